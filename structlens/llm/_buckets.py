"""Buckets that several nodes share, found by an exchange of packed numbers.

A task packs the keys of its rows and sends a blob to every part of the key space; a part holds about PART_BYTES, so
parts grow in number with the input. A part is read in chunks. Of a key that one node had so far, one record is kept; as
soon as a second node has it, the records of all nodes but the first leave as rows. So a key that a third of all nodes
have takes no more memory than any other, and of keys that nothing shares no row is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of records in a part; records that a task packs at once, and that a part takes in at once.
PART_BYTES, PACK, CHUNK = 8 << 20, 1 << 21, 1 << 20
#: Of a record: a key, the two halves of a node, and its size.
RECORD_BYTES = 26
#: Sizes count in units of so many bytes, the last standing for all above.
UNIT = 64
_FILTER = 1 << 22

Records = tuple[np.ndarray, np.ndarray, np.ndarray]  # keys, halves of nodes, sizes


def shared(nodes: DataFrame, bands: int) -> DataFrame:
    """(bucket, a, node, bytes): for every bucket that several of nodes (node, bytes, bands) have, its first node a with each
    other one.

    node is 16 bytes, bands the 64-bit keys of its buckets, `bands` of them, as bytes; sizes come back in units of
    UNIT. Rows of nodes may repeat, those of the result don't.
    """
    parts = max(1, nodes.count() * bands * RECORD_BYTES // PART_BYTES)
    bits = parts.bit_length()  # at least one: no shift by all 64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Records] = []
        for batch in batches:
            held.append(_records(batch, bands))
            if sum(len(x[0]) for x in held) >= PACK:
                yield _dealt(_joined(held), bits)
                held = []
        if held:
            yield _dealt(_joined(held), bits)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, held, size = None, None, [], 0
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if held and (part != now or size >= CHUNK):
                    out, state = _met(_joined(held), state, part == now)
                    yield _rows(*out)
                    held, size = [], 0
                if part != now:
                    now, state = part, None
                held.append(_read(data))
                size += len(held[-1][0])
        if held:
            yield _rows(*_met(_joined(held), state, False)[0])

    blobs = nodes.select("node", "bytes", "bands").mapInArrow(pack, "part long, data binary")
    found = blobs.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "bucket long, a binary, node binary, bytes long")
    return found.distinct()


def _records(batch: pa.RecordBatch, bands: int) -> Records:
    keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.uint64)
    names = np.frombuffer(b"".join(batch.column("node").to_pylist()), np.uint64).reshape(-1, 2)
    sizes = np.minimum(batch.column("bytes").to_numpy(zero_copy_only=False) // UNIT + 1, 0xFFFF).astype(np.uint16)
    return keys, np.repeat(names, bands, axis=0), np.repeat(sizes, bands)


def _joined(held: list[Records]) -> Records:
    return tuple(np.concatenate([x[i] for x in held]) for i in range(3)) if len(held) > 1 else held[0]


def _read(data: bytes) -> Records:
    n = len(data) // RECORD_BYTES
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint64, 2 * n, 8 * n).reshape(-1, 2), np.frombuffer(data, np.uint16, n, 24 * n)


def _dealt(records: Records, bits: int) -> pa.RecordBatch:
    keys = records[0]
    part = (keys >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    columns = [np.split(x[order], cuts) for x in records]
    data = [b"".join(x.tobytes() for x in row) for row in zip(*columns, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[np.concatenate(([0], cuts))].astype(np.int64)), pa.array(data, pa.binary())], ["part", "data"])


def _met(records: Records, state: Records | None, goes_on: bool):
    """((key, first node, other node, size) of what leaves, the state if the part goes on).

    state has a record of each key so far, which stays its key's first: other nodes are known by their difference from it.
    """
    known = 0
    if state is not None:
        known = len(state[0])
        records = _joined([state, records])
    keys, names, sizes = records
    late = np.arange(len(keys)) >= known
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    there = np.zeros(_FILTER, bool)
    there[twice & np.uint64(_FILTER - 1)] = True
    some = np.flatnonzero(there[keys & np.uint64(_FILTER - 1)])
    some = some[np.lexsort((names[some, 1], names[some, 0], late[some], keys[some]))]
    k, n = keys[some], names[some]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    leaves = (n != n[head]).any(axis=1)
    leaves[1:] &= new[1:] | (n[1:] != n[:-1]).any(axis=1)
    out = k[leaves], n[head][leaves], n[leaves], sizes[some][leaves]
    if not goes_on:
        return out, None
    every = np.lexsort((names[:, 1], names[:, 0], late, keys))
    first = every[np.concatenate(([True], keys[every][1:] != keys[every][:-1]))]
    return out, tuple(x[first] for x in records)


def _rows(keys: np.ndarray, first: np.ndarray, other: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    names = [pa.Array.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary()) for x in (first, other)]
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *names, pa.array(sizes.astype(np.int64) * UNIT)], ["bucket", "a", "node", "bytes"])
