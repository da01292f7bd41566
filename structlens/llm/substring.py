"""Substring dedup by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of BLOCK words, and every rolling window of BLOCK words probes
the index of all blocks. A repeat of WINDOW words holds a whole block of either text, so it has a hit on both sides.
Hits are extended to maximal exact repeats: the windows of WINDOW words whose own blocks are all hit go to a second
exchange that finds the first occurrence of each; what overlapping later occurrences cover is removed. There windows
meet by 64 + 16 bits of their hashes and the number of their bucket.

Both exchanges move packed numbers, not rows: a task packs the texts it reads, keeps one record of each hash in a
pack (a repeat inside a pack is settled there), and sends a blob to every bucket of hashes. A hash that is very common
costs one record a pack, not one an occurrence, and nothing grows with the square of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _hashing
from ._common import Stored
from ._deal import buckets, even_keys

WINDOW, BLOCK = 20, 10
#: Bytes of text in a pack; a longer text is a pack of its own.
PACK_BYTES = 2 << 20
LAST = (1 << 63) - 1
ROWS = "bucket long, pack long, kind int, data binary"
DOCS, RECORDS, HITS = 0, 1, 2


class Pack:
    """Texts with their hashes; documents in the order of (doc_id, text hash), exact repeats dropped."""

    def __init__(self, rows: list[tuple[int, int, bytes, object]], tables: int):
        rows.sort(key=lambda r: r[:2])
        kept = [r for i, r in enumerate(rows) if not i or r[:2] != rows[i - 1][:2]]
        self.ids = np.array([r[0] for r in kept], np.int64)
        self.marks = np.array([r[1] for r in kept], np.int64)
        self.extra = [r[3] for r in kept]
        starts, self.hashes = _hashing.words([r[2] for r in kept], tables)
        self.starts = starts.astype(np.int64)
        counts = np.diff(self.starts)
        self.doc = np.repeat(np.arange(len(kept)), counts)
        self.left = np.repeat(self.starts[1:], counts) - np.arange(self.starts[-1])  # words up to the text's end
        self.number = xxhash.xxh3_64_intdigest(self.header()) >> 1

    def header(self) -> bytes:
        return _blob(self.ids, self.marks, self.starts)


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; each with its length and type."""
    parts = []
    for a in arrays:
        parts += [np.array([len(a), "?BHIQbhilq".index(a.dtype.char if a.dtype.char != "L" else "Q")], np.int64).tobytes(), a.tobytes()]
    return b"".join(parts)


def _arrays(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, kind = np.frombuffer(data, np.int64, 2, at)
        dtype = np.dtype("?BHIQbhilq"[kind])
        out.append(np.frombuffer(data, dtype, int(n), at + 16))
        at += 16 + int(n) * dtype.itemsize
    return out


def _packs(batches, tables: int, extra: str | None = None) -> Iterator[Pack]:
    rows, held = [], 0
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("doc_id", "mark", "text")]
        more = batch.column(extra).to_pylist() if extra else [None] * batch.num_rows
        for row in zip(*columns, more, strict=True):
            rows.append(row)
            held += len(row[2])
            if held >= PACK_BYTES:
                yield Pack(rows, tables)
                rows, held = [], 0
    if rows:
        yield Pack(rows, tables)


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "pack", "kind", "data"])


def _planes(x: np.ndarray, n_bytes: int) -> np.ndarray:
    """The low bytes of numbers, byte by byte: sorted high bytes compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T).ravel()


def _unplaned(b: np.ndarray, n_bytes: int) -> np.ndarray:
    out = np.zeros((len(b) // n_bytes, 8), np.uint8)
    out[:, :n_bytes] = b.reshape(n_bytes, -1).T
    return out.view("<u8").ravel()


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where groups of equal neighbours begin, their sizes)."""
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
    return first, np.diff(np.concatenate((first, [len(values)])))


def _by_bucket(bucket: np.ndarray, n: int):
    """(bucket, positions of its records), records of a bucket in their order."""
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in range(n):
        if bounds[b] < bounds[b + 1]:
            yield b, order[bounds[b] : bounds[b + 1]]


# -- first exchange: blocks and probes ----------------------------------------------------------------------------


def anchors(docs: DataFrame, keys: list[int]) -> DataFrame:
    """ROWS: for every pack its documents with the windows that repeat inside it, and for every bucket its records.

    A record is a window of BLOCK words: 40 bits of its hash, its first position in the pack, whether it is also a
    reference block, and whether the pack has settled it already.
    """
    n = len(keys)

    def run(batches):
        for pack in _packs(batches, 1):
            h = _hashing.rolling(pack.hashes[0], BLOCK)
            long_enough = np.diff(pack.starts)[pack.doc[: len(h)]] >= WINDOW if len(h) else np.empty(0, bool)
            at = np.flatnonzero((pack.left[: len(h)] >= BLOCK) & long_enough)
            f = h[at]
            order = np.argsort(f, kind="stable")
            at, f = at[order], f[order]
            first, size = _groups(f)
            block = (at - pack.starts[pack.doc[at]]) % BLOCK == 0
            is_block = np.logical_or.reduceat(block, first) if len(first) else block
            direct = at[np.repeat(size > 1, size)]
            rows = [(keys[pack.number % n], pack.number, DOCS, _blob(pack.ids, pack.marks, pack.starts, direct.astype(np.uint32)))]
            f, at = f[first], at[first]
            flags = is_block.astype(np.uint64) | ((size > 1).astype(np.uint64) << np.uint64(1))
            where = (at.astype(np.uint64) << np.uint64(2)) | flags
            width = 3 if len(pack.doc) < 1 << 22 else 5
            bucket = ((f & np.uint64(0xFFFFFF)) % np.uint64(n)).astype(np.int32)
            for b, some in _by_bucket(bucket, n):
                data = _blob(_planes(f[some] >> np.uint64(24), 5), _planes(where[some], width), np.array([width], np.uint8))
                rows.append((keys[b], pack.number, RECORDS, data))
            yield _table(rows)

    return docs.mapInArrow(run, ROWS)


def _gathered(batches) -> tuple[list[tuple], list[tuple[int, int, list[np.ndarray]]]]:
    through, records = [], []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[2] == RECORDS:
                records.append((row[0], row[1], _arrays(row[3])))
            else:
                through.append(row)
    return through, records


def probe(rows: DataFrame) -> DataFrame:
    """ROWS of anchors() by bucket to DOCS rows as they are and HITS rows: positions whose window occurs elsewhere too,
    and is a reference block in one of its places."""

    def run(batches):
        through, records = _gathered(batches)
        if through:
            yield _table(through)
        if not records:
            return
        key = np.concatenate([_unplaned(r[2][0], 5) for r in records])
        where = np.concatenate([_unplaned(r[2][1], int(r[2][2][0])) for r in records])
        row = np.repeat(np.arange(len(records)), [len(r[2][0]) // 5 for r in records])
        bucket = np.array([r[0] for r in records])[row]
        order = np.argsort(key, kind="stable") if len(set(bucket.tolist())) == 1 else np.lexsort((key, bucket))
        key, where, row, bucket = key[order], where[order], row[order], bucket[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])))
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate((first, [len(key)])))
        indexed = np.bitwise_or.reduceat(where, first)
        hit = (size > 1) | (indexed & np.uint64(2) > 0)
        hit &= indexed & np.uint64(1) > 0
        wanted = np.repeat(hit, size) & (where & np.uint64(2) == 0)
        row, where = row[wanted], (where[wanted] >> np.uint64(2)).astype(np.uint32)
        out = []
        for r, some in _by_bucket(row, len(records)):
            out.append((records[r][0], records[r][1], HITS, np.sort(where[some]).tobytes()))
            if len(out) == 1000:
                yield _table(out)
                out = []
        if out:
            yield _table(out)

    return rows.mapInArrow(run, ROWS)


def _answers(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Of the rows of one pack: its DOCS arrays, and all positions that were hit."""
    docs, hits = None, []
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
        if kind == DOCS:
            docs = _arrays(data)
            hits.append(docs[3])
        else:
            hits.append(np.frombuffer(data, np.uint32))
    return docs, np.concatenate(hits)


def _runs(flags: np.ndarray) -> np.ndarray:
    """[start, end) of the runs of true values, flat."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))


def _runs_by_doc(docs: list[np.ndarray], flags: np.ndarray) -> pa.Table:
    """(doc_id, mark, runs): the runs of flagged words, counted in each text."""
    ids, marks, starts = docs[:3]
    edges = _runs(flags)
    begin, end = edges[::2], edges[1::2]
    # A run may go on from one text into the next: cut it there.
    cuts = starts[1:-1]
    extra = cuts[flags[np.maximum(cuts - 1, 0)] & flags[np.minimum(cuts, len(flags) - 1)] & (cuts > 0) & (cuts < len(flags))]
    extra = np.unique(extra)
    begin, end = np.sort(np.concatenate((begin, extra))), np.sort(np.concatenate((end, extra)))
    doc = np.searchsorted(starts, begin, "right") - 1
    first, size = _groups(doc)
    flat = np.stack((begin - starts[doc], end - starts[doc]), 1).astype(np.int32)
    blobs = [flat[a : a + n].tobytes() for a, n in zip(first, size, strict=True)]
    return pa.table({"doc_id": ids[doc[first]], "mark": marks[doc[first]], "runs": pa.array(blobs, pa.binary())})


def candidates(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, runs) of probe()'s rows: runs of starts of WINDOW words whose own blocks are all hit."""

    def run(table: pa.Table) -> pa.Table:
        docs, hits = _answers(table)
        starts = docs[2]
        hit = np.zeros(starts[-1], bool)
        hit[hits] = True
        n = np.diff(starts)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(starts[-1]) - starts[doc]
        # The first block that begins at or after a window's start, and the next if it still fits.
        block = -(-at // BLOCK) * BLOCK + starts[doc]
        flags = at + WINDOW <= n[doc]
        safe = np.minimum(block, len(hit) - 1)
        flags &= hit[safe]
        second = (block + 2 * BLOCK <= np.arange(starts[-1]) + WINDOW) & flags
        flags &= ~second | hit[np.minimum(safe + BLOCK, len(hit) - 1)]
        return _runs_by_doc(docs, flags)

    return rows.groupBy("pack").applyInArrow(run, "doc_id long, mark long, runs binary")


# -- second exchange: first occurrences of windows ---------------------------------------------------------------


def windows(docs: DataFrame, keys: list[int]) -> DataFrame:
    """ROWS of docs with candidate runs: for every pack its documents with the windows that an earlier one in the pack
    repeats, and for every bucket the first occurrence in the pack of each window."""
    n = len(keys)

    def run(batches):
        for pack in _packs(batches, 2, "runs"):
            flags = np.zeros(len(pack.doc) + 1, np.int64)
            for i, runs in enumerate(pack.extra):
                for part in runs:
                    edges = np.frombuffer(part, np.int32).astype(np.int64) + pack.starts[i]
                    np.add.at(flags, edges[::2], 1)
                    np.add.at(flags, edges[1::2], -1)
            at = np.flatnonzero(np.cumsum(flags[:-1]) > 0)
            one, two = (_hashing.rolling(h, WINDOW) for h in pack.hashes)
            one, two = one[at], two[at]
            order = np.lexsort((at, two, one))
            one, two, at = one[order], two[order], at[order]
            new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))) if len(at) else np.empty(0, bool)
            rows = [(keys[pack.number % n], pack.number, DOCS, _blob(pack.ids, pack.marks, pack.starts, at[~new].astype(np.uint32)))]
            one, two, at = one[new], two[new], at[new]
            bucket = ((two & np.uint64(0xFFFFFF)) % np.uint64(n)).astype(np.int32)
            for b, some in _by_bucket(bucket, n):
                present, doc = np.unique(pack.doc[at[some]], return_inverse=True)
                data = _blob(
                    _planes(one[some], 8), _planes(two[some] >> np.uint64(24), 2), at[some].astype(np.uint32), doc.astype(np.uint32),
                    pack.ids[present], pack.marks[present], pack.starts[present],
                )
                rows.append((keys[b], pack.number, RECORDS, data))
            yield _table(rows)

    return docs.mapInArrow(run, ROWS)


def later(rows: DataFrame) -> DataFrame:
    """ROWS of windows() by bucket to DOCS rows as they are and HITS rows: windows that another pack has earlier."""

    def run(batches):
        through, records = _gathered(batches)
        if through:
            yield _table(through)
        if not records:
            return
        parts = []
        for number, (bucket, _, (one, two, at, doc, ids, marks, starts)) in enumerate(records):
            m = len(at)
            parts.append((_unplaned(one, 8), _unplaned(two, 2).astype(np.uint16), at, np.full(m, number), np.full(m, bucket), ids[doc], marks[doc], at - starts[doc]))
        one, two, at, row, bucket, ids, marks, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((two, one))
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        shared = np.zeros(len(order) + 1, bool)
        shared[:-1][1:] |= same
        shared[:-1][: len(same)] |= same
        some = order[shared[:-1]]
        some = some[np.lexsort((place[some], marks[some], ids[some], bucket[some], two[some], one[some]))]
        a, b = some[1:], some[:-1]
        new = np.concatenate(([True], (one[a] != one[b]) | (two[a] != two[b]) | (bucket[a] != bucket[b]))) if len(some) else np.empty(0, bool)
        head = some[np.flatnonzero(new)][np.cumsum(new) - 1] if len(some) else some
        after = (ids[some] != ids[head]) | (marks[some] != marks[head]) | (place[some] != place[head])
        some = some[after]
        out = []
        for r, picked in _by_bucket(row[some], len(records)):
            out.append((records[r][0], records[r][1], HITS, np.sort(at[some[picked]]).astype(np.uint32).tobytes()))
            if len(out) == 1000:
                yield _table(out)
                out = []
        if out:
            yield _table(out)

    return rows.mapInArrow(run, ROWS)


def removed(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, runs) of later()'s rows: the words that windows with an earlier occurrence cover."""

    def run(table: pa.Table) -> pa.Table:
        docs, hits = _answers(table)
        starts = docs[2]
        if not len(hits):
            return pa.table({"doc_id": pa.array([], pa.int64()), "mark": pa.array([], pa.int64()), "runs": pa.array([], pa.binary())})
        edges = np.zeros(starts[-1] + 1, np.int64)
        np.add.at(edges, hits.astype(np.int64), 1)
        np.add.at(edges, hits.astype(np.int64) + WINDOW, -1)
        return _runs_by_doc(docs, np.cumsum(edges[:-1]) > 0)

    return rows.groupBy("pack").applyInArrow(run, "doc_id long, mark long, runs binary")


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "mark").agg(F.collect_list("runs").alias("runs"))


def dedup(docs: DataFrame, digest_only: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs (doc_id, text): the words left, joined by one space.

    With digest_only, kept_sha256 instead of kept. A word goes if a window of WINDOW words that covers it has the same
    words as one that starts earlier: in a document of a smaller id, or before it in the same. Null ids come last.
    Rows that share an id are ordered by a hash of their text; rows equal in id and text are one document and treated
    alike. Null and empty texts have no words; texts of fewer than WINDOW words keep all. No rows give no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"), F.col("doc_id").isNull().alias("unnamed"))
    n = buckets(docs)
    keys = even_keys(spark, n)
    rows = source.select("doc_id", "mark", "text")
    found = Stored(candidates(probe(anchors(rows, keys).repartition(n, "bucket"))), "anchors")
    runs = _merged(found.df)
    both = rows.join(runs, ["doc_id", "mark"])
    gone = Stored(removed(later(windows(both, keys).repartition(n, "bucket"))), "repeats")
    found.drop()
    joined = source.join(_merged(gone.df), ["doc_id", "mark"], "left")

    def finish(batches):
        for batch in batches:
            ids, unnamed, texts, runs = (batch.column(c).to_pylist() for c in ("doc_id", "unnamed", "text", "runs"))
            out = []
            for i, u, t, r in zip(ids, unnamed, texts, runs, strict=True):
                words = t.split()
                n_words, dropped = len(words), 0
                if r:
                    drop = np.zeros(n_words, bool)
                    for part in r:
                        for a, b in np.frombuffer(part, np.int32).reshape(-1, 2):
                            drop[a:b] = True
                    dropped = int(drop.sum())
                    words = [w for w, d in zip(words, drop, strict=True) if not d]
                kept = b" ".join(words)
                out.append((None if u else i, n_words, dropped, hashlib.sha256(kept).hexdigest() if digest_only else kept.decode()))
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_words", "n_removed", last])

    last = "kept_sha256" if digest_only else "kept"
    return joined.mapInArrow(finish, f"doc_id long, n_words long, n_removed long, {last} string")
