"""Words of many texts and their hashes at once, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

_SPAN = 64
_TABLES = np.random.default_rng(20240229).integers(0, 1 << 64, size=(2, 256 * _SPAN), dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of runs a followed by runs b."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def words(texts: list[bytes], tables: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """(where each text's words begin, with the end of the last; `tables` independent hashes of every word).

    Words stand between blanks. Up to 64 bytes a word's hash is a tabulation hash of its bytes; of longer ones, xxh3.
    """
    buffer = b"\n".join(texts)
    raw = np.frombuffer(buffer, np.uint8)
    blank = _BLANK[raw]
    edge = np.diff(np.concatenate(([1], blank.view(np.int8), [1])).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = last - first
    text_at = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts = np.searchsorted(first, text_at)
    if not len(first):
        return starts, [np.empty(0, np.uint64) for _ in range(tables)]
    inside = np.flatnonzero(~blank)
    cell = raw[inside].astype(np.int32) * _SPAN + ((inside - np.repeat(first, size)) & (_SPAN - 1)).astype(np.int32)
    at = np.cumsum(size) - size
    long = np.flatnonzero(size > _SPAN)
    out = []
    for t in range(tables):
        h = mix(np.add.reduceat(_TABLES[t][cell], at) + size.astype(np.uint64))
        for i in long:
            h[i] = xxhash.xxh3_64_intdigest(buffer[first[i] : last[i]], seed=t)
        out.append(h)
    return starts, out


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, also those across texts; empty if there are fewer words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    power, size, out, done = h, 1, None, 0
    while n >> (size.bit_length() - 1):
        if n & size:
            out = power if out is None else join(out[: len(power) - done], power[done:]) if len(power) > done else np.empty(0, np.uint64)
            done += size
        if n >> size.bit_length() == 0:
            break
        power = join(power[:-size], power[size:])
        size *= 2
    return out[: len(h) - n + 1]
