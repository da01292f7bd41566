"""Benchmark decontamination: a prefix-filtered set join of item windows with whole documents.

Every benchmark item is cut into windows of its words. A window is a set of shingles with offsets; shingles are
ordered by rarity, which is their count over all documents, and the window is indexed under its necessary prefix: of
|S| shingles that all must occur (exact containment), the single rarest. Documents are read twice, whatever the size of
the benchmark: first the shingles that items have are counted, then every position that holds a prefix shingle proposes
starts by the shingle's offsets in a join of positions with windows (positional bound). Starts before the document or
ending past it are dropped (length bound), and the remaining windows are verified word by word.

Both passes let only those positions go that a Bloom filter of bounded size may hold; fuller filters pass more, never
less, and the joins are exact. Neither windows nor positions are ever gathered in the driver or in one task. Shingles
that are common for the prefix they are (a common one-word item has no other) are cut into parts, as many as their
counts ask for. Where a window is one shingle, a document sends it once, with all its places. Items are known by numbers
of their windows and come in only where a document's hits are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _hashing
from ._common import Stored, packs, small

#: Words of a window, and of a shingle in it.
WINDOW, SHINGLE = 13, 5
LAST = (1 << 63) - 1
PACK_BYTES = 1 << 20
#: A key of the join of positions has at most this share of them, or so many; so at most SHARE codes need parts.
SHARE, LEAST_PART = 10_000, 4096
#: Blocks of 64 bits of a filter at most.
MOST_BLOCKS = 1 << 20
#: Contaminated documents that a broadcast takes; more are taken out by a shuffled join.
MOST_BROADCAST = 500_000
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: A-Z to a-z; all other ASCII but a-z and 0-9 to a blank; bytes of other characters stay.
TABLE = bytes(
    b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).translate(bytes.maketrans(_UPPER, _LOWER))
)


def codes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Numbers of all runs of `size` words, also those across texts; other sizes have other numbers."""
    return _hashing.mix(_hashing.rolling(hashes, size) + np.uint64(size))


# -- filters ------------------------------------------------------------------------------------------------------


def _bits(keys: np.ndarray) -> np.ndarray:
    """Four of the 64 bits of a block."""
    mixed, out = _hashing.mix(keys + np.uint64(17)), np.zeros(len(keys), np.uint64)
    for i in range(4):
        out |= np.uint64(1) << (mixed >> np.uint64(6 * i)) % np.uint64(64)
    return out


def _filter(keys: DataFrame, column: str) -> np.ndarray:
    """A blocked Bloom filter of a column of numbers: at least four keys a block, at most MOST_BLOCKS blocks."""
    blocks, n = min(1 << 10, MOST_BLOCKS), keys.count()
    while blocks < MOST_BLOCKS and blocks * 4 < n:
        blocks *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(blocks, np.uint64)
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            np.bitwise_or.at(filled, own % np.uint64(blocks), _bits(own))
        at = np.flatnonzero(filled)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(filled[at].view(np.int64))], ["block", "bits"])

    parts = keys.select(F.col(column).cast("long")).mapInArrow(run, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(blocks, np.uint64)
    out[parts["block"].to_numpy()] = parts["bits"].to_numpy().view(np.uint64)
    return out


def _may_hold(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = _bits(keys)
    return filled[keys % np.uint64(len(filled))] & bits == bits


# -- windows ------------------------------------------------------------------------------------------------------


def windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(words, n, k, codes, item): a row for each window of each item of benchmark (item_id, text), its words joined by blanks,
    and the codes of its shingles of k words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in packs(batches, PACK_BYTES, "text", "item"):
            out = []
            for text, item in rows:
                held = text.translate(TABLE).split()
                if not held:
                    continue
                n = min(window, len(held))
                k = min(shingle, n)
                runs = codes(_hashing.words([b" ".join(held)])[1][0], k).view(np.int64)
                for i in range(len(held) - n + 1):
                    out.append((b" ".join(held[i : i + n]), n, k, runs[i : i + n - k + 1], item))
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["words", "n", "k", "codes", "item"])

    plain = benchmark.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), F.col("item_id").cast("string").alias("item"))
    return plain.mapInArrow(run, "words binary, n int, k int, codes array<long>, item string")


def _runs(texts: list[bytes], sizes: list[int]) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(where each text's words begin, with the end of the last; by shingle size the places and codes of its runs)."""
    starts, (h,) = _hashing.words([t.translate(TABLE) for t in texts])
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(starts[-1])
    out = {}
    for k in sizes:
        at = np.flatnonzero(left >= k)
        out[k] = at, codes(h, k)[at] if len(at) else np.empty(0, np.uint64)
    return starts, out


def _rarity(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """(code, count): how often the shingles (code) occur in all of docs, and some others that the filter lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(shingles, "code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in packs(batches, PACK_BYTES, "text"):
            _, found = _runs([r[0] for r in rows], sizes)
            every = np.concatenate([c[_may_hold(shared.value, c)] for _, c in found.values()] or [np.empty(0, np.uint64)])
            code, n = np.unique(every, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n, pa.int64())], ["code", "n"])

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("count"))


def _prefixes(found: DataFrame, docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(code, offset, words, n, window, whole, count): every window of (words, n, k, codes, window) under its rarest shingle,
    which is the whole of it or not; windows with one that no document has are left out, as no document has them."""
    each = found.select("window", F.posexplode("codes").alias("offset", "code"))
    counted = each.join(_rarity(docs, found.select(F.explode("codes").alias("code")).distinct(), sizes), "code", "left")
    rarest = counted.groupBy("window").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "code", "offset")).alias("r")).where("r.count > 0")
    return found.select("words", "n", (F.col("n") == F.col("k")).alias("whole"), "window").join(rarest, "window").select("r.code", "r.offset", "words", "n", "window", "whole", "r.count")


def _parts(prefixes: DataFrame) -> dict[int, int]:
    """Into how many parts the positions of a code are cut, for codes with more than a part: at most SHARE of them, since each
    has more than that share of all."""
    counts = prefixes.groupBy("code").agg(F.max("count").alias("count"))
    total = counts.agg(F.sum("count")).first()[0] or 0
    most = max(LEAST_PART, total // SHARE)
    return {r["code"]: -(-r["count"] // most) for r in counts.where(F.col("count") > most).collect()}


def _positions(docs: DataFrame, prefixes: DataFrame, sizes: list[int], reach: int, parts: dict[int, int]) -> DataFrame:
    """(doc_id, mark, n_words, code, part, whole, around, at, places): for every row of docs one without code, and one for every
    position that may hold a prefix shingle of a longer window, with the words around it, of which it begins at the at-th.
    For windows that are one shingle, one with whole for all places of the shingle's words in a document (of more than
    LEAST_PART, several)."""
    share = docs.sparkSession.sparkContext.broadcast
    longer, whole, cut = share(_filter(prefixes.where("not whole"), "code")), share(_filter(prefixes.where("whole"), "code")), share(parts)

    def of(texts: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int, int, bool]]]:
        """(where texts begin, (place, code, size, whole) in order of places)."""
        starts, found = _runs(texts, sizes)
        hits = [(at[hit], c[hit], k, w) for k, (at, c) in found.items() for w, filled in ((False, longer), (True, whole)) for hit in (_may_hold(filled.value, c),)]
        return starts, sorted((p, c, k, w) for at, code, k, w in hits for p, c in zip(at.tolist(), code.view(np.int64).tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in packs(batches, PACK_BYTES, "text", "doc_id", "mark"):
            starts, places = of([r[0] for r in rows])
            out = [(doc_id, mark, int(n), *[None] * 6) for (_, doc_id, mark), n in zip(rows, np.diff(starts), strict=True)]
            documents = (np.searchsorted(starts, [p[0] for p in places], "right") - 1).tolist()
            held, words, same = -1, [], {}
            for (p, c, k, is_whole), d in zip(places, documents, strict=True):
                if d != held:
                    held, words = d, rows[d][0].translate(TABLE).split()
                p -= int(starts[d])
                if is_whole:
                    same.setdefault((d, c, b" ".join(words[p : p + k])), []).append(p)
                else:
                    first, (_, doc_id, mark) = max(0, p - reach), rows[d]
                    out.append((doc_id, mark, None, c, _part(cut.value, c, doc_id + p), False, b" ".join(words[first : p + reach + 1]), p - first, [p]))
            for (d, c, shingle), at in same.items():
                for i in range(0, len(at), LEAST_PART):
                    out.append((rows[d][1], rows[d][2], None, c, _part(cut.value, c, rows[d][1] + i), True, shingle, 0, at[i : i + LEAST_PART]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
            names = ["doc_id", "mark", "n_words", "code", "part", "whole", "around", "at", "places"]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names)

    return docs.mapInArrow(run, "doc_id long, mark long, n_words long, code long, part int, whole boolean, around binary, at int, places array<long>")


def _part(parts: dict[int, int], code: int, at: int) -> int:
    return at % parts.get(code, 1)


def _plain(docs: DataFrame) -> DataFrame:
    """(text, doc_id, mark): bytes, the id with null as the last one, and a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(text.cast("binary").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("mark"))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """(doc_id, mark, n_words, n_hit, items) for each row of docs."""
    plain = _plain(docs)
    each = Stored(windows(benchmark, window, shingle), "item-windows").df
    every = each.groupBy("words").agg(F.max("n").alias("n"), F.max("k").alias("k"), F.first("codes").alias("codes"))
    every = Stored(every.withColumn("window", F.monotonically_increasing_id()), "windows").df
    items = each.where("item is not null").join(every.select("words", "window"), "words").select("window", "item").distinct()
    sizes = sorted(r[0] for r in every.select("k").distinct().collect())  # at most `shingle` numbers
    prefixes = Stored(_prefixes(every, plain, sizes), "prefixes").df
    parts = _parts(prefixes)
    seen = Stored(_positions(plain, prefixes, sizes, window - 1, parts), "positions").df
    rows = seen.where("code is null").select("doc_id", "mark", "n_words")
    cut = docs.sparkSession.createDataFrame(list(parts.items()), "code LONG, parts INT")  # at most SHARE rows
    dealt = prefixes.join(F.broadcast(cut), "code", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    met = seen.where("code is not null").join(dealt.drop("parts", "count"), ["code", "part", "whole"]).withColumn("start", F.col("at") - F.col("offset"))
    # Of the words around the position, those that the window would take.
    taken = F.array_join(F.slice(F.split(F.col("around").cast("string"), " "), F.greatest(F.lit(1), F.col("start") + 1), F.col("n")), " ")
    hits = met.where((F.col("start") >= 0) & (taken.cast("binary") == F.col("words")))
    hits = Stored(hits.select("doc_id", "mark", F.explode("places").alias("pos"), "offset", "n", "window").select("doc_id", "mark", (F.col("pos") - F.col("offset")).alias("s"), "n", "window").distinct(), "hits").df
    span = F.struct("s", (F.col("s") + F.col("n")).alias("e"))
    by_doc = hits.select("doc_id", "mark", "s", "n").distinct().groupBy("doc_id", "mark").agg(_covered(F.sort_array(F.collect_list(span))).alias("n_hit"))
    listed = hits.select("doc_id", "mark", "window").distinct().join(items, "window").groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = rows.join(by_doc, ["doc_id", "mark"], "left").join(listed, ["doc_id", "mark"], "left")
    return out.select("doc_id", "mark", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _covered(spans: Column) -> Column:
    """Positions that spans (s, e), in order, cover together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda a, p: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), p["e"] - F.greatest(a["to"], p["s"]))).alias("n"), F.greatest(a["to"], p["e"]).alias("to"))
    return F.aggregate(spans, start, step)["n"]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_hit, items) for each row of docs (doc_id, text): the words that an item's window covers.

    A window is `window` consecutive words of an item, or the whole of a shorter item. Null or wordless texts have no
    words and no hits; null or wordless items give no window; a null item_id hits without being listed. Repeated rows
    are judged each; an empty benchmark hits nothing; other columns are ignored.
    """
    null = F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id")
    return _found(docs, benchmark, window, shingle).select(null, "n_words", "n_hit", "items")


def _is_bad(percent: int) -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)


def judge(docs: DataFrame, benchmark: DataFrame, percent: int = 5, **how) -> DataFrame:
    """find() with n_items, items_sha256 and contaminated: at least `percent` of the words are hit."""
    return find(docs, benchmark, **how).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        _is_bad(percent).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 5, **how) -> DataFrame:
    """The rows of docs that judge() doesn't call contaminated, with their columns, whatever their names."""
    found = _found(docs, benchmark, how.get("window", WINDOW), how.get("shingle", SHINGLE)).where(_is_bad(percent))
    bad = Stored(found.select(F.col("doc_id").alias("__bad_id"), F.col("mark").alias("__bad_mark")).distinct(), "contaminated").df
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col("__bad_id")) & (F.xxhash64(text) == F.col("__bad_mark"))
    return docs.join(F.broadcast(bad) if small(bad, MOST_BROADCAST) else bad, same, "left_anti")
