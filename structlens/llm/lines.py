"""Fuzzy line dedup by MinHash over character shingles.

Equal lines are one node from the start. A line's shingles are the SHINGLE characters from each of its characters on,
blanks included; a shorter line is one shingle. Their hashes fall into BANDS parts by one of their digits; a band is the
minima of a part in ROWS orders. Lines that share a band are candidates, sketches and parities of their sets rule out most,
the exact Jaccard similarity of the shingle sets confirms the rest, and distributed union-find makes components, of which the first
occurrence stays. DataFrame operations only.

`signatures` and `shingle_sets` are numpy forms of bands and sets for lines that are at hand; no query runs them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _hashing, _link
from ._bloom import blocks_for, bloom, probed
from ._common import Stored
from ._deal import buckets
from ._graph import components

SHINGLE, PERCENT = 9, 80
#: Were minima independent, a pair at exactly 0.8 would share no band with probability 2e-5, one at 0.9 with 1e-9.
#: BANDS is a power of two.
BANDS, ROWS = 16, 3
BINS = BANDS * ROWS
LAST = (1 << 63) - 1
#: Of a line's sketch and parities: how many classes, in how many longs (a power of two).
WORDS = 8
CLASSES = 64 * WORDS
_WORDED = r"[^\x20\x09-\x0D]"
_WIDE = r"[^\x00-\xFF]"
_RANDOM = np.random.default_rng(12)
#: Of each bin, the order in which it looks for another when empty; what tells borrowed values apart; a seed of each band.
_ORDER = np.stack([_RANDOM.permutation(BINS) for _ in range(BINS)])
_SALT = _RANDOM.integers(0, 1 << 32, size=BINS, dtype=np.uint64).astype(np.uint32)
_SEED = _RANDOM.integers(0, 1 << 63, size=BANDS, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _windows(codes: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of the `size` numbers from each place on, taken as zero beyond the end."""
    done, length, power, step = codes, 0, codes, 1
    ahead = lambda x, n: np.concatenate((x[n:], np.zeros(min(n, len(x)), x.dtype)))
    factor = np.array([_BASE]).astype(codes.dtype)
    while True:
        if size & step:
            done = done * factor + ahead(power, length) if length else power
            length += step
            if length == size:
                return done
        power = power * factor + ahead(power, step)
        factor, step = factor * factor, step * 2


def _numbers(lines: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """The code points of lines one after the other, each plus one, and where each line ends; lines hold no newline."""
    codes = np.frombuffer(b"\n".join(lines).decode(errors="replace").encode("utf-32-le"), np.uint32) + np.uint32(1)
    return codes, np.append(np.flatnonzero(codes == 11), len(codes)).tolist()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def signatures(lines: list[bytes]) -> np.ndarray:
    """A key of each band for each line."""
    codes, ends = _numbers(lines)
    hashes = _mixed(_windows(codes, SHINGLE))
    valid, counts, start = np.ones(len(codes), bool), np.ones(len(lines), np.int64), 0
    for i, end in enumerate(ends):
        if end - start >= SHINGLE:
            hashes[start : end - SHINGLE + 1].sort()
            valid[end - SHINGLE + 1 : end + 1] = False
            counts[i] = end - SHINGLE + 1 - start
        elif end > start:
            hashes[start] = _mixed(_windows(codes[start:end], end - start)[:1])[0]
            valid[start + 1 : end + 1] = False
        else:  # an empty line has no shingle
            valid[end : end + 1] = False
            counts[i] = 0
        start = end + 1
    line, value = np.repeat(np.arange(len(lines)), counts), hashes[valid]
    bins = (value.astype(np.uint64) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(value), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (line[1:] != line[:-1])
    least, full = np.zeros((len(lines), BINS), np.uint32), np.zeros((len(lines), BINS), bool)
    least[line[first], bins[first]] = value[first]
    full[line[first], bins[first]] = True
    some = np.flatnonzero(~full.all(axis=1))
    if len(some):
        own, has = least[some], full[some]
        for b in range(BINS):
            empty = np.flatnonzero(~has[:, b])
            lender = _ORDER[b][has[empty][:, _ORDER[b]].argmax(axis=1)]
            least[some[empty], b] = _mixed(own[empty, lender] ^ _SALT[b])
    keys = np.broadcast_to(_SEED, (len(lines), BANDS))
    for r in range(ROWS):
        keys = _hashing.join(keys, least[:, r * BANDS : (r + 1) * BANDS].astype(np.uint64))
    return keys.view(np.int64)


def shingle_sets(lines: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each line; lines hold no newline."""
    codes, ends = _numbers(lines)
    codes = codes.astype(np.uint64)
    hashes = _hashing.mix(_windows(codes, SHINGLE))
    out, start = [], 0
    for end in ends:
        if end - start >= SHINGLE:
            own = np.sort(hashes[start : end - SHINGLE + 1])
            new = own[1:] != own[:-1]
            out.append(own if new.all() else own[np.concatenate(([True], new))])
        else:
            out.append(_hashing.mix(_windows(codes[start:end], end - start)[:1] if end > start else np.zeros(1, np.uint64)))
        start = end + 1
    return out


def _marked(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, pos, node, n_lines) of every line with a word, and for every row of docs one without node, with pos -1.

    node is the line's MD5, n_lines the number of such lines in the document. Null ids come last.
    """
    parts = _marked(docs).select("doc_id", "mark", F.split("text", "\n").alias("parts"))
    counted = parts.select("doc_id", "mark", "parts", F.size(F.filter("parts", lambda x: x.rlike(_WORDED))).cast("long").alias("n_lines"))
    each = counted.select("doc_id", "mark", "n_lines", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "parts")).alias("at", "line"))
    worded = each.where(F.col("line").isNull() | F.col("line").rlike(_WORDED))
    return worded.select("doc_id", "mark", (F.col("at") - 1).alias("pos"), F.unhex(F.md5("line")).alias("node"), "n_lines")


def _lines(docs: DataFrame) -> DataFrame:
    """(id, line) of every line with a word; id is 64 bits of hash, by which candidates are found."""
    each = _marked(docs).select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(_WORDED))
    return each.select(F.xxhash64("line").alias("id"), "line")


def _coded(line: Column) -> Column:
    """A line as bytes of which a shingle is cut out without counting from the line's beginning: one a character if it has
    none above U+00FF, else four. step is how many."""
    wide = line.rlike(_WIDE)
    codes = F.when(wide, F.encode(line, "UTF-32")).otherwise(F.encode(line, "ISO-8859-1"))
    return F.struct(codes.alias("codes"), F.when(wide, F.lit(4)).otherwise(F.lit(1)).alias("step"))


def _size(coded: Column) -> Column:
    """How many shingles begin in a line, repeats included."""
    return F.greatest((F.length(coded["codes"]) / coded["step"]).cast("int") - SHINGLE + 1, F.lit(1))


def _starts(coded: Column) -> Column:
    return F.sequence(F.lit(1), (_size(coded) - 1) * coded["step"] + 1, coded["step"])


def _hash(coded: Column, start: Column) -> Column:
    """The hash of a shingle, the same in whichever form its line is."""
    piece = F.substring(coded["codes"], start, 4 * SHINGLE)
    text = F.decode(piece, "UTF-32")
    wide = F.when(text.rlike(_WIDE), F.xxhash64(piece)).otherwise(F.xxhash64(F.encode(text, "ISO-8859-1")))
    return F.when(coded["step"] == 1, F.xxhash64(F.substring(coded["codes"], start, SHINGLE))).otherwise(wide)


def _exploded(lines: DataFrame) -> DataFrame:
    """(id, size, first, h): a row for each shingle of lines (id, line), repeats included, with their number."""
    coded = lines.select("id", _coded(F.col("line")).alias("c")).select("id", "c.codes", "c.step")
    parts = {"codes": F.col("codes"), "step": F.col("step")}
    each = coded.select("id", "codes", "step", _size(parts).alias("size"), F.explode(_starts(parts)).alias("start"))
    return each.select("id", "size", (F.col("start") == 1).alias("first"), _hash(parts, F.col("start")).alias("h"))


def shingle_hashes(line: Column) -> Column:
    """The distinct 64-bit hashes of a line's shingles. The codes are bound by a lambda, so they are made once a line."""
    return F.transform(F.array(_coded(line)), lambda c: F.array_distinct(F.transform(_starts(c), lambda i: _hash(c, i))))[0]


def band_keys(lines: DataFrame) -> DataFrame:
    """(bucket, id): the keys of distinct lines (id, line), partitioned by id: one for each of BANDS parts of a line's
    shingles, of the minima of the part in ROWS orders."""
    turned = lambda n: F.call_function("shiftleft", F.col("h"), F.lit(n)).bitwiseOR(F.shiftrightunsigned("h", 64 - n)) if n else F.col("h")
    minima = [F.min(turned(21 * r)).alias(f"m{r}") for r in range(ROWS)]
    least = _exploded(lines).select("id", "h").groupBy("id", F.col("h").bitwiseAND(BANDS - 1).alias("band")).agg(*minima)
    return least.select(F.xxhash64("band", *[f"m{r}" for r in range(ROWS)]).alias("bucket"), "id")


def members(docs: DataFrame) -> DataFrame:
    """(bucket, id, low) of the lines of docs that share a bucket with another line; low is the bucket's smallest id."""
    parts = buckets(docs)
    # By a number of parts, so that a part's minima fit in memory however short its lines are.
    distinct = _lines(docs).repartition(parts, "id").distinct()
    keys = band_keys(distinct).repartition(parts, "bucket")
    # Of the two columns of keys, so that both sides of the join read one exchange.
    several = keys.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    return keys.join(several.hint("shuffle_hash"), "bucket").select("bucket", "id", "low")


def _words(of, digits: int, h: Column) -> list[Column]:
    """A digit of h as one bit of CLASSES in WORDS longs, aggregated by of."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, digits).bitwiseAND(63).cast("int"))
    word = F.shiftrightunsigned(h, digits + 6).bitwiseAND(WORDS - 1)
    return [of(F.when(word == w, one).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(WORDS)]


def sketches(texts: DataFrame) -> DataFrame:
    """(id, size, w0, ...) of texts (id, line): how many shingles a line has, repeats included, and of one in four of them by
    hash, which of CLASSES classes they fall into."""
    one_in_four = F.col("h").bitwiseAND(3) == 0
    each = _exploded(texts).where(F.col("first") | one_in_four)
    return each.groupBy("id").agg(F.max("size").alias("size"), *_words(F.bit_or, 2, F.when(one_in_four, F.col("h"))))


def parities(texts: DataFrame) -> DataFrame:
    """(id, size, w0, ...) of texts (id, line): the size of each line's shingle set and its parities: of each of CLASSES
    classes of shingles, whether the set has an odd number."""
    sets = texts.select("id", shingle_hashes(F.col("line")).alias("all"))
    # Of a plain explode Spark infers a filter, which would make the sets a second time before the exchange.
    each = sets.select("id", F.size("all").alias("size"), F.explode_outer("all").alias("h"))
    return each.groupBy("id").agg(F.max("size").alias("size"), *_words(F.bit_xor, 0, F.col("h")))


def _differ() -> Column:
    """In how many classes lines x and y differ."""
    return reduce(Column.__add__, [F.bit_count(F.col(f"x.w{w}").bitwiseXOR(F.col(f"y.w{w}"))) for w in range(WORDS)])


def _most(percent: int) -> Column:
    """Of similar lines x and y, how many shingles only one may have."""
    return (100 - percent) * (F.col("x.size") + F.col("y.size")) / (100 + percent)


def _sketched(percent: int) -> Column:
    """Whether lines x and y can reach the similarity by their sketches, which differ in no more classes than there are
    sampled shingles that only one has: five standard deviations above what is expected of these is enough."""
    return _differ() <= _most(percent) / 4 + 5 * F.sqrt(_most(percent) * 3 / 16) + 1


def _may_link(percent: int) -> Column:
    """Whether lines x and y can reach the similarity. Their parities differ in no more classes than there are shingles that
    only one has; where that many would collide, five standard deviations above what is expected of them is enough."""
    x, y, most = F.col("x.size"), F.col("y.size"), _most(percent)
    usual = F.lit(CLASSES / 2) * (1 - F.exp(-2 * most / CLASSES))
    far = (_differ() <= most) & (_differ() <= usual + 5 * F.sqrt(usual * (1 - usual / CLASSES)) + 1)
    return (F.least(x, y) * 100 >= F.greatest(x, y) * percent) & far


def _similar(x: Column, y: Column, percent: int) -> Column:
    """Whether sets of hashes have the similarity."""
    close = F.least(F.size(x), F.size(y)) * 100 >= F.greatest(F.size(x), F.size(y)) * percent
    return close & (F.size(F.array_intersect(x, y)) * (100 + percent) >= (F.size(x) + F.size(y)) * percent)


def _stars(shared: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links of lines b with a, of the smallest members of its buckets the one in most of them.

    Confirmed on the whole lines. All other pairs are left to the blocks, also those of few common buckets.
    """
    met = shared.where("id <> low").groupBy("id", "low").count().where(F.col("count") >= BANDS / 4)
    pairs = met.groupBy("id").agg(F.max_by("low", "count").alias("low"))
    for c, k in (("a", "low"), ("b", "id")):
        pairs = pairs.join(texts.select(F.col("id").alias(k), F.col("node").alias(c), F.col("line").alias(f"{c}_line")), k)
    sets = F.array(F.struct(shingle_hashes(F.col("a_line")).alias("x"), shingle_hashes(F.col("b_line")).alias("y")))
    return pairs.where(F.transform(sets, lambda s: _similar(s["x"], s["y"], percent))[0]).select("a", "b")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (bucket, id, parts) cut into blocks of bounded size, and every two blocks are a key (bucket, p, q), so that a
    large bucket is many keys; second tells one block's members from the other's."""
    block = F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts"))
    each = rows.withColumn("i", block).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return each.withColumns({"p": F.least("i", "j"), "q": F.greatest("i", "j"), "second": F.col("i") > F.col("j")}).drop("i", "j", "parts")


def _parts() -> Column:
    return F.ceil(F.count("*") / _link.BLOCK_ROWS).alias("parts")


def _meet() -> Column:
    """Whether x and y are of two labels and in one key, each in its own block unless that is one."""
    key = reduce(Column.__and__, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("bucket", "p", "q")])
    return key & (F.col("x.label") != F.col("y.label")) & ((F.col("x.p") == F.col("x.q")) | (F.col("x.second") != F.col("y.second")))


def _first() -> Column:
    """Whether the bucket is the first of those that x and y share."""
    return F.array_min(F.array_intersect("x.mine", "y.mine")) == F.col("x.bucket")


def _open(labelled: DataFrame, known: DataFrame, may: Column) -> DataFrame:
    """(bucket, id, label, mine) of labelled (bucket, id, label, ...): members that may be linked with another one of their
    bucket and of another label, and all such buckets of the member. A semi-join, so no pair becomes a row."""
    of = labelled.groupBy("bucket").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), _parts(), F.count("*").alias("n"), F.bit_xor("id").alias("v"), F.bit_xor(F.xxhash64("id")).alias("w")
    )
    # Of buckets with the same members one is enough.
    still = of.where("low <> high").groupBy("v", "w", "n").agg(F.min("bucket").alias("bucket"), F.max("parts").alias("parts"))
    sent = Stored(_dealt(labelled.join(still.select("bucket", "parts"), "bucket")).join(known, "id"), "open")
    found = Stored(sent.df.alias("x").hint("merge").join(sent.df.alias("y"), _meet() & may, "left_semi").select("bucket", "id", "label").distinct(), "near")
    sent.drop()
    return found.df.join(found.df.groupBy("id").agg(F.collect_list("bucket").alias("mine")), "id")


def _blocks(open_: DataFrame, texts: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(a, b): all links across labels among the members of the buckets of open_ (bucket, id, label, mine), each in the
    first bucket that both are in.

    The similarity of the whole sets is part of the join's condition, so what is no link becomes no row. Members travel
    as lines; the sets, which are larger, are made where they meet.
    """
    sent = Stored(_dealt(open_.join(open_.groupBy("bucket").agg(_parts()), "bucket")).join(texts, "id").join(known, "id"), "sent")
    full = sent.df.repartition("bucket", "p", "q").withColumn("set", shingle_hashes(F.col("line"))).drop("line")
    once = (F.col("x.p") < F.col("x.q")) & ~F.col("x.second") | (F.col("x.p") == F.col("x.q")) & (F.col("x.node") < F.col("y.node"))
    met = full.alias("x").hint("merge").join(full.alias("y"), _meet() & once & _may_link(percent) & _first() & _similar(F.col("x.set"), F.col("y.set"), percent))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def groups(docs: DataFrame, seen: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, label): for each line of seen, the occurrences of docs, that repeats or is similar to others, the smallest node
    of its component."""
    shared = Stored(members(docs), "members")
    wanted = shared.df.select("id").distinct()
    blocks = blocks_for(wanted.count())
    some = probed(_lines(docs), "id", bloom(wanted, "id", blocks), blocks).where("__maybe").select("id", F.unhex(F.md5("line")).alias("node"), "line")
    texts = Stored(some.join(wanted, "id", "left_semi").distinct(), "texts")
    edges = Stored(_stars(shared.df, texts.df, percent), "links")
    labels = components(edges.df, contract=False)
    of = texts.df.select("id", "node").join(labels.df, "node").groupBy("id").agg(F.min(F.xxhash64("label")).alias("label"))
    labelled = shared.df.select("bucket", "id").join(of, "id", "left").withColumn("label", F.coalesce("label", "id"))
    # Sketches are made by less work than parities and rule out most lines.
    sketched = Stored(sketches(texts.df.select("id", "line").repartition(buckets(docs), "id")), "facts")
    near = Stored(_open(labelled, sketched.df, _sketched(percent)), "mine")
    some = texts.df.join(near.df.select("id").distinct(), "id", "left_semi")
    known = Stored(parities(some.select("id", "line").repartition(buckets(docs), "id")), "facts")
    # With the buckets of before: a pair meets in the first of them that both share, and in the end only there.
    open_ = Stored(_open(near.df, known.df, _may_link(percent) & _first()), "mine")
    more = Stored(_blocks(open_.df, texts.df, known.df, percent), "links")
    if not more.df.isEmpty():
        labels.drop()
        labels = components(edges.df.unionByName(more.df), contract=False)
    for x in (shared, texts, edges, sketched, near, known, open_, more):
        x.drop()
    repeated = seen.where("node is not null").groupBy("node").count().where("count > 1").select("node")
    return repeated.join(labels.df, "node", "full").select("node", F.coalesce("label", "node").alias("label"))


def decisions(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, mark, n_lines, removed) for each row of docs (doc_id, text): positions of the lines that go, from 0.

    Lines are what stands between newlines; lines without a word always stay and don't count in n_lines. Of each
    component the occurrence with the smallest (doc_id, text hash, position) stays. Null texts have no lines; null ids
    come last; rows equal in id and text are one document and treated alike. No rows give no rows. Other columns are
    ignored.
    """
    seen = Stored(occurrences(docs), "lines").df
    each = seen.where("node is not null").select("node", "doc_id", "mark", "pos")
    grouped = Stored(each.join(groups(docs, seen, percent), "node").select("label", "doc_id", "mark", "pos"), "grouped").df
    kept = grouped.groupBy("label").agg(F.min(F.struct("doc_id", "mark", "pos")).alias("kept"))
    gone = grouped.join(kept, "label").where(F.struct("doc_id", "mark", "pos") != F.col("kept")).select("doc_id", "mark", "pos").distinct()
    by_doc = gone.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list("pos")).alias("removed"))
    rows = seen.where("node is null").select("doc_id", "mark", "n_lines")
    out = rows.join(by_doc, ["doc_id", "mark"], "left")
    return out.select(F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "mark", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs with the text that is left of them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = decisions(docs, percent).where(F.size("removed") > 0).groupBy("doc_id", "mark").agg(F.first("removed").alias("__removed"))
    found = found.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "__removed")
    marked = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__mark")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__removed", i)), "\n")
    return marked.withColumn("text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(left)).select(*docs.columns)
