"""How the words of sources diverge from each other and from their language, in whole numbers.

Terms are counted by language and source, over Arrow batches: a task packs its counts by the hash of language and term, and
what reads a hash adds the packs up, so a term's counts of all sources meet in one row; a language keeps those in at least MIN_DOCUMENTS of its documents (rows). With V
kept terms and N occurrences of them, a group or language gives a term p = 1 + floor(10^9 (count + 1) / (N + V)), and p
against q contributes floor((p - q)^2 / q).

Pairs of sources sum this over all kept terms, but no table of groups times terms is made: where neither source has a term,
its contribution is the same baseline. So V baselines are corrected by the terms of either source alone, which only count by
how often each count occurs, and by the terms that both have, a row for each two sources of a term. Both corrections are
sums that map sides combine.

The highest terms of each group are found by radix selection: histograms over the bits of the value (first how many there
are, then 12 at a time) narrow each group to the bin that holds its TOP-th term, then, among equal values, histograms over
UTF-8 bytes of the term, from the first in which any of them differ. A group is ranked as soon as SETTLED terms or
fewer are left beyond those that are surely among the highest. No group's terms are sorted as a whole.

Null texts, languages and sources are ''. Rows that repeat count each time. A language that keeps no term has pairs of value
0 and no terms; a source that is alone has no pairs. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Stored
from ._deal import buckets, even_keys

MIN_DOCUMENTS, TOP, SCALE = 3, 200, 1_000_000_000
#: Terms that a group may have left beyond its highest when they are ranked; bits of a bin; bytes of texts that a task counts
#: at once, and the most documents of them; rows of packs that are added up at once.
SETTLED, BITS, HELD, DOCUMENTS, ADDED = 1000, 12, 12 << 20, 1 << 14, 1 << 18
#: Every byte but letters and those above ASCII is a blank; A-Z are lower-cased.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
GROUP = ["lang", "source"]
_PACK = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("documents", pa.int64())])


def kept_terms(docs: DataFrame) -> DataFrame:
    """(lang, term, total, sources) of the terms that a language keeps: how often it has them, and for each source that does
    (source, count), in the order of sources."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    keys = even_keys(docs.sparkSession, buckets(texts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size = 0, 0
            for i, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
                if i > start and (size + n > HELD or i - start == DOCUMENTS):
                    yield _packs(batch.slice(start, i - start), keys)
                    start, size = i, 0
                size += n
            if batch.num_rows:
                yield _packs(batch.slice(start), keys)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, rows = _PACK.empty_table(), [], 0
        for batch in batches:
            for data in batch.column("data"):
                held.append(pa.ipc.read_record_batch(data.as_buffer(), _PACK))
                rows += held[-1].num_rows
                if rows >= max(ADDED, sums.num_rows):
                    sums, held, rows = _sums([*sums.to_batches(), *held]), [], 0
        yield from _rows(_sums([*sums.to_batches(), *held]))

    packs = texts.mapInArrow(count, "part long, data binary").repartition(len(keys), "part")
    return packs.mapInArrow(add, "lang string, term string, total long, sources array<struct<source: string, count: long>>")


def _packs(batch: pa.RecordBatch, keys: list[int]) -> pa.RecordBatch:
    """(part, data): how often groups have terms, and in how many rows, of all rows of a batch (lang, source, text); a pack for
    each part of the hashes of language and term."""
    letters = pa.array([t.as_buffer().to_pybytes().translate(_LETTERS) for t in batch.column("text")], pa.binary())
    words = pc.ascii_split_whitespace(letters.cast(pa.string()))
    encoded = words.flatten().dictionary_encode()
    terms, codes = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(words).to_numpy())
    langs, sources = (batch.column(c).dictionary_encode() for c in GROUP)
    pairs, group = np.unique(langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(), return_inverse=True)
    # Group, term and row in one number: at most 14, 31 and 15 bits.
    row_bits, term_bits = batch.num_rows.bit_length(), len(terms).bit_length()
    every = (group[row] << term_bits | codes) << row_bits | row
    blank = pc.index(terms, "").as_py()
    every = np.sort(every if blank < 0 else every[codes != blank])
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    which = every >> row_bits
    starts = np.flatnonzero(np.concatenate((new[:1], which[1:] != which[:-1])))
    which = which[starts]
    counts = np.diff(np.append(starts, len(every)))
    documents = np.add.reduceat(new.astype(np.int64), starts) if len(starts) else counts
    group, code = which >> term_bits, which & ((1 << term_bits) - 1)
    lang, source = np.divmod(pairs[group], len(sources.dictionary))
    hashes = lambda values: np.array([zlib.crc32(v.as_buffer()) for v in values], np.uint64)
    part = ((hashes(terms)[code] << np.uint64(32) | hashes(langs.dictionary)[lang]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(len(keys))
    order = np.argsort(part, kind="stable")
    columns = [langs.dictionary.take(pa.array(lang[order])), sources.dictionary.take(pa.array(source[order])), terms.take(pa.array(code[order])), pa.array(counts[order]), pa.array(documents[order])]
    dealt = pa.RecordBatch.from_arrays(columns, schema=_PACK)
    ends = np.searchsorted(part[order], np.arange(len(keys) + 1, dtype=np.uint64)).tolist()
    found = [(keys[i], dealt.slice(a, b - a).serialize().to_pybytes()) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if a < b]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["part", "data"])


def _sums(packs: list[pa.RecordBatch]) -> pa.Table:
    sums = pa.Table.from_batches(packs, _PACK).group_by([*GROUP, "term"], use_threads=False).aggregate([("count", "sum"), ("documents", "sum")])
    return sums.select([*GROUP, "term", "count_sum", "documents_sum"]).rename_columns(_PACK.names)


def _rows(sums: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of kept_terms() of a part."""
    sums = sums.take(pc.sort_indices(sums.column("source")))
    terms = sums.group_by(["lang", "term"], use_threads=False).aggregate([("count", "sum"), ("documents", "sum"), ("source", "list"), ("count", "list")])
    terms = terms.filter(pc.greater_equal(terms.column("documents_sum"), MIN_DOCUMENTS))
    for batch in terms.to_batches(1 << 14):
        lists = batch.column("source_list")
        ends = pa.array(np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy())), pa.int32())
        each = pa.StructArray.from_arrays([lists.flatten(), batch.column("count_list").flatten()], ["source", "count"])
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("term"), batch.column("count_sum"), pa.ListArray.from_arrays(ends, each)], ["lang", "term", "total", "sources"])


def share(count: str, n: str, v: str) -> str:
    """SQL of 1 + floor(10^9 (count + 1) / (n + v)), exact for any counts."""
    return f"(1 + {SCALE}BD * (cast({count} as decimal(20,0)) + 1) div (cast({n} as decimal(20,0)) + {v}))"


def contribution(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / q); shares stay below 2^30, so squares fit."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): for every source of a language its other sources (part pair) and its
    highest TOP terms (part term), by value from high to low, then by item."""
    terms = Stored(kept_terms(docs), "terms").df
    entries = terms.select("lang", "term", "total", F.explode("sources").alias("of")).select("lang", "of.source", "term", "of.count", "total")
    # How often a group has each count; of a language, terms once each.
    often = Stored(entries.groupBy(*GROUP, "count").agg(F.count("*").alias("terms")), "often").df
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP]).distinct()
    sizes = often.groupBy(*GROUP).agg(F.sum(F.col("count") * F.col("terms")).alias("n"))
    groups = every.join(langs, "lang", "left").join(sizes, GROUP, "left").fillna(0, ["v", "lang_n", "n"])
    base = F.when(F.col("v") > 0, F.expr(share("0", "n", "v"))).otherwise(1)
    groups = Stored(groups.withColumn("base", base), "groups").df
    pair = _pairs(terms, often, groups)
    by_value = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))
    shares = entries.join(groups, GROUP).select(*GROUP, "term", F.expr(share("count", "n", "v")).alias("p"), F.expr(share("total", "lang_n", "v")).alias("q"))
    values = Stored(shares.where("p > q").select(*GROUP, "term", F.expr(contribution("p", "q")).alias("value")), "values")
    top = highest(values.df).withColumnRenamed("term", "item").withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(columns).unionByName(top.select(columns))


def _pairs(terms: DataFrame, often: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of sources of a language."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("n").alias("item_n"), F.col("base").alias("item_base"))
    pairs = groups.join(other, "lang").where("source <> item").withColumn("both_base", F.expr(contribution("base", "item_base")))
    pairs = Stored(pairs.select("lang", "source", "item", "v", "n", "item_n", "base", "item_base", "both_base"), "pairs").df
    exact = lambda e: F.sum(F.expr(f"cast({e} as decimal(38,0))"))
    keys = ["lang", "source", "item"]
    # Terms of one of the two: their counts alone matter, so equal ones are one row.
    p, q = share("count", "n", "v"), share("count", "item_n", "v")
    mine = pairs.join(often, GROUP).select(*keys, F.expr(f"cast(terms as decimal(18,0)) * ({contribution(p, 'item_base')} - both_base)").alias("more"))
    theirs = pairs.join(often.withColumnRenamed("source", "item"), ["lang", "item"])
    theirs = theirs.select(*keys, F.expr(f"cast(terms as decimal(18,0)) * ({contribution('base', q)} - both_base)").alias("more"))
    # Terms of both: what the two corrections counted twice.
    # Each two sources of a term once, then in both orders.
    first = terms.select("lang", "sources", F.posexplode("sources").alias("at", "a"))
    two = first.select("lang", "a", F.explode(F.expr("slice(sources, at + 2, size(sources))")).alias("b"))
    two = two.groupBy("lang", F.col("a.source").alias("x"), F.col("b.source").alias("y"), F.col("a.count").alias("m"), F.col("b.count").alias("n")).agg(F.count("*").alias("terms"))
    orders = F.expr("inline(array(struct(x AS source, y AS item, m AS count, n AS other), struct(y AS source, x AS item, n AS count, m AS other)))")
    both = two.select("lang", "terms", orders).join(pairs, keys)
    q = share("other", "item_n", "v")
    twice = f"{contribution(p, q)} - {contribution(p, 'item_base')} - {contribution('base', q)} + both_base"
    both = both.select(*keys, F.expr(f"cast(terms as decimal(18,0)) * ({twice})").alias("more"))
    more = mine.unionByName(theirs).unionByName(both).groupBy(*keys).agg(exact("more").alias("more"))
    value = F.expr("cast(cast(v as decimal(18,0)) * both_base + coalesce(more, 0) as bigint)")
    return pairs.join(more, keys, "left").select(*keys, F.when(F.col("v") > 0, value).otherwise(F.lit(0).cast("long")).alias("value"))


def highest(values: DataFrame, top: int = TOP, settled: int = SETTLED) -> DataFrame:
    """(lang, source, term, value, rank) of the top rows of each group of (lang, source, term, value), values at least 0, by
    value from high to low, then by the term's bytes; terms of a group are distinct.

    A group's state is the range of values that holds its last row, the rows above that, and those in it.
    """
    open_ = F.col("above") + F.col("n") > top + settled
    counted = [F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")]
    state = Stored(values.groupBy(*GROUP).agg(F.lit(0).cast("long").alias("above"), *counted), "state").df
    done, bins = [state.where(~open_)], F.length(F.bin("value")).cast("long")
    live = state.where(open_)
    while not live.where("low < high").isEmpty():
        done.append(live.where("low = high"))
        now = live.where("low < high").select(*GROUP, "above", F.col("low").alias("from"), F.col("high").alias("to"))
        met = values.join(now, GROUP).where("value between from and to").withColumn("bin", bins)
        state = Stored(_chosen(met.groupBy(*GROUP, "bin").agg(F.max("above").alias("above"), *counted), F.desc("bin"), top), "state").df
        done.append(state.where(~open_))
        live = state.where(open_)
        bins = F.expr(f"shiftright(value - from, greatest(0, length(bin(to - from)) - {BITS}))")
    done.append(live)
    cuts = done[0].select(*GROUP, "above", "n", "low")
    for d in done[1:]:
        cuts = cuts.unionByName(d.select(*GROUP, "above", "n", "low"))
    cuts = Stored(cuts, "cuts").df
    last = _ties(values, cuts.where(open_), top, settled)
    ends = cuts.join(last, GROUP, "left").select(*GROUP, "low", "last")
    reach = values.join(ends, GROUP).where("value > low or value = low and (last is null or term <= last)")
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "term"))
    return reach.select(*GROUP, "term", "value").withColumn("rank", rank).where(F.col("rank") <= top)


def _ties(values: DataFrame, groups: DataFrame, top: int, settled: int) -> DataFrame:
    """(lang, source, last): where too many terms have the value low, a term that is not before the last wanted one."""
    counted = [F.count("*").alias("n"), F.min("term").alias("first"), F.max("term").alias("last")]
    same = Stored(values.join(groups.select(*GROUP, "above", "low"), GROUP).where("value = low").select(*GROUP, "term", "above"), "ties").df
    state = Stored(same.groupBy(*GROUP).agg(F.max("above").alias("above"), *counted), "state").df
    out = state.limit(0).select(*GROUP, "last")
    open_ = F.col("above") + F.col("n") > top + settled
    while not state.where(open_).isEmpty():
        out = out.unionByName(state.where(~open_).select(*GROUP, "last"))
        # Bytes in front of the first that differs among the terms left are skipped.
        a, b = "cast(from as binary)", "cast(to as binary)"
        differs = f"filter(sequence(1, least(octet_length(from), octet_length(to))), i -> substring({a}, i, 1) <> substring({b}, i, 1))"
        now = state.where(open_).select(*GROUP, F.col("above"), F.col("first").alias("from"), F.col("last").alias("to"))
        now = now.withColumn("at", F.expr(f"coalesce(get({differs}, 0), least(octet_length(from), octet_length(to)) + 1)"))
        met = same.drop("above").join(now, GROUP).where("term between from and to").withColumn("bin", F.expr("substring(cast(term as binary), at, 2)"))
        state = Stored(_chosen(met.groupBy(*GROUP, "bin").agg(F.max("above").alias("above"), *counted), F.asc("bin"), top), "state").df
    return out.unionByName(state.select(*GROUP, "last"))


def _chosen(bins: DataFrame, order: Column, top: int) -> DataFrame:
    """Of each group the bin that holds the top-th row, with the rows before it; a group has at most 2^16 bins."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*GROUP).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bins.withColumn("above", F.col("above") + before).where((F.col("above") < top) & (F.col("above") + F.col("n") >= top)).drop("bin")
