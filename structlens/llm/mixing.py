"""Mixing sources to target weights by weighted sampling without replacement, within whole epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, Stored

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Characters per word, its blank included, that prose usually has; the least weight of a document.
USUAL_CHARS, LEAST_WEIGHT = 6, 0.05
#: Documents that one slice of a source's keys holds on average, and the most slices of a source.
SLICE_ROWS, MOST_SLICES = 500, 1 << 20
#: Rates of the exponential distributions whose mean cuts the slices: for weights between them, no slice is much fuller.
RATES = (4.0, 1.0, 0.25, 0.0625)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A double in (0, 1), the same for the same parts: 13 hexadecimal digits of their MD5."""
    digits = F.substring(F.md5(F.concat_ws("\x1f", *[p.cast("string") for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def quality_weight(text: Column, size: Column) -> Column:
    """A graded guess at quality, from 1 down to LEAST_WEIGHT: falls with the share of characters that are neither letters
    nor blanks, and with the distance of the characters per word from USUAL_CHARS on a logarithmic scale."""
    chars = F.length(text)
    odd = F.coalesce(F.try_divide(F.length(F.regexp_replace(text, r"[\p{L}\s]+", "")), chars), F.lit(1.0))
    away = F.coalesce(F.log(F.try_divide(chars, size) / USUAL_CHARS), F.lit(9.0))
    return F.greatest(F.lit(LEAST_WEIGHT), (1 - odd) * (1 - odd) / (1 + 4 * away * away))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) of (source, source_size): the weights' shares of all words, none above `most` times
    its source.

    The sources are few (one row each), so one ordered window over them is enough: with sources ordered by cap over
    weight, the capped ones are a prefix, and what they leave is dealt to the rest by weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn(
        "w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * most)
    by_room = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, after, every = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing), by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = ranked.withColumn("level", left / F.sum("w").over(after))
    # The level of the first source that is not capped holds for all after it.
    free = F.min(F.when(F.col("cap") >= F.col("w") * F.col("level"), F.struct(F.col("cap") / F.col("w"), "level"))).over(every)
    level = level.withColumn("free", free["level"])
    target = F.when(F.col("free").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("w") * F.col("free"))
    )
    return level.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: int = 0,
    quality: Column | None = None,
    slice_rows: int = SLICE_ROWS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken) for each row of docs (doc_id, text, source), and the
    columns in keep.

    Size is the number of words. A source with target t and size s takes every document floor(t / s) times in whole
    epochs; the rest of the target goes to its documents in the order of the keys -ln(u) / quality, smallest first,
    until their running size reaches it; the document that crosses it counts in part (its first words). u comes from
    an MD5 of doc_id and seed, so reruns agree. The keys' order is cut into slices by their distribution, the slices'
    sizes are summed ahead of the prefix sums, and only a slice is ever sorted in one task, so no source is too large.

    Null texts have size 0 and take nothing; null sources form one source, named last; rows with a null doc_id share
    a key, and their order is settled by size. Repeated rows count as documents of their own. No rows give no rows.
    """
    weight = quality if quality is not None else quality_weight(F.col("text"), F.col("size"))
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text", *keep).withColumn("size", n_words(F.col("text")))
    narrow = narrow.withColumn("w", weight).withColumn(
        "key", -F.log(uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))) / F.col("w")
    )
    held = Stored(narrow.select("doc_id", "source", "size", "key", *keep), "mix").df
    per_source = held.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    slices = F.least(F.ceil(F.col("n") / slice_rows), F.lit(MOST_SLICES)).cast("long")
    known = targets(per_source.select("source", "source_size"), weights, most)
    # One number of slices for all sources, from the largest: the slice of a row needs no join then.
    largest = per_source.agg(F.max(slices)).first()[0] or 1
    spread = sum((1 - F.exp(-F.col("key") * r) for r in RATES), F.lit(0.0)) / len(RATES)
    at = F.least(F.floor(spread * largest), F.lit(largest - 1)).cast("long")
    cut = held.withColumn("slice", at)
    sums = cut.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
    left, right = sums.alias("a"), known.alias("b")
    plan = left.join(right, F.expr("a.source <=> b.source")).select("a.source", "slice", "ahead", "source_size", "target")
    a, b = cut.alias("a"), plan.alias("b")
    joined = a.join(b, F.expr("a.source <=> b.source and a.slice = b.slice")).select(
        "a.doc_id", "a.source", "a.size", "a.key", "a.slice", "ahead", "source_size", "target", *[f"a.{k}" for k in keep]
    )
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.try_divide("target", "source_size"))).otherwise(F.lit(0))
    out = joined.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.withColumn("epochs", F.least(epochs, F.lit(most)).cast("long"))
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("ahead")))
    taken = F.when(F.col("epochs") >= most, F.col("epochs") * F.col("size")).otherwise(F.col("epochs") * F.col("size") + part)
    return out.withColumn("taken", taken.cast("long")).select("doc_id", "source", "size", "source_size", "target", "epochs", "taken", *keep)


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as mix() takes them, to the nearest whole time; those it doesn't take are left out.

    Rows that are equal in doc_id, text and source share what mix() takes of them as evenly as whole times allow. Columns
    of docs come back as they are, whatever their names. No rows give no rows.
    """
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("")))
    marked = docs.select("doc_id", "text", "source", mark.alias("__mark"))
    times = F.when(F.col("size") > 0, F.try_divide("taken", "size")).otherwise(0.0)
    drawn = mix(marked, keep=("__mark",), **how).select("doc_id", "__mark", times.alias("times"))
    drawn = drawn.groupBy(F.col("doc_id").alias("__id"), F.col("__mark").alias("__m")).agg(F.round(F.sum("times")).cast("long").alias("__times"), F.count("*").alias("__rows")).where("__times > 0")
    drawn = Stored(drawn, "drawn").df
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select("doc_id", mark.alias("__mark"), row)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__m"))
    # The same plan at every size: what is drawn grows with the documents.
    joined = rows.join(drawn.hint("merge"), same)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__copy")
    single = joined.where("__rows = 1").select("__row", F.col("__times").alias("__n")).select("__row", copies).select("__row.*")
    if drawn.where("__rows > 1").isEmpty():
        return single
    # Only rows that repeat are numbered.
    nth = F.row_number().over(Window.partitionBy("__id", "__m").orderBy(F.lit(0)))
    several = joined.where("__rows > 1").select("__row", "__times", "__rows", nth.alias("__nth"))
    several = several.select("__row", (F.expr("__times div __rows") + (F.col("__nth") <= F.col("__times") % F.col("__rows")).cast("long")).alias("__n")).where("__n > 0")
    return single.unionByName(several.select("__row", copies).select("__row.*"))
