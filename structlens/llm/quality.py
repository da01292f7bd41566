"""Quality rules: text statistics, fixed base rules, and robust multivariate outliers per language and source.

Statistics become a transformed vector. Each group's centre and covariance are minimum-covariance-determinant estimates:
from several deterministic starts, concentration steps re-estimate them on the nearest three quarters until the
determinants settle, and the start that ends at the least determinant counts. Estimates of a group are drawn towards
those of its language, and these towards those of all documents, by as much as PRIOR documents weigh; so small groups
need no rule of their own. Documents beyond a Mahalanobis distance are rejected. All of it is DataFrame expressions.
Vectors are whole numbers (units of 1/SCALE) and their sums exact, so estimates don't depend on how rows are dealt to
tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import BLANKS, Stored, native_words, small

SCALE = 1000
#: Of the vector: least standard deviations. A statistic that hardly varies in a group rejects nothing by itself.
FLOORS = (1.3, 0.1, 0.7, 0.8, 0.08)
DIMS = len(FLOORS)
#: 0.9999 quantile of chi-squared with 5 degrees of freedom: squared distance beyond which a document goes.
CUTOFF = 25.74
#: Share of a group that a concentration step keeps, and what corrects the covariance of so trimmed normal data.
CORE, CONSISTENCY = 0.75, 1.41
#: Starts: medians and quartile ranges; the same with half of the group in the first step; means and covariances.
STARTS = ("quartiles", "half", "moments")
#: A start of a group is settled when a step, from the third on, doesn't lower the logarithm of its determinant by more.
#: The floors bound determinants from below, so steps end; no other group's steps matter.
SETTLED, FREE_STEPS = 1e-2, 2
#: Documents that a parent's estimate weighs in its groups' estimates.
PRIOR = 50
#: Characters a word about which short texts are damped: their averages vary more.
USUAL_CHARS = 5
#: More groups than this are joined by a salted shuffle, not broadcast.
MOST_BROADCAST, SALTS = 20_000, 32
MIN_WORDS, MAX_REPEAT_PERCENT, SPAN = 10, 20, 5


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, span: int = SPAN) -> Column:
    """Words inside windows of `span` words that the text has twice or more, by 64-bit hashes of the windows."""

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.lit(span), F.coalesce(b - a, F.lit(span))))
        return F.aggregate(gaps, F.lit(0), lambda n, x: n + x)

    def twice(ordered: Column) -> Column:
        same = F.zip_with(
            ordered,
            F.slice(ordered, 2, F.size(ordered)),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
        )
        return _let(F.sort_array(F.array_distinct(F.flatten(same))), covered)

    def count(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(F.sort_array(pairs), twice)).otherwise(0)

    def windows(each: Column) -> Column:
        """Hashes of the windows from those of the words: words are hashed once, and no window is built."""
        n = F.size(each) - span + 1
        joined = F.slice(each, 1, n)
        for k in range(1, span):
            joined = F.zip_with(joined, F.slice(each, k + 1, n), lambda a, b: F.xxhash64(a, b))
        return _let(joined, count)

    return F.when(F.size(words) > span, _let(F.transform(words, lambda w: F.xxhash64(w)), windows)).otherwise(0).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to docs (with text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.withColumn("__words", native_words(text))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return split.select(
        *docs.columns,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def vector() -> list[Column]:
    """Log words; log characters a word, damped for short texts; log symbol percentage; log repeated lines; repeated share."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    raw = [
        F.log(n),
        F.log(chars / n / USUAL_CHARS) * F.sqrt(n / (n + 30)),
        F.log1p(F.col("n_symbols") * 100 / chars),
        F.log1p(F.col("n_dup_lines")),
        F.col("n_repeat_words") / n,
    ]
    return [F.round(x * SCALE).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def _with(rows: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of their group's parameters: broadcast if they are few, else by a salted shuffle."""
    if small(params, MOST_BROADCAST):
        return rows.join(F.broadcast(params), "group", how)
    salted = params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    return dealt.join(salted, ["group", "salt"], how).drop("salt")


_MEANS = [f"m{i}" for i in range(DIMS)]
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
_COVS = [f"c{i}{j}" for i, j in _PAIRS]


def _inverse(params: DataFrame, *keep: str) -> DataFrame:
    """(keep, m0.., i00, i10.., det) from m0.. and covariances c00, c10..: the inverse of their Cholesky factor, and the
    logarithm of their determinant."""
    for i in range(DIMS):
        row = {}
        for j in range(i + 1):
            dot = reduce(Column.__add__, [(row.get(k) if k in row else F.col(f"l{i}{k}")) * F.col(f"l{j}{k}") if i != j else row[k] * row[k] for k in range(j)], F.lit(0.0))
            row[j] = F.sqrt(F.col(f"c{i}{i}") - dot) if i == j else (F.col(f"c{i}{j}") - dot) / F.col(f"l{j}{j}")
            params = params.withColumn(f"l{i}{j}", row[j])
            row[j] = F.col(f"l{i}{j}")
    for j in range(DIMS):
        params = params.withColumn(f"i{j}{j}", 1 / F.col(f"l{j}{j}"))
        for i in range(j + 1, DIMS):
            dot = reduce(Column.__add__, [F.col(f"l{i}{k}") * F.col(f"i{k}{j}") for k in range(j, i)])
            params = params.withColumn(f"i{i}{j}", -dot / F.col(f"l{i}{i}"))
    det = reduce(Column.__add__, [2 * F.log(f"l{i}{i}") for i in range(DIMS)])
    return params.select(*keep, *_MEANS, *[f"i{i}{j}" for i, j in _PAIRS], det.alias("det"))


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. under the parameters of _inverse."""
    away = [F.col(f"x{i}") / SCALE - F.col(f"m{i}") for i in range(DIMS)]
    z = [reduce(Column.__add__, [F.col(f"i{i}{j}") * away[j] for j in range(i + 1)]) for i in range(DIMS)]
    return reduce(Column.__add__, [x * x for x in z])


def _sums() -> list[Column]:
    """Numbers, sums and sums of products of x0.., exact."""
    return [
        F.count("*").alias("n"),
        *[F.sum(F.col(f"x{i}").cast("decimal(20,0)")).alias(f"s{i}") for i in range(DIMS)],
        *[F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(20,0)")).alias(f"p{i}{j}") for i, j in _PAIRS],
    ]


_TOTALS = ["n", *[f"s{i}" for i in range(DIMS)], *[f"p{i}{j}" for i, j in _PAIRS]]


def _moments(sums: DataFrame, factor: float, *keep: str) -> DataFrame:
    """(keep, n, m0.., c00..) of _sums(): covariances times factor, with the floors added."""
    mean = [F.col(f"s{i}").cast("double") / F.col("n") / SCALE for i in range(DIMS)]
    cov = lambda i, j: (F.col(f"p{i}{j}").cast("double") / F.col("n") / SCALE**2 - mean[i] * mean[j]) * factor
    return sums.select(*keep, "n", *[m.alias(f"m{i}") for i, m in enumerate(mean)], *[(cov(i, j) + (FLOORS[i] ** 2 if i == j else 0)).alias(f"c{i}{j}") for i, j in _PAIRS])


def _starts(rows: DataFrame) -> DataFrame:
    """(group, start, m0.., c00..) of rows (levels, x0..): one row for each of STARTS."""
    own = rows.groupBy("levels").agg(*_sums())
    every = own.withColumn("group", F.explode("levels")).groupBy("group").agg(*[F.sum(c).alias(c) for c in _TOTALS])
    moments = _moments(every, 1.0, "group").select("group", F.lit(2).alias("start"), *_MEANS, *_COVS)
    long = rows.select("levels", F.posexplode(F.array(*[f"x{i}" for i in range(DIMS)])).alias("dim", "x"))
    counts = long.groupBy("levels", "dim", F.floor(F.col("x") / 10).alias("bin")).count()
    counts = counts.withColumn("group", F.explode("levels")).groupBy("group", "dim", "bin").agg(F.sum("count").alias("count"))
    upto, whole = Window.partitionBy("group", "dim").orderBy("bin"), Window.partitionBy("group", "dim")
    ranked = counts.withColumns({"below": F.sum("count").over(upto), "all": F.sum("count").over(whole)})
    at = lambda q: F.min(F.when(F.col("below") >= F.col("all") * q, F.col("bin"))) * (10 / SCALE)
    quartiles = ranked.groupBy("group").pivot("dim", list(range(DIMS))).agg(at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("spread"))
    cov = lambda i, j: F.pow(f"{i}_spread", F.lit(2)) + FLOORS[i] ** 2 if i == j else F.lit(0.0)
    robust = quartiles.select("group", F.explode(F.array(F.lit(0), F.lit(1))).alias("start"), *[F.col(f"{i}_mid").alias(f"m{i}") for i in range(DIMS)], *[cov(i, j).alias(f"c{i}{j}") for i, j in _PAIRS])
    return robust.unionByName(moments)


def estimates(rows: DataFrame) -> DataFrame:
    """(group, n, m0.., c00..): the robust centre and covariance of each group of rows (levels, x0..), where levels are the
    keys of the groups that a row belongs to."""
    flat = rows.select(F.explode("levels").alias("group"), *[f"x{i}" for i in range(DIMS)])
    now = Stored(_inverse(_starts(rows), "group", "start"), "mcd").df
    order, group = Window.partitionBy("group", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("group", "start")
    names, done, step = ["group", "start", "all", *_MEANS, *_COVS, "det"], [], 0
    while not now.isEmpty():
        near = _with(flat, now).select("group", "start", *[f"x{i}" for i in range(DIMS)], F.floor(F.log1p(_distance()) * 64).alias("bin"))
        per_bin = near.groupBy("group", "start", "bin").agg(*_sums())
        share = F.when((F.col("start") == 1) & F.lit(step == 0), 0.5).otherwise(CORE)
        core = per_bin.withColumns({"before": F.coalesce(F.sum("n").over(order), F.lit(0)), "all": F.sum("n").over(group)}).where(F.col("before") < F.col("all") * share)
        sums = core.groupBy("group", "start").agg(*[F.sum(c).alias(c) for c in _TOTALS], F.max("all").alias("all"))
        after = _inverse(_moments(sums, CONSISTENCY, "group", "start", "all"), "group", "start", "all", *_COVS)
        after = Stored(after.join(now.select("group", "start", F.col("det").alias("was")), ["group", "start"]), "mcd").df
        going = F.col("det") < F.col("was") - SETTLED if step >= FREE_STEPS else F.lit(True)
        ended = after.where(~going)
        done.append(ended.where("det <= was").select(names))
        if step >= FREE_STEPS:
            done.append(now.join(ended.where("det > was").select("group", "start"), ["group", "start"], "left_semi").select(names))
        now, step = after.where(going), step + 1
    now = Stored(reduce(DataFrame.unionByName, done), "mcd").df if done else now.withColumns({c: F.lit(None).cast("double") for c in ("all", *_COVS)})
    best = now.groupBy("group").agg(F.min_by("start", F.struct("det", "start")).alias("start"))
    return now.join(best, ["group", "start"]).select("group", F.col("all").alias("n"), *_MEANS, *_COVS)


def _shrunk(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Estimates of child (parent, ...) drawn towards those of their parents."""
    names = [*_MEANS, *_COVS]
    known = parent.select(F.col("group").alias("parent"), *[F.col(c).alias(f"p_{c}") for c in names])
    mixed = [((F.col("n") * F.col(c) + PRIOR * F.col(f"p_{c}")) / (F.col("n") + PRIOR)).alias(c) for c in names]
    return child.join(known, "parent").select("group", *mixed)


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, with_rows: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept) for each row of docs
    (doc_id, text, lang, source), and given with_rows the row itself in one column, row.

    base_failed documents are not kept and not part of the estimates; of the others those within CUTOFF of their
    group are. Null texts have no words and fail the base rules; null languages and sources are groups like others.
    Repeated rows each count and are each judged; no rows give no rows. Other columns are ignored, whatever their names.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_rows else []
    stats = statistics(docs.select("doc_id", "lang", "source", "text", *row))
    keep = ["doc_id", *(["row"] if with_rows else [])]
    own = F.xxhash64(F.lit(2), "lang", F.col("lang").isNull(), "source", F.col("source").isNull())
    above = F.xxhash64(F.lit(1), "lang", F.col("lang").isNull())
    keys = F.array(own, above, F.lit(0).cast("long")).alias("levels")
    held = Stored(stats.select(*keep, *_NAMES, base_failed().alias("base_failed"), keys), "quality").df
    keyed = held.withColumns({f"x{i}": x for i, x in enumerate(vector())})
    fit = keyed.where("not base_failed").select("levels", *[f"x{i}" for i in range(DIMS)])
    found = Stored(estimates(fit), "estimates").df
    pairs = fit.select("levels").distinct()
    under = lambda i: found.join(pairs.select(F.col("levels")[i].alias("group"), F.col("levels")[i + 1].alias("parent")).distinct(), "group")
    groups = _shrunk(under(0), _shrunk(under(1), found))
    params = Stored(_inverse(groups, "group"), "mcd").df
    out = _with(keyed.withColumn("group", F.col("levels")[0]), params, "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= CUTOFF))
    return out.withColumn("kept", kept).select(*keep, *_NAMES, "base_failed", "distance", "kept")


def good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns, whatever their names."""
    return judge(docs, with_rows=True).where("kept").select("row.*")
