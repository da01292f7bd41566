"""URL filters: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bloom import MOST_BLOCKS, blocks_for, bloom, probed
from ._common import Stored, ascii_lower

#: More rules than this are joined as a table instead of being conditions of the plan.
MOST_RULES = 200
#: A URL with more than this share of the possible hits, or more than so many of them, is cut into parts.
SHARE, LEAST_PART = 10_000, 1 << 16


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; "" for null or without "://"."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end; "" for null or without "://"."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The URL without scheme, "www.", default port, closing slashes, fragment and utm_ parameters; null without host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(url, r"^(?s:.*?)://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&", "")
    return F.when(
        host_of(url) != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    )


def _fits(host: Column, path: Column, rule: str) -> Column:
    name, slash, rest = rule.partition("/")
    name = name.lower()
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def _decided(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """urls (host, path) with rule and verdict of the longest rule that fits; null without one."""
    host, path = F.col("host"), F.col("path")
    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    none = F.lit(None).cast("string")
    rule = F.coalesce(*[F.when(_fits(host, path, r), F.lit(r)) for _, r in ranked], none)
    verdict = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for v, r in ranked], none)
    return urls.withColumn("rule", rule).withColumn("verdict", verdict)


def _joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """As _decided(), for a table of rules (rule, verdict) of any size.

    Every distinct host and path becomes pairs of a host's suffix and a path's beginning, of the lengths that rules have,
    and those an equality join: no comparison of all URLs with all rules of a host.
    """
    name, rest = F.substring_index("rule", "/", 1), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")
    keyed = rules.groupBy("rule").agg(F.min("verdict").alias("verdict")).select("rule", "verdict", ascii_lower(name).alias("suffix"), rest.alias("start"))
    lengths = [r[0] for r in keyed.select(F.length("start").alias("n")).distinct().orderBy("n").collect()]  # at most as many as a URL has characters
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    each = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    each = each.select("host", "path", "suffix", F.explode(F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("start"))
    best = each.join(keyed, ["suffix", "start"]).groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "verdict")).alias("b"))
    return urls.join(best.select("host", "path", "b.rule", "b.verdict"), ["host", "path"], "left")


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[tuple[str, str]] | DataFrame,
    url: str = "url",
    listed_url: str = "url",
) -> DataFrame:
    """Adds host, path, rule, verdict to the rows of pages, instead of columns of these names; all other columns come back as
    they are, whatever their names.

    rules are (verdict, "host/path") pairs, or a table with the columns verdict and rule; many rules, and those of a
    table, are joined. The longest fitting rule decides (of equal verdicts for one rule the first listed, in a table the
    smallest); without one, a page whose canonical URL is listed is blocked and any other allowed. The Bloom filter is
    broadcast (its size is bounded by MOST_BLOCKS); pages it rejects are final, possible hits go to a hash join on the
    canonical URL, where URLs with more than a share of them are cut into as many parts as that asks for. Null URLs and URLs without "://" have empty host and path,
    fit nothing and are allowed. Repeated rows are each judged; an empty list blocks nothing.
    """
    spark, added = pages.sparkSession, ["host", "path", "rule", "verdict"]
    names = [c for c in pages.columns if c not in added]
    known = listed.select(canonical(F.col(listed_url)).alias("canon")).where("canon is not null").distinct()
    blocks = blocks_for(known.limit(MOST_BLOCKS * 4).count())
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    urls = pages.select(row, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), canonical(F.col(url)).alias("canon"))
    if isinstance(rules, DataFrame):
        base = _joined(urls, rules)
    elif len(rules) > MOST_RULES:
        first = {rule: verdict for verdict, rule in reversed(rules)}
        base = _joined(urls, spark.createDataFrame(list(first.items()), "rule STRING, verdict STRING"))
    else:
        base = _decided(urls, rules)
    base = base.withColumn("canon", F.when(F.col("rule").isNull(), F.col("canon")))
    flagged = probed(base, "canon", bloom(known, "canon", blocks), blocks)
    out = ["row.*", *added]
    rest = flagged.where(~F.col("__maybe")).withColumn("verdict", F.coalesce("verdict", F.lit("allow"))).select(*out)
    maybe = flagged.where("__maybe")
    counted = Stored(maybe.groupBy("canon").agg(F.count("*").alias("n")), "hits").df
    most = max(LEAST_PART, (counted.agg(F.sum("n")).first()[0] or 0) // SHARE)
    # Each has more than that share of all possible hits, so these are at most SHARE.
    cut = F.broadcast(counted.where(F.col("n") > most).select("canon", F.ceil(F.col("n") / most).cast("long").alias("parts")))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    maybe = maybe.join(cut, "canon", "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), parts))
    exact = known.join(cut, "canon", "left").select(F.col("canon").alias("listed"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("at"))
    hits = maybe.join(exact.hint("shuffle_hash"), (maybe["canon"] == exact["listed"]) & (maybe["salt"] == exact["at"]), "left")
    return rest.unionByName(hits.withColumn("verdict", F.when(F.col("listed").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).select(*out))
