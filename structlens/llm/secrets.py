"""Secret scans: fixed patterns, and a randomness test battery on long tokens.

A token is a run of 20 or more characters of an encoding's alphabet. The battery asks how unlikely a token is as a name
or a word written in that alphabet: chi-squared uniformity of its characters, runs of character classes, and serial
correlation of neighbours. Each statistic is standardized by its exact mean and variance under that null, their scores
are combined to a p-value, and tokens are reported under Benjamini-Hochberg control of the false discovery rate within
bands of length, counted over the whole corpus. Only DataFrame expressions are used: a text is read once, its matches
become rows, and every step is linear in the text, its matches and the length of a token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Stored

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "random")
#: What a text must hold for its matches of a kind to be looked for, and the pattern itself.
PATTERNS = ((ASSIGN, ASSIGN), (r"AKIA[A-Z0-9]{16}", ACCESS), (HEX, HEX), (TOKEN, TOKEN))
#: Encodings from the narrowest: name, pattern, size of the alphabet; sums of squared and of cubed character shares of
#: names and words in it; whether neighbours can differ in class (fixed values, measured on words of a public
#: vocabulary joined in lower case, as camel case, by separators, and with numbers).
ENCODINGS = (
    ("decimal", r"^[0-9]+$", 10, 0.2, 0.05, False),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 16, 0.12, 0.02, True),
    ("base32", r"^[A-Z2-7]+=*$", 32, 0.06, 0.0042, True),
    ("base36", r"^[a-z0-9]+$", 36, 0.06, 0.0042, True),
    ("base64", r"^.*$", 64, 0.05, 0.003, True),
)
#: Of names: share of neighbours that differ in class (digit, capital, small letter), and correlation of neighbours.
CHANGE, SERIAL = 0.27, -0.1
#: False discoveries among reported tokens, in a band of length. Bands double.
RATE = 0.001
#: Tenths of -log10(p) beyond which p-values are as good as equal.
MOST_BIN = 400


def normal_tail(z: Column) -> Column:
    """-log10 of an upper bound of the normal distribution's upper tail, within a few per cent for z >= 0; 0 below."""
    bound = F.lit(4 / (2 * 3.141592653589793) ** 0.5) / (3 * z + F.sqrt(z * z + 8))
    return F.when(z > 0, (z * z / 2 - F.log(bound)) / 2.302585092994046).otherwise(F.lit(0.0))


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, uniform, runs, serial (z-scores, larger if more random) and bin (tenths of -log10 p) to tokens (hit).

    Under the null, characters are drawn independently with shares p: the pairs of equal characters have mean n (n - 1)
    s2 and variance 2 n (n - 1) (s2 + 2 (n - 2) s3 - (2 n - 3) s2^2), with s2 and s3 the sums of p^2 and p^3. Changes of
    class are binomial; the serial correlation has standard deviation 1 / sqrt(n).
    """
    named = tokens.withColumn("encoding", F.coalesce(*[F.when(F.col("hit").rlike(e[1]), F.lit(e[0])) for e in ENCODINGS]))
    pick = lambda i: F.coalesce(*[F.when(F.col("encoding") == e[0], F.lit(e[i])) for e in ENCODINGS])
    start = F.struct(F.lit(-1.0).alias("last"), *[F.lit(0.0).alias(x) for x in ("s", "q", "c")])
    step = lambda a, x: F.struct(
        x.alias("last"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"), (a["c"] + F.when(a["last"] >= 0, a["last"] * x).otherwise(0.0)).alias("c")
    )
    # Each step's columns are computed in a projection of their own, once a token.
    split = named.withColumns({"__n": F.length("hit").cast("double"), "__chars": F.filter(F.split("hit", ""), lambda c: c != ""), "__s2": pick(3), "__s3": pick(4), "__classes": pick(5)})
    counted = split.withColumns({
        "__pairs": F.aggregate(F.array_distinct("__chars"), F.lit(0.0), lambda a, c: a + F.pow(F.col("__n") - F.length(F.replace("hit", c, F.lit(""))), F.lit(2))) - F.col("__n"),
        "__sums": F.aggregate(F.transform("__chars", lambda c: F.ascii(c).cast("double")), start, step),
        "__plain": F.regexp_replace("hit", "[+/_=-]+", ""),
        "__first": F.ascii("hit").cast("double"),
    })
    n, s2, s3, sums = F.col("__n"), F.col("__s2"), F.col("__s3"), F.col("__sums")
    m = F.greatest(F.length("__plain") - 1, F.lit(1)).cast("double")
    changes = F.greatest(F.length(F.regexp_replace("__plain", "[0-9]+|[A-Z]+|[a-z]+", "x")) - 1, F.lit(0)).cast("double")
    mean = sums["s"] / n
    spread = sums["q"] - n * mean * mean
    cross = sums["c"] - mean * (2 * sums["s"] - F.col("__first") - sums["last"]) + (n - 1) * mean * mean
    scored = counted.withColumns({
        "uniform": (n * (n - 1) * s2 - F.col("__pairs")) / F.sqrt(2 * n * (n - 1) * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2)),
        "runs": F.when(F.col("__classes"), (changes - m * CHANGE) / F.sqrt(m * (CHANGE * (1 - CHANGE)))),
        # Both signs of correlation speak against randomness.
        "serial": F.when(spread > 0.5, (-F.abs(cross / spread) - SERIAL) * F.sqrt(n)).otherwise(-F.sqrt(n)),
    })
    total = F.col("uniform") + F.coalesce("runs", F.lit(0.0)) + F.col("serial")
    scored = scored.withColumn("__z", total / F.when(F.col("__classes"), F.lit(3.0**0.5)).otherwise(F.lit(2.0**0.5)))
    bins = F.least(F.lit(MOST_BIN), F.floor(normal_tail(F.col("__z")) * 10)).cast("int")
    return scored.select(*tokens.columns, "encoding", "uniform", "runs", "serial", bins.alias("bin"))


def _matches(docs: DataFrame) -> DataFrame:
    """(row, kind, start, end, hit, inner): matches of each row of docs (row, pieces), in code points.

    Where a match lies follows from the lengths of the matches before it and of the texts between them.
    """
    each = docs.select("row", F.posexplode("pieces").alias("kind", "found")).select("row", "kind", F.posexplode("found").alias("pos", "m"))
    upto = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.length("m.hit")).over(upto)
    placed = each.select("row", "kind", end.cast("int").alias("end"), "m.hit", "m.inner")
    return placed.select("row", "kind", (F.col("end") - F.length("hit")).alias("start"), "end", "hit", "inner")


def _pieces(text: Column, holds: str, pattern: str, grouped: bool) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if grouped else F.lit(None).cast("array<string>")
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.zip_with(found, gaps, lambda h, g: F.struct(g.alias("gap"), h.alias("hit"), F.lit(None).cast("string").alias("inner")))
    if grouped:
        zipped = F.zip_with(zipped, inner, lambda z, i: F.struct(z["gap"].alias("gap"), z["hit"].alias("hit"), i.alias("inner")))
    # The text after the last match is a gap without a hit.
    return F.when(text.rlike(holds), F.filter(zipped, lambda z: z["hit"].isNotNull())).otherwise(F.array().cast("array<struct<gap:int,hit:string,inner:string>>"))


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, base, added) for each row of docs (doc_id, text): arrays of (start, order, end, kind).

    base holds the fixed kinds by start, then in the order of KINDS; added the tokens that the battery reports and that
    overlap no base span. Null texts have no spans. Repeated rows are each scanned and count for the rate; an empty
    table gives no rows; other columns of docs are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select("doc_id", text.alias("text"))
    pieces = F.array(*[_pieces(F.col("text"), holds, p, p is ASSIGN) for holds, p in PATTERNS])
    held = Stored(plain.select(F.monotonically_increasing_id().alias("row"), "doc_id", pieces.alias("pieces")), "matches").df
    found = _matches(held.where("size(pieces[0]) + size(pieces[1]) + size(pieces[2]) + size(pieces[3]) > 0"))
    kept = (F.col("kind") != 0) | (F.length("inner") >= LEAST_ASSIGN)
    spans = found.where(kept & ((F.col("kind") != 1) | (F.length("hit") >= LEAST_ACCESS))).drop("inner")
    is_base = F.col("kind") < 3
    # A token overlaps a base span that begins before its end and ends after its start.
    ahead = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = spans.withColumns({"reach": F.max(F.when(is_base, F.col("end"))).over(ahead), "next": F.min(F.when(is_base, F.col("start"))).over(behind)})
    free = near.where((F.col("kind") == 3) & (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))
    band = F.floor(F.log2(F.length("hit").cast("double"))).cast("int").alias("band")
    base = near.where(is_base).select("row", "start", "end", "kind", F.lit(None).cast("int").alias("band"), F.lit(None).cast("int").alias("bin"))
    tested = battery(free.select("row", "start", "end", "kind", band, "hit")).select("row", "start", "end", "kind", "band", "bin")
    every = Stored(base.unionByName(tested), "spans").df
    counts = every.where("kind = 3").groupBy("band", "bin").count()
    least, whole = Window.partitionBy("band").orderBy(F.desc("bin")), Window.partitionBy("band")
    ranked = counts.withColumns({"rank": F.sum("count").over(least), "all": F.sum("count").over(whole)})
    passing = F.pow(F.lit(10.0), -F.col("bin") / 10) <= rate * F.col("rank") / F.col("all")
    # At most a row for each doubling of token length, so at most 32.
    cuts = ranked.where(passing).groupBy("band").agg(F.min("bin").alias("cut")).collect()
    limit = F.coalesce(*[F.when(F.col("band") == b, F.lit(c)) for b, c in cuts], F.lit(MOST_BIN + 1))
    names = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.struct("start", F.col("kind").alias("order"), "end", names.alias("kind"))
    reported = every.where((F.col("kind") < 3) | (F.col("bin") >= limit))
    by_row = reported.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("kind") < 3, span))).alias("base"), F.sort_array(F.collect_list(F.when(F.col("kind") == 3, span))).alias("added"))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    out = held.select("row", "doc_id").join(by_row, "row", "left")
    return out.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """scan() as counts of the base kinds, the digest of the base spans, and all spans as text."""
    found = scan(docs, rate)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
