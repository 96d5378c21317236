"""URL filter by a ratio of character language models (native: DataFrame functions only).

Rules decide where they fit. The URLs that they accept or reject train two
Witten-Bell smoothed variable-order Markov models over host and path (runs of
digits become one 0). The log-likelihood ratio of a URL is a plain sum of one
weight for each of its substrings: a substring of k characters adds what it
changes against backing off, as an event, and the back-off weight, as a context.
So scoring is an explode, a join with the table of weights and a sum, and equal
strings are scored once. The ratio per character is compared with a threshold
that a held-out fifth of the labelled strings calibrates.

Weights are millionths of a nat as whole numbers, so sums do not depend on their
order. Defined results: a null url, or one without ://, has an empty host and
path and no rule; without labels on both sides the threshold is 0 and an unseen
string is allowed; a ratio at the threshold is allowed, and of equally good thresholds the one
nearest to 0, then the lower, is taken; a long url takes four rows a character; repeated rows each get a
row; an empty table gives an empty result; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, hash_of, met, small
from .decontaminate import LOWER, UPPER

#: Verdict, host and path of each rule.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
ORDER = 4
FOLDS = 5
UNIT = 1_000_000
BIN = 10_000  # calibration looks at the ratio in hundredths of a nat


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without a ://."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(length, name, verdict); null if none."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("name"), F.lit(v).alias("verdict"))) for v, h, p in RULES]
    return F.array_max(F.array(*fits))


def labelled(pages: DataFrame) -> DataFrame:
    host, path = parsed(pages["url"])
    df = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path")))
    shape = F.concat(F.lit("\x02"), F.regexp_replace(F.concat("host", "path"), "[0-9]+", "0"), F.lit("\x03"))
    return df.select("page_id", "host", "path", F.col("r.name").alias("rule"), F.col("r.verdict").alias("label"), shape.alias("shape"))


def substrings(shape: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(shape) - (k - 1)), lambda i: F.substring(shape, i, F.lit(k)))


def all_substrings(shape: Column) -> Column:
    return F.flatten(F.array(*[F.when(F.length(shape) >= k, substrings(shape, k)).otherwise(F.array().cast("array<string>")) for k in range(1, ORDER + 1)]))


def weights(strings: DataFrame) -> DataFrame:
    """(gram, w) from strings(shape, yes, no, fold): the ratio's weight of each substring."""
    grams = strings.filter("fold > 0 and yes + no > 0").select("yes", "no", F.explode(all_substrings(F.col("shape"))).alias("gram"))
    grams = cut(grams.groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).withColumns({"k": F.length("gram"), "context": F.expr("left(gram, length(gram) - 1)"), "suffix": F.expr("substring(gram, 2)")}), "grams")
    seen = [f(c).alias(f"{n}_{c}") for c in ("yes", "no") for n, f in (("n", F.sum), ("t", lambda c: F.count_if(F.col(c) > 0)))]
    contexts = grams.groupBy("context").agg(*seen)
    for c in ("yes", "no"):
        back = F.when(F.col(f"n_{c}") > 0, F.col(f"t_{c}") / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(1.0)
        contexts = contexts.withColumn(f"back_{c}", back)
    with_context = cut(grams.join(contexts, "context"), "contexts")
    lower, levels = None, []
    for k in range(1, ORDER + 1):
        level = with_context.filter(F.col("k") == k)
        level = level.withColumns({f"q_{c}": F.lit(1 / 256) for c in ("yes", "no")}) if lower is None else level.join(lower, "suffix")
        for c in ("yes", "no"):
            p = F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"q_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"q_{c}"))
            level = level.withColumn(f"p_{c}", p)
        gain = lambda c: F.log(F.col(f"p_{c}") / (F.col(f"back_{c}") * F.col(f"q_{c}")))
        level = cut(level.select("gram", "p_yes", "p_no", F.when(F.col("yes") > 0, gain("yes")).otherwise(0.0).alias("g_yes"), F.when(F.col("no") > 0, gain("no")).otherwise(0.0).alias("g_no")), "level")
        lower = level.select(F.col("gram").alias("suffix"), F.col("p_yes").alias("q_yes"), F.col("p_no").alias("q_no"))
        levels.append(level.select("gram", (F.col("g_yes") - F.col("g_no")).alias("w")))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    backs = contexts.select(F.col("context").alias("gram"), (F.log("back_yes") - F.log("back_no")).alias("w"))
    return out.union(backs).groupBy("gram").agg(F.round(F.sum("w") * UNIT).cast("long").alias("w"))


def scores(strings: DataFrame, table: DataFrame) -> DataFrame:
    """strings with `ratio`, in hundredths of a nat per character."""
    start = table.filter("gram = ''").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    each = strings.select("shape", F.explode(all_substrings(F.col("shape"))).alias("gram")).join(small(table, 2_000_000), "gram", "left")
    sums = each.groupBy("shape").agg(F.sum(F.coalesce("w", F.lit(0))).alias("s"))
    length = F.length("shape").cast("long")
    return strings.join(sums, "shape").withColumn("ratio", F.floor((F.col("s") + F.lit(start).cast("long") * length) / (length * BIN)).cast("long")).drop("s")


def threshold(scored: DataFrame) -> int:
    """The ratio that parts held-out accepted and rejected strings best (balanced accuracy)."""
    bins = scored.filter("fold = 0 and yes + no > 0").groupBy("ratio").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    below = W.orderBy("ratio").rowsBetween(W.unboundedPreceding, -1)  # bins of ratios, not rows
    all_ = W.partitionBy()
    cuts = bins.withColumns({"rejected": F.try_divide(F.coalesce(F.sum("no").over(below), F.lit(0)), F.sum("no").over(all_)), "lost": F.try_divide(F.coalesce(F.sum("yes").over(below), F.lit(0)), F.sum("yes").over(all_))})
    best = cuts.select("ratio", (F.col("rejected") - F.col("lost")).alias("gain")).filter("gain is not null").orderBy(F.desc("gain"), F.abs("ratio"), "ratio").first()
    return best.ratio if best else 0


def filter_urls(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, ratio (null where a rule decides)."""
    rows = labelled(pages)
    count = lambda v: F.count_if(F.coalesce(F.col("label") == v, F.lit(False)))
    strings = rows.groupBy("shape").agg(count("allow").alias("yes"), count("block").alias("no"), F.count(F.lit(1)).alias("n"))
    strings = cut(strings.withColumn("fold", hash_of("shape") % FOLDS), "strings")
    scored = cut(scores(strings, cut(weights(strings), "weights")), "scored")
    line = threshold(scored)
    joined = met(rows, scored.select("shape", "ratio", "n"), "shape", "n")
    verdict = F.coalesce("label", F.when(F.col("ratio") >= line, "allow").otherwise("block"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("ratio")).alias("ratio"))
