"""Evaluation statistics of scores against labels.

Ranks and cumulative counts are taken over distinct scores, after an aggregation
by score. The running sums go over slices of the score range: totals of the
slices are added up first, so no task orders all scores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from .quantiles import quantiles, sliced
from .sample import ranks
from .select import small


def by_score(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """One row per distinct score: pos, neg, and above_pos, above_neg, the counts of higher scores.

    Distinct scores are range-partitioned, and a partition is a slice: as many of them as the
    data have, so that none is long, whatever the distribution of the scores."""
    counts = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("s"))
    counts = counts.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    up = [*by, F.desc("s")]
    placed = sliced(counts, up)
    totals = placed.groupBy(*by, "_slice").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)  # slices, not rows
    totals = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_slice").alias("_of"), F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_up_p"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_up_n"))
    inside = W.partitionBy(*by, "_slice").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, -1)
    for c in ("pos", "neg"):
        placed = placed.withColumn(f"above_{c}", F.coalesce(F.sum(c).over(inside), F.lit(0)))
    same = F.col("_slice") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = placed.join(totals, same)
    return out.select(*by, "s", "pos", "neg", (F.col("above_pos") + F.col("_up_p")).alias("above_pos"), (F.col("above_neg") + F.col("_up_n")).alias("above_neg"))


def ranked_stats(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Average precision, prevalence, area under the ROC curve, Mann-Whitney U and its tie
    term in one pass; null where a class is empty."""
    by = by or []
    t = by_score(df, score, label, by)
    tp, all_ = F.col("above_pos") + F.col("pos"), F.col("above_pos") + F.col("pos") + F.col("above_neg") + F.col("neg")
    n = F.col("pos") + F.col("neg")
    out = t.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * tp / all_).alias("_ap"),
        F.sum(F.col("neg") * (F.col("above_pos") + F.col("pos") / 2)).alias("u"), F.sum((n * n * n - n).cast("double")).alias("ties"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.withColumns({"auc_pr": F.when(both, F.col("_ap") / F.col("n_pos")), "prevalence": F.when(both, F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))), "auc_roc": F.when(both, F.col("u") / (F.col("n_pos") * F.col("n_neg")))}).drop("_ap")


def exact_tail(u: float, n1: int, n2: int) -> float:
    """P(U >= u) without ties, by counting the arrangements for every value of U."""
    ways = [1] + [0] * (n1 * n2)
    for j in range(1, n1 + 1):  # Gaussian binomial: times (1 - q^(n2+j)), divided by (1 - q^j)
        for i in range(n1 * n2, n2 + j - 1, -1):
            ways[i] -= ways[i - n2 - j]
        for i in range(j, n1 * n2 + 1):
            ways[i] += ways[i - j]
    return sum(ways[math.ceil(u) :]) / math.comb(n1 + n2, n1)


def mann_whitney(df: DataFrame, score: str, label: str, least: int = 5) -> DataFrame:
    """U, one-sided p (positives higher), effect 2U/(n1 n2) - 1; empty with under `least` rows in a class."""
    row = ranked_stats(df, score, label).first()  # one row
    spark = df.sparkSession
    schema = "u double, p_value double, effect_size double, n_pos long, n_neg long"
    if row is None or row.n_pos is None or min(row.n_pos, row.n_neg) < least:
        return spark.createDataFrame([], schema)
    n1, n2 = row.n_pos, row.n_neg
    n = n1 + n2
    if min(n1, n2) <= 8 and not row.ties:
        p = exact_tail(row.u, n1, n2)
    else:
        sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - row.ties / (n * (n - 1))))
        p = 0.5 * math.erfc((row.u - n1 * n2 / 2 - 0.5) / sd / math.sqrt(2)) if sd else 1.0
    return spark.createDataFrame([(float(row.u), float(min(1.0, p)), 2 * row.u / (n1 * n2) - 1, n1, n2)], schema)


def pr_curve(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    t = by_score(df, score, label, by)
    tp, all_ = F.col("above_pos") + F.col("pos"), F.col("above_pos") + F.col("pos") + F.col("above_neg") + F.col("neg")
    total = df.filter(F.col(score).isNotNull()).groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("_all"))
    return t.join(total, by).select(*by, F.col("s").alias("threshold"), (tp / all_).alias("precision"), (tp / F.col("_all")).alias("recall"))


def pr_curves(df: DataFrame, scores: list[str], label: str) -> DataFrame:
    """detector, threshold, precision, recall of several score columns, each over the rows that have it, and of a random
    detector: the share of positives among the rows with the first score, at recall 0 and 1."""
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias("detector"), F.col(c).cast("double").alias("score")) for c in scores])).alias("x")).select(label, "x.*").filter("score is not null")
    share = df.filter(F.col(scores[0]).isNotNull()).agg((F.count_if(F.col(label) == 1) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("precision"))  # one row
    line = share.select(F.lit("random").alias("detector"), F.lit(None).cast("double").alias("threshold"), "precision", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("recall"))
    return pr_curve(long, "score", label, ["detector"]).unionByName(line)


def inversion(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: areas of the score and of its inverse against the share of positives, and advice.

    Scores only count by their order, so the inverse is the negative. `advice`: keep, invert, or that the labels are unsuited, if the
    inverse is better but no better than chance."""
    long = df.select(label, F.explode(F.array(F.struct(F.lit(False).alias("turned"), F.col(score).alias("s")), F.struct(F.lit(True).alias("turned"), (-F.col(score)).alias("s")))).alias("x")).select(label, "x.*")
    both = ranked_stats(long, "s", label, ["turned"])
    of = lambda c, turned: F.max(F.when(F.col("turned") == turned, F.col(c)))
    row = both.agg(of("auc_roc", False).alias("a"), of("auc_roc", True).alias("b"), of("auc_pr", False).alias("c"), of("auc_pr", True).alias("d"), F.max("prevalence").alias("e"))
    better, above, above_turned = F.col("d") > F.col("c"), F.col("c") > F.col("e"), F.col("d") > F.col("e")
    advice = F.when(better & above_turned, "invert").when(better, "unsuited labels").otherwise("keep")
    areas = {"auc_roc": "a", "auc_roc_inverted": "b", "auc_pr": "c", "auc_pr_inverted": "d", "prevalence": "e"}
    return row.select(*[rounded(c, 6).alias(n) for n, c in areas.items()], (F.col("a") < 0.5).alias("invert"), above.alias("above_random"), above_turned.alias("above_random_inverted"), advice.alias("advice"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 with 0 where it is undefined."""
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def binary_scores(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None, rows: str | None = None) -> DataFrame:
    """Confusion cells, F1 of each class, their mean and accuracy. rows: a column that says how many rows one stands for."""
    y, p = F.col(truth), F.col(predicted)
    cells = {"tp": (y == 1) & (p == 1), "fp": (y == 0) & (p == 1), "fn": (y == 1) & (p == 0), "tn": (y == 0) & (p == 0)}
    out = df.groupBy(*(by or [])).agg(*[(F.sum(F.when(c, F.col(rows)).otherwise(0)) if rows else F.count_if(c)).alias(k) for k, c in cells.items()])
    tp, fp, fn, tn = (F.col(k) for k in cells)
    out = out.withColumns({"f1_positive": f1(tp, fp, fn), "f1_negative": f1(tn, fn, fp)})
    return out.withColumns({"f1_macro": (F.col("f1_positive") + F.col("f1_negative")) / 2, "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn)})


def triage_f1(index: DataFrame, predictions: DataFrame) -> DataFrame:
    """F1 of weather labels against dark (1) and cloudy (0) images; empty without a labelled row."""
    y = F.when(F.col("quality_flag") == "dark", 1).when(F.col("quality_flag") == "cloudy", 0)
    both = index.drop("weather_label").withColumn("y", y).filter("y is not null").join(predictions.select("filename", "weather_label"), "filename")
    out = binary_scores(both, "y", "weather_label").filter("tp + fp + fn + tn > 0")
    return out.select("f1_macro", F.col("f1_positive").alias("f1_volcanic"), F.col("f1_negative").alias("f1_weather"), "accuracy")


def report(ranked: DataFrame, signal: DataFrame, binary: DataFrame, triage: DataFrame, counts: DataFrame) -> DataFrame:
    """The figures of frames of one row as one row; null where a frame has no row."""
    one = counts.join(F.broadcast(ranked), F.lit(True), "left")
    for df in (signal, binary, triage):
        one = one.join(F.broadcast(df), F.lit(True), "left")
    delta = F.col("auc_pr") - F.col("prevalence")
    figures = {"auc_pr_baseline": F.col("prevalence"), "auc_pr_patchcore": F.col("auc_pr"), "auc_roc_patchcore": F.col("auc_roc"), "delta_auc_pr": delta}
    rest = ["f1_macro_evaluate", "f1_anomaly", "f1_normal", "f1_macro_triage", "f1_volcanic", "f1_weather"]
    return one.select(*[rounded(c, 6).alias(k) for k, c in figures.items()], rounded(F.when(F.col("prevalence") > 0, 100 * delta / F.col("prevalence")), 4).alias("improvement_pct"), *[rounded(c, 6).alias(c) for c in rest], rounded("p_value", 8).alias("mann_whitney_p"), rounded("effect_size", 6).alias("effect_size"), "n_train", "n_test", F.col("n_pos").alias("n_positive_proxy"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    n = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(truth)))


def precursors(index: DataFrame, events: DataFrame, leads: tuple[int, ...] = (3, 7, 14), score: str = "patchcore_score", ratio: float = 1.1, least: int = 2) -> DataFrame:
    """Scores of usable images in the days before each event against the usual ones.

    The window [event - lead, event) becomes an equi-join on the day: an event is
    expanded into the days of its longest lead (a fixed number), and every lead takes
    those within its reach. Background: median over usable day images."""
    at = F.make_timestamp_ntz("year", "month", "day", F.coalesce("hour", F.lit(0)), F.coalesce("minute", F.lit(0)), F.coalesce("second", F.lit(0)))
    scored = index.filter(F.col(score).isNotNull() & (F.col("quality_flag") == "usable")).select(at.alias("at"), F.make_date("year", "month", "day").alias("d"), F.col(score).alias("s"), F.coalesce("hour", F.lit(0)).alias("h"))
    usual = quantiles(scored.filter("h between 6 and 17"), "s", [], {"background_score": 0.5})
    days = events.select("event_date", "event_type", "event_intensity", F.explode(F.sequence(F.date_sub("event_date", max(leads)), F.date_sub("event_date", 1))).alias("d"))
    lead = F.explode(F.array(*map(F.lit, leads)))
    met = scored.join(small(days), "d").withColumn("lead_days", lead).filter(F.col("d") >= F.date_sub("event_date", F.col("lead_days")))
    stats = met.groupBy("event_date", "event_type", "event_intensity", "lead_days").agg(F.count(F.lit(1)).alias("n_images"), F.avg("s").alias("mean_score"), F.percentile("s", F.lit(0.9)).alias("q90_score"), F.max("s").alias("max_score")).filter(F.col("n_images") >= least)
    out = stats.join(F.broadcast(usual)).withColumn("ratio", F.when(F.col("background_score") > 0, F.col("q90_score") / F.col("background_score")))
    return out.withColumn("triggered", F.coalesce(F.col("ratio") >= ratio, F.lit(False)))


def threshold_analysis(found: DataFrame, thresholds: tuple[float, ...] = (1.0, 1.1, 1.2, 1.3, 1.4, 1.5)) -> DataFrame:
    """Triggers and ratio statistics per threshold and lead, from the rows of precursors()."""
    each = found.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hit = F.count_if(F.col("ratio") >= F.col("threshold"))
    return each.groupBy("threshold", "lead_days").agg(F.count(F.lit(1)).alias("n_events"), hit.alias("n_triggers"), (hit / F.count(F.lit(1))).alias("trigger_rate"), F.avg("ratio").alias("ratio_mean"), F.percentile("ratio", F.lit(0.5)).alias("ratio_median"), F.max("ratio").alias("ratio_max"))


def spread(total: int) -> tuple[int, int]:
    """Sides of a rectangle of total cells or a few more: of up to 1,000 sides from the root of total on, that with the fewest."""
    root = math.isqrt(total)
    side = min(range(root, root + min(1000, root + 1)), key=lambda a: (-total % a, a))
    return side, -(-total // side)


def drawn(spark: SparkSession, runs: int, m: int, total: int) -> DataFrame:
    """run, at: for each run m different numbers below total, drawn at random without replacement.

    A run is a keyed permutation of the cells of a rectangle that holds `total` of them: six Feistel steps add to the column
    a hash of the line, or the other way round. Its first m images that are below total are the draw; a few cells are not."""
    a, b = spread(total)
    out = spark.range(runs).select(F.col("id").alias("run"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m + a * b - total - 1).cast("long"))).alias("j"))
    out = out.select("run", "j", (F.col("j") % a).alias("x"), F.floor(F.col("j") / a).alias("y"))
    # names its argument once: the filter below is pushed down through all steps, which would double it each time
    stirred = lambda h: F.shiftright(h * 1540483477, 16) % 4294967296
    for i in range(6):
        to, of, size = ("x", "y", a) if i % 2 == 0 else ("y", "x", b)
        key = stirred((F.col("run") * 6 + i + 1) * 2246822519 % 4294967296)
        h = stirred(stirred((F.col(of) * 2654435761 + key) % 4294967296))
        out = out.withColumn(to, (F.col(to) + F.shiftright(h, 6)) % size)
    inside = out.select("run", "j", (F.col("y") * a + F.col("x")).alias("at")).filter(F.col("at") < total)
    return inside.withColumn("i", F.row_number().over(W.partitionBy("run").orderBy("j"))).filter(F.col("i") <= m).select("run", "at")


def permutation_test(index: DataFrame, found: DataFrame, lead: int = 7, runs: int = 1000, score: str = "patchcore_score", key: str = "image_id", least: int = 10) -> DataFrame:
    """How often the mean score of random usable rows reaches the mean q90 of the events of one lead;
    empty without an event or with under `least` rows.

    Each run draws m rows without replacement: instead of crossing runs with rows, every run draws m row
    numbers and joins them, so the work is runs x m."""
    of = found.filter(F.col("lead_days") == lead)
    seen = of.agg(F.avg("q90_score").alias("q"), F.count(F.lit(1)).alias("k")).first()  # one row
    rows = index.filter(F.col(score).isNotNull() & (F.col("quality_flag") == "usable")).select(F.lit(0).alias("all"), key, F.col(score).alias("s"))
    total = rows.count()
    m = min(total, int(seen.k) * max(1, 2 * lead))
    spark = index.sparkSession
    if total < least or seen.q is None:
        return spark.createDataFrame([], "lead_days int, n_permutations int, observed_mean double, null_mean double, null_std double, p_value double, significant boolean")
    numbered = ranks(rows, "all", key).select((F.col("rank") - 1).alias("at"), "s")
    means = drawn(spark, runs, m, total).join(numbered, "at").groupBy("run").agg(F.avg("s").alias("mean"))
    q = F.lit(float(seen.q))
    p = F.count_if(F.col("mean") >= q) / F.count(F.lit(1))
    return means.agg(F.lit(lead).alias("lead_days"), F.count(F.lit(1)).cast("int").alias("n_permutations"), F.first(q).alias("observed_mean"), F.avg("mean").alias("null_mean"), F.stddev_pop("mean").alias("null_std"), p.alias("p_value"), (p < 0.05).alias("significant"))
