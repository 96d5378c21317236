"""Aggregates of the reports a monitoring team reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, levels
from ..functions.rounding import rounded
from .quantiles import quantiles

QUARTILES = {"p10": 0.1, "median": 0.5, "p90": 0.9, "p95": 0.95}


def r6(c: Column | str) -> Column:
    return rounded(c, 6)


def summary(df: DataFrame) -> DataFrame:
    """Totals, counts by flag, by year and by month in one pass of grouping sets."""
    out = df.groupingSets([[], ["quality_flag"], ["year"], ["year", "month"]], "quality_flag", "year", "month")
    scope = F.when(F.grouping("quality_flag") == 0, "flag").when(F.grouping("month") == 0, "month").when(F.grouping("year") == 0, "year").otherwise("all")
    return out.agg(scope.alias("scope"), F.count(F.lit(1)).alias("n"), F.count_if("downloaded").alias("downloaded"), F.count_if(~F.col("downloaded")).alias("missing"))


def score_stats(df: DataFrame, score: str, by: list[str], wanted: dict[str, float] = QUARTILES) -> DataFrame:
    """Count, mean, deviation, extremes and the wanted quantiles; without any of these it is a single aggregate."""
    c = F.col(score)
    few = [F.count(c).alias("n"), r6(F.avg(c)).alias("mean"), r6(F.stddev_samp(c)).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")]
    if not wanted:
        return df.groupBy(*by).agg(*few)
    q = quantiles(df, score, by, wanted).select(*[F.col(b).alias(f"_{b}") for b in by], *[r6(n).alias(n) for n in wanted])
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return df.groupBy(*by).agg(*few).join(q, same, "left").drop(*[f"_{b}" for b in by])


def flag_shares(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each flag and their share of the group, from aggregates only."""
    flags = df.groupBy(*by, F.coalesce("quality_flag", F.lit("unknown")).alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_night").alias("at_night"))
    total = F.sum("n").over(W.partitionBy(*by))
    return flags.withColumn("percent", r6(100 * F.col("n") / total))


def coverage(df: DataFrame, by: list[str]) -> DataFrame:
    scored, usable = F.col("patchcore_score").isNotNull(), F.col("quality_flag") == "usable"
    n = F.count(F.lit(1))
    share = lambda c: r6(100 * F.count_if(c) / n)
    return df.groupBy(*by).agg(n.alias("indexed"), F.count_if("downloaded").alias("downloaded"), F.count_if(scored).alias("scored"), F.count_if(usable).alias("usable"), share(F.col("downloaded")).alias("downloaded_percent"), share(scored).alias("scored_percent"))


def timeline(df: DataFrame, score: str, rule: str, by: list[str] | None = None) -> DataFrame:
    """Mean, maximum and count of a score by day, week ending on Sunday or month; empty bins are absent."""
    at = df.withColumn("bin", dates.bin_label(dates.moment_strict(), rule)).filter(F.col("bin").isNotNull() & F.col(score).isNotNull())
    return at.groupBy(*(by or []), "bin").agg(F.avg(score).alias("mean_score"), F.max(score).alias("max_score"), F.count(F.lit(1)).alias("n_images"))


def rolling_std(bins: DataFrame, by: list[str], order: str, value: str, width: int = 4) -> DataFrame:
    """Sample deviation of the last `width` bins; null for a single one."""
    return bins.withColumn("band", F.stddev_samp(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(1 - width, 0)))


def histogram(df: DataFrame, value: str, bins: int, by: list[str]) -> DataFrame:
    """Counts and density per group over shared edges; the last bin is closed. Equal values are all in the last bin, which has no width and so no density."""
    df = df.filter(F.col(value).isNotNull())
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))  # one row
    step = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.floor(F.try_divide(F.col(value) - F.col("lo"), step)), F.lit(bins - 1)).cast("int")
    counted = df.join(F.broadcast(edges)).groupBy(*by, place.alias("bin"), step.alias("width")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("density", r6(F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy(*by)) * F.col("width")))).drop("width")


def box_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles, and whiskers at the last values within 1.5 interquartile ranges."""
    q = quantiles(df, value, by, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    near = F.when(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach), F.col(value))
    return df.join(q, by).groupBy(*by, "q1", "q2", "q3").agg(F.min(near).alias("low"), F.max(near).alias("high"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, nulls, mean, deviation and extremes per column, one row each, from one aggregate."""
    parts = [f(F.col(c)).alias(f"{c}__{n}") for c in columns for n, f in (("n", F.count), ("missing", lambda x: F.count_if(x.isNull())), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{n}").cast("long" if n in ("n", "missing") else "double").alias(n) for n in ("n", "missing", "mean", "std", "min", "max")]) for c in columns]
    return df.agg(*parts).select(F.inline(F.array(*rows)))


def mu_2sigma(df: DataFrame, score: str, by: list[str], k: float = 2.0) -> DataFrame:
    """Threshold mean + k deviations per scope, which rows exceed it and by how much. The
    threshold is aggregated and joined back, so no window holds a whole scope."""
    line = df.groupBy(*by).agg((F.avg(score) + k * F.stddev_samp(score)).alias("threshold"))
    out = df.join(line, by) if by else df.join(F.broadcast(line))
    return out.withColumns({"is_anomaly": F.col(score) > F.col("threshold"), "distance_to_threshold": F.col(score) - F.col("threshold")})


def class_shares(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", r6(100 * F.col("n") / F.sum("n").over(W.partitionBy())))


def pivot_counts(df: DataFrame, rows: list[str], column: str, values: list, value: Column | None = None) -> DataFrame:
    """Counts (or an aggregate) with one column for each of the given values; absent ones count 0."""
    out = df.groupBy(*rows).pivot(column, values).agg(value if value is not None else F.count(F.lit(1)))
    return out if value is not None else out.na.fill(0)


FLAGS = levels.FLAGS
