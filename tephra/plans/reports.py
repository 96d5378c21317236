"""Queries of the reports: summaries, coverage, timelines, histograms, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import levels
from ..functions.rounding import rounded
from ..operators import report
from ..operators.quantiles import quantiles
from ..operators.report import r6
from ..sources import catalog_files
from .derived import CLASSED_SQL
from .registry import query
from .views import index


def _n():  # noqa: ANN202
    return F.count(F.lit(1))


@query("SELECT CASE WHEN GROUPING(quality_flag) = 0 THEN 'flag' WHEN GROUPING(month) = 0 THEN 'month' WHEN GROUPING(year) = 0 THEN 'year' ELSE 'all' END AS scope, quality_flag, year, month, count(*) AS n, count(*) FILTER (downloaded) AS downloaded, count(*) FILTER (NOT downloaded) AS missing FROM idx GROUP BY GROUPING SETS ((), (quality_flag), (year), (year, month))")
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(index(spark, sf_dir)).select("scope", "quality_flag", "year", "month", "n", "downloaded", "missing")


@query("SELECT round(avg((quality_flag = 'usable')::INT), 6) AS usable_rate, round(avg((quality_flag = 'dark')::INT), 6) AS dark_rate, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}, round(stddev_samp({c}), 6) AS std_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}" for c in ("mean_brightness", "variance", "entropy")) + " FROM idx")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = [r6(F.avg((F.col("quality_flag") == f).cast("int"))).alias(f"{f}_rate") for f in ("usable", "dark")]
    stats = [x for c in ("mean_brightness", "variance", "entropy") for x in (r6(F.avg(c)).alias(f"mean_{c}"), r6(F.stddev_samp(c)).alias(f"std_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))]
    return index(spark, sf_dir).agg(*rates, *stats)


_FLAGS = ", ".join(f"count(*) FILTER (coalesce(quality_flag, 'unknown') = '{f}') AS {f}" for f in levels.FLAGS)


@query(f"SELECT year, month, {_FLAGS} FROM idx GROUP BY year, month")
def quality_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir).withColumn("flag", F.coalesce("quality_flag", F.lit("unknown")))
    return report.pivot_counts(df, ["year", "month"], "flag", levels.FLAGS)


@query("SELECT coalesce(quality_flag, 'unknown') AS flag, count(*) AS n, count(*) FILTER (is_night) AS at_night, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM idx GROUP BY coalesce(quality_flag, 'unknown')")
def quality_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.flag_shares(index(spark, sf_dir), [])


_COVER = "count(*) AS indexed, count(*) FILTER (downloaded) AS downloaded, count(patchcore_score) AS scored, count(*) FILTER (quality_flag = 'usable') AS usable, round(100 * count(*) FILTER (downloaded) / count(*), 6) AS downloaded_percent, round(100 * count(patchcore_score) / count(*), 6) AS scored_percent"


@query(f"SELECT year, {_COVER} FROM idx GROUP BY year")
def coverage_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.coverage(index(spark, sf_dir), ["year"])


@query(f"SELECT {_COVER} FROM idx")
def coverage_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.coverage(index(spark, sf_dir), [])


@query("SELECT unnest(['downloaded', 'graded', 'scored']) AS phase, unnest([round(100 * count(*) FILTER (downloaded) / count(*), 6), round(100 * count(quality_flag) / count(*), 6), round(100 * count(patchcore_score) / count(*), 6)]) AS percent FROM idx")
def pipeline_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: r6(100 * F.count_if(c) / _n())
    one = index(spark, sf_dir).agg(share(F.col("downloaded")).alias("downloaded"), share(F.col("quality_flag").isNotNull()).alias("graded"), share(F.col("patchcore_score").isNotNull()).alias("scored"))
    return one.unpivot([], ["downloaded", "graded", "scored"], "phase", "percent")


for _by in ("year", "month", "hour", "camera"):

    def _counts(spark: SparkSession, sf_dir: str, by: str = _by) -> DataFrame:
        return index(spark, sf_dir).groupBy(by).agg(_n().alias("n"))

    _counts.__name__ = f"counts_by_{_by}"
    query(f"SELECT {_by}, count(*) AS n FROM idx GROUP BY {_by}")(_counts)


@query("SELECT hour, " + ", ".join(f'round(avg(patchcore_score) FILTER (day = {d}), 6) AS "{d}"' for d in range(1, 32)) + " FROM idx GROUP BY hour")
def day_hour_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pivot_counts(index(spark, sf_dir), ["hour"], "day", list(range(1, 32)), r6(F.avg("patchcore_score")))


@query("SELECT year, " + ", ".join(f'count(*) FILTER (month = {m}) AS "{m}"' for m in range(1, 13)) + " FROM idx GROUP BY year")
def calendar_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pivot_counts(index(spark, sf_dir), ["year"], "month", list(range(1, 13)))


@query(CLASSED_SQL + " SELECT camera, " + ", ".join(f"count(*) FILTER (class = '{c}') AS {c}" for c in ("pyroclastique", "lave", "nuage", "normal")) + " FROM cl GROUP BY camera")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir).withColumn("class", levels.heuristic_class())
    return report.pivot_counts(df, ["camera"], "class", ["pyroclastique", "lave", "nuage", "normal"])


_STATS = "count(patchcore_score) AS n, round(avg(patchcore_score), 6) AS mean, round(stddev_samp(patchcore_score), 6) AS std, min(patchcore_score) AS min, max(patchcore_score) AS max, " + ", ".join(f"round(quantile_cont(patchcore_score, {q}), 6) AS {n}" for n, q in report.QUARTILES.items())


@query(f"SELECT camera, {_STATS} FROM idx GROUP BY camera")
def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.score_stats(index(spark, sf_dir), "patchcore_score", ["camera"])


@query("SELECT year, round(avg(patchcore_score), 6) AS mean, max(patchcore_score) AS max, round(stddev_samp(patchcore_score), 6) AS std FROM idx GROUP BY year")
def score_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.score_stats(index(spark, sf_dir), "patchcore_score", ["year"], {}).select("year", "mean", "max", "std")


@query("SELECT camera, make_date(year, month, 1) AS month_start, round(avg(patchcore_score), 6) AS mean, max(patchcore_score) AS max, count(*) AS n FROM idx WHERE patchcore_score IS NOT NULL GROUP BY ALL")
def monthly_score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir).filter("patchcore_score is not null")
    return df.groupBy("camera", F.make_date("year", "month", F.lit(1)).alias("month_start")).agg(r6(F.avg("patchcore_score")).alias("mean"), F.max("patchcore_score").alias("max"), _n().alias("n"))


_BINS = {"D": "d", "W": "(date_trunc('week', d) + INTERVAL 6 DAY)::DATE", "ME": "last_day(d)"}
_TL = ", t AS (SELECT *, make_date(year, month, day) AS d FROM idx WHERE patchcore_score IS NOT NULL)"


@query(_TL + " " + " UNION ALL ".join(f"SELECT '{k}' AS rule, {e} AS bin, round(avg(patchcore_score), 6) AS mean_score, max(patchcore_score) AS max_score, count(*) AS n_images FROM t GROUP BY ALL" for k, e in _BINS.items()))
def timeline_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, out = index(spark, sf_dir), None
    for rule in _BINS:
        part = report.timeline(df, "patchcore_score", rule).select(F.lit(rule).alias("rule"), "bin", r6("mean_score").alias("mean_score"), "max_score", "n_images")
        out = part if out is None else out.union(part)
    return out


_WEEKS = _TL + f", u AS (SELECT * FROM t WHERE quality_flag = 'usable'), w AS (SELECT camera, {_BINS['W']} AS bin, avg(patchcore_score) AS mean_score, max(patchcore_score) AS max_score, count(*) AS n_images FROM u GROUP BY ALL HAVING count(*) >= 2)"


@query(_WEEKS + ", p AS (SELECT quantile_cont(patchcore_score, 0.9) AS p90 FROM u) SELECT camera, bin, round(mean_score, 6) AS mean_score, max_score, n_images, round(stddev_samp(mean_score) OVER (PARTITION BY camera ORDER BY bin ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS band, round(p90, 6) AS p90 FROM w, p")
def weekly_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of the usable images: mean, highest, band and the 90th percentile of all."""
    df = index(spark, sf_dir).filter("quality_flag = 'usable'")
    weeks = report.rolling_std(report.timeline(df, "patchcore_score", "W", ["camera"]).filter("n_images >= 2"), ["camera"], "bin", "mean_score")
    line = quantiles(df, "patchcore_score", [], {"p90": 0.9}).select(r6("p90").alias("p90"))
    return weeks.join(F.broadcast(line)).withColumns({"mean_score": r6("mean_score"), "band": r6("band")})


@query(_WEEKS + " SELECT camera, bin, round(stddev_samp(mean_score) OVER (PARTITION BY camera ORDER BY bin ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS band FROM w")
def rolling_std4(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = report.timeline(index(spark, sf_dir).filter("quality_flag = 'usable'"), "patchcore_score", "W", ["camera"]).filter("n_images >= 2")
    return report.rolling_std(weeks, ["camera"], "bin", "mean_score").select("camera", "bin", r6("band").alias("band"))


@query("SELECT count(patchcore_score) AS n, round(avg(patchcore_score), 6) AS mean, max(patchcore_score) AS max, round(100 * count(*) FILTER (patchcore_score > 49.975) / count(patchcore_score), 6) AS above_percent FROM idx")
def kpi_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("patchcore_score")
    return index(spark, sf_dir).agg(F.count(s).alias("n"), r6(F.avg(s)).alias("mean"), F.max(s).alias("max"), r6(100 * F.count_if(s > 49.975) / F.count(s)).alias("above_percent"))


_PROFILED = ["file_size_bytes", "anomaly_score", "patchcore_score", "mean_brightness"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM idx" for c in _PROFILED))
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.profile(index(spark, sf_dir), _PROFILED).withColumns({"mean": r6("mean"), "std": r6("std")})


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM idx" for c in _PROFILED))
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.profile(index(spark, sf_dir), _PROFILED).select("column", "missing")


@query("SELECT count(*) AS names, coalesce(sum(n - 1), 0)::BIGINT AS extra_rows FROM (SELECT filename, count(*) AS n FROM idx GROUP BY filename HAVING count(*) > 1)")
def duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = index(spark, sf_dir).groupBy("filename").agg(_n().alias("n")).filter("n > 1")
    return twice.agg(_n().alias("names"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


@query("SELECT 640 + 320 * (image_id % 3) AS width, 480 + 240 * (image_id % 2) AS height, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM idx GROUP BY ALL")
def resolution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("image_id")
    df = index(spark, sf_dir).select(F.struct((640 + 320 * (i % 3)).alias("width"), (480 + 240 * (i % 2)).alias("height")).alias("size"))
    return report.class_shares(df, "size").select("size.width", "size.height", "n", "percent")


@query("SELECT camera, round(avg(n), 6) AS mean_per_day FROM (SELECT camera, year, month, day, count(*) AS n FROM idx GROUP BY ALL) GROUP BY camera")
def daily_mean_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).groupBy("camera", "year", "month", "day").agg(_n().alias("n")).groupBy("camera").agg(r6(F.avg("n")).alias("mean_per_day"))


@query("SELECT year, string_agg(DISTINCT camera, ',' ORDER BY camera) AS cameras FROM idx GROUP BY year")
def cameras_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).groupBy("year").agg(F.array_join(F.sort_array(F.collect_set("camera")), ",").alias("cameras"))


@query("SELECT hour, round(avg(mean_brightness), 6) AS brightness, round(stddev_samp(mean_brightness), 6) AS brightness_std, round(avg(variance), 6) AS variance FROM idx GROUP BY hour")
def diurnal_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).groupBy("hour").agg(r6(F.avg("mean_brightness")).alias("brightness"), r6(F.stddev_samp("mean_brightness")).alias("brightness_std"), r6(F.avg("variance")).alias("variance"))


_HIST = ", e AS (SELECT min(patchcore_score) AS lo, max(patchcore_score) AS hi FROM idx{w}), h AS (SELECT {g}least(floor((patchcore_score - lo) / ((hi - lo) / {n})), {n} - 1)::INT AS bin, (hi - lo) / {n} AS width, count(*) AS n FROM idx, e WHERE patchcore_score IS NOT NULL{a} GROUP BY ALL) SELECT {g}bin, n, round(n / (sum(n) OVER (PARTITION BY {p}) * width), 6) AS density FROM h"


@query(_HIST.format(g="camera, ", n=30, p="camera", w="", a=""))
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.histogram(index(spark, sf_dir), "patchcore_score", 30, ["camera"])


@query(", q AS (SELECT camera, quantile_cont(patchcore_score, 0.25) AS q1, quantile_cont(patchcore_score, 0.5) AS q2, quantile_cont(patchcore_score, 0.75) AS q3 FROM idx GROUP BY camera) SELECT camera, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, min(patchcore_score) AS low, max(patchcore_score) AS high FROM idx JOIN q USING (camera) WHERE patchcore_score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL")
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.box_stats(index(spark, sf_dir), "patchcore_score", ["camera"]).withColumns({q: r6(q) for q in ("q1", "q2", "q3")})


_CORR = ["anomaly_score", "patchcore_score", "mean_brightness", "entropy"]
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i:]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM idx" for a, b in _PAIRS))
def score_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = index(spark, sf_dir).agg(*[r6(F.corr(a, b)).alias(f"c{i}") for i, (a, b) in enumerate(_PAIRS)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(_PAIRS)])))


@query(", c AS (SELECT camera, day, count(*) AS n FROM idx GROUP BY ALL) SELECT camera, arg_min(day, (-n, day)) AS busiest_day FROM c GROUP BY camera")
def mode_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).groupBy("camera").agg(F.mode("day", True).alias("busiest_day"))


@query("SELECT camera, sum(file_size_bytes)::BIGINT AS total, round(avg(file_size_bytes), 6) AS mean, round(stddev_samp(file_size_bytes), 6) AS std, max(file_size_bytes) AS max, quantile_cont(file_size_bytes, 0.5) AS median FROM idx GROUP BY camera")
def file_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = "file_size_bytes"
    return index(spark, sf_dir).groupBy("camera").agg(F.sum(c).alias("total"), r6(F.avg(c)).alias("mean"), r6(F.stddev_samp(c)).alias("std"), F.max(c).alias("max")).join(quantiles(index(spark, sf_dir), c, ["camera"], {"median": 0.5}), "camera", "left")


@query(CLASSED_SQL + " SELECT class, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM cl GROUP BY class")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.class_shares(index(spark, sf_dir).withColumn("class", levels.heuristic_class()), "class")


@query("SELECT camera, unnest(['n', 'mean', 'max']) AS metric, unnest([count(*)::DOUBLE, round(avg(patchcore_score), 6), max(patchcore_score)]) AS value FROM idx GROUP BY camera")
def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = index(spark, sf_dir).groupBy("camera").agg(_n().cast("double").alias("n"), r6(F.avg("patchcore_score")).alias("mean"), F.max("patchcore_score").alias("max"))
    return wide.unpivot(["camera"], ["n", "mean", "max"], "metric", "value")


_HOLES = "CASE WHEN image_id % 5 = 0 THEN NULL WHEN image_id % 5 = 1 THEN 'NaN'::DOUBLE ELSE patchcore_score END"


@query(f", v AS (SELECT camera, {_HOLES} AS v FROM idx) SELECT camera, round(coalesce(sum(v) FILTER (NOT isnan(v)), 0), 4) AS total, round(coalesce(avg(v) FILTER (NOT isnan(v)), 0), 6) AS mean FROM v GROUP BY camera")
def null_safe_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("image_id") % 5 == 0, None).when(F.col("image_id") % 5 == 1, float("nan")).otherwise(F.col("patchcore_score"))
    v = F.nanvl(v, F.lit(None).cast("double"))
    return index(spark, sf_dir).groupBy("camera").agg(rounded(F.coalesce(F.sum(v), F.lit(0.0)), 4).alias("total"), r6(F.coalesce(F.avg(v), F.lit(0.0))).alias("mean"))


@query(f", v AS (SELECT camera, {_HOLES} AS v FROM idx) SELECT camera, round(coalesce(avg(v) FILTER (NOT isnan(v)), 0), 6) AS mean FROM v GROUP BY camera")
def null_safe_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_safe_sum(spark, sf_dir).select("camera", "mean")


@query("SELECT year, month, count(*) AS found, count(*) FILTER (downloaded) AS downloaded, count(*) FILTER (NOT downloaded) AS failed FROM idx GROUP BY ALL")
def scrape_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).groupBy("year", "month").agg(_n().alias("found"), F.count_if("downloaded").alias("downloaded"), F.count_if(~F.col("downloaded")).alias("failed"))


@query(", r AS (SELECT camera, count(*) AS raw FROM idx WHERE downloaded GROUP BY camera), p AS (SELECT camera, count(*) AS processed FROM idx WHERE downloaded AND quality_flag = 'usable' AND camera <> 'kali' GROUP BY camera) SELECT camera, coalesce(raw, 0) AS raw, coalesce(processed, 0) AS processed, coalesce(raw, 0) - coalesce(processed, 0) AS remaining FROM r FULL JOIN p USING (camera)")
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir).filter("downloaded")
    raw = df.groupBy("camera").agg(_n().alias("raw"))
    done = df.filter("quality_flag = 'usable' and camera <> 'kali'").groupBy("camera").agg(_n().alias("processed"))
    both = raw.join(done, "camera", "full_outer").na.fill(0)
    return both.withColumn("remaining", F.col("raw") - F.col("processed"))


@query("SELECT day, count(*) AS n FROM idx GROUP BY day ORDER BY n DESC, day LIMIT 5")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).groupBy("day").agg(_n().alias("n")).orderBy(F.desc("n"), "day").limit(5)


@query(", m AS (SELECT camera, avg(patchcore_score) + 2 * stddev_samp(patchcore_score) AS t FROM idx GROUP BY camera) SELECT image_id, round(t, 6) AS threshold, patchcore_score > t AS is_anomaly, round(patchcore_score - t, 6) AS distance_to_threshold FROM idx JOIN m USING (camera) WHERE patchcore_score IS NOT NULL")
def mu_2sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.mu_2sigma(index(spark, sf_dir).filter("patchcore_score is not null"), "patchcore_score", ["camera"])
    return out.select("image_id", r6("threshold").alias("threshold"), "is_anomaly", r6("distance_to_threshold").alias("distance_to_threshold"))


@query(_TL + ", b AS (SELECT d, avg(patchcore_score) AS m FROM t GROUP BY d), l AS (SELECT avg(m) + 2 * stddev_samp(m) AS line FROM b) SELECT count(*) AS bins, count(*) FILTER (m > line) AS peaks, round(max(m), 6) AS highest, round(any_value(line), 6) AS line FROM b, l")
def activity_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = report.mu_2sigma(report.timeline(index(spark, sf_dir), "patchcore_score", "D"), "mean_score", [])
    return bins.agg(_n().alias("bins"), F.count_if("is_anomaly").alias("peaks"), r6(F.max("mean_score")).alias("highest"), r6(F.max("threshold")).alias("line"))


@query(", l AS (SELECT image_id, unnest(['anomaly_score', 'patchcore_score', 'entropy']) AS series, unnest([anomaly_score, patchcore_score, entropy]) AS v FROM idx), m AS (SELECT series, avg(v) AS mean, avg(v) + 2 * stddev_samp(v) AS line FROM l GROUP BY series) SELECT series, round(mean, 6) AS mean, round(line, 6) AS line, count(*) FILTER (v > line) AS n_above FROM l JOIN m USING (series) GROUP BY ALL")
def series_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["anomaly_score", "patchcore_score", "entropy"]
    long = index(spark, sf_dir).unpivot(["image_id"], names, "series", "v").filter("v is not null")
    out = report.mu_2sigma(long, "v", ["series"])
    return out.groupBy("series").agg(r6(F.avg("v")).alias("mean"), r6(F.max("threshold")).alias("line"), F.count_if("is_anomaly").alias("n_above"))


_ENRICHED = """, g AS (SELECT image_id, filename, local_path, year, month, CASE WHEN image_id % 4 <> 0 THEN day END AS d, CASE WHEN image_id % 6 <> 1 THEN hour END AS h, day, hour, minute, second, CASE WHEN image_id % 3 <> 0 THEN patchcore_score END AS p, anomaly_score FROM idx),
sc AS (SELECT filename, arg_min(patchcore_score, patchcore_score) AS s FROM idx WHERE patchcore_score IS NOT NULL GROUP BY filename), disk AS (SELECT DISTINCT local_path AS path FROM idx WHERE image_id % 7 <> 0)"""


@query(_ENRICHED + " SELECT image_id, day, hour, minute, second, round(coalesce(p, s), 6) AS patchcore_score, round(coalesce(anomaly_score, p, s), 6) AS anomaly_score, path IS NOT NULL AS on_disk FROM g LEFT JOIN sc USING (filename) LEFT JOIN disk ON path = local_path WHERE contains(lower(filename), 'kalor')")
def read_index_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index with gaps, filled from file names and a table of scores, with the files that are there."""
    df, i = index(spark, sf_dir), F.col("image_id")
    scores = df.select("filename", "patchcore_score").filter("patchcore_score is not null")
    files = df.filter(i % 7 != 0).select(F.col("local_path").alias("path")).distinct()
    holes = df.withColumns({"day": F.when(i % 4 != 0, F.col("day")), "hour": F.when(i % 6 != 1, F.col("hour")), "patchcore_score": F.when(i % 3 != 0, F.col("patchcore_score"))})
    out = catalog_files.enriched(holes, scores, files)
    return out.select("image_id", "day", "hour", "minute", "second", r6("patchcore_score").alias("patchcore_score"), r6("anomaly_score").alias("anomaly_score"), "on_disk")
