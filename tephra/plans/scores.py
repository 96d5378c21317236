"""Queries of events, evaluation, nearest-neighbour scores, heatmaps and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, levels
from ..functions.rounding import rounded
from ..operators import evaluate, kernels, models, nearest, report, sample, select
from ..operators.quantiles import quantiles
from ..operators.report import r6
from . import views
from .derived import CLASSED_SQL
from .registry import query
from .views import EVENTS_SQL, FRAMES_SQL, index

_PRE = f""", {EVENTS_SQL}, t AS (SELECT *, make_timestamp(year, month, day, hour, minute, second::DOUBLE) AS at_ FROM idx WHERE patchcore_score IS NOT NULL AND quality_flag = 'usable'), bg AS (SELECT quantile_cont(patchcore_score, 0.5) AS background_score FROM t WHERE hour BETWEEN 6 AND 17),
pre AS (SELECT event_date, event_type, event_intensity, lead_days, count(*) AS n_images, avg(patchcore_score) AS mean_score, quantile_cont(patchcore_score, 0.9) AS q90_score, max(patchcore_score) AS max_score, any_value(background_score) AS background_score, quantile_cont(patchcore_score, 0.9) / any_value(background_score) AS ratio
FROM ev, (SELECT unnest([3, 7, 14]) AS lead_days), t, bg WHERE at_ >= event_date::TIMESTAMP - to_days(lead_days) AND at_ < event_date::TIMESTAMP GROUP BY ALL HAVING count(*) >= 2)"""
_ROUNDED = ("mean_score", "q90_score", "max_score", "background_score", "ratio")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.precursors(index(spark, sf_dir), views.event_catalogue(spark))


@query(_PRE + " SELECT event_date, event_type, event_intensity, lead_days, n_images, " + ", ".join(f"round({c}, 6) AS {c}" for c in _ROUNDED) + ", ratio >= 1.1 AS triggered FROM pre")
def precursor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).withColumns({c: r6(c) for c in _ROUNDED})


@query(_PRE + " SELECT event_date, lead_days, n_images FROM pre")
def precursor_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("event_date", "lead_days", "n_images")


@query(_PRE + " SELECT threshold, lead_days, count(*) AS n_events, count(*) FILTER (ratio >= threshold) AS n_triggers, round(count(*) FILTER (ratio >= threshold) / count(*), 3) AS trigger_rate, round(avg(ratio), 4) AS ratio_mean, round(quantile_cont(ratio, 0.5), 4) AS ratio_median, round(max(ratio), 4) AS ratio_max FROM pre, (SELECT unnest([1.0, 1.1, 1.2, 1.3, 1.4, 1.5])::DOUBLE AS threshold) GROUP BY ALL")
def threshold_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.threshold_analysis(found(spark, sf_dir))
    return out.withColumns({c: rounded(c, 3 if c == "trigger_rate" else 4) for c in ("trigger_rate", "ratio_mean", "ratio_median", "ratio_max")})


_RUNS = """, e AS (SELECT avg(q90_score) AS q, count(*) AS k FROM pre WHERE lead_days = 7), r AS (SELECT patchcore_score AS s, row_number() OVER (ORDER BY (image_id * 2654435761 + 42) % 4294967296, image_id) - 1 AS at_ FROM idx WHERE patchcore_score IS NOT NULL AND quality_flag = 'usable'), n AS (SELECT count(*) AS n FROM r),
sides AS (SELECT n, a, (a - n % a) % a AS over, (n + (a - n % a) % a) // a AS b FROM (SELECT n, unnest(range(floor(sqrt(n))::BIGINT, floor(sqrt(n))::BIGINT + least(1000, floor(sqrt(n))::BIGINT + 1))) AS a FROM n) ORDER BY over, a LIMIT 1),
d0 AS (SELECT run, j, n, k, a, b, j % a AS x, j // a AS y FROM (SELECT unnest(range(1000)) AS run), (SELECT unnest(range(least(n, k * 14) + over)) AS j FROM sides, e), sides, e),
""" + "".join(f"""h{i} AS (SELECT *, ({of} * 2654435761 + ((run * 6 + {i + 1}) * 2246822519 % 4294967296 * 1540483477 >> 16) % 4294967296) % 4294967296 AS h FROM d{i}),
d{i + 1} AS (SELECT run, j, n, k, a, b, {other}, ({to} + (((h * 1540483477 >> 16) % 4294967296 * 1540483477 >> 16) % 4294967296 >> 6)) % {size} AS {to} FROM h{i}),
""" for i, (to, of, size, other) in enumerate([("x", "y", "a", "y"), ("y", "x", "b", "x")] * 3)) + """d AS (SELECT run, y * a + x AS at_ FROM d6 WHERE y * a + x < n QUALIFY row_number() OVER (PARTITION BY run ORDER BY j) <= least(any_value(n) OVER (), any_value(k) OVER () * 14)),
m AS (SELECT run, avg(s) AS mean FROM d JOIN r USING (at_) GROUP BY run)"""


@query(_PRE + _RUNS + " SELECT 7::INT AS lead_days, count(*)::INT AS n_permutations, round(any_value(q), 6) AS observed_mean, round(avg(mean), 6) AS null_mean, round(stddev_pop(mean), 6) AS null_std, round(count(*) FILTER (mean >= q) / count(*), 6) AS p_value, count(*) FILTER (mean >= q) / count(*) < 0.05 AS significant FROM m, e")
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.permutation_test(index(spark, sf_dir), found(spark, sf_dir))
    return out.withColumns({c: r6(c) for c in ("observed_mean", "null_mean", "null_std", "p_value")})


_PROXY = ", y AS (SELECT camera, patchcore_score AS s, anomaly_score AS s2, CASE WHEN quality_flag = 'dark' THEN 1 ELSE 0 END AS y FROM idx WHERE patchcore_score IS NOT NULL AND (quality_flag = 'dark' OR (quality_flag = 'usable' AND hour BETWEEN 6 AND 17)))"
_AP = "{n} AS (SELECT {g}s, count(*) FILTER (y = 1) AS p, count(*) AS n FROM {t} WHERE s IS NOT NULL GROUP BY ALL), {n}c AS (SELECT {g}s, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS a, sum(p) OVER (PARTITION BY {k}) AS np, sum(n) OVER (PARTITION BY {k}) AS nn FROM {n} WINDOW w AS (PARTITION BY {k} ORDER BY s DESC))"


def proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.proxy_labels(index(spark, sf_dir), "patchcore_score")


@query(_PROXY + ", " + _AP.format(n="a", g="camera, ", t="y", k="camera") + " SELECT camera, round(sum(p / np * tp / a), 6) AS auc_pr, round(any_value(np / nn), 6) AS prevalence FROM ac GROUP BY camera")
def auc_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ranked_stats(proxies(spark, sf_dir), "patchcore_score", "y_true", ["camera"]).select("camera", r6("auc_pr").alias("auc_pr"), r6("prevalence").alias("prevalence"))


@query(_PROXY + ", " + _AP.format(n="a", g="camera, ", t="y", k="camera") + " SELECT camera, s AS threshold, round(tp / a, 6) AS precision, round(tp / np, 6) AS recall FROM ac")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pr_curve(proxies(spark, sf_dir), "patchcore_score", "y_true", ["camera"]).withColumns({"precision": r6("precision"), "recall": r6("recall")})


_U = ", u AS (SELECT camera, sum(CASE WHEN a.s > b.s THEN 1 WHEN a.s = b.s THEN 0.5 ELSE 0 END)::DOUBLE AS u, count(*) AS m FROM (SELECT * FROM y WHERE y = 1) a JOIN (SELECT camera, s FROM y WHERE y = 0) b USING (camera) GROUP BY camera)"


@query(_PROXY + _U + " SELECT camera, round(u / m, 6) AS auc_roc FROM u")
def auc_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ranked_stats(proxies(spark, sf_dir), "patchcore_score", "y_true", ["camera"]).select("camera", r6("auc_roc").alias("auc_roc"))


@query(_PROXY + _U.replace("SELECT camera, sum", "SELECT sum").replace(" JOIN (SELECT camera, s FROM y WHERE y = 0) b USING (camera) GROUP BY camera", ", (SELECT s FROM y WHERE y = 0) b") + " SELECT u, round(2 * u / m - 1, 6) AS effect_size, (SELECT count(*) FILTER (y = 1) FROM y) AS n_pos, (SELECT count(*) FILTER (y = 0) FROM y) AS n_neg FROM u")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.mann_whitney(proxies(spark, sf_dir), "patchcore_score", "y_true")
    return out.select("u", r6("effect_size").alias("effect_size"), "n_pos", "n_neg")


_TIES = "tie AS (SELECT sum(n::DOUBLE ** 3 - n) AS ties FROM (SELECT count(*) AS n FROM y GROUP BY s)), mw AS (SELECT u, n1, n2, (u - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u, tie, (SELECT count(*) FILTER (y = 1)::DOUBLE AS n1, count(*) FILTER (y = 0)::DOUBLE AS n2 FROM y))"
#: The upper tail of the normal distribution by Simpson's rule, from z to z + 12 in 6,000 steps.
_TAIL = "(SELECT sum(CASE WHEN k IN (0, 6000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-((z + k * 0.002) ** 2) / 2)) * 0.002 / 3 / sqrt(2 * pi()) FROM range(6001) AS r(k), mw)"
_ALL_U = _U.replace("SELECT camera, sum", "SELECT sum").replace(" JOIN (SELECT camera, s FROM y WHERE y = 0) b USING (camera) GROUP BY camera", ", (SELECT s FROM y WHERE y = 0) b")


@query(_PROXY + _ALL_U + f", {_TIES} SELECT u, round({_TAIL}, 8) AS p_value, round(2 * u / (n1 * n2) - 1, 6) AS effect_size FROM mw")
def mann_whitney_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The p value, which needs the error function."""
    return evaluate.mann_whitney(proxies(spark, sf_dir), "patchcore_score", "y_true").select("u", rounded("p_value", 8).alias("p_value"), r6("effect_size").alias("effect_size"))


_CELLS = "count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn"
_F1 = "round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_{a}, round(coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0), 6) AS f1_{b}, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS f1_macro, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy"


_P90 = "y AS (SELECT patchcore_score AS s, (quality_flag = 'dark')::INT AS y FROM idx WHERE patchcore_score IS NOT NULL AND quality_flag IN ('dark', 'usable'))"


def p90_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark against usable images of all hours, called dark above the 90th percentile of their scores."""
    df = index(spark, sf_dir).filter("patchcore_score is not null and quality_flag in ('dark', 'usable')").withColumn("y", (F.col("quality_flag") == "dark").cast("int"))
    line = quantiles(df, "patchcore_score", [], {"p90": 0.9})
    return evaluate.binary_scores(df.join(F.broadcast(line)).withColumn("p", (F.col("patchcore_score") > F.col("p90")).cast("int")), "y", "p")


@query(f", {_P90}, q AS (SELECT quantile_cont(s, 0.9) AS p90 FROM y), c AS (SELECT {_CELLS} FROM (SELECT y, (s > p90)::INT AS p FROM y, q)) SELECT tp, fp, fn, tn, {_F1.format(a='positive', b='negative')} FROM c")
def binary_f1_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p90_scores(spark, sf_dir).withColumns({c: r6(c) for c in ("f1_positive", "f1_negative", "f1_macro", "accuracy")})


@query(f", y AS (SELECT CASE quality_flag WHEN 'dark' THEN 1 WHEN 'cloudy' THEN 0 END AS y, predicted AS p FROM idx), c AS (SELECT {_CELLS} FROM y) SELECT {_F1.format(a='volcanic', b='weather')} FROM c")
def triage_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir).withColumn("filename", F.col("image_id").cast("string"))
    out = evaluate.triage_f1(df, df.select("filename", F.col("predicted").alias("weather_label")))
    return out.select(*[r6(c).alias(c) for c in ("f1_volcanic", "f1_weather", "f1_macro", "accuracy")])


@query(_PROXY + ", z AS (SELECT s2 AS s, y FROM y WHERE s2 IS NOT NULL), " + _AP.format(n="a", g="", t="y", k="1") + ", " + _AP.format(n="b", g="", t="z", k="1") + ", r AS (SELECT (SELECT sum(p / np * tp / a) FROM ac) AS first, (SELECT sum(p / np * tp / a) FROM bc) AS second) SELECT round(first, 6) AS auc_pr_first, round(second, 6) AS auc_pr_second, round(second - first, 6) AS delta, round(100 * (second - first) / first, 4) AS percent FROM r")
def compare_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = proxies(spark, sf_dir)
    long = df.unpivot(["image_id", "y_true"], ["patchcore_score", "anomaly_score"], "detector", "score")
    by = evaluate.ranked_stats(long, "score", "y_true", ["detector"])
    one = by.agg(F.max(F.when(F.col("detector") == "patchcore_score", F.col("auc_pr"))).alias("a"), F.max(F.when(F.col("detector") == "anomaly_score", F.col("auc_pr"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return one.select(r6(a).alias("auc_pr_first"), r6(b).alias("auc_pr_second"), r6(b - a).alias("delta"), rounded(F.try_divide(100 * (b - a), a), 4).alias("percent"))


@query(" SELECT quality, toxic, n, round(n / sum(n) OVER (PARTITION BY quality), 6) AS share FROM c", "c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic)")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", "toxic").withColumn("share", r6("share"))


@query(_PROXY + ", e AS (SELECT min(s) AS lo, max(s) AS hi FROM y), h AS (SELECT y, least(floor((s - lo) / ((hi - lo) / 40)), 39)::INT AS bin, (hi - lo) / 40 AS w, count(*) AS n FROM y, e GROUP BY ALL), m AS (SELECT y, quantile_cont(s, 0.5) AS median FROM y GROUP BY y) SELECT y AS y_true, bin, n, round(n / (sum(n) OVER (PARTITION BY y) * w), 6) AS density, round(median, 6) AS median FROM h JOIN m USING (y)")
def score_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = proxies(spark, sf_dir)
    middle = quantiles(df, "patchcore_score", ["y_true"], {"median": 0.5}).withColumn("median", r6("median"))
    return report.histogram(df, "patchcore_score", 40, ["y_true"]).join(middle, "y_true")


_REPORT = (
    _PROXY + ", " + _AP.format(n="a", g="", t="y", k="1") + _ALL_U + ", " + _TIES + f", b {_P90[2:]}, c AS (SELECT {_CELLS} FROM (SELECT y, (s > p90)::INT AS p FROM b, (SELECT quantile_cont(s, 0.9) AS p90 FROM b))), f AS (SELECT {_F1.format(a='anomaly', b='normal')} FROM c)"
    f", g AS (SELECT {_CELLS} FROM (SELECT CASE quality_flag WHEN 'dark' THEN 1 WHEN 'cloudy' THEN 0 END AS y, predicted AS p FROM idx)), h AS (SELECT {_F1.format(a='volcanic', b='weather')} FROM g), r AS (SELECT (SELECT sum(p / np * tp / a) FROM ac) AS ap, (SELECT count(*) FILTER (y = 1) / count(*) FROM y) AS prevalence)"
)


@query(_REPORT + f" SELECT round(prevalence, 6) AS auc_pr_baseline, round(ap, 6) AS auc_pr_patchcore, round(u / (n1 * n2), 6) AS auc_roc_patchcore, round(ap - prevalence, 6) AS delta_auc_pr, round(100 * (ap - prevalence) / prevalence, 4) AS improvement_pct, f.f1_macro AS f1_macro_evaluate, f1_anomaly, f1_normal, h.f1_macro AS f1_macro_triage, f1_volcanic, f1_weather, round({_TAIL}, 8) AS mann_whitney_p, round(2 * u / (n1 * n2) - 1, 6) AS effect_size, (SELECT count(*) FROM idx WHERE quality_flag = 'usable' AND year BETWEEN 2014 AND 2017) AS n_train, (SELECT count(*) FROM idx WHERE year = 2018 AND patchcore_score IS NOT NULL) AS n_test, n1::BIGINT AS n_positive_proxy FROM mw, r, f, h")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of the 16 figures of the report."""
    df = index(spark, sf_dir)
    ranked = evaluate.ranked_stats(proxies(spark, sf_dir), "patchcore_score", "y_true")
    signal = evaluate.mann_whitney(proxies(spark, sf_dir), "patchcore_score", "y_true").select("p_value", "effect_size")
    binary = p90_scores(spark, sf_dir).select(F.col("f1_macro").alias("f1_macro_evaluate"), F.col("f1_positive").alias("f1_anomaly"), F.col("f1_negative").alias("f1_normal"))
    named = df.withColumn("filename", F.col("image_id").cast("string"))
    triage = evaluate.triage_f1(named, named.select("filename", F.col("predicted").alias("weather_label"))).select(F.col("f1_macro").alias("f1_macro_triage"), "f1_volcanic", "f1_weather")
    counts = df.agg(F.count_if((F.col("quality_flag") == "usable") & F.col("year").between(2014, 2017)).alias("n_train"), F.count_if((F.col("year") == 2018) & F.col("patchcore_score").isNotNull()).alias("n_test"))
    return evaluate.report(ranked, signal, binary, triage, counts)


_ADVICE = "CASE WHEN turned > plain AND turned > prevalence THEN 'invert' WHEN turned > plain THEN 'unsuited labels' ELSE 'keep' END"


@query(_PROXY + ", v AS (SELECT -s AS s, y FROM y), " + _AP.format(n="a", g="", t="y", k="1") + ", " + _AP.format(n="b", g="", t="v", k="1") + _U.replace("SELECT camera, sum", "SELECT sum").replace(" JOIN (SELECT camera, s FROM y WHERE y = 0) b USING (camera) GROUP BY camera", ", (SELECT s FROM y WHERE y = 0) b") + f", r AS (SELECT (SELECT sum(p / np * tp / a) FROM ac) AS plain, (SELECT sum(p / np * tp / a) FROM bc) AS turned, (SELECT count(*) FILTER (y = 1) / count(*) FROM y) AS prevalence) SELECT round(u / m, 6) AS auc_roc, round(1 - u / m, 6) AS auc_roc_inverted, u / m < 0.5 AS invert, round(plain, 6) AS auc_pr, round(turned, 6) AS auc_pr_inverted, round(prevalence, 6) AS prevalence, plain > prevalence AS above_random, turned > prevalence AS above_random_inverted, {_ADVICE} AS advice FROM u, r")
def score_inversion_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both areas of the score and of its inverse, and which of the two to use."""
    return evaluate.inversion(proxies(spark, sf_dir), "patchcore_score", "y_true")


@query(_PROXY + " SELECT y AS y_true, count(*) AS n, " + ", ".join(f"round({f}, 6) AS {n}" for n, f in {"mean": "avg(s)", "median": "quantile_cont(s, 0.5)", "std": "stddev_samp(s)", "min": "min(s)", "max": "max(s)", "p10": "quantile_cont(s, 0.1)", "p90": "quantile_cont(s, 0.9)"}.items()) + " FROM y GROUP BY y")
def score_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of each class in figures."""
    df, s = proxies(spark, sf_dir).filter("patchcore_score is not null"), F.col("patchcore_score")
    middle = quantiles(df, "patchcore_score", ["y_true"], {"median": 0.5, "p10": 0.1, "p90": 0.9})
    out = df.groupBy("y_true").agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max")).join(middle, "y_true")
    return out.select("y_true", "n", *[r6(c).alias(c) for c in ("mean", "median", "std", "min", "max", "p10", "p90")])


@query(_PROXY + ", z AS (SELECT s2 AS s, y FROM y WHERE s2 IS NOT NULL), " + _AP.format(n="a", g="", t="y", k="1") + ", " + _AP.format(n="b", g="", t="z", k="1") + " SELECT 'patchcore_score' AS detector, s AS threshold, round(tp / a, 6) AS precision, round(tp / np, 6) AS recall FROM ac UNION ALL SELECT 'anomaly_score', s, round(tp / a, 6), round(tp / np, 6) FROM bc UNION ALL SELECT 'random', NULL, round((SELECT count(*) FILTER (y = 1) / count(*) FROM y), 6), unnest([0.0, 1.0])::DOUBLE")
def pr_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curves of several detectors, and the line of a random one."""
    return evaluate.pr_curves(proxies(spark, sf_dir), ["patchcore_score", "anomaly_score"], "y_true").withColumns({"precision": r6("precision"), "recall": r6("recall")})


@query("SELECT count(patchcore_score) AS scored, count(patchcore_score) FILTER (year = 2018) AS scored_test, count(patchcore_score) FILTER (quality_flag = 'dark') AS scored_dark FROM idx")
def pre_eval_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("patchcore_score").isNotNull()
    return index(spark, sf_dir).agg(F.count_if(s).alias("scored"), F.count_if(s & (F.col("year") == 2018)).alias("scored_test"), F.count_if(s & (F.col("quality_flag") == "dark")).alias("scored_dark"))


_HEAT = """, g AS (SELECT camera, r, c, exp(-((r / 15 - 0.4) ** 2 + (c / 15 - 0.5) ** 2) / (2 * 0.25 ** 2)) AS w1, exp(-((sqrt((r / 15 - 0.5) ** 2 + (c / 15 - 0.5) ** 2) - 0.3) ** 2) / (2 * 0.15 ** 2)) AS w2, exp(-((r / 15 - 0.75) ** 2) / (2 * 0.2 ** 2)) AS w3
FROM (SELECT DISTINCT camera FROM idx), (SELECT unnest(range(16)) AS r), (SELECT unnest(range(16)) AS c)), h AS (SELECT camera, r, c, avg(x) AS mean, sum(x) AS "sum", max(x) AS "max" FROM (SELECT camera, r, c, patchcore_score * (w1 * (0.4 + 0.6 * thermal_gradient) + w2 * edge_density + w3 * (bright_zone_area + bright_pixel_ratio) + 0.1) AS x FROM g JOIN idx USING (camera) WHERE patchcore_score IS NOT NULL AND patchcore_score <> 0) GROUP BY ALL)"""


@query(_HEAT + " SELECT camera, r::INT AS row, c::INT AS col, " + ", ".join(f'round("{k}" / max("{k}") OVER (PARTITION BY camera), 6) AS "{k}"' for k in ("mean", "sum", "max")) + " FROM h")
def activity_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir)
    both = nearest.heatmap(df, "patchcore_score", ["camera"]).join(nearest.heatmap_max(df, "patchcore_score", ["camera"]), ["camera", "row", "col"])
    return both.withColumns({c: r6(c) for c in ("mean", "sum", "max")})


@query("SELECT image_id, round(quantile_cont(v, 0.9), 6) AS activity FROM px GROUP BY image_id", FRAMES_SQL)
def activity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.frame_stats(views.frames(spark, sf_dir), ["image_id"]).select("image_id", r6("p90").alias("activity"))


_REACH = """on_ AS (SELECT image_id, y * 8 + x AS p, x, y, v FROM px WHERE v >= 0.6), ed AS (SELECT a.image_id, a.p AS a, b.p AS b FROM on_ a JOIN on_ b ON a.image_id = b.image_id AND abs(a.x - b.x) + abs(a.y - b.y) <= 1),
rc AS (SELECT image_id, a AS p, b AS l FROM ed UNION SELECT r.image_id, e.a, r.l FROM rc r JOIN ed e ON e.image_id = r.image_id AND e.b = r.p), lb AS (SELECT image_id, p, min(l) AS l FROM rc GROUP BY ALL)"""


@query(f", {_REACH} SELECT image_id, round(avg(y), 6) AS centroid_row, round(avg(x), 6) AS centroid_col, round(avg(v), 6) AS score, count(*)::INT AS size, min(y)::INT AS row_min, max(y)::INT AS row_max, min(x)::INT AS col_min, max(x)::INT AS col_max, row_number() OVER (PARTITION BY image_id ORDER BY avg(v) DESC)::INT AS rank FROM on_ JOIN lb USING (image_id, p) GROUP BY image_id, l HAVING count(*) >= 2", "RECURSIVE " + FRAMES_SQL)
def active_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = views.pixels(spark, sf_dir).select("image_id", F.col("y").alias("row"), F.col("x").alias("col"), F.col("v").alias("value"))
    return nearest.clusters(grid, "image_id", 0.6).withColumns({c: r6(c) for c in ("centroid_row", "centroid_col", "score")})


_BANK = "bank AS (SELECT embedding AS e FROM (SELECT embedding, row_number() OVER (ORDER BY (vec_id * 2654435761 + 42) % 4294967296, vec_id) AS r, count(*) OVER () AS n FROM embeddings WHERE label = 0) WHERE r <= least(n, greatest(500, floor(0.15 * n)))), nn AS (SELECT vec_id, vec_id // 16 AS image_id, (vec_id % 16)::INT AS patch_id, min(list_distance(embedding::DOUBLE[], e::DOUBLE[])) AS d FROM embeddings, bank GROUP BY vec_id)"


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all patches to the memory bank of the normal ones."""
    p = views.patches(spark, sf_dir)
    bank = sample.coreset(nearest.usable(p.filter("label = 0")).withColumn("vec_id", F.col("image_id") * 16 + F.col("patch_id")), "vec_id").select("features")
    return nearest.distances(p, bank, ["image_id", "patch_id"], 64)


@query(" SELECT image_id, patch_id, round(d, 5) + 0.0 AS distance FROM nn", _BANK)
def nn_distance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir).withColumn("distance", rounded("distance", 5) + 0.0)


@query(" SELECT image_id, round(max(d), 5) AS score FROM nn GROUP BY image_id", _BANK)
def patchcore_score_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir).groupBy("image_id").agg(rounded(F.max("distance"), 5).alias("score"))


@query()
def nn_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distances again by random projections, never below the exact ones."""
    p = views.patches(spark, sf_dir)
    bank = sample.coreset(nearest.usable(p.filter("label = 0")).withColumn("vec_id", F.col("image_id") * 16 + F.col("patch_id")), "vec_id").select("features")
    return nearest.probed(p, bank, ["image_id", "patch_id"], 64).withColumn("distance", rounded("distance", 5) + 0.0)


@query()
def coreset_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory bank by farthest-first selection among the normal patches."""
    p = nearest.usable(views.patches(spark, sf_dir).filter("label = 0")).select((F.col("image_id") * 16 + F.col("patch_id")).alias("vec_id"), "features")
    return nearest.greedy_coreset(p, "vec_id").select("vec_id")


_SPLIT = "m AS (SELECT DISTINCT vec_id // 16 AS image_id, 2014 + (vec_id // 16 % 6)::INT AS year, CASE (vec_id // 16) % 7 WHEN 0 THEN NULL WHEN 1 THEN 'dark' WHEN 2 THEN 'cloudy' ELSE 'usable' END AS quality_flag, (vec_id // 16) / 100 AS old FROM embeddings)"


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of the patches with a year, a flag and an earlier score."""
    ids = views.patches(spark, sf_dir).select("image_id").distinct()
    k = F.col("image_id") % 7
    return ids.withColumns({"year": (2014 + F.col("image_id") % 6).cast("int"), "quality_flag": F.when(k == 0, None).when(k == 1, "dark").when(k == 2, "cloudy").otherwise("usable"), "old": F.col("image_id") / 100})


@query(f", {_SPLIT}, s AS (SELECT image_id, max(d) AS score FROM nn GROUP BY image_id) SELECT split, image_id, year, round(score, 5) AS score, count(score) OVER (PARTITION BY split, year) AS scored_of_year FROM (SELECT 'test' AS split, m.image_id, year, CASE WHEN year = 2018 AND quality_flag = 'usable' THEN score END AS score FROM m JOIN s USING (image_id) UNION ALL SELECT 'all', m.image_id, year, CASE WHEN quality_flag IN ('usable', 'dark') OR quality_flag IS NULL THEN score END FROM m JOIN s USING (image_id) UNION ALL SELECT 'unfitted', image_id, year, old FROM m)", _BANK)
def patchcore_score_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of both splits, with the scored images of each year, and the earlier scores that
    stand in where nothing was fitted."""
    found = neighbours(spark, sf_dir).groupBy("image_id").agg(F.max("distance").alias("score"))
    return nearest.score_all(archive(spark, sf_dir), found, "old").withColumn("score", rounded("score", 5))


_MAP = ", mp AS (SELECT image_id, patch_id, (d - min(d) OVER w) / nullif(max(d) OVER w - min(d) OVER w, 0) AS norm FROM nn WINDOW w AS (PARTITION BY image_id))"
_LV = "CASE WHEN norm < 0.2 THEN 'Normal 🟢' WHEN norm < 0.4 THEN 'Légère 🟡' WHEN norm < 0.6 THEN 'Modérée 🟠' WHEN norm < 0.8 THEN 'Forte 🔴' ELSE 'Critique ⚠️' END"


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.scaled(neighbours(spark, sf_dir), "distance", "image_id")


@query(_MAP + " SELECT image_id, patch_id, round(coalesce(norm, 0), 4) + 0.0 AS norm FROM mp", _BANK)
def patch_map_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps(spark, sf_dir).select("image_id", "patch_id", (rounded("norm", 4) + 0.0).alias("norm"))


@query(_MAP + f" SELECT image_id, patch_id, (patch_id // 4)::INT AS row, (patch_id % 4)::INT AS col, {_LV} AS level, rank() OVER (PARTITION BY image_id ORDER BY round(norm, 5) DESC) AS rank FROM mp", _BANK)
def patch_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.patch_metadata(maps(spark, sf_dir), 4).drop("score")


@query(_MAP + f" SELECT {_LV} AS level, count(*) AS n FROM mp GROUP BY ALL", _BANK)
def patch_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.patch_metadata(maps(spark, sf_dir), 4).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(_MAP + " SELECT image_id, round(100 * count(*) FILTER (norm > 0.7) / count(*), 4) AS active_percent, round(coalesce(avg(patch_id % 4) FILTER (norm > 0.7) / 4, 0.5), 6) AS centroid_x, round(coalesce(avg(patch_id // 4) FILTER (norm > 0.7) / 4, 0.5), 6) AS centroid_y, count(*) FILTER (norm > 0.7) AS n_active FROM mp GROUP BY image_id", _BANK)
def zone_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nearest.zone_metrics(maps(spark, sf_dir), 4)
    return out.select("image_id", rounded("active_percent", 4).alias("active_percent"), r6("centroid_x").alias("centroid_x"), r6("centroid_y").alias("centroid_y"), "n_active")


@query(", tr AS (SELECT image_id FROM m WHERE year BETWEEN 2014 AND 2017 AND quality_flag = 'usable' ORDER BY (image_id * 2654435761 + 42) % 4294967296, image_id LIMIT 500), u AS (SELECT vec_id, row_number() OVER (ORDER BY (vec_id * 2654435761 + 42) % 4294967296, vec_id) AS r, count(*) OVER () AS n FROM embeddings WHERE vec_id // 16 IN (SELECT image_id FROM tr)) SELECT vec_id FROM u WHERE r <= least(n, greatest(500, floor(0.15 * n)))", _SPLIT)
def patchcore_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory bank of at most 500 usable images of the training years."""
    p = views.patches(spark, sf_dir).withColumn("vec_id", F.col("image_id") * 16 + F.col("patch_id"))
    train = sample.sample_n(archive(spark, sf_dir).filter(F.col("year").between(2014, 2017) & (F.col("quality_flag") == "usable")), "image_id", 500)
    return models.patchcore_fit(p, train, "vec_id").select("vec_id")


@query()
def pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.pca_2d(views.patches(spark, sf_dir), "features", ["image_id", "patch_id"])
    return out.select("image_id", "patch_id", rounded(F.abs("x"), 4).alias("x"), rounded(F.abs("y"), 4).alias("y"), "explained_x", "explained_y")


@query()
def frechet_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.patches(spark, sf_dir).withColumn("side", F.col("label") % 2)
    return models.frechet_distance(p, "features", "side")


FEATURES = ["thermal_gradient", "bright_zone_area", "edge_density", "bright_pixel_ratio", "optical_flow_mag", "texture_roughness", "temporal_change_score", "pixel_diff_mean", "lbp_entropy", "patchcore_score"]


def weather_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir).withColumns(dates.cyclic(F.col("hour"), F.col("month")))
    return models.assembled(df, [*FEATURES, "hour_sin", "hour_cos", "month_sin", "month_cos"]).withColumn("label", levels.label_from_flag(F.col("quality_flag")).cast("double"))


_TRIAGED = "quality_flag in ('usable', 'cloudy', 'dark')"


@query()
def weather_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which classifier wins, and what it predicts for labelled and usable rows."""
    rows = weather_rows(spark, sf_dir)
    model, name, _ = models.weather_fit(rows.filter("label is not null"), "image_id")
    out = models.weather_predict(model, rows.filter(_TRIAGED), ["image_id"])
    return out.select("image_id", "weather_label", rounded("weather_proba", 4).alias("weather_proba"), F.lit(name).alias("model"))


@query()
def weather_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the best model that is not a forest, chosen by cross-validation."""
    rows = weather_rows(spark, sf_dir)
    known = models.balanced(rows.filter("label is not null"), "label")
    candidates = {n: e for n, e in models.weather_candidates(weight="weight").items() if n != "forest"}
    scores = models.competed(known, "image_id", candidates)
    model = models.fit_all(known, "image_id", candidates[max(scores, key=lambda n: scores[n][0])])
    return models.weather_predict(model, rows.filter(_TRIAGED), ["image_id"]).withColumn("weather_proba", rounded("weather_proba", 4))


def _forest(spark: SparkSession, sf_dir: str, trees: int = 200):  # noqa: ANN202
    df = index(spark, sf_dir).withColumn("class", levels.heuristic_class()).withColumn("night", F.col("is_night").cast("double"))
    return df, models.volcano_fit(df, "class", [*FEATURES, "night"], trees)


@query()
def volcano_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, fitted = _forest(spark, sf_dir)
    return models.volcano_predict(fitted, df, [*FEATURES, "night"], ["image_id"])


@query()
def volcano_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the forest agrees with the rules that labelled it."""
    df, fitted = _forest(spark, sf_dir)
    out = models.volcano_predict(fitted, df, [*FEATURES, "night"], ["image_id", "class"])
    return out.groupBy("class", "volcano_class").agg(F.count(F.lit(1)).alias("n"))


@query()
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, fitted = _forest(spark, sf_dir)
    return models.importance(fitted, [*FEATURES, "night"], df)


@query()
def cv_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of macro F1 of every candidate over five stratified folds."""
    known = models.balanced(weather_rows(spark, sf_dir).filter("label is not null"), "label")
    scores = models.competed(known, "image_id", models.weather_candidates(weight="weight"))
    out = spark.createDataFrame([(n, *map(float, x)) for n, x in scores.items()], "model string, mean double, std double")
    return out.select("model", r6("mean").alias("mean"), r6("std").alias("std"))


@query()
def volcano_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability for each of the four classes, 0 for those without a training row."""
    df, fitted = _forest(spark, sf_dir)
    return models.volcano_proba(fitted, df, [*FEATURES, "night"], ["image_id"], levels.CLASSES)


@query(CLASSED_SQL + " SELECT image_id, class, 1.0::DOUBLE AS confidence, " + ", ".join(f"(class = '{c}')::INT::DOUBLE AS p_{c}" for c in ("pyroclastique", "lave", "nuage", "normal")) + " FROM cl")
def classify_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' classes, sure of themselves, as used where no model can be fitted."""
    df = index(spark, sf_dir).withColumn("class", levels.heuristic_class())
    return models.volcano_proba(None, df, [], ["image_id", "class"], levels.CLASSES).select("image_id", "class", F.col("class_confidence").alias("confidence"), *[f"p_{c}" for c in levels.CLASSES])


@query("SELECT 'train' AS split, is_night, count(*) AS n FROM (SELECT is_night, row_number() OVER (PARTITION BY is_night ORDER BY (image_id * 2654435761 + 42) % 4294967296, image_id) AS r, count(*) OVER (PARTITION BY is_night) AS n FROM idx) WHERE r > greatest(1, floor(n * 0.1)) GROUP BY is_night UNION ALL SELECT 'val', is_night, greatest(1, floor(count(*) * 0.1))::BIGINT FROM idx GROUP BY is_night")
def jsonl_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.train_val(index(spark, sf_dir), "is_night", "image_id", 0.1).groupBy("split", "is_night").agg(F.count(F.lit(1)).alias("n"))
