"""Queries of pixel kernels and frame pairs, over vectors read as 8 x 8 frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import levels
from ..functions.rounding import rounded
from ..operators import kernels, pixels, report
from ..operators.report import r6
from . import views
from .registry import query
from .views import FRAMES_SQL, index


def px_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pixels(spark, sf_dir)


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame and the one before it."""
    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"))
    return ids.filter("image_id > 0").withColumn("prev_id", F.col("image_id") - 1)


def with_before(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    """image_id, prev_id, width, pixels, before of pairs(image_id, prev_id, and others); before is null without prev_id."""
    fr = views.frames(spark, sf_dir).select("image_id", "pixels")
    before = fr.select(F.col("image_id").alias("prev_id"), F.col("pixels").alias("before"))
    return pairs.join(fr, "image_id").join(before, "prev_id", "left").withColumn("width", F.lit(8))


def compared(spark: SparkSession, sf_dir: str, similarity: bool = True) -> DataFrame:
    """The scores of every frame against the one before it; frames meet as arrays."""
    return kernels.pair_scores(with_before(spark, sf_dir, pairs_of(spark, sf_dir)), ["image_id"], similarity=similarity)


def stats_of(spark: SparkSession, sf_dir: str, dim: float = 1.0) -> DataFrame:
    """The statistics of every frame by itself, in one pass without a shuffle."""
    return kernels.frame_stats(views.frames(spark, sf_dir), ["image_id"], dim)


_G = "floor(v * 255)"
_BOTH = ", bo AS (SELECT a.image_id, b.image_id AS prev_id, a.x, a.y, a.v, b.v AS w FROM px a JOIN px b ON b.image_id = a.image_id - 1 AND a.x = b.x AND a.y = b.y)"


@query("SELECT image_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(var_pop(v), 6) AS variance, min(v) AS low, max(v) AS high, (max(x) + 1)::INT AS width, (max(y) + 1)::INT AS height FROM px GROUP BY image_id", FRAMES_SQL)
def pixel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_of(spark, sf_dir).select("image_id", *[r6(c).alias(c) for c in ("mean", "std", "variance")], "low", "high", F.lit(8).alias("width"), F.lit(8).alias("height"))


@query(f", c AS (SELECT image_id, {_G} AS g, count(*) AS c FROM px GROUP BY ALL) SELECT image_id, round(-sum(c / 64 * log2(c / 64)), 6) + 0.0 AS entropy FROM c GROUP BY image_id", FRAMES_SQL)
def pixel_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_of(spark, sf_dir).select("image_id", (r6("entropy") + 0.0).alias("entropy"))


@query(f"SELECT image_id, round(avg(CASE WHEN {_G} > 200 THEN 1 ELSE 0 END), 6) AS above_200, round(avg(CASE WHEN {_G} > 180 THEN 1 ELSE 0 END), 6) AS above_180 FROM px GROUP BY image_id", FRAMES_SQL)
def bright_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_of(spark, sf_dir).select("image_id", r6("above_200").alias("above_200"), r6("above_180").alias("above_180"))


@query(f"SELECT image_id, round(avg(CASE WHEN {_G} > 180 THEN 1 ELSE 0 END), 6) AS above_180 FROM px GROUP BY image_id", FRAMES_SQL)
def bright_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_of(spark, sf_dir).select("image_id", r6("above_180").alias("above_180"))


@query("SELECT image_id, round(CASE WHEN avg(v / 4) >= 30 / 255 THEN 0 ELSE avg(CASE WHEN v / 4 > 60 / 255 THEN 1 ELSE 0 END) END, 6) AS night_score FROM px GROUP BY image_id", FRAMES_SQL)
def night_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_of(spark, sf_dir, dim=0.25).select("image_id", r6("night_score").alias("night_score"))


def single(spark: SparkSession, sf_dir: str, scale: str = "reference") -> DataFrame:
    """The features of the frames by themselves."""
    return kernels.features(views.frames(spark, sf_dir).select("image_id", "pixels", F.lit(8).alias("width"), F.lit(None).cast("array<double>").alias("before")), scale)


def _tap(kernel: dict) -> str:
    return " + ".join(f"({w}) * m[{(dy + 1) * 3 + dx + 2}]" for (dx, dy), w in kernel.items())


_NEAR = ", nb AS (SELECT c.image_id, c.x, c.y, list(p.v ORDER BY p.y, p.x) AS m FROM px c JOIN px p ON p.image_id = c.image_id AND p.x BETWEEN c.x - 1 AND c.x + 1 AND p.y BETWEEN c.y - 1 AND c.y + 1 WHERE c.x BETWEEN 1 AND 6 AND c.y BETWEEN 1 AND 6 GROUP BY ALL)"


@query(_NEAR + f" SELECT image_id, round(avg(sqrt(({_tap(pixels.SOBEL['gx'])}) ** 2 + ({_tap(pixels.SOBEL['gy'])}) ** 2)) / 1448, 8) AS thermal_gradient FROM nb GROUP BY image_id", FRAMES_SQL)
def thermal_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir).select("image_id", rounded("thermal_gradient", 8).alias("thermal_gradient"))


@query(_NEAR + f" SELECT image_id, round(stddev_pop({_tap(pixels.LAPLACE['lap'])}) / 255, 8) AS texture_roughness FROM nb GROUP BY image_id", FRAMES_SQL)
def texture_roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir).select("image_id", rounded("texture_roughness", 8).alias("texture_roughness"))


_EDGES = f"g AS (SELECT image_id, x, y, sqrt(({_tap(pixels.DIFFERENCE['gx'])}) ** 2 + ({_tap(pixels.DIFFERENCE['gy'])}) ** 2) / 2 AS m FROM nb), eg AS (SELECT a.image_id, avg(CASE WHEN a.m > 0.1 AND EXISTS (SELECT 1 FROM g b WHERE b.image_id = a.image_id AND abs(a.x - b.x) + abs(a.y - b.y) <= 1 AND b.m > 0.3) THEN 1 ELSE 0 END) AS e FROM g a GROUP BY a.image_id)"


@query(_NEAR + f", {_EDGES} SELECT image_id, round(e, 6) AS edge_density FROM eg", FRAMES_SQL)
def edge_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir, "unit").select("image_id", r6("edge_density").alias("edge_density"))


_MAD = _BOTH + " SELECT image_id, {c} FROM bo GROUP BY image_id"


@query(_MAD.format(c="round(avg(abs(v - w)), 6) AS mad"), FRAMES_SQL)
def mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir, similarity=False).select("image_id", r6("mad").alias("mad"))


@query(_MAD.format(c="round(avg(abs(v - w)), 6) AS pixel_diff"), FRAMES_SQL)
def pixel_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir, similarity=False).select("image_id", r6("mad").alias("pixel_diff"))


@query(_MAD.format(c="round(avg(abs(v - w)) / (1 + stddev_pop(w) + 1e-6), 6) AS temporal_change"), FRAMES_SQL)
def temporal_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir, similarity=False).select("image_id", r6("temporal_change").alias("temporal_change"))


@query(_MAD.format(c="round(100 * avg(abs(v - w)), 4) AS mean_percent, round(100 * max(abs(v - w)), 4) AS max_percent, round(100 * quantile_cont(abs(v - w), 0.95), 4) AS p95_percent"), FRAMES_SQL)
def recon_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = compared(spark, sf_dir, similarity=False)
    return d.select("image_id", *[rounded(100 * F.col(c), 4).alias(n) for c, n in (("mad", "mean_percent"), ("most", "max_percent"), ("p95", "p95_percent"))])


_SSIM = _BOTH + """, rg AS (SELECT image_id, greatest(max(v) - min(v), max(w) - min(w)) AS r FROM bo GROUP BY image_id), ws AS (SELECT c.image_id, c.x, c.y, avg(p.v) AS mv, avg(p.w) AS mw, 49 / 48 * (avg(p.v * p.v) - avg(p.v) ** 2) AS vv, 49 / 48 * (avg(p.w * p.w) - avg(p.w) ** 2) AS ww, 49 / 48 * (avg(p.v * p.w) - avg(p.v) * avg(p.w)) AS vw
FROM bo c JOIN bo p ON p.image_id = c.image_id AND p.x BETWEEN c.x - 3 AND c.x + 3 AND p.y BETWEEN c.y - 3 AND c.y + 3 WHERE c.x BETWEEN 3 AND 4 AND c.y BETWEEN 3 AND 4 GROUP BY ALL),
ss AS (SELECT image_id, 1 - avg((2 * mv * mw + (0.01 * r) ** 2) * (2 * vw + (0.03 * r) ** 2) / ((mv ** 2 + mw ** 2 + (0.01 * r) ** 2) * (vv + ww + (0.03 * r) ** 2))) AS d FROM ws JOIN rg USING (image_id) GROUP BY image_id)"""


@query(_SSIM + " SELECT image_id, round(d, 4) AS ssim_distance FROM ss", FRAMES_SQL)
def ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).select("image_id", rounded("ssim_distance", 4).alias("ssim_distance"))


@query(_SSIM + " SELECT count(*) AS n, round(avg(1 - d), 5) AS mean, round(stddev_pop(1 - d), 5) AS std FROM ss", FRAMES_SQL)
def ssim_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = compared(spark, sf_dir)
    return s.agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(1 - F.col("ssim_distance")), 5).alias("mean"), rounded(F.stddev_pop(1 - F.col("ssim_distance")), 5).alias("std"))


@query(", q AS (SELECT image_id, x, y, v / 2 + 0.1 AS v FROM px), m AS (SELECT image_id, min(v) AS a, max(v) AS z FROM q GROUP BY image_id) SELECT image_id, x, y, round((v - a) / (z - a), 6) AS norm FROM q JOIN m USING (image_id)", FRAMES_SQL)
def normalize_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    dull = views.frames(spark, sf_dir).select("image_id", F.transform("pixels", lambda v: v / 2 + 0.1).alias("v"))
    norm = dull.select("image_id", pixels.stretched(F.col("v"), F.array_min("v"), F.array_max("v")).alias("norm"))
    return pixels.exploded(norm, "norm", F.lit(8)).select("image_id", "x", "y", r6("v").alias("norm"))


@query("SELECT image_id, x - 2 AS x, y - 1 AS y, v FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6", FRAMES_SQL)
def roi_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.crop(px_of(spark, sf_dir), 2, 6, 1, 7)


@query(f"SELECT image_id, x, y, {_G}::INT AS gray, round({_G} / 255, 6) AS unit FROM px", FRAMES_SQL)
def pixel_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = pixels.level(F.col("v"))
    return px_of(spark, sf_dir).select("image_id", "x", "y", g.alias("gray"), r6(g / 255).alias("unit"))


@query("SELECT image_id, round((pixels[p] - a) / (z - a), 6) AS norm, p - 1 AS patch FROM (SELECT image_id, pixels, list_min(pixels) AS a, list_max(pixels) AS z, unnest(range(1, 65)) AS p FROM fr)", FRAMES_SQL)
def attention_grid_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = pixels.stretched(F.col("pixels"), F.array_min("pixels"), F.array_max("pixels"))
    return views.frames(spark, sf_dir).select("image_id", F.posexplode(norm).alias("patch", "norm")).select("image_id", r6("norm").alias("norm"), "patch")


#: One frame an hour from 2019 on, thirty days a month.
_META = "idx AS (SELECT vec_id AS image_id, (2019 + vec_id // 8640)::INT AS year, (vec_id // 720 % 12 + 1)::INT AS month, (vec_id // 24 % 30 + 1)::INT AS day, (vec_id % 24)::INT AS hour FROM embeddings), " + FRAMES_SQL


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, i = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id")), F.col("image_id")
    whole = {"year": 2019 + F.floor(i / 8640), "month": F.floor(i / 720) % 12 + 1, "day": F.floor(i / 24) % 30 + 1, "hour": i % 24}
    return ids.withColumns({k: c.cast("int") for k, c in whole.items()})


_BOTH_MONTH = _BOTH.replace("b.image_id = a.image_id - 1", "b.image_id = a.image_id - 1 AND a.image_id % 720 <> 0")
_SSIM_MONTH = _SSIM.replace(_BOTH, _BOTH_MONTH)


@query(", b AS (SELECT a.*, CASE WHEN avg(v / 4) >= 30 / 255 THEN 0 ELSE avg(CASE WHEN v / 4 > 60 / 255 THEN 1 ELSE 0 END) END AS night FROM idx a JOIN px USING (image_id) GROUP BY ALL)" + _SSIM_MONTH + ", md AS (SELECT image_id, avg(abs(v - w)) AS m FROM bo GROUP BY image_id), c AS (SELECT b.*, m, d, (night + coalesce(m, 0) + coalesce(d, 0)) / (1 + (m IS NOT NULL)::INT + (d IS NOT NULL)::INT) AS s FROM b LEFT JOIN md USING (image_id) LEFT JOIN ss USING (image_id)), t AS (SELECT year, month, avg(s) + 2 * stddev_samp(s) AS t FROM c GROUP BY ALL) SELECT image_id, year, month, day, hour, round(night, 4) AS night_score, round(m, 4) AS mad_prev, round(d, 4) AS ssim_prev, round(s, 4) AS combined_score, round(t, 4) AS threshold, s > t AS is_anomaly, round(s - t, 4) AS distance_to_threshold FROM c JOIN t USING (year, month)", _META)
def baseline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every frame of a month against the one before it in the month, and the month's threshold."""
    rows = meta(spark, sf_dir).withColumns({"camera": F.lit("a"), "minute": F.lit(0), "filename": F.lit("f"), "readable": F.lit(True)})
    found = kernels.pair_scores(with_before(spark, sf_dir, pixels.previous_in_month(rows)), ["image_id", "year", "month", "day", "hour"], dim=0.25)
    scored = found.withColumn("combined", levels.mean_of_present(F.col("night_score"), F.col("mad"), F.col("ssim_distance")))
    out = report.mu_2sigma(scored, "combined", ["year", "month"])
    names = {"night_score": "night_score", "mad": "mad_prev", "ssim_distance": "ssim_prev", "combined": "combined_score", "threshold": "threshold", "distance_to_threshold": "distance_to_threshold"}
    return out.select("image_id", "year", "month", "day", "hour", "is_anomaly", *[rounded(c, 4).alias(n) for c, n in names.items()])


@query(_SSIM.replace(_BOTH, _BOTH.replace("a.image_id - 1", "a.image_id - 24 AND a.image_id % 720 >= 24")) + " SELECT image_id, b.day AS day_a, a.day AS day_b, a.year, a.month, a.hour, round(avg(abs(v - w)), 6) AS mad_score, round(any_value(d), 4) AS ssim_score FROM bo JOIN ss USING (image_id) JOIN idx a USING (image_id) JOIN idx b ON b.image_id = prev_id GROUP BY ALL", _META)
def same_hour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame against the one of the next day at its hour, in every month."""
    after = W.partitionBy("year", "month", "hour").orderBy("day", "image_id")  # the days of one month
    at = meta(spark, sf_dir).select(F.col("image_id").alias("prev_id"), F.col("day").alias("day_a"), "year", "month", "hour", F.lead("image_id").over(after).alias("image_id"), F.lead("day").over(after).alias("day_b"))
    keep = ["image_id", "day_a", "day_b", "year", "month", "hour"]
    found = kernels.pair_scores(with_before(spark, sf_dir, at.filter("image_id is not null")), keep)
    return found.select(*keep, r6("mad").alias("mad_score"), rounded("ssim_distance", 4).alias("ssim_score"))


@query(", r AS (SELECT * FROM idx WHERE quality_flag IS DISTINCT FROM 'corrupted') SELECT image_id, lag(image_id) OVER (PARTITION BY camera, year, month ORDER BY day, hour, minute, filename, image_id) AS prev_id FROM r")
def prev_frame_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir).withColumn("readable", ~F.col("quality_flag").eqNullSafe("corrupted"))
    return pixels.previous_in_month(df).select("image_id", "prev_id")


@query(", a AS (SELECT image_id, camera, make_timestamp(year, month, day, hour, minute, second::DOUBLE) AS at_ FROM idx), l AS (SELECT *, lag(image_id) OVER w AS p, lag(at_) OVER w AS t FROM a WINDOW w AS (PARTITION BY camera ORDER BY at_, image_id)) SELECT image_id, CASE WHEN epoch(at_) - epoch(t) <= 1200 THEN p END AS prev_id FROM l")
def prev_frame_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir).withColumn("at", F.make_timestamp_ntz("year", "month", "day", "hour", "minute", "second"))
    return pixels.previous_in_gap(df).select("image_id", "prev_id")


#: Frames come in twos of one camera, seven minutes apart; the next two of it follow after its gap.
_TWOS = "idx AS (SELECT vec_id AS image_id, CASE WHEN vec_id % 11 <> 5 THEN 'usable' ELSE 'corrupted' END AS quality_flag FROM embeddings), " + FRAMES_SQL.replace("FROM embeddings)", "FROM embeddings WHERE vec_id % 11 <> 5)")
_POINTS = [(round(-3 * math.sin(2 * math.pi * i / 24), 5), round(3 * math.cos(2 * math.pi * i / 24), 5)) for i in range(24)]
_TWO_BOTH = _BOTH.replace("a.image_id - 1", "a.image_id - 1 AND a.image_id % 2 = 1")
_LBP = f""", pt AS (SELECT i, floor(dy)::INT AS y0, floor(dx)::INT AS x0, dy - floor(dy) AS fy, dx - floor(dx) AS fx FROM (VALUES {", ".join(f"({i}, {dy}::DOUBLE, {dx}::DOUBLE)" for i, (dy, dx) in enumerate(_POINTS))}) AS v(i, dy, dx)),
gr AS (SELECT image_id, [floor(v * 255) for v in pixels] AS g FROM fr), at_ AS (SELECT image_id, g, p, p % 8 AS x, p // 8 AS y, i, fx, fy, p % 8 + x0 AS a, p // 8 + y0 AS b FROM gr, (SELECT unnest(range(64)) AS p), pt),
bt AS (SELECT image_id, p, i, ({" + ".join(f"CASE WHEN a + {j} BETWEEN 0 AND 7 AND b + {k} BETWEEN 0 AND 7 THEN g[(b + {k}) * 8 + a + {j} + 1] ELSE 0 END * {'fy' if k else '(1 - fy)'} * {'fx' if j else '(1 - fx)'}" for k in (0, 1) for j in (0, 1))}) - g[p + 1] >= -1e-12 AS bit FROM at_),
bl AS (SELECT image_id, p, list(bit::INT ORDER BY i) AS m FROM bt GROUP BY ALL), cd AS (SELECT image_id, CASE WHEN list_sum([(m[k] <> m[(k + 22) % 24 + 1])::INT for k in range(1, 25)]) <= 2 THEN list_sum(m) ELSE 25 END AS c FROM bl),
cn AS (SELECT image_id, c, count(*) AS n FROM cd GROUP BY ALL), wd AS (SELECT image_id, CASE WHEN max(c) > min(c) THEN (max(c) - min(c)) / 26 ELSE 1 / 26 END AS w FROM cn GROUP BY image_id), lb AS (SELECT image_id, -sum(n / (64 * w) * log2(n / (64 * w))) AS h FROM cn JOIN wd USING (image_id) GROUP BY image_id)"""
_FEATURES = _NEAR + f", tg AS (SELECT image_id, avg(sqrt(({_tap(pixels.SOBEL['gx'])}) ** 2 + ({_tap(pixels.SOBEL['gy'])}) ** 2)) / 1448 AS g, stddev_pop({_tap(pixels.LAPLACE['lap'])}) / 255 AS r FROM nb GROUP BY image_id)" + _TWO_BOTH + f", d AS (SELECT image_id, avg(abs(v - w)) AS d, avg(abs(v - w)) / (1 + stddev_pop(w) + 1e-6) AS t FROM bo GROUP BY image_id), b AS (SELECT image_id, avg(CASE WHEN {_G} > 200 THEN 1 ELSE 0 END) AS b, avg(CASE WHEN {_G} > 180 THEN 1 ELSE 0 END) AS z FROM px GROUP BY image_id)" + _LBP


@query(_FEATURES + " SELECT image_id, 0.0::DOUBLE AS optical_flow_mag, round(h, 5) AS lbp_entropy, round(b, 6) AS bright_pixel_ratio, 1.0::DOUBLE AS contour_convexity, round(coalesce(d, 0), 6) AS pixel_diff_mean, round(g, 6) AS thermal_gradient, round(z, 6) AS bright_zone_area, round(r, 6) AS texture_roughness, 0.0::DOUBLE AS edge_density, round(coalesce(t, 0), 6) AS temporal_change_score FROM b JOIN tg USING (image_id) JOIN lb USING (image_id) LEFT JOIN d USING (image_id)", _TWOS)
def features_all(spark: SparkSession, sf_dir: str, scale: str = "reference") -> DataFrame:
    """The ten features of every frame that is not corrupted, paired with its camera's last one of
    the twenty minutes before. In the published scale no edge of a frame in [0, 1] is found (see `kernels.SCALES`)."""
    i = F.col("image_id")
    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id")).filter(i % 11 != 5)
    at = F.timestamp_add("MINUTE", (F.floor(i / 2) * 30 + i % 2 * 7).cast("int"), F.lit("2019-01-01").cast("timestamp_ntz"))
    rows = ids.withColumns({"camera": F.element_at(F.array(*map(F.lit, ("kalor", "suki", "kali"))), (F.floor(i / 2) % 3 + 1).cast("int")), "at": at})
    out = kernels.features(with_before(spark, sf_dir, pixels.previous_in_gap(rows).select("image_id", "prev_id")), scale)
    return out.select("image_id", *[rounded(c, 5 if c == "lbp_entropy" else 6).alias(c) for c in kernels.FEATURES])


@query(_LBP + " SELECT image_id, round(h, 5) AS lbp_entropy FROM lb", FRAMES_SQL)
def lbp_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir).select("image_id", rounded("lbp_entropy", 5).alias("lbp_entropy"))


@query(_FEATURES + f", {_EDGES} SELECT image_id, round(coalesce(d, 0), 6) AS pixel_diff_mean, round(coalesce(t, 0), 6) AS temporal_change_score, round(b, 6) AS bright_pixel_ratio, round(z, 6) AS bright_zone_area, round(g * 255, 6) AS thermal_gradient, round(r * 255, 6) AS texture_roughness, round(h, 5) AS lbp_entropy, round(e, 6) AS edge_density FROM b JOIN tg USING (image_id) JOIN lb USING (image_id) JOIN eg USING (image_id) LEFT JOIN d USING (image_id)", _TWOS)
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features in the unit scale, in which frames have edges."""
    return features_all(spark, sf_dir, "unit").select("image_id", "pixel_diff_mean", "temporal_change_score", "bright_pixel_ratio", "bright_zone_area", "thermal_gradient", "texture_roughness", "lbp_entropy", "edge_density")


_SHRUNK = ", z AS (SELECT image_id, i, j, sum(v * 255 * greatest(0, least(y, 1.5 * (i + 1)) - greatest(y - 1, 1.5 * i)) * greatest(0, least(x + 1, 2 * (j + 1)) - greatest(x, 2 * j))) / 3 / 255 AS a FROM px, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j) WHERE y BETWEEN 1 AND 6 GROUP BY ALL), e AS (SELECT image_id, min(a) AS lo, max(a) AS hi FROM z GROUP BY image_id), g AS (SELECT image_id, i, j, floor((a - lo) / (hi - lo) * 255) AS g FROM z JOIN e USING (image_id))"


@query(_SHRUNK + " SELECT 'frame/' || image_id AS path, list(g::INT ORDER BY i, j) AS pixels, round(avg(g), 6) AS mean, CASE WHEN avg(g) < 30 THEN 'dark' WHEN var_pop(g) < 50 THEN 'cloudy' ELSE 'usable' END AS flag, NULL::VARCHAR AS error FROM g GROUP BY image_id", FRAMES_SQL)
def preprocess_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames cropped, resized to 4 x 4 and stretched; quality from the result."""
    fr = views.frames(spark, sf_dir).select(F.concat(F.lit("frame/"), F.col("image_id").cast("string")).alias("path"), F.lit(8).alias("width"), F.transform("pixels", lambda v: v * 255).alias("pixels"))
    out = kernels.preprocess(fr, 4, (0, 8, 1, 7))
    flag = levels.quality_flag(F.lit(5000), F.col("error").isNull(), F.col("mean"), F.col("variance"))
    return out.select("path", F.transform("pixels", lambda v: v.cast("int")).alias("pixels"), r6("mean").alias("mean"), flag.alias("flag"), "error")


@query(f", m AS (SELECT image_id, avg({_G}) AS mean, var_pop({_G}) AS var FROM px GROUP BY image_id), f AS (SELECT image_id, CASE WHEN mean < 30 THEN 'dark' WHEN var < 50 THEN 'cloudy' ELSE 'usable' END AS flag FROM m) SELECT flag, count(*) AS n FROM f GROUP BY flag", FRAMES_SQL)
def rebuild_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = levels.quality_flag(F.lit(5000), F.lit(True), F.col("gray_mean"), F.col("gray_variance"))
    return stats_of(spark, sf_dir).groupBy(flag.alias("flag")).agg(F.count(F.lit(1)).alias("n"))
