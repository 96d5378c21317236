"""Queries of derived columns and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import captions, dates, levels, names
from ..functions.rounding import rounded
from ..operators import select
from .registry import query
from .views import index

#: Names that exercise every pattern, mixed by row into the index.
ODD_NAMES = ["cam_20141115_143022.jpg", "20141115_14.jpg", "x_2014-11-15_14-30.jpg", "Kalor_Canon_2014-11-12_17.13.07.jpg", "ech_kalor_Canon_2021-05-31_17.00.13.jpg", "therm.jpg"]
_ODD = "CASE image_id % 12 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(ODD_NAMES)) + " ELSE filename END"


def odd_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F
    for i, n in enumerate(ODD_NAMES):
        name = name.when(F.col("image_id") % 12 == i, n)
    return index(spark, sf_dir).withColumn("filename", name.otherwise(F.col("filename")))


_STAMP_SQL = rf""", o AS (SELECT * REPLACE ({_ODD} AS filename) FROM idx), st AS (SELECT *, regexp_replace(filename, '\.[^.]*$', '') AS stem FROM o),
p AS (SELECT *, CASE WHEN regexp_matches(stem, '\d{{8}}_\d{{4}}') THEN regexp_extract(stem, '(\d{{4}})(\d{{2}})(\d{{2}})_(\d{{2}})(\d{{2}})(\d{{2}})?', ['a','b','c','d','e','f'])
    WHEN regexp_matches(stem, '\d{{8}}_\d{{2}}') THEN regexp_extract(stem || '', '(\d{{4}})(\d{{2}})(\d{{2}})_(\d{{2}})()()', ['a','b','c','d','e','f'])
    WHEN regexp_matches(stem, '\d{{4}}-\d{{2}}-\d{{2}}_\d{{2}}-\d{{2}}') THEN regexp_extract(stem, '(\d{{4}})-(\d{{2}})-(\d{{2}})_(\d{{2}})-(\d{{2}})()', ['a','b','c','d','e','f'])
    WHEN regexp_matches(stem, '\d{{4}}-\d{{2}}-\d{{2}}_\d{{2}}\.\d{{2}}') THEN regexp_extract(stem, '(\d{{4}})-(\d{{2}})-(\d{{2}})_(\d{{2}})\.(\d{{2}})(?:\.(\d{{2}}))?', ['a','b','c','d','e','f']) END AS g FROM st),
s AS (SELECT image_id, filename, year, month, day, hour, minute, second, g.a::INT AS y, g.b::INT AS mo, g.c::INT AS d, g.d::INT AS h, CASE WHEN g IS NOT NULL THEN coalesce(nullif(g.e, '')::INT, 0) END AS mi, CASE WHEN g IS NOT NULL THEN coalesce(nullif(g.f, '')::INT, 0) END AS se FROM p)"""


@query(_STAMP_SQL + " SELECT image_id, filename, y AS p_year, mo AS p_month, d AS p_day, h AS p_hour, mi AS p_minute, se AS p_second FROM s")
def parse_filename_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.stamped(odd_named(spark, sf_dir)).select("image_id", "filename", *[f"p_{c}" for c in names.PARTS])


@query(_STAMP_SQL + " SELECT image_id, coalesce(CASE WHEN image_id % 4 <> 0 THEN day END, d) AS day, coalesce(CASE WHEN image_id % 4 <> 1 THEN hour END, h) AS hour, coalesce(minute, mi) AS minute, coalesce(CASE WHEN image_id % 4 <> 2 THEN second END, se) AS second FROM s")
def fill_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = {c: F.when(F.col("image_id") % 4 != i, F.col(c)) for i, c in enumerate(("day", "hour"))} | {"second": F.when(F.col("image_id") % 4 != 2, F.col("second"))}
    return names.fill_from_name(odd_named(spark, sf_dir).withColumns(holes)).select("image_id", "day", "hour", "minute", "second")


_HOLED = """, b AS (SELECT image_id, CASE WHEN image_id % 31 = 5 THEN NULL WHEN image_id % 37 = 4 THEN -1 ELSE year END AS year, CASE WHEN image_id % 41 = 3 THEN 13 WHEN image_id % 43 = 0 THEN 2 ELSE month END AS month,
CASE WHEN image_id % 17 = 0 THEN NULL WHEN image_id % 19 = 0 THEN 0 WHEN image_id % 23 = 0 THEN 32 ELSE day END AS day, CASE WHEN image_id % 13 <> 0 THEN hour END AS hour, CASE WHEN image_id % 11 <> 0 THEN minute END AS minute, second FROM idx)"""


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("image_id")
    return index(spark, sf_dir).select(
        "image_id", F.when(i % 31 == 5, None).when(i % 37 == 4, -1).otherwise(F.col("year")).alias("year"), F.when(i % 41 == 3, 13).when(i % 43 == 0, 2).otherwise(F.col("month")).alias("month"),
        F.when(i % 17 == 0, None).when(i % 19 == 0, 0).when(i % 23 == 0, 32).otherwise(F.col("day")).alias("day"), F.when(i % 13 != 0, F.col("hour")).alias("hour"), F.when(i % 11 != 0, F.col("minute")).alias("minute"), "second",
    )


@query(_HOLED + """, f AS (SELECT image_id, year, month, CASE WHEN day BETWEEN 1 AND 31 THEN day ELSE 1 END AS day, coalesce(hour, 0) AS hour, coalesce(minute, 0) AS minute, coalesce(second, 0) AS second FROM b WHERE year > 0 AND month BETWEEN 1 AND 12)
SELECT image_id, strftime(make_timestamp(year, month, day, hour, minute, second::DOUBLE), '%Y-%m-%d %H:%M:%S') AS taken_at FROM f WHERE day <= day(last_day(make_date(year, month, 1)))""")
def build_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = holed(spark, sf_dir).withColumn("t", dates.moment()).filter("t is not null")
    return df.select("image_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("taken_at"))


@query(_HOLED + """ SELECT image_id, strftime(make_timestamp(year, month, day, hour, 0, 0), '%Y-%m-%d %H:%M:%S') AS taken_at FROM b WHERE year IS NOT NULL AND year > 0 AND month BETWEEN 1 AND 12 AND hour IS NOT NULL AND day BETWEEN 1 AND day(last_day(make_date(year, CASE WHEN month BETWEEN 1 AND 12 THEN month ELSE 1 END, 1)))""")
def build_datetime_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = holed(spark, sf_dir).filter("year > 0").withColumn("t", dates.moment_strict()).filter("t is not null")
    return df.select("image_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("taken_at"))


@query("SELECT image_id, make_date(year, month, 15) AS middle, make_date(year, month, 1) AS first_day FROM idx")
def month_anchor_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("image_id", dates.month_anchor().alias("middle"), dates.month_anchor(1).alias("first_day"))


@query("SELECT image_id, make_date(year, month, 15) + ((image_id * 2654435761) % 4294967296 % 21 - 10)::INT AS shown_at FROM idx")
def jitter_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("image_id", dates.jittered(dates.month_anchor(), F.col("image_id")).alias("shown_at"))


@query(f", o AS (SELECT * REPLACE ({_ODD} AS filename) FROM idx) SELECT image_id, coalesce(nullif(lower(regexp_extract(filename, '^([A-Za-z0-9_]+)_Canon', 1)), ''), 'unknown') AS camera, coalesce(nullif(lower(regexp_extract(filename, '^([a-zA-Z0-9]+)_', 1)), ''), 'unknown') AS prefix FROM o")
def camera_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_named(spark, sf_dir).select("image_id", names.camera(F.col("filename")).alias("camera"), names.camera(F.col("filename"), r"^([a-zA-Z0-9]+)_").alias("prefix"))


@query("SELECT image_id, CASE image_id % 3 WHEN 0 THEN 'icone' WHEN 1 THEN 'image_publique' ELSE 'autre' END AS source_type FROM idx")
def source_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("image_id") % 3 == 0, "/icones/").when(F.col("image_id") % 3 == 1, "/images_publiques/").otherwise("/")
    return index(spark, sf_dir).select("image_id", names.source_type(F.concat("url", folder)).alias("source_type"))


@query("SELECT image_id, regexp_replace(replace(local_path, 'data/raw/', 'data/processed/'), '\\.[^./]*$', '.png') AS processed_path FROM idx")
def processed_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("image_id", names.processed_path(F.col("local_path")).alias("processed_path"))


_FLAGGED = "CASE WHEN file_size_bytes IS NULL OR file_size_bytes < 1000 OR NOT downloaded OR mean_brightness IS NULL THEN 'corrupted' WHEN mean_brightness < 30 THEN 'dark' WHEN variance < 50 THEN 'cloudy' ELSE 'usable' END"


@query(f"SELECT image_id, {_FLAGGED} AS flag, mean_brightness < 30 AS night FROM idx")
def quality_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = levels.quality_flag(F.col("file_size_bytes"), F.col("downloaded"), F.col("mean_brightness"), F.col("variance"))
    return index(spark, sf_dir).select("image_id", flag.alias("flag"), (F.col("mean_brightness") < 30).alias("night"))


_TOD = "CASE WHEN hour BETWEEN 6 AND 9 THEN 'early_morning' WHEN hour BETWEEN 10 AND 13 THEN 'midday' WHEN hour BETWEEN 14 AND 17 THEN 'afternoon' WHEN hour BETWEEN 18 AND 20 THEN 'dusk' ELSE 'night' END"


@query(f"SELECT image_id, hour BETWEEN 6 AND 17 AS is_day, CASE WHEN hour BETWEEN 6 AND 18 THEN 'day' ELSE 'night' END AS wide_period, {_TOD} AS time_of_day FROM idx")
def day_night(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("image_id", dates.is_day(F.col("hour")).alias("is_day"), F.when(dates.is_day(F.col("hour"), 6, 18), "day").otherwise("night").alias("wide_period"), dates.time_of_day(F.col("hour")).alias("time_of_day"))


@query(f"SELECT image_id, {_TOD} AS time_of_day FROM idx")
def time_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("image_id", dates.time_of_day(F.col("hour")).alias("time_of_day"))


_BUCKETS = """, sc AS (SELECT *, coalesce(anomaly_score, 0) AS s FROM idx), bk AS (SELECT *, CASE WHEN hour BETWEEN 6 AND 17 AND s > 0.3 THEN 'bright_with_incandescence' WHEN hour BETWEEN 6 AND 17 THEN 'daylight' WHEN s > 0.3 THEN 'incandescent_glow' WHEN s > 0.1 THEN 'dim_glow' ELSE 'dark' END AS brightness,
CASE WHEN s > 0.5 THEN 'very_high' WHEN s > 0.3 THEN 'high' WHEN s > 0.15 THEN 'moderate' WHEN s > 0.05 THEN 'low' ELSE 'none' END AS lava_intensity, CASE WHEN s > 0.3 THEN 'low' WHEN s > 0.1 THEN 'medium' ELSE 'high' END AS viscosity,
CASE WHEN s > 0.5 THEN 'high' WHEN s > 0.1 THEN 'moderate' ELSE 'low' END AS temperature, CASE WHEN s > 0.3 THEN 'effusive' ELSE 'none' END AS eruption,
CASE WHEN quality_flag = 'cloudy' THEN 'overcast' WHEN quality_flag = 'dark' AND NOT hour BETWEEN 6 AND 17 THEN 'clear_night' WHEN quality_flag = 'dark' THEN 'hazy' ELSE 'clear' END AS weather, CASE camera WHEN 'suki' THEN '30deg_south' WHEN 'kalor' THEN '25deg_west' WHEN 'kali' THEN '35deg_east' ELSE '30deg_unknown' END AS slope FROM sc)"""


def _buckets() -> dict:
    return levels.activity_buckets(F.col("hour"), F.coalesce("anomaly_score", F.lit(0.0)))


@query(_BUCKETS + " SELECT image_id, brightness, lava_intensity, viscosity, temperature, eruption FROM bk")
def activity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("image_id", *[c.alias(k) for k, c in _buckets().items()])


@query(_BUCKETS + " SELECT image_id, weather, slope FROM bk")
def weather_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("image_id", levels.weather_bucket(F.col("quality_flag"), F.col("hour")).alias("weather"), levels.slope(F.col("camera")).alias("slope"))


@query("SELECT image_id, CASE camera WHEN 'suki' THEN '30deg_south' WHEN 'kalor' THEN '25deg_west' ELSE '35deg_east' END AS slope FROM idx")
def slope_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("image_id", levels.slope(F.col("camera")).alias("slope"))


def _case(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


@query(_BUCKETS + f""" SELECT image_id, 'Surveillance camera photograph of the volcano, ' || {_case(captions.CAMERA, "camera")} || '. ' || ({_case(captions.TIME, f"({_TOD})")}) || ', ' || {_case(captions.WEATHER, "weather")} || '. ' || {_case(captions.BRIGHTNESS, "brightness")} || '. ' || {_case(captions.LAVA, "lava_intensity")} || '. ' ||
CASE WHEN lava_intensity <> 'none' THEN {_case(captions.VISCOSITY, "viscosity")} || ' with ' || {_case(captions.TEMPERATURE, "temperature")} || '. ' ELSE '' END || CASE WHEN eruption <> 'none' THEN {_case(captions.ERUPTION, "eruption")} || ' ' ELSE '' END || '{captions.TAIL}' AS caption,
'surveillance camera photo of the volcano, ' || CASE WHEN hour BETWEEN 6 AND 17 THEN '{captions.DAY_NIGHT[True]}' ELSE '{captions.DAY_NIGHT[False]}' END || ', Canon EOS 1100D, scientific monitoring' AS short_caption FROM bk""")
def caption_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = captions.caption(F.col("camera"), dates.time_of_day(F.col("hour")), _buckets(), levels.weather_bucket(F.col("quality_flag"), F.col("hour")), "the volcano")
    return index(spark, sf_dir).select("image_id", long.alias("caption"), captions.short_caption(dates.is_day(F.col("hour")), "the volcano").alias("short_caption"))


@query(_BUCKETS + """ SELECT image_id, round(CASE WHEN hour BETWEEN 6 AND 9 THEN 1.08 WHEN hour BETWEEN 10 AND 13 THEN 1.0 WHEN hour BETWEEN 14 AND 17 THEN 1.05 WHEN hour BETWEEN 18 AND 20 THEN 1.2 WHEN s > 0.3 THEN 0.3 + 0.7 * least(s * 1.8, 1.0) WHEN s > 0.1 THEN 0.45 ELSE 0.25 END::DOUBLE, 6) AS r,
round(CASE WHEN hour BETWEEN 6 AND 9 THEN 1.02 WHEN hour BETWEEN 10 AND 13 THEN 1.0 WHEN hour BETWEEN 14 AND 17 THEN 0.98 WHEN hour BETWEEN 18 AND 20 THEN 0.82 WHEN s > 0.3 THEN 0.15 + 0.35 * least(s * 1.8, 1.0) ELSE 0.3 END::DOUBLE, 6) AS g,
CASE WHEN hour BETWEEN 6 AND 9 THEN 0.88 WHEN hour BETWEEN 10 AND 13 THEN 0.95 WHEN hour BETWEEN 14 AND 17 THEN 0.88 WHEN hour BETWEEN 18 AND 20 THEN 0.6 WHEN s > 0.3 THEN 0.1 WHEN s > 0.1 THEN 0.2 ELSE 0.45 END::DOUBLE AS b FROM bk""")
def colour_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    gains = levels.colour_gains(F.col("hour"), F.coalesce("anomaly_score", F.lit(0.0)))
    return index(spark, sf_dir).select("image_id", rounded(gains["r"], 6).alias("r"), rounded(gains["g"], 6).alias("g"), gains["b"].alias("b"))


@query("SELECT image_id, round(sin(2 * pi() * coalesce(CASE WHEN image_id % 9 <> 0 THEN hour END, 12) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * coalesce(CASE WHEN image_id % 9 <> 0 THEN hour END, 12) / 24), 6) + 0.0 AS hour_cos, round(sin(2 * pi() * month / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month / 12), 6) + 0.0 AS month_cos FROM idx")
def cyclic_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = dates.cyclic(F.when(F.col("image_id") % 9 != 0, F.col("hour")), F.col("month"))
    return index(spark, sf_dir).select("image_id", *[(rounded(c, 6) + 0.0).alias(k) for k, c in parts.items()])


_LEVEL = "CASE WHEN {s} < 0.2 THEN 'Normal 🟢' WHEN {s} < 0.4 THEN 'Légère 🟡' WHEN {s} < 0.6 THEN 'Modérée 🟠' WHEN {s} < 0.8 THEN 'Forte 🔴' WHEN {s} IS NOT NULL THEN 'Critique ⚠️' END"


@query(f"SELECT image_id, {_LEVEL.format(s='anomaly_score')} AS level FROM idx")
def anomaly_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("image_id", levels.anomaly_level(F.col("anomaly_score")).alias("level"))


@query("SELECT image_id, CASE WHEN variance / 100 > 1.5 THEN 'strong' WHEN variance / 100 > 1.2 THEN 'medium' ELSE 'normal' END AS level FROM idx")
def alert_ratio_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("image_id", levels.alert_ratio_level(F.col("variance") / 100).alias("level"))


@query(", c AS (SELECT day, 100.0 * count(*) FILTER (downloaded) / count(*) AS p FROM idx GROUP BY day) SELECT day, CASE WHEN p >= 90 THEN 'good' WHEN p >= 50 THEN 'partial' ELSE 'poor' END AS level FROM c")
def coverage_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).groupBy("day").agg((100 * F.avg(F.col("downloaded").cast("int"))).alias("p")).select("day", levels.coverage_level(F.col("p")).alias("level"))


_CLASS = """CASE WHEN optical_flow_mag = 0 AND p = 0 AND texture_roughness = 0 AND temporal_change_score = 0 AND bright_pixel_ratio = 0 AND lbp_entropy = 0 AND pixel_diff_mean = 0 THEN 'normal'
WHEN optical_flow_mag > 2.0 OR p > 46.5 OR (p > 44.0 AND texture_roughness > 0.00033) OR (temporal_change_score > 0.12 AND p > 40) THEN 'pyroclastique' WHEN (is_night AND bright_pixel_ratio > 0.02) OR (NOT is_night AND bright_pixel_ratio > 0.92) THEN 'lave'
WHEN coalesce(regexp_matches(lower(weather_label), 'cloud|nuage|fog'), false) THEN 'nuage' WHEN (lbp_entropy > 0 OR pixel_diff_mean > 0) AND p < 30 AND lbp_entropy < 3.5 AND pixel_diff_mean < 0.03 THEN 'nuage' ELSE 'normal' END"""
CLASSED_SQL = f", cl AS (SELECT *, {_CLASS} AS class FROM (SELECT *, coalesce(patchcore_score, 0) AS p FROM idx))"


@query(CLASSED_SQL + " SELECT image_id, class FROM cl")
def classify_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("image_id", levels.heuristic_class().alias("class"))


@query("SELECT image_id, coalesce(anomaly_score, patchcore_score) AS score FROM idx")
def score_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("image_id", F.coalesce("anomaly_score", "patchcore_score").alias("score"))


@query("SELECT image_id, round(coalesce(list_avg([x for x in [anomaly_score, patchcore_score, CASE WHEN image_id % 3 = 0 THEN thermal_gradient END] if x IS NOT NULL]), 0), 6) AS combined FROM idx")
def combined_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = levels.mean_of_present(F.col("anomaly_score"), F.col("patchcore_score"), F.when(F.col("image_id") % 3 == 0, F.col("thermal_gradient")))
    return index(spark, sf_dir).select("image_id", rounded(c, 6).alias("combined"))


_NORM = ", m AS (SELECT min(patchcore_score) AS lo, max(patchcore_score) AS hi FROM idx)"


@query(_NORM + " SELECT image_id, round((patchcore_score - lo) / (hi - lo + 1e-9), 6) AS norm FROM idx, m WHERE patchcore_score IS NOT NULL")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.minmax_norm(index(spark, sf_dir), "patchcore_score").select("image_id", rounded("norm", 6).alias("norm"))


@query(_NORM + " SELECT image_id, round(1 - (patchcore_score - lo) / (hi - lo + 1e-9), 6) AS inverted, true AS correction_applied FROM idx, m WHERE patchcore_score IS NOT NULL")
def invert_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.minmax_norm(index(spark, sf_dir), "patchcore_score").select("image_id", rounded(1 - F.col("norm"), 6).alias("inverted"), F.lit(True).alias("correction_applied"))


@query("SELECT image_id, file_size_bytes / 1024 AS size_kb FROM idx")
def size_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("image_id", (F.col("file_size_bytes") / 1024).alias("size_kb"))


@query("SELECT image_id, printf('%d-%02d', year, month) AS period FROM idx")
def period_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("image_id", dates.period_label(F.col("year"), F.col("month")).alias("period"))


@query("SELECT image_id, CASE quality_flag WHEN 'cloudy' THEN 0 WHEN 'dark' THEN 1 END AS label FROM idx")
def label_from_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("image_id", levels.label_from_flag(F.col("quality_flag")).alias("label"))


@query(f", m AS (SELECT camera, max(patchcore_score) AS hi FROM idx GROUP BY camera) SELECT image_id, {_LEVEL.format(s='patchcore_score / hi')} AS level FROM idx JOIN m USING (camera) WHERE patchcore_score IS NOT NULL")
def relative_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.relative(index(spark, sf_dir), "patchcore_score", "camera").select("image_id", levels.anomaly_level(F.col("relative")).alias("level"))


@query("SELECT image_id FROM idx WHERE year = 2024 AND month = 1")
def filter_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).filter("year = 2024 and month = 1").select("image_id")


@query("SELECT image_id FROM idx WHERE downloaded")
def filter_downloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).filter("downloaded").select("image_id")


@query("SELECT image_id FROM idx WHERE quality_flag IN ('usable', 'dark') OR quality_flag IS NULL")
def filter_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.of_quality(index(spark, sf_dir), ["usable", "dark"]).select("image_id")


@query("SELECT image_id, starts_with(lower(filename), 'kal') AS by_prefix FROM idx WHERE contains(lower(filename), 'kalor') OR starts_with(lower(filename), 'kal')")
def filter_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower("filename")
    return index(spark, sf_dir).filter(name.contains("kalor") | name.startswith("kal")).select("image_id", name.startswith("kal").alias("by_prefix"))


@query(""", y AS (SELECT * FROM idx WHERE year = 2024), m AS (SELECT * FROM y WHERE month = 1), d AS (SELECT * FROM m WHERE day = 15), q AS (SELECT * FROM d WHERE quality_flag = 'usable' OR quality_flag IS NULL)
SELECT 'month' AS level, month::VARCHAR AS choice, count(*) AS n FROM y GROUP BY month UNION ALL SELECT 'day', day::VARCHAR, count(*) FROM m GROUP BY day UNION ALL SELECT 'quality', quality_flag, count(*) FROM d GROUP BY quality_flag UNION ALL SELECT 'downloaded', downloaded::VARCHAR, count(*) FROM q GROUP BY downloaded""")
def cascade_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.cascade(index(spark, sf_dir), {"year": 2024, "month": 1, "day": 15, "quality_flag": "usable"})


@query("SELECT image_id FROM idx WHERE year BETWEEN 2015 AND 2018")
def year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).filter(F.col("year").between(2015, 2018)).select("image_id")


@query("SELECT image_id, CASE WHEN year BETWEEN 2014 AND 2017 THEN 'train' ELSE 'test' END AS split FROM idx WHERE quality_flag = 'usable' AND (year = 2018 OR year BETWEEN 2014 AND 2017 AND hour BETWEEN 6 AND 17)")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.temporal_split(index(spark, sf_dir), F.col("year").between(2014, 2017), F.col("year") == 2018).select("image_id", "split")


@query("SELECT image_id, CASE WHEN quality_flag = 'dark' THEN 1 ELSE 0 END AS y_true FROM idx WHERE patchcore_score IS NOT NULL AND (quality_flag = 'dark' OR (quality_flag = 'usable' AND hour BETWEEN 6 AND 17))")
def proxy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.proxy_labels(index(spark, sf_dir), "patchcore_score").select("image_id", "y_true")


@query("SELECT image_id FROM idx WHERE NOT (is_night AND coalesce(anomaly_score, 0) <= 0.05)")
def glow_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).filter(~(F.col("is_night") & (F.coalesce("anomaly_score", F.lit(0.0)) <= 0.05))).select("image_id")


CATEGORIES_SQL = """, us AS (SELECT * REPLACE (coalesce(anomaly_score, 0) AS anomaly_score) FROM idx WHERE quality_flag = 'usable'), cat AS (SELECT image_id, camera, unnest([x for x in [CASE WHEN hour BETWEEN 6 AND 17 AND anomaly_score < 0.1 THEN 'day_calm' END, CASE WHEN hour BETWEEN 6 AND 17 AND anomaly_score >= 0.15 THEN 'day_active' END,
CASE WHEN NOT hour BETWEEN 6 AND 17 AND anomaly_score >= 0.15 THEN 'night_active' END, CASE WHEN NOT hour BETWEEN 6 AND 17 AND anomaly_score < 0.05 THEN 'night_calm' END, CASE WHEN hour BETWEEN 18 AND 20 THEN 'dusk' END] if x IS NOT NULL]) AS category FROM us)"""


@query(CATEGORIES_SQL + " SELECT image_id, category FROM cat")
def real_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.categories(index(spark, sf_dir)).select("image_id", "category")


@query(", t AS (SELECT quantile_cont(patchcore_score, 0.9) AS line FROM idx) SELECT image_id FROM idx, t WHERE patchcore_score > line")
def above_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.above(index(spark, sf_dir), "patchcore_score", 0.9).select("image_id")


@query("SELECT day, hour, count(*) AS n FROM idx GROUP BY day, hour HAVING count(*) >= 15")
def min_group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).groupBy("day", "hour").agg(F.count(F.lit(1)).alias("n")).filter("n >= 15")


#: Pages of the archive made from the index: one for each day and camera, with images, detail pages and decorations.
_PAGES = r""", ln AS (SELECT 'http://s/' || strftime(make_date(year, month, 1), '%Y_%m') || '/index.html' AS page, year, month, image_id, filename, regexp_replace(filename, '\.[^.]*$', '') AS stem FROM idx)"""


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, year, month, html: a month page of each day, with five kinds of tags by image."""
    i, stem = F.col("image_id") % 7, F.regexp_replace("filename", r"\.[^.]*$", "")
    tag = F.when(i == 0, F.concat(F.lit('<img alt="x" src="thumbnails/ech_'), "filename", F.lit('">'))).when(i == 1, F.concat(F.lit("<a href='/2024_01/images_publiques/"), "filename", F.lit("'>"))).when(i == 2, F.concat(F.lit('<a href="html_images/'), stem, F.lit('.html">'))).when(i == 3, F.concat(F.lit('<A class="q" HREF="file:///C|/x/2020_04/html_images/'), stem, F.lit('.html">')))
    tag = tag.when(i == 4, F.concat(F.lit('<img src="http://s/img/arrow_kalor'), F.col("image_id").cast("string"), F.lit('.png">'))).when(i == 5, F.concat(F.lit('<img src="http://s/img/logo.png"><img src="http://t/'), "filename", F.lit('?v=1">'))).otherwise(F.concat(F.lit('<a href="other.html">'), F.col("image_id").cast("string"), F.lit("</a>")))
    rows = index(spark, sf_dir).withColumn("tag", tag)
    url = F.concat(F.lit("http://s/"), F.date_format(F.make_date("year", "month", F.lit(1)), "yyyy_MM"), F.lit("/index.html"))
    pages = rows.groupBy("year", "month", "day").agg(F.concat_ws("\n", F.sort_array(F.collect_list("tag"))).alias("html"))
    return pages.select((F.col("year") * 10000 + F.col("month") * 100 + F.col("day")).alias("page_id"), url.alias("url"), "year", "month", "html")


@query(_PAGES + r""", l AS (SELECT year * 10000 + month * 100 + day AS page_id, CASE image_id % 7 WHEN 0 THEN 'http://b/' || strftime(make_date(year, month, 1), '%Y_%m') || '/html_images/ech_' || stem || '.jpg' WHEN 1 THEN 'http://s/2024_01/images_publiques/' || filename WHEN 2 THEN 'http://s/' || strftime(make_date(year, month, 1), '%Y_%m') || '/html_images/ech_' || stem || '.jpg'
    WHEN 3 THEN 'http://b/2020_04/html_images/ech_' || stem || '.jpg' WHEN 5 THEN 'http://t/' || filename || '?v=1' END AS link, filename FROM (SELECT ln.*, idx.day FROM ln JOIN idx USING (image_id))) SELECT DISTINCT page_id, link FROM l WHERE link IS NOT NULL AND starts_with(filename, 'kalor')""")
def extract_image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of one camera's full images on the month pages."""
    return select.image_links(page_rows(spark, sf_dir), "http://b", "kalor").select("page_id", "link")


_LINKS = r""", l AS (SELECT page_id, url AS page, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)"""


@query(_LINKS + r""" SELECT DISTINCT page_id, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(page, '^([A-Za-z]+://[^/?#]*)', 1) || href ELSE regexp_replace(regexp_replace(page, '[?#].*$', ''), '[^/]*$', '') || href END AS link FROM l""", views="none_ AS (SELECT 1)")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of raw web pages, resolved."""
    return select.links(spark.read.parquet(f"{sf_dir}/pages.parquet"), "a", "href").select("page_id", "link").distinct()


_KINDS = """, u AS (SELECT image_id, CASE image_id % 5 WHEN 0 THEN 'http://s/2024_01/thumbnails/ech_' || filename WHEN 1 THEN 'http://s/2024_01/icones/' || filename WHEN 2 THEN 'file:///C|/x/2024_02/html_images/' || replace(filename, '.jpg', '.html')
WHEN 3 THEN 'http://s/2024_01/html_images/' || replace(filename, '.jpg', '.html') ELSE 'http://s/2014/html/' || replace(filename, '.jpg', '.html') END AS u, regexp_replace(filename, '\\.[^.]*$', '') AS stem, year, month FROM idx)"""


def _odd_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, i = F.replace("filename", F.lit(".jpg"), F.lit(".html")), F.col("image_id") % 5
    u = F.when(i == 0, F.concat(F.lit("http://s/2024_01/thumbnails/ech_"), "filename")).when(i == 1, F.concat(F.lit("http://s/2024_01/icones/"), "filename")).when(i == 2, F.concat(F.lit("file:///C|/x/2024_02/html_images/"), page))
    return index(spark, sf_dir).withColumn("u", u.when(i == 3, F.concat(F.lit("http://s/2024_01/html_images/"), page)).otherwise(F.concat(F.lit("http://s/2014/html/"), page)))


@query(_KINDS + """ SELECT image_id, CASE image_id % 5 WHEN 0 THEN 'http://b/' || strftime(make_date(year, month, 1), '%Y_%m') || '/html_images/ech_' || stem || '.jpg' WHEN 1 THEN 'http://s/2024_01/images_publiques/' || stem || '.jpg' WHEN 2 THEN CASE WHEN regexp_matches(lower(stem), '^(kalor|suki|canon|cam)') THEN 'http://b/2024_02/html_images/ech_' || stem || '.jpg' END
WHEN 3 THEN 'http://s/2024_01/html_images/ech_' || stem || '.jpg' ELSE 'http://s/2014/images_publiques/' || stem || '.jpg' END AS image_url FROM u""")
def rewrite_image_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd_urls(spark, sf_dir).select("image_id", names.rewritten(F.col("u"), "http://b", F.col("year"), F.col("month")).alias("image_url"))


#: Addresses that hit or just miss each predicate, mixed by row into the odd ones.
TELLTALES = ["http://s/barre_vert.gif", "http://s/x_title.png", "http://s/logo.jpg", "http://s/fleche_g.png", "http://s/Arrow.png?x=1", "http://s/spacer.gif", "http://s/a/arrow/kalor.jpeg", "http://s/x.GIF", "http://s/html/Suki.HTML", "file://s/html/suki.html", "http://s/html_images/a.html", ""]
_TELL = "CASE image_id % 24 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(TELLTALES)) + " ELSE u END"
_SUFFIX = r"regexp_replace(regexp_replace(u, '[?#].*$', ''), '^.*/', '')"


@query(_KINDS + f""", t AS (SELECT image_id, {_TELL} AS u FROM u) SELECT image_id, regexp_matches({_SUFFIX}, '\\.(jpg|jpeg|JPG|JPEG|png|PNG)$') AND NOT (contains(lower(u), 'title') OR contains(lower(u), 'logo') OR contains(lower(u), 'barre')) AS is_image,
u <> '' AND NOT starts_with(u, 'file://') AND (contains(lower(u), '/html_images/') OR contains(lower(u), '/html/')) AND ends_with(lower(u), '.html') AND regexp_matches(lower(u), 'canon|cam|kalor|suki') AS is_detail,
len([x for x in ['barre_vert', 'barre_hor', '_title', 'fleche', 'arrow', 'spacer'] if contains(lower(regexp_replace({_SUFFIX}, '\\.[^.]*$', '')), x)]) > 0 AS is_decoration FROM t""")
def link_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("image_id") % 24, F
    for k, x in enumerate(TELLTALES):
        u = u.when(i == k, x)
    rows, u = _odd_urls(spark, sf_dir).withColumn("u", u.otherwise(F.col("u"))), F.col("u")
    return rows.select("image_id", names.is_image_url(u).alias("is_image"), names.is_detail_page(u).alias("is_detail"), names.is_decoration(u).alias("is_decoration"))


@query("SELECT DISTINCT year, month, 'http://b/' || year || '_' || lpad(month::VARCHAR, 2, '0') || '/' || year || '_' || lower(strftime(make_date(year, month, 1), '%b')) || '.html' AS page FROM idx")
def month_page_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("year", "month").distinct().withColumn("page", names.month_page_url("http://b", F.col("year"), F.col("month")))
