"""Stand-in views: the event log read as a camera archive, vectors read as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pixels as pixel_kernels


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image index with scores and features, one row per event.

    The log spans one month, so the rows of some users are put back by whole months: the index
    has years from 2014 to 2024 of unequal size, and not every camera has rows in each."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    u = F.col("user_id") % 8
    back = F.when(u == 4, 72).when(u == 5, 73 + F.col("event_id") % 3).when((u == 6) & (F.col("user_id") % 3 != 2), 100).when(u == 7, 109 + F.col("event_id") % 12).otherwise(0)
    e = e.withColumn("ts", F.col("ts") - F.make_ym_interval(F.lit(0), back.cast("int")))
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    e = e.select(F.col("event_id").alias("image_id"), "ts", "user_id", "event_type", "value", k.alias("k"))
    part = lambda p: F.date_part(F.lit(p), "ts").cast("int")
    e = e.withColumns({"year": F.year("ts"), "month": F.month("ts"), "day": F.dayofmonth("ts"), "hour": F.hour("ts"), "minute": F.minute("ts"), "second": F.floor(part("SECOND")).cast("int")})
    camera = F.when(F.col("user_id") % 3 == 0, "kalor").when(F.col("user_id") % 3 == 1, "suki").otherwise("kali")
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    stamp = F.concat_ws("-", "year", two("month"), two("day"))
    clock = F.concat_ws(".", two("hour"), two("minute"), two("second"))
    flag = F.when(F.col("image_id") % 29 == 0, None).when(F.col("event_type").isin("view", "purchase"), "usable").when(F.col("event_type") == "error", "dark").when(F.col("event_type") == "click", "cloudy").otherwise("corrupted")
    e = e.withColumns({"camera": camera, "quality_flag": flag, "filename": F.concat(camera, F.lit("_Canon_"), stamp, F.lit("_"), clock, F.lit(".jpg"))})
    folder = F.concat_ws("/", F.col("year").cast("string"), two("month"))
    return e.select(
        "image_id", F.concat(F.lit("http://cams.example/"), folder, F.lit("/"), F.col("image_id").cast("string"), F.lit("/"), "filename").alias("url"), "filename", "camera",
        F.concat(F.lit("data/raw/"), folder, F.lit("/"), "filename").alias("local_path"), F.lit(".jpg").alias("extension"),
        "year", "month", "day", "hour", "minute", "second", "quality_flag", (F.col("image_id") % 5 != 0).alias("downloaded"),
        F.when(F.col("image_id") % 11 != 0, 400 + F.col("k") * 97).cast("long").alias("file_size_bytes"), (~F.col("hour").between(6, 17)).alias("is_night"),
        F.when(F.col("image_id") % 7 != 0, F.col("value") / 500).alias("anomaly_score"), F.when(F.col("image_id") % 13 != 0, F.col("value")).alias("patchcore_score"),
        (F.col("k") * 2.5).alias("mean_brightness"), (F.col("value") * 2).alias("variance"), (1 + F.col("k") / 20).alias("entropy"), (F.col("value") / 4).alias("std_brightness"),
        (F.col("k") / 100).alias("thermal_gradient"), (F.col("k") % 10 / 10).alias("bright_zone_area"), (F.col("k") % 7 / 7).alias("edge_density"), (F.col("k") % 5 / 5).alias("bright_pixel_ratio"),
        (F.col("k") % 30 / 13).alias("optical_flow_mag"), (F.col("k") / 200_000).alias("texture_roughness"), (F.col("k") % 40 / 300).alias("temporal_change_score"), (F.col("k") % 17 / 400).alias("pixel_diff_mean"), (F.col("k") % 9 / 2).alias("lbp_entropy"),
        F.when(F.col("image_id") % 6 == 0, "cloudy sky").when(F.col("image_id") % 6 == 1, "clear").alias("weather_label"), (F.col("image_id") % 3 != 0).cast("int").alias("predicted"), (F.col("k") / 100).alias("weather_proba"),
    )


INDEX_SQL = r"""moved_ AS (SELECT * REPLACE (ts - to_months((CASE WHEN user_id % 8 = 4 THEN 72 WHEN user_id % 8 = 5 THEN 73 + event_id % 3 WHEN user_id % 8 = 6 AND user_id % 3 <> 2 THEN 100 WHEN user_id % 8 = 7 THEN 109 + event_id % 12 ELSE 0 END)::INT) AS ts) FROM events),
raw_ AS (SELECT *, event_id AS image_id, regexp_extract(props, '[0-9]+')::INT AS k, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second,
    CASE user_id % 3 WHEN 0 THEN 'kalor' WHEN 1 THEN 'suki' ELSE 'kali' END AS camera FROM moved_),
named_ AS (SELECT *, camera || '_Canon_' || strftime(ts, '%Y-%m-%d_%H.%M.%S') || '.jpg' AS filename, strftime(ts, '%Y/%m') AS folder FROM raw_),
idx AS (SELECT image_id, 'http://cams.example/' || folder || '/' || image_id || '/' || filename AS url, filename, camera, 'data/raw/' || folder || '/' || filename AS local_path, '.jpg' AS extension, year, month, day, hour, minute, second,
    CASE WHEN image_id % 29 = 0 THEN NULL WHEN event_type IN ('view', 'purchase') THEN 'usable' WHEN event_type = 'error' THEN 'dark' WHEN event_type = 'click' THEN 'cloudy' ELSE 'corrupted' END AS quality_flag,
    image_id % 5 <> 0 AS downloaded, CASE WHEN image_id % 11 <> 0 THEN 400 + k * 97 END::BIGINT AS file_size_bytes, NOT (hour BETWEEN 6 AND 17) AS is_night,
    CASE WHEN image_id % 7 <> 0 THEN value / 500 END AS anomaly_score, CASE WHEN image_id % 13 <> 0 THEN value END AS patchcore_score,
    (k * 2.5)::DOUBLE AS mean_brightness, value * 2 AS variance, 1 + k / 20 AS entropy, value / 4 AS std_brightness, k / 100 AS thermal_gradient, k % 10 / 10 AS bright_zone_area, k % 7 / 7 AS edge_density, k % 5 / 5 AS bright_pixel_ratio,
    k % 30 / 13 AS optical_flow_mag, k / 200000 AS texture_roughness, k % 40 / 300 AS temporal_change_score, k % 17 / 400 AS pixel_diff_mean, k % 9 / 2 AS lbp_entropy,
    CASE image_id % 6 WHEN 0 THEN 'cloudy sky' WHEN 1 THEN 'clear' END AS weather_label, (image_id % 3 <> 0)::INT AS predicted, k / 100 AS weather_proba FROM named_)"""


#: Documented events that stand in for an event catalogue.
EVENTS = [("2015-09-20", "dome", "minor"), ("2018-01-12", "phreatic", "moderate"), ("2024-01-06", "phreatic", "moderate"), ("2024-01-10", "dome", "minor"), ("2024-01-15", "phreatic", "major"), ("2024-01-20", "lava", "moderate"), ("2024-01-25", "dome", "major"), ("2024-02-01", "phreatic", "minor")]
EVENTS_SQL = "ev AS (SELECT a::DATE AS event_date, b AS event_type, c AS event_intensity FROM (VALUES " + ", ".join(map(str, EVENTS)) + ") AS v(a, b, c))"


def event_catalogue(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(EVENTS, "event_date string, event_type string, event_intensity string")
    return df.withColumn("event_date", F.to_date("event_date"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector read as an 8 x 8 gray frame: image_id, label, pixels scaled to [0, 1]."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("raw"))
    bounds = F.struct(F.array_min("raw").alias("low"), F.array_max("raw").alias("high"))
    scaled = pixel_kernels.let(bounds, lambda b: F.transform("raw", lambda x: F.try_divide(x - b["low"], b["high"] - b["low"])))  # bounds once a frame, not once a pixel
    return e.select("image_id", "label", scaled.alias("pixels"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames one pixel a row: image_id, x, y, v."""
    return pixel_kernels.exploded(frames(spark, sf_dir), "pixels", F.lit(8))


FRAMES_SQL = """fr AS (SELECT vec_id AS image_id, label, [(x::DOUBLE - list_min(embedding)::DOUBLE) / (list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE) for x in embedding] AS pixels FROM embeddings),
px AS (SELECT image_id, (p - 1) % 8 AS x, (p - 1) // 8 AS y, pixels[p] AS v FROM (SELECT image_id, pixels, unnest(range(1, 65)) AS p FROM fr))"""


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patch features: 16 vectors make the 4 x 4 patches of an image."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.floor(F.col("vec_id") / 16).alias("image_id"), (F.col("vec_id") % 16).cast("int").alias("patch_id"), "label", F.col("embedding").alias("features"))
