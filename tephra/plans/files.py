"""Queries that write tables and files and read them back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import captions, dates
from ..functions.rounding import rounded
from ..operators import kernels, models, sample
from ..sources import catalog_files as files
from ..sources.work import work_path, written
from ..streaming import ingest as stream
from . import views
from .registry import query
from .scores import weather_rows
from .views import index

_TYPED = "image_id, url, year, month, day, downloaded, file_size_bytes, is_night"


@query(f"SELECT {_TYPED}, anomaly_score, NULL::VARCHAR AS notes FROM idx")
def read_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written as text, with texts for null, and read with its types."""
    path = work_path(spark, "index.csv")
    df = index(spark, sf_dir)
    text = df.withColumns({"anomaly_score": F.coalesce(F.col("anomaly_score").cast("string"), F.lit("nan")), "file_size_bytes": F.concat(F.col("file_size_bytes").cast("string"), F.lit(".0")), "is_night": F.initcap(F.col("is_night").cast("string"))})
    text.select(_TYPED.split(", ") + ["anomaly_score"]).write.option("header", True).csv(path)
    out = files.read_index(spark, path)
    return out.select(F.col("image_id").cast("long").alias("image_id"), *_TYPED.split(", ")[1:], "anomaly_score", "notes")


_LOG = ", e AS (SELECT make_date(year, month, day) AS date, event_type AS type, k, image_id FROM idx JOIN (SELECT event_id AS image_id, event_type, regexp_extract(props, '[0-9]+')::INT AS k FROM events) USING (image_id) WHERE quality_flag = 'dark')"


@query(_LOG + " SELECT date, type, CASE WHEN k > 50 THEN 'major' ELSE 'minor' END AS intensity, 'é, \"' || image_id || '\"' AS description FROM e WHERE image_id % 10 <> 3")
def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark images as an event log in CSV, with quoted texts and dates that cannot be read."""
    path = work_path(spark, "events.csv")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("image_id"), "event_type", F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"))
    rows = index(spark, sf_dir).filter("quality_flag = 'dark'").join(events, "image_id")
    date = F.when(F.col("image_id") % 10 == 3, "unknown").otherwise(F.make_date("year", "month", "day").cast("string"))
    text = F.concat(F.lit('é, "'), F.col("image_id").cast("string"), F.lit('"'))
    rows.select(date.alias("date"), F.col("event_type").alias("type"), F.when(F.col("k") > 50, "major").otherwise("minor").alias("intensity"), F.lit("log").alias("source"), text.alias("description")).write.option("header", True).option("escape", '"').csv(path)
    return files.read_events(spark, path).select("date", "type", "intensity", "description")


@query()
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The input tables' own files, without reading them."""
    return files.list_files(spark, sf_dir, "*.parquet").select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length")


@query("SELECT year, month, count(*) AS n FROM idx WHERE downloaded GROUP BY ALL")
def discover_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.discover_months(index(spark, sf_dir).filter("downloaded"))


@query(f"SELECT {_TYPED} FROM idx")
def write_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "index")
    files.write_index(index(spark, sf_dir).select(_TYPED.split(", ") + ["hour", "minute"]), path)
    return spark.read.parquet(path).select(_TYPED.split(", "))


@query("SELECT image_id, camera, patchcore_score FROM idx WHERE year = 2024 AND month = 1")
def read_month_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "scores")
    files.write_index(index(spark, sf_dir).select("image_id", "camera", "patchcore_score", "year", "month", "day", "hour", "minute"), path)
    return files.read_month(spark, path, 2024, 1).select("image_id", "camera", "patchcore_score")


@query("SELECT filename, patchcore_score FROM idx")
def write_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "scores.csv")
    files.write_scores(index(spark, sf_dir).select("filename", "patchcore_score"), path)
    return spark.read.option("header", True).schema("filename string, patchcore_score double").csv(path)


@query("SELECT camera, count(*) AS n FROM idx GROUP BY camera")
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "export.csv")
    files.write_scores(index(spark, sf_dir).groupBy("camera").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.option("header", True).schema("camera string, n long").csv(path)


@query(", r AS (SELECT filename, is_night, row_number() OVER (PARTITION BY is_night ORDER BY (image_id * 2654435761 + 42) % 4294967296, image_id) AS r, count(*) OVER (PARTITION BY is_night) AS n FROM idx) SELECT CASE WHEN r <= greatest(1, floor(n * 0.1)) THEN 'val' ELSE 'train' END AS split, CASE WHEN is_night THEN 'night' ELSE 'day' END AS period, count(*) AS n, count(*) AS n_names, printf('%06d.png', (count(*) - 1)::INT) AS last_name FROM r GROUP BY ALL")
def write_jsonl_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "captions")
    rows = sample.train_val(index(spark, sf_dir), "is_night", "image_id", 0.1)
    text = captions.short_caption(dates.is_day(F.col("hour")), "the volcano")
    files.write_jsonl(rows.select("image_id", "split", F.when(F.col("is_night"), "night").otherwise("day").alias("period"), text.alias("text"), F.concat_ws("#", "filename", "image_id").alias("original_filename"), "year", "month"), path, "image_id")
    back = spark.read.schema("file_name string, text string, split string, period string").json(path)
    return files.named(back)


@query("SELECT camera AS part, count(*) AS n, count(anomaly_score) AS scored FROM idx WHERE camera <> 'kali' GROUP BY camera UNION ALL SELECT 'kali', 0, 0")
def safe_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each camera but one, which counts as empty as it is not there."""
    path, out = work_path(spark, "parts"), None
    index(spark, sf_dir).filter("camera != 'kali'").select("camera", "url", "anomaly_score").write.partitionBy("camera").option("header", True).csv(path)
    for camera in ("kalor", "suki", "kali"):
        df = files.typed(files.safe_read(spark, f"{path}/camera={camera}"))
        one = df.agg(F.count(F.lit(1)).alias("n"), F.count("anomaly_score").alias("scored")).select(F.lit(camera).alias("part"), "n", "scored")
        out = one if out is None else out.union(one)
    return out


_PNG = ", g AS (SELECT image_id, floor(v * 255) AS g FROM px), t AS (SELECT image_id, avg(CASE WHEN image_id % 2 = 0 THEN g ELSE 0.299 * g + 0.587 * (255 - g) + 0.114 * floor(g / 2) END) AS mean FROM g GROUP BY image_id)"


def png_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames as PNG files, gray or in colour, some cut off and some of another kind: path, content."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for i, px in zip(pdf["image_id"], pdf["pixels"], strict=True):
                g = np.floor(np.asarray(px) * 255).reshape(8, 8)
                data = kernels.png_of(g if i % 2 == 0 else np.stack([g, 255 - g, g // 2], axis=2))
                out.append((f"frame/{i}.png", data[:60] if i % 10 == 3 else b"GIF89a" if i % 10 == 7 else data))
            yield pd.DataFrame(out, columns=["path", "content"])

    return views.frames(spark, sf_dir).select("image_id", "pixels").mapInPandas(run, "path string, content binary")


def image_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder in the shared one with the PNG files."""
    path = work_path(spark, "images")
    written(files.write_files(png_files(spark, sf_dir), path), "names")
    return path


_NAME = "regexp_extract(path, '(frame/[0-9]+[.]png)$', 1)"


@query(_PNG + " SELECT 'frame/' || image_id || '.png' AS path, CASE WHEN image_id % 10 NOT IN (3, 7) THEN 8 END::INT AS width, CASE WHEN image_id % 10 NOT IN (3, 7) THEN 8 END::INT AS height, CASE WHEN image_id % 10 NOT IN (3, 7) THEN round(mean, 6) END AS mean FROM t", views.FRAMES_SQL)
def read_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray levels of the image files of a folder, read by Spark's image source; one that cannot be decoded has none."""
    mean = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x) / F.size("pixels")
    return files.read_images(spark, image_folder(spark, sf_dir)).select(F.expr(_NAME).alias("path"), "width", "height", rounded(mean, 6).alias("mean"))


@query(_PNG + " SELECT 'frame/' || image_id || '.png' AS path, image_id % 10 NOT IN (3, 7) AS valid, CASE image_id % 10 WHEN 3 THEN 'damaged' WHEN 7 THEN 'short' END AS reason FROM t", views.FRAMES_SQL)
def audit_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files of a folder are whole images of a least size, and what is wrong with the others."""
    return files.audit_images(spark, image_folder(spark, sf_dir), min_bytes=40).select(F.expr(_NAME).alias("path"), "valid", "reason")


@query()
def model_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a model that was written and read back."""
    rows = weather_rows(spark, sf_dir)
    path = work_path(spark, "model")
    models.save(models.weather_candidates()["linear_1"].fit(rows.filter("label is not null")), path)
    return models.weather_predict(models.load(path), rows.filter("quality_flag = 'usable'"), ["image_id"]).withColumn("weather_proba", rounded("weather_proba", 4))


@query("SELECT url, CASE WHEN image_id % 4 = 0 THEN 'dark' ELSE quality_flag END AS quality_flag FROM idx")
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index in two arrivals, merged as a stream; the second corrects some rows."""
    path, table = work_path(spark, "arrivals"), work_path(spark, "stream")
    df = index(spark, sf_dir).select("url", "quality_flag", "year", "month", "image_id")
    first = df.withColumn("arrival", F.lit(1)).drop("image_id")
    second = df.filter("image_id % 4 = 0").withColumns({"quality_flag": F.lit("dark"), "arrival": F.lit(2)}).drop("image_id")
    for part in (first, second):
        part.write.mode("append").parquet(path)
    query_ = stream.ingest(stream.arrivals(spark, path, first.schema), table, work_path(spark, "offsets"))
    query_.awaitTermination()
    return spark.read.parquet(table).select("url", "quality_flag")
