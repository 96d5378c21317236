"""Readers and writers of the catalogue: index CSV, events, scores, file listings, images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions import names
from ..operators.catalog import fill_scores
from ..operators.kernels import gray_of_png
from ..operators.sample import ranks

#: The columns of the index with their types, and the texts that mean null.
INDEX = {
    "url": "string", "filename": "string", "local_path": "string", "extension": "string",
    "year": "int", "month": "int", "day": "int", "hour": "int", "minute": "int", "second": "int",
    "downloaded": "boolean", "file_size_bytes": "bigint", "quality_flag": "string", "is_night": "boolean", "anomaly_score": "double", "notes": "string",
}
NULLS = ["", "None", "nan", "NaN", "NA", "<NA>"]
EVENTS = "date date, type string, intensity string, source string, description string"


def typed(df: DataFrame) -> DataFrame:
    """The index columns cast softly, absent ones added as null; further columns stay as they are."""
    def column(c: str, kind: str) -> Column:
        if c not in df.columns:
            return F.lit(None).cast(kind)
        if df.schema[c].dataType != T.StringType():
            return F.col(c).cast(kind)
        v = F.when(~F.trim(c).isin(NULLS), F.trim(c))
        return v if kind == "string" else v.try_cast("double").try_cast(kind) if kind in ("int", "bigint") else v.try_cast(kind)

    return df.select(*[column(c, k).alias(c) for c, k in INDEX.items()], *[c for c in df.columns if c not in INDEX])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index CSV; a missing or empty file gives an empty index."""
    return typed(safe_read(spark, path))


def safe_read(spark: SparkSession, path: str) -> DataFrame:
    """A CSV as text columns; nothing there, or nothing readable, gives an empty frame."""
    try:
        df = spark.read.option("header", True).option("multiLine", True).option("mode", "PERMISSIVE").csv(path)
        return df if df.columns else spark.createDataFrame([], "url string")
    except AnalysisException:
        return spark.createDataFrame([], "url string")


def enriched(index: DataFrame, scores: DataFrame | None = None, files: DataFrame | None = None, camera: str | None = "kalor") -> DataFrame:
    """Index rows of one camera with gaps filled: dates from the file name, scores from a table
    (filename, patchcore_score), anomaly scores from these; `on_disk` says whether files(path) has the row's."""
    df = names.fill_from_name(index)
    if "patchcore_score" in df.columns and scores is not None:
        df = fill_scores(df, scores, "patchcore_score", F.col("patchcore_score"))
    if "patchcore_score" in df.columns:
        df = df.withColumn("anomaly_score", F.coalesce("anomaly_score", "patchcore_score"))
    if files is not None:
        there = files.select(F.col("path").alias("local_path"), F.lit(True).alias("on_disk")).distinct()
        df = df.join(there, "local_path", "left").withColumn("on_disk", F.coalesce("on_disk", F.lit(False)))
    return df if camera is None else df.filter(F.lower("filename").contains(camera))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).option("header", True).option("escape", "\"").option("mode", "PERMISSIVE").csv(path).filter("date is not null").orderBy("date")


def list_files(spark: SparkSession, path: str, glob: str = "*.{jpg,jpeg,png,JPG,JPEG,PNG}") -> DataFrame:
    """path, length, year, month of the files below path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")
    part = lambda i: F.expr(f"try_cast(nullif(regexp_extract(path, '/([0-9]{{4}})/([0-9]{{1,2}})/[^/]*$', {i}), '') AS int)")
    return files.withColumns({"year": part(1), "month": part(2)})


def discover_months(files: DataFrame) -> DataFrame:
    return files.filter("year is not null").groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, pixels (gray, 0..255 by rows) of the images below path; an image that
    cannot be decoded has null pixels, and files without any bytes are not listed. Spark decodes them; bytes come as blue, green, red."""
    rows = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)

    def gray(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for origin, w, h, c, data in zip(pdf["origin"], pdf["width"], pdf["height"], pdf["nChannels"], pdf["data"], strict=True):
                if h > 0:
                    px = np.frombuffer(data, dtype=np.uint8).reshape(-1, c).astype(np.float64)
                    out.append((origin, w, h, px[:, 0] if c == 1 else px[:, :3] @ [0.114, 0.587, 0.299]))
                else:
                    out.append((origin, None, None, None))
            yield pd.DataFrame(out, columns=["path", "width", "height", "pixels"]).astype({"width": "Int32", "height": "Int32"})

    return rows.select("image.origin", "image.width", "image.height", "image.nChannels", "image.data").mapInPandas(gray, "path string, width int, height int, pixels array<double>")


def decoded(files: DataFrame) -> DataFrame:
    """path, length, width, height, pixels (gray, by rows), error of PNG files(path, content), such as
    the binaryFile source gives; a file that cannot be decoded has its error and null pixels."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    img = gray_of_png(data or b"")
                    out.append((path, len(data), img.shape[1], img.shape[0], img.ravel(), None))
                except ValueError as x:
                    out.append((path, len(data or b""), None, None, None, str(x)))
            yield pd.DataFrame(out, columns=["path", "length", "width", "height", "pixels", "error"]).astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, length long, width int, height int, pixels array<double>, error string")


def audit(read: DataFrame, min_bytes: int = 1024) -> DataFrame:
    """Every file of decoded() with `valid`: large enough and decodable."""
    return read.select("path", "length", "error", ((F.col("length") >= min_bytes) & F.col("error").isNull()).alias("valid"))


def audit_images(spark: SparkSession, path: str, min_bytes: int = 1024) -> DataFrame:
    """Every file below path with its size, whether Spark decodes it, whether it is `valid`, and why not: `short`
    or `damaged`. Rows that are not valid are those to be put aside. Files without any bytes are not listed by Spark."""
    sizes = list_files(spark, path, "*").select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")
    seen = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path).select(F.regexp_replace("image.origin", "^file:/+", "/").alias("path"), (F.col("image.height") > 0).alias("decoded"))
    reason = F.when(F.col("length") < min_bytes, "short").when(~F.coalesce("decoded", F.lit(False)), "damaged")
    return sizes.join(seen, "path", "left").withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def write_files(files: DataFrame, path: str) -> DataFrame:
    """Write files(path, content), names and bytes, below a folder that all executors share; each task writes its own.

    Returns the names and sizes that were written."""

    def run(batches):  # noqa: ANN001, ANN202
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                store.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(data or b"")
            yield pd.DataFrame({"path": pdf["path"], "length": [len(x or b"") for x in pdf["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, length long")


def write_index(index: DataFrame, path: str) -> None:
    """Parquet by year and month; only months present in the frame are replaced. A month with many rows is several tasks and files."""
    order = [F.col(c).asc_nulls_last() for c in ("year", "month", "day", "hour", "minute")]
    index.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)


def read_month(spark: SparkSession, path: str, year: int, month: int) -> DataFrame:
    """One month of a table written by write_index or write_scores; other months are pruned."""
    return spark.read.parquet(path).filter((F.col("year") == year) & (F.col("month") == month))


def write_scores(scores: DataFrame, path: str, form: str = "csv") -> None:
    scores.write.mode("overwrite").option("header", True).format(form).save(path)


def write_jsonl(rows: DataFrame, path: str, key: str) -> None:
    """Caption rows as JSON lines by split and period, with running file names in each, in the order
    of a hash of a whole-number key; no task numbers a whole split."""
    each = ranks(rows.withColumn("_stratum", F.concat_ws("/", "split", "period")), "_stratum", key)
    named = each.withColumn("file_name", F.format_string("%06d.png", F.col("rank") - 1)).drop("_stratum", "rank", "n", key)
    named.write.mode("overwrite").partitionBy("split", "period").json(path)


def named(rows: DataFrame) -> DataFrame:
    """split, period, n, n_names, last_name of rows that write_jsonl wrote. From a million rows on names get longer, so the last is the longest first."""
    last = F.max(F.struct(F.length("file_name").alias("long"), "file_name"))["file_name"]
    return rows.groupBy("split", "period").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_name").alias("n_names"), last.alias("last_name"))
