"""Catalogue rows that arrive as a stream, merged into the table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import upsert


def arrivals(spark: SparkSession, path: str, schema) -> DataFrame:  # noqa: ANN001
    """New index files below path as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(path)


def ingest(stream: DataFrame, table: str, checkpoint: str, key: str = "url", arrival: str = "arrival") -> StreamingQuery:
    """Merge what has arrived into the table and stop.

    Each batch rewrites only the months it touches: their rows are read, the batch is
    upserted by key, and the result goes to a new version of those partitions. A batch
    that is replayed after a failure gives the same table, as an upsert is idempotent."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.drop("year", "month").columns
        try:
            old = spark.read.parquet(table)
        except Exception as x:  # noqa: BLE001  no table yet
            if "PATH_NOT_FOUND" not in str(x) and "UNABLE_TO_INFER_SCHEMA" not in str(x):
                raise
            old = batch.drop(arrival).limit(0)
        months = F.broadcast(batch.select("year", "month").distinct())  # months of one batch
        touched = old.join(months, ["year", "month"], "left_semi")
        merged = upsert(touched, batch.select(*new, "year", "month"), key, F.col(arrival))
        # written aside first: the old files are read while the new ones are made
        aside = f"{checkpoint}/batch-{number}"
        merged.write.mode("overwrite").partitionBy("year", "month").parquet(aside)
        out = spark.read.parquet(aside)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(table)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_activity(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Images and mean score by camera and hour, closed once the watermark has passed."""
    return stream.withWatermark("taken_at", late).groupBy(F.window("taken_at", "1 hour"), "camera").agg(F.count(F.lit(1)).alias("n"), F.avg("patchcore_score").alias("mean_score"))
