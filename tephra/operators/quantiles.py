"""Exact, linearly interpolated quantiles without all values of a group in one task.

Spark's own exact percentile keeps a map of all distinct values of a group. Here
values are counted first, and the distinct ones are range-partitioned: a partition is a slice, and
there are as many as the data have. Counts are summed over slices, and only the slice
that holds a wanted rank has to say which value is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import work_path

def sliced(df: DataFrame, order: list) -> DataFrame:
    """df with `_slice`, the number of its range partition in an order; written out, so that the
    numbers stay as they are however often the frame is read."""
    path = work_path(df.sparkSession, "slices")
    out = df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())
    out.write.parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def quantiles(df: DataFrame, value: str, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """by and one column for each wanted quantile; groups without a value are absent."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    placed = sliced(counts, [*by, "_s"])
    totals = placed.groupBy(*by, "_slice").agg(F.sum("_n").alias("_t"))
    of = W.partitionBy(*by)  # slices, not rows
    before = of.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_slice").alias("_of"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"), F.sum("_t").over(of).alias("_all"))
    inside = placed.withColumn("_upto", F.sum("_n").over(W.partitionBy(*by, "_slice").orderBy("_s").rowsBetween(W.unboundedPreceding, 0)))
    same = F.col("_slice") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    ranked = inside.join(starts, same).withColumn("_end", F.col("_start") + F.col("_upto"))  # the value has the ranks _end - _n .. _end - 1
    at = lambda rank: F.max(F.when((rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end")), F.col("_s")))
    ends = []
    for name, q in wanted.items():
        place = F.lit(float(q)) * (F.col("_all") - 1)
        ends += [at(F.floor(place)).alias(f"_{name}_lo"), at(F.ceil(place)).alias(f"_{name}_hi"), F.max(place - F.floor(place)).alias(f"_{name}_f")]
    out = ranked.groupBy(*by).agg(*ends)
    return out.select(*by, *[(F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n) for n in wanted])
