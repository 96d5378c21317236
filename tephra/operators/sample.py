"""Ranks, caps and reproducible samples.

Samples order rows by a multiplicative hash of a key, so the same rows come back
on every run and on every engine. Global samples of n rows use a top-k, which
keeps n rows per task. Positions in an order, and ranks of scores, are taken in range partitions of
that order, which start where the earlier ones end. Strata are ranked in slices of the hash: as many as the square root of
their rows asks for, so that neither a slice nor the list of the slices gets long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import sliced


def hashed(key: str, seed: int = 42) -> Column:
    return (F.col(key) * 2654435761 + seed) % 4294967296


def alike(columns: list[str]) -> Column:
    """Whether `c` and `_by_c` are the same for each of the columns, nulls too."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return same


def starting(counts: DataFrame, by: list[str]) -> DataFrame:
    """Of counts(by, _part, _c) how many rows come before each part, as (_by_..., _of, _start)."""
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # parts, not rows
    return counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_of"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))


def rank_min(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """`rank` in each group by falling score, the smallest of its tie; nulls come last.

    Rows are counted by score first, so ties are one row, and ranks are sums over range partitions of the scores."""
    scores = sliced(df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_c")), [*by, F.desc(score)]).withColumnRenamed("_slice", "_part")
    starts = starting(scores.groupBy(*by, "_part").agg(F.sum("_c").alias("_c")), by)
    higher = F.coalesce(F.sum("_c").over(W.partitionBy(*by, "_part").orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = scores.withColumn("_at", higher).join(starts, alike(by) & F.col("_part").eqNullSafe(F.col("_of")))
    ranked = placed.select(*[F.col(c).alias(f"_by_{c}") for c in (*by, score)], (F.col("_start") + F.col("_at") + 1).alias("rank"))
    return df.join(ranked, alike([*by, score])).select(*df.columns, "rank")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, slices: int) -> DataFrame:
    """Positions from 1 in each group. The first `slices` columns of the order, such as the
    date, cut a group into parts that are numbered apart and start where the earlier end."""
    cut = df.withColumn("_part", F.struct(*[F.col(c) for c in order[:slices]]))
    return in_parts(cut, by, order[slices:], name).select(*df.columns, name)


def in_parts(cut: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Positions from 1 in each group of rows that say their `_part`, in an order inside the parts."""
    starts = starting(cut.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_c")), by)
    inside = cut.withColumn("_at", F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order)))
    return inside.join(starts, alike(by) & F.col("_part").eqNullSafe(F.col("_of"))).withColumn(name, F.col("_start") + F.col("_at"))


def positions(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Positions from 1 in each group, where no column of the order cuts it into parts: range partitions of the order do."""
    cut = sliced(df, [*by, *order]).withColumnRenamed("_slice", "_part")
    return in_parts(cut, by, order, name).select(*df.columns, name)


def sample_n(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(hashed(key), key).limit(n)


def ranks(df: DataFrame, by: str, key: str) -> DataFrame:
    """`rank` (from 1) of each row in its stratum by hash, and `n`, the rows of the stratum; no task
    numbers a whole stratum, whatever its size. A null stratum is one like any other."""
    h = hashed(key)
    sizes = df.groupBy(F.col(by).alias("_of")).agg(F.count(F.lit(1)).alias("n"))
    sized = df.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, F.col(by).eqNullSafe(F.col("_of")))
    width = 4294967296 / F.greatest(F.ceil(F.sqrt("n")), F.lit(1))
    cut = sized.withColumns({"_h": h, "_slice": F.floor(h / width)})
    counts = cut.groupBy("_of", "_slice").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy("_of").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("_of").alias("_by"), F.col("_slice").alias("_at_slice"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    inside = cut.withColumn("_at", F.row_number().over(W.partitionBy("_of", "_slice").orderBy("_h", key)))
    out = inside.join(starts, F.col("_of").eqNullSafe(F.col("_by")) & (F.col("_slice") == F.col("_at_slice")))
    return out.select(*df.columns, "n", (F.col("_start") + F.col("_at")).alias("rank"))


def stratified(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """n rows of each stratum."""
    return ranks(df, by, key).filter(F.col("rank") <= n).drop("rank", "n")


def lowest(df: DataFrame, by: str, key: str, wanted: Column) -> DataFrame:
    """`wanted`: whether a row's rank in its stratum is within a bound, which may use n, the stratum's row count."""
    return ranks(df, by, key).withColumn("wanted", F.col("rank") <= wanted).drop("rank", "n")


def train_val(df: DataFrame, by: str, key: str, ratio: float) -> DataFrame:
    out = lowest(df, by, key, F.greatest(F.lit(1), F.floor(F.col("n") * ratio)))
    return out.withColumn("split", F.when(F.col("wanted"), "val").otherwise("train")).drop("wanted")


def coreset(df: DataFrame, key: str, share: float = 0.15, least: int = 500) -> DataFrame:
    out = lowest(df.withColumn("_all", F.lit(0)), "_all", key, F.least(F.col("n"), F.greatest(F.lit(least), F.floor(F.col("n") * share))))
    return out.filter("wanted").drop("wanted", "_all")
