"""Classes of linked labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import written
from .sample import alike


def merged(links: DataFrame, by: str, rounds: int = 60) -> DataFrame:
    """(by, label, root) for every label in links(by, a, b) between labels of one `by`; root is the smallest label of the class.

    Each round hangs the larger neighbours of a label on the smallest label around it, and then all smaller ones: a class becomes a
    star in about as many rounds as the logarithm of its diameter. Minima are aggregated before they are joined back, so
    no task holds the links of one label. Every round is written, which cuts the lineage."""
    pairs = links.select(by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    pairs, before = written(pairs, "links"), None
    for _ in range(rounds):
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64(by, "a", "b").bitwiseAND(0xFFFFFFFF))).first())
        if now == before or not now[0]:
            return pairs.select(by, F.col("a").alias("label"), F.col("b").alias("root")).unionByName(pairs.select(by, F.col("b").alias("label"), F.col("b").alias("root")).distinct())
        before = now
        around = pairs.unionByName(pairs.select(by, F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy(F.col(by).alias(f"_by_{by}"), F.col("a").alias("_by_a")).agg(F.least(F.min("b"), F.col("a")).alias("m"))
        up = written(around.filter("b > a").join(least, alike([by, "a"])).select(by, F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "up")
        low = up.groupBy(F.col(by).alias(f"_by_{by}"), F.col("a").alias("_by_a")).agg(F.min("b").alias("m"))
        own = low.select(F.col(f"_by_{by}").alias(by), F.col("_by_a").alias("a"), F.col("m").alias("b"))
        down = up.join(low, alike([by, "a"])).select(by, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
        pairs = written(down.filter("a != b").distinct(), "down")
    raise RuntimeError(f"labels did not settle in {rounds} rounds")
