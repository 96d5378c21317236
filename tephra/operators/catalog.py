"""The image catalogue: upserts, bulk updates, reconciliation with files, gaps.

All joins are equi-joins on the url or file name. The new side is reduced to one
row per key first (the last arrival wins), so no join multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import sliced
from .sample import positions
from .select import first_of


def last_per_key(new: DataFrame, key: str, arrival: Column) -> DataFrame:
    return first_of(new, [key], arrival, last=True)


def upsert(old: DataFrame, new: DataFrame, key: str = "url", arrival: Column | None = None) -> DataFrame:
    """Rows of both by key: non-null new values win, nulls keep the old ones, new keys are added."""
    if arrival is not None:
        new = last_per_key(new, key, arrival)
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    both = [c for c in old.columns if c != key]
    return joined.select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in both])


def fill_scores(index: DataFrame, scores: DataFrame, column: str, order: Column, key: str = "filename") -> DataFrame:
    """Null scores filled by file name; of several scores of a name the first in the order counts."""
    right = first_of(scores.select(key, column), [key], order).select(key, F.col(column).alias("_new"))
    return index.join(right, key, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")


def update(index: DataFrame, changes: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """The columns of changes written over those of the index where they are not null;
    `updated` says which rows had a change."""
    if order is not None:
        changes = first_of(changes, [key], order)
    cols = [c for c in changes.columns if c != key]
    right = changes.select(key, *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_hit"))
    joined = index.join(right, key, "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) if c in index.columns else F.col(f"_{c}") for c in cols} | {"updated": F.coalesce("_hit", F.lit(False))}).drop(*[f"_{c}" for c in cols], "_hit")


def fix_unknown_flags(index: DataFrame, dark: float = 30.0, flat: float = 50.0) -> DataFrame:
    """Flag and is_night recomputed where the flag is unknown, empty or null and there is a
    brightness: dark (by night), cloudy or usable. No variance counts as 0; `fixed` says where."""
    open_ = F.coalesce("quality_flag", F.lit("unknown")).isin("", "unknown") & F.col("mean_brightness").isNotNull()
    night = F.col("mean_brightness") < dark
    flag = F.when(night, "dark").when(F.coalesce("variance", F.lit(0.0)) < flat, "cloudy").otherwise("usable")
    return index.withColumns({"quality_flag": F.when(open_, flag).otherwise(F.col("quality_flag")), "is_night": F.when(open_, night).otherwise(F.col("is_night")), "fixed": open_})


def reconcile(index: DataFrame, files: DataFrame) -> DataFrame:
    """downloaded and file_size_bytes as files(path, length) has them; `changed` where they were different."""
    joined = index.join(files.select(F.col("path").alias("local_path"), F.col("length").alias("_length")), "local_path", "left")
    there = F.col("_length").isNotNull()
    changed = (there != F.coalesce("downloaded", F.lit(False))) | (there & ~F.col("_length").eqNullSafe(F.col("file_size_bytes")))
    return joined.withColumns({"changed": changed, "downloaded": there, "file_size_bytes": F.coalesce("_length", "file_size_bytes")}).drop("_length")


def merge_from_disk(index: DataFrame, files: DataFrame) -> DataFrame:
    """Files with an unknown name are inserted (`inserted`), known ones update their rows."""
    named = files.withColumn("filename", F.regexp_replace("path", "^.*/", ""))
    named = first_of(named, ["filename"], F.col("path"))
    known = index.join(named.select("filename", F.col("length").alias("_length")), "filename", "left")
    known = known.withColumns({"downloaded": F.col("_length").isNotNull() | F.coalesce("downloaded", F.lit(False)), "file_size_bytes": F.coalesce("_length", "file_size_bytes"), "inserted": F.lit(False)}).drop("_length")
    fresh = named.join(index.select("filename").distinct(), "filename", "left_anti")
    fresh = fresh.select("filename", F.col("path").alias("local_path"), F.col("length").alias("file_size_bytes"), F.lit(True).alias("downloaded"), F.lit(True).alias("inserted"))
    return known.unionByName(fresh, allowMissingColumns=True)


def phantoms(index: DataFrame, files: DataFrame) -> DataFrame:
    """Rows that say downloaded without a file."""
    return index.filter("downloaded").join(files.select(F.col("path").alias("local_path")), "local_path", "left_anti")


def first_existing(candidates: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """The first path of candidates(key, paths) that is a file; keys without one are left out."""
    each = candidates.select(key, F.posexplode_outer("paths").alias("pos", "path"))  # the inner one has Spark compute all paths once more, in a filter for empty arrays
    return each.join(files.select("path"), "path", "left_semi").groupBy(key).agg(F.min_by("path", "pos").alias("path"))


def nearest_in_time(points: DataFrame, at: str, rows: DataFrame, when: str, by: list[str]) -> DataFrame:
    """For each point and each group of rows the row nearest in days; the earlier of two as near, then the smallest.

    An as-of join to both sides: rows and points are range-partitioned by day, and in a partition each point sees
    the last row and the next one of every group. What lies outside comes from the first and last rows of the
    partitions, which are carried on to the others. Rows and points without a time are left out."""
    rest = [when, *[c for c in rows.columns if c not in by and c != when]]
    days = rows.select(F.struct(*by).alias("_g"), F.to_date(when).alias("_t"), F.struct(*rest).alias("_row")).filter("_t is not null")
    days = days.groupBy("_g", "_t").agg(F.min("_row").alias("_row"))
    asked = points.select(F.col(at).alias("_at"), F.to_date(at).alias("_t")).filter("_t is not null").distinct()
    placed = sliced(days.unionByName(asked, allowMissingColumns=True), ["_t"])
    there, asks = placed.filter("_g is not null").drop("_at"), placed.filter("_g is null").select("_at", "_t", "_slice")
    last = placed.agg(F.coalesce(F.max("_slice"), F.lit(0))).first()[0]
    row = F.struct("_t", "_row")
    ends = there.groupBy("_g", "_slice").agg(F.min(row).alias("_first"), F.max(row).alias("_last"))
    ends = there.select("_g").distinct().select("_g", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("_slice")).join(ends, ["_g", "_slice"], "left")
    carried = lambda c, order: F.last(c, True).over(W.partitionBy("_g").orderBy(order).rowsBetween(W.unboundedPreceding, -1))  # noqa: E731  slices, not rows
    around = ends.select("_g", "_slice", carried("_last", F.asc("_slice")).alias("_before"), carried("_first", F.desc("_slice")).alias("_after"))
    each = asks.join(around, "_slice").withColumn("_ask", F.lit(1))
    both = each.unionByName(there.join(asks.select("_slice").distinct(), "_slice", "left_semi").withColumn("_ask", F.lit(0)), allowMissingColumns=True)
    seen = lambda order: F.last(F.when(F.col("_ask") == 0, row), True).over(W.partitionBy("_g", "_slice").orderBy(order, "_ask").rowsBetween(W.unboundedPreceding, 0))
    near = both.withColumns({"_lower": seen(F.asc("_t")), "_upper": seen(F.desc("_t"))}).filter("_ask = 1")
    far = lambda x: F.struct(F.abs(F.date_diff("_t", x["_t"])).alias("far"), x["_t"].alias("t"), x["_row"].alias("row"))
    best = F.array_min(F.transform(F.array_compact(F.array("_lower", "_upper", "_before", "_after")), far))
    return near.select(F.col("_at").alias(at), "_g.*", best["row"].alias("_row")).select(at, *by, "_row.*")


def missing_periods(index: DataFrame, first: str, last: str) -> DataFrame:
    """Months from first to last (yyyy-MM-dd) without a downloaded image."""
    spark = index.sparkSession
    months = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 month"))).alias("m")).select(F.year("m").alias("year"), F.month("m").alias("month"))
    return months.join(index.filter("downloaded").select("year", "month").distinct(), ["year", "month"], "left_anti")


def missing_days(index: DataFrame) -> DataFrame:
    """Calendar days between the first and last image without one."""
    days = index.select(F.make_date("year", "month", "day").alias("d")).filter("d is not null").distinct()
    span = days.agg(F.min("d").alias("a"), F.max("d").alias("z")).filter("a is not null").select(F.explode(F.sequence("a", "z")).alias("d"))
    return span.join(days, "d", "left_anti")


def pairwise(df: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """Mean absolute difference of the pairs of each two groups, and inside each group.

    For each pair of groups it is a sum over the values in order: a value is as far above the
    lower ones as it times their number, less their sum. So sorted values with running counts
    and sums replace the pairs, and the work grows with the values times the groups, which are few."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    groups = rows.select(F.col("g").alias("h")).distinct()
    either = rows.join(F.broadcast(groups)).select(F.least("g", "h").alias("a_group"), F.greatest("g", "h").alias("b_group"), "g", "v")
    lower = W.partitionBy("a_group", "b_group").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    of = lambda side, x: F.coalesce(F.sum(F.when(F.col("g") == F.col(side), x)).over(lower), F.lit(0.0))
    other = F.when(F.col("g") == F.col("a_group"), F.col("v") * of("b_group", F.lit(1.0)) - of("b_group", F.col("v"))).otherwise(F.col("v") * of("a_group", F.lit(1.0)) - of("a_group", F.col("v")))
    n = lambda side: F.count_if(F.col("g") == F.col(side))
    out = either.withColumn("far", other).groupBy("a_group", "b_group").agg(F.sum("far").alias("far"), n("a_group").alias("n_a"), n("b_group").alias("n_b"))
    pairs = F.when(F.col("a_group") == F.col("b_group"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b")).cast("long")
    return out.select("a_group", "b_group", pairs.alias("pairs"), (F.col("far") / pairs).alias("mean_difference")).filter("pairs > 0")


def similar_groups(df: DataFrame, group: str, features: str) -> DataFrame:
    """a_group, b_group, pairs, similarity: mean cosine of the pairs of images of each two groups, and inside each group.

    No pair is made: the mean cosine of two groups is the product of the means of their unit vectors, and inside a
    group of n it is (|sum|^2 - n) / (n (n - 1)). Vectors of zeros have no direction and are left out. Sums are one row for
    each group and dimension."""
    length = F.sqrt(F.aggregate(features, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    units = df.select(F.col(group).alias("g"), F.col(features).alias("f"), length.alias("size")).filter("size > 0")
    each = units.select("g", F.posexplode(F.transform("f", lambda x: x.cast("double") / F.col("size"))).alias("i", "u"))
    sums = each.groupBy("g", "i").agg(F.sum("u").alias("s"), F.count(F.lit(1)).alias("n"))
    one, other = sums.toDF("a_group", "i", "sa", "na"), sums.toDF("b_group", "i", "sb", "nb")
    both = one.join(other, "i").filter("a_group <= b_group").groupBy("a_group", "b_group").agg(F.sum(F.col("sa") * F.col("sb")).alias("dot"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    inside = F.col("a_group") == F.col("b_group")
    pairs = F.when(inside, F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb")).cast("long")
    total = F.when(inside, (F.col("dot") - F.col("na")) / 2).otherwise(F.col("dot"))
    return both.select("a_group", "b_group", pairs.alias("pairs"), total.alias("total")).filter("pairs > 0").select("a_group", "b_group", "pairs", (F.col("total") / F.col("pairs")).alias("similarity"))


def zip_by_rank(a: DataFrame, b: DataFrame, key: str, by: str, order: str) -> DataFrame:
    """The i-th row of a with the i-th row of b inside each group, in name order; no task numbers a whole group."""
    ranked = [positions(d.select(by, order, key), [by], [order, key], "rank") for d in (a, b)]
    return ranked[0].select(by, "rank", F.col(key).alias("first")).join(ranked[1].select(by, "rank", F.col(key).alias("second")), [by, "rank"])
