"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

#: Spark's setting by which the shuffle files of a query go when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    A cluster has to name one. Only in local mode, as in tests, a temporary folder
    of this application's own stands in for it.
    """
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_dirs[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks that it held, not
    the plan above this point.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/work/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def cut_tidy(df: DataFrame, name: str) -> DataFrame:
    """cut(), with the shuffle files behind the table deleted once it is written.

    Otherwise they stay until the driver collects garbage, so that those of several large steps lie beside each other."""
    conf = df.sparkSession.conf
    before = conf.get(TIDY, None)
    conf.set(TIDY, "true")
    try:
        return cut(df, name)
    finally:
        conf.unset(TIDY) if before is None else conf.set(TIDY, before)


def discard(*cuts: DataFrame) -> None:
    """Delete tables that cut() wrote once later tables have replaced them."""
    for df in cuts:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 32_000_000) -> DataFrame:
    """Hint a broadcast only if df, counted and then measured here, is within both bounds.

    Beyond them the frame comes back without a hint: Spark then shuffles both
    sides and splits skewed keys at run time, with the same result. df should
    be a table that cut() wrote, so that counting it costs nothing.
    """
    if df.count() > max_rows:
        return df
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()[0]
    return F.broadcast(df) if (size or 0) <= max_bytes else df


def met(rows: DataFrame, side: DataFrame, key: str, count: str, most: int = 100_000) -> DataFrame:
    """The inner join of rows with side, which has one row per key and says in `count` how many rows have it.

    A hot key never lands in one task. Keys with over a 1/most of all rows, and over
    10,000, are broadcast; there are fewer than `most` of them, whatever the size of
    the tables. The other keys shuffle, and none of them is hot. side should be
    a table that cut() wrote.
    """
    if (few := small(side, most)) is not side:
        return rows.join(few, key)
    hot = F.col(count) > max(10_000, (side.agg(F.sum(count)).first()[0] or 0) // most)
    often = side.filter(hot)
    seldom = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(side.filter(~hot), key)
    return rows.join(F.broadcast(often), key).unionByName(seldom)


def unmet(rows: DataFrame, side: DataFrame, key: str, count: str, most: int = 100_000) -> DataFrame:
    """The rows whose key side does not have; the counterpart of met()."""
    keys = side.select(key, count)
    if (few := small(keys, most)) is not keys:
        return rows.join(few.select(key), key, "left_anti")
    hot = F.col(count) > max(10_000, (keys.agg(F.sum(count)).first()[0] or 0) // most)
    return rows.join(F.broadcast(keys.filter(hot).select(key)), key, "left_anti").join(keys.filter(~hot).select(key), key, "left_anti")


def sampled(docs: DataFrame, n: int, condition: Column | None = None, over: int = 8) -> DataFrame:
    """(text, h): at most n distinct texts, those of the lowest hashes that meet a condition on `text`.

    Rows that meet the condition are counted first. Of these, only those whose hash is among the lowest, a share that about
    over * n of them have, are looked at. Hashes alone go through one task, over * n or so of them; copies count once.
    """
    share = over * n / max(1, (docs if condition is None else docs.filter(condition)).count())
    bound = (1 << 63) - 1 if share >= 1 else int(share * (1 << 64)) - (1 << 63)
    few = docs.select("text", F.xxhash64("text").alias("h")).filter(F.col("text").isNotNull() & (F.col("h") <= bound))
    few = cut((few if condition is None else few.filter(condition)).dropDuplicates(["h"]), "sample")
    last = few.select("h").orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return few.filter(F.col("h") <= F.lit(last).cast("long"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def hash_of(column: str) -> Column:
    """A whole number below 2**24 that any SQL engine can compute from a string."""
    return F.conv(F.substring(F.md5(F.col(column)), 1, 6), 16, 10).cast("long")


def packed(docs: DataFrame, **work: Column) -> DataFrame:
    """The input row as one struct beside working columns, so that no input name can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in work.items()])


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """row (all columns as a struct) and uid, a key of the row that stays the same however often
    the frame is computed.

    Rows of Parquet files have one already, the file and the position in it, so nothing is
    copied. Any other frame is written out with a number for each row."""
    columns = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    plan = docs._jdf.queryExecution().analyzed().toString().strip().split("\n")
    scan = len(plan) > 0 and re.match(r"[ :+-]*Relation.* parquet$", plan[-1]) and all(re.match(r"[ :+-]*(Project|Filter|SubqueryAlias) ", x) for x in plan[:-1])
    if scan and "_metadata" not in docs.columns:  # one row of a file for each row, as nothing multiplies or merges them
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return docs.select(columns, place.alias("uid"))
    number = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))
    return cut(docs.select(columns, number.alias("uid")), name)


def running(df: DataFrame, key: str, count: str, order: list[str], name: str, value: Column | None = None, run: int = 32) -> DataFrame:
    """Add the sum of `value` (1 if not given: a gapless 0-based position) over the
    earlier rows of the same key, in an order whose first column is a hash.

    No task gets a whole key: a key of `count` rows (a column) is dealt by its
    hash into runs of about `run` rows, or of a quarter of the square root of `count` if that is
    more, so neither a run nor the list of a key's runs gets long. Sums are taken
    inside a run, and each run starts where the totals of the earlier runs end. The
    order should be total, then reruns agree.
    """
    value = F.lit(1).cast("long") if value is None else value
    runs = F.greatest(F.ceil(F.col(count) / F.greatest(F.lit(run), F.sqrt(count) / 4)), F.lit(1))
    # said outright, as rows that a join has left dealt by the key alone would be taken to suit the windows
    dealt = df.withColumns({"_run": F.pmod(F.shiftrightunsigned(F.col(order[0]), 17), runs), "_value": value}).repartition(F.col(key), F.col("_run"))
    before = W.partitionBy(key).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.groupBy(key, "_run").agg(F.sum("_value").alias("_total")).select(key, "_run", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("_value").over(W.partitionBy(key, "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_at", inside).join(starts, [key, "_run"]).withColumn(name, F.col("_start") + F.col("_at")).drop("_run", "_start", "_at", "_value")
