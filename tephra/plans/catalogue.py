"""Queries of the catalogue: joins, upserts, reconciliation, windows, samples, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import levels, names
from ..functions.rounding import rounded
from ..operators import catalog, sample, select
from .derived import CATEGORIES_SQL, CLASSED_SQL
from .registry import query
from .views import EVENTS_SQL, event_catalogue, index

_NEW = """, old AS (SELECT url, filename, quality_flag, file_size_bytes FROM idx WHERE image_id % 3 <> 0), new_ AS (SELECT url, filename, CASE WHEN image_id % 2 = 0 THEN 'usable' END AS quality_flag, CASE WHEN image_id % 4 <> 0 THEN file_size_bytes + 1 END AS file_size_bytes, image_id + 5 AS arrival FROM idx WHERE image_id % 3 = 0 OR image_id % 5 = 0
UNION ALL SELECT url, filename, 'dark', NULL, image_id FROM idx WHERE image_id % 15 = 0), n AS (SELECT * FROM new_ QUALIFY row_number() OVER (PARTITION BY url ORDER BY arrival DESC) = 1)"""


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df, i = index(spark, sf_dir), F.col("image_id")
    old = df.filter(i % 3 != 0).select("url", "filename", "quality_flag", "file_size_bytes")
    new = df.filter((i % 3 == 0) | (i % 5 == 0)).select("url", "filename", F.when(i % 2 == 0, "usable").alias("quality_flag"), F.when(i % 4 != 0, F.col("file_size_bytes") + 1).alias("file_size_bytes"), (i + 5).alias("arrival"))
    again = df.filter(i % 15 == 0).select("url", "filename", F.lit("dark").alias("quality_flag"), F.lit(None).cast("long").alias("file_size_bytes"), i.alias("arrival"))
    return old, new.union(again)


@query(_NEW + " SELECT url, coalesce(n.filename, old.filename) AS filename, coalesce(n.quality_flag, old.quality_flag) AS quality_flag, coalesce(n.file_size_bytes, old.file_size_bytes) AS file_size_bytes FROM old FULL JOIN n USING (url)")
def upsert_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.upsert(*_old_new(spark, sf_dir), arrival=F.col("arrival"))


_SCORES = ", sc AS (SELECT filename, patchcore_score AS s, image_id FROM idx WHERE patchcore_score IS NOT NULL AND image_id % 2 = 0), one AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY filename ORDER BY s) = 1)"


@query(_SCORES + " SELECT image_id, coalesce(anomaly_score, s) AS anomaly_score FROM idx LEFT JOIN (SELECT filename, s FROM one) USING (filename)")
def map_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir)
    scores = df.filter("patchcore_score is not null and image_id % 2 = 0").select("filename", F.col("patchcore_score").alias("anomaly_score"))
    return catalog.fill_scores(df, scores, "anomaly_score", F.col("anomaly_score")).select("image_id", "anomaly_score")


@query("SELECT image_id, CASE WHEN image_id % 10 = 0 THEN 'checked' ELSE quality_flag END AS quality_flag, image_id % 10 = 0 AS updated FROM idx")
def update_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir)
    changes = df.filter("image_id % 10 = 0").select("url", F.lit("checked").alias("quality_flag"))
    return catalog.update(df, changes, "url").select("image_id", "quality_flag", "updated")


_BULK = ", ch AS (SELECT filename, CASE WHEN image_id % 2 = 0 THEN 'cloudy' END AS f, mean_brightness + 1 AS m, image_id FROM idx WHERE image_id % 4 = 0), o AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY filename ORDER BY image_id) = 1)"


@query(_BULK + " SELECT count(*) AS n_rows, count(*) FILTER (o.filename IS NOT NULL) AS n_updated, count(*) FILTER (coalesce(f, quality_flag) = 'cloudy') AS n_cloudy, round(sum(coalesce(m, mean_brightness)), 3) AS brightness FROM idx LEFT JOIN o ON idx.filename = o.filename")
def update_quality_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir)
    changes = df.filter("image_id % 4 = 0").select("filename", F.when(F.col("image_id") % 2 == 0, "cloudy").alias("quality_flag"), (F.col("mean_brightness") + 1).alias("mean_brightness"), F.col("image_id").alias("seen"))
    done = catalog.update(df, select.first_of(changes, ["filename"], F.col("seen")).drop("seen"), "filename")
    return done.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("updated").alias("n_updated"), F.count_if(F.col("quality_flag") == "cloudy").alias("n_cloudy"), rounded(F.sum("mean_brightness"), 3).alias("brightness"))


_OPEN = """, g AS (SELECT *, CASE WHEN image_id % 9 = 1 THEN 'unknown' WHEN image_id % 9 = 2 THEN '' ELSE quality_flag END AS f, CASE WHEN image_id % 5 <> 3 THEN mean_brightness END AS m, CASE WHEN image_id % 4 <> 1 THEN variance END AS v FROM idx),
o AS (SELECT *, coalesce(f, 'unknown') IN ('', 'unknown') AND m IS NOT NULL AS fixed FROM g)"""


@query(_OPEN + " SELECT image_id, CASE WHEN fixed THEN CASE WHEN m < 30 THEN 'dark' WHEN coalesce(v, 0) < 50 THEN 'cloudy' ELSE 'usable' END ELSE f END AS quality_flag, CASE WHEN fixed THEN m < 30 ELSE is_night END AS is_night, fixed FROM o")
def fix_unknown_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, i = index(spark, sf_dir), F.col("image_id")
    open_ = df.withColumns({"quality_flag": F.when(i % 9 == 1, "unknown").when(i % 9 == 2, "").otherwise(F.col("quality_flag")), "mean_brightness": F.when(i % 5 != 3, F.col("mean_brightness")), "variance": F.when(i % 4 != 1, F.col("variance"))})
    return catalog.fix_unknown_flags(open_).select("image_id", "quality_flag", "is_night", "fixed")


def _path_of(i: Column) -> Column:
    return F.when(i % 50 == 1, F.concat(F.lit("data/raw/2024/01/new_"), "filename")).otherwise(F.col("local_path"))


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing that stands in for the disk: most images, some with another size, some unknown ones."""
    df, i = index(spark, sf_dir), F.col("image_id")
    one = select.first_of(df.filter(i % 7 != 0).select("image_id", "local_path", "filename", "file_size_bytes"), ["local_path"], i)
    size = F.when(i % 3 == 0, 2000 + i % 100).otherwise(F.coalesce("file_size_bytes", F.lit(700)))
    return one.select(_path_of(i).alias("path"), size.cast("long").alias("length"))


def paths_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of files_of alone. A path ends with its file name, so the least number is all that a group keeps, and nothing is sorted."""
    df, i = index(spark, sf_dir), F.col("image_id")
    one = df.filter(i % 7 != 0).groupBy("local_path", "filename").agg(F.min("image_id").alias("image_id"))
    return one.select(_path_of(i).alias("path"))


_FILES = ", disk AS (SELECT CASE WHEN image_id % 50 = 1 THEN 'data/raw/2024/01/new_' || filename ELSE local_path END AS path, CASE WHEN image_id % 3 = 0 THEN 2000 + image_id % 100 ELSE coalesce(file_size_bytes, 700) END AS length FROM (SELECT * FROM idx WHERE image_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY local_path ORDER BY image_id) = 1))"


@query(_FILES + " SELECT image_id, length IS NOT NULL AS downloaded, coalesce(length, file_size_bytes) AS file_size_bytes, ((length IS NOT NULL) <> downloaded) OR (length IS NOT NULL AND length IS DISTINCT FROM file_size_bytes) AS changed FROM idx LEFT JOIN disk ON path = local_path")
def reconcile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.reconcile(index(spark, sf_dir), files_of(spark, sf_dir)).select("image_id", "downloaded", "file_size_bytes", "changed")


@query(_FILES + ", d AS (SELECT *, regexp_replace(path, '^.*/', '') AS name FROM disk QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '^.*/', '') ORDER BY path) = 1) SELECT filename, coalesce(length, file_size_bytes) AS file_size_bytes, length IS NOT NULL OR downloaded AS downloaded, false AS inserted FROM idx LEFT JOIN d ON name = filename UNION ALL SELECT name, length, true, true FROM d WHERE name NOT IN (SELECT filename FROM idx)")
def merge_from_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.merge_from_disk(index(spark, sf_dir), files_of(spark, sf_dir)).select("filename", "file_size_bytes", "downloaded", "inserted")


@query(_FILES + " SELECT image_id FROM idx WHERE downloaded AND local_path NOT IN (SELECT path FROM disk)")
def phantom_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.phantoms(index(spark, sf_dir), files_of(spark, sf_dir)).select("image_id")


@query(_FILES + ", c AS (SELECT image_id, unnest([regexp_replace(replace(local_path, 'data/raw/', 'data/processed/'), '\\.[^./]*$', '.png'), local_path]) AS path, unnest([0, 1]) AS pos FROM idx) SELECT image_id, arg_min(path, pos) AS path FROM c WHERE path IN (SELECT path FROM disk) GROUP BY image_id")
def path_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = index(spark, sf_dir).select("image_id", names.path_candidates(F.col("local_path"), F.col("filename")).alias("paths"))
    return catalog.first_existing(c, paths_of(spark, sf_dir), "image_id")


@query(", f AS (SELECT DISTINCT filename, 1 AS has FROM idx WHERE image_id % 6 <> 0 AND quality_flag = 'usable') SELECT count(*) AS n_rows, count(has) AS n_joined, count(*) FILTER (has IS NULL) AS n_missing FROM idx LEFT JOIN f USING (filename)")
def features_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir)
    features = df.filter("image_id % 6 != 0 and quality_flag = 'usable'").select("filename", F.lit(1).alias("has")).dropDuplicates(["filename"])
    joined = df.join(features, "filename", "left")
    return joined.agg(F.count(F.lit(1)).alias("n_rows"), F.count("has").alias("n_joined"), F.count_if(F.col("has").isNull()).alias("n_missing"))


@query("SELECT image_id, CASE quality_flag WHEN 'dark' THEN 1 ELSE 0 END AS y_true, predicted AS y_pred FROM idx WHERE quality_flag IN ('dark', 'cloudy')")
def labels_predictions_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir)
    labelled = df.drop("predicted").withColumn("y_true", levels.label_from_flag(F.col("quality_flag"))).filter("y_true is not null")
    return labelled.join(df.select("image_id", F.col("predicted").alias("y_pred")), "image_id").select("image_id", "y_true", "y_pred")


@query(", l AS (SELECT DISTINCT filename FROM idx WHERE quality_flag IN ('dark', 'cloudy')), f AS (SELECT DISTINCT filename FROM idx WHERE image_id % 4 = 0) SELECT count(*) AS n_common, count(*) < 20 AS stale FROM l WHERE filename IN (SELECT filename FROM f)")
def coverage_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir)
    labelled = df.filter("quality_flag in ('dark', 'cloudy')").select("filename").distinct()
    return labelled.join(df.filter("image_id % 4 = 0").select("filename"), "filename", "left_semi").agg(F.count(F.lit(1)).alias("n_common"), (F.count(F.lit(1)) < 20).alias("stale"))


@query(f", {EVENTS_SQL}, md AS (SELECT camera, make_date(year, month, 1) AS m, max(patchcore_score) AS max_score FROM idx WHERE patchcore_score IS NOT NULL GROUP BY ALL) SELECT event_date, camera, m AS month_start, max_score FROM ev, md QUALIFY row_number() OVER (PARTITION BY event_date, camera ORDER BY abs(event_date - m), m) = 1")
def nearest_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month nearest to each event, with its highest score."""
    scored = index(spark, sf_dir).filter("patchcore_score is not null")
    monthly = scored.groupBy("camera", F.make_date("year", "month", F.lit(1)).alias("month_start")).agg(F.max("patchcore_score").alias("max_score"))
    return catalog.nearest_in_time(event_catalogue(spark).select("event_date"), "event_date", monthly, "month_start", ["camera"])


@query(", a AS (SELECT unnest(generate_series(DATE '2023-10-01', DATE '2024-03-01', INTERVAL 1 MONTH))::DATE AS m) SELECT year(m)::INT AS year, month(m)::INT AS month FROM a WHERE (year(m), month(m)) NOT IN (SELECT (year, month) FROM idx WHERE downloaded)")
def missing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.missing_periods(index(spark, sf_dir), "2023-10-01", "2024-03-01")


@query(", d AS (SELECT DISTINCT make_date(year, month, day) AS d FROM idx WHERE day % 4 <> 0), a AS (SELECT unnest(generate_series((SELECT min(d) FROM d), (SELECT max(d) FROM d), INTERVAL 1 DAY))::DATE AS d) SELECT d FROM a WHERE d NOT IN (SELECT d FROM d)")
def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.missing_days(index(spark, sf_dir).filter("day % 4 != 0"))


@query(", g AS (SELECT camera AS g, day AS i, avg(mean_brightness) AS v FROM idx GROUP BY ALL) SELECT a.g AS a_group, b.g AS b_group, count(*) AS pairs, round(avg(abs(a.v - b.v)), 6) AS mean_difference FROM g a JOIN g b ON a.g < b.g OR (a.g = b.g AND a.i < b.i) GROUP BY ALL")
def pairwise_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = index(spark, sf_dir).groupBy("camera", "day").agg(F.avg("mean_brightness").alias("v"))
    return catalog.pairwise(daily, "camera", "day", "v").withColumn("mean_difference", rounded("mean_difference", 6))


@query(" SELECT a.label AS a_group, b.label AS b_group, count(*) AS pairs, round(avg(list_cosine_similarity(a.e, b.e)), 6) AS similarity FROM e a JOIN e b ON a.label < b.label OR (a.label = b.label AND a.vec_id < b.vec_id) GROUP BY ALL", "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)")
def similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the images of each two groups are."""
    return catalog.similar_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "label", "embedding").withColumn("similarity", rounded("similarity", 6))


@query(", a AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY filename, image_id) AS rank FROM idx WHERE camera = 'suki'), b AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY filename, image_id) AS rank FROM idx WHERE camera = 'kali') SELECT day, rank, a.image_id AS first, b.image_id AS second FROM a JOIN b USING (day, rank)")
def zip_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir)
    return catalog.zip_by_rank(df.filter("camera = 'suki'"), df.filter("camera = 'kali'"), "image_id", "day", "filename")


@query(CLASSED_SQL + ", b AS (SELECT image_id, class, CASE WHEN predicted = 1 THEN class WHEN is_night THEN 'lave' ELSE 'normal' END AS model_class FROM cl) SELECT class, model_class, count(*) AS n, class = model_class AS agree FROM b GROUP BY ALL")
def agreement_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir).withColumn("class", levels.heuristic_class())
    model = F.when(F.col("predicted") == 1, F.col("class")).when(F.col("is_night"), "lave").otherwise("normal")
    return df.withColumn("model_class", model).groupBy("class", "model_class").agg(F.count(F.lit(1)).alias("n")).withColumn("agree", F.col("class") == F.col("model_class"))


@query("SELECT image_id, rank() OVER (PARTITION BY camera, day ORDER BY round(patchcore_score, 0) DESC) AS rank FROM idx WHERE patchcore_score IS NOT NULL")
def rank_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir).filter("patchcore_score is not null").withColumn("s", F.round("patchcore_score", 0))
    return sample.rank_min(df, ["camera", "day"], "s").select("image_id", "rank")


@query("SELECT image_id, row_number() OVER (PARTITION BY camera ORDER BY year, month, day, hour, minute, second, image_id) AS position FROM idx")
def chrono_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["year", "month", "day", "hour", "minute", "second", "image_id"]
    return sample.numbered(index(spark, sf_dir), ["camera"], order, "position", slices=3).select("image_id", "position")


@query("SELECT image_id FROM idx QUALIFY row_number() OVER (PARTITION BY camera, year, month ORDER BY day, hour, minute, filename, image_id) <= 30")
def month_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["day", "hour", "minute", "filename", "image_id"]
    return sample.numbered(index(spark, sf_dir), ["camera", "year", "month"], order, "n", slices=1).filter("n <= 30").select("image_id")


@query("SELECT image_id, patchcore_score FROM idx ORDER BY patchcore_score DESC NULLS LAST, filename, image_id LIMIT 20")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).orderBy(F.desc_nulls_last("patchcore_score"), "filename", "image_id").limit(20).select("image_id", "patchcore_score")


@query("SELECT image_id, patchcore_score, (SELECT ceil(count(*) / 50.0)::BIGINT FROM idx) AS pages FROM idx ORDER BY patchcore_score DESC NULLS LAST, image_id LIMIT 50 OFFSET 100")
def page_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir)
    page = df.orderBy(F.desc_nulls_last("patchcore_score"), "image_id").offset(100).limit(50).select("image_id", "patchcore_score")
    return page.join(F.broadcast(df.agg(F.ceil(F.count(F.lit(1)) / 50).alias("pages"))))


@query("SELECT camera, image_id FROM idx QUALIFY row_number() OVER (PARTITION BY camera ORDER BY abs(mean_brightness - 120), image_id) = 1")
def nearest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = F.struct(F.abs(F.col("mean_brightness") - 120), "image_id")
    return index(spark, sf_dir).groupBy("camera").agg(F.min_by("image_id", far).alias("image_id"))


@query("SELECT image_id, day, hour FROM idx ORDER BY year NULLS LAST, month NULLS LAST, day NULLS LAST, hour NULLS LAST, minute NULLS LAST, image_id")
def chrono_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).orderBy(*[F.col(c).asc_nulls_last() for c in ("year", "month", "day", "hour", "minute", "image_id")]).select("image_id", "day", "hour")


_HASH = "(image_id * 2654435761 + 42) % 4294967296"


@query(f"SELECT image_id FROM idx ORDER BY {_HASH}, image_id LIMIT 200")
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.sample_n(index(spark, sf_dir), "image_id", 200).select("image_id")


@query(CATEGORIES_SQL + f" SELECT image_id, category FROM cat QUALIFY row_number() OVER (PARTITION BY category ORDER BY {_HASH}, image_id) <= 50")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.stratified(select.categories(index(spark, sf_dir)), "category", "image_id", 50).select("image_id", "category")


@query(f", r AS (SELECT image_id, is_night, row_number() OVER (PARTITION BY is_night ORDER BY {_HASH}, image_id) AS r, count(*) OVER (PARTITION BY is_night) AS n FROM idx) SELECT image_id, CASE WHEN r <= greatest(1, floor(n * 0.1)) THEN 'val' ELSE 'train' END AS split FROM r")
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.train_val(index(spark, sf_dir), "is_night", "image_id", 0.1).select("image_id", "split")


@query(f", n AS (SELECT count(*) AS n FROM idx) SELECT image_id FROM (SELECT image_id, row_number() OVER (ORDER BY {_HASH}, image_id) AS r FROM idx), n WHERE r <= least(n, greatest(500, floor(0.15 * n)))")
def coreset_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.coreset(index(spark, sf_dir), "image_id").select("image_id")


@query("SELECT image_id, month AS part, NULL::DOUBLE AS extra FROM idx WHERE day <= 10 UNION ALL SELECT image_id, month, variance FROM idx WHERE day > 20")
def union_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir).withColumn("part", F.col("month"))
    return df.filter("day <= 10").select("image_id", "part").unionByName(df.filter("day > 20").select("image_id", "part", F.col("variance").alias("extra")), allowMissingColumns=True)


@query(", two AS (SELECT url, image_id AS seen, 'a' AS v FROM idx UNION ALL SELECT url, image_id + 1, 'b' FROM idx WHERE image_id % 3 = 0) SELECT url, v FROM two QUALIFY row_number() OVER (PARTITION BY url ORDER BY seen DESC) = 1")
def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir)
    two = df.select("url", F.col("image_id").alias("seen"), F.lit("a").alias("v")).union(df.filter("image_id % 3 = 0").select("url", F.col("image_id") + 1, F.lit("b")))
    return catalog.last_per_key(two, "url", F.col("seen")).select("url", "v")


@query("SELECT DISTINCT day, hour FROM idx WHERE camera = 'suki' EXCEPT SELECT day, hour FROM idx WHERE camera = 'kali'")
def period_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir)
    return df.filter("camera = 'suki'").select("day", "hour").subtract(df.filter("camera = 'kali'").select("day", "hour"))


@query("SELECT filename FROM idx WHERE quality_flag IN ('dark', 'cloudy') INTERSECT SELECT filename FROM idx WHERE image_id % 4 = 0")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(spark, sf_dir)
    return df.filter("quality_flag in ('dark', 'cloudy')").select("filename").intersect(df.filter("image_id % 4 = 0").select("filename"))
