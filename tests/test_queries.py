"""Every registered query of the library against its SQL in DuckDB, at the smallest scale."""

import datetime
import decimal
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from tephra.operators import catalog, models
from tephra.plans import catalogue
from tephra.plans.registry import QUERIES, SQL

TABLES = "events documents embeddings pages labels".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.sql(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=key)
    assert rows == sorted((tuple(map(norm, r)) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"cv_macro_f1", "weather_fit"}))
def test_queries_without_sql_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_competition_of_classifiers(spark, sf):
    """Every candidate has a score, and the rows get the classes of the winner."""
    scores = {r.model: (r.mean, r.std) for r in QUERIES["cv_macro_f1"](spark, sf).collect()}
    assert len(scores) == 9 and all(0.3 < mean < 1 and 0 <= std < 0.3 for mean, std in scores.values())
    out = QUERIES["weather_fit"](spark, sf).collect()
    assert {r.model for r in out} == {models.winner(scores)} and {r.weather_label for r in out} <= {0, 1}
    assert all((r.weather_proba >= 0.5) == (r.weather_label == 1) for r in out if abs(r.weather_proba - 0.5) > 1e-4)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_path_lookup_makes_paths_once_and_lists_what_the_files_have(spark, sf):
    """Spark put all candidates of a row into a filter for empty arrays, and whole rows into the listing."""
    query = QUERIES["path_candidates"](spark, sf)
    plan = query._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("Filter" in line and "regexp_replace" in line for line in plan)
    assert not any("Aggregate" in line and "quality_flag" in line for line in plan)
    assert Counter(catalogue.paths_of(spark, sf).collect()) == Counter(catalogue.files_of(spark, sf).select("path").collect())
    odd = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, [None, "b"]), (5, ["c"])], "k int, paths array<string>")
    files = spark.createDataFrame([("b",), ("b",), (None,)], "path string")
    assert {tuple(r) for r in catalog.first_existing(odd, files, "k").collect()} == {(1, "b"), (4, "b")}
