import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from linkweave.plans import registry

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def said(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(said(r[c]) for c in columns) for r in df.collect())
    rows = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(said(r[names.index(c)]) for c in columns) for r in rows.fetchall())


@needs_tables
@pytest.mark.parametrize("name", ["str_translit", "str_textmode_latin", "sim_tokensort", "jn_fuzzy_best", "hash_bucket", "mat_folds", "mat_sample_s1", "mat_negdown", "smp_stratified", "smp_linked", "smp_anchored", "prf_sim", "emb_encode"])
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.columns and df.count() >= 1


def test_feature_count(spark):
    from linkweave.operators.features import FEATURES, feature_set

    assert len(FEATURES()) == len(set(FEATURES())) == 85 and len(feature_set("base")) == 44 and len(feature_set("submission2")) == 61


def test_bucket_limits_are_pushed_into_the_ranking(spark):
    from pyspark.sql import functions as F

    from linkweave.operators.windows import top

    df = top(spark.range(100).selectExpr("id", "id % 3 AS g"), "g", [F.col("id")], 2)
    assert "WindowGroupLimit" in df._jdf.queryExecution().toString()
