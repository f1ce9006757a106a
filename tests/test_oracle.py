"""Every registered query runs, and equals its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry_module
from check import compare, connect, spark_rows, sql_rows

QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()
SLOW = {"kmeans_fit", "k_scan", "cross_validation", "model_comparison", "cluster_matrix", "tree_importances"}


@pytest.fixture(scope="module")
def con(request):
    import os
    return connect(os.environ.get("SF_DIR", "/root/testdata/sf0.001"))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, con, name):
    assert compare(spark_rows(QUERIES[name](spark, sf_dir)), sql_rows(con, ORACLES[name])) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert {"profile_id", "job_id", "similarity_score", "matched_skills"} <= set(df.columns) and df.count() == 30
