"""Every registered query against its SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from chronorank.plans import jobs, oracle
from compare import compare, connect

QUERIES, SQL = jobs.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    pytest.importorskip("duckdb")
    return connect(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, folder, name):
    _, difference = compare(spark, con, folder, name, QUERIES[name], SQL[name])
    assert difference == ""


@pytest.mark.parametrize("name", ["route", "kl_scores", "sentence_scores", "rm3_model", "match_vs_nonmatch"])
def test_no_cross_join(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scanned_hours_cut_the_query(spark):
    """At a size where they do: rows before, within and after the hours."""
    bins = QUERIES["scan_query"](spark, "/root/testdata/sf0.01").select("date_bin").collect()
    places = [(r.date_bin >= jobs.SCAN_LOW) + (r.date_bin >= jobs.SCAN_HIGH) for r in bins]
    assert all(places.count(n) for n in range(3))
    assert QUERIES["scan_bins"](spark, "/root/testdata/sf0.01").count() == places.count(1)
    assert QUERIES["rm3_rerank_hours"](spark, "/root/testdata/sf0.01").count() == places.count(1)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "stream_id", "score", "rank"]
    assert df.count() > 0
