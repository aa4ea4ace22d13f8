"""The catalogue: every query has a plan over the smallest tables; a few are run against their SQL."""

import glob
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


def test_flagship(spark):
    import __spark_entry__ as e

    assert set(e.entry(spark).columns) == {"query_id", "doc_id", "score", "rank"}


@pytest.mark.parametrize("name", ["islands_merge", "gaps_complement", "smallest_containing", "bm25_topk", "completion_progress", "trajectory_summary", "audit_findings", "pareto_front"])
def test_against_sql(spark, name):
    import duckdb

    from corvane.plans import catalog

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.execute(catalog.SQL[name])
    cols = [c[0] for c in want.description]
    clean = lambda v: round(float(v), 5) if isinstance(v, float) else v
    want = sorted(tuple(map(clean, r)) for r in want.fetchall())
    got = sorted(tuple(clean(r[c]) for c in cols) for r in catalog.QUERIES[name](spark, DATA).collect())
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]


def test_retrieval_is_planned_in_steps(spark):
    """The last plan fuses written channels; it holds none of their joins."""
    from corvane.plans import catalog

    plan = catalog.QUERIES["rag_pipeline"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") < 10
