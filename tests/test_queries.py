"""Every registered query against its SQL equivalent on the smallest tables."""

import os

import pytest

from suite.oracles import ORACLES
from suite.queries import QUERIES

from .compare import difference, sql_engine

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def engine():
    return sql_engine(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, engine, name):
    assert difference(QUERIES[name](spark, SF_DIR).toPandas(), engine.execute(ORACLES[name]).df()) == ""


def test_topics(spark):
    rows = QUERIES["topic_summary"](spark, SF_DIR).collect()
    assert len(rows) == 6
    assert sum(r["n_articles"] for r in rows) == 200
    assert abs(sum(r["mean_weight"] for r in rows) - 1) < 1e-6
    assert all(len(r["top_terms"].split()) == 10 for r in rows)


def test_only_the_model_runs_python(spark):
    """No plan but that of the supplied model leaves the JVM."""
    for name in sorted(set(QUERIES) - {"topics", "topic_summary", "batch_score"}):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert node not in plan, (name, node)
