"""Registered queries against their SQL, and what their plans look like."""

import pytest

import __spark_entry__ as entry
from hushframe.plans.oracle import oracle_sql
from hushframe.plans.queries import queries
from tests.check_oracle import compare, connect

QUERIES = queries()
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(request):
    return connect("/root/testdata/sf0.001")


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle_sql()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, sf_dir, name):
    problem, *_ = compare(spark, con, sf_dir, name)
    assert problem is None, problem


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0


def test_deciding_an_outcome_shuffles_no_text(spark, sf_dir):
    plan = QUERIES["disposition"](spark, sf_dir)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    fields = [plan.output().apply(i).name() for i in range(plan.output().size())]
    assert not {"text", "detections"} & set(fields)


def test_no_python_in_batch_plans(spark, sf_dir):
    for name in ("analyze", "scrub_session", "send_pipeline", "token_vault_session"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
