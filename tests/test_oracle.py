"""Every registered query against its SQL counterpart, values and types exactly."""

import importlib
import sys

import pytest

import __spark_entry__
from __spark_entry__ import entry
from ridelake.plans.oracle import ORACLE
from ridelake.plans.queries import REGISTRY
from tests.oracle_check import differences



def test_every_query_is_compared():
    assert set(REGISTRY) == set(ORACLE) and set(REGISTRY) <= set(__spark_entry__.queries())
    assert ORACLE.items() <= __spark_entry__.oracle_sql().items()


def test_trip_queries_do_without_the_text_operators(monkeypatch):
    for missing in ("xxhash", "ridelake.llm.queries", "corpus_pipeline"):
        with monkeypatch.context() as m:
            for name in [n for n in sys.modules if n.startswith(("ridelake.llm", "corpus_pipeline", "__spark_entry__"))]:
                m.delitem(sys.modules, name)
            m.setitem(sys.modules, missing, None)
            with pytest.warns(UserWarning, match="without the text"):
                again = importlib.import_module("__spark_entry__")
            assert set(REGISTRY) <= set(again.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    assert differences(REGISTRY[name](spark, sf), sf, ORACLE[name]) == []


@pytest.mark.parametrize("name", ["scan_project_limit", "prediction_audit"])
def test_limits_that_act(spark, name):
    """The larger tables have more rows than the cut leaves."""
    sf = "/root/testdata/sf0.1"
    found = REGISTRY[name](spark, sf)
    assert found.count() == {"scan_project_limit": 50_000, "prediction_audit": 5_000}[name]
    assert differences(found, sf, ORACLE[name]) == []


def test_entry(spark):
    assert entry(spark).count() == 6


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_no_python_and_no_pairwise_join_in_plans(spark, sf, name):
    plan = REGISTRY[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan
