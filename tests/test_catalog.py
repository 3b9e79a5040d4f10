"""Every registered query beside its SQL on the smallest of the given tables."""

import pytest

from compare import DATA, differences, duck
from lodestone.catalog import QUERIES, SQL

SF = "sf0.001"
pytestmark = pytest.mark.skipif(not (DATA / SF).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    frame = QUERIES[name](spark, str(DATA / SF))
    if name in SQL:
        assert differences(frame, con, SQL[name]) is None
    else:
        assert frame.count() > 0


@pytest.mark.parametrize("name", ["semantic_search", "keyword_search", "quiz_items", "rewritten_kb", "latency_per_method"])
def test_plans_form_no_pairs(spark, name):
    plan = QUERIES[name](spark, str(DATA / SF))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_columns_and_filters_reach_the_scan(spark):
    plan = QUERIES["method_mix"](spark, str(DATA / SF))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string>" in plan
