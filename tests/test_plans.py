"""Plan guards over every lazily built query of the event engine."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001

# these write tables when called (they test the incremental writers)
EAGER = {"k3_raw_insert_two_deliveries", "k3_raw_insert_late_delivery", "k4_metrics_upsert", "w1_stream_metrics_out_of_order", "w2_metrics_after_compaction",
         "m1_delta_refresh", "m5_refresh_1min", "m5_refresh_15min", "m5_refresh_emptied_days", "m7_refresh_from_log"}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInArrow", "FlatMapGroupsInArrow",
             "FlatMapCoGroupsInArrow", "FlatMapGroupsInPandas", "MapInPandas", "FlatMapCoGroupsInPandas")


@pytest.mark.parametrize("name", sorted(set(E.queries()) - EAGER - set(E.LLM_QUERIES)))
def test_no_cross_join_and_no_python_in_plan(spark, name):
    df = E.queries()[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, (name, op)
    # every aggregation has its partial (map-side) phase
    if "Aggregate(" in plan:
        assert "partial_" in plan or "Expand" in plan or "max_by" in plan, name
