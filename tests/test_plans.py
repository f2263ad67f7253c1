"""What the plans of headline queries are made of: scans, shuffles and joins before anything runs."""

import os

import pytest

from panemill.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.mark.parametrize(
    ("name", "scans", "shuffles", "joins"),
    [
        ("tumbling_max", 1, 1, 0),
        ("tumbling_median", 1, 2, 0),
        ("tumbling_all_aggs_long", 1, 2, 0),
        ("sliding_sum", 1, 2, 0),
        ("concurrent_tumbling_max", 1, 2, 0),
        ("pane_shared_sliding", 1, 3, 0),
        ("session_sum", 1, 1, 0),
        ("count_tumbling_per_key", 2, 6, 1),
    ],
)
def test_scans_shuffles_and_joins(spark, name, scans, shuffles, joins):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    found = (plan.count("FileScan parquet"), plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition"), plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin"))
    assert found[0] <= scans and found[1] <= shuffles and found[2] <= joins, (found, plan)
    assert "Python" not in plan and "Arrow" not in plan and "collect_list" not in plan


def test_only_needed_columns_are_read(spark):
    plan = QUERIES["tumbling_max"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan
