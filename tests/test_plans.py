"""Plan properties that matter at scale, checked on the physical plans of the registered queries."""

import pytest

import __spark_entry__ as entry
from sitelore.operators import frontier
from sitelore.sources.fixtures import tables

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython")
SKIP = {"stream_ingest", "stream_discover", "stream_progress", "write_raw", "read_raw", "write_processed",
        "write_exports", "list_exports"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SKIP))
def test_no_pairwise_joins_or_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert not [k for k in FORBIDDEN if k in plan]


def test_top_k_uses_window_group_limit(spark):
    for name in ("limit_frontier", "top_summaries"):
        assert "WindowGroupLimit" in plan_of(entry.queries()[name](spark, SF))


def test_bench_frontier_scan_is_pruned(spark):
    t = tables(spark, SF)
    plan = plan_of(frontier.discover_pages(t["links_bench"], t["courses_bench"]))
    assert "l_extendedprice" not in plan and "l_quantity" not in plan  # only the 5 used columns are read
    assert plan.count("Exchange hashpartitioning") <= 2  # the dedupe shuffle (+ site table if not broadcast)
