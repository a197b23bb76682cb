"""Physical-plan checks: pushdown, no stray cartesian joins or Python nodes."""

import pytest

import __spark_entry__ as entry
from settings import SF_SMALL
from parkops.plans import catalog

QUERIES = {name: fn for name, fn in entry.queries().items() if name in catalog.QUERIES}
# one-row KPI frames (#23, #24), the seed grid (#2, #3), the zone x hour grid (#33)
CROSS_OK = {"dashboard_kpis", "dashboard_kpis_client", "occupancy_profile", "seed_spot_grid",
            "seed_spot_grid_client"}
PYTHON_OK = {"spot_booking_admission", "apply_extensions", "expire_bookings", "spot_status_board",
             "booking_urgency", "urgency_counts", "booking_progress"}
STREAMS = {q for q in QUERIES if q.startswith("stream_")} | {"result_sink"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cartesian_or_python_unless_expected(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    if name not in CROSS_OK:
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
    if name not in PYTHON_OK:
        assert "Python" not in p and "ArrowEval" not in p, name


def test_scan_pushes_the_time_range(spark):
    df = QUERIES["scan_sessions"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in p
