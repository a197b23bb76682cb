"""Cross-form checks between operators."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from settings import SF_SMALL
from parkops.operators import reports
from parkops.sources.fixtures import AS_OF, model

Q = entry.queries()


def test_zone_occupied_sum_not_above_dashboard(spark):
    zones_occ = Q["zone_occupancy"](spark, SF_SMALL).agg(F.sum("occupied")).collect()[0][0]
    kpi = Q["dashboard_kpis"](spark, SF_SMALL).collect()[0]["occupied_spots"]
    assert zones_occ <= kpi


def test_recent_activity_union_form_equals_explode_form(spark):
    m = model(spark, SF_SMALL)
    got = reports.recent_activity(m.sessions, m.vehicles, m.spots, m.zones, AS_OF)
    now = F.lit(AS_OF).cast("timestamp_ntz")
    v = m.vehicles.select(F.col("id").alias("_vid"), "license_plate")
    s = m.spots.select(F.col("id").alias("_sid"), "spot_number", "zone_id")
    z = m.zones.select(F.col("id").alias("_zid"), F.col("name").alias("zone_name"))
    j = (m.sessions.filter(F.col("entry_time") <= now).join(v, F.col("vehicle_id") == F.col("_vid"))
         .join(s, F.col("spot_id") == F.col("_sid")).join(z, F.col("zone_id") == F.col("_zid")))
    cols = ["license_plate", "spot_number", "zone_name"]
    ins = j.select(F.lit("check-in").alias("action"), *cols, F.col("entry_time").alias("timestamp"),
                   F.col("id").alias("session_id"))
    outs = j.filter(F.col("exit_time") <= now).select(F.lit("check-out").alias("action"), *cols,
                                                      F.col("exit_time").alias("timestamp"),
                                                      F.col("id").alias("session_id"))
    order = [F.col("timestamp").desc(), F.col("action").asc(), F.col("session_id").desc()]
    want = ins.orderBy(*order).limit(20).unionByName(outs.orderBy(*order).limit(20)).orderBy(*order).limit(20)
    assert got.collect() == want.collect()


def test_billing_server_amount_equals_stored_amount(spark):
    # the stored session amount follows the server rule: ceil(minutes / 60) x rate
    b = Q["session_billing"](spark, SF_SMALL).select("session_id", "server_amount")
    m = model(spark, SF_SMALL)
    s = m.sessions.filter(F.col("exit_time").isNotNull()).select(
        F.col("id").alias("session_id"), F.col("total_amount").cast("double").alias("stored"))
    bad = b.join(s, "session_id").filter(~F.col("server_amount").eqNullSafe(F.col("stored")))
    assert bad.count() == 0
