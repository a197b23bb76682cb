"""Bulk state changes: request logs decided in one plan.

The reference decides one request at a time (check, then write).  Here a
whole log is decided at once; the order is (event time, event id) and the
first request wins.  Every input row comes back with ``accepted`` and a
``reason`` for a rejection.

Per-key order questions ("what did this vehicle do last?") use the
bucketed windows of :mod:`parkops.plans.windows`, and bookings come from the
life cycle in :mod:`parkops.operators.cycle`, so a hot vehicle or spot is
never gathered into a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.windows import adaptive_bucket, ordered_lookups

ORDER = ["ts", "event_id"]


def session_pairing(log: DataFrame) -> DataFrame:
    """Check-in / check-out log -> decisions and sessions.

    A check-in is rejected while the vehicle is parked (``already_parked``),
    a check-out without an open session is rejected (``no_open_session``);
    rejected events change nothing.  The state after any event is "parked"
    exactly when the event is a check-in (accepted, or rejected because the
    vehicle was already parked), so the previous event decides each one.
    An accepted check-in is closed by the next check-out of the vehicle.
    Events without a vehicle or a time are rejected (``invalid_event``).
    """
    pairs = (log.filter(F.col("action").isin("check_in", "check_out"))
             .select("event_id", "vehicle_id", "spot_id", "action", "ts"))
    ok = F.col("vehicle_id").isNotNull() & F.col("ts").isNotNull()
    bad = pairs.filter(~ok).select(
        "event_id", "vehicle_id", "spot_id", "action", "ts", F.lit(False).alias("accepted"),
        F.lit("invalid_event").alias("reason"), F.lit(None).cast("timestamp_ntz").alias("exit_time"),
        F.lit(None).cast("bigint").alias("exit_event_id"))
    ev, buckets = adaptive_bucket(pairs.filter(ok), ["vehicle_id"], "ts")
    ev = ev.withColumn("_out", F.when(F.col("action") == "check_out",
                                      F.struct(F.col("ts").alias("ts"), F.col("event_id").alias("event_id"))))
    ev = ordered_lookups(ev, ["vehicle_id"], buckets, ORDER,
                         [("prev", "action", "prev_action"), ("next", "_out", "_next_out")])
    was_parked = F.coalesce(F.col("prev_action") == "check_in", F.lit(False))
    is_in = F.col("action") == "check_in"
    accepted = F.when(is_in, ~was_parked).otherwise(was_parked)
    closes = is_in & accepted
    return ev.select(
        "event_id", "vehicle_id", "spot_id", "action", "ts", accepted.alias("accepted"),
        F.when(accepted, F.lit(None).cast("string"))
         .when(is_in, F.lit("already_parked")).otherwise(F.lit("no_open_session")).alias("reason"),
        F.when(closes, F.col("_next_out.ts")).alias("exit_time"),
        F.when(closes, F.col("_next_out.event_id")).alias("exit_event_id")).unionByName(bad)


def reservation_admission(log: DataFrame, spots: DataFrame) -> DataFrame:
    """Reserve / cancel log -> decisions.

    A reserve is accepted only if the spot exists and is neither occupied
    (snapshot) nor reserved at that moment; requested times are never
    compared.  A cancel releases only a spot that is reserved.  The snapshot
    ``is_reserved`` flag is the state before the first event.  On an
    occupied spot every reserve fails, so only the first cancel of a spot
    reserved in the snapshot can succeed.
    """
    sp = spots.select(F.col("id").alias("_sid"), F.col("is_occupied").alias("_occ"),
                      F.col("is_reserved").alias("_res"))
    rows = (log.filter(F.col("action").isin("reserve", "cancel"))
            .select("event_id", "spot_id", "vehicle_id", "action", "ts", "hours"))
    ok = F.col("spot_id").isNotNull() & F.col("ts").isNotNull()
    bad = rows.filter(~ok).select(
        "event_id", "spot_id", "vehicle_id", "action", "ts", F.lit(False).alias("accepted"),
        F.when(F.col("spot_id").isNull(), F.lit("spot_not_found")).otherwise(F.lit("invalid_event"))
         .alias("reason"), F.lit(None).cast("timestamp_ntz").alias("end_time"))
    ev, buckets = adaptive_bucket(rows.filter(ok).join(sp, F.col("spot_id") == F.col("_sid"), "left"),
                                  ["spot_id"], "ts")
    ev = ev.withColumn("_c", F.when(F.col("action") == "cancel", F.col("event_id")))
    ev = ordered_lookups(ev, ["spot_id"], buckets, ORDER,
                         [("prev", "action", "prev_action"), ("prev", "_c", "_prev_cancel")])
    found = F.col("_sid").isNotNull()
    occ = F.coalesce(F.col("_occ"), F.lit(False))
    res0 = F.coalesce(F.col("_res"), F.lit(False))
    before_reserved = F.coalesce(F.col("prev_action") == "reserve", res0)
    is_res = F.col("action") == "reserve"
    accepted = (F.when(~found, F.lit(False))
                 .when(occ, (~is_res) & res0 & F.col("_prev_cancel").isNull())
                 .when(is_res, ~before_reserved)
                 .otherwise(before_reserved))
    reason = (F.when(accepted, F.lit(None).cast("string"))
               .when(~found, F.lit("spot_not_found"))
               .when(is_res & occ, F.lit("spot_occupied"))
               .when(is_res, F.lit("spot_reserved"))
               .otherwise(F.lit("not_reserved")))
    return ev.select("event_id", "spot_id", "vehicle_id", "action", "ts", accepted.alias("accepted"),
                     reason.alias("reason"),
                     F.when(accepted & is_res, F.col("ts") + F.make_dt_interval(hours=F.col("hours")))
                      .alias("end_time")).unionByName(bad)


def spot_booking_admission(cycle: DataFrame) -> DataFrame:
    """Booking requests (check-ins with a duration) -> decisions, read from the
    booking life cycle (:mod:`parkops.operators.cycle`).

    A request is rejected if the spot does not exist, if it is invalid (no
    spot, time or positive duration), or if the spot's booking, with its
    extensions, still holds; a check-out ends a booking early.
    ``is_reserved`` is ignored."""
    req = cycle.filter(F.col("action") == "check_in")
    accepted = F.col("kind") == "booked"
    reason = (F.when(accepted, F.lit(None).cast("string")).when(F.col("kind") == "rejected", F.lit("spot_occupied"))
              .when(F.col("kind") == "invalid", F.lit("invalid_event")).otherwise(F.col("kind")))
    return req.select("event_id", "spot_id", "vehicle_id", "ts", "hours",
                      (F.col("ts") + F.make_dt_interval(hours=F.col("hours"))).alias("end_time"),
                      accepted.alias("accepted"), reason.alias("reason"))
