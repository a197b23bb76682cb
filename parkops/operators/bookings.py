"""Bookings: extensions, expiry and the per-spot countdown views.

All of them read the booking life cycle (:mod:`parkops.operators.cycle`), which
decides check-ins, extensions and check-outs of a spot in one order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hhmmss
from ..schemas import CRITICAL_MS, WARNING_MS
from ..sources.fixtures import as_of_lit
from .cycle import us_time


def _ms(c):
    return F.unix_millis(c.cast("timestamp"))


def _totals(cycle: DataFrame) -> DataFrame:
    """Per booking: its start row and its applied extensions."""
    mine = cycle.filter(F.col("kind").isin("booked", "extended"))
    ext = F.col("kind") == "extended"
    start = F.max(F.when(~ext, F.struct("spot_id", "vehicle_id", "ts", "hours")))
    g = mine.groupBy("booking_id").agg(
        start.alias("s"), F.coalesce(F.sum(F.when(ext, F.col("hours"))), F.lit(0)).cast("int").alias("total_extended_hours"),
        F.count_if(ext).alias("extension_count"), F.max_by("end_us", F.struct("ts", "event_id")).alias("end_us"))
    return g.select("booking_id", F.col("s.vehicle_id").alias("vehicle_id"), F.col("s.ts").alias("start_time"),
                    us_time(F.col("end_us")).alias("end_time"),
                    (F.col("s.hours") + F.col("total_extended_hours")).alias("duration_hours"),
                    "total_extended_hours", "extension_count")


def apply_extensions(cycle: DataFrame, as_of: str) -> DataFrame:
    """Extension events up to ``as_of``: the booking each one extends, the end it
    gives it, and the booking's state after all its extensions.  An extension
    of a spot without a booking (none yet, or checked out) is not applied and
    has a NULL booking."""
    past = cycle.filter(F.col("ts") <= as_of_lit(as_of))
    x = past.filter((F.col("action") == "extend") & F.col("kind").isin("extended", "no_booking"))
    done = _totals(past).select(F.col("booking_id").alias("_bid"), F.col("end_time").alias("booking_end_time"),
                                F.col("duration_hours").alias("booking_duration_hours"), "total_extended_hours")
    return (x.join(done, F.col("booking_id") == F.col("_bid"), "left")
            .select("event_id", "spot_id", F.col("ts").alias("extended_at"), F.col("hours").alias("added_hours"), "booking_id",
                    us_time(F.col("end_us")).alias("new_end_time"), "booking_end_time", "booking_duration_hours",
                    "total_extended_hours", (F.col("kind") == "extended").alias("applied")))


def spot_bookings(cycle: DataFrame, as_of: str) -> DataFrame:
    """Per spot with any action up to ``as_of``: its booking (NULL after a
    check-out or without one) with its extensions, and whether a check-out or
    an expiry has ``cleared`` the spot's flags."""
    now = as_of_lit(as_of)
    past = cycle.filter((F.col("ts") <= now) & F.col("kind").isin("booked", "extended", "rejected", "no_booking", "checked_out"))
    ran_out = F.col("kind").isin("booked", "extended", "rejected") & (
        F.least(F.coalesce(F.col("next_ts"), now), now) > us_time(F.col("end_us")))
    g = past.groupBy("spot_id").agg(
        F.max_by("booking_id", F.struct("ts", "event_id")).alias("booking_id"),
        (F.count_if(ran_out | (F.col("kind") == "checked_out")) > 0).alias("cleared"))
    t = _totals(past).withColumnRenamed("booking_id", "_bid")
    return g.join(t, F.col("booking_id") == F.col("_bid"), "left").drop("_bid")


def current_bookings(spot_states: DataFrame) -> DataFrame:
    """The spots' bookings, of spots that have one."""
    return spot_states.filter(F.col("booking_id").isNotNull()).drop("cleared")


def expire_bookings(spots: DataFrame, spot_states: DataFrame, as_of: str) -> DataFrame:
    """Sweep at ``as_of``: a booking strictly past its end becomes expired and its
    spot's occupied and reserved flags are cleared, as by a check-out; a live
    booking keeps its spot occupied.  Spots without any action keep their
    flags.  The session is not closed."""
    now = as_of_lit(as_of)
    c = spot_states.select(F.col("spot_id").alias("_sid"), "booking_id", "end_time", "cleared")
    j = spots.join(c, F.col("id") == F.col("_sid"), "left")
    has = F.col("booking_id").isNotNull()
    expired = has & (now > F.col("end_time"))
    cleared = F.coalesce(F.col("cleared"), F.lit(False))
    return j.select(
        "id", "spot_number", "zone_id", "spot_type",
        F.when(has, ~expired).when(cleared, F.lit(False)).otherwise(F.col("is_occupied")).alias("is_occupied"),
        F.when(cleared, F.lit(False)).otherwise(F.col("is_reserved")).alias("is_reserved"),
        "booking_id", F.col("end_time").alias("booking_end_time"),
        F.when(has, expired).alias("expired"))


def spot_status_board(swept: DataFrame, as_of: str) -> DataFrame:
    """One status per spot, first match wins: overdue, critical (< 5 min),
    warning (< 15 min), occupied, reserved, then the spot type.  The time
    classes need an occupied spot with a booking."""
    now_ms = _ms(as_of_lit(as_of))
    rem = _ms(F.col("booking_end_time")) - now_ms
    occ = F.coalesce(F.col("is_occupied"), F.lit(False))
    booked = F.col("booking_id").isNotNull()
    status = (F.when(occ & booked & (rem <= 0), "overdue")
               .when(occ & booked & (rem < CRITICAL_MS), "critical")
               .when(occ & booked & (rem < WARNING_MS), "warning")
               .when(occ, "occupied")
               .when(F.coalesce(F.col("is_reserved"), F.lit(False)), "reserved")
               .when(F.col("spot_type") == "electric", "electric")
               .when(F.col("spot_type") == "motorcycle", "motorcycle")
               .when(F.col("spot_type") == "handicapped", "handicapped")
               .otherwise("regular"))
    return swept.select("id", "spot_number", "zone_id", "is_occupied", "is_reserved", "booking_id",
                        status.alias("status"))


def booking_urgency(current: DataFrame, as_of: str) -> DataFrame:
    """Countdown of every current booking: remaining time clamped at 0,
    ``expired`` at 0, ``critical`` under 5 min, ``warning`` under 15 min
    (critical ones included), and the hh:mm:ss text."""
    now_ms = _ms(as_of_lit(as_of))
    rem = F.greatest(F.lit(0), _ms(F.col("end_time")) - now_ms)
    return current.select(
        "spot_id", "booking_id", "end_time", rem.alias("remaining_ms"),
        (rem == 0).alias("expired"), ((rem > 0) & (rem < CRITICAL_MS)).alias("critical"),
        ((rem > 0) & (rem < WARNING_MS)).alias("warning"), hhmmss(rem).alias("countdown"))


def urgency_counts(swept: DataFrame, as_of: str) -> DataFrame:
    """Unexpired bookings ending within 5 and within 15 minutes (no lower
    bound, so an overdue booking not yet flagged counts in both)."""
    now_ms = _ms(as_of_lit(as_of))
    rem = _ms(F.col("booking_end_time")) - now_ms
    live = F.col("booking_id").isNotNull() & ~F.coalesce(F.col("expired"), F.lit(False))
    return swept.agg(F.count_if(live & (rem < CRITICAL_MS)).alias("critical_count"),
                     F.count_if(live & (rem < WARNING_MS)).alias("warning_count"))


def booking_progress(current: DataFrame, as_of: str) -> DataFrame:
    """Share of the booked time already used, clamped to 0..100 %."""
    now_ms = _ms(as_of_lit(as_of))
    total = F.col("duration_hours").cast("double") * 3600000.0
    used = total - (_ms(F.col("end_time")) - now_ms)
    pct = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.try_divide(used, total) * 100.0))
    return current.select("spot_id", "booking_id", "duration_hours", F.round(pct, 2).alias("used_pct"))
