"""Live versions of the reports and state changes over the event stream.

#47 hourly entries and #48 daily revenue are windowed aggregations (Spark keeps
the partial aggregates as state).  #49 spot state, #50 session pairing and #51
booking expiry are decided per key in event-time order (:mod:`.ordered`).

Event time is cast from TIMESTAMP_NTZ to TIMESTAMP (session zone UTC)
because watermarks need the latter; outputs are cast back.  Late data
policy: one hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import HOUR_US, InOrder, Rows, decide, us_time

WATERMARK = "1 hour"


def _event_time(df: DataFrame, col: str, out: str = "et") -> DataFrame:
    return df.withColumn(out, F.col(col).cast("timestamp"))


def hourly_entries(sessions: DataFrame) -> DataFrame:
    """Entries per clock hour, with closed stays and their whole minutes
    (so the mean stay of an hour is ``stay_minutes / closed``)."""
    s = _event_time(sessions, "entry_time").withWatermark("et", WATERMARK)
    return (s.groupBy(F.window("et", "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("entry_count"),
                 F.count("exit_time").alias("closed"),
                 F.sum(F.timestamp_diff("MINUTE", F.col("entry_time"), F.col("exit_time"))).alias("stay_minutes")))


def hourly_entries_out(df: DataFrame) -> DataFrame:
    return df.select(F.col("w.start").cast("timestamp_ntz").alias("hour_start"), "entry_count", "closed",
                     F.coalesce(F.col("stay_minutes"), F.lit(0)).cast("bigint").alias("stay_minutes"))


def daily_revenue(sessions: DataFrame) -> DataFrame:
    """Paid revenue and transactions per exit day."""
    s = (sessions.filter(F.col("exit_time").isNotNull() & (F.col("payment_status") == "paid"))
         .transform(lambda d: _event_time(d, "exit_time")).withWatermark("et", WATERMARK))
    return (s.groupBy(F.window("et", "1 day").alias("w"))
            .agg(F.sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("transactions")))


def daily_revenue_out(df: DataFrame) -> DataFrame:
    return df.select(F.date_format(F.col("w.start").cast("timestamp_ntz"), "yyyy-MM-dd").alias("date"),
                     F.col("revenue").cast("double").alias("revenue"), "transactions")


# --------------------------------------------------------------------------
# #50 session pairing, per vehicle
# --------------------------------------------------------------------------
def _pair(vehicle: int, carry: tuple, event: tuple) -> tuple[tuple, Rows]:
    (opened,), (us, event_id, action, spot) = carry, event
    is_in = action == "check_in"
    accepted = (opened is None) == is_in
    reason = None if accepted else "already_parked" if is_in else "no_open_session"
    closes = opened if accepted and not is_in else None
    if accepted:
        opened = event_id if is_in else None
    return (opened,), [(event_id, vehicle, spot and int(spot), action, us_time(us), accepted, reason, closes)]


def _pair_late(vehicle: int, event: tuple) -> Rows:
    us, event_id, action, spot = event
    return [(event_id, vehicle, spot and int(spot), action, us_time(us), False, "late_event", None)]


PAIRING = InOrder(
    payload={"action": "string", "spot": "string"}, carry={"open_event_id": "long"}, start=(None,), step=_pair, late=_pair_late,
    output="event_id long, vehicle_id long, spot_id long, action string, ts timestamp_ntz, "
           "accepted boolean, reason string, entry_event_id long")


def session_pairing_stream(log: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """Check-ins and check-outs paired per vehicle as by ``lifecycle.session_pairing``, in event-time order.

    Each event is told once, when it is decided; an accepted check-out names the
    check-in that it closes.  Events without a vehicle or a time are rejected as
    ``invalid_event``, late ones as ``late_event``."""
    ev = log.filter(F.col("action").isin("check_in", "check_out")).select("event_id", "vehicle_id", "spot_id", "action", "ts")
    valid = F.col("vehicle_id").isNotNull() & F.col("ts").isNotNull()
    bad = ev.filter(~valid).select("event_id", "vehicle_id", "spot_id", "action", "ts", F.lit(False).alias("accepted"),
                                   F.lit("invalid_event").alias("reason"), F.lit(None).cast("long").alias("entry_event_id"))
    good = ev.filter(valid).withColumn("spot", F.col("spot_id").cast("string"))   # text: whole numbers that may be null
    return decide(good, "vehicle_id", PAIRING, ticks).unionByName(bad)


# --------------------------------------------------------------------------
# #49 and #51 the booking life cycle, per spot
# --------------------------------------------------------------------------
def _sweep(spot: int, carry: tuple, now: int) -> tuple[tuple, Rows]:
    """The booking expires if ``now`` is strictly past its end."""
    booking, end, expired = carry
    if booking is None or expired or now <= end:
        return carry, []
    return (booking, end, True), [(spot, booking, "expired", us_time(end), us_time(end))]


def _book(spot: int, carry: tuple, event: tuple) -> tuple[tuple, Rows]:
    us, event_id, action, hours = event
    (booking, end, expired), rows = _sweep(spot, carry, us)
    if action == "check_in":
        kind = "booked" if booking is None or expired else "rejected"
        if kind == "booked":
            booking, end, expired = event_id, us + int(hours) * HOUR_US, False
    elif action == "extend":
        kind = "no_booking" if booking is None else "extended"
        if booking is not None:
            # counted from the old end, also of a booking that has run out; it may stay in the past
            end, expired = end + int(hours) * HOUR_US, False
    else:
        booking, end, expired, kind = None, None, False, "checked_out"
    return (booking, end, expired), [*rows, (spot, event_id, kind, us_time(us), us_time(end))]


def _booking_end(carry: tuple) -> int | None:
    booking, end, expired = carry
    return None if booking is None or expired else end


def _booking_late(spot: int, event: tuple) -> Rows:
    return [(spot, event[1], "late", us_time(event[0]), None)]


_BOOKING = {"booking_id": "long", "end_us": "long", "expired": "boolean"}
BOOKING = InOrder(
    payload={"action": "string", "hours": "int"}, carry=_BOOKING, start=(None, None, False), step=_book, late=_booking_late,
    elapse=_sweep, wakes=_booking_end, output="spot_id long, event_id long, kind string, ts timestamp_ntz, end_time timestamp_ntz")


def _spot_actions(log: DataFrame, spots: DataFrame) -> DataFrame:
    """Actions on known spots with a time and, but for check-outs, a positive duration."""
    ids = spots.select(F.col("id").alias("_sid")).distinct()
    valid = F.col("ts").isNotNull() & ((F.col("action") == "check_out") | (F.col("hours") > 0))
    return (log.filter(F.col("action").isin("check_in", "extend", "check_out") & valid)
            .select("event_id", "spot_id", "action", "ts", F.coalesce(F.col("hours").cast("int"), F.lit(0)).alias("hours"))
            .join(ids, F.col("spot_id") == F.col("_sid"), "left_semi"))


def booking_expiry_stream(log: DataFrame, spots: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """Per known spot, the booking life cycle (:mod:`parkops.operators.cycle`): admit
    requests, extend, check out, and emit ``expired`` whenever a booking's end
    passes, told by the spot's next action or by the horizon.  Invalid actions (no
    time, a duration that is not positive) are left out, late ones are told as ``late``."""
    return decide(_spot_actions(log, spots), "spot_id", BOOKING, ticks)


def _spot_elapse(spot: int, carry: tuple, now: int) -> tuple[tuple, Rows]:
    after, rows = _sweep(spot, carry[:3], now)
    return (*after, carry[3] or bool(rows), *carry[4:]), []


def _spot_step(spot: int, carry: tuple, event: tuple) -> tuple[tuple, Rows]:
    after, rows = _book(spot, carry[:3], event)
    freed = any(r[2] in ("expired", "checked_out") for r in rows)
    return (*after, carry[3] or freed, carry[4] + 1, event[2], event[0], event[1]), []


def _spot_report(spot: int, carry: tuple) -> Rows:
    booking, end, expired, freed, events, action, us, event_id = carry
    return [(spot, action, us_time(us), event_id, booking, us_time(end), expired if booking is not None else None, freed, events)]


SPOT = InOrder(
    payload=BOOKING.payload, start=(None, None, False, False, 0, None, None, None), step=_spot_step,
    carry=_BOOKING | {"freed": "boolean", "events": "long", "last_action": "string", "last_us": "long", "last_event_id": "long"},
    elapse=_spot_elapse, wakes=lambda carry: _booking_end(carry[:3]), report=_spot_report,
    output="spot_id long, last_action string, last_ts timestamp_ntz, last_event_id long, booking_id long, "
           "booking_end_time timestamp_ntz, expired boolean, freed boolean, events long")


def spot_state(log: DataFrame, spots: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """Live state of every known spot that saw an action, told anew whenever it changes:
    by an action or because its booking's end has passed (update mode)."""
    return decide(_spot_actions(log, spots), "spot_id", SPOT, ticks, "update")


def spot_state_out(states: DataFrame, spots: DataFrame) -> DataFrame:
    """The spots' latest states with their flags, as after ``bookings.expire_bookings``: occupied
    while a booking holds; the snapshot's flags hold until a check-out or an expiry."""
    sp = spots.select(F.col("id").alias("_sid"), F.col("is_occupied").alias("_occ"), F.col("is_reserved").alias("_res"))
    free = F.col("freed")
    return states.join(sp, F.col("spot_id") == F.col("_sid"), "left").select(
        "spot_id", "last_action", "last_ts", "last_event_id", "booking_id", "booking_end_time", "expired",
        F.when(F.col("booking_id").isNotNull(), ~F.col("expired")).when(free, False).otherwise(F.col("_occ")).alias("is_occupied"),
        F.when(free, False).otherwise(F.col("_res")).alias("is_reserved"), "events")
