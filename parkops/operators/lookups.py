"""Lookups, projections and join operators over the parking tables.

Dimension joins (zones, spots, vehicles, users) are plain equi-joins; the
planner broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both sides
(AQE splits skewed partitions).  "Current" lookups that the reference does
with a correlated ``LIMIT 1`` subquery are one ``min_by`` aggregate, which
is deterministic and combines map-side, so a hot spot or vehicle does not
land in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import js_or, whole_minutes
from ..schemas import CLIENT_FALLBACK_RATE, DASH
from ..sources.fixtures import as_of_lit

SPOT_COLS = ["id", "spot_number", "zone_id", "spot_type", "is_occupied", "is_reserved", "hourly_rate", "created_at"]
SESSION_COLS = ["id", "vehicle_id", "spot_id", "user_id", "entry_time", "exit_time", "total_amount", "payment_status", "payment_method",
                "created_at"]


def all_of(df: DataFrame, columns: list[str]) -> list[str]:
    """A table's columns (the ``t.*`` of a query), as far as ``df`` has them."""
    return [c for c in columns if c in df.columns]


def _zone_names(zones: DataFrame, with_description: bool = False) -> DataFrame:
    cols = [F.col("id").alias("_zid"), F.col("name").alias("zone_name")]
    if with_description:
        cols.append(F.col("description").alias("zone_description"))
    return zones.select(*cols)


def spots_filtered(spots: DataFrame, zones: DataFrame, zone: str | None = None, spot_type: str | None = None,
                   available: str | None = None) -> DataFrame:
    """Spots with their zone, filtered by optional AND-ed predicates.

    Only the exact string ``'true'`` turns on the availability filter; an
    empty or missing value means "no filter", as in the request handler.
    """
    j = spots.join(_zone_names(zones, True), F.col("zone_id") == F.col("_zid"), "inner")
    preds: list[Column] = []
    if zone:
        preds.append(F.col("zone_name") == zone)
    if spot_type:
        preds.append(F.col("spot_type") == spot_type)
    if available == "true":
        preds.append((F.col("is_occupied") == False) & (F.col("is_reserved") == False))  # noqa: E712
    if preds:
        j = j.filter(reduce(lambda a, b: a & b, preds))
    return j.select(*all_of(spots, SPOT_COLS), "zone_name", "zone_description")


def user_profile(users: DataFrame) -> DataFrame:
    """Public profile columns only (no password hash, flags or update time)."""
    return users.select("id", "username", "email", "full_name", "role", "phone", "created_at")


def user_directory(users: DataFrame) -> DataFrame:
    """All users; a missing or empty phone is shown as a dash."""
    return users.select("id", "full_name", "username", "email",
                        F.coalesce(F.nullif(F.col("phone"), F.lit("")), F.lit(DASH)).alias("phone"),
                        "role")


def _session_context(sessions: DataFrame, vehicles: DataFrame, spots: DataFrame, zones: DataFrame,
                     how: str = "left") -> DataFrame:
    v = vehicles.select(F.col("id").alias("_vid"), "license_plate", "vehicle_type")
    s = spots.select(F.col("id").alias("_sid"), "spot_number", "zone_id", "hourly_rate")
    j = (sessions.join(v, F.col("vehicle_id") == F.col("_vid"), how)
         .join(s, F.col("spot_id") == F.col("_sid"), how)
         .join(_zone_names(zones), F.col("zone_id") == F.col("_zid"), how))
    return j


def session_history(sessions: DataFrame, vehicles: DataFrame, spots: DataFrame, zones: DataFrame) -> DataFrame:
    """Completed sessions, newest first, with both displayed amounts: the
    admin view shows a missing amount as 0, the user view falls back to
    (rate or 5) x hours; a stored 0 stays 0 in both."""
    done = sessions.filter(F.col("exit_time").isNotNull())
    j = _session_context(done, vehicles, spots, zones, "left")
    hours = F.ceil(F.col("duration_minutes") / F.lit(60))
    return (j.select(
        "id", "license_plate", "spot_number", "zone_name", hours.cast("bigint").alias("duration_hours"),
        "entry_time",
        F.coalesce(F.col("total_amount").cast("double"), F.lit(0.0)).alias("admin_amount"),
        F.coalesce(F.col("total_amount").cast("double"),
                   (js_or(F.col("hourly_rate"), CLIENT_FALLBACK_RATE) * hours).cast("double")).alias("user_amount"))
        .orderBy(F.col("id").desc()))


def user_sessions(users: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per user (all users at once): open and completed session counts."""
    agg = sessions.groupBy(F.col("user_id").alias("_uid")).agg(
        F.count_if(F.col("exit_time").isNull()).alias("active_sessions"),
        F.count_if(F.col("exit_time").isNotNull()).alias("completed_sessions"))
    j = users.select("id", "username").join(agg, F.col("id") == F.col("_uid"), "left")
    return j.select(F.col("id").alias("user_id"), "username",
                    F.coalesce("active_sessions", F.lit(0)).cast("bigint").alias("active_sessions"),
                    F.coalesce("completed_sessions", F.lit(0)).cast("bigint").alias("completed_sessions"))


def active_sessions(sessions: DataFrame, vehicles: DataFrame, spots: DataFrame, zones: DataFrame,
                    as_of: str) -> DataFrame:
    """Open sessions at ``as_of`` with plate, type, spot and zone, and the
    whole minutes parked so far (shadowing the stored duration), newest
    entry first.  Inner joins: a session whose vehicle, spot or zone is
    missing is not listed."""
    now = as_of_lit(as_of)
    open_ = sessions.filter(F.col("exit_time").isNull() & (F.col("entry_time") <= now)).drop("duration_minutes")
    own = all_of(sessions, SESSION_COLS)
    j = _session_context(open_.select(*own), vehicles, spots, zones, "inner").withColumn("total_amount", F.col("total_amount").cast("double"))
    return (j.select(*own, "license_plate", "vehicle_type", "spot_number", "zone_name",
                     whole_minutes("entry_time", now).alias("duration_minutes"))
            .orderBy(F.col("entry_time").desc(), F.col("id").desc()))


def _open_sessions_at(sessions: DataFrame, as_of: str | None) -> DataFrame:
    f = F.col("exit_time").isNull()
    if as_of is not None:
        f = f & (F.col("entry_time") <= as_of_lit(as_of))
    return sessions.filter(f)


def spot_detail(spots: DataFrame, zones: DataFrame, sessions: DataFrame, vehicles: DataFrame,
                as_of: str | None = None) -> DataFrame:
    """Every spot with its zone and the plate parked there now (the earliest
    open session, by entry time then id, when several are open)."""
    v = vehicles.select(F.col("id").alias("_vid"), "license_plate")
    cur = (_open_sessions_at(sessions, as_of).join(v, F.col("vehicle_id") == F.col("_vid"), "inner")
           .groupBy(F.col("spot_id").alias("_cur_sid"))
           .agg(F.min_by("license_plate", F.struct("entry_time", "id")).alias("current_vehicle")))
    j = (spots.join(_zone_names(zones), F.col("zone_id") == F.col("_zid"), "inner")
         .join(cur, F.col("id") == F.col("_cur_sid"), "left"))
    return j.select(*all_of(spots, SPOT_COLS), "zone_name", "current_vehicle")


def _current_spot_by_vehicle(sessions: DataFrame, spots: DataFrame, as_of: str | None) -> DataFrame:
    s = spots.select(F.col("id").alias("_sid"), "spot_number")
    return (_open_sessions_at(sessions, as_of).join(s, F.col("spot_id") == F.col("_sid"), "inner")
            .groupBy(F.col("vehicle_id").alias("_cur_vid"))
            .agg(F.min_by(F.struct(F.col("spot_number").alias("spot_number"),
                                   F.col("entry_time").alias("entry_time")),
                          F.struct("entry_time", "id")).alias("_cur")))


_VEHICLE_REST = ("make", "model", "color", "created_at", "updated_at")


def vehicles_list(vehicles: DataFrame, users: DataFrame, sessions: DataFrame, spots: DataFrame,
                  as_of: str | None = None) -> DataFrame:
    """All vehicles with owner name / e-mail and current spot, newest first."""
    u = users.select(F.col("id").alias("_uid"), F.col("username").alias("owner_username"),
                     F.col("email").alias("owner_email"))
    cur = _current_spot_by_vehicle(sessions, spots, as_of)
    j = (vehicles.join(u, F.col("user_id") == F.col("_uid"), "left")
         .join(cur, F.col("id") == F.col("_cur_vid"), "left"))
    return (j.select("id", "user_id", "license_plate", "vehicle_type", *_VEHICLE_REST, "owner_username",
                     "owner_email", F.col("_cur.spot_number").alias("current_spot"))
            .orderBy(F.col("created_at").desc(), F.col("id").desc()))


def my_vehicles(vehicles: DataFrame, sessions: DataFrame, spots: DataFrame, as_of: str | None = None) -> DataFrame:
    """Each owner's vehicles (all owners at once) with current spot and entry
    time taken from the same open session."""
    cur = _current_spot_by_vehicle(sessions, spots, as_of)
    j = vehicles.filter(F.col("user_id").isNotNull()).join(cur, F.col("id") == F.col("_cur_vid"), "left")
    return (j.select("id", "user_id", "license_plate", "vehicle_type", *_VEHICLE_REST,
                     F.col("_cur.spot_number").alias("current_spot"), F.col("_cur.entry_time").alias("entry_time"))
            .orderBy("user_id", F.col("created_at").desc(), F.col("id").desc()))


def user_reservations(reservations: DataFrame, spots: DataFrame, zones: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Active reservations of every user with spot, zone and plate, by start."""
    s = spots.select(F.col("id").alias("_sid"), "spot_number", "zone_id")
    v = vehicles.select(F.col("id").alias("_vid"), "license_plate")
    j = (reservations.filter(F.col("status") == "active")
         .join(s, F.col("spot_id") == F.col("_sid"), "inner")
         .join(_zone_names(zones), F.col("zone_id") == F.col("_zid"), "inner")
         .join(v, F.col("vehicle_id") == F.col("_vid"), "left"))
    return (j.select("id", "user_id", "spot_id", "vehicle_id", "start_time", "end_time", "status",
                     F.col("total_amount").cast("double").alias("total_amount"), "payment_status", "created_at",
                     "spot_number", "zone_name", "license_plate")
            .orderBy("user_id", "start_time", "id"))


def active_session_for_vehicle(sessions: DataFrame, spots: DataFrame, as_of: str | None = None) -> DataFrame:
    """Per vehicle, the open session a check-out closes: the latest entry
    (id breaks ties) among open sessions on a known spot, with its rate."""
    s = spots.select(F.col("id").alias("_sid"), "hourly_rate")
    j = _open_sessions_at(sessions, as_of).join(s, F.col("spot_id") == F.col("_sid"), "inner")
    pick = F.max_by(F.struct(F.col("id").alias("session_id"), F.col("spot_id").alias("spot_id"),
                             F.col("entry_time").alias("entry_time"), F.col("hourly_rate").alias("hourly_rate")),
                    F.struct("entry_time", "id"))
    g = j.groupBy("vehicle_id").agg(pick.alias("s"))
    return g.select("vehicle_id", "s.session_id", "s.spot_id", "s.entry_time",
                    F.col("s.hourly_rate").cast("double").alias("hourly_rate"))


def booking_rows(sessions: DataFrame, vehicles: DataFrame, spots: DataFrame, zones: DataFrame,
                 as_of: str | None = None) -> DataFrame:
    """Open bookings with the spot found by the session's ``spot_number`` (the first spot with that number, by id)
    and the booked cost (rate or 5) x booked hours; a session whose spot is gone still shows."""
    first = spots.groupBy(F.col("spot_number").alias("_number")).agg(F.min_by(F.struct("zone_id", "hourly_rate"), "id").alias("_s"))
    v = vehicles.select(F.col("id").alias("_vid"), "license_plate")
    j = (_open_sessions_at(sessions, as_of).join(v, F.col("vehicle_id") == F.col("_vid"), "left")
         .join(first, F.col("spot_number") == F.col("_number"), "left")
         .join(_zone_names(zones), F.col("_s.zone_id") == F.col("_zid"), "left"))
    rate = js_or(F.col("_s.hourly_rate"), CLIENT_FALLBACK_RATE)
    return j.select("id", "license_plate", "spot_number", "zone_name",
                    F.col("booked_hours").alias("duration_hours"), "entry_time",
                    (F.col("entry_time") + F.make_dt_interval(hours=F.col("booked_hours"))).alias("end_time"),
                    rate.cast("double").alias("hourly_rate"),
                    (rate * F.col("booked_hours")).cast("double").alias("booking_cost"))


def identity_resolve(handles: DataFrame, users: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Resolve login handles (username or e-mail) to active users.

    The server's collation takes letters of either case as equal (the handle as it is
    typed stays in the result); ``case_sensitive`` is the client's rule.  The
    ``username = h OR email = h`` test would plan as a nested-loop join;
    it is split into two equi-joins whose matches are unioned and
    de-duplicated.  Handles without a match keep a NULL user.
    """
    def key(c):   # a binary key, so that the joins hash and sort as plain strings do
        return F.col(c) if case_sensitive else F.lower(F.col(c))

    act = users.filter(F.col("is_active") == True)  # noqa: E712
    h = handles.select("handle_id", "handle", key("handle").alias("_h"))
    found = [h.join(act.select(F.col("id").alias("user_id"), "role", key(c).alias("_h")), "_h").select("handle_id", "user_id", "role")
             for c in ("username", "email")]
    matches = found[0].unionByName(found[1]).distinct()
    return h.join(matches, "handle_id", "left").select("handle_id", "handle", "user_id", "role")
