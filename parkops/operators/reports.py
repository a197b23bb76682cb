"""Reporting operators: KPIs, revenue, distributions, occupancy.

Every operator is a pure function of DataFrames plus an explicit ``as_of``.
Fact tables are aggregated before they meet a dimension, so a shuffle carries
partial aggregates (one row per key and map task), never raw rows; a hot key
is absorbed by the map-side combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pct, pct_int, whole_minutes
from ..plans.materialize import materialize
from ..schemas import ACTIVITY_CHECK_IN, ACTIVITY_CHECK_OUT, CLIENT_ZONE_LABEL
from ..sources.fixtures import as_of_lit


def _spot_counts_by_zone(spots: DataFrame) -> DataFrame:
    """Per zone: spots, occupied, free (neither flag), reserved (overlapping)."""
    return (spots.groupBy("zone_id").agg(
        F.count("id").alias("n_spots"),
        F.count_if(F.col("is_occupied") == True).alias("n_occupied"),  # noqa: E712
        F.count_if((F.col("is_occupied") == False) & (F.col("is_reserved") == False)).alias("n_free"),  # noqa: E712
        F.count_if(F.col("is_reserved") == True).alias("n_reserved"),  # noqa: E712
    ))


def zone_occupancy(zones: DataFrame, spots: DataFrame) -> DataFrame:
    """Active zones with total / occupied / available spots and occupancy %.

    A zone without spots reports zeros and a NULL rate.  Spots are reduced to
    one row per zone before the join, so only a zone-sized table is joined.
    """
    counts = _spot_counts_by_zone(spots)
    z = zones.filter(F.col("is_active") == True)  # noqa: E712
    j = z.join(counts, z["id"] == counts["zone_id"], "left")
    total = F.coalesce(F.col("n_spots"), F.lit(0))
    occupied = F.coalesce(F.col("n_occupied"), F.lit(0))
    return j.select(
        z["id"].alias("id"),
        z["name"].alias("zone_name"),
        z["description"].alias("description"),
        total.cast("bigint").alias("total_spots"),
        occupied.cast("bigint").alias("occupied"),
        F.coalesce(F.col("n_free"), F.lit(0)).cast("bigint").alias("available"),
        pct(occupied, total, 2).alias("occupancy_rate"),
    )


def _day_bounds(as_of: str):
    day = F.to_date(as_of_lit(as_of)).cast("timestamp_ntz")
    return day, day + F.expr("INTERVAL 1 DAY")


def spot_kpis(spots: DataFrame, js_truthy: bool = False) -> DataFrame:
    """One row: total / occupied / available / reserved spots.

    ``js_truthy`` treats a NULL flag as false (client); otherwise the SQL
    rule applies (NULL matches neither TRUE nor FALSE).
    """
    occ, res = F.col("is_occupied"), F.col("is_reserved")
    if js_truthy:
        occ, res = F.coalesce(occ, F.lit(False)), F.coalesce(res, F.lit(False))
    return spots.agg(
        F.count(F.lit(1)).alias("total_spots"),
        F.count_if(occ == True).alias("occupied_spots"),  # noqa: E712
        F.count_if((occ == False) & (res == False)).alias("available_spots"),  # noqa: E712
        F.count_if(res == True).alias("reserved_spots"),  # noqa: E712
    )


def dashboard_kpis(spots: DataFrame, sessions: DataFrame, as_of: str) -> DataFrame:
    """Server dashboard: spot counts, paid revenue of sessions that left on
    the as-of date, distinct vehicles that entered that date, occupancy %.

    Each table is scanned once; the date tests are half-open ranges so they
    can be pushed to the scan.
    """
    lo, hi = _day_bounds(as_of)
    exited_today = (F.col("exit_time") >= lo) & (F.col("exit_time") < hi)
    entered_today = (F.col("entry_time") >= lo) & (F.col("entry_time") < hi)
    s = (sessions.filter(exited_today | entered_today)
         .agg(F.coalesce(F.sum(F.when(exited_today & (F.col("payment_status") == "paid"),
                                      F.col("total_amount"))), F.lit(0)).cast("double").alias("today_revenue"),
              F.count_distinct(F.when(entered_today, F.col("vehicle_id"))).alias("today_vehicles")))
    k = spot_kpis(spots)
    return (k.crossJoin(s).select(
        "total_spots", "occupied_spots", "available_spots", "reserved_spots", "today_revenue",
        "today_vehicles", pct_int(F.col("occupied_spots"), F.col("total_spots")).alias("occupancy_rate")))


def dashboard_kpis_client(spots: DataFrame, sessions: DataFrame, as_of: str,
                          flat_rate: float = 5.0) -> DataFrame:
    """Client dashboard: revenue = every completed amount plus open time at a
    flat rate (minutes / 60 * rate), rounded to cents, with no date filter;
    vehicles = number of sessions."""
    s = sessions.agg(_client_revenue(as_of, flat_rate).alias("today_revenue"),
                     F.count(F.lit(1)).alias("today_vehicles"))
    k = spot_kpis(spots, js_truthy=True)
    return k.crossJoin(s).select(
        "total_spots", "occupied_spots", "available_spots", "reserved_spots", "today_revenue",
        "today_vehicles", pct_int(F.col("occupied_spots"), F.col("total_spots")).alias("occupancy_rate"))


def weekly_revenue(sessions: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Paid revenue per exit date over the ``days`` x 24 h before ``as_of``
    (up to ``days`` + 1 calendar dates), with the English day name."""
    now = as_of_lit(as_of)
    lo = now - F.make_dt_interval(days=F.lit(days))
    f = sessions.filter((F.col("exit_time") >= lo) & (F.col("exit_time") <= now)
                        & (F.col("payment_status") == "paid"))
    return (f.groupBy(F.to_date("exit_time").alias("_d"))
            .agg(F.coalesce(F.sum("total_amount"), F.lit(0)).cast("double").alias("revenue"),
                 F.count(F.lit(1)).alias("transactions"))
            .select(F.date_format("_d", "yyyy-MM-dd").alias("date"),
                    F.date_format("_d", "EEEE").alias("day_name"), "revenue", "transactions")
            .orderBy("date"))


def vehicle_distribution(vehicles: DataFrame) -> DataFrame:
    return vehicles.groupBy("vehicle_type").agg(F.count(F.lit(1)).alias("count"))


def peak_hours(sessions: DataFrame, as_of: str, days: int = 30, top: int = 10) -> DataFrame:
    """Top ``top`` hours of day by entries over the last ``days`` days, with
    the mean whole-minute stay (open sessions count as entries only).
    Ties on the count go to the earlier hour; the limit is the feature."""
    now = as_of_lit(as_of)
    f = sessions.filter((F.col("entry_time") >= now - F.make_dt_interval(days=F.lit(days)))
                        & (F.col("entry_time") <= now))
    return (f.groupBy(F.hour("entry_time").alias("hour"))
            .agg(F.count(F.lit(1)).alias("entry_count"),
                 F.round(F.avg(whole_minutes("entry_time", "exit_time")), 4).alias("avg_duration"))
            .orderBy(F.col("entry_count").desc(), F.col("hour").asc())
            .limit(top))


def zones_summary(zones: DataFrame, spots: DataFrame) -> DataFrame:
    """Active zones with overlapping counts (occupied and reserved both
    count a spot flagged both); the stored ``total_spots`` is kept as
    ``declared_spots`` next to the computed one."""
    counts = _spot_counts_by_zone(spots)
    z = zones.filter(F.col("is_active") == True)  # noqa: E712
    j = z.join(counts, z["id"] == counts["zone_id"], "left")

    def z0(c):
        return F.coalesce(F.col(c), F.lit(0)).cast("bigint")

    return j.select(z["id"], z["name"], z["description"], z["total_spots"].alias("declared_spots"),
                    z["is_active"], *[z[c] for c in ("created_at",) if c in z.columns], z0("n_spots").alias("total_spots"), z0("n_free").alias("available_spots"),
                    z0("n_occupied").alias("occupied_spots"), z0("n_reserved").alias("reserved_spots"))


def zones_summary_client(zones: DataFrame, spots: DataFrame) -> DataFrame:
    """Client zone cards: exclusive buckets (occupied, else reserved, else
    available) built from the spots, so a zone without spots does not
    appear; utilisation is a rounded integer percentage."""
    occ = F.coalesce(F.col("is_occupied"), F.lit(False))
    res = F.coalesce(F.col("is_reserved"), F.lit(False))
    counts = spots.groupBy("zone_id").agg(
        F.count(F.lit(1)).alias("total_spots"),
        F.count_if(~occ & ~res).alias("available_spots"),
        F.count_if(occ).alias("occupied_spots"),
        F.count_if(~occ & res).alias("reserved_spots"))
    zn = zones.select(F.col("id").alias("_zid"), F.col("name").alias("name"))
    j = counts.join(zn, counts["zone_id"] == zn["_zid"], "left")
    return j.select(
        F.col("zone_id").alias("id"), "name",
        F.concat(F.lit(CLIENT_ZONE_LABEL), F.col("name")).alias("description"),
        "total_spots", "available_spots", "occupied_spots", "reserved_spots",
        pct_int(F.col("occupied_spots"), F.col("total_spots")).alias("utilisation"))


def spot_type_availability(spots: DataFrame) -> DataFrame:
    """Per spot type: total, free (neither flag), occupied and not occupied
    (reserved spots included; this is the "EV free" figure for electric)."""
    occ = F.coalesce(F.col("is_occupied"), F.lit(False))
    res = F.coalesce(F.col("is_reserved"), F.lit(False))
    return spots.groupBy("spot_type").agg(
        F.count(F.lit(1)).alias("total_spots"),
        F.count_if(~occ & ~res).alias("available_spots"),
        F.count_if(occ).alias("occupied_spots"),
        F.count_if(~occ).alias("unoccupied_spots"))


def _client_revenue(as_of: str, flat_rate: float):
    """Aggregate expression of the client dashboard revenue (sessions only)."""
    now_ms = F.unix_millis(as_of_lit(as_of).cast("timestamp"))
    open_ms = now_ms - F.unix_millis(F.col("entry_time").cast("timestamp"))
    completed = (F.col("duration_minutes") > 0) & F.col("total_amount").isNotNull() & (F.col("total_amount") != 0)
    done = F.coalesce(F.sum(F.when(completed, F.col("total_amount").cast("double"))), F.lit(0.0))
    live = F.coalesce(F.sum(F.when(F.col("exit_time").isNull(), open_ms / 60000.0 / 60.0 * flat_rate)), F.lit(0.0))
    return F.round(done + live, 2)


def revenue_summary(sessions: DataFrame, as_of: str, flat_rate: float = 5.0) -> DataFrame:
    """Client revenue card: completed total, booked-hours estimate of open
    sessions at a flat rate, and the dashboard total (need not add up).
    One aggregate over the sessions."""
    done = F.col("exit_time").isNotNull() & (F.col("duration_minutes") > 0)
    is_open = F.col("exit_time").isNull()
    return sessions.agg(
        F.round(F.coalesce(F.sum(F.when(done, F.coalesce(F.col("total_amount"), F.lit(0)))), F.lit(0))
                .cast("double"), 2).alias("completed_total"),
        F.round(F.coalesce(F.sum(F.when(is_open, F.col("booked_hours") * flat_rate)), F.lit(0.0))
                .cast("double"), 2).alias("active_estimate"),
        _client_revenue(as_of, flat_rate).alias("kpi_total"))


def occupancy_profile(zones: DataFrame, spots: DataFrame, sessions: DataFrame, as_of: str,
                      days: int = 7) -> DataFrame:
    """Per active zone and hour of day: mean share of the zone's spots that
    were occupied in that hour over the ``days`` calendar dates up to
    ``as_of`` (predicted_occupancy, %), with the day-to-day spread turned
    into a confidence (100 - population std-dev of the %), for the 24 hours
    that follow ``as_of``; shaped like ``ai_predictions``.

    Sessions are cut to the window before the hour explode, distinct
    spot-hours are counted per zone with a map-side combine, and the only
    cross join is the zone x hour grid used to put in the empty hours.
    """
    now = as_of_lit(as_of)
    day0 = F.date_sub(F.to_date(now), days - 1).cast("timestamp_ntz")
    end = F.coalesce(F.col("exit_time"), now)
    # a row that ends before it begins (clock errors) covers no hour
    live = sessions.filter((F.col("entry_time") <= now) & (end >= day0) & (end >= F.col("entry_time")))
    sp = spots.select(F.col("id").alias("_sid"), F.col("zone_id"))
    hours = (live.join(sp, live["spot_id"] == sp["_sid"], "inner")
             .select("zone_id", "spot_id",
                     F.explode(F.sequence(F.date_trunc("hour", F.greatest(F.col("entry_time"), day0)),
                                          F.date_trunc("hour", F.least(end, now)),
                                          F.expr("INTERVAL 1 HOUR"))).alias("h")))
    per_hour = (hours.groupBy("zone_id", "h").agg(F.count_distinct("spot_id").alias("n_occ")))
    zone_size = spots.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n_spots"))
    active = (zones.filter(F.col("is_active") == True)  # noqa: E712
              .join(zone_size, zones["id"] == zone_size["zone_id"], "inner")
              .select(F.col("id").alias("zone_id"), "n_spots"))
    spark = zones.sparkSession
    grid_h = (spark.range(days * 24)
              .select((day0 + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("h"))
              .filter(F.col("h") <= now))
    grid = active.crossJoin(grid_h)
    filled = (grid.join(per_hour, ["zone_id", "h"], "left")
              .select("zone_id", F.hour("h").alias("hour"),
                      (F.coalesce(F.col("n_occ"), F.lit(0)) * 100.0 / F.col("n_spots")).alias("pct")))
    prof = filled.groupBy("zone_id", "hour").agg(F.avg("pct").alias("m"), F.stddev_pop("pct").alias("sd"))
    ahead = spark.range(24).select(
        (F.date_trunc("hour", now) + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("t"))
    ahead = ahead.select(F.to_date("t").alias("prediction_date"), F.hour("t").alias("hour"))
    return (prof.join(ahead, "hour").select(
        F.col("zone_id").cast("int").alias("zone_id"), "prediction_date", F.col("hour").cast("int").alias("hour"),
        F.round(F.col("m"), 2).cast("double").alias("predicted_occupancy"),
        F.lit(None).cast("double").alias("actual_occupancy"),
        F.round(F.greatest(F.lit(0.0), F.lit(100.0) - F.col("sd")), 2).cast("double").alias("confidence_score")))


def recent_activity(sessions: DataFrame, vehicles: DataFrame, spots: DataFrame, zones: DataFrame,
                    as_of: str, top: int = 20) -> DataFrame:
    """Latest ``top`` check-in / check-out events (plate, spot, zone, time).

    Each session yields its events through an ``explode``; the newest events
    are taken by their ids alone (``TakeOrderedAndProject``: a top-k per partition, then
    a merge), written, and only they are joined.  Events without a vehicle,
    spot or zone drop out; while that leaves fewer than ``top`` and there are more
    events, eight times as many are taken.  Ties are broken by action and
    session id; the limit is the feature.
    """
    now = as_of_lit(as_of)
    ev = F.array(
        F.struct(F.lit(ACTIVITY_CHECK_IN).alias("action"), F.col("entry_time").alias("timestamp")),
        F.struct(F.lit(ACTIVITY_CHECK_OUT).alias("action"),
                 F.when(F.col("exit_time") <= now, F.col("exit_time")).alias("timestamp")))
    events = (sessions.filter(F.col("entry_time") <= now)
              .select(F.col("id").alias("session_id"), "vehicle_id", "spot_id", F.explode(ev).alias("e"))
              .filter(F.col("e.timestamp").isNotNull())
              .select("session_id", "vehicle_id", "spot_id", "e.action", "e.timestamp"))
    newest = [F.col("timestamp").desc(), F.col("action").asc(), F.col("session_id").desc()]
    v = vehicles.select(F.col("id").alias("_vid"), "license_plate")
    s = spots.select(F.col("id").alias("_sid"), "spot_number", "zone_id")
    z = zones.select(F.col("id").alias("_zid"), F.col("name").alias("zone_name"))
    take = 2 * top
    while True:
        some = materialize(events.orderBy(*newest).limit(take), "newest-events")
        found = (some.join(v, F.col("vehicle_id") == F.col("_vid")).join(s, F.col("spot_id") == F.col("_sid"))
                 .join(z, F.col("zone_id") == F.col("_zid"))
                 .select("action", "license_plate", "spot_number", "zone_name", "timestamp", "session_id"))
        found = materialize(found.orderBy(*newest).limit(top), "recent-activity")
        if found.count() >= top or some.count() < take:
            return found.orderBy(*newest)
        take *= 8
