"""Registered queries: each runs one operator on the whole driver tables.

Money is cast to DOUBLE and counts to BIGINT on both sides; every computed
column is aliased identically in the Spark code and the oracle SQL.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import billing, bookings as bk, changes, cycle, daily, imports, lifecycle, lookups, reports, seeds
from ..session import scratch_dir
from ..sources import documents, io
from ..sources.fixtures import AS_OF, PEAK_AS_OF, model
from ..streaming import jobs as sj
from ..streaming.runner import log_end, run_available_now, run_to_end
from .catalog import register

# ---------------------------------------------------------------------------
# Reports
# ---------------------------------------------------------------------------


@register("zone_occupancy", """
    WITH per_zone AS (
        SELECT zone_id, count(*) AS n, count(*) FILTER (WHERE is_occupied) AS taken,
               count(*) FILTER (WHERE NOT is_occupied AND NOT is_reserved) AS free
        FROM parking_spots GROUP BY zone_id)
    SELECT zones.id, zones.name AS zone_name, zones.description, coalesce(n, 0) AS total_spots,
           coalesce(taken, 0) AS occupied, coalesce(free, 0) AS available, round(100.0::DOUBLE * taken / n, 2) AS occupancy_rate
    FROM zones LEFT JOIN per_zone ON per_zone.zone_id = zones.id WHERE zones.is_active
""")
def q_zone_occupancy(spark, base):
    m = model(spark, base)
    return reports.zone_occupancy(m.zones, m.spots)


NOW = f"TIMESTAMP '{AS_OF}'"
PEAK_NOW = f"TIMESTAMP '{PEAK_AS_OF}'"

SPOT_KPIS_SQL = """
    SELECT COUNT(*) AS total_spots,
           COUNT(*) FILTER (WHERE is_occupied = TRUE) AS occupied_spots,
           COUNT(*) FILTER (WHERE is_occupied = FALSE AND is_reserved = FALSE) AS available_spots,
           COUNT(*) FILTER (WHERE is_reserved = TRUE) AS reserved_spots
    FROM parking_spots"""

SPOT_KPIS_JS_SQL = """
    SELECT COUNT(*) AS total_spots,
           COUNT(*) FILTER (WHERE coalesce(is_occupied, FALSE)) AS occupied_spots,
           COUNT(*) FILTER (WHERE NOT coalesce(is_occupied, FALSE) AND NOT coalesce(is_reserved, FALSE))
               AS available_spots,
           COUNT(*) FILTER (WHERE coalesce(is_reserved, FALSE)) AS reserved_spots
    FROM parking_spots"""

CLIENT_REVENUE_SQL = f"""
    SELECT round(
        COALESCE(SUM(CASE WHEN duration_minutes > 0 AND total_amount IS NOT NULL AND total_amount <> 0
                          THEN CAST(total_amount AS DOUBLE) END), 0.0)
      + COALESCE(SUM(CASE WHEN exit_time IS NULL
                          THEN ((epoch_us({NOW}) // 1000) - (epoch_us(entry_time) // 1000)) / 60000.0 / 60.0 * 5.0 END), 0.0),
        2) AS today_revenue,
        COUNT(*) AS today_vehicles
    FROM parking_sessions"""


def occ_rate_sql(occ: str, total: str) -> str:
    return (f"CASE WHEN {total} > 0 THEN CAST(round(CAST({occ} AS DOUBLE) * 100.0 / {total}) AS BIGINT) "
            f"ELSE 0 END")


@register("dashboard_kpis", f"""
    WITH k AS ({SPOT_KPIS_SQL}),
    s AS (
        SELECT CAST(COALESCE(SUM(total_amount) FILTER (
                   WHERE CAST(exit_time AS DATE) = CAST({NOW} AS DATE) AND payment_status = 'paid'), 0)
                   AS DOUBLE) AS today_revenue,
               COUNT(DISTINCT vehicle_id) FILTER (WHERE CAST(entry_time AS DATE) = CAST({NOW} AS DATE))
                   AS today_vehicles
        FROM parking_sessions)
    SELECT k.total_spots, k.occupied_spots, k.available_spots, k.reserved_spots, s.today_revenue,
           s.today_vehicles, {occ_rate_sql('k.occupied_spots', 'k.total_spots')} AS occupancy_rate
    FROM k CROSS JOIN s
""")
def q_dashboard_kpis(spark, base):
    """From the day's partials; here the whole history is loaded first, as one load."""
    m = model(spark, base)
    path = scratch_dir(spark, "session-days")
    daily.load_sessions(m.sessions, path, 0)
    return daily.dashboard_kpis(m.spots, path, AS_OF)


@register("dashboard_kpis_client", f"""
    WITH k AS ({SPOT_KPIS_JS_SQL}), s AS ({CLIENT_REVENUE_SQL})
    SELECT k.total_spots, k.occupied_spots, k.available_spots, k.reserved_spots, s.today_revenue,
           s.today_vehicles, {occ_rate_sql('k.occupied_spots', 'k.total_spots')} AS occupancy_rate
    FROM k CROSS JOIN s
""")
def q_dashboard_kpis_client(spark, base):
    m = model(spark, base)
    return reports.dashboard_kpis_client(m.spots, m.sessions, AS_OF)


@register("weekly_revenue", f"""
    SELECT strftime(CAST(exit_time AS DATE), '%Y-%m-%d') AS date,
           dayname(CAST(exit_time AS DATE)) AS day_name,
           CAST(COALESCE(SUM(total_amount), 0) AS DOUBLE) AS revenue,
           COUNT(*) AS transactions
    FROM parking_sessions
    WHERE exit_time >= {NOW} - INTERVAL 7 DAY AND exit_time <= {NOW} AND payment_status = 'paid'
    GROUP BY 1, 2
    ORDER BY date
""")
def q_weekly_revenue(spark, base):
    """From the week's partials; here the whole history is loaded first, as one load."""
    path = scratch_dir(spark, "session-days")
    daily.load_sessions(model(spark, base).sessions, path, 0, ["exits"])
    return daily.weekly_revenue(spark, path, AS_OF)


@register("vehicle_distribution", """
    SELECT vehicle_type, COUNT(*) AS "count" FROM vehicles GROUP BY vehicle_type
""")
def q_vehicle_distribution(spark, base):
    return reports.vehicle_distribution(model(spark, base).vehicles)


@register("peak_hours", f"""
    SELECT CAST(hour(entry_time) AS INTEGER) AS hour, COUNT(*) AS entry_count,
           round(AVG(datesub('minute', entry_time, exit_time)), 4) AS avg_duration
    FROM parking_sessions
    WHERE entry_time >= {PEAK_NOW} - INTERVAL 30 DAY AND entry_time <= {PEAK_NOW}
    GROUP BY 1
    ORDER BY entry_count DESC, hour ASC
    LIMIT 10
""")
def q_peak_hours(spark, base):
    return reports.peak_hours(model(spark, base).sessions, PEAK_AS_OF)


@register("zones_summary", """
    WITH per_zone AS (
        SELECT zone_id, count(*) AS n, count(*) FILTER (WHERE is_occupied) AS taken,
               count(*) FILTER (WHERE NOT is_occupied AND NOT is_reserved) AS free,
               count(*) FILTER (WHERE is_reserved) AS held
        FROM parking_spots GROUP BY zone_id)
    SELECT zones.id, zones.name, zones.description, zones.total_spots AS declared_spots, zones.is_active, zones.created_at,
           coalesce(n, 0) AS total_spots, coalesce(free, 0) AS available_spots,
           coalesce(taken, 0) AS occupied_spots, coalesce(held, 0) AS reserved_spots
    FROM zones LEFT JOIN per_zone ON per_zone.zone_id = zones.id WHERE zones.is_active
""")
def q_zones_summary(spark, base):
    m = model(spark, base)
    return reports.zones_summary(m.zones, m.spots)


@register("zones_summary_client", f"""
    WITH c AS (
        SELECT zone_id, COUNT(*) AS total_spots,
               COUNT(*) FILTER (WHERE NOT coalesce(is_occupied, FALSE) AND NOT coalesce(is_reserved, FALSE))
                   AS available_spots,
               COUNT(*) FILTER (WHERE coalesce(is_occupied, FALSE)) AS occupied_spots,
               COUNT(*) FILTER (WHERE NOT coalesce(is_occupied, FALSE) AND coalesce(is_reserved, FALSE))
                   AS reserved_spots
        FROM parking_spots GROUP BY zone_id)
    SELECT c.zone_id AS id, z.name, 'Zone ' || z.name AS description, c.total_spots, c.available_spots,
           c.occupied_spots, c.reserved_spots, {occ_rate_sql('c.occupied_spots', 'c.total_spots')} AS utilisation
    FROM c LEFT JOIN zones z ON c.zone_id = z.id
""")
def q_zones_summary_client(spark, base):
    m = model(spark, base)
    return reports.zones_summary_client(m.zones, m.spots)


@register("spot_type_availability", """
    SELECT spot_type, COUNT(*) AS total_spots,
           COUNT(*) FILTER (WHERE NOT coalesce(is_occupied, FALSE) AND NOT coalesce(is_reserved, FALSE))
               AS available_spots,
           COUNT(*) FILTER (WHERE coalesce(is_occupied, FALSE)) AS occupied_spots,
           COUNT(*) FILTER (WHERE NOT coalesce(is_occupied, FALSE)) AS unoccupied_spots
    FROM parking_spots GROUP BY spot_type
""")
def q_spot_type_availability(spark, base):
    return reports.spot_type_availability(model(spark, base).spots)


@register("revenue_summary", f"""
    WITH s AS (
        SELECT round(CAST(COALESCE(SUM(CASE WHEN exit_time IS NOT NULL AND duration_minutes > 0
                                            THEN COALESCE(total_amount, 0) END), 0) AS DOUBLE), 2)
                   AS completed_total,
               round(CAST(COALESCE(SUM(CASE WHEN exit_time IS NULL THEN booked_hours * 5.0 END), 0.0)
                          AS DOUBLE), 2) AS active_estimate
        FROM parking_sessions),
    k AS ({CLIENT_REVENUE_SQL})
    SELECT s.completed_total, s.active_estimate, k.today_revenue AS kpi_total FROM s CROSS JOIN k
""")
def q_revenue_summary(spark, base):
    m = model(spark, base)
    return reports.revenue_summary(m.sessions, AS_OF)


@register("occupancy_profile", f"""
    WITH params AS (
        SELECT {NOW} AS now, CAST(CAST({NOW} AS DATE) - INTERVAL 6 DAY AS TIMESTAMP) AS day0),
    live AS (
        SELECT s.spot_id, p.zone_id, greatest(s.entry_time, day0) AS a,
               least(coalesce(s.exit_time, now), now) AS b
        FROM parking_sessions s JOIN parking_spots p ON s.spot_id = p.id CROSS JOIN params
        WHERE s.entry_time <= now AND coalesce(s.exit_time, now) >= day0),
    hrs AS (
        SELECT zone_id, spot_id,
               unnest(generate_series(date_trunc('hour', a), date_trunc('hour', b), INTERVAL 1 HOUR)) AS h
        FROM live),
    per_hour AS (SELECT zone_id, h, COUNT(DISTINCT spot_id) AS n_occ FROM hrs GROUP BY zone_id, h),
    zs AS (SELECT zone_id, COUNT(*) AS n_spots FROM parking_spots GROUP BY zone_id),
    act AS (SELECT z.id AS zone_id, zs.n_spots FROM zones z JOIN zs ON z.id = zs.zone_id WHERE z.is_active),
    grid_h AS (
        SELECT day0 + to_hours(i) AS h FROM params CROSS JOIN range(7 * 24) t(i)
        WHERE day0 + to_hours(i) <= now),
    filled AS (
        SELECT a.zone_id, hour(g.h) AS hour,
               CAST(coalesce(p.n_occ, 0) AS DOUBLE) * 100.0 / a.n_spots AS pct
        FROM act a CROSS JOIN grid_h g LEFT JOIN per_hour p ON p.zone_id = a.zone_id AND p.h = g.h),
    prof AS (SELECT zone_id, hour, avg(pct) AS m, stddev_pop(pct) AS sd FROM filled GROUP BY zone_id, hour),
    ahead AS (
        SELECT CAST(date_trunc('hour', now) + to_hours(i) AS DATE) AS prediction_date,
               hour(date_trunc('hour', now) + to_hours(i)) AS hour
        FROM params CROSS JOIN range(24) t(i))
    SELECT CAST(p.zone_id AS INTEGER) AS zone_id, strftime(a.prediction_date, '%Y-%m-%d') AS prediction_date,
           CAST(a.hour AS INTEGER) AS hour,
           round(p.m, 2) AS predicted_occupancy, CAST(NULL AS DOUBLE) AS actual_occupancy,
           round(greatest(0.0, 100.0 - p.sd), 2) AS confidence_score
    FROM prof p JOIN ahead a ON p.hour = a.hour
""")
def q_occupancy_profile(spark, base):
    m = model(spark, base)
    out = reports.occupancy_profile(m.zones, m.spots, m.sessions, AS_OF)
    # dates travel as ISO text so both engines hash them alike
    return out.withColumn("prediction_date", F.date_format("prediction_date", "yyyy-MM-dd"))


@register("recent_activity", f"""
    WITH j AS (
        SELECT s.id AS session_id, v.license_plate, p.spot_number, z.name AS zone_name,
               s.entry_time, s.exit_time
        FROM parking_sessions s
        JOIN vehicles v ON s.vehicle_id = v.id
        JOIN parking_spots p ON s.spot_id = p.id
        JOIN zones z ON p.zone_id = z.id
        WHERE s.entry_time <= {NOW}),
    e AS (
        SELECT 'check-in' AS action, license_plate, spot_number, zone_name, entry_time AS "timestamp", session_id
        FROM j
        UNION ALL
        SELECT 'check-out', license_plate, spot_number, zone_name, exit_time, session_id
        FROM j WHERE exit_time IS NOT NULL AND exit_time <= {NOW})
    SELECT * FROM e ORDER BY "timestamp" DESC, action ASC, session_id DESC LIMIT 20
""")
def q_recent_activity(spark, base):
    m = model(spark, base)
    return reports.recent_activity(m.sessions, m.vehicles, m.spots, m.zones, AS_OF)


# ---------------------------------------------------------------------------
# Projections, filters, lookups and joins
# ---------------------------------------------------------------------------

JS_RATE = "CASE WHEN {r} IS NULL OR {r} = 0 THEN 5 ELSE {r} END"
SPOT_SELECT = ("ps.id, ps.spot_number, ps.zone_id, ps.spot_type, ps.is_occupied, ps.is_reserved, "
               "CAST(ps.hourly_rate AS DOUBLE) AS hourly_rate, ps.created_at")


@register("spots_filtered", f"""
    SELECT {SPOT_SELECT}, z.name AS zone_name, z.description AS zone_description
    FROM parking_spots ps JOIN zones z ON ps.zone_id = z.id
    WHERE ps.spot_type = 'electric' AND ps.is_occupied = FALSE AND ps.is_reserved = FALSE
""")
def q_spots_filtered(spark, base):
    m = model(spark, base)
    return lookups.spots_filtered(m.spots, m.zones, spot_type="electric", available="true")


@register("spots_filtered_zone", f"""
    SELECT {SPOT_SELECT}, z.name AS zone_name, z.description AS zone_description
    FROM parking_spots ps JOIN zones z ON ps.zone_id = z.id
    WHERE z.name = 'Z05'
""")
def q_spots_filtered_zone(spark, base):
    """Zone filter only: ``available='1'`` is not the string 'true', so no flag filter."""
    m = model(spark, base)
    return lookups.spots_filtered(m.spots, m.zones, zone="Z05", spot_type="", available="1")


@register("user_profile", "SELECT id, username, email, full_name, role, phone, created_at FROM users")
def q_user_profile(spark, base):
    return lookups.user_profile(model(spark, base).users)


@register("user_directory", """
    SELECT id, full_name, username, email, coalesce(nullif(phone, ''), '—') AS phone, role FROM users
""")
def q_user_directory(spark, base):
    return lookups.user_directory(model(spark, base).users)


@register("session_history", f"""
    SELECT s.id, v.license_plate, p.spot_number, z.name AS zone_name,
           CAST(ceil(s.duration_minutes / 60.0) AS BIGINT) AS duration_hours, s.entry_time,
           coalesce(CAST(s.total_amount AS DOUBLE), 0.0) AS admin_amount,
           coalesce(CAST(s.total_amount AS DOUBLE),
                    CAST(({JS_RATE.format(r='p.hourly_rate')}) * ceil(s.duration_minutes / 60.0) AS DOUBLE))
               AS user_amount
    FROM parking_sessions s
    LEFT JOIN vehicles v ON s.vehicle_id = v.id
    LEFT JOIN parking_spots p ON s.spot_id = p.id
    LEFT JOIN zones z ON p.zone_id = z.id
    WHERE s.exit_time IS NOT NULL
    ORDER BY s.id DESC
""")
def q_session_history(spark, base):
    m = model(spark, base)
    return lookups.session_history(m.sessions, m.vehicles, m.spots, m.zones)


@register("user_sessions", """
    SELECT u.id AS user_id, u.username,
           CAST(coalesce(a.active_sessions, 0) AS BIGINT) AS active_sessions,
           CAST(coalesce(a.completed_sessions, 0) AS BIGINT) AS completed_sessions
    FROM users u LEFT JOIN (
        SELECT user_id, COUNT(*) FILTER (WHERE exit_time IS NULL) AS active_sessions,
               COUNT(*) FILTER (WHERE exit_time IS NOT NULL) AS completed_sessions
        FROM parking_sessions GROUP BY user_id) a ON u.id = a.user_id
""")
def q_user_sessions(spark, base):
    m = model(spark, base)
    return lookups.user_sessions(m.users, m.sessions)


@register("active_sessions", f"""
    SELECT s.id, s.vehicle_id, s.spot_id, s.user_id, s.entry_time, s.exit_time,
           CAST(s.total_amount AS DOUBLE) AS total_amount, s.payment_status, s.payment_method, s.created_at,
           v.license_plate, v.vehicle_type, p.spot_number, z.name AS zone_name,
           datesub('minute', s.entry_time, {NOW}) AS duration_minutes
    FROM parking_sessions s
    JOIN vehicles v ON s.vehicle_id = v.id
    JOIN parking_spots p ON s.spot_id = p.id
    JOIN zones z ON p.zone_id = z.id
    WHERE s.exit_time IS NULL AND s.entry_time <= {NOW}
    ORDER BY s.entry_time DESC, s.id DESC
""")
def q_active_sessions(spark, base):
    m = model(spark, base)
    return lookups.active_sessions(m.sessions, m.vehicles, m.spots, m.zones, AS_OF)


@register("spot_detail", f"""
    WITH cur AS (
        SELECT spot_id, license_plate FROM (
            SELECT s.spot_id, v.license_plate,
                   row_number() OVER (PARTITION BY s.spot_id ORDER BY s.entry_time, s.id) AS rn
            FROM parking_sessions s JOIN vehicles v ON s.vehicle_id = v.id
            WHERE s.exit_time IS NULL AND s.entry_time <= {NOW}) WHERE rn = 1)
    SELECT {SPOT_SELECT}, z.name AS zone_name, cur.license_plate AS current_vehicle
    FROM parking_spots ps JOIN zones z ON ps.zone_id = z.id LEFT JOIN cur ON cur.spot_id = ps.id
""")
def q_spot_detail(spark, base):
    m = model(spark, base)
    return lookups.spot_detail(m.spots, m.zones, m.sessions, m.vehicles, AS_OF)


CURRENT_BY_VEHICLE = f"""
    SELECT vehicle_id, spot_number, entry_time FROM (
        SELECT s.vehicle_id, p.spot_number, s.entry_time,
               row_number() OVER (PARTITION BY s.vehicle_id ORDER BY s.entry_time, s.id) AS rn
        FROM parking_sessions s JOIN parking_spots p ON s.spot_id = p.id
        WHERE s.exit_time IS NULL AND s.entry_time <= {NOW}) WHERE rn = 1"""


@register("vehicles_list", f"""
    WITH cur AS ({CURRENT_BY_VEHICLE})
    SELECT v.id, v.user_id, v.license_plate, v.vehicle_type, v.make, v.model, v.color, v.created_at, v.updated_at,
           u.username AS owner_username, u.email AS owner_email, cur.spot_number AS current_spot
    FROM vehicles v LEFT JOIN users u ON v.user_id = u.id LEFT JOIN cur ON v.id = cur.vehicle_id
    ORDER BY v.created_at DESC, v.id DESC
""")
def q_vehicles_list(spark, base):
    m = model(spark, base)
    return lookups.vehicles_list(m.vehicles, m.users, m.sessions, m.spots, AS_OF)


@register("my_vehicles", f"""
    WITH cur AS ({CURRENT_BY_VEHICLE})
    SELECT v.id, v.user_id, v.license_plate, v.vehicle_type, v.make, v.model, v.color, v.created_at, v.updated_at,
           cur.spot_number AS current_spot, cur.entry_time
    FROM vehicles v LEFT JOIN cur ON v.id = cur.vehicle_id
    WHERE v.user_id IS NOT NULL
    ORDER BY v.user_id, v.created_at DESC, v.id DESC
""")
def q_my_vehicles(spark, base):
    m = model(spark, base)
    return lookups.my_vehicles(m.vehicles, m.sessions, m.spots, AS_OF)


@register("user_reservations", """
    SELECT r.id, r.user_id, r.spot_id, r.vehicle_id, r.start_time, r.end_time, r.status,
           CAST(r.total_amount AS DOUBLE) AS total_amount, r.payment_status, r.created_at,
           p.spot_number, z.name AS zone_name, v.license_plate
    FROM reservations r
    JOIN parking_spots p ON r.spot_id = p.id
    JOIN zones z ON p.zone_id = z.id
    LEFT JOIN vehicles v ON r.vehicle_id = v.id
    WHERE r.status = 'active'
    ORDER BY r.user_id, r.start_time, r.id
""")
def q_user_reservations(spark, base):
    m = model(spark, base)
    return lookups.user_reservations(m.reservations, m.spots, m.zones, m.vehicles)


@register("active_session_for_vehicle", f"""
    SELECT vehicle_id, session_id, spot_id, entry_time, hourly_rate FROM (
        SELECT s.vehicle_id, s.id AS session_id, s.spot_id, s.entry_time,
               CAST(p.hourly_rate AS DOUBLE) AS hourly_rate,
               row_number() OVER (PARTITION BY s.vehicle_id ORDER BY s.entry_time DESC, s.id DESC) AS rn
        FROM parking_sessions s JOIN parking_spots p ON s.spot_id = p.id
        WHERE s.exit_time IS NULL AND s.entry_time <= {NOW}) WHERE rn = 1
""")
def q_active_session_for_vehicle(spark, base):
    m = model(spark, base)
    return lookups.active_session_for_vehicle(m.sessions, m.spots, AS_OF)


@register("booking_rows", f"""
    SELECT s.id, v.license_plate, s.spot_number, z.name AS zone_name, s.booked_hours AS duration_hours,
           s.entry_time, s.entry_time + to_hours(s.booked_hours) AS end_time,
           CAST({JS_RATE.format(r='p.hourly_rate')} AS DOUBLE) AS hourly_rate,
           CAST(({JS_RATE.format(r='p.hourly_rate')}) * s.booked_hours AS DOUBLE) AS booking_cost
    FROM parking_sessions s
    LEFT JOIN vehicles v ON s.vehicle_id = v.id
    LEFT JOIN (SELECT spot_number, arg_min(zone_id, id) AS zone_id, arg_min(hourly_rate, id) AS hourly_rate
               FROM parking_spots GROUP BY spot_number) p ON s.spot_number = p.spot_number
    LEFT JOIN zones z ON p.zone_id = z.id
    WHERE s.exit_time IS NULL AND s.entry_time <= {NOW}
""")
def q_booking_rows(spark, base):
    m = model(spark, base)
    return lookups.booking_rows(m.client_sessions, m.vehicles, m.spots, m.zones, AS_OF)


@register("identity_resolve", """
    WITH act AS (SELECT id AS user_id, username, email, role FROM users WHERE is_active = TRUE),
    m AS (SELECT DISTINCT h.handle_id, a.user_id, a.role
          FROM handles h JOIN act a ON lower(h.handle) = lower(a.username) OR lower(h.handle) = lower(a.email))
    SELECT h.handle_id, h.handle, m.user_id, m.role FROM handles h LEFT JOIN m ON h.handle_id = m.handle_id
""")
def q_identity_resolve(spark, base):
    m = model(spark, base)
    return lookups.identity_resolve(m.handles, m.users)


# ---------------------------------------------------------------------------
# Billing
# ---------------------------------------------------------------------------


@register("session_billing", f"""
    WITH j AS (
        SELECT s.id AS session_id, s.spot_id, s.entry_time, s.exit_time, p.hourly_rate AS rate,
               epoch_us(s.exit_time) - epoch_us(s.entry_time) AS us
        FROM parking_sessions s LEFT JOIN parking_spots p ON s.spot_id = p.id
        WHERE s.exit_time IS NOT NULL),
    k AS (SELECT *, floor(us / 60000000.0) AS fm, {JS_RATE.format(r='rate')} AS jrate FROM j)
    SELECT session_id, spot_id, entry_time, exit_time, CAST(rate AS DOUBLE) AS hourly_rate,
           CAST(fm AS BIGINT) AS server_minutes, CAST(ceil(fm / 60.0) AS BIGINT) AS server_hours,
           CAST(ceil(fm / 60.0) * rate AS DOUBLE) AS server_amount,
           CAST(greatest(1, fm) AS BIGINT) AS client_minutes,
           CAST(ceil(greatest(1, fm) / 60.0) AS BIGINT) AS client_hours,
           CAST(ceil(greatest(1, fm) / 60.0) * jrate AS DOUBLE) AS client_amount,
           CAST(fm AS BIGINT) AS display_minutes,
           CAST(greatest(1, ceil(us / 3600000000.0)) AS BIGINT) AS display_hours,
           CAST(greatest(1, ceil(us / 3600000000.0)) * jrate AS DOUBLE) AS display_amount,
           'pending' AS payment_status
    FROM k
""")
def q_session_billing(spark, base):
    m = model(spark, base)
    return billing.session_billing(m.sessions, m.spots)


@register("checkout_billing", f"""
    WITH ev AS (
        SELECT *, lag(action) OVER (PARTITION BY vehicle_id ORDER BY ts, event_id) AS before
        FROM vehicle_log WHERE action IN ('check_in', 'check_out') AND vehicle_id IS NOT NULL AND ts IS NOT NULL),
    opened AS (SELECT * FROM ev WHERE action = 'check_in' AND coalesce(before, '') <> 'check_in'),
    closed AS (SELECT vehicle_id, ts, event_id FROM ev WHERE action = 'check_out' AND before = 'check_in'),
    paired AS (
        SELECT o.event_id AS session_id, o.vehicle_id, o.spot_id, o.ts AS entry_time,
               (SELECT min((c.ts, c.event_id)) FROM closed c
                WHERE c.vehicle_id = o.vehicle_id AND (c.ts, c.event_id) > (o.ts, o.event_id)) AS out
        FROM opened o),
    k AS (
        SELECT p.*, p.out[1] AS exit_time, s.hourly_rate AS rate,
               floor((epoch_us(p.out[1]) - epoch_us(p.entry_time)) / 60000000.0) AS fm
        FROM paired p LEFT JOIN parking_spots s ON p.spot_id = s.id WHERE p.out IS NOT NULL)
    SELECT session_id, vehicle_id, spot_id, entry_time, exit_time, CAST(fm AS BIGINT) AS server_minutes,
           CAST(ceil(fm / 60.0) AS BIGINT) AS server_hours, CAST(ceil(fm / 60.0) * rate AS DOUBLE) AS server_amount,
           'pending' AS payment_status
    FROM k
""")
def q_checkout_billing(spark, base):
    """Check-out pipeline: the log's check-ins and check-outs are paired, and every
    session so closed is billed."""
    m = model(spark, base)
    paired = lifecycle.session_pairing(m.lot_events("vehicle"))
    sessions = paired.filter((F.col("action") == "check_in") & F.col("exit_time").isNotNull()).select(
        F.col("event_id").alias("id"), "vehicle_id", "spot_id", F.col("ts").alias("entry_time"), "exit_time")
    billed = billing.session_billing(sessions, m.spots, modes=("server",)).drop("hourly_rate")
    who = sessions.select(F.col("id").alias("session_id"), "vehicle_id")
    return billed.join(who, "session_id").select(
        "session_id", "vehicle_id", "spot_id", "entry_time", "exit_time", "server_minutes", "server_hours", "server_amount",
        "payment_status")


@register("active_cost_estimate", f"""
    SELECT s.id AS session_id, s.spot_id, s.entry_time, s.booked_hours,
           round(CAST(epoch_us({NOW}) - epoch_us(s.entry_time) AS DOUBLE) / 60000000.0 / 60.0 * 5.0, 4)
               AS flat_estimate,
           CAST(ceil((epoch_us({NOW}) - epoch_us(s.entry_time)) / 3600000000.0) * p.hourly_rate AS DOUBLE)
               AS started_hours_estimate,
           CAST(({JS_RATE.format(r='p.hourly_rate')}) * s.booked_hours AS DOUBLE) AS booked_estimate
    FROM parking_sessions s LEFT JOIN parking_spots p ON s.spot_id = p.id
    WHERE s.exit_time IS NULL AND s.entry_time <= {NOW}
""")
def q_active_cost_estimate(spark, base):
    m = model(spark, base)
    return billing.active_cost_estimate(m.sessions, m.spots, AS_OF).withColumn(
        "flat_estimate", F.round("flat_estimate", 4))


# ---------------------------------------------------------------------------
# Bulk state changes
# ---------------------------------------------------------------------------


@register("session_pairing", """
    WITH ev AS (SELECT * FROM vehicle_log WHERE action IN ('check_in', 'check_out')),
    w AS (
        SELECT *, lag(action) OVER (PARTITION BY vehicle_id ORDER BY ts, event_id) AS prev_action,
               first_value(CASE WHEN action = 'check_out' THEN ts END IGNORE NULLS) OVER (
                   PARTITION BY vehicle_id ORDER BY ts, event_id
                   ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_out_ts,
               first_value(CASE WHEN action = 'check_out' THEN event_id END IGNORE NULLS) OVER (
                   PARTITION BY vehicle_id ORDER BY ts, event_id
                   ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_out_id
        FROM ev),
    d AS (
        SELECT *, CASE WHEN action = 'check_in' THEN NOT coalesce(prev_action = 'check_in', FALSE)
                       ELSE coalesce(prev_action = 'check_in', FALSE) END AS accepted
        FROM w)
    SELECT event_id, vehicle_id, spot_id, action, ts, accepted,
           CASE WHEN accepted THEN NULL WHEN action = 'check_in' THEN 'already_parked'
                ELSE 'no_open_session' END AS reason,
           CASE WHEN accepted AND action = 'check_in' THEN next_out_ts END AS exit_time,
           CASE WHEN accepted AND action = 'check_in' THEN next_out_id END AS exit_event_id
    FROM d
""")
def q_session_pairing(spark, base):
    return lifecycle.session_pairing(model(spark, base).lot_events("vehicle"))


@register("reservation_admission", """
    WITH ev AS (
        SELECT l.*, p.id AS sid, coalesce(p.is_occupied, FALSE) AS occ, coalesce(p.is_reserved, FALSE) AS res
        FROM reservation_log l LEFT JOIN parking_spots p ON l.spot_id = p.id
        WHERE l.action IN ('reserve', 'cancel')),
    w AS (
        SELECT *, lag(action) OVER (PARTITION BY spot_id ORDER BY ts, event_id) AS prev_action,
               count(CASE WHEN action = 'cancel' THEN 1 END) OVER (
                   PARTITION BY spot_id ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_cancels
        FROM ev),
    d AS (
        SELECT *, CASE WHEN sid IS NULL THEN FALSE
                       WHEN occ THEN action = 'cancel' AND res AND coalesce(prev_cancels, 0) = 0
                       WHEN action = 'reserve' THEN NOT coalesce(prev_action = 'reserve', res)
                       ELSE coalesce(prev_action = 'reserve', res) END AS accepted
        FROM w)
    SELECT event_id, spot_id, vehicle_id, action, ts, accepted,
           CASE WHEN accepted THEN NULL WHEN sid IS NULL THEN 'spot_not_found'
                WHEN action = 'reserve' AND occ THEN 'spot_occupied'
                WHEN action = 'reserve' THEN 'spot_reserved' ELSE 'not_reserved' END AS reason,
           CASE WHEN accepted AND action = 'reserve' THEN ts + to_hours(hours) END AS end_time
    FROM d
""")
def q_reservation_admission(spark, base):
    m = model(spark, base)
    return lifecycle.reservation_admission(m.lot_events("reservation"), m.spots)


CYCLE_SQL = """
    act AS (
        SELECT event_id, spot_id, ts, action, hours,
               row_number() OVER (PARTITION BY spot_id ORDER BY ts, event_id) AS rn,
               lead(ts) OVER (PARTITION BY spot_id ORDER BY ts, event_id) AS next_ts
        FROM vehicle_log
        WHERE action IN ('check_in', 'extend', 'check_out') AND spot_id IN (SELECT id FROM parking_spots)
              AND ts IS NOT NULL AND (action = 'check_out' OR hours > 0)),
    walk(spot_id, rn, bid, end_t, kind) AS (
        SELECT spot_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR)
        FROM act WHERE rn = 1
        UNION ALL
        SELECT a.spot_id, a.rn,
               CASE WHEN a.action = 'check_out' THEN NULL
                    WHEN a.action = 'check_in' AND (w.bid IS NULL OR a.ts > w.end_t) THEN a.event_id
                    ELSE w.bid END,
               CASE WHEN a.action = 'check_out' THEN NULL
                    WHEN a.action = 'check_in' AND (w.bid IS NULL OR a.ts > w.end_t) THEN a.ts + to_hours(a.hours)
                    WHEN a.action = 'extend' THEN w.end_t + to_hours(a.hours)
                    ELSE w.end_t END,
               CASE WHEN a.action = 'check_out' THEN 'checked_out'
                    WHEN a.action = 'check_in' AND (w.bid IS NULL OR a.ts > w.end_t) THEN 'booked'
                    WHEN a.action = 'check_in' THEN 'rejected'
                    WHEN w.bid IS NULL THEN 'no_booking' ELSE 'extended' END
        FROM walk w JOIN act a ON a.spot_id = w.spot_id AND a.rn = w.rn + 1),
    life AS (
        SELECT a.event_id, a.spot_id, a.ts, a.action, a.hours, a.rn, a.next_ts, w.bid, w.end_t, w.kind
        FROM walk w JOIN act a ON a.spot_id = w.spot_id AND a.rn = w.rn)"""

BOOKINGS_SQL = CYCLE_SQL + f""",
    past AS (SELECT * FROM life WHERE ts <= {NOW}),
    added AS (SELECT bid, sum(hours) AS ext, count(*) AS n FROM past WHERE kind = 'extended' GROUP BY bid),
    ends AS (SELECT bid, arg_max(end_t, rn) AS end_time FROM past WHERE kind IN ('booked', 'extended') GROUP BY bid),
    booking_final AS (
        SELECT l.event_id AS booking_id, l.spot_id, v.vehicle_id, l.ts AS start_time, e.end_time,
               CAST(l.hours + coalesce(a.ext, 0) AS INTEGER) AS duration_hours,
               CAST(coalesce(a.ext, 0) AS INTEGER) AS total_extended_hours, coalesce(a.n, 0) AS extension_count
        FROM past l JOIN ends e ON l.event_id = e.bid JOIN vehicle_log v ON l.event_id = v.event_id
             LEFT JOIN added a ON l.event_id = a.bid
        WHERE l.kind = 'booked'),
    latest AS (SELECT spot_id, max(rn) AS rn FROM past GROUP BY spot_id),
    cur AS (
        SELECT b.booking_id, b.spot_id, b.vehicle_id, b.start_time, b.end_time, b.duration_hours,
               b.total_extended_hours, b.extension_count
        FROM latest t JOIN past l ON t.spot_id = l.spot_id AND t.rn = l.rn JOIN booking_final b ON l.bid = b.booking_id),
    freed AS (
        SELECT DISTINCT spot_id FROM past
        WHERE kind = 'checked_out' OR end_t < least(coalesce(next_ts, {NOW}), {NOW})),
    swept AS (
        SELECT p.id, p.spot_number, p.zone_id, p.spot_type,
               CASE WHEN c.booking_id IS NOT NULL THEN c.end_time >= {NOW}
                    WHEN f.spot_id IS NOT NULL THEN FALSE ELSE p.is_occupied END AS is_occupied,
               p.is_reserved AND f.spot_id IS NULL AS is_reserved,
               c.booking_id, c.end_time AS booking_end_time,
               CASE WHEN c.booking_id IS NOT NULL THEN {NOW} > c.end_time END AS expired
        FROM parking_spots p LEFT JOIN cur c ON p.id = c.spot_id LEFT JOIN freed f ON p.id = f.spot_id)"""


def _cycle(spark, base):
    m = model(spark, base)
    return m, cycle.booking_cycle(m.lot_events("vehicle"), m.spots)


def _current(spark, base):
    m, life = _cycle(spark, base)
    return m, bk.spot_bookings(life, AS_OF)


@register("spot_booking_admission", f"""
    WITH RECURSIVE {CYCLE_SQL}
    SELECT l.event_id, l.spot_id, l.vehicle_id, l.ts, l.hours, l.ts + to_hours(l.hours) AS end_time,
           coalesce(c.kind = 'booked', FALSE) AS accepted,
           CASE WHEN c.kind = 'booked' THEN NULL WHEN c.kind = 'rejected' THEN 'spot_occupied'
                WHEN l.ts IS NULL OR l.spot_id IS NULL OR coalesce(l.hours, 0) <= 0 THEN 'invalid_event'
                ELSE 'spot_not_found' END AS reason
    FROM vehicle_log l LEFT JOIN life c ON l.event_id = c.event_id WHERE l.action = 'check_in'
""")
def q_spot_booking_admission(spark, base):
    return lifecycle.spot_booking_admission(_cycle(spark, base)[1])


# ---------------------------------------------------------------------------
# Bookings: extensions, expiry, countdowns
# ---------------------------------------------------------------------------


@register("apply_extensions", f"""
    WITH RECURSIVE {BOOKINGS_SQL}
    SELECT l.event_id, l.spot_id, l.ts AS extended_at, l.hours AS added_hours, l.bid AS booking_id, l.end_t AS new_end_time,
           f.end_time AS booking_end_time, f.duration_hours AS booking_duration_hours,
           f.total_extended_hours, l.kind = 'extended' AS applied
    FROM past l LEFT JOIN booking_final f ON l.bid = f.booking_id WHERE l.action = 'extend'
""")
def q_apply_extensions(spark, base):
    return bk.apply_extensions(_cycle(spark, base)[1], AS_OF)


@register("expire_bookings", f"""
    WITH RECURSIVE {BOOKINGS_SQL}
    SELECT * FROM swept
""")
def q_expire_bookings(spark, base):
    m, cur = _current(spark, base)
    return bk.expire_bookings(m.spots, cur, AS_OF)


@register("spot_status_board", f"""
    WITH RECURSIVE {BOOKINGS_SQL}
    SELECT id, spot_number, zone_id, is_occupied, is_reserved, booking_id,
           CASE WHEN coalesce(is_occupied, FALSE) AND booking_id IS NOT NULL AND rem <= 0 THEN 'overdue'
                WHEN coalesce(is_occupied, FALSE) AND booking_id IS NOT NULL AND rem < 300000 THEN 'critical'
                WHEN coalesce(is_occupied, FALSE) AND booking_id IS NOT NULL AND rem < 900000 THEN 'warning'
                WHEN coalesce(is_occupied, FALSE) THEN 'occupied'
                WHEN coalesce(is_reserved, FALSE) THEN 'reserved'
                WHEN spot_type = 'electric' THEN 'electric'
                WHEN spot_type = 'motorcycle' THEN 'motorcycle'
                WHEN spot_type = 'handicapped' THEN 'handicapped'
                ELSE 'regular' END AS status
    FROM (SELECT *, (epoch_us(booking_end_time) // 1000) - (epoch_us({NOW}) // 1000) AS rem FROM swept)
""")
def q_spot_status_board(spark, base):
    m, cur = _current(spark, base)
    return bk.spot_status_board(bk.expire_bookings(m.spots, cur, AS_OF), AS_OF)


def _pad2_sql(x: str) -> str:
    return f"CASE WHEN length(CAST({x} AS VARCHAR)) < 2 THEN lpad(CAST({x} AS VARCHAR), 2, '0') " \
           f"ELSE CAST({x} AS VARCHAR) END"


@register("booking_urgency", f"""
    WITH RECURSIVE {BOOKINGS_SQL},
    u AS (SELECT *, greatest(0, (epoch_us(end_time) // 1000) - (epoch_us({NOW}) // 1000)) AS rem FROM cur),
    v AS (SELECT *, rem // 1000 AS secs FROM u)
    SELECT spot_id, booking_id, end_time, rem AS remaining_ms, rem = 0 AS expired,
           rem > 0 AND rem < 300000 AS critical, rem > 0 AND rem < 900000 AS warning,
           {_pad2_sql('secs // 3600')} || ':' || {_pad2_sql('(secs % 3600) // 60')} || ':'
               || {_pad2_sql('secs % 60')} AS countdown
    FROM v
""")
def q_booking_urgency(spark, base):
    _, cur = _current(spark, base)
    return bk.booking_urgency(bk.current_bookings(cur), AS_OF)


@register("urgency_counts", f"""
    WITH RECURSIVE {BOOKINGS_SQL}
    SELECT count(*) FILTER (WHERE booking_id IS NOT NULL AND NOT coalesce(expired, FALSE)
                              AND (epoch_us(booking_end_time) // 1000) - (epoch_us({NOW}) // 1000) < 300000) AS critical_count,
           count(*) FILTER (WHERE booking_id IS NOT NULL AND NOT coalesce(expired, FALSE)
                              AND (epoch_us(booking_end_time) // 1000) - (epoch_us({NOW}) // 1000) < 900000) AS warning_count
    FROM swept
""")
def q_urgency_counts(spark, base):
    m, cur = _current(spark, base)
    return bk.urgency_counts(bk.expire_bookings(m.spots, cur, AS_OF), AS_OF)


@register("booking_progress", f"""
    WITH RECURSIVE {BOOKINGS_SQL}
    SELECT spot_id, booking_id, duration_hours,
           round(least(100.0, greatest(0.0, (total - ((epoch_us(end_time) // 1000) - (epoch_us({NOW}) // 1000))) / total * 100.0)), 2)
               AS used_pct
    FROM (SELECT *, CAST(duration_hours AS DOUBLE) * 3600000.0 AS total FROM cur)
""")
def q_booking_progress(spark, base):
    _, cur = _current(spark, base)
    return bk.booking_progress(bk.current_bookings(cur), AS_OF)


# ---------------------------------------------------------------------------
# Imports, change log, deletes
# ---------------------------------------------------------------------------

@register("user_import_validate", f"""
    WITH RECURSIVE r AS (SELECT *, lower(trim(username)) AS u, lower(trim(email)) AS e FROM user_import),
    chk AS (
        SELECT r.*, CASE
            WHEN username IS NULL OR length(username) < 3 OR length(username) > 50 THEN 'username_length'
            WHEN email IS NULL OR length(email) > 100 OR len(string_split(email, '@')) <> 2
                 OR NOT regexp_matches(split_part(email, '@', 1), '^[A-Za-z0-9!#$%&''*+/=?^_`{{|}}~-]+(\\.[A-Za-z0-9!#$%&''*+/=?^_`{{|}}~-]+)*$')
                 OR length(split_part(email, '@', 1)) > 64
                 OR NOT regexp_matches(split_part(email, '@', 2), '^([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\\.)+[A-Za-z]{{2,}}$')
                 THEN 'email_invalid'
            WHEN coalesce(password_length, 0) < 6 THEN 'password_short'
            WHEN coalesce(full_name, '') = '' THEN 'full_name_empty'
            WHEN length(full_name) > 100 THEN 'full_name_long'
            WHEN u IN (SELECT lower(username) FROM users) OR e IN (SELECT lower(email) FROM users)
                THEN 'already_exists' END AS pre
        FROM r),
    cand AS (SELECT request_id, u, e, row_number() OVER (ORDER BY request_id) AS rn FROM chk WHERE pre IS NULL),
    walk(rn, request_id, ok, tu, te) AS (
        SELECT rn, request_id, TRUE, [u], [e] FROM cand WHERE rn = 1
        UNION ALL
        SELECT c.rn, c.request_id, NOT (list_contains(w.tu, c.u) OR list_contains(w.te, c.e)),
               CASE WHEN list_contains(w.tu, c.u) OR list_contains(w.te, c.e) THEN w.tu
                    ELSE list_append(w.tu, c.u) END,
               CASE WHEN list_contains(w.tu, c.u) OR list_contains(w.te, c.e) THEN w.te
                    ELSE list_append(w.te, c.e) END
        FROM walk w JOIN cand c ON c.rn = w.rn + 1)
    SELECT chk.request_id, chk.username, chk.email, coalesce(w.ok, FALSE) AS accepted,
           CASE WHEN coalesce(w.ok, FALSE) THEN NULL ELSE coalesce(chk.pre, 'duplicate_in_batch') END AS reason,
           CASE WHEN coalesce(w.ok, FALSE) THEN 'customer' END AS role
    FROM chk LEFT JOIN walk w ON chk.request_id = w.request_id
""")
def q_user_import_validate(spark, base):
    m = model(spark, base)
    return imports.user_import_validate(m.user_import, m.users)


@register("vehicle_import_validate", """
    WITH r AS (SELECT *, upper(trim(license_plate)) AS plate FROM vehicle_import),
    chk AS (
        SELECT r.*, CASE
            WHEN plate IS NULL OR plate = '' THEN 'plate_required'
            WHEN length(plate) > 20 THEN 'plate_too_long'
            WHEN NOT coalesce(vehicle_type IN ('car', 'motorcycle', 'electric', 'truck'), FALSE) THEN 'invalid_type'
            WHEN plate IN (SELECT upper(trim(license_plate)) FROM vehicles) THEN 'already_registered' END AS pre
        FROM r),
    f AS (SELECT plate, min(request_id) AS first FROM chk WHERE pre IS NULL GROUP BY plate)
    SELECT chk.request_id, chk.user_id, chk.plate, chk.vehicle_type, nullif(chk.make, '') AS make, nullif(chk.model, '') AS model,
           nullif(chk.color, '') AS color,
           (chk.pre IS NULL AND chk.request_id = f.first) AS accepted,
           CASE WHEN chk.pre IS NULL AND chk.request_id = f.first THEN NULL
                ELSE coalesce(chk.pre, 'duplicate_in_batch') END AS reason
    FROM chk LEFT JOIN f ON chk.plate = f.plate
""")
def q_vehicle_import_validate(spark, base):
    m = model(spark, base)
    return imports.vehicle_import_validate(m.vehicle_import, m.vehicles)


@register("walk_in_vehicles", """
    WITH c AS (SELECT *, upper(trim(license_plate)) AS plate FROM checkin_plates),
    u AS (SELECT * FROM c WHERE NOT EXISTS (
              SELECT 1 FROM vehicles v WHERE upper(trim(v.license_plate)) = c.plate)),
    g AS (SELECT plate, count(*) AS check_ins FROM u GROUP BY plate),
    f AS (SELECT plate, ts, event_id FROM (
              SELECT plate, ts, event_id, row_number() OVER (PARTITION BY plate ORDER BY ts, event_id) AS rn
              FROM u) WHERE rn = 1)
    SELECT f.plate AS license_plate, 'car' AS vehicle_type, CAST(NULL AS BIGINT) AS user_id,
           f.ts AS first_seen, f.event_id AS first_event_id, g.check_ins
    FROM f JOIN g ON f.plate = g.plate
""")
def q_walk_in_vehicles(spark, base):
    m = model(spark, base)
    return imports.walk_in_vehicles(m.checkin_plates, m.vehicles)


@register("change_log_snapshot", """
    WITH ev AS (
        SELECT id AS user_id, 'base' AS op, TIMESTAMP '1900-01-01 00:00:00' AS changed_at,
               CAST(-1 AS BIGINT) AS change_id, username, email, full_name, phone, role, is_active
        FROM users
        UNION ALL
        SELECT user_id, op, changed_at, change_id, username, email, full_name, phone, role, TRUE
        FROM user_changes),
    rs AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY changed_at DESC, change_id DESC) AS rn
            FROM ev WHERE op IN ('base', 'insert', 'delete')) WHERE rn = 1 AND op <> 'delete'),
    up AS (
        SELECT e.* FROM ev e JOIN rs r ON e.user_id = r.user_id
        WHERE e.op IN ('profile', 'role')
          AND (e.changed_at > r.changed_at OR (e.changed_at = r.changed_at AND e.change_id > r.change_id))),
    pf AS (
        SELECT * FROM (
            SELECT user_id, full_name, phone,
                   row_number() OVER (PARTITION BY user_id ORDER BY changed_at DESC, change_id DESC) AS rn
            FROM up WHERE op = 'profile') WHERE rn = 1),
    rl AS (
        SELECT * FROM (
            SELECT user_id, role,
                   row_number() OVER (PARTITION BY user_id ORDER BY changed_at DESC, change_id DESC) AS rn
            FROM up WHERE op = 'role') WHERE rn = 1)
    SELECT r.user_id AS id, r.username, r.email,
           CASE WHEN pf.user_id IS NOT NULL THEN pf.full_name ELSE r.full_name END AS full_name,
           coalesce(rl.role, r.role) AS role,
           CASE WHEN pf.user_id IS NOT NULL THEN pf.phone ELSE r.phone END AS phone,
           r.is_active
    FROM rs r LEFT JOIN pf ON r.user_id = pf.user_id LEFT JOIN rl ON r.user_id = rl.user_id
""")
def q_change_log_snapshot(spark, base):
    m = model(spark, base)
    return changes.change_log_snapshot(m.users, m.user_changes)


def _last_set(log: str, key: str, column: str, value: str, where: str) -> str:
    """Last written value of one column per key."""
    return (f"SELECT {key} AS id, {value} AS {column} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY changed_at DESC, "
            f"change_id DESC) AS rn FROM {log} WHERE {where}) WHERE rn = 1")


@register("change_log_spots", f"""
    WITH log AS (SELECT spot_id, action, ts AS changed_at, event_id AS change_id FROM spot_flag_changes),
    occ AS ({_last_set("log", "spot_id", "flag", "action = 'check_in'", "action IN ('check_in', 'check_out')")}),
    res AS ({_last_set("log", "spot_id", "flag", "action = 'reserve'", "action IN ('reserve', 'cancel')")})
    SELECT p.id, p.spot_number, p.zone_id, p.spot_type, coalesce(occ.flag, p.is_occupied) AS is_occupied,
           coalesce(res.flag, p.is_reserved) AS is_reserved
    FROM parking_spots p LEFT JOIN occ ON p.id = occ.id LEFT JOIN res ON p.id = res.id
""")
def q_change_log_spots(spark, base):
    """#43 for spots: the last writer of each flag."""
    m = model(spark, base)
    return changes.spot_flags_snapshot(m.spots, m.spot_flag_changes)


@register("change_log_reservations", f"""
    WITH st AS ({_last_set("reservation_changes", "reservation_id", "status", "status", "status IS NOT NULL")}),
    pay AS ({_last_set("reservation_changes", "reservation_id", "payment_status", "payment_status", "payment_status IS NOT NULL")})
    SELECT r.id, r.user_id, r.spot_id, r.vehicle_id, r.start_time, r.end_time, coalesce(st.status, r.status) AS status,
           coalesce(pay.payment_status, r.payment_status) AS payment_status
    FROM reservations r LEFT JOIN st ON r.id = st.id LEFT JOIN pay ON r.id = pay.id
""")
def q_change_log_reservations(spark, base):
    """#43 for reservations: status and payment status have their own last writers."""
    m = model(spark, base)
    return changes.reservation_status_snapshot(m.reservations, m.reservation_changes)


@register("delete_propagation", """
    WITH dz AS (SELECT id FROM zones WHERE id % 11 = 3),
    du AS (SELECT id FROM users WHERE id % 7 = 3),
    dv AS (SELECT id FROM vehicles WHERE id % 13 = 5),
    ds AS (SELECT id FROM parking_spots WHERE id % 17 = 4 OR zone_id IN (SELECT id FROM dz))
    SELECT 'zones' AS table_name, CAST(id AS BIGINT) AS id, '' AS nulled FROM zones WHERE id NOT IN (SELECT id FROM dz)
    UNION ALL SELECT 'parking_spots', id, '' FROM parking_spots WHERE id NOT IN (SELECT id FROM ds)
    UNION ALL SELECT 'users', id, '' FROM users WHERE id NOT IN (SELECT id FROM du)
    UNION ALL SELECT 'vehicles', id, CASE WHEN user_id IN (SELECT id FROM du) THEN 'user_id' ELSE '' END
              FROM vehicles WHERE id NOT IN (SELECT id FROM dv)
    UNION ALL SELECT 'parking_sessions', id, CASE WHEN user_id IN (SELECT id FROM du) THEN 'user_id' ELSE '' END
              FROM parking_sessions WHERE spot_id NOT IN (SELECT id FROM ds) AND vehicle_id NOT IN (SELECT id FROM dv)
    UNION ALL SELECT 'reservations', id, CASE WHEN vehicle_id IN (SELECT id FROM dv) THEN 'vehicle_id' ELSE '' END
              FROM reservations WHERE spot_id NOT IN (SELECT id FROM ds) AND user_id NOT IN (SELECT id FROM du)
    UNION ALL SELECT 'ai_predictions', id, '' FROM ai_predictions WHERE zone_id NOT IN (SELECT id FROM dz)
    UNION ALL SELECT 'audit_logs', id, CASE WHEN user_id IN (SELECT id FROM du) THEN 'user_id' ELSE '' END FROM audit_logs
""")
def q_delete_propagation(spark, base):
    """Every row that is left in every table, with the keys that became NULL."""
    m = model(spark, base)
    tables = {"zones": m.zones, "parking_spots": m.spots, "users": m.users, "vehicles": m.vehicles, "parking_sessions": m.sessions,
              "reservations": m.reservations, "ai_predictions": m.ai_predictions, "audit_logs": m.audit_logs}
    return changes.surviving_rows(changes.delete_propagation(tables, m.delete_lists()))


# ---------------------------------------------------------------------------
# Sources, seeds and sinks
# ---------------------------------------------------------------------------

EV_ZONE = "L3"  # the seeded zone that plays the EV-charging zone


@register("scan_sessions", """
    SELECT id, vehicle_id, spot_id, entry_time, exit_time, payment_status
    FROM parking_sessions
    WHERE entry_time >= TIMESTAMP '2024-01-10 00:00:00' AND entry_time < TIMESTAMP '2024-01-12 00:00:00'
""")
def q_scan_sessions(spark, base):
    """Pruned, filtered scan: the entry-time range reaches the Parquet reader."""
    m = model(spark, base)
    lo, hi = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")
    return (m.sessions.filter((F.col("entry_time") >= lo) & (F.col("entry_time") < hi))
            .select("id", "vehicle_id", "spot_id", "entry_time", "exit_time", "payment_status"))


@register("seed_spot_grid", f"""
    SELECT z.name || '-' || lpad(CAST(n.n AS VARCHAR), 2, '0') AS spot_number, z.id AS zone_id, n.n,
           CASE WHEN z.name = '{EV_ZONE}' THEN 'electric' WHEN n.n <= 2 THEN 'electric' ELSE 'regular' END
               AS spot_type,
           CAST(CASE WHEN z.name = '{EV_ZONE}' THEN 7.00 ELSE 5.00 END AS DOUBLE) AS hourly_rate
    FROM seed_zones z CROSS JOIN (SELECT CAST(range AS INTEGER) AS n FROM range(1, 13)) n
""")
def q_seed_spot_grid(spark, base):
    return seeds.seed_spot_grid(model(spark, base).seed_zones, ev_zone=EV_ZONE)


@register("seed_spot_grid_client", f"""
    SELECT z.name || '-' || lpad(CAST(n.n AS VARCHAR), 2, '0') AS spot_number, z.id AS zone_id,
           z.name AS zone_name, n.n,
           CASE WHEN z.name = '{EV_ZONE}' THEN 'electric' WHEN n.n = 11 THEN 'motorcycle'
                WHEN n.n = 12 THEN 'electric' ELSE 'regular' END AS spot_type,
           CASE WHEN z.name = '{EV_ZONE}' THEN 7 ELSE 5 END AS hourly_rate,
           FALSE AS is_occupied, FALSE AS is_reserved,
           row_number() OVER (ORDER BY z.id, n.n) AS id
    FROM seed_zones z CROSS JOIN (SELECT CAST(range AS INTEGER) AS n FROM range(1, 13)) n
""")
def q_seed_spot_grid_client(spark, base):
    return seeds.seed_spot_grid_client(model(spark, base).seed_zones, ev_zone=EV_ZONE)


BOOKING_DOCS_SQL = """
    WITH ev AS (
        SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
        FROM events),
    d AS (
        SELECT *, (event_id * 7919) % 200 AS spot, 'S-' || lpad(CAST((event_id * 7919) % 200 AS VARCHAR), 6, '0') AS number,
               CAST(1 + k % 24 AS INTEGER) AS hours, CAST(k % 3 AS INTEGER) AS n_ext, ts + to_hours(1 + k % 24) AS end_ts,
               event_id % 50 <> 49 AS whole, event_id % 50 <> 49 AND k % 4 <> 0 AS has_b
        FROM ev),
    b AS (
        SELECT event_id AS doc_id, CASE WHEN whole THEN spot END AS spot_id, CASE WHEN whole THEN number END AS spot_number,
               CASE WHEN whole THEN event_type <> 'error' END AS is_occupied, CASE WHEN whole THEN event_id % 7 = 0 END AS is_reserved,
               CASE WHEN whole THEN has_b END AS has_booking,
               CASE WHEN has_b THEN event_id END AS session_id,
               CASE WHEN has_b THEN 'Z' || lpad(CAST(spot % 24 AS VARCHAR), 2, '0') END AS zone_name,
               CASE WHEN has_b THEN 'P-' || lpad(CAST(user_id AS VARCHAR), 8, '0') END AS license_plate,
               CASE WHEN has_b THEN CASE WHEN user_id % 2 = 0 THEN 'car' ELSE 'electric' END END AS vehicle_type,
               CASE WHEN has_b THEN date_trunc('millisecond', ts) END AS start_time,
               CASE WHEN has_b THEN date_trunc('millisecond', end_ts) END AS end_time,
               CASE WHEN has_b THEN hours END AS duration_hours,
               CASE WHEN has_b THEN CASE WHEN k % 5 = 0 THEN 7.0::DOUBLE ELSE 5.0::DOUBLE END END AS hourly_rate,
               CASE WHEN has_b THEN k % 2 = 0 END AS expired,
               CASE WHEN has_b THEN CAST(n_ext * (n_ext + 1) // 2 AS INTEGER) END AS total_extended_hours,
               CASE WHEN has_b THEN user_id % 10 END AS booked_by_user_id,
               CASE WHEN has_b THEN n_ext ELSE 0 END AS n_b, ts, end_ts,
               CASE WHEN NOT whole THEN left('{"id":' || spot || ',"spot_number":"' || number || '","is_occupied":', 30) END AS corrupt
        FROM d)
    SELECT b.doc_id, b.spot_id, b.spot_number, b.is_occupied, b.is_reserved, b.has_booking, b.session_id, b.zone_name, b.license_plate,
           b.vehicle_type, b.start_time, b.end_time, b.duration_hours, b.hourly_rate, b.expired, b.total_extended_hours, b.booked_by_user_id,
           CAST(e.i - 1 AS INTEGER) AS ext_pos, CAST(e.i AS INTEGER) AS added_hours,
           date_trunc('millisecond', b.ts + to_minutes(e.i * 10)) AS extended_at,
           date_trunc('millisecond', b.end_ts + to_hours(e.i * (e.i + 1) // 2)) AS new_end_time, b.corrupt
    FROM b LEFT JOIN (SELECT 1 AS i UNION ALL SELECT 2) e ON e.i <= b.n_b
"""


@register("booking_json_flatten", BOOKING_DOCS_SQL)
def q_booking_json_flatten(spark, base):
    return documents.booking_json_flatten(model(spark, base).spot_documents)


@register("booking_json_round_trip", BOOKING_DOCS_SQL)
def q_booking_json_round_trip(spark, base):
    """#4 both ways: documents parsed, written anew and parsed again."""
    flat = documents.booking_json_flatten(model(spark, base).spot_documents)
    return documents.booking_json_flatten(documents.booking_documents(flat))


@register("result_sink", """
    SELECT id, vehicle_id, spot_id, entry_time, exit_time, CAST(total_amount AS DOUBLE) AS total_amount,
           strftime(CAST(entry_time AS DATE), '%Y-%m-%d') AS entry_date
    FROM parking_sessions
""")
def q_result_sink(spark, base):
    """Write session facts partitioned by entry date and read all of them back."""
    m = model(spark, base)
    path = scratch_dir(spark, "sessions_by_entry_date")
    facts = m.sessions.select("id", "vehicle_id", "spot_id", "entry_time", "exit_time", "total_amount",
                              F.to_date("entry_time").alias("entry_date"))
    io.write_result(facts, path, partition_by=["entry_date"], spread=["id"])
    back = io.scan_table(spark, path)
    return back.select("id", "vehicle_id", "spot_id", "entry_time", "exit_time", "total_amount",
                       F.date_format("entry_date", "yyyy-MM-dd").alias("entry_date"))


# ---------------------------------------------------------------------------
# Streaming (bounded runs with availableNow; results read back as batch)
# ---------------------------------------------------------------------------


def _stream_model(spark, base):
    return model(spark, base, streams=("events",))


@register("stream_hourly_entries", """
    SELECT date_trunc('hour', entry_time) AS hour_start, COUNT(*) AS entry_count, COUNT(exit_time) AS closed,
           CAST(coalesce(SUM(datesub('minute', entry_time, exit_time)), 0) AS BIGINT) AS stay_minutes
    FROM parking_sessions GROUP BY 1
""")
def q_stream_hourly_entries(spark, base):
    m = _stream_model(spark, base)
    out = run_available_now(sj.hourly_entries(m.sessions), "hourly_entries", "complete")
    return sj.hourly_entries_out(out)


@register("stream_daily_revenue", """
    SELECT strftime(CAST(exit_time AS DATE), '%Y-%m-%d') AS date, CAST(SUM(total_amount) AS DOUBLE) AS revenue,
           COUNT(*) AS transactions
    FROM parking_sessions WHERE exit_time IS NOT NULL AND payment_status = 'paid' GROUP BY 1
""")
def q_stream_daily_revenue(spark, base):
    m = _stream_model(spark, base)
    out = run_available_now(sj.daily_revenue(m.sessions), "daily_revenue", "complete")
    return sj.daily_revenue_out(out)


@register("stream_spot_state", f"""
    WITH RECURSIVE {BOOKINGS_SQL},
    seen AS (SELECT spot_id, count(*) AS events, arg_max(action, rn) AS last_action, max(ts) AS last_ts, arg_max(event_id, rn) AS last_event_id
             FROM past GROUP BY spot_id)
    SELECT n.spot_id, n.last_action, n.last_ts, n.last_event_id, s.booking_id, s.booking_end_time, s.expired, s.is_occupied, s.is_reserved,
           n.events
    FROM seen n JOIN swept s ON n.spot_id = s.id
""")
def q_stream_spot_state(spark, base):
    """The live state of every spot with an action at ``AS_OF``: equal to the batch sweep."""
    m = _stream_model(spark, base)
    out = run_to_end(spark, lambda ticks: sj.spot_state(m.lot_events("vehicle"), m.spots, ticks), "spot_state",
                     datetime.fromisoformat(AS_OF), "update", ["spot_id"])
    return sj.spot_state_out(out, m.spots)


@register("stream_session_pairing", """
    WITH ev AS (SELECT * FROM vehicle_log WHERE action IN ('check_in', 'check_out')),
    w AS (SELECT *, lag(action) OVER (PARTITION BY vehicle_id ORDER BY ts, event_id) AS prev_action FROM ev),
    d AS (SELECT *, CASE WHEN action = 'check_in' THEN NOT coalesce(prev_action = 'check_in', FALSE)
                         ELSE coalesce(prev_action = 'check_in', FALSE) END AS accepted FROM w),
    o AS (SELECT *, last_value(CASE WHEN accepted AND action = 'check_in' THEN event_id END IGNORE NULLS) OVER (
                        PARTITION BY vehicle_id ORDER BY ts, event_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opener
          FROM d)
    SELECT event_id, vehicle_id, spot_id, action, ts, accepted,
           CASE WHEN accepted THEN NULL WHEN action = 'check_in' THEN 'already_parked'
                ELSE 'no_open_session' END AS reason,
           CASE WHEN accepted AND action = 'check_out' THEN opener END AS entry_event_id
    FROM o
""")
def q_stream_session_pairing(spark, base):
    m = _stream_model(spark, base)
    return run_to_end(spark, lambda ticks: sj.session_pairing_stream(m.lot_events("vehicle"), ticks), "session_pairing",
                      log_end(model(spark, base).lot_events("vehicle")))


@register("stream_booking_decisions", f"""
    WITH RECURSIVE {CYCLE_SQL}
    SELECT spot_id, event_id, kind, ts, end_t AS end_time FROM life
""")
def q_stream_booking_decisions(spark, base):
    """The decisions of the live booking stream (#51), one per action."""
    return _booking_stream(spark, base).filter(F.col("kind") != "expired")


@register("stream_booking_expiry", f"""
    WITH RECURSIVE {CYCLE_SQL},
    mark AS (SELECT date_trunc('second', max(ts)) + INTERVAL 1 SECOND AS ended FROM vehicle_log)
    SELECT spot_id, event_id, kind, ts, end_t AS end_time FROM life
    UNION ALL
    SELECT spot_id, bid, 'expired', end_t, end_t FROM life
    WHERE kind IN ('booked', 'rejected', 'extended') AND coalesce(next_ts, (SELECT ended FROM mark)) > end_t
""")
def q_stream_booking_expiry(spark, base):
    """All rows of the live booking stream: decisions, and an expiry for each time a
    booking's end passed before the spot's next action (for its last one: before the
    log's end)."""
    return _booking_stream(spark, base)


def _booking_stream(spark, base):
    m = _stream_model(spark, base)
    return run_to_end(spark, lambda ticks: sj.booking_expiry_stream(m.lot_events("vehicle"), m.spots, ticks), "bookings",
                      log_end(model(spark, base).lot_events("vehicle")))
