"""DuckDB spellings of the parking views (FIXTURES.md §1) for the SQL oracles.

Each oracle query in :mod:`parkops.plans.catalog` is written against these
view names; :func:`with_views` prepends the CTEs a query needs, in dependency
order, so the SQL runs on the driver's pre-registered raw tables alone.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "zones": """
        SELECT CAST(n_nationkey AS INTEGER) AS id,
               'Z' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS name,
               n_name AS description,
               CAST(100 AS INTEGER) AS total_spots,
               (n_nationkey % 8 <> 7) AS is_active,
               TIMESTAMP '2022-05-01 00:00:00' + to_hours(CAST(n_nationkey AS BIGINT)) AS created_at
        FROM nation""",
    "seed_zones": """
        SELECT CAST(s_suppkey AS INTEGER) AS id, 'L' || CAST(s_suppkey AS VARCHAR) AS name,
               s_name AS description, CAST(12 AS INTEGER) AS total_spots, TRUE AS is_active
        FROM supplier""",
    "parking_spots": """
        SELECT CAST(p_partkey AS BIGINT) AS id,
               'S-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS spot_number,
               CAST(p_size % 24 AS INTEGER) AS zone_id,
               CASE WHEN p_type = 'PROMO' THEN 'electric' WHEN p_type = 'SMALL' THEN 'motorcycle'
                    WHEN p_type = 'LARGE' THEN 'handicapped' ELSE 'regular' END AS spot_type,
               (p_partkey % 3 = 0) AS is_occupied,
               (p_partkey % 7 = 0) AS is_reserved,
               CAST(CASE WHEN p_type = 'PROMO' THEN 7.00 ELSE 5.00 END AS DECIMAL(10,2)) AS hourly_rate,
               TIMESTAMP '2022-06-01 00:00:00' + to_minutes(CAST(p_partkey % 500000 AS BIGINT)) AS created_at
        FROM part""",
    "users": """
        SELECT CAST(s_suppkey AS BIGINT) AS id,
               'user' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS username,
               'user' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '@example.com' AS email,
               s_name AS full_name,
               CASE WHEN s_suppkey % 10 = 0 THEN 'admin' WHEN s_suppkey % 10 = 1 THEN 'staff'
                    ELSE 'customer' END AS role,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL
                    ELSE '555-' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') END AS phone,
               TIMESTAMP '2022-01-01 00:00:00' + to_hours(CAST(s_suppkey AS BIGINT)) AS created_at,
               (s_suppkey % 6 <> 5) AS is_active
        FROM supplier""",
    "vehicles": """
        SELECT CAST(c_custkey AS BIGINT) AS id,
               CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE CAST(c_custkey % 10 AS BIGINT) END AS user_id,
               'P-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS license_plate,
               CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'car' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'electric'
                    WHEN c_mktsegment = 'FURNITURE' THEN 'motorcycle' ELSE 'truck' END AS vehicle_type,
               TIMESTAMP '2023-01-01 00:00:00' + to_minutes(CAST(c_custkey AS BIGINT)) AS created_at,
               CASE WHEN c_custkey % 6 <> 0 THEN 'Make ' || CAST(c_custkey % 6 AS VARCHAR) END AS make,
               CASE WHEN c_custkey % 6 <> 0 THEN 'Model ' || CAST(c_custkey % 40 AS VARCHAR) END AS model,
               CASE c_custkey % 3 WHEN 0 THEN 'white' WHEN 1 THEN 'black' END AS color,
               TIMESTAMP '2023-01-01 00:00:00' + to_minutes(CAST(c_custkey AS BIGINT)) + to_hours(CAST(c_custkey % 48 AS BIGINT))
                   AS updated_at
        FROM customer""",
    "sessions_base": """
        SELECT event_id AS id, user_id AS vehicle_id, (event_id * 7919) % 200 AS spot_id,
               user_id % 10 AS user_id, ts AS entry_time,
               CASE WHEN event_type = 'error' THEN NULL
                    ELSE ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) END AS exit_time,
               CASE WHEN event_type IN ('purchase', 'view') THEN 'paid'
                    WHEN event_type = 'click' THEN 'cancelled' ELSE 'pending' END AS payment_status,
               CASE event_id % 4 WHEN 0 THEN 'cash' WHEN 1 THEN 'card' WHEN 2 THEN 'online'
                    ELSE 'subscription' END AS payment_method,
               CAST(1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 24 AS INTEGER) AS booked_hours
        FROM events""",
    "parking_sessions": """
        SELECT b.id, b.vehicle_id, b.spot_id, b.user_id, b.entry_time, b.exit_time,
               CAST(datesub('minute', b.entry_time, b.exit_time) AS INTEGER) AS duration_minutes,
               CAST(ceil(datesub('minute', b.entry_time, b.exit_time) / 60.0) * s.hourly_rate
                    AS DECIMAL(10,2)) AS total_amount,
               b.payment_status, b.payment_method, b.entry_time AS created_at, b.booked_hours,
               'S-' || lpad(CAST(b.spot_id AS VARCHAR), 6, '0') AS spot_number
        FROM sessions_base b LEFT JOIN parking_spots s ON b.spot_id = s.id""",
    "reservations": """
        SELECT o_orderkey AS id, o_custkey % 10 AS user_id, o_orderkey % 200 AS spot_id,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS vehicle_id,
               o_orderdate AS start_time,
               o_orderdate + to_hours(CAST(substr(o_orderpriority, 1, 1) AS BIGINT)) AS end_time,
               CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'completed'
                    WHEN 'P' THEN 'cancelled' END AS status,
               CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
               CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'P' THEN 'refunded' ELSE 'pending' END AS payment_status,
               o_orderdate - to_days(CAST(o_orderkey % 9 AS INTEGER)) AS created_at
        FROM orders""",
    "handles": """
        SELECT CAST(c_custkey AS BIGINT) AS handle_id,
               CASE c_custkey % 4
                    WHEN 0 THEN CASE WHEN c_custkey % 8 = 0 THEN 'USER' ELSE 'user' END || lpad(CAST(c_custkey % 16 AS VARCHAR), 6, '0')
                    WHEN 1 THEN CASE WHEN c_custkey % 8 = 1 THEN 'User' || lpad(CAST(c_custkey % 16 AS VARCHAR), 6, '0') || '@Example.COM'
                                     ELSE 'user' || lpad(CAST(c_custkey % 16 AS VARCHAR), 6, '0') || '@example.com' END
                    WHEN 2 THEN 'nobody' || CAST(c_custkey AS VARCHAR)
                    ELSE c_name END AS handle
        FROM customer""",
    "user_import": """
        SELECT CAST(c_custkey AS BIGINT) AS request_id,
               CASE c_custkey % 5 WHEN 0 THEN 'user' || lpad(CAST(c_custkey % 16 AS VARCHAR), 6, '0')
                    WHEN 1 THEN 'new' || lpad(CAST(c_custkey % 40 AS VARCHAR), 4, '0')
                    WHEN 2 THEN 'ab' ELSE 'cust' || CAST(c_custkey AS VARCHAR) END AS username,
               CASE c_custkey % 7 WHEN 0 THEN 'not-an-email'
                    WHEN 1 THEN 'user' || lpad(CAST(c_custkey % 16 AS VARCHAR), 6, '0') || '@example.com'
                    WHEN 2 THEN 'shared' || CAST(c_custkey % 30 AS VARCHAR) || '@mail.test'
                    ELSE 'c' || CAST(c_custkey AS VARCHAR) || '@mail.test' END AS email,
               CAST(c_custkey % 9 + 2 AS INTEGER) AS password_length,
               CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS full_name,
               CASE WHEN c_custkey % 13 = 0 THEN 'admin' END AS requested_role
        FROM customer""",
    "vehicle_import": """
        SELECT CAST(c_custkey AS BIGINT) AS request_id, c_custkey % 10 AS user_id,
               CASE c_custkey % 6 WHEN 0 THEN 'p-' || lpad(CAST(c_custkey % 50 AS VARCHAR), 8, '0')
                    WHEN 1 THEN '  '
                    WHEN 2 THEN 'n-' || lpad(CAST(c_custkey % 97 AS VARCHAR), 5, '0')
                    ELSE 'N-' || CAST(c_custkey AS VARCHAR) END AS license_plate,
               CASE WHEN c_custkey % 5 = 0 THEN 'spaceship' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'car'
                    WHEN c_mktsegment = 'HOUSEHOLD' THEN 'electric' WHEN c_mktsegment = 'FURNITURE' THEN 'motorcycle'
                    ELSE 'truck' END AS vehicle_type,
               CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'Make ' || CAST(c_custkey % 6 AS VARCHAR) END AS make,
               CASE WHEN c_custkey % 5 <> 0 THEN 'Model ' || CAST(c_custkey % 40 AS VARCHAR) ELSE '' END AS model,
               CASE c_custkey % 3 WHEN 0 THEN 'white' WHEN 1 THEN '' END AS color
        FROM customer""",
    "user_changes": """
        SELECT o_orderkey AS change_id, CAST(o_custkey % 16 AS BIGINT) AS user_id,
               CASE WHEN o_orderkey % 20 = 0 THEN 'delete' WHEN o_orderkey % 20 = 1 THEN 'insert'
                    WHEN o_orderkey % 20 BETWEEN 2 AND 7 THEN 'role' ELSE 'profile' END AS op,
               o_orderdate + to_seconds(CAST(o_orderkey % 86400 AS BIGINT)) AS changed_at,
               'user' || lpad(CAST(o_custkey % 16 AS VARCHAR), 6, '0') AS username,
               'user' || lpad(CAST(o_custkey % 16 AS VARCHAR), 6, '0') || '@example.com' AS email,
               'Name ' || CAST(o_orderkey AS VARCHAR) AS full_name,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL
                    ELSE '555-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') END AS phone,
               CASE o_orderkey % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'staff' ELSE 'admin' END AS role
        FROM orders""",
    "spot_flag_changes": """
        SELECT event_id, ts, (event_id * 7919) % 200 AS spot_id,
               CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_type IN ('view', 'signup') THEN 'check_in'
                                                    WHEN event_type IN ('purchase', 'error') THEN 'check_out' END
                    ELSE CASE WHEN event_type IN ('view', 'signup') THEN 'reserve'
                              WHEN event_type IN ('purchase', 'error') THEN 'cancel' END END AS action
        FROM events""",
    "reservation_changes": """
        SELECT l_orderkey AS reservation_id, l_shipdate AS changed_at, l_orderkey * 10 + l_linenumber AS change_id,
               CASE l_returnflag WHEN 'R' THEN 'cancelled' WHEN 'A' THEN 'completed' END AS status,
               CASE WHEN l_linestatus = 'F' THEN CASE l_returnflag WHEN 'R' THEN 'refunded' ELSE 'paid' END END AS payment_status
        FROM lineitem""",
    "ai_predictions": "SELECT event_id AS id, CAST(event_id % 25 AS INTEGER) AS zone_id FROM events",
    "audit_logs": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey % 16 END AS user_id FROM orders",
    "vehicle_log": """
        SELECT event_id, ts, user_id AS vehicle_id, (event_id * 7919) % 200 AS spot_id,
               CASE WHEN event_type IN ('view', 'signup') THEN 'check_in'
                    WHEN event_type IN ('purchase', 'error') THEN 'check_out'
                    WHEN event_type = 'click' THEN 'extend' END AS action,
               CAST(1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 24 AS INTEGER) AS hours
        FROM events""",
    "checkin_plates": """
        SELECT event_id, ts, spot_id,
               CASE WHEN event_id % 10 = 0 THEN 'W-' || lpad(CAST(event_id % 300 AS VARCHAR), 6, '0')
                    ELSE 'P-' || lpad(CAST(vehicle_id AS VARCHAR), 8, '0') END AS license_plate
        FROM vehicle_log WHERE action = 'check_in'""",
    "reservation_log": """
        SELECT event_id, ts, user_id AS vehicle_id, (event_id * 7919) % 200 AS spot_id,
               CASE WHEN event_type IN ('view', 'signup') THEN 'reserve'
                    WHEN event_type IN ('purchase', 'error') THEN 'cancel' END AS action,
               CAST(1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 24 AS INTEGER) AS hours
        FROM events""",
}


def _deps(name: str) -> list[str]:
    body = VIEWS[name]
    return [v for v in VIEWS if v != name and re.search(rf"\b{v}\b", body)]


def with_views(sql: str, extra_ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with the CTEs of every parking view it mentions.

    ``extra_ctes`` are query-specific CTEs (name, body) placed after the views.
    """
    text = sql + " ".join(body for _, body in (extra_ctes or []))
    needed: list[str] = []

    def visit(v: str) -> None:
        if v in needed:
            return
        for d in _deps(v):
            visit(d)
        needed.append(v)

    for v in VIEWS:
        if re.search(rf"\b{v}\b", text):
            visit(v)
    ctes = [f"{v} AS ({VIEWS[v]})" for v in needed]
    ctes += [f"{n} AS ({b})" for n, b in (extra_ctes or [])]
    if not ctes:
        return sql
    head = sql.lstrip()
    if head[:4].upper() == "WITH":
        # merge with the query's own WITH clause
        rest = head[4:].lstrip()
        if rest[:9].upper() == "RECURSIVE":
            return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + rest[9:].lstrip()
        return "WITH " + ",\n".join(ctes) + ",\n" + rest
    return "WITH " + ",\n".join(ctes) + "\n" + sql
