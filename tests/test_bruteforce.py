"""Sequential rules against plain-Python simulations on random logs with a
hot key (one vehicle / spot holding a large share of the rows)."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parkops import schemas as S
from parkops.operators import changes, imports, lifecycle
from parkops.operators.cycle import booking_cycle, expiries

T0 = datetime(2024, 1, 1)


def random_log(rnd, n, actions, n_keys=6, hot_share=0.4):
    rows = []
    for i in range(n):
        key = 0 if rnd.random() < hot_share else rnd.randint(1, n_keys)
        ts = T0 + timedelta(minutes=rnd.randint(0, 60 * 24 * 3))
        rows.append((i, ts, key, key, rnd.choice(actions), rnd.randint(1, 6)))
    return rows


def log_df(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, vehicle_id long, spot_id long, "
                                       "action string, hours int")


@pytest.mark.parametrize("seed", [1, 2])
def test_session_pairing_matches_simulation(spark, seed):
    rnd = random.Random(seed)
    rows = random_log(rnd, 500, ["check_in", "check_out", "extend"])
    got = {r["event_id"]: (r["accepted"], r["exit_event_id"])
           for r in lifecycle.session_pairing(log_df(spark, rows)).collect()}
    want = {}
    by_vehicle = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if r[4] in ("check_in", "check_out"):
            by_vehicle.setdefault(r[2], []).append(r)
    for evs in by_vehicle.values():
        open_in = None
        for e in evs:
            if e[4] == "check_in":
                ok = open_in is None
                want[e[0]] = [ok, None]
                if ok:
                    open_in = e[0]
            else:
                ok = open_in is not None
                want[e[0]] = [ok, None]
                if ok:
                    want[open_in][1] = e[0]
                    open_in = None
    assert got == {k: tuple(v) for k, v in want.items()}


# without check-outs, and check-ins faster than bookings end, a spot is one piece: it's cut into chunks of rows
@pytest.mark.parametrize("actions, chunk_rows", [(["check_in", "check_in", "extend", "check_out"], 100_000),
                                                 (["check_in", "check_in", "extend", "check_out"], 5),
                                                 (["check_in"], 40), (["check_in"] * 12 + ["extend"], 25)])
def test_booking_cycle_matches_simulation(spark, actions, chunk_rows):
    rnd = random.Random(5)
    rows = random_log(rnd, 700, actions, n_keys=4, hot_share=0.5)
    spots = spark.createDataFrame([(k, f"S{k}", 1, "regular", False, False, None) for k in range(4)],
                                  S.PARKING_SPOTS)  # spot 4 is unknown
    life = booking_cycle(log_df(spark, rows), spots, chunk_rows)
    got = {r["event_id"]: (r["kind"], r["booking_id"]) for r in life.collect()}
    want, held, ends = {}, {}, []
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        event, t, _, spot, action, hours = r[:6]
        if spot >= 4:
            want[event] = ("spot_not_found", None)
            continue
        bid, end, told = held.get(spot, (None, None, True))
        if bid is not None and not told and t > end:
            ends.append((spot, bid, end))
            told = True
        if action == "check_out":
            bid, kind = None, "checked_out"
        elif action == "extend":
            kind = "no_booking" if bid is None else "extended"
            if bid is not None:
                end, told = end + timedelta(hours=hours), False
        elif bid is None or t > end:
            bid, end, told, kind = event, t + timedelta(hours=hours), False, "booked"
        else:
            kind = "rejected"
        held[spot] = (bid, end, told)
        want[event] = (kind, bid)
    assert got == want
    until = max(r[1] for r in rows)
    ends += [(s, b, e) for s, (b, e, told) in held.items() if b is not None and not told and until > e]
    out = expiries(life, F.lit(until).cast("timestamp_ntz")).collect()
    assert sorted((r["spot_id"], r["booking_id"], r["end_time"]) for r in out) == sorted(ends)


def test_chunk_functions_equal_the_walk():
    from parkops.operators.cycle import chunk_function
    rnd = random.Random(8)
    for _ in range(300):
        rows, t = [], 0
        for i in range(rnd.randint(0, 12)):
            t += rnd.randint(0, 4) - (rnd.random() < 0.2) * rnd.randint(0, 9)   # an extension sets the clock back
            rows.append((t, t + rnd.randint(1, 8), i))
        function = chunk_function(rows)
        for entry in (None, *range(-12, 40)):
            reach, booking = entry, "before"
            for time, ends, event in rows:
                if reach is None or time > reach:
                    reach, booking = ends, event
            first = next((f for f in function if entry is None or f[0] > entry), None)
            assert (first[1:] if first else (entry, "before")) == (reach, booking)


def test_reservation_admission_matches_simulation(spark):
    rnd = random.Random(9)
    rows = random_log(rnd, 400, ["reserve", "cancel"], n_keys=5)
    flags = {k: (k == 2, k in (1, 2)) for k in range(5)}  # (occupied, reserved); spot 5 unknown
    spots = spark.createDataFrame([(k, f"S{k}", 1, "regular", o, r, None) for k, (o, r) in flags.items()],
                                  S.PARKING_SPOTS)
    got = {r["event_id"]: r["accepted"]
           for r in lifecycle.reservation_admission(log_df(spark, rows), spots).collect()}
    want = {}
    state = {k: r for k, (_, r) in flags.items()}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        spot = r[3]
        if spot not in flags:
            want[r[0]] = False
            continue
        if r[4] == "reserve":
            ok = not flags[spot][0] and not state[spot]
            if ok:
                state[spot] = True
        else:
            ok = state[spot]
            state[spot] = False
        want[r[0]] = ok
    assert got == want


def test_greedy_unique_matches_simulation(spark):
    rnd = random.Random(11)
    rows = [(i, f"u{rnd.randint(0, 30)}", f"e{rnd.randint(0, 30)}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, u string, e string")
    got = {r["id"] for r in imports.greedy_unique(df, "id", ["u", "e"]).collect()}
    seen_u, seen_e, want = set(), set(), set()
    for i, u, e in rows:
        if u not in seen_u and e not in seen_e:
            want.add(i)
            seen_u.add(u)
            seen_e.add(e)
    assert got == want


def test_change_log_matches_simulation(spark):
    rnd = random.Random(13)
    base = [(k, f"user{k}", f"user{k}@x", f"Name{k}", "customer", None, None, True) for k in range(5)]
    users = spark.createDataFrame(base, S.USERS)
    ops = ["profile", "role", "delete", "insert"]
    log = []
    for i in range(200):
        k = rnd.randint(0, 7)
        ts = T0 + timedelta(hours=rnd.randint(0, 50))
        log.append((i, k, rnd.choice(ops), ts, f"user{k}", f"user{k}@x", f"N{i}",
                    None if i % 3 == 0 else f"p{i}", rnd.choice(["admin", "staff", "customer"])))
    ch = spark.createDataFrame(log, "change_id long, user_id long, op string, changed_at timestamp_ntz, "
                                    "username string, email string, full_name string, phone string, role string")
    got = {r["id"]: (r["full_name"], r["phone"], r["role"], r["is_active"])
           for r in changes.change_log_snapshot(users, ch).collect()}
    table = {b[0]: {"full_name": b[3], "phone": b[5], "role": b[4], "is_active": True} for b in base}
    for c in sorted(log, key=lambda c: (c[3], c[0])):
        k, op = c[1], c[2]
        if op == "delete":
            table.pop(k, None)
        elif op == "insert":
            table[k] = {"full_name": c[6], "phone": c[7], "role": c[8], "is_active": True}
        elif k in table and op == "profile":
            table[k].update(full_name=c[6], phone=c[7])
        elif k in table and op == "role":
            table[k]["role"] = c[8]
    want = {k: (v["full_name"], v["phone"], v["role"], v["is_active"]) for k, v in table.items()}
    assert got == want
