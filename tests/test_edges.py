"""Hand-made edge rows (FIXTURES.md §3) run through the operators."""

from datetime import datetime as dt

from pyspark.sql import functions as F

from parkops import schemas as S
from parkops.functions.billing import bill
from parkops.operators import bookings as bk
from parkops.operators import imports, lifecycle, lookups, reports
from parkops.operators.cycle import booking_cycle, expiries

AS_OF = "2024-01-30 23:59:59"


def spots_df(spark, rows):
    return spark.createDataFrame(rows, S.PARKING_SPOTS)


def zones_df(spark, rows):
    return spark.createDataFrame(rows, S.ZONES)


def test_billing_modes(spark):
    from decimal import Decimal
    df = spark.createDataFrame(
        [(dt(2024, 1, 1, 10), dt(2024, 1, 1, 10, 0, 30), Decimal("5.00")),
         (dt(2024, 1, 1, 10), dt(2024, 1, 1, 11, 0, 30), Decimal("5.00")),
         (dt(2024, 1, 1, 10), dt(2024, 1, 1, 10, 30), Decimal("0.00")),
         (dt(2024, 1, 1, 10), dt(2024, 1, 1, 10, 30), None)],
        "a timestamp_ntz, b timestamp_ntz, r decimal(10,2)")
    cols = []
    for m in ("server", "client", "display"):
        b = bill("a", "b", "r", m)
        cols += [b["hours"].alias(f"{m}_h"), b["amount"].alias(f"{m}_a")]
    r = df.select(*cols).collect()
    # 30 s: server 0 h / 0.00, client and display 1 h
    assert (r[0]["server_h"], r[0]["server_a"], r[0]["client_h"], r[0]["display_h"]) == (0, 0.0, 1, 1)
    # 60 min 30 s: server and client 1 h, display 2 h
    assert (r[1]["server_h"], r[1]["client_h"], r[1]["display_h"], r[1]["display_a"]) == (1, 1, 2, 10.0)
    # rate 0 or NULL: client falls back to 5
    assert r[2]["client_a"] == 5.0 and r[3]["client_a"] == 5.0 and r[3]["server_a"] is None


def test_active_zone_without_spots_and_double_flags(spark):
    z = zones_df(spark, [(1, "A", "a", 12, True), (2, "B", "b", 12, True), (3, "C", "c", 12, False)])
    s = spots_df(spark, [(1, "A-01", 1, "regular", True, True, None), (2, "A-02", 1, "regular", False, False, None)])
    occ = {r["id"]: r for r in reports.zone_occupancy(z, s).collect()}
    assert set(occ) == {1, 2}
    assert (occ[2]["total_spots"], occ[2]["occupied"], occ[2]["occupancy_rate"]) == (0, 0, None)
    assert occ[1]["occupancy_rate"] == 50.0
    summ = {r["id"]: r for r in reports.zones_summary(z, s).collect()}
    assert (summ[1]["occupied_spots"], summ[1]["reserved_spots"]) == (1, 1)  # both counted
    cli = {r["id"]: r for r in reports.zones_summary_client(z, s).collect()}
    assert set(cli) == {1}  # a zone without spots does not appear
    assert (cli[1]["occupied_spots"], cli[1]["reserved_spots"], cli[1]["available_spots"]) == (1, 0, 1)


def test_no_spots_gives_zero_occupancy(spark):
    s = spots_df(spark, [])
    sess = spark.createDataFrame([], S.PARKING_SESSIONS)
    r = reports.dashboard_kpis(s, sess, AS_OF).collect()[0]
    assert (r["total_spots"], r["occupancy_rate"], r["today_revenue"]) == (0, 0, 0.0)


def test_available_filter_only_for_exact_true(spark):
    z = zones_df(spark, [(1, "A", "a", 12, True)])
    s = spots_df(spark, [(1, "A-01", 1, "regular", True, False, None), (2, "A-02", 1, "regular", False, False, None)])
    assert lookups.spots_filtered(s, z, available="1").count() == 2
    assert lookups.spots_filtered(s, z, available="true").count() == 1
    assert lookups.spots_filtered(s, z, zone="", available=None).count() == 2


def log_df(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, vehicle_id long, spot_id long, "
                                       "action string, hours int")


def test_pairing_rejects_double_check_in_and_orphan_check_out(spark):
    log = log_df(spark, [
        (1, dt(2024, 1, 1, 8), 7, 1, "check_out", 1),
        (2, dt(2024, 1, 1, 9), 7, 1, "check_in", 1),
        (3, dt(2024, 1, 1, 10), 7, 2, "check_in", 1),
        (4, dt(2024, 1, 1, 11), 7, 1, "check_out", 1),
        (5, dt(2024, 1, 1, 11), 8, 1, "check_in", 1)])
    r = {x["event_id"]: x for x in lifecycle.session_pairing(log).collect()}
    assert (r[1]["accepted"], r[1]["reason"]) == (False, "no_open_session")
    assert r[2]["accepted"] and r[2]["exit_event_id"] == 4
    assert (r[3]["accepted"], r[3]["reason"]) == (False, "already_parked")
    assert r[4]["accepted"]
    assert r[5]["accepted"] and r[5]["exit_time"] is None


def test_booking_admission_is_strict_at_the_end(spark):
    spots = spots_df(spark, [(1, "S1", 1, "regular", False, False, None)])
    log = log_df(spark, [
        (1, dt(2024, 1, 1, 8), 1, 1, "check_in", 2),    # holds until 10:00
        (2, dt(2024, 1, 1, 10), 2, 1, "check_in", 1),   # exactly at the end: still held
        (3, dt(2024, 1, 1, 10, 0, 1), 3, 1, "check_in", 1),  # after the end: accepted, holds to 11:00:01
        (4, dt(2024, 1, 1, 11), 4, 1, "check_in", 1),   # rejected
        (5, dt(2024, 1, 1, 9), 5, 99, "check_in", 1),  # unknown spot
        (6, dt(2024, 1, 1, 9), 6, 1, "check_in", -2), (7, dt(2024, 1, 1, 9), 7, 1, "check_in", -2),
        (8, dt(2024, 1, 1, 9), 8, 1, "check_in", None), (9, None, 9, 1, "check_in", 1), (10, dt(2024, 1, 1, 9), 9, None, "check_in", 1)])
    r = {x["event_id"]: x for x in lifecycle.spot_booking_admission(booking_cycle(log, spots)).collect()}
    assert [r[i]["accepted"] for i in (1, 2, 3, 4, 5)] == [True, False, True, False, False]
    assert r[5]["reason"] == "spot_not_found" and r[2]["reason"] == "spot_occupied"
    assert {r[i]["reason"] for i in (6, 7, 8, 9, 10)} == {"invalid_event"}


def test_check_out_ends_a_booking(spark):
    spots = spots_df(spark, [(1, "S1", 1, "regular", True, True, None)])
    log = log_df(spark, [
        (1, dt(2024, 1, 1, 8), 1, 1, "extend", 1),      # no booking yet
        (2, dt(2024, 1, 1, 8), 1, 1, "check_in", 24),
        (3, dt(2024, 1, 1, 9), 2, 1, "check_in", 1),    # held
        (4, dt(2024, 1, 1, 10), 1, 1, "check_out", None),
        (5, dt(2024, 1, 1, 10, 30), 1, 1, "extend", 1),  # nothing to extend
        (6, dt(2024, 1, 1, 11), 3, 1, "check_in", 1),   # inside the old end: free again
        (7, dt(2024, 1, 1, 13), 3, 1, "extend", 5),     # ran out at 12:00, moves to 17:00
        (8, dt(2024, 1, 1, 16), 4, 1, "check_in", 1)])
    life = booking_cycle(log, spots)
    got = {x["event_id"]: (x["kind"], x["booking_id"]) for x in life.collect()}
    assert got == {1: ("no_booking", None), 2: ("booked", 2), 3: ("rejected", 2), 4: ("checked_out", None),
                   5: ("no_booking", None), 6: ("booked", 6), 7: ("extended", 6), 8: ("rejected", 6)}
    until = F.lit(dt(2024, 1, 1, 17, 0, 1)).cast("timestamp_ntz")
    ran_out = sorted(x["end_time"] for x in expiries(life, until).collect())
    assert ran_out == [dt(2024, 1, 1, 12), dt(2024, 1, 1, 17)]
    swept = bk.expire_bookings(spots, bk.spot_bookings(life, AS_OF), AS_OF).collect()[0]
    assert (swept["booking_id"], swept["expired"], swept["is_occupied"], swept["is_reserved"]) == (6, True, False, False)
    gone = bk.spot_bookings(booking_cycle(log.filter("event_id <= 5"), spots), AS_OF)
    swept = bk.expire_bookings(spots, gone, AS_OF).collect()[0]
    assert (swept["booking_id"], swept["expired"], swept["is_occupied"], swept["is_reserved"]) == (None, None, False, False)


def test_reservation_on_occupied_reserved_spot(spark):
    spots = spots_df(spark, [(1, "S1", 1, "regular", True, True, None), (2, "S2", 1, "regular", False, False, None)])
    log = log_df(spark, [
        (1, dt(2024, 1, 1, 8), 1, 1, "reserve", 1), (2, dt(2024, 1, 1, 9), 1, 1, "cancel", 1),
        (3, dt(2024, 1, 1, 10), 1, 1, "cancel", 1), (4, dt(2024, 1, 1, 8), 1, 2, "cancel", 1),
        (5, dt(2024, 1, 1, 9), 1, 2, "reserve", 1), (6, dt(2024, 1, 1, 10), 1, 2, "reserve", 1)])
    r = {x["event_id"]: (x["accepted"], x["reason"]) for x in lifecycle.reservation_admission(log, spots).collect()}
    assert r[1] == (False, "spot_occupied") and r[2] == (True, None) and r[3] == (False, "not_reserved")
    assert r[4] == (False, "not_reserved") and r[5] == (True, None) and r[6] == (False, "spot_reserved")


def test_booking_ending_exactly_now(spark):
    spots = spots_df(spark, [(1, "S1", 1, "regular", False, False, None)])
    log = log_df(spark, [(1, dt(2024, 1, 30, 22, 59, 59), 1, 1, "check_in", 1)])
    states = bk.spot_bookings(booking_cycle(log, spots), AS_OF)
    swept = bk.expire_bookings(spots, states, AS_OF).collect()[0]
    assert swept["expired"] is False and swept["is_occupied"] is True  # not past the end (strict)
    u = bk.booking_urgency(bk.current_bookings(states), AS_OF).collect()[0]
    assert u["remaining_ms"] == 0 and u["expired"] is True and u["countdown"] == "00:00:00"
    cnt = bk.urgency_counts(bk.expire_bookings(spots, states, AS_OF), AS_OF).collect()[0]
    assert (cnt["critical_count"], cnt["warning_count"]) == (1, 1)
    board = bk.spot_status_board(bk.expire_bookings(spots, states, AS_OF), AS_OF).collect()[0]
    assert board["status"] == "overdue"


def test_extension_of_expired_booking_counts_from_old_end(spark):
    spots = spots_df(spark, [(1, "S1", 1, "regular", False, False, None)])
    life = booking_cycle(log_df(spark, [(1, dt(2024, 1, 1, 8), 1, 1, "check_in", 1), (10, dt(2024, 1, 1, 12), 1, 1, "extend", 2),
                                        (11, dt(2024, 1, 1, 7), 1, 1, "extend", 1)]), spots)
    r = {e["event_id"]: e for e in bk.apply_extensions(life, AS_OF).collect()}
    assert r[10]["new_end_time"] == dt(2024, 1, 1, 11)  # old end 09:00 + 2 h, still in the past
    assert r[11]["booking_id"] is None and not r[11]["applied"]  # before any booking
    cur = bk.current_bookings(bk.spot_bookings(life, AS_OF)).collect()[0]
    assert (cur["end_time"], cur["duration_hours"], cur["total_extended_hours"]) == (dt(2024, 1, 1, 11), 3, 2)


def test_session_with_missing_vehicle_is_not_listed(spark):
    z = zones_df(spark, [(1, "A", "a", 12, True)])
    s = spots_df(spark, [(1, "A-01", 1, "regular", True, False, None)])
    v = spark.createDataFrame([(1, None, "P-1", "car", None, "A", "B", "red", None)], S.VEHICLES)
    sess = spark.createDataFrame(
        [(1, 1, 1, None, dt(2024, 1, 30, 10), None, None, None, "pending", "cash"),
         (2, 99, 1, None, dt(2024, 1, 30, 11), None, None, None, "pending", "cash")], S.PARKING_SESSIONS)
    assert [r["id"] for r in lookups.active_sessions(sess, v, s, z, AS_OF).collect()] == [1]
    assert {r["session_id"] for r in reports.recent_activity(sess, v, s, z, AS_OF).collect()} == {1}


def test_batch_registration_first_wins_and_chains(spark):
    users = spark.createDataFrame([(1, "admin", "admin@x.io", "Admin", "admin", None, None, True)], S.USERS)
    req = spark.createDataFrame(
        [(1, "alice", "p@x.io", 8, "A", None), (2, "bob", "p@x.io", 8, "B", None),
         (3, "bob", "q@x.io", 8, "B", None), (4, "alice", "r@x.io", 8, "A", "admin"),
         (5, "admin", "s@x.io", 8, "C", None), (6, "zed", "bad", 8, "Z", None)],
        "request_id long, username string, email string, password_length int, full_name string, "
        "requested_role string")
    r = {x["request_id"]: x for x in imports.user_import_validate(req, users).collect()}
    assert [r[i]["accepted"] for i in range(1, 7)] == [True, False, True, False, False, False]
    assert r[2]["reason"] == "duplicate_in_batch" and r[5]["reason"] == "already_exists"
    assert r[6]["reason"] == "email_invalid" and r[1]["role"] == "customer"


def test_events_without_key_or_time_are_rejected(spark):
    log = log_df(spark, [(1, None, 7, 1, "check_in", 1), (2, dt(2024, 1, 1, 9), None, 1, "check_in", 1),
                         (3, dt(2024, 1, 1, 9), 7, 1, "check_in", 1)])
    r = {x["event_id"]: (x["accepted"], x["reason"]) for x in lifecycle.session_pairing(log).collect()}
    assert r == {1: (False, "invalid_event"), 2: (False, "invalid_event"), 3: (True, None)}
    spots = spots_df(spark, [(1, "S1", 1, "regular", False, False, None)])
    rl = log_df(spark, [(1, None, 7, 1, "reserve", 1), (2, dt(2024, 1, 1, 9), 7, None, "reserve", 1),
                        (3, dt(2024, 1, 1, 9), 7, 1, "reserve", 1)])
    r = {x["event_id"]: (x["accepted"], x["reason"]) for x in lifecycle.reservation_admission(rl, spots).collect()}
    assert r == {1: (False, "invalid_event"), 2: (False, "spot_not_found"), 3: (True, None)}


def test_registration_address_and_length_rules(spark):
    users = spark.createDataFrame([(1, "admin", "admin@x.io", "Admin", "admin", None, None, True)], S.USERS)
    mails = ["a@b.co", "a.b+c@d-e.org", "a b@c.io", "a@b", "a@b.c", "a..b@c.io", ".a@c.io", "a@-b.io", "a@b..io", "a@b@c.io",
             "x" * 65 + "@b.io", "a@" + "b" * 100 + ".io", None]
    rows = [(i, f"name{i}", m, 8, " ", None) for i, m in enumerate(mails)]
    rows += [(50, "long", "l@x.io", 8, "n" * 101, None), (51, "none", "n@x.io", 8, "", None)]
    req = spark.createDataFrame(rows, "request_id long, username string, email string, password_length int, full_name string, "
                                      "requested_role string")
    r = {x["request_id"]: x["reason"] for x in imports.user_import_validate(req, users).collect()}
    assert [i for i in range(len(mails)) if r[i] is None] == [0, 1]
    assert {r[i] for i in range(2, len(mails))} == {"email_invalid"}
    assert (r[50], r[51]) == ("full_name_long", "full_name_empty")


def test_bad_rows_do_not_stop_or_pollute(spark):
    from parkops.sources import documents
    doc = '{"id": 1, "booking": {"sessionId": 1, "startTime": "yesterday", "endTime": "2024-01-01T08:00:00.000Z"}}'
    row = documents.booking_json_flatten(spark.createDataFrame([(doc,), ("not json",)], "doc string")).filter("spot_id = 1").collect()[0]
    assert row["start_time"] is None and row["end_time"] == dt(2024, 1, 1, 8)
    seen = spark.createDataFrame([(1, dt(2024, 1, 1), None), (2, dt(2024, 1, 1), "  "), (3, dt(2024, 1, 1), "p-1")],
                                 "event_id long, ts timestamp_ntz, license_plate string")
    none = spark.createDataFrame([], S.VEHICLES)
    assert [x["license_plate"] for x in imports.walk_in_vehicles(seen, none).collect()] == ["P-1"]
    z = zones_df(spark, [(1, "A", "a", 12, True)])
    s = spots_df(spark, [(1, "A-01", 1, "regular", True, False, None)])
    back = spark.createDataFrame([(1, 1, 1, None, dt(2024, 1, 30, 10), dt(2024, 1, 30, 9), None, None, "pending", "cash")], S.PARKING_SESSIONS)
    assert reports.occupancy_profile(z, s, back, AS_OF).count() == 24
