"""Look-ups: letter case of handles, spots by number, the newest events, documents both ways."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parkops import schemas as S
from parkops.operators import lookups, reports
from parkops.sources import documents
from parkops.sources.fixtures import AS_OF, model
from settings import SF_SMALL

T0 = datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_handles_resolve_in_either_case(spark):
    users = spark.createDataFrame([(3, "user000003", "User3@Example.com", "U", "staff", None, None, True),
                                   (4, "gone", "gone@x.io", "G", "staff", None, None, False)], S.USERS)
    handles = spark.createDataFrame([(1, "USER000003"), (2, "user3@EXAMPLE.com"), (3, "user000003"), (4, "Gone"), (5, None), (6, "")],
                                    "handle_id long, handle string")
    got = lookups.identity_resolve(handles, users)
    assert {r.handle_id: (r.handle, r.user_id) for r in got.collect()} == {
        1: ("USER000003", 3), 2: ("user3@EXAMPLE.com", 3), 3: ("user000003", 3), 4: ("Gone", None), 5: (None, None), 6: ("", None)}
    exact = lookups.identity_resolve(handles, users, case_sensitive=True)
    assert {r.handle_id for r in exact.filter("user_id = 3").collect()} == {3}
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_bookings_find_the_first_spot_of_a_number(spark):
    z = spark.createDataFrame([(1, "A", "a", 12, True), (2, "B", "b", 12, True)], S.ZONES)
    s = spark.createDataFrame([(7, "X-1", 2, "regular", False, False, None), (3, "X-1", 1, "regular", False, False, None)], S.PARKING_SPOTS)
    v = spark.createDataFrame([(1, None, "P-1", "car", None, "A", "B", "red", None)], S.VEHICLES)
    sess = spark.createDataFrame([(1, 1, 7, T0, None, 2, "X-1"), (2, 1, 99, T0, None, 3, "Y-9"), (3, 1, 7, T0, None, 1, None)],
                                 "id long, vehicle_id long, spot_id long, entry_time timestamp_ntz, exit_time timestamp_ntz, booked_hours int, "
                                 "spot_number string")
    got = {r.id: (r.spot_number, r.zone_name, r.booking_cost) for r in lookups.booking_rows(sess, v, s, z).collect()}
    assert got == {1: ("X-1", "A", 10.0), 2: ("Y-9", None, 15.0), 3: (None, None, 5.0)}


def test_recent_activity_widens_beyond_orphans(spark):
    """A thousand newest events of unknown vehicles: older ones come, and no whole table of sessions is joined."""
    z = spark.createDataFrame([(1, "A", "a", 12, True)], S.ZONES)
    s = spark.createDataFrame([(1, "A-01", 1, "regular", True, False, None)], S.PARKING_SPOTS)
    v = spark.createDataFrame([(1, None, "P-1", "car", None, "A", "B", "red", None)], S.VEHICLES)
    rows = [(i, 1 if i < 40 else 99, 1, None, T0 + timedelta(minutes=i), None, None, None, "pending", "cash") for i in range(1040)]
    sess = spark.createDataFrame(rows, S.PARKING_SESSIONS)
    got = [r.session_id for r in reports.recent_activity(sess, v, s, z, AS_OF).collect()]
    assert got == list(range(39, 19, -1))
    few = reports.recent_activity(sess.filter("id in (3, 5) or id >= 40"), v, s, z, AS_OF)
    assert [r.session_id for r in few.collect()] == [5, 3]
    assert reports.recent_activity(sess.filter("id < 0"), v, s, z, AS_OF).count() == 0


def test_recent_activity_joins_only_the_newest(spark):
    m = model(spark, SF_SMALL)
    p = plan(reports.recent_activity(m.sessions, m.vehicles, m.spots, m.zones, AS_OF))
    assert "Join" not in p and "events.parquet" not in p   # what is left to do is to read the written rows


def test_documents_both_ways(spark):
    docs = model(spark, SF_SMALL).spot_documents.unionByName(spark.createDataFrame(
        [(-1, None), (-2, "not json"), (-3, "{}"), (-4, '{"id": 5, "booking": {}}'),
         (-5, '{"id": 5, "booking": {"sessionId": 9007199254740993, "extensions": [{"addedHours": 2}, {}]}}')], "doc_id long, doc string"))
    flat = documents.booking_json_flatten(docs)
    again = documents.booking_json_flatten(documents.booking_documents(flat))
    key = lambda r: str((r.doc_id, r.ext_pos))
    assert sorted(flat.collect(), key=key) == sorted(again.collect(), key=key)
    rows = {(r.doc_id, r.ext_pos): r for r in flat.filter("doc_id < 0").collect()}
    assert set(rows) == {(-1, None), (-2, None), (-3, None), (-4, None), (-5, 0), (-5, 1)}
    assert rows[-2, None].corrupt == "not json" and rows[-2, None].has_booking is None
    assert (rows[-3, None].has_booking, rows[-4, None].has_booking, rows[-1, None].has_booking) == (False, True, None)
    assert rows[-5, 0].session_id == 9007199254740993 and rows[-5, 0].added_hours == 2 and rows[-5, 1].added_hours is None
    assert flat.filter("corrupt is not null and doc_id >= 0").count() == docs.filter("doc_id >= 0 and doc_id % 50 = 49").count() > 0
    assert flat.filter(F.col("booked_by_user_id").isNotNull() & F.col("zone_name").isNotNull() & F.col("vehicle_type").isNotNull()).count() > 100
