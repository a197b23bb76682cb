"""Stream forms against their batch forms."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from settings import SF_SMALL

Q = entry.queries()


def test_stream_pairing_equals_batch_pairing(spark):
    s = Q["stream_session_pairing"](spark, SF_SMALL).select("event_id", "accepted", "reason")
    b = Q["session_pairing"](spark, SF_SMALL).select("event_id", "accepted", "reason")
    assert s.count() == b.count()
    assert s.exceptAll(b).count() == 0


def test_stream_hourly_entries_sum_to_peak_hours(spark):
    hourly = Q["stream_hourly_entries"](spark, SF_SMALL)
    total = hourly.agg(F.sum("entry_count")).collect()[0][0]
    assert total == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    # peak hours looks back 30 days from 2024-02-09 12:00, i.e. from 2024-01-10 12:00
    s = (hourly.filter(F.col("hour_start") >= F.lit("2024-01-10 12:00:00").cast("timestamp_ntz"))
         .groupBy(F.hour("hour_start").alias("hour")).agg(F.sum("entry_count").alias("n")))
    peak = Q["peak_hours"](spark, SF_SMALL).select("hour", "entry_count").collect()
    by_hour = {r["hour"]: r["n"] for r in s.collect()}
    assert peak and all(by_hour[r["hour"]] == r["entry_count"] for r in peak)


def test_booking_stream_equals_the_batch_cycle(spark):
    from parkops.operators.cycle import booking_cycle
    from parkops.sources.fixtures import model
    m = model(spark, SF_SMALL)
    batch = booking_cycle(m.lot_events("vehicle"), m.spots).filter(~F.col("kind").isin("invalid", "spot_not_found"))
    stream = Q["stream_booking_decisions"](spark, SF_SMALL)
    cols = ["spot_id", "event_id", "kind"]
    assert stream.count() == batch.count() > 0
    assert stream.select(*cols).exceptAll(batch.select(*cols)).count() == 0


def test_spot_state_equals_the_batch_sweep(spark):
    cols = ["booking_id", "booking_end_time", "expired", "is_occupied", "is_reserved"]
    state = Q["stream_spot_state"](spark, SF_SMALL).select(F.col("spot_id").alias("id"), *cols)
    swept = Q["expire_bookings"](spark, SF_SMALL).select("id", *cols)
    assert state.exceptAll(swept).count() == 0
    assert state.count() == swept.join(state, "id", "left_semi").count() > 100
    assert state.filter("expired").count() > 10


def test_live_jobs_run_on_a_processing_time_trigger(spark):
    import datetime
    import os
    import tempfile

    from parkops.streaming.live import read_live, start_live_jobs
    base = tempfile.mkdtemp(prefix="live-")
    schema = "ts timestamp_ntz"
    spark.createDataFrame([], schema).write.parquet(f"{base}/ticks")
    ticks = spark.readStream.schema(schema).parquet(f"{base}/ticks")
    qs = start_live_jobs(spark, SF_SMALL, f"{base}/out", f"{base}/ckpt", trigger="1 second", ticks=ticks)
    try:
        for q in qs.values():
            q.processAllAvailable()
        # the clock goes on, as of AS_OF and the lateness
        spark.createDataFrame([(datetime.datetime(2024, 1, 31, 0, 59, 59),)], schema).write.mode("append").parquet(f"{base}/ticks")
        for q in qs.values():
            q.processAllAvailable()
    finally:
        for q in qs.values():
            q.stop()
    assert sorted(os.listdir(f"{base}/out")) == sorted(qs)
    assert read_live(spark, f"{base}/out", "hourly_entries").agg(F.sum("entry_count")).collect()[0][0] == \
        spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    state, full = read_live(spark, f"{base}/out", "spot_state"), Q["stream_spot_state"](spark, SF_SMALL)
    assert state.count() == full.count() > 0
    assert state.select(*full.columns).exceptAll(full).count() == 0
    pairing = read_live(spark, f"{base}/out", "session_pairing")
    assert pairing.count() == Q["session_pairing"](spark, SF_SMALL).count()
    # the folder of the table before stays, older ones go
    assert 1 <= sum(f.startswith("version-") for f in os.listdir(f"{base}/out/spot_state")) <= 2


def test_a_table_is_switched_as_a_whole(spark, tmp_path):
    from parkops.streaming.live import current_folder, read_live, switch_table
    table = str(tmp_path / "t")
    for n in (5, 7, 9):
        before = current_folder(spark, table)
        reader = read_live(spark, str(tmp_path), "t") if before else None
        switch_table(spark, table, spark.range(n))
        assert read_live(spark, str(tmp_path), "t").count() == n
        assert reader is None or reader.count() == n - 2   # who reads the table before still can


LOG = "event_id long, vehicle_id long, spot_id long, action string, ts timestamp_ntz, hours int"


def arrivals(spark, rows, batches):
    """A stream of ``rows`` in ``batches`` files of one micro-batch each, in the given order."""
    import tempfile
    base = tempfile.mkdtemp(prefix="arrivals-")
    size = -(-len(rows) // batches)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i:i + size], LOG).coalesce(1).write.mode("append").parquet(f"{base}/log")
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{base}/log")


def random_log(seed, n=300, keys=6):
    import random
    from datetime import datetime, timedelta
    rng, t = random.Random(seed), datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        t += timedelta(seconds=rng.choice((0, 0, 1, 300, 1800)))   # ties too
        rows.append((i, rng.randrange(keys), rng.randrange(keys), rng.choice(("check_in", "check_in", "check_out", "extend")), t, rng.randrange(1, 4)))
    # each event comes less than an hour late
    return rows, sorted(rows, key=lambda r: (r[4] + timedelta(minutes=rng.uniform(0, 59)), r[0]))


def test_order_of_arrival_does_not_matter(spark):
    """Less than an hour late, cut into any micro-batches: pairing, bookings and spots equal the batch."""
    from datetime import datetime

    from parkops.operators import bookings as bk, lifecycle
    from parkops.operators.cycle import booking_cycle, expiries
    from parkops.schemas import PARKING_SPOTS
    from parkops.streaming import jobs as sj
    from parkops.streaming.runner import run_to_end
    rows, late = random_log(3)
    assert [r[0] for r in late] != [r[0] for r in rows]
    until = rows[-1][4].replace(microsecond=0)
    until = datetime.fromtimestamp(until.timestamp() + 5400)   # some bookings end after the last event
    spots = spark.createDataFrame([(i, f"S-{i}", 1, "regular", i % 2 == 0, i % 3 == 0, None) for i in range(5)], PARKING_SPOTS)
    log = spark.createDataFrame(rows, LOG)
    want = lifecycle.session_pairing(log).select("event_id", "accepted", "reason")
    closed = lifecycle.session_pairing(log).filter("exit_event_id is not null").select(F.col("exit_event_id").alias("event_id"), F.col("event_id").alias("entry_event_id"))
    cycle = booking_cycle(log, spots)
    decided = cycle.filter("kind not in ('invalid', 'spot_not_found')").select("spot_id", "event_id", "kind")
    ended = expiries(cycle, F.lit(until).cast("timestamp_ntz")).select("spot_id", F.col("booking_id").alias("event_id"), F.lit("expired").alias("kind"))
    swept = bk.expire_bookings(spots, bk.spot_bookings(cycle, str(until)), str(until))
    for batches in (1, 5):
        stream = arrivals(spark, late, batches)
        got = run_to_end(spark, lambda t: sj.session_pairing_stream(stream, t), "p", until)
        assert sorted(map(str, got.select("event_id", "accepted", "reason").collect())) == sorted(map(str, want.collect()))
        assert sorted(got.filter("accepted and action = 'check_out'").select("event_id", "entry_event_id").collect()) == sorted(closed.collect())
        got = run_to_end(spark, lambda t: sj.booking_expiry_stream(stream, spots, t), "b", until).select("spot_id", "event_id", "kind")
        assert sorted(got.collect()) == sorted(decided.unionByName(ended).collect())
        states = run_to_end(spark, lambda t: sj.spot_state(stream, spots, t), "s", until, "update", ["spot_id"])
        cols = ["booking_id", "booking_end_time", "expired", "is_occupied", "is_reserved"]
        got = sj.spot_state_out(states, spots).select(F.col("spot_id").alias("id"), *cols)
        assert sorted(map(str, got.collect())) == sorted(map(str, swept.select("id", *cols).collect()))


def test_late_events_are_told_and_change_nothing(spark):
    from datetime import datetime

    from parkops.streaming import jobs as sj
    from parkops.streaming.runner import run_to_end
    day = lambda h, m=0: datetime(2024, 1, 1, h, m)
    rows = [(1, 1, 1, "check_in", day(8), 1), (2, 2, 2, "check_in", day(12), 1), (3, 1, 1, "check_out", day(10, 30), 1),
            (4, 1, 1, "check_out", day(8, 30), 1),      # later than Spark's watermark: dropped and counted there
            (5, 1, 1, "check_out", day(12, 30), 1), (6, None, 1, "check_in", day(12, 40), 1), (7, 1, None, "check_in", day(12, 50), 1)]
    stream = arrivals(spark, rows, len(rows))
    got = {r.event_id: r for r in run_to_end(spark, lambda t: sj.session_pairing_stream(stream, t), "late", day(14)).collect()}
    assert sorted(got) == [1, 2, 3, 5, 6, 7]
    assert (got[3].accepted, got[3].reason) == (False, "late_event")
    assert (got[6].accepted, got[6].reason) == (False, "invalid_event")
    assert got[5].accepted and got[5].entry_event_id == 1 and got[7].accepted and got[7].spot_id is None
    spots = spark.createDataFrame([(1,), (2,)], "id long")
    got = run_to_end(spark, lambda t: sj.booking_expiry_stream(stream, spots, t), "late2", day(14)).collect()
    assert ("late", 3) in {(r.kind, r.event_id) for r in got} and ("booked", 1) in {(r.kind, r.event_id) for r in got}


def test_large_ids_survive_the_pairing_stream(spark):
    import datetime
    import tempfile

    from parkops.streaming import jobs as sj
    from parkops.streaming.runner import run_to_end
    base = tempfile.mkdtemp(prefix="ids-")
    big = 9007199254740993
    t = datetime.datetime(2024, 1, 1)
    schema = "event_id long, vehicle_id long, spot_id long, action string, ts timestamp_ntz"
    spark.createDataFrame([(big, 1, 1, "check_in", t), (big + 2, 1, 1, "check_out", t + datetime.timedelta(hours=1))],
                          schema).write.parquet(f"{base}/log")
    log = spark.readStream.schema(schema).parquet(f"{base}/log")
    out = {r["event_id"]: r["entry_event_id"] for r in run_to_end(
        spark, lambda ticks: sj.session_pairing_stream(log, ticks), "ids", t + datetime.timedelta(hours=1)).collect()}
    assert out == {big: None, big + 2: big}


def test_keys_share_the_state_of_their_group(spark, monkeypatch):
    """Spark keeps a state for each group of keys, not for each key; keys don't mix, also beside an event without an id."""
    import tempfile
    from datetime import datetime, timedelta

    from parkops.operators import lifecycle
    from parkops.streaming import jobs as sj, ordered
    from parkops.streaming.runner import run_to_end
    monkeypatch.setattr(ordered, "GROUPS", 8, raising=False)
    big, t = 2**53, datetime(2024, 1, 1)
    rows = [(big + i, i % 60, i % 7 or None, ("check_in", "check_out", "check_in")[i % 7 % 3], t + timedelta(minutes=i), 1) for i in range(600)]
    log = spark.createDataFrame(rows, LOG)
    stream = arrivals(spark, [*rows, (None, 61, 1, "check_in", t + timedelta(minutes=600), 1)], 2)
    got = run_to_end(spark, lambda ticks: sj.session_pairing_stream(stream, ticks), "shared", t + timedelta(minutes=601))
    ours = ("event_id", "spot_id", "accepted", "reason")
    want = lifecycle.session_pairing(log).select(*ours).collect()
    assert sorted(map(str, got.filter("vehicle_id < 61").select(*ours).collect())) == sorted(map(str, want))
    assert [(r.event_id, r.accepted) for r in got.filter("vehicle_id = 61").collect()] == [(None, True)]
    query = (sj.session_pairing_stream(stream).writeStream.foreachBatch(lambda batch, _: batch.count())
             .option("checkpointLocation", tempfile.mkdtemp(prefix="shared-")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert 0 < max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators) <= 8
