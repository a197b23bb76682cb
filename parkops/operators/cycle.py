"""The booking life cycle of a spot: check-in, extend, check-out, expiry.

All actions on a spot are taken in (time, id) order, as the client does:

* a check-in books the spot if it has no booking or is strictly past the
  booking's end; otherwise it is rejected;
* an extension moves the end of the spot's booking, also of one that has run
  out; without a booking it is rejected;
* a check-out ends the booking and frees the spot;
* a booking whose end passes before the spot's next action has expired.

A long history is cut where its past can't matter: after a check-out, and
at a check-in later than every end that any earlier check-in could have
reached (a running maximum).  The pieces are walked independently, row by row
with a state of two numbers.

A piece with more than ``CHUNK_ROWS`` actions (check-ins that come faster than
bookings end) is cut into chunks of rows as well, which depend on each other only through
the booking that is held between them.  Each chunk first becomes a function
from the end of the booking that it is entered with to the one that it is left
with; then the functions are applied one after another, a look-up of one row a
piece and chunk; then all chunks are walked at once, each from its entry.  So no task holds
more than one chunk of a spot, whatever the spot's share of all actions.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from ..plans.windows import adaptive_bucket, ordered_lookups
from ..session import scratch_dir

_HOUR_US = 3_600_000_000
ACTIONS = ("check_in", "extend", "check_out")
#: Longer pieces are cut into chunks of this many rows, or of a 256th of their rows if that is more.
CHUNK_ROWS = 100_000
MOST_CHUNKS = 256
_OUT = ("event_id long, spot_id long, vehicle_id long, action string, ts timestamp_ntz, hours int, "
        "next_ts timestamp_ntz, kind string, booking_id long, end_us long")


def _us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def us_time(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decide rows that come by spot, piece, chunk and order; state: booking and its end.

    A chunk is entered with ``entry_booking`` (null: none), whose end at that time is ``entry_reach``
    plus the extensions so far (``shift``, which includes the row's own)."""
    at, booking, end = None, None, 0
    work = ("piece", "chunk", "us", "span", "shift", "entry_booking", "entry_reach")
    for batch in batches:
        kinds, bookings, ends = [], [], []
        steps = (batch.column(c).to_pylist() for c in ("spot_id", "event_id", "action", *work))
        for spot, event, action, piece, chunk, us, span, shift, entry, reach in zip(*steps):
            if at != (spot, piece, chunk):
                at, booking = (spot, piece, chunk), entry
                end = 0 if entry is None else reach + shift - (span if action == "extend" else 0)
            if action == "check_in":
                if booking is None or us > end:
                    booking, end, kind = event, us + span, "booked"
                else:
                    kind = "rejected"
            elif action == "extend":
                kind = "no_booking" if booking is None else "extended"
                end = end + span
            else:
                booking, kind = None, "checked_out"
            kinds.append(kind)
            bookings.append(booking)
            ends.append(None if booking is None else end)
        kept = [c for c in batch.schema.names if c not in work]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in kept], pa.array(kinds, pa.string()), pa.array(bookings, pa.int64()), pa.array(ends, pa.int64())],
            names=[*kept, "kind", "booking_id", "end_us"])


def chunk_function(rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """A chunk as a function, from its check-ins ``(time, reach, event)`` in order.

    Times and reaches are less all extensions so far, so that extensions don't move
    them.  Entered with reach r, the first check-in later than r is booked, and what
    follows depends on that one only.  Gives ``(time, exit reach, exit booking)`` of those
    that can be the first: later than all before them.  From the last to the first,
    a stack keeps the check-ins that can come next, nearest last and earliest last."""
    leaves: list[tuple[int, int]] = [(0, 0)] * len(rows)
    times: list[int] = []   # of the stack, negated: ascending for the search
    places: list[int] = []
    for i in range(len(rows) - 1, -1, -1):
        time, reach, event = rows[i]
        k = bisect_left(times, -reach)   # times[:k] are those later than the reach; the last of them comes first
        leaves[i] = leaves[places[k - 1]] if k else (reach, event)
        while times and -times[-1] <= time:
            times.pop()
            places.pop()
        times.append(-time)
        places.append(i)
    found, latest = [], None
    for (time, _, _), (reach, event) in zip(rows, leaves):
        if latest is None or time > latest:
            found.append((time, reach, event))
            latest = time
    return found


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk functions of check-ins that come by spot, piece, chunk and order; one chunk at a time is held."""
    names = ["spot_id", "piece", "chunk", "time", "exit_reach", "exit_booking"]

    def flush() -> pa.RecordBatch:
        out = [(*at, *r) for r in chunk_function(held)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 6)], names=names)

    at, held = None, []
    for batch in batches:
        for spot, piece, chunk, *row in zip(*(batch.column(c).to_pylist() for c in ("spot_id", "piece", "chunk", "time", "reach", "event_id"))):
            if at != (spot, piece, chunk):
                if held:
                    yield flush()
                at, held = (spot, piece, chunk), []
            held.append(tuple(row))
    if held:
        yield flush()


def _entries(long_rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """``spot_id, piece, chunk, entry_booking, entry_reach`` of all chunks but the first ones.

    ``pieces`` holds the pieces that are cut, with their number of ``chunks``.  Chunk functions are written by
    chunk number; the states after chunk c are then looked up in the functions of chunk c
    alone, for all pieces at once."""
    spark = long_rows.sparkSession
    ins = long_rows.filter(F.col("action") == "check_in").select(
        "spot_id", "piece", "chunk", (F.col("us") - F.col("shift")).alias("time"),
        (F.col("us") + F.col("span") - F.col("shift")).alias("reach"), "ts", "event_id")
    dealt = ins.repartition("spot_id", "piece", "chunk").sortWithinPartitions("spot_id", "piece", "chunk", "ts", "event_id").drop("ts")
    path = scratch_dir(spark, "chunk-functions")
    (dealt.mapInArrow(_functions, "spot_id long, piece long, chunk long, time long, exit_reach long, exit_booking long")
     .write.partitionBy("chunk").parquet(path))
    most = pieces.agg(F.max("chunks")).first()[0]
    functions = spark.read.schema("spot_id long, piece long, time long, exit_reach long, exit_booking long, chunk long").parquet(path)
    key = ["spot_id", "piece"]
    none = F.lit(None).cast("long")
    state = pieces.select(*key, "chunks", none.alias("entry_booking"), none.alias("entry_reach"))
    entries = None
    for c in range(most - 1):
        here = functions.filter(F.col("chunk") == c).join(state.select(*key, "entry_reach"), key)
        first = (here.filter(F.col("entry_reach").isNull() | (F.col("time") > F.col("entry_reach"))).groupBy(*key)
                 .agg(F.min_by(F.struct("exit_booking", "exit_reach"), "time").alias("_exit")))
        # without a later check-in the booking is held on
        state = state.filter(F.col("chunks") > c + 1).join(first, key, "left").select(
            *key, "chunks", F.coalesce("_exit.exit_booking", "entry_booking").alias("entry_booking"),
            F.coalesce("_exit.exit_reach", "entry_reach").alias("entry_reach"))
        state = materialize(state, "chunk-entries")
        found = state.select(*key, F.lit(c + 1).cast("long").alias("chunk"), "entry_booking", "entry_reach")
        entries = found if entries is None else entries.unionByName(found)
    return materialize(entries, "chunk-entries")


def booking_cycle(log: DataFrame, spots: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every check-in, extension and check-out with its decision (``kind``), the
    spot's booking and its end after it, and the time of the spot's next
    valid action (``next_ts``).

    Kinds: booked, rejected, extended, no_booking, checked_out, spot_not_found,
    invalid (no spot, no time, or a duration that is not positive).  The result
    is written once under the checkpoint folder."""
    rows = (log.filter(F.col("action").isin(*ACTIONS))
            .select("event_id", "spot_id", "vehicle_id", "action", "ts", F.col("hours").cast("int").alias("hours")))
    timed = F.col("ts").isNotNull() & F.col("spot_id").isNotNull()
    valid = timed & ((F.col("action") == "check_out") | F.coalesce(F.col("hours") > 0, F.lit(False)))
    ids = spots.select(F.col("id").alias("_sid")).distinct()
    placed = rows.join(ids, rows["spot_id"] == ids["_sid"], "left").withColumn(
        "_bad", F.when(~valid, "invalid").when(F.col("_sid").isNull(), "spot_not_found")).drop("_sid")
    none = F.lit(None)
    bad = placed.filter(F.col("_bad").isNotNull()).select(
        *rows.columns, none.cast("timestamp_ntz").alias("next_ts"), F.col("_bad").alias("kind"),
        none.cast("long").alias("booking_id"), none.cast("long").alias("end_us"))

    span = F.when(F.col("action") == "check_out", F.lit(0)).otherwise(F.col("hours")).cast("long") * _HOUR_US
    good = placed.filter(F.col("_bad").isNull()).drop("_bad").withColumns({"us": _us(F.col("ts")), "span": span})
    good, buckets = adaptive_bucket(good, ["spot_id"], "ts")
    order = ["ts", "event_id"]
    good = good.withColumn("_added", F.when(F.col("action") == "extend", F.col("span")).otherwise(0))
    good = ordered_lookups(good, ["spot_id"], buckets, order, [("cumsum", "_added", "_shift"), ("prev", "action", "_before"),
                                                               ("next", "ts", "next_ts")])
    good = materialize(good, "cycle")   # the next look-ups read it twice
    # times less all extensions so far: an end moves with the extensions that follow it
    is_in = F.col("action") == "check_in"
    good = good.withColumn("_reach", F.when(is_in, F.col("us") + F.col("span") - F.col("_shift")))
    good = materialize(ordered_lookups(good, ["spot_id"], buckets, order, [("prevmax", "_reach", "_most")]), "cycle")
    apart = is_in & F.coalesce(F.col("us") - F.col("_shift") > F.col("_most"), F.lit(True))
    cut = apart | F.coalesce(F.col("_before") == "check_out", F.lit(True))
    good = good.withColumns({"_cut": cut.cast("int"), "_one": F.lit(1)})
    good = ordered_lookups(good, ["spot_id"], buckets, order, [("cumsum", "_cut", "piece"), ("cumsum", "_one", "_n")])
    good = materialize(good.select(*rows.columns, "next_ts", "piece", "us", "span", F.col("_shift").alias("shift"), "_n"), "cycle")

    pieces = (good.groupBy("spot_id", "piece").agg(F.count(F.lit(1)).alias("_rows"), F.min("_n").alias("_first"))
              .filter(F.col("_rows") > chunk_rows).withColumn("_size", F.greatest(F.lit(chunk_rows), F.ceil(F.col("_rows") / MOST_CHUNKS)))
              .withColumn("chunks", F.ceil(F.col("_rows") / F.col("_size"))))
    pieces = materialize(pieces, "long-pieces")   # at most one a chunk_rows rows
    key = ["spot_id", "piece"]
    if pieces.isEmpty():
        good = good.withColumns({"chunk": F.lit(0).cast("long"), "entry_booking": none.cast("long"), "entry_reach": none.cast("long")})
    else:
        good = good.join(pieces.select(*key, "_first", "_size"), key, "left").withColumn(
            "chunk", F.coalesce(F.floor((F.col("_n") - F.col("_first")) / F.col("_size")), F.lit(0)).cast("long"))
        entries = _entries(good.filter(F.col("_size").isNotNull()), pieces)
        good = good.join(entries, [*key, "chunk"], "left")
    dealt = (good.select(*rows.columns, "next_ts", "piece", "chunk", "us", "span", "shift", "entry_booking", "entry_reach")
             .repartition("spot_id", "piece", "chunk").sortWithinPartitions("spot_id", "piece", "chunk", "ts", "event_id"))
    return materialize(dealt.mapInArrow(walk, _OUT).unionByName(bad), "booking-cycle")


def expiries(cycle: DataFrame, until: Column) -> DataFrame:
    """``spot_id, booking_id, end_time``: each time a booking's end passed before the
    spot's next action, or before ``until`` where there is none."""
    end = us_time(F.col("end_us"))
    held = cycle.filter(F.col("kind").isin("booked", "extended", "rejected"))
    return held.filter(F.coalesce(F.col("next_ts"), until) > end).select("spot_id", "booking_id", end.alias("end_time"))
