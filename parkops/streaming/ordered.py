"""Keyed streams decided in event-time order, whatever their order of arrival.

The state of a key holds the events that are not decided yet, in order, and a
few scalars (the carry).  Keys are dealt to ``GROUPS`` groups, which are what Spark
calls for and keeps as one state each: a call costs milliseconds, as much as
hundreds of events.  An event is decided once the horizon has reached it:
one hour behind the newest event of the whole stream.  So every event that
comes less than an hour late is decided in its place, and what the stream
gives doesn't depend on how the log is cut into micro-batches.

Spark's own watermark stays another hour behind.  An event that the horizon has
passed when it comes (one to two hours late) is given out as late and changes
nothing; what is later still is dropped by Spark and counted in the query's
progress (``numRowsDroppedByWatermark``).

A timer wakes a group when the horizon reaches the next event of a key or what else
it waits for (a booking's end), also if nothing new comes for the key.  Ticks, rows with
nothing but a time, move the horizon when no event does: the end of a bounded
log, or a clock in a live run.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR_US = 3_600_000_000
#: How late an event may come and still be decided in its place.
LATENESS_US = HOUR_US
#: Spark's watermark: the lateness and an hour in which late events are still told.
WATERMARK = "2 hours"
_SLACK_US = 2 * HOUR_US - LATENESS_US
#: Groups of keys; fixed for the life of a checkpoint.
GROUPS = 1024

Rows = list[tuple]


def us_time(us: int | None) -> pd.Timestamp | None:
    return None if us is None else pd.Timestamp(us * 1000)


@dataclass(frozen=True)
class InOrder:
    """What an operator does with the events of one key.

    ``payload`` and ``carry`` name the events' further columns and the state's scalars
    with their types, ``start`` is the carry of a new key.  ``step(key, carry, event)`` decides
    one event ``(us, event_id, *payload)`` and gives the carry and output rows; ``late(key, event)``
    gives the rows of a late one; ``elapse(key, carry, horizon)`` does what time alone
    brings about, ``wakes(carry)`` is when that will be; ``report(key, carry)`` gives the rows
    that tell a carry that has changed."""

    payload: dict[str, str]
    carry: dict[str, str]
    start: tuple
    output: str
    step: Callable[[Any, tuple, tuple], tuple[tuple, Rows]]
    late: Callable[[Any, tuple], Rows] = lambda key, event: []
    elapse: Callable[[Any, tuple, int], tuple[tuple, Rows]] | None = None
    wakes: Callable[[tuple], int | None] | None = None
    report: Callable[[Any, tuple], Rows] | None = None

    def state(self, key: str) -> str:
        """The state of a group: its keys (of type ``key``), how many events each holds, their carries, and the held events in order of the keys."""
        held = {"us": "long", "event_id": "long"} | self.payload
        return ", ".join([f"key array<{key}>", "n_held array<int>", *(f"{c} array<{t}>" for c, t in self.carry.items()),
                          *(f"held_{c} array<{t}>" for c, t in held.items())])

    def run(self, group: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if group[0] is None:   # ticks; events without a key never come here
            return
        held, carries = self._load(state)
        rows, fresh = [], set()
        horizon = state.getCurrentWatermarkMs() * 1000 + _SLACK_US
        if not state.hasTimedOut:
            for pdf in pdfs:
                ids = [i if known else None for i, known in zip(pdf["event_id"].tolist(), pdf["known"].tolist())]
                for key, *event in zip(pdf["key"].tolist(), pdf["us"].tolist(), ids, *(pdf[c].tolist() for c in self.payload)):
                    if event[0] <= horizon:
                        rows += self.late(key, tuple(event))
                    else:
                        held.setdefault(key, []).append(tuple(event))
                        fresh.add(key)
        for key in fresh:
            held[key].sort(key=_place)
        for key in {**carries, **held}:
            rows += self._decide(key, held, carries, horizon)
        self._keep(state, held, carries)
        if rows:
            names = [c.split()[0] for c in self.output.split(",")]
            yield pd.DataFrame(rows, columns=names, dtype=object)   # objects: ids may exceed 2^53

    def _load(self, state: GroupState) -> tuple[dict[Any, list[tuple]], dict[Any, tuple]]:
        """Undecided events and carry by key."""
        if not state.exists:
            return {}, {}
        keys, counts, *columns = state.get
        carries = dict(zip(keys, zip(*columns[:len(self.carry)])))
        events = zip(*columns[len(self.carry):])
        return {k: list(islice(events, n)) for k, n in zip(keys, counts) if n}, carries

    def _decide(self, key: Any, held: dict[Any, list[tuple]], carries: dict[Any, tuple], horizon: int) -> Rows:
        """Decide the key's events that the horizon has reached; what is left stays in ``held`` and ``carries``."""
        before = carry = carries.get(key, self.start)
        events = held.pop(key, [])
        ready, rows = bisect_right(events, horizon, key=lambda e: e[0]), []
        for event in events[:ready]:
            carry, out = self.step(key, carry, event)
            rows += out
        if self.elapse:
            carry, out = self.elapse(key, carry, horizon)
            rows += out
        if events[ready:]:
            held[key] = events[ready:]
        carries[key] = carry
        if self.report and carry != before:
            rows += self.report(key, carry)
        return rows

    def _keep(self, state: GroupState, held: dict[Any, list[tuple]], carries: dict[Any, tuple]) -> None:
        keys = [k for k, carry in carries.items() if k in held or carry != self.start]
        if not keys:
            if state.exists:
                state.remove()
            return
        width = 2 + len(self.payload)
        events = [e for k in keys for e in held.get(k, ())]
        columns = [list(c) for c in zip(*events)] if events else [[] for _ in range(width)]
        state.update((keys, [len(held.get(k, ())) for k in keys], *(list(c) for c in zip(*(carries[k] for k in keys))), *columns))
        # a timer fires when the watermark is beyond it; nothing that is due by now is left
        due = [-(-(events[0][0] - _SLACK_US) // 1000) - 1 for events in held.values()]
        if self.wakes:
            due += [(at - _SLACK_US) // 1000 for k in keys if (at := self.wakes(carries[k])) is not None]
        if due:
            state.setTimeoutTimestamp(max(min(due), state.getCurrentWatermarkMs(), 1))


def _place(event: tuple) -> tuple:
    """Order of events: time, then id, null first."""
    return event[0], event[1] is not None, event[1]


def decide(events: DataFrame, key: str, rule: InOrder, ticks: DataFrame | None = None, mode: str = "append") -> DataFrame:
    """``events`` (``event_id``, ``ts``, the key and the payload) decided by ``rule``.

    ``ticks`` is a stream with one column ``ts``; events have a key and a time."""
    rows = events.select("event_id", "ts", F.col(key).alias("key"), *rule.payload)
    if ticks is not None:
        rows = rows.unionByName(ticks.select("ts"), allowMissingColumns=True)
    # pandas would make floats of whole numbers beside a null
    timed = (rows.withColumn("et", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("et")).drop("ts")
             .withColumn("known", F.col("event_id").isNotNull()).withColumn("event_id", F.coalesce("event_id", F.lit(0).cast("long")))
             .withColumn("group", F.when(F.col("key").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(GROUPS)))).withWatermark("et", WATERMARK))
    kind = events.schema[key].dataType.simpleString()
    return timed.groupBy("group").applyInPandasWithState(rule.run, rule.output, rule.state(kind), mode, GroupStateTimeout.EventTimeTimeout)
