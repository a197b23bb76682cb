"""Periodic runs of words: recursive frequency splitting, then a lag scan.

In a run whose length is at least ``powers`` periods every word occurs at
least ``powers`` times.  So a word that occurs fewer times within its segment
(at first the text) lies in no run of that segment and splits it; what is left
is split again until nothing changes.  In ordinary prose little survives.

Surviving segments are scanned for lags.  At scale k = 1, 2, 4, ... the scan
looks at lags above k / 2 up to k: windows of k words get the same number if
they are equal, and a window's lag is the distance to its next equal window.
In a run of smallest period q (at that scale) this is exactly q for every
window that has a copy one period on, because a word of q letters that is no
power of a shorter one occurs in its own square only at both ends.  So each run
is one stretch of windows with equal lag, and each stretch that is long enough is
a run: n log n steps a scale also for a text that is one long run.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are taken together up to this many bytes.
SLICE_BYTES = 4_000_000

_RUN = "struct<start:long,length:long,period:long>"
_RUN_TYPE = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def split_by_frequency(words: np.ndarray, segment: np.ndarray, powers: int, least: int) -> np.ndarray:
    """Positions of the words that survive; ``segment`` numbers ascend from 0 along the input.

    A round drops words with fewer than ``powers`` occurrences in their segment and
    segments shorter than ``least``; segments that lose nothing are set aside."""
    at, kinds = np.arange(len(words)), int(words.max(initial=0)) + 1
    done: list[np.ndarray] = []
    while len(at):
        _, inverse, counts = np.unique(segment * kinds + words[at], return_inverse=True, return_counts=True)
        sizes = np.bincount(segment)
        keep = (counts[inverse] >= powers) & (sizes[segment] >= least)
        whole = np.bincount(segment[~keep], minlength=len(sizes))[segment] == 0
        done.append(at[whole])
        left = keep & ~whole
        at, segment = at[left], segment[left]
        # what was dropped, and what was set aside, lies between the new segments
        segment = np.cumsum(np.r_[True, (np.diff(at) > 1) | (np.diff(segment) > 0)][:len(at)]) - 1
        if not len(done[-1]):
            done.pop()
    return np.sort(np.concatenate(done)) if done else at


def lag_scan(words: np.ndarray, segment: np.ndarray, powers: int, least: int) -> np.ndarray:
    """Rows ``(first position, length, period)`` of all runs of the segments, which lie one after another."""
    n = len(words)
    if not n:
        return np.empty((0, 3), np.int64)
    sizes = np.bincount(segment)
    ends = np.cumsum(sizes)[segment]
    # windows of one word, told apart by segment too
    ids = np.unique(segment * (int(words.max()) + 1) + words, return_inverse=True)[1].astype(np.int64)
    at, k, found = np.arange(n), 1, []
    while len(at):
        order = np.argsort(ids[at], kind="stable")
        same = np.diff(ids[at][order]) == 0
        lag = np.zeros(n + 1, np.int64)
        here = at[order]
        lag[here[:-1][same]] = (here[1:] - here[:-1])[same]
        lag[(lag <= k // 2) | (lag > k)] = 0
        edge = np.flatnonzero(np.diff(lag, prepend=0))   # a stretch begins, ends or changes its lag
        lags, stretch = lag[edge], np.diff(edge, append=n + 1)
        length = stretch - 1 + k + lags
        good = (lags > 0) & (length >= np.maximum(least, powers * lags))
        found.append(np.stack([edge[good], length[good], lags[good]], axis=1))
        # windows of twice as many words, in segments that can hold the next scale's shortest run
        room = (at + 2 * k <= ends[at]) & (sizes[segment[at]] >= powers * (k + 1))
        at = at[room]
        pairs = np.unique(ids[at] * (int(ids.max()) + 1) + ids[at + k], return_inverse=True)[1]
        ids = np.zeros(n, np.int64)
        ids[at] = pairs
        k *= 2
    return np.concatenate(found)


def runs_of(texts: list[list[bytes]], powers: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Runs ``(start, length, period)`` of each text, by start, then period."""
    numbers: dict[bytes, int] = {}
    fresh = count()
    words = np.array([numbers[w] if w in numbers else numbers.setdefault(w, next(fresh)) for t in texts for w in t], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    at = split_by_frequency(words, text, powers, least)
    segment = np.cumsum(np.r_[True, (np.diff(at) > 1) | (np.diff(text[at]) > 0)][:len(at)]) - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    first = np.cumsum(sizes) - sizes
    for place, length, period in lag_scan(words[at], segment, powers, least).tolist():
        start = int(at[place])
        out[text[start]].append((start - int(first[text[start]]), length, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text without what any run repeats after its first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(kept))


def _find(powers: int, least: int):
    def flush(batch: pa.RecordBatch, rows: list[int], texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts, powers, least)
        as_row = lambda r: dict(zip(("start", "length", "period"), r))
        best = [max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None for runs in found]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows)), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([[as_row(r) for r in runs] for runs in found], pa.list_(_RUN_TYPE)),
             pa.array([r and as_row(r) for r in best], _RUN_TYPE),
             pa.array([collapse(t, runs) for t, runs in zip(texts, found)], pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, held = [], [], 0
            for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
                raw = text.as_py() or b""
                rows.append(i)
                texts.append(raw.split())   # bytes split at the six ASCII white-space characters only
                held += len(raw)
                if held > SLICE_BYTES:
                    yield flush(batch, rows, texts)
                    rows, texts, held = [], [], 0
            if rows:
                yield flush(batch, rows, texts)
    return run


def find_runs(df: DataFrame, powers: int = 4, least: int = 6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_words, runs, strongest, collapsed``.

    A run is a stretch of consecutive words with smallest period q, at least
    ``least`` words and ``powers`` periods long, that no neighbour extends with that
    period.  ``runs`` holds all of them as ``(start, length, period)`` by start,
    then period; ``strongest`` the one with most periods (ties: smallest start,
    then period; null without a run); ``collapsed`` the text's words, joined by one
    space, without those that a run repeats after its first period.  ``powers`` is
    at least 3.  Null and empty texts have no words and no runs; null and
    repeated ids are ordinary rows; empty table: no rows; other columns are
    ignored, whatever their names."""
    if powers < 3:
        raise ValueError("the lag scan needs runs of three periods or more")
    light = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {light.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<{_RUN}>, strongest {_RUN}, collapsed string"
    return light.mapInArrow(_find(powers, least), schema)
