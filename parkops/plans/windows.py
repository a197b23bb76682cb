"""Ordered per-key look-ups that do not put a whole key into one task.

A plain ``Window.partitionBy(key)`` sorts every row of a key in one task; if
one vehicle or spot holds a third of the data, that task holds a third of
the data.  These helpers split each key into time buckets:

1. inside each (key, bucket) chunk an ordinary window answers the question
   for rows whose answer lies in the same chunk;
2. each chunk's edge value (last / first non-null, or total) is a
   map-side-combined aggregate, one row per chunk;
3. windows over those chunk rows carry the edges across chunks - inside an
   hour over its (at most 3,600) second chunks, then across the hours of a
   key (one row per hour);
4. the carried value is joined back on (key, bucket).

The result equals the plain window exactly; the buckets only decide how
finely a hot key is split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in names]


def _edge_agg(kind: str, value: Column, rank: Column) -> Column:
    """The chunk's edge: last / first non-null value in order, or the total."""
    if kind == "prev":
        return F.max_by(value, F.when(value.isNotNull(), rank))
    if kind == "next":
        return F.min_by(value, F.when(value.isNotNull(), rank))
    if kind == "cumsum":
        return F.sum(value)
    if kind == "prevmax":
        return F.max(value)
    raise ValueError(kind)


def _carry(kind: str, edge: Column, w: Window) -> Column:
    """Carry chunk edges along ``w``: from the earlier (prev, cumsum) or the
    later (next) chunks of the same partition."""
    if kind == "prev":
        return F.last(edge, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if kind == "next":
        return F.first(edge, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    if kind == "prevmax":
        return F.max(edge).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.sum(edge).over(w.rowsBetween(Window.unboundedPreceding, -1))


def _combine(kind: str, near: Column, far: Column) -> Column:
    if kind == "cumsum":
        return F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))
    if kind == "prevmax":
        return F.greatest(near, far)
    return F.coalesce(near, far)


def ordered_lookups(df: DataFrame, keys: Sequence[str], bucket: str | Sequence[str], order: Sequence[str],
                    specs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Add several per-key ordered look-ups in one pass.

    ``specs`` holds ``(kind, value, out)`` with kind ``prev`` (last non-null
    value strictly before the row), ``next`` (first non-null value strictly
    after it), ``prevmax`` (largest value strictly before the row) or
    ``cumsum`` (running sum including the row).  ``bucket`` is
    one column or a (coarse, fine) pair - e.g. the hour and the sub-bucket
    from :func:`adaptive_bucket` - each monotone in ``order``; keys and
    buckets must not be NULL.

    Plan: the rows are shuffled once on (key, buckets) into one window
    operator that answers inside each chunk.  Chunk edges are an aggregate
    of the same input that combines map-side.  With two bucket levels the
    edges are carried first inside each coarse bucket (at most the number of
    fine buckets per coarse one, e.g. 3,600 seconds per hour) and then
    across the coarse buckets of a key (one row per hour), so no window ever
    holds more than one chunk, one hour's chunks or one key's hours.  The
    carried values come back through equi-joins - broadcast when small,
    otherwise sort-merge joins that reuse the chunk partitioning.
    """
    keys = list(keys)
    buckets = [bucket] if isinstance(bucket, str) else list(bucket)
    chunk = [*keys, *buckets]
    ords = _cols(order)
    rank = F.struct(*ords)
    w = Window.partitionBy(*chunk).orderBy(*ords)
    inner: list[Column] = []
    for i, (kind, value, _) in enumerate(specs):
        v = F.col(value)
        if kind == "prev":
            inner.append(F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_in{i}"))
        elif kind == "next":
            inner.append(F.first(v, True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias(f"_in{i}"))
        elif kind == "prevmax":
            inner.append(F.max(v).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_in{i}"))
        elif kind == "cumsum":
            inner.append(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_in{i}"))
        else:
            raise ValueError(kind)
    win = df.select("*", *inner)
    edges = df.groupBy(*chunk).agg(*[_edge_agg(k, F.col(v), rank).alias(f"_edge{i}")
                                     for i, (k, v, _) in enumerate(specs)])
    if len(buckets) == 1:
        wk = Window.partitionBy(*keys).orderBy(buckets[0])
        summ = edges.select(*chunk, *[_carry(k, F.col(f"_edge{i}"), wk).alias(f"_c{i}")
                                      for i, (k, _, _) in enumerate(specs)])
    else:
        coarse, fine = buckets
        w1 = Window.partitionBy(*keys, coarse).orderBy(fine)
        near = edges.select(*chunk, *[_carry(k, F.col(f"_edge{i}"), w1).alias(f"_n{i}")
                                      for i, (k, _, _) in enumerate(specs)])
        coarse_edges = edges.groupBy(*keys, coarse).agg(
            *[_edge_agg(k, F.col(f"_edge{i}"), F.col(fine)).alias(f"_ce{i}") for i, (k, _, _) in enumerate(specs)])
        w2 = Window.partitionBy(*keys).orderBy(coarse)
        far = coarse_edges.select(*keys, coarse, *[_carry(k, F.col(f"_ce{i}"), w2).alias(f"_f{i}")
                                                   for i, (k, _, _) in enumerate(specs)])
        summ = near.join(far, [*keys, coarse], "left").select(
            *chunk, *[_combine(k, F.col(f"_n{i}"), F.col(f"_f{i}")).alias(f"_c{i}")
                      for i, (k, _, _) in enumerate(specs)])
    out = win.join(summ, chunk, "left")
    for i, (kind, _, name) in enumerate(specs):
        out = out.withColumn(name, _combine(kind, F.col(f"_in{i}"), F.col(f"_c{i}")))
    return out.drop(*[f"{p}{i}" for i in range(len(specs)) for p in ("_in", "_c")])


def carry_value(df: DataFrame, keys: Sequence[str], bucket: str | Sequence[str], order: Sequence[str],
                value: str, out: str, direction: str = "prev") -> DataFrame:
    """Add ``out``: within each key ordered by ``order``, the last non-null
    ``value`` strictly before the row (``prev``) or the first non-null one
    strictly after it (``next``)."""
    if direction not in ("prev", "next"):
        raise ValueError(direction)
    return ordered_lookups(df, keys, bucket, order, [(direction, value, out)])


def prefix_sum(df: DataFrame, keys: Sequence[str], bucket: str | Sequence[str], order: Sequence[str], value: str,
               out: str) -> DataFrame:
    """Add ``out``: running sum of ``value`` per key in ``order``, the row included."""
    return ordered_lookups(df, keys, bucket, order, [("cumsum", value, out)])




# A (key, hour) chunk with more rows than this is split into one-second
# chunks, so a burst of one key inside one hour does not land in one task.
HOT_CHUNK_ROWS = 1_000_000


def adaptive_bucket(df: DataFrame, keys: Sequence[str], ts: str, out: str = "_b", hour_out: str = "_h",
                    hot_rows: int | None = None) -> tuple[DataFrame, tuple[str, ...]]:
    """Add the bucket columns for :func:`ordered_lookups` and return them.

    ``hour_out`` is the hour of ``ts``.  Inside an hour that holds more than
    ``hot_rows`` rows of one key, ``out`` is the second of ``ts``, else the
    hour.  Both buckets are truncations of ``ts``, so they stay monotone in
    (ts, ...) order.  The plan is the same at every size; the table of hot
    hours (at most rows / ``hot_rows`` entries) is joined as the planner sees
    fit by its size.  Returns ``(df, buckets)``; pass ``buckets`` on."""
    keys = list(keys)
    hot_rows = HOT_CHUNK_ROWS if hot_rows is None else hot_rows
    with_hour = df.withColumn(hour_out, F.date_trunc("hour", F.col(ts)))
    hot = (with_hour.groupBy(*keys, hour_out).agg(F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") > hot_rows).select(*keys, hour_out, F.lit(True).alias("_hot")))
    j = with_hour.join(hot, [*keys, hour_out], "left")
    return (j.withColumn(out, F.when(F.col("_hot"), F.date_trunc("second", F.col(ts)))
                         .otherwise(F.col(hour_out))).drop("_hot"), (hour_out, out))
