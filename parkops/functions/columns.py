"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_minutes(start: Column | str, end: Column | str) -> Column:
    """Whole minutes from ``start`` to ``end`` (truncates: 59 s -> 0)."""
    return F.timestamp_diff("MINUTE", col(start), col(end))


def js_or(x: Column | str, default) -> Column:
    """``x || default`` of JavaScript for numbers: 0 and NULL both fall back."""
    x = col(x)
    return F.when(x.isNull() | (x == 0), F.lit(default)).otherwise(x)


def pct(part: Column, whole: Column, scale: int = 2) -> Column:
    """``ROUND(part * 100.0 / whole, scale)``; NULL when ``whole`` is 0."""
    return F.round(F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double")), scale)


def pct_int(part: Column, whole: Column) -> Column:
    """``Math.round(part / whole * 100)``, 0 when there is nothing to divide."""
    return F.coalesce(F.round(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), 0), F.lit(0.0)) \
        .cast("bigint")


def hhmmss(total_ms: Column) -> Column:
    """``hh:mm:ss`` from milliseconds; hours are padded to two digits but
    never cut (100 h stays ``100``)."""
    secs = F.floor(total_ms / 1000)
    h = F.floor(secs / 3600)
    m = F.floor((secs % 3600) / 60)
    s = secs % 60

    def pad2(x: Column) -> Column:
        t = x.cast("bigint").cast("string")
        return F.when(F.length(t) < 2, F.lpad(t, 2, "0")).otherwise(t)

    return F.concat_ws(":", pad2(h), pad2(m), pad2(s))
