"""Billing expressions: the three check-out formulas side by side.

``server``  : minutes = floor(elapsed), hours = ceil(minutes / 60), amount = hours x rate
``client``  : minutes = max(1, floor(elapsed)), hours = ceil(minutes / 60), amount = hours x (rate or 5)
``display`` : hours = max(1, ceil(elapsed in hours)), amount = hours x (rate or 5)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CLIENT_FALLBACK_RATE
from .columns import col, js_or

MODES = ("server", "client", "display")
_US_PER_MIN = 60_000_000
_US_PER_HOUR = 3_600_000_000


def elapsed_us(start: Column | str, end: Column | str) -> Column:
    return F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))


def bill(start: Column | str, end: Column | str, rate: Column | str, mode: str = "server") -> dict[str, Column]:
    """Return ``{minutes, hours, amount}`` columns for one billing mode."""
    us = elapsed_us(start, end)
    rate = col(rate)
    floor_min = F.floor(us / F.lit(_US_PER_MIN))
    if mode == "server":
        minutes = floor_min
        hours = F.ceil(minutes / F.lit(60))
        amount = hours * rate
    elif mode == "client":
        minutes = F.greatest(F.lit(1), floor_min)
        hours = F.ceil(minutes / F.lit(60))
        amount = hours * js_or(rate, CLIENT_FALLBACK_RATE)
    elif mode == "display":
        minutes = floor_min
        hours = F.greatest(F.lit(1), F.ceil(us / F.lit(_US_PER_HOUR)))
        amount = hours * js_or(rate, CLIENT_FALLBACK_RATE)
    else:
        raise ValueError(f"unknown billing mode {mode!r}")
    return {"minutes": minutes.cast("bigint"), "hours": hours.cast("bigint"),
            "amount": amount.cast("double")}


def open_cost_estimates(entry: Column | str, now: Column, rate: Column | str, booked_hours: Column | str,
                        flat_rate: float = 5.0) -> dict[str, Column]:
    """Cost of a session still open at ``now``, in the three forms shown:
    fractional minutes at a flat rate, started hours at the spot rate, and
    booked hours at the spot rate (or the fallback)."""
    us = elapsed_us(entry, now)
    rate = col(rate)
    return {
        "flat_estimate": (us / F.lit(float(_US_PER_MIN)) / 60.0 * flat_rate).cast("double"),
        "started_hours_estimate": (F.ceil(us / F.lit(_US_PER_HOUR)) * rate).cast("double"),
        "booked_estimate": (js_or(rate, CLIENT_FALLBACK_RATE) * col(booked_hours)).cast("double"),
    }
