"""Bulk check-out billing and open-session cost estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.billing import MODES, bill, open_cost_estimates
from ..sources.fixtures import as_of_lit


def _with_rate(sessions: DataFrame, spots: DataFrame) -> DataFrame:
    s = spots.select(F.col("id").alias("_sid"), F.col("hourly_rate"))
    return sessions.join(s, F.col("spot_id") == F.col("_sid"), "left")


def session_billing(sessions: DataFrame, spots: DataFrame, modes=MODES) -> DataFrame:
    """Bill every closed session in each mode (minutes, hours, amount per
    mode); the new payment status is ``pending``.  Pure column expressions
    over one dimension join, no shuffle of the session table."""
    j = _with_rate(sessions.filter(F.col("exit_time").isNotNull()), spots)
    cols = [F.col("id").alias("session_id"), "spot_id", "entry_time", "exit_time",
            F.col("hourly_rate").cast("double").alias("hourly_rate")]
    for m in modes:
        b = bill("entry_time", "exit_time", "hourly_rate", m)
        cols += [b["minutes"].alias(f"{m}_minutes"), b["hours"].alias(f"{m}_hours"), b["amount"].alias(f"{m}_amount")]
    cols.append(F.lit("pending").alias("payment_status"))
    return j.select(*cols)


def active_cost_estimate(sessions: DataFrame, spots: DataFrame, as_of: str) -> DataFrame:
    """Cost of every session open at ``as_of`` in the three displayed forms."""
    now = as_of_lit(as_of)
    j = _with_rate(sessions.filter(F.col("exit_time").isNull() & (F.col("entry_time") <= now)), spots)
    est = open_cost_estimates("entry_time", now, "hourly_rate", "booked_hours")
    return j.select(F.col("id").alias("session_id"), "spot_id", "entry_time", "booked_hours",
                    *[c.alias(k) for k, c in est.items()])
