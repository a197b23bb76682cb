"""Spot dimension seeding: every zone crossed with slot numbers 1..N.

The slot list is ``spark.range`` of a fixed, small size, so crossing it with
the zones is a broadcast nested-loop join whose broadcast side has a proven
bound (N rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import global_row_number
from ..schemas import DEFAULT_HOURLY_RATE, EV_ZONE_RATE, SEED_SPOTS_PER_ZONE


def _grid(zones: DataFrame, per_zone: int) -> DataFrame:
    slots = zones.sparkSession.range(1, per_zone + 1).select(F.col("id").cast("int").alias("n"))
    return zones.select(F.col("id").alias("zone_id"), F.col("name").alias("zone_name")).crossJoin(F.broadcast(slots))


def seed_spot_grid(zones: DataFrame, ev_zone: str = "D", per_zone: int = SEED_SPOTS_PER_ZONE) -> DataFrame:
    """Server seed: ``<zone>-<nn>``; the EV zone is all electric at 7.00,
    elsewhere slots 1-2 are electric and the rest regular, at 5.00."""
    g = _grid(zones, per_zone)
    ev = F.col("zone_name") == ev_zone
    return g.select(
        F.concat(F.col("zone_name"), F.lit("-"), F.lpad(F.col("n").cast("string"), 2, "0")).alias("spot_number"),
        "zone_id", "n",
        F.when(ev, "electric").when(F.col("n") <= 2, "electric").otherwise("regular").alias("spot_type"),
        F.when(ev, F.lit(EV_ZONE_RATE)).otherwise(F.lit(DEFAULT_HOURLY_RATE)).cast("decimal(10,2)")
         .alias("hourly_rate"))


def seed_spot_grid_client(zones: DataFrame, ev_zone: str = "D", per_zone: int = SEED_SPOTS_PER_ZONE) -> DataFrame:
    """Client seed: the EV zone is all electric at 7; elsewhere slot 11 is a
    motorcycle bay and slot 12 electric, at 5.  Ids run 1, 2, ... over zones
    in id order, then slots."""
    g = _grid(zones, per_zone)
    ev = F.col("zone_name") == ev_zone
    g = g.select(
        F.concat(F.col("zone_name"), F.lit("-"), F.lpad(F.col("n").cast("string"), 2, "0")).alias("spot_number"),
        "zone_id", "zone_name", "n",
        F.when(ev, "electric").when(F.col("n") == 11, "motorcycle").when(F.col("n") == 12, "electric")
         .otherwise("regular").alias("spot_type"),
        F.when(ev, F.lit(7)).otherwise(F.lit(5)).cast("int").alias("hourly_rate"),
        F.lit(False).alias("is_occupied"), F.lit(False).alias("is_reserved"))
    return global_row_number(g, ["zone_id", "n"], "id")
