"""Dense sequential numbering without a single-partition window.

``Window.orderBy(...)`` with no partition moves every row into one task.
Instead: range-partition on the order, number rows inside each partition,
and add the row counts of all earlier partitions (a table with one row per
partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .materialize import materialize


def global_row_number(df: DataFrame, order: Sequence[str], out: str = "row_number",
                      partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1, 2, ... following ``order`` (which must be unique)."""
    order = list(order)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the range bounds come from a sample that differs from one evaluation to
    # the next, so the partition number is written down once and both the
    # per-partition numbering and the partition sizes read that copy
    parted = materialize(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()),
                         "row-number")
    local = parted.withColumn("_local", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    sizes = parted.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_pid", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_local"))
            .drop("_pid", "_local", "_off"))
