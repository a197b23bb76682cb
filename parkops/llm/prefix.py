"""Global prefix sums from per-partition totals.

Rows are range-partitioned on a total order and written once with their
partition number (range bounds are sampled anew on every evaluation).  Each
partition sums its own rows; a table with one row per partition carries the
totals of all earlier partitions.  No task sees more than its own range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def prefix_sums(df: DataFrame, order: Sequence[Column], values: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, totals)``.

    ``rows`` is ``df`` plus ``position`` (0, 1, ... in ``order``) and, for each
    value column ``v``, ``v_before``: its sum over all earlier rows.
    ``totals`` has one row: ``n_rows`` and, for each ``v``, ``v_total`` (0 for
    an empty table).  Rows that tie in the whole of ``order`` come in any
    sequence, so ``order`` should end with what tells rows apart.  A row number
    comes last, so that rows repeated whole, however many, are cut too."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*order, F.col("_tie")]
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *order)
    placed = materialize(placed.withColumn("_pid", F.spark_partition_id()), name)
    sums = [F.sum(v).alias(f"_sum_{v}") for v in values]
    per = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_rows"), *sums)
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    offsets = per.select("_pid", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_off"),
                         *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}") for v in values])
    own = Window.partitionBy("_pid").orderBy(*order)
    own_earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumns(
        {"_local": F.row_number().over(own) - 1}
        | {f"_local_{v}": F.coalesce(F.sum(v).over(own_earlier), F.lit(0)) for v in values})
    rows = rows.join(F.broadcast(offsets), "_pid")   # at most one row per shuffle partition
    rows = rows.withColumns({"position": F.col("_off") + F.col("_local")}
                            | {f"{v}_before": F.col(f"_off_{v}") + F.col(f"_local_{v}") for v in values})
    rows = rows.drop("_pid", "_tie", "_off", "_local", *[f"{p}_{v}" for p in ("_off", "_local") for v in values])
    totals = per.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"),
                     *[F.coalesce(F.sum(f"_sum_{v}"), F.lit(0)).alias(f"{v}_total") for v in values])
    return rows, totals
