"""Write an intermediate result to the shared checkpoint folder and read it back.

Used where one derived table feeds several branches of a plan (so it is
computed once) or where lineage would otherwise grow with each iteration.
The files live under ``spark.checkpoint.dir`` (shared storage on a
cluster), so they survive the loss of an executor; the planner also sees
their real size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
