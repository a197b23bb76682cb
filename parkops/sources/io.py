"""Scans and sinks.

``scan_table`` reads Parquet with an optional explicit schema, selected
columns and a predicate; Catalyst prunes the columns and pushes the
predicate into the Parquet reader (row-group skipping), and a filter on a
partition column prunes whole folders.  ``write_result`` is the sink: it
writes a result as Parquet (or JSON), optionally partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_table(spark: SparkSession, path: str, schema: StructType | None = None,
               columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(path)
    if where is not None:
        df = df.filter(where)
    if columns:
        df = df.select(*columns)
    return df


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: Sequence[str] | None = None, spread: Sequence[str] = (), files: int = 4) -> str:
    """Write ``df`` to ``path`` (a folder on shared storage) and return it.

    With ``spread`` columns the rows are first dealt by partition value and one
    of ``files`` hashes of them, so a folder gets at most ``files`` files instead
    of one from every task."""
    if partition_by and spread:
        df = df.repartition(*partition_by, F.pmod(F.xxhash64(*spread), F.lit(files)))
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    getattr(w, fmt)(path)
    return path
