"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from ..session import ensure_checkpoint_dir, ship_package

__all__ = ["materialize", "prepare", "read", "word_count", "union_all", "WORD_GAP"]

#: What separates words: the six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


#: Rows that a Python worker gets at a time.  Texts are long: Spark's default of ten thousand can be gigabytes.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder, package and batch size for the Python workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":   # left at the default
        spark.conf.set(rows, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    ends += F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def union_all(first: DataFrame, *rest: DataFrame) -> DataFrame:
    for df in rest:
        first = first.unionByName(df)
    return first
