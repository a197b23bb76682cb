"""The query catalog: every registered query and its DuckDB oracle.

A query is a callable ``(spark, base_dir) -> DataFrame`` that reads the
given tables through :class:`parkops.sources.fixtures.ParkingModel` and
runs one operator on the whole input.  The oracle is ANSI SQL over the same
raw tables (parking views are added as CTEs by ``with_views``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def money_as_double(df: DataFrame) -> DataFrame:
    """Cast DECIMAL result columns to DOUBLE (the oracle reads them as such)."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import DecimalType
    if not any(isinstance(f.dataType, DecimalType) for f in df.schema.fields):
        return df
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
                       else F.col(f.name) for f in df.schema.fields])


def register(name: str, oracle: str | None = None, extra_ctes: list[tuple[str, str]] | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, base: str) -> DataFrame:
            return money_as_double(fn(spark, base))
        run.__doc__ = fn.__doc__
        run.__name__ = fn.__name__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle, extra_ctes)
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import queries  # noqa: F401
