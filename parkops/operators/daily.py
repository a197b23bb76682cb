"""Session facts by day, and what each day adds up to.

Facts are kept as Parquet partitioned by day: exits by the day of the exit, entries by the
day of the entry.  From them each day has partials that merge: sums and counts,
and the set of distinct vehicles as rows.  A load appends its facts and computes
anew only the days that it touches (late sessions too), so a report of one day or week reads
that many folders, whatever the size of the history.

Loads are numbered: a session that comes again replaces what an earlier load said of it, if the
day is the same (a closed session comes with its exit, an open one without).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import pct_int
from ..sources.fixtures import as_of_lit
from ..sources.io import write_result
from .reports import spot_kpis

#: Fact tables: the time that gives the day, and the columns kept with their types.
FACTS = {"exits": ("exit_time", {"payment_status": "string", "total_amount": "decimal(10,2)"}),
         "entries": ("entry_time", {"vehicle_id": "long"})}
#: Partials made of each fact table's days.
PARTIALS = {"exits": "revenue_days", "entries": "vehicle_days"}


def _days_of(df: DataFrame) -> list[date]:
    """Distinct days: one value a calendar day for the driver."""
    return sorted(r.day for r in df.select("day").distinct().collect())


def load_sessions(sessions: DataFrame, path: str, load: int, facts: Sequence[str] = tuple(FACTS)) -> dict[str, list[date]]:
    """Append the facts of load number ``load`` and refresh the days they touch, which are returned.

    Sessions without the time in question have no fact of that kind."""
    spark, touched = sessions.sparkSession, {}
    for name in facts:
        time, columns = FACTS[name]
        rows = sessions.filter(F.col(time).isNotNull()).select("id", time, *columns, F.to_date(time).alias("day"))
        write_result(rows, f"{path}/{name}/load={load:012d}", partition_by=["day"], spread=["id"])
        touched[name] = _days_of(_read(spark, path, name).filter(F.col("load") == load))
        refresh(spark, path, name, touched[name])
    return touched


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    time, columns = FACTS[name]
    kept = ", ".join(f"{c} {t}" for c, t in columns.items())
    return spark.read.schema(f"id long, {time} timestamp_ntz, {kept}, load long, day date").parquet(f"{path}/{name}")


def facts_of(spark: SparkSession, path: str, name: str, days: Sequence[date]) -> DataFrame:
    """The facts of some days, each session once, as its latest load says; only their folders are read."""
    time, columns = FACTS[name]
    rows = _read(spark, path, name).filter(F.col("day").isin(list(days)))
    latest = rows.groupBy("day", "id").agg(F.max_by(F.struct(time, *columns), "load").alias("f"))
    return latest.select("day", "id", *[F.col(f"f.{c}").alias(c) for c in (time, *columns)])


def _paid(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("payment_status") == "paid").groupBy("day")
            .agg(F.coalesce(F.sum("total_amount"), F.lit(0)).cast("decimal(38,2)").alias("revenue"), F.count(F.lit(1)).alias("transactions")))


def refresh(spark: SparkSession, path: str, name: str, days: Sequence[date]) -> None:
    """Compute the partials of some days anew; other days' folders stay as they are."""
    facts = facts_of(spark, path, name, days)
    partial = _paid(facts) if name == "exits" else facts.select("day", "vehicle_id").distinct()
    (partial.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day")
     .parquet(f"{path}/{PARTIALS[name]}"))


def _partials(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, day date").parquet(f"{path}/{PARTIALS[name]}")


def revenue_days(spark: SparkSession, path: str) -> DataFrame:
    """``day, revenue, transactions`` of paid sessions by exit day."""
    return _partials(spark, path, "exits", "revenue decimal(38,2), transactions long")


def vehicle_days(spark: SparkSession, path: str) -> DataFrame:
    """``day, vehicle_id``: the distinct vehicles that entered on a day."""
    return _partials(spark, path, "entries", "vehicle_id long")


def dashboard_kpis(spots: DataFrame, path: str, as_of: str) -> DataFrame:
    """``reports.dashboard_kpis`` from the partials of the as-of day."""
    spark, today = spots.sparkSession, F.to_date(as_of_lit(as_of))
    money = revenue_days(spark, path).filter(F.col("day") == today).agg(
        F.coalesce(F.sum("revenue"), F.lit(0)).cast("double").alias("today_revenue"))
    seen = vehicle_days(spark, path).filter(F.col("day") == today).agg(F.count("vehicle_id").alias("today_vehicles"))
    return spot_kpis(spots).crossJoin(money).crossJoin(seen).select(
        "total_spots", "occupied_spots", "available_spots", "reserved_spots", "today_revenue",
        "today_vehicles", pct_int(F.col("occupied_spots"), F.col("total_spots")).alias("occupancy_rate"))


def weekly_revenue(spark: SparkSession, path: str, as_of: str, days: int = 7) -> DataFrame:
    """``reports.weekly_revenue``: whole days from their partials, the two days at the ends from their facts."""
    now = as_of_lit(as_of)
    since = now - F.make_dt_interval(days=F.lit(days))
    first, last = spark.range(1).select(F.to_date(since), F.to_date(now)).first()
    whole = revenue_days(spark, path).filter((F.col("day") > F.lit(first)) & (F.col("day") < F.lit(last)))
    ends = facts_of(spark, path, "exits", [first, last]).filter((F.col("exit_time") >= since) & (F.col("exit_time") <= now))
    return (whole.select("day", "revenue", "transactions").unionByName(_paid(ends))
            .select(F.date_format("day", "yyyy-MM-dd").alias("date"), F.date_format("day", "EEEE").alias("day_name"),
                    F.col("revenue").cast("double").alias("revenue"), "transactions").orderBy("date"))
