"""Facts by day: pruned reads, days computed alone, late sessions."""

import os
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from parkops import schemas as S
from parkops.operators import daily, reports
from parkops.sources.fixtures import AS_OF, model
from settings import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def random_sessions(seed, n, first=0):
    rng = random.Random(seed)
    out = []
    for i in range(first, first + n):
        start = datetime(2024, 1, 20) + timedelta(minutes=rng.randrange(11 * 24 * 60))
        end = start + timedelta(minutes=rng.randrange(1, 600)) if rng.random() < 0.8 else None
        out.append((i, rng.randrange(20), 1, None, start, end, None, Decimal(rng.randrange(1000)) / 100 if end else None,
                    rng.choice(["paid", "paid", "pending"]), "cash"))
    return out


def spots(spark):
    return spark.createDataFrame([(1, "A", 1, "regular", True, False, None), (2, "B", 1, "regular", False, False, None)], S.PARKING_SPOTS)


def test_reports_equal_the_direct_ones_after_late_loads(spark, tmp_path):
    path = str(tmp_path / "days")
    early, late = random_sessions(1, 300), random_sessions(2, 40, 300)
    # an open session comes again, closed; a payment is corrected
    again = [(*r[:5], r[4] + timedelta(minutes=5), None, Decimal("3.50"), "paid", "cash") for r in early if r[5] is None][:10]
    again += [(*r[:8], "paid", "cash") for r in early if r[5] and r[8] == "pending"][:10]
    final = {r[0]: r for r in early} | {r[0]: r for r in [*late, *again]}
    df = lambda rows: spark.createDataFrame(list(rows), S.PARKING_SESSIONS)
    daily.load_sessions(df(early), path, 1)
    touched = daily.load_sessions(df([*late, *again]), path, 2)
    assert set(touched) == {"exits", "entries"} and all(isinstance(d, date) for d in touched["exits"])
    daily.load_sessions(df([]), path, 3)
    whole = df(final.values())
    for as_of in (AS_OF, "2024-01-28 10:30:00", "2024-03-01 00:00:00"):
        assert rows_of(daily.weekly_revenue(spark, path, as_of)) == rows_of(reports.weekly_revenue(whole, as_of))
        assert rows_of(daily.dashboard_kpis(spots(spark), path, as_of)) == rows_of(reports.dashboard_kpis(spots(spark), whole, as_of))


def test_a_day_is_computed_alone(spark, tmp_path):
    path = str(tmp_path / "days")
    daily.load_sessions(spark.createDataFrame(random_sessions(3, 200), S.PARKING_SESSIONS), path, 1)

    def files():
        return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{path}/revenue_days") for f in fs
                if f.endswith(".parquet")}
    before = files()
    one = (9999, 1, 1, None, datetime(2024, 1, 25, 8), datetime(2024, 1, 25, 9), None, Decimal("5.00"), "paid", "cash")
    touched = daily.load_sessions(spark.createDataFrame([one], S.PARKING_SESSIONS), path, 2)
    assert touched["exits"] == [date(2024, 1, 25)]
    after = files()
    assert len(before) == len(after) and sum(after.get(f) == t for f, t in before.items()) == len(before) - 1


def test_only_the_days_asked_for_are_read(spark, tmp_path):
    path = str(tmp_path / "days")
    m = model(spark, SF_SMALL)
    daily.load_sessions(m.sessions, path, 0)
    week = plan(daily.weekly_revenue(spark, path, AS_OF))
    assert "PartitionFilters: [isnotnull(day" in week and "(day#" in week and "events.parquet" not in week
    scans = [line for line in week.splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters: []" not in line for line in scans)
    kpis = [line for line in plan(daily.dashboard_kpis(m.spots, path, AS_OF)).splitlines() if "FileScan" in line and "day#" in line]
    assert len(kpis) == 2 and all("PartitionFilters: [isnotnull(day" in line for line in kpis)
    assert daily.revenue_days(spark, path).agg(F.sum("transactions")).first()[0] == \
        m.sessions.filter("payment_status = 'paid' and exit_time is not null").count()


def test_empty_history(spark, tmp_path):
    path = str(tmp_path / "days")
    daily.load_sessions(spark.createDataFrame([], S.PARKING_SESSIONS), path, 0)
    daily.load_sessions(spark.createDataFrame(random_sessions(5, 3), S.PARKING_SESSIONS), path, 1)
    assert daily.weekly_revenue(spark, path, "2020-01-01 00:00:00").count() == 0
