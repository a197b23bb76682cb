"""Column expressions against plain-Python versions of the same rules."""

import math
import random
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from parkops.functions.billing import bill, open_cost_estimates
from parkops.functions.columns import hhmmss, js_or, pct_int

T0 = datetime(2024, 1, 1, 8)


def py_bill(us: int, rate, mode: str):
    js_rate = 5 if rate is None or rate == 0 else rate
    if mode == "server":
        m = us // 60_000_000
        h = math.ceil(m / 60)
        return m, h, None if rate is None else float(h * rate)
    if mode == "client":
        m = max(1, us // 60_000_000)
        h = math.ceil(m / 60)
        return m, h, float(h * js_rate)
    m = us // 60_000_000
    h = max(1, math.ceil(us / 3_600_000_000))
    return m, h, float(h * js_rate)


def test_billing_modes_match_python(spark):
    rnd = random.Random(21)
    rows = []
    specials = [0, 30_000_000, 59_999_999, 60_000_000, 3_600_000_000, 3_600_000_001, 3_630_000_000]
    for i in range(300):
        us = specials[i] if i < len(specials) else rnd.randint(0, 3 * 86_400_000_000)
        rate = rnd.choice([None, Decimal("0.00"), Decimal("5.00"), Decimal("7.00")])
        rows.append((i, T0, T0 + timedelta(microseconds=us), rate, us))
    df = spark.createDataFrame(rows, "i long, a timestamp_ntz, b timestamp_ntz, r decimal(10,2), us long")
    cols = ["i", "us", "r"]
    for mode in ("server", "client", "display"):
        b = bill("a", "b", "r", mode)
        cols += [b["minutes"].alias(f"{mode}_m"), b["hours"].alias(f"{mode}_h"), b["amount"].alias(f"{mode}_a")]
    for row in df.select(*cols).collect():
        for mode in ("server", "client", "display"):
            want = py_bill(row["us"], row["r"], mode)
            got = (row[f"{mode}_m"], row[f"{mode}_h"], row[f"{mode}_a"])
            assert got == want, (mode, row)


def test_open_estimates_and_small_helpers(spark):
    df = spark.createDataFrame([(T0, Decimal("7.00"), 3), (T0, None, 2)],
                               "e timestamp_ntz, r decimal(10,2), h int")
    now = F.lit(T0 + timedelta(minutes=90)).cast("timestamp_ntz")
    est = open_cost_estimates("e", now, "r", "h")
    got = df.select(*[c.alias(k) for k, c in est.items()]).collect()
    assert got[0]["flat_estimate"] == 7.5 and got[0]["started_hours_estimate"] == 14.0
    assert got[0]["booked_estimate"] == 21.0 and got[1]["booked_estimate"] == 10.0
    assert got[1]["started_hours_estimate"] is None
    r = spark.createDataFrame([(0, 0), (3, 7), (1, 8)], "a int, b int").select(
        pct_int(F.col("a"), F.col("b")).alias("p"), js_or(F.col("a"), 5).alias("j")).collect()
    assert [x["p"] for x in r] == [0, 43, 13] and [x["j"] for x in r] == [5, 3, 1]


def test_countdown_text(spark):
    cases = [0, 999, 1000, 59_000, 3_599_000, 3_600_000, 100 * 3_600_000 + 61_000]
    df = spark.createDataFrame([(c,) for c in cases], "ms long")
    got = [r["t"] for r in df.select(hhmmss(F.col("ms")).alias("t")).collect()]

    def py(ms):
        s = ms // 1000
        return f"{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"
    assert got == [py(c) for c in cases]
    assert got[-1] == "100:01:01"   # hours are padded, never cut
