"""Change logs and deletes against plain-Python simulations."""

import random
from datetime import datetime, timedelta

import pytest
from parkops.operators import changes
from parkops.operators.changes import ForeignKey

T0 = datetime(2024, 1, 1)
FIELDS = ["name", "flag", "size"]
LOG = "id long, op string, changed_at timestamp_ntz, change_id long, sets array<string>, name string, flag boolean, size int"


def random_changes(rng, n, keys):
    rows = []
    for i in range(n):
        op = rng.choice(["update"] * 6 + ["insert", "delete"])
        sets = [c for c in FIELDS if rng.random() < 0.5] if op == "update" else None
        key = 0 if rng.random() < 0.4 else rng.randrange(keys)   # a hot key
        rows.append((key, op, T0 + timedelta(hours=rng.randrange(30)), i, sets, rng.choice(["x", "y", None]), rng.choice([True, False, None]),
                     rng.choice([1, 2, None])))   # times tie
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_each_column_has_its_last_writer(spark, seed):
    rng = random.Random(seed)
    base = [(k, f"base{k}", None, k) for k in range(6)]
    log = random_changes(rng, 300, 12)
    got = changes.merge_changes(spark.createDataFrame([*base, (None, "no key", True, 1)], "id long, name string, flag boolean, size int"),
                                spark.createDataFrame([*log, (None, "insert", T0, 999, None, "n", True, 1)], LOG).repartition(3), FIELDS)
    rows = {k: dict(zip(FIELDS, v)) for k, *v in base}
    for key, op, _, _, sets, *values in sorted(log, key=lambda r: (r[2], r[3])):
        new = dict(zip(FIELDS, values))
        if op == "delete":
            rows.pop(key, None)
        elif op == "insert":
            rows[key] = new
        elif key in rows:
            rows[key] |= {c: new[c] for c in sets}
    assert {r.id: (r.name, r.flag, r["size"]) for r in got.collect()} == {k: tuple(v.values()) for k, v in rows.items()}


def test_spot_flags_and_reservation_status_have_their_own_writers(spark):
    spots = spark.createDataFrame([(1, "S1", 1, "regular", False, True), (2, "S2", 1, "regular", None, None)],
                                  "id long, spot_number string, zone_id int, spot_type string, is_occupied boolean, is_reserved boolean")
    flags = [(1, 1, "check_in", T0), (2, 1, "cancel", T0), (3, 1, "check_out", T0 - timedelta(hours=1)), (4, 2, "reserve", T0), (5, 2, None, T0),
             (6, 9, "check_in", T0), (7, None, "check_in", T0)]
    got = changes.spot_flags_snapshot(spots, spark.createDataFrame(flags, "event_id long, spot_id long, action string, ts timestamp_ntz"))
    assert {r.id: (r.is_occupied, r.is_reserved) for r in got.collect()} == {1: (True, False), 2: (None, True)}
    res = spark.createDataFrame([(1, 1, 1, None, T0, T0, "active", "pending")], "id long, user_id long, spot_id long, vehicle_id long, "
                                "start_time timestamp_ntz, end_time timestamp_ntz, status string, payment_status string")
    log = [(1, T0, 2, "cancelled", None), (1, T0, 1, "completed", "paid"), (1, T0 - timedelta(days=1), 3, None, "refunded")]
    out = changes.reservation_status_snapshot(res, spark.createDataFrame(
        log, "reservation_id long, changed_at timestamp_ntz, change_id long, status string, payment_status string")).first()
    assert (out.status, out.payment_status, out.user_id) == ("cancelled", "paid", 1)


KEYS = (ForeignKey("b", "a_id", "a", "cascade"), ForeignKey("c", "b_id", "b", "cascade"), ForeignKey("c", "a_id", "a", "set null"),
        ForeignKey("d", "c_id", "c", "set null"), ForeignKey("d", "b_id", "b", "cascade"))


def test_deletes_follow_the_foreign_keys(spark):
    rng = random.Random(7)
    ref = lambda n: rng.choice([None, *range(n + 2)])  # noqa: E731  (also rows that are not there)
    data = {"a": [(i,) for i in range(12)], "b": [(i, ref(12)) for i in range(30)], "c": [(i, ref(30), ref(12)) for i in range(60)],
            "d": [(i, ref(60), ref(30)) for i in range(100)]}
    columns = {"a": ["id"], "b": ["id", "a_id"], "c": ["id", "b_id", "a_id"], "d": ["id", "c_id", "b_id"]}
    listed = {"a": [1, 5, 99], "c": [3, 3, None], "d": [4]}
    tables = {n: spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns[n])) for n, rows in reversed(data.items())}
    left = changes.delete_propagation(tables, {n: spark.createDataFrame([(i,) for i in ids], "id long") for n, ids in listed.items()}, KEYS)
    gone = {n: set(listed.get(n, [])) & {r[0] for r in rows} for n, rows in data.items()}
    want = {}
    for name in "abcd":
        for row in data[name]:
            values, blanked = dict(zip(columns[name], row)), []
            for k in KEYS:
                if k.child == name and values[k.column] in gone[k.parent]:
                    if k.rule == "cascade":
                        gone[name].add(row[0])
                    else:
                        blanked.append(k.column)
            if row[0] not in gone[name]:
                want[name, row[0]] = ({c: None if c in blanked else v for c, v in values.items()}, ",".join(blanked))
    got = {(n, r.id): ({c: r[c] for c in columns[n]}, r.nulled) for n, df in left.items() for r in df.collect()}
    assert got == want and any(v[1] for v in want.values())
    assert changes.surviving_rows(left).count() == len(want)


def test_foreign_keys_in_a_circle_are_an_error(spark):
    tables = {n: spark.createDataFrame([(1, 1)], "id long, other long") for n in "xy"}
    with pytest.raises(ValueError):
        changes.delete_propagation(tables, {}, (ForeignKey("x", "other", "y", "cascade"), ForeignKey("y", "other", "x", "cascade")))
