"""Change logs and deletes applied in bulk."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_TIME = "1900-01-01 00:00:00"
USER_FIELDS = ["username", "email", "full_name", "phone", "role", "is_active"]
SPOT_FIELDS = ["spot_number", "zone_id", "spot_type", "is_occupied", "is_reserved"]
RESERVATION_FIELDS = ["user_id", "spot_id", "vehicle_id", "start_time", "end_time", "status", "payment_status"]


# ---------------------------------------------------------------------------
# Change logs
# ---------------------------------------------------------------------------
def merge_changes(base: DataFrame, changes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The rows of ``base`` (``id`` and ``fields``) after a change log.

    ``changes`` has ``id``, ``op``, ``changed_at``, ``change_id``, ``sets`` (names of the columns that an
    update writes; a NULL is written too) and ``fields``.  Changes apply in the order of
    (changed_at, change_id): an ``insert`` writes the whole row, a ``delete`` removes it, an ``update`` writes some
    columns of a row that is there and nothing otherwise.  So the latest insert or delete of
    a key (the base counts as an insert before everything) decides whether its row exists, and
    each column has its last writer after that.  All steps are aggregates per key
    that combine map-side, so a hot key is not gathered.  Keys that are NULL are left out."""
    key = F.col("id").isNotNull()
    log = changes.filter(key).select("id", "op", "changed_at", "change_id", "sets", *fields)
    start = base.filter(key).select("id", F.lit("insert").alias("op"), F.lit(BASE_TIME).cast("timestamp_ntz").alias("changed_at"),
                                    F.lit(-1).cast("bigint").alias("change_id"), F.lit(None).cast("array<string>").alias("sets"), *fields)
    order = F.struct("changed_at", "change_id")
    resets = (start.unionByName(log.filter(F.col("op").isin("insert", "delete"))).groupBy("id")
              .agg(F.max_by(F.struct("op", order.alias("at"), *fields), order).alias("r")))
    live = resets.filter(F.col("r.op") == "insert")
    updates = log.filter(F.col("op") == "update").join(live.select("id", F.col("r.at").alias("_at")), "id").filter(order > F.col("_at"))
    # a struct, so that a written NULL differs from no writer
    last = [F.max_by(F.struct(c), F.when(F.array_contains("sets", c), order)).alias(f"_{c}") for c in fields]
    return live.join(updates.groupBy("id").agg(*last), "id", "left").select(
        "id", *[F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in fields])


def change_log_snapshot(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Users after a change log of ``insert`` (whole row), ``profile``
    (full name and phone, both replaced, NULL included), ``role`` and
    ``delete`` operations."""
    sets = (F.when(F.col("op") == "profile", F.array(F.lit("full_name"), F.lit("phone")))
            .when(F.col("op") == "role", F.array(F.lit("role"))))
    log = changes.select(F.col("user_id").alias("id"), F.when(sets.isNotNull(), "update").otherwise(F.col("op")).alias("op"), "changed_at",
                         "change_id", sets.alias("sets"), "username", "email", "full_name", "phone", "role", F.lit(True).alias("is_active"))
    return merge_changes(users, log, USER_FIELDS).select("id", "username", "email", "full_name", "role", "phone", "is_active")


def spot_flags_snapshot(spots: DataFrame, flags: DataFrame) -> DataFrame:
    """Spots after a log of flag changes: ``check_in`` and ``check_out`` set and clear ``is_occupied``, ``reserve`` and
    ``cancel`` set and clear ``is_reserved``; each leaves the other flag alone."""
    occupies = F.col("action").isin("check_in", "check_out")
    sets = F.array(F.when(occupies, "is_occupied").otherwise("is_reserved"))
    log = flags.filter(occupies | F.col("action").isin("reserve", "cancel")).select(
        F.col("spot_id").alias("id"), F.lit("update").alias("op"), F.col("ts").alias("changed_at"), F.col("event_id").alias("change_id"),
        sets.alias("sets"), F.lit(None).cast("string").alias("spot_number"), F.lit(None).cast("int").alias("zone_id"),
        F.lit(None).cast("string").alias("spot_type"), (F.col("action") == "check_in").alias("is_occupied"),
        (F.col("action") == "reserve").alias("is_reserved"))
    return merge_changes(spots, log, SPOT_FIELDS)


def reservation_status_snapshot(reservations: DataFrame, changes: DataFrame) -> DataFrame:
    """Reservations after a log whose rows write a ``status``, a ``payment_status`` or both (NULL: not written)."""
    written = [F.when(F.col(c).isNotNull(), F.lit(c)) for c in ("status", "payment_status")]
    kinds = dict(reservations.dtypes)
    log = changes.select(
        F.col("reservation_id").alias("id"), F.lit("update").alias("op"), "changed_at", "change_id", F.array_compact(F.array(*written)).alias("sets"),
        *[F.col(c) if c in ("status", "payment_status") else F.lit(None).cast(kinds[c]).alias(c) for c in RESERVATION_FIELDS])
    return merge_changes(reservations, log, RESERVATION_FIELDS)


# ---------------------------------------------------------------------------
# Deletes
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` names a row of ``parent``; what its delete does: ``cascade`` or ``set null``."""
    child: str
    column: str
    parent: str
    rule: str


#: The schema's foreign keys (fixed values).
FOREIGN_KEYS = (
    ForeignKey("parking_spots", "zone_id", "zones", "cascade"),
    ForeignKey("vehicles", "user_id", "users", "set null"),
    ForeignKey("parking_sessions", "vehicle_id", "vehicles", "cascade"),
    ForeignKey("parking_sessions", "spot_id", "parking_spots", "cascade"),
    ForeignKey("parking_sessions", "user_id", "users", "set null"),
    ForeignKey("reservations", "user_id", "users", "cascade"),
    ForeignKey("reservations", "spot_id", "parking_spots", "cascade"),
    ForeignKey("reservations", "vehicle_id", "vehicles", "set null"),
    ForeignKey("ai_predictions", "zone_id", "zones", "cascade"),
    ForeignKey("audit_logs", "user_id", "users", "set null"),
)


def delete_propagation(tables: dict[str, DataFrame], deleted: dict[str, DataFrame],
                       keys: Sequence[ForeignKey] = FOREIGN_KEYS) -> dict[str, DataFrame]:
    """All tables after deleting the listed ids (one column ``id`` a table).

    Tables are taken parents first, in the order of the foreign keys (a cycle is an
    error).  A row goes if its id is listed or a ``cascade`` key names a row that goes; where a
    ``set null`` key does, the key becomes NULL.  The result has one more column, ``nulled``: the names
    of the keys so blanked, comma-joined.  A key that is NULL, or names a row that was never there, changes nothing.
    Tables have a column ``id``; a row meets each parent's ids in one equi-join."""
    parents = {name: [k for k in keys if k.child == name] for name in tables}
    order = TopologicalSorter({name: {k.parent for k in ks} for name, ks in parents.items()}).static_order()
    gone: dict[str, DataFrame] = {}
    left: dict[str, DataFrame] = {}
    for name in order:
        df = tables[name]
        goes, blank = [], []
        listed = deleted.get(name)
        if listed is not None:
            ids = listed.select(F.col("id").alias("_listed")).filter("_listed is not null").distinct()
            df = df.join(ids, F.col("id") == F.col("_listed"), "left")
            goes.append(F.col("_listed").isNotNull())
        for i, k in enumerate(parents[name]):
            if k.parent in gone:
                df = df.join(gone[k.parent].select(F.col("id").alias(f"_fk{i}")), F.col(k.column) == F.col(f"_fk{i}"), "left")
                hit = F.col(f"_fk{i}").isNotNull()
                if k.rule == "cascade":
                    goes.append(hit)
                else:
                    blank.append((hit, k.column))
        dead = reduce(lambda a, b: a | b, goes, F.lit(False))
        if goes:
            gone[name] = df.filter(dead).select("id").distinct()
        nulled = F.concat_ws(",", *[F.when(hit, F.lit(c)) for hit, c in blank]) if blank else F.lit("")
        columns = {c: F.col(c) for c in tables[name].columns} | {c: F.when(~hit, F.col(c)).alias(c) for hit, c in blank}
        left[name] = df.filter(~dead).select(*columns.values(), nulled.alias("nulled"))
    return left


def surviving_rows(left: dict[str, DataFrame]) -> DataFrame:
    """``table_name, id, nulled`` of every row that is left, of all tables."""
    parts = [df.select(F.lit(name).alias("table_name"), F.col("id").cast("long").alias("id"), "nulled") for name, df in left.items()]
    return reduce(DataFrame.unionByName, parts)
