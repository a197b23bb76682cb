"""Bulk registration: users, vehicles and walk-in vehicles.

Requests are decided in request-id order and the first one wins.  Rule
checks are column expressions; "already exists" is an anti-join against the
current table; duplicates inside a batch are resolved without gathering a
name into one task (per-key minimum via map-side combining aggregates).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import (FORCED_ROLE, PASSWORD_MIN_LEN, PLATE_MAX_LEN, USERNAME_MAX_LEN, USERNAME_MIN_LEN,
                       VEHICLE_TYPES, WALK_IN_VEHICLE_TYPE)
from ..plans.components import connected_components
from ..plans.materialize import materialize

# Column widths, and the parts of an e-mail address (dot-separated atoms of at most 64
# characters, then a domain name whose last label is letters).
EMAIL_MAX_LEN = FULL_NAME_MAX_LEN = 100
EMAIL_LOCAL_MAX_LEN = 64
_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
EMAIL_PATTERN = rf"^{_ATOM}(?:\.{_ATOM})*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{{2,}}$"


def _first_violation(rules: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for bad, reason in reversed(rules):
        out = F.when(bad, F.lit(reason)).otherwise(out)
    return out


def _settle(rest: DataFrame, id_col: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round: ``(accepted, undecided)``.  A row that is the first for every one of its keys is certainly
    accepted; the rows that share a key with it are certainly rejected."""
    firsts = rest
    for k in keys:
        m = rest.groupBy(k).agg(F.min(id_col).alias(f"_min_{k}"))
        firsts = firsts.join(m, k, "inner").filter(F.col(id_col) == F.col(f"_min_{k}")).drop(f"_min_{k}")
    firsts = materialize(firsts, "greedy-won")
    for k in keys:
        rest = rest.join(firsts.select(k).distinct(), k, "left_anti")
    return firsts.select(id_col), materialize(rest, "greedy-rest")


def _first_wins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids accepted among rows ``(component, id, *keys)`` that come by component and id; held: a component's accepted keys."""
    at, taken = None, []
    for batch in batches:
        won = []
        for component, row, *keys in zip(*(c.to_pylist() for c in batch.columns)):
            if component != at:
                at, taken = component, [set() for _ in keys]
            if not any(k in t for k, t in zip(keys, taken)):
                for k, t in zip(keys, taken):
                    t.add(k)
                won.append(row)
        yield pa.RecordBatch.from_arrays([pa.array(won, batch.schema.field(1).type)], names=[batch.schema.names[1]])


def greedy_unique(cand: DataFrame, id_col: str, keys: list[str], rounds: int = 2) -> DataFrame:
    """Ids accepted by the sequential rule "accept a row unless an earlier accepted row shares one of ``keys``".

    First ``rounds`` rounds of aggregates and anti-joins accept the rows that come first for all of
    their keys and reject those that share a key with them: that decides nearly all rows of a
    key that many share.  What is left are chains, in which each row waits for the one before.
    They are told apart as connected components of the keys (a row links its keys), and each
    component's rows are decided in one ordered pass, component by component as they stream by.  So the
    number of jobs grows with the logarithm of the longest chain, not with its length.
    Ids are distinct and keys not null.  Returns one column ``id_col``."""
    rest = materialize(cand.select(id_col, *keys), "greedy-rest")
    accepted = []
    for _ in range(rounds):
        if rest.isEmpty():
            break
        won, rest = _settle(rest, id_col, keys)
        accepted.append(won)
    if not rest.isEmpty():
        node = [F.xxhash64(F.lit(k), k) for k in keys]   # a collision only joins two components
        edges = [rest.select(node[0].alias("a"), n.alias("b")) for n in node[1:]]
        groups = connected_components(reduce(DataFrame.unionByName, edges, rest.select(node[0].alias("a"), node[0].alias("b"))))
        placed = rest.withColumn("node", node[0]).join(groups, "node", "left").select(
            F.coalesce("component", "node").alias("component"), id_col, *keys)
        dealt = placed.repartition("component").sortWithinPartitions("component", id_col)
        kind = rest.schema[id_col].dataType.simpleString()
        accepted.append(materialize(dealt.mapInArrow(_first_wins, f"{id_col} {kind}"), "greedy-won"))
    return reduce(DataFrame.unionByName, accepted) if accepted else cand.select(id_col).limit(0)


def user_import_validate(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Registration batch -> decision per request.

    Checks, first failure wins: username 3-50 characters, e-mail address,
    password at least 6 characters (only the length is an input), full name
    not empty and at most 100 characters, username or e-mail already taken (case-insensitive), then a
    clash with an earlier accepted request of the same batch.  Accepted
    users always get the role ``customer`` whatever the request asked for.
    """
    r = requests.withColumn("_u", F.lower(F.trim("username"))).withColumn("_e", F.lower(F.trim("email")))
    taken_u = users.select(F.lower("username").alias("_u")).distinct()
    taken_e = users.select(F.lower("email").alias("_e")).distinct()
    r = (r.join(taken_u.withColumn("_tu", F.lit(True)), "_u", "left")
         .join(taken_e.withColumn("_te", F.lit(True)), "_e", "left"))
    n = F.length("username")
    pre = _first_violation([
        (F.col("username").isNull() | (n < USERNAME_MIN_LEN) | (n > USERNAME_MAX_LEN), "username_length"),
        (F.col("email").isNull() | ~F.col("email").rlike(EMAIL_PATTERN) | (F.length("email") > EMAIL_MAX_LEN)
         | (F.length(F.substring_index("email", "@", 1)) > EMAIL_LOCAL_MAX_LEN), "email_invalid"),
        (F.coalesce(F.col("password_length"), F.lit(0)) < PASSWORD_MIN_LEN, "password_short"),
        (F.coalesce("full_name", F.lit("")) == "", "full_name_empty"),
        (F.length("full_name") > FULL_NAME_MAX_LEN, "full_name_long"),
        (F.col("_tu").isNotNull() | F.col("_te").isNotNull(), "already_exists"),
    ])
    r = r.withColumn("_pre", pre)
    won = greedy_unique(r.filter(F.col("_pre").isNull()), "request_id", ["_u", "_e"])
    j = r.join(won.withColumn("_won", F.lit(True)), "request_id", "left")
    accepted = F.coalesce(F.col("_won"), F.lit(False))
    return j.select("request_id", "username", "email", accepted.alias("accepted"),
                    F.when(accepted, F.lit(None).cast("string"))
                     .otherwise(F.coalesce(F.col("_pre"), F.lit("duplicate_in_batch"))).alias("reason"),
                    F.when(accepted, F.lit(FORCED_ROLE)).alias("role"))


def vehicle_import_validate(requests: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Vehicle batch -> decision per request: plate required (trimmed,
    upper-cased, at most 20 characters), type in the enum, plate not yet
    registered, and the first request of a plate in the batch wins.  Empty
    makes, models and colors become NULL."""
    plate = F.upper(F.trim("license_plate"))
    r = requests.withColumn("plate", plate)
    known = vehicles.select(F.upper(F.trim("license_plate")).alias("plate")).distinct().withColumn("_k", F.lit(True))
    r = r.join(known, "plate", "left")
    pre = _first_violation([
        (F.col("plate").isNull() | (F.col("plate") == ""), "plate_required"),
        (F.length("plate") > PLATE_MAX_LEN, "plate_too_long"),
        (~F.coalesce(F.col("vehicle_type").isin(*VEHICLE_TYPES), F.lit(False)), "invalid_type"),
        (F.col("_k").isNotNull(), "already_registered"),
    ])
    r = r.withColumn("_pre", pre)
    firsts = (r.filter(F.col("_pre").isNull()).groupBy("plate")
              .agg(F.min("request_id").alias("_first")))
    j = r.join(firsts, "plate", "left")
    accepted = F.col("_pre").isNull() & (F.col("request_id") == F.col("_first"))
    attributes = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("make", "model", "color")]
    return j.select("request_id", "user_id", "plate", "vehicle_type", *attributes, accepted.alias("accepted"),
                    F.when(accepted, F.lit(None).cast("string"))
                     .otherwise(F.coalesce(F.col("_pre"), F.lit("duplicate_in_batch"))).alias("reason"))


def walk_in_vehicles(checkins: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Plates seen at check-in that are not registered become vehicles of
    type ``car`` without an owner: one per plate, from its earliest check-in.
    A check-in needs a plate: NULL and blank ones make no vehicle."""
    plate = F.upper(F.trim("license_plate"))
    c = checkins.withColumn("plate", plate).filter(F.col("plate") != "")
    known = vehicles.select(F.upper(F.trim("license_plate")).alias("plate"))
    unknown = c.join(known, "plate", "left_anti")
    g = unknown.groupBy("plate").agg(
        F.min_by(F.struct("ts", "event_id"), F.struct("ts", "event_id")).alias("first"),
        F.count(F.lit(1)).alias("check_ins"))
    return g.select(F.col("plate").alias("license_plate"), F.lit(WALK_IN_VEHICLE_TYPE).alias("vehicle_type"),
                    F.lit(None).cast("bigint").alias("user_id"), F.col("first.ts").alias("first_seen"),
                    F.col("first.event_id").alias("first_event_id"), "check_ins")
