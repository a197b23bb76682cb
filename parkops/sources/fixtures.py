"""Map the driver tables onto the parking data model.

This module only gives rows in the schema the operators expect: it renames
and re-types columns of the given tables (rules in FIXTURES.md §1).  It does
none of the operators' work; every operator must be right on any data of
these schemas.  The one join here (session amount from the spot's rate) is a
broadcast-size-checked dimension lookup done by the planner.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Fixed clocks (FIXTURES.md §2).
AS_OF = "2024-01-30 23:59:59"
PEAK_AS_OF = "2024-02-09 12:00:00"


def _lpad_num(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def as_of_lit(ts: str) -> Column:
    return F.lit(ts).cast("timestamp_ntz")


def vehicle_action(event_type: Column) -> Column:
    return (F.when(event_type.isin("view", "signup"), F.lit("check_in"))
             .when(event_type.isin("purchase", "error"), F.lit("check_out"))
             .when(event_type == "click", F.lit("extend")))


def reservation_action(event_type: Column) -> Column:
    return (F.when(event_type.isin("view", "signup"), F.lit("reserve"))
             .when(event_type.isin("purchase", "error"), F.lit("cancel")))


def event_spot(event_id: Column) -> Column:
    # the remainder first, so large ids never overflow
    return ((event_id % F.lit(200)) * F.lit(7919)) % F.lit(200)


def props_hours(props: Column) -> Column:
    k = F.get_json_object(props, "$.k").try_cast("bigint")
    return (F.lit(1) + k % F.lit(24)).cast("int")


@dataclass
class ParkingModel:
    """Lazy parking views over one folder of driver tables."""

    spark: SparkSession
    base_dir: str
    streams: tuple[str, ...] = ()
    max_files_per_trigger: int = 64

    def raw(self, name: str) -> DataFrame:
        """A driver table; names listed in ``streams`` are read as a stream."""
        if name in self.streams:
            from .streams import read_stream_table
            return read_stream_table(self.spark, self.base_dir, name, self.max_files_per_trigger)
        return read_table(self.spark, self.base_dir, name)

    @cached_property
    def zones(self) -> DataFrame:
        n = self.raw("nation")
        return n.select(
            F.col("n_nationkey").cast("int").alias("id"),
            F.concat(F.lit("Z"), _lpad_num(F.col("n_nationkey"), 2)).alias("name"),
            F.col("n_name").alias("description"),
            F.lit(100).cast("int").alias("total_spots"),
            (F.col("n_nationkey") % 8 != 7).alias("is_active"),
            (as_of_lit("2022-05-01 00:00:00") + F.make_dt_interval(hours=F.col("n_nationkey").cast("int"))).alias("created_at"),
        )

    @cached_property
    def seed_zones(self) -> DataFrame:
        """Zones to seed a spot grid for (one per supplier row, so the grid
        grows with the data): id, name ``L<id>``, description, 12, active."""
        s = self.raw("supplier")
        return s.select(
            F.col("s_suppkey").cast("int").alias("id"),
            F.concat(F.lit("L"), F.col("s_suppkey").cast("string")).alias("name"),
            F.col("s_name").alias("description"),
            F.lit(12).cast("int").alias("total_spots"),
            F.lit(True).alias("is_active"),
        )

    @cached_property
    def spots(self) -> DataFrame:
        p = self.raw("part")
        t = F.col("p_type")
        return p.select(
            F.col("p_partkey").cast("bigint").alias("id"),
            F.concat(F.lit("S-"), _lpad_num(F.col("p_partkey"), 6)).alias("spot_number"),
            (F.col("p_size") % 24).cast("int").alias("zone_id"),
            F.when(t == "PROMO", "electric").when(t == "SMALL", "motorcycle")
             .when(t == "LARGE", "handicapped").otherwise("regular").alias("spot_type"),
            (F.col("p_partkey") % 3 == 0).alias("is_occupied"),
            (F.col("p_partkey") % 7 == 0).alias("is_reserved"),
            F.when(t == "PROMO", F.lit(7.00)).otherwise(F.lit(5.00)).cast("decimal(10,2)").alias("hourly_rate"),
            (as_of_lit("2022-06-01 00:00:00") + F.make_dt_interval(mins=(F.col("p_partkey") % 500_000).cast("int"))).alias("created_at"),
        )

    @cached_property
    def users(self) -> DataFrame:
        s = self.raw("supplier")
        k = F.col("s_suppkey")
        username = F.concat(F.lit("user"), _lpad_num(k, 6))
        return s.select(
            k.cast("bigint").alias("id"),
            username.alias("username"),
            F.concat(username, F.lit("@example.com")).alias("email"),
            F.col("s_name").alias("full_name"),
            F.when(k % 10 == 0, "admin").when(k % 10 == 1, "staff").otherwise("customer").alias("role"),
            F.when(k % 4 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("555-"), _lpad_num(k, 4))).alias("phone"),
            (as_of_lit("2022-01-01 00:00:00") + F.make_dt_interval(hours=k.cast("int"))).alias("created_at"),
            (k % 6 != 5).alias("is_active"),
        )

    @cached_property
    def vehicles(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        seg = F.col("c_mktsegment")
        return c.select(
            k.cast("bigint").alias("id"),
            F.when(k % 10 == 9, F.lit(None).cast("bigint")).otherwise(k % 10).alias("user_id"),
            F.concat(F.lit("P-"), _lpad_num(k, 8)).alias("license_plate"),
            F.when(seg == "AUTOMOBILE", "car").when(seg == "HOUSEHOLD", "electric")
             .when(seg == "FURNITURE", "motorcycle").otherwise("truck").alias("vehicle_type"),
            (as_of_lit("2023-01-01 00:00:00") + F.make_dt_interval(mins=k.cast("int"))).alias("created_at"),
            F.when(k % 6 != 0, F.concat(F.lit("Make "), (k % 6).cast("string"))).alias("make"),
            F.when(k % 6 != 0, F.concat(F.lit("Model "), (k % 40).cast("string"))).alias("model"),
            F.when(k % 3 == 0, "white").when(k % 3 == 1, "black").alias("color"),
            (as_of_lit("2023-01-01 00:00:00") + F.make_dt_interval(mins=k.cast("int"), hours=(k % 48).cast("int")))
            .alias("updated_at"),
        )

    @cached_property
    def sessions(self) -> DataFrame:
        """parking_sessions: one row per event; `error` events stay open.

        ``booked_hours`` is the duration the client books at check-in (the
        same ``props`` rule as ``lot_events.hours``)."""
        e = self.raw("events")
        et = F.col("event_type")
        base = e.select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("vehicle_id"),
            event_spot(F.col("event_id")).alias("spot_id"),
            (F.col("user_id") % 10).alias("user_id"),
            F.col("ts").alias("entry_time"),
            F.when(et == "error", F.lit(None).cast("timestamp_ntz"))
             .otherwise(F.col("ts") + F.make_dt_interval(secs=F.floor(F.col("value") * 60).cast("int")))
             .alias("exit_time"),
            F.when(et.isin("purchase", "view"), "paid").when(et == "click", "cancelled")
             .otherwise("pending").alias("payment_status"),
            F.element_at(F.array(*[F.lit(m) for m in ("cash", "card", "online", "subscription")]),
                         (F.col("event_id") % 4 + 1).cast("int")).alias("payment_method"),
            props_hours(F.col("props")).alias("booked_hours"),
        )
        minutes = F.timestamp_diff("MINUTE", F.col("entry_time"), F.col("exit_time")).cast("int")
        # one rate per spot id (the primary key); being visibly unique on the
        # key lets the optimizer drop this join when no amount is read
        rates = self.spots.groupBy(F.col("id").alias("_sid")).agg(F.max("hourly_rate").alias("_rate"))
        return (base.withColumn("duration_minutes", minutes)
                .join(rates, F.col("spot_id") == F.col("_sid"), "left")
                .withColumn("total_amount",
                            (F.ceil(F.col("duration_minutes") / F.lit(60.0)) * F.col("_rate")).cast("decimal(10,2)"))
                .select("id", "vehicle_id", "spot_id", "user_id", "entry_time", "exit_time",
                        "duration_minutes", "total_amount", "payment_status", "payment_method",
                        F.col("entry_time").alias("created_at"), "booked_hours"))

    @cached_property
    def client_sessions(self) -> DataFrame:
        """Sessions as the client keeps them: with the number of their spot."""
        return self.sessions.withColumn("spot_number", F.concat(F.lit("S-"), _lpad_num(F.col("spot_id"), 6)))

    @cached_property
    def reservations(self) -> DataFrame:
        o = self.raw("orders")
        st = F.col("o_orderstatus")
        hours = F.substring(F.col("o_orderpriority"), 1, 1).try_cast("int")
        return o.select(
            F.col("o_orderkey").alias("id"),
            (F.col("o_custkey") % 10).alias("user_id"),
            (F.col("o_orderkey") % 200).alias("spot_id"),
            F.when(F.col("o_orderkey") % 5 == 0, F.lit(None).cast("bigint"))
             .otherwise(F.col("o_custkey")).alias("vehicle_id"),
            F.col("o_orderdate").alias("start_time"),
            (F.col("o_orderdate") + F.make_dt_interval(hours=hours)).alias("end_time"),
            F.when(st == "O", "active").when(st == "F", "completed").when(st == "P", "cancelled").alias("status"),
            F.col("o_totalprice").cast("decimal(10,2)").alias("total_amount"),
            F.when(st == "F", "paid").when(st == "P", "refunded").otherwise("pending").alias("payment_status"),
            (F.col("o_orderdate") - F.make_dt_interval(days=(F.col("o_orderkey") % 9).cast("int"))).alias("created_at"),
        )

    @cached_property
    def handles(self) -> DataFrame:
        """Login handles to resolve: usernames, e-mails, unknown names."""
        c = self.raw("customer")
        k = F.col("c_custkey")
        uname = F.concat(F.lit("user"), _lpad_num(k % 16, 6))
        return c.select(
            k.cast("bigint").alias("handle_id"),
            F.when(k % 8 == 0, F.upper(uname)).when(k % 4 == 0, uname)
             .when(k % 8 == 1, F.concat(F.initcap(uname), F.lit("@Example.COM"))).when(k % 4 == 1, F.concat(uname, F.lit("@example.com")))
             .when(k % 4 == 2, F.concat(F.lit("nobody"), k.cast("string"))).otherwise(F.col("c_name"))
             .alias("handle"))

    @cached_property
    def user_import(self) -> DataFrame:
        """Registration requests: some valid, some breaking a rule, some
        taken already, some repeating a name or e-mail inside the batch."""
        c = self.raw("customer")
        k = F.col("c_custkey")
        known = F.concat(F.lit("user"), _lpad_num(k % 16, 6))
        username = (F.when(k % 5 == 0, known).when(k % 5 == 1, F.concat(F.lit("new"), _lpad_num(k % 40, 4)))
                    .when(k % 5 == 2, F.lit("ab")).otherwise(F.concat(F.lit("cust"), k.cast("string"))))
        email = (F.when(k % 7 == 0, F.lit("not-an-email"))
                 .when(k % 7 == 1, F.concat(known, F.lit("@example.com")))
                 .when(k % 7 == 2, F.concat(F.lit("shared"), (k % 30).cast("string"), F.lit("@mail.test")))
                 .otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.test"))))
        return c.select(
            k.cast("bigint").alias("request_id"), username.alias("username"), email.alias("email"),
            (k % 9 + 2).cast("int").alias("password_length"),
            F.when(k % 11 == 0, F.lit("")).otherwise(F.col("c_name")).alias("full_name"),
            F.when(k % 13 == 0, F.lit("admin")).alias("requested_role"))

    @cached_property
    def vehicle_import(self) -> DataFrame:
        """Vehicle registrations: known plates, blank plates, bad types,
        plates repeated inside the batch."""
        c = self.raw("customer")
        k = F.col("c_custkey")
        seg = F.col("c_mktsegment")
        plate = (F.when(k % 6 == 0, F.concat(F.lit("p-"), _lpad_num(k % 50, 8)))
                 .when(k % 6 == 1, F.lit("  "))
                 .when(k % 6 == 2, F.concat(F.lit("n-"), _lpad_num(k % 97, 5)))
                 .otherwise(F.concat(F.lit("N-"), k.cast("string"))))
        vtype = (F.when(k % 5 == 0, F.lit("spaceship")).when(seg == "AUTOMOBILE", "car")
                 .when(seg == "HOUSEHOLD", "electric").when(seg == "FURNITURE", "motorcycle").otherwise("truck"))
        return c.select(k.cast("bigint").alias("request_id"), (k % 10).alias("user_id"),
                        plate.alias("license_plate"), vtype.alias("vehicle_type"),
                        F.when(k % 4 == 0, F.lit("")).when(k % 4 != 1, F.concat(F.lit("Make "), (k % 6).cast("string"))).alias("make"),
                        F.when(k % 5 != 0, F.concat(F.lit("Model "), (k % 40).cast("string"))).otherwise(F.lit("")).alias("model"),
                        F.when(k % 3 == 0, F.lit("white")).when(k % 3 == 1, F.lit("")).alias("color"))

    @cached_property
    def checkin_plates(self) -> DataFrame:
        """Check-in requests by plate; every tenth comes from a walk-in."""
        e = self.lot_events("vehicle").filter(F.col("action") == "check_in")
        plate = (F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("W-"), _lpad_num(F.col("event_id") % 300, 6)))
                 .otherwise(F.concat(F.lit("P-"), _lpad_num(F.col("vehicle_id"), 8))))
        return e.select("event_id", "ts", "spot_id", plate.alias("license_plate"))

    @cached_property
    def user_changes(self) -> DataFrame:
        """User change log: profile edits, role changes, deletes, inserts."""
        o = self.raw("orders")
        k = F.col("o_orderkey")
        uid = (F.col("o_custkey") % 16).cast("bigint")
        r = k % 20
        op = (F.when(r == 0, "delete").when(r == 1, "insert").when((r >= 2) & (r <= 7), "role")
              .otherwise("profile"))
        uname = F.concat(F.lit("user"), _lpad_num(uid, 6))
        return o.select(
            k.alias("change_id"), uid.alias("user_id"), op.alias("op"),
            (F.col("o_orderdate") + F.make_dt_interval(secs=(k % 86400).cast("int"))).alias("changed_at"),
            uname.alias("username"), F.concat(uname, F.lit("@example.com")).alias("email"),
            F.concat(F.lit("Name "), k.cast("string")).alias("full_name"),
            F.when(k % 3 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("555-"), _lpad_num(k % 10000, 4))).alias("phone"),
            F.when(k % 3 == 0, "customer").when(k % 3 == 1, "staff").otherwise("admin").alias("role"))

    @cached_property
    def spot_flag_changes(self) -> DataFrame:
        """Flag changes of spots: even events act on ``is_occupied``, odd ones on ``is_reserved``."""
        e = self.raw("events")
        kind, even = F.col("event_type"), F.col("event_id") % 2 == 0
        action = F.when(even, F.when(kind == "click", None).otherwise(vehicle_action(kind))).otherwise(reservation_action(kind))
        return e.select("event_id", "ts", event_spot(F.col("event_id")).alias("spot_id"), action.alias("action"))

    @cached_property
    def reservation_changes(self) -> DataFrame:
        """Status and payment changes of reservations, one per order line."""
        li = self.raw("lineitem")
        flag = F.col("l_returnflag")
        return li.select(
            F.col("l_orderkey").alias("reservation_id"), F.col("l_shipdate").alias("changed_at"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("change_id"),
            F.when(flag == "R", "cancelled").when(flag == "A", "completed").alias("status"),
            F.when(F.col("l_linestatus") == "F", F.when(flag == "R", "refunded").otherwise("paid")).alias("payment_status"))

    @cached_property
    def ai_predictions(self) -> DataFrame:
        """One stored prediction per event."""
        e = self.raw("events")
        return e.select(
            F.col("event_id").alias("id"), (F.col("event_id") % 25).cast("int").alias("zone_id"),
            F.to_date("ts").alias("prediction_date"), F.hour("ts").cast("int").alias("hour"),
            (F.col("event_id") % 101).cast("decimal(5,2)").alias("predicted_occupancy"))

    @cached_property
    def audit_logs(self) -> DataFrame:
        """One audit entry per order; every ninth has no user."""
        o = self.raw("orders")
        k = F.col("o_orderkey")
        return o.select(
            k.alias("id"), F.when(k % 9 != 0, F.col("o_custkey") % 16).alias("user_id"),
            F.when(k % 2 == 0, "login").otherwise("reserve").alias("action"), F.lit("reservation").alias("entity_type"),
            k.alias("entity_id"), F.col("o_orderdate").alias("created_at"))

    @cached_property
    def spot_documents(self) -> DataFrame:
        """Client-storage spot documents as JSON text, one per event: a spot
        with an optional booking holding 0-2 extension records."""
        from .documents import iso_text
        e = self.raw("events")
        k = F.get_json_object(F.col("props"), "$.k").try_cast("bigint")
        hours = (F.lit(1) + k % 24).cast("int")
        spot = event_spot(F.col("event_id"))
        number = F.concat(F.lit("S-"), _lpad_num(spot, 6))
        n_ext = (k % 3).cast("int")
        end = F.col("ts") + F.make_dt_interval(hours=hours)
        exts = F.filter(F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.struct(
            i.alias("addedHours"),
            iso_text(F.col("ts") + F.make_dt_interval(mins=i * 10)).alias("extendedAt"),
            iso_text(end + F.make_dt_interval(hours=((i * (i + 1)) / 2).cast("int"))).alias("newEndTime"))),
            lambda x: x["addedHours"] <= n_ext)
        booking = F.when(k % 4 == 0, F.lit(None)).otherwise(F.struct(
            F.col("event_id").alias("sessionId"), spot.alias("spotId"), number.alias("spotNumber"),
            F.concat(F.lit("Z"), _lpad_num(spot % 24, 2)).alias("zoneName"),
            F.concat(F.lit("P-"), _lpad_num(F.col("user_id"), 8)).alias("licensePlate"),
            F.when(F.col("user_id") % 2 == 0, "car").otherwise("electric").alias("vehicleType"),
            iso_text(F.col("ts")).alias("startTime"), iso_text(end).alias("endTime"),
            hours.alias("durationHours"), F.when(k % 5 == 0, F.lit(7.0)).otherwise(F.lit(5.0)).alias("hourlyRate"),
            (k % 2 == 0).alias("expired"), exts.alias("extensions"), ((n_ext * (n_ext + 1)) / 2).cast("int").alias("totalExtendedHours"),
            (F.col("user_id") % 10).alias("bookedByUserId")))
        doc = F.to_json(F.struct(spot.alias("id"), number.alias("spot_number"),
                                 (F.col("event_type") != "error").alias("is_occupied"),
                                 (F.col("event_id") % 7 == 0).alias("is_reserved"), booking.alias("booking")))
        # some were cut off when they were stored
        doc = F.when(F.col("event_id") % 50 == 49, F.substring(doc, 1, 30)).otherwise(doc)
        return e.select(F.col("event_id").alias("doc_id"), doc.alias("doc"))

    def delete_lists(self) -> dict[str, DataFrame]:
        """Ids to delete per table."""
        return {
            "zones": self.zones.filter(F.col("id") % 11 == 3).select("id"),
            "users": self.users.filter(F.col("id") % 7 == 3).select("id"),
            "vehicles": self.vehicles.filter(F.col("id") % 13 == 5).select("id"),
            "parking_spots": self.spots.filter(F.col("id") % 17 == 4).select("id"),
        }

    def lot_events(self, log: str = "vehicle") -> DataFrame:
        """Event log for pairing (``vehicle``) or reservation admission (``reservation``)."""
        e = self.raw("events")
        action = vehicle_action(F.col("event_type")) if log == "vehicle" else reservation_action(F.col("event_type"))
        return e.select(
            F.col("event_id"), F.col("ts"),
            F.col("user_id").alias("vehicle_id"),
            event_spot(F.col("event_id")).alias("spot_id"),
            action.alias("action"),
            props_hours(F.col("props")).alias("hours"),
        )


def model(spark: SparkSession, base_dir: str, streams: tuple[str, ...] = (),
          max_files_per_trigger: int = 64) -> ParkingModel:
    return ParkingModel(spark, base_dir, streams, max_files_per_trigger)
