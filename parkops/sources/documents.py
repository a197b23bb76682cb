"""Nested spot documents (spot + booking struct + extension array) as JSON.

Parsing uses ``from_json`` with the explicit nested schema (no inference),
struct field access and ``posexplode_outer`` so a spot without a booking or
a booking without extensions still gives one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import BOOKING, SPOT_DOCUMENT

# Fixed value: ISO-8601 text as written by JavaScript's toISOString().
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO_FORMAT)


def iso_time(text: Column) -> Column:
    """NULL for a text that is no such time; one bad document never stops the job."""
    return F.try_to_timestamp(text, F.lit(ISO_FORMAT)).cast("timestamp_ntz")


_CORRUPT = "_corrupt"
#: Fields of a document's booking and the columns they become.
_BOOKING = {"sessionId": "session_id", "zoneName": "zone_name", "licensePlate": "license_plate", "vehicleType": "vehicle_type",
            "startTime": "start_time", "endTime": "end_time", "durationHours": "duration_hours", "hourlyRate": "hourly_rate",
            "expired": "expired", "totalExtendedHours": "total_extended_hours", "bookedByUserId": "booked_by_user_id"}
_EXTENSION = {"addedHours": "added_hours", "extendedAt": "extended_at", "newEndTime": "new_end_time"}
_TIMES = ("startTime", "endTime", "extendedAt", "newEndTime")
_SPOT = ("spot_number", "is_occupied", "is_reserved")


def booking_json_flatten(docs: DataFrame, doc_col: str = "doc", id_col: str = "doc_id") -> DataFrame:
    """One row per (spot document, extension) with all fields; documents without a booking or
    without extensions keep one row with NULL extension fields.

    ``has_booking`` tells a missing booking from one with empty fields.  A text that is no such document
    comes whole in ``corrupt``, with all other fields NULL; ``doc_id`` comes along if ``docs`` has it."""
    schema = T.StructType([*SPOT_DOCUMENT.fields, T.StructField(_CORRUPT, T.StringType())])
    d = F.from_json(F.col(doc_col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    ids = [c for c in (id_col,) if c in docs.columns]
    parsed = docs.select(*ids, d.alias("p")).select(*ids, F.when(F.col(f"p.{_CORRUPT}").isNull(), F.col("p")).alias("d"),
                                                    F.col(f"p.{_CORRUPT}").alias("corrupt"))

    def field(name, c):
        return iso_time(c) if name in _TIMES else c

    flat = parsed.select(
        *ids, F.col("d.id").alias("spot_id"), *[F.col(f"d.{c}").alias(c) for c in _SPOT],
        F.when(F.col("d").isNotNull(), F.col("d.booking").isNotNull()).alias("has_booking"),
        *[field(name, F.col(f"d.booking.{name}")).alias(c) for name, c in _BOOKING.items()],
        F.posexplode_outer(F.col("d.booking.extensions")).alias("ext_pos", "ext"), "corrupt")
    return flat.select(*[c for c in flat.columns if c not in ("ext", "corrupt")],
                       *[field(name, F.col(f"ext.{name}")).alias(c) for name, c in _EXTENSION.items()], "corrupt")


def booking_documents(flat: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, doc``: the documents of :func:`booking_json_flatten`'s rows, one per id; its inverse.

    Extensions come in the order of ``ext_pos``; a corrupt text comes back as it was.  One document's
    extensions meet in one row, as in the document."""
    def text(name, c):
        return iso_text(c) if name in _TIMES else c

    ext = F.struct("ext_pos", *[text(name, F.col(c)).alias(name) for name, c in _EXTENSION.items()])
    head = ["spot_id", *_SPOT, "has_booking", *_BOOKING.values(), "corrupt"]
    g = flat.groupBy(id_col).agg(*[F.first(c).alias(c) for c in head],
                                 F.sort_array(F.collect_list(F.when(F.col("ext_pos").isNotNull(), ext))).alias("exts"))
    exts = F.transform("exts", lambda e: F.struct(*[e[name].alias(name) for name in _EXTENSION]))
    made = {name: text(name, F.col(c)) for name, c in _BOOKING.items()} | {
        "spotId": F.col("spot_id"), "spotNumber": F.col("spot_number"), "extensions": exts}
    booking = F.when(F.col("has_booking"), F.struct(*[made[f.name].alias(f.name) for f in BOOKING.fields]))
    doc = F.to_json(F.struct(F.col("spot_id").alias("id"), *_SPOT, booking.alias("booking")))
    # neither a document nor a corrupt text: there was no text
    return g.select(id_col, F.coalesce("corrupt", F.when(F.col("has_booking").isNotNull(), doc)).alias("doc"))
