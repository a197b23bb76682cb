"""Schemas, enumerations and fixed values of the parking data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the domain's own definitions for right results).
# ---------------------------------------------------------------------------
USER_ROLES = ["admin", "staff", "customer"]
SPOT_TYPES = ["regular", "electric", "handicapped", "motorcycle"]
VEHICLE_TYPES = ["car", "motorcycle", "electric", "truck"]
PAYMENT_STATUSES = ["pending", "paid", "cancelled"]
PAYMENT_METHODS = ["cash", "card", "online", "subscription"]
RESERVATION_STATUSES = ["active", "completed", "cancelled", "expired"]
DEFAULT_HOURLY_RATE = 5.00          # parking_spots.hourly_rate default
EV_ZONE_RATE = 7.00                 # seed rate of the EV zone
CLIENT_FALLBACK_RATE = 5            # `rate || 5` in the client
SEED_SPOTS_PER_ZONE = 12
USERNAME_MIN_LEN, USERNAME_MAX_LEN = 3, 50
PASSWORD_MIN_LEN = 6
PLATE_MAX_LEN = 20
CRITICAL_MS = 5 * 60 * 1000         # countdown shown red
WARNING_MS = 15 * 60 * 1000         # countdown shown amber
DASH = "—"                    # shown for a missing phone number
CLIENT_ZONE_LABEL = "Zone "          # client zone description: "Zone " + name
ACTIVITY_CHECK_IN = "check-in"       # activity feed action labels
ACTIVITY_CHECK_OUT = "check-out"
WALK_IN_VEHICLE_TYPE = "car"         # type given to an unregistered plate at check-in
FORCED_ROLE = "customer"             # role of every self-registered user

# ---------------------------------------------------------------------------
# Table schemas (Spark types).  Ids are LongType throughout.
# ---------------------------------------------------------------------------
USERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("username", T.StringType(), False),
    T.StructField("email", T.StringType(), False),
    T.StructField("full_name", T.StringType(), False),
    T.StructField("role", T.StringType(), True),
    T.StructField("phone", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("is_active", T.BooleanType(), True),
])

ZONES = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("total_spots", T.IntegerType(), False),
    T.StructField("is_active", T.BooleanType(), True),
])

PARKING_SPOTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("spot_number", T.StringType(), False),
    T.StructField("zone_id", T.IntegerType(), False),
    T.StructField("spot_type", T.StringType(), True),
    T.StructField("is_occupied", T.BooleanType(), True),
    T.StructField("is_reserved", T.BooleanType(), True),
    T.StructField("hourly_rate", T.DecimalType(10, 2), True),
])

VEHICLES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("license_plate", T.StringType(), False),
    T.StructField("vehicle_type", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("make", T.StringType(), True),
    T.StructField("model", T.StringType(), True),
    T.StructField("color", T.StringType(), True),
    T.StructField("updated_at", T.TimestampNTZType(), True),
])

PARKING_SESSIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("vehicle_id", T.LongType(), False),
    T.StructField("spot_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("entry_time", T.TimestampNTZType(), True),
    T.StructField("exit_time", T.TimestampNTZType(), True),
    T.StructField("duration_minutes", T.IntegerType(), True),
    T.StructField("total_amount", T.DecimalType(10, 2), True),
    T.StructField("payment_status", T.StringType(), True),
    T.StructField("payment_method", T.StringType(), True),
])

RESERVATIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("spot_id", T.LongType(), False),
    T.StructField("vehicle_id", T.LongType(), True),
    T.StructField("start_time", T.TimestampNTZType(), False),
    T.StructField("end_time", T.TimestampNTZType(), False),
    T.StructField("status", T.StringType(), True),
    T.StructField("total_amount", T.DecimalType(10, 2), True),
    T.StructField("payment_status", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

LOT_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("vehicle_id", T.LongType(), False),
    T.StructField("spot_id", T.LongType(), False),
    T.StructField("action", T.StringType(), True),
    T.StructField("hours", T.IntegerType(), True),
])

EXTENSION = T.StructType([
    T.StructField("addedHours", T.IntegerType(), True),
    T.StructField("extendedAt", T.StringType(), True),
    T.StructField("newEndTime", T.StringType(), True),
])

# Nested booking document kept on a spot (client storage shape).
BOOKING = T.StructType([
    T.StructField("sessionId", T.LongType(), True),
    T.StructField("spotId", T.LongType(), True),
    T.StructField("spotNumber", T.StringType(), True),
    T.StructField("zoneName", T.StringType(), True),
    T.StructField("licensePlate", T.StringType(), True),
    T.StructField("vehicleType", T.StringType(), True),
    T.StructField("startTime", T.StringType(), True),
    T.StructField("endTime", T.StringType(), True),
    T.StructField("durationHours", T.IntegerType(), True),
    T.StructField("hourlyRate", T.DoubleType(), True),
    T.StructField("expired", T.BooleanType(), True),
    T.StructField("extensions", T.ArrayType(EXTENSION), True),
    T.StructField("totalExtendedHours", T.IntegerType(), True),
    T.StructField("bookedByUserId", T.LongType(), True),
])

SPOT_DOCUMENT = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("spot_number", T.StringType(), True),
    T.StructField("is_occupied", T.BooleanType(), True),
    T.StructField("is_reserved", T.BooleanType(), True),
    T.StructField("booking", BOOKING, True),
])

AI_PREDICTIONS = T.StructType([
    T.StructField("zone_id", T.IntegerType(), True),
    T.StructField("prediction_date", T.DateType(), False),
    T.StructField("hour", T.IntegerType(), False),
    T.StructField("predicted_occupancy", T.DecimalType(5, 2), True),
    T.StructField("actual_occupancy", T.DecimalType(5, 2), True),
    T.StructField("confidence_score", T.DecimalType(5, 2), True),
])
