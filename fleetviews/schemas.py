"""Message schemas, fixed vocabularies and validation predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F, types as T

# The message vocabularies every fleet producer and consumer shares.
SEVERITIES = ("high", "medium", "low")
EVENT_TYPES = (
    "low_fuel",
    "high_engine_temp",
    "tire_pressure_warning",
    "speed_limit_exceeded",
    "maintenance_due",
    "battery_voltage_low",
)
SENSORS = ("speed", "fuel_level", "engine_temp", "tire_pressure", "battery_voltage")
SENSOR_UNITS = {
    "speed": "mph",
    "fuel_level": "percent",
    "engine_temp": "fahrenheit",
    "tire_pressure": "psi",
    "battery_voltage": "volts",
}
LATITUDE_RANGE = (-90.0, 90.0)
LONGITUDE_RANGE = (-180.0, 180.0)
ENGINE_TEMP_LIMIT_F = 220.0
FUEL_ALERT_PCT = 10.0
# Named regions as (min latitude, max latitude, min longitude, max longitude).
REGIONS = {"boston": (42.2, 42.5, -71.2, -70.9)}
# End of fixed values.


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_STRING, _DOUBLE, _TIME = T.StringType(), T.DoubleType(), T.TimestampType()

# Bodies of the three message kinds (what the producer serialises).
TELEMETRY_BODY = _struct(
    vehicle_id=_STRING,
    **{sensor: _DOUBLE for sensor in SENSORS},
    latitude=_DOUBLE,
    longitude=_DOUBLE,
)
EVENT_BODY = _struct(
    vehicle_id=_STRING,
    event_type=_STRING,
    severity=_STRING,
    description=_STRING,
    payload=_STRING,
)
COMMAND_BODY = _struct(
    vehicle_id=_STRING, command_type=_STRING, parameters=_STRING, issued_by=_STRING
)

# What travels around a body: the envelope columns, next to the raw text.
MESSAGE = T.StructType(
    [
        T.StructField("topic", _STRING),
        T.StructField("ts", _TIME),
        T.StructField("headers", T.MapType(_STRING, _STRING)),
        T.StructField("value", _STRING),
    ]
)

UNIFIED = _struct(
    vehicle_id=_STRING,
    event_type=_STRING,
    metric_type=_STRING,
    severity=_STRING,
    value=_DOUBLE,
    unit=_STRING,
    latitude=_DOUBLE,
    longitude=_DOUBLE,
    description=_STRING,
    payload=_STRING,
    topic=_STRING,
    ts=_TIME,
)

CONNECTOR_STATUS = _struct(
    connector_name=_STRING,
    is_ready=T.BooleanType(),
    sentinel_detected_at=_TIME,
    events_before_sentinel=T.LongType(),
    total_events_consumed=T.LongType(),
    last_updated=_TIME,
)

REGISTRY_MAPPING = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("pattern", _STRING),
        T.StructField("mv", _STRING),
        T.StructField("time_column", _STRING),
        T.StructField("aggregates", T.MapType(_STRING, _STRING)),
        T.StructField("enriched", _STRING),
        T.StructField("spatial", T.MapType(_STRING, _STRING)),
    ]
)

ADDRESS_LEVEL = _struct(name=_STRING, addressLevelType=_STRING)
CATALOG_EVENT = _struct(id=_STRING, name=_STRING)
CATALOG_EVENT_VERSION = T.StructType(
    [
        T.StructField("event_id", _STRING),
        T.StructField("version", _STRING),
        T.StructField("description", _STRING),
        T.StructField("schema_version_id", _STRING),
        T.StructField("levels", T.ArrayType(ADDRESS_LEVEL)),
    ]
)
CATALOG_SCHEMA_VERSION = _struct(id=_STRING, content=_STRING)


def _within(column: str, bounds: tuple[float, float]) -> Column:
    return F.col(column).isNull() | F.col(column).between(*bounds)


def valid_telemetry() -> Column:
    """True for a reading with a vehicle and coordinates inside the globe."""
    checks = [
        F.col("vehicle_id").isNotNull(),
        _within("latitude", LATITUDE_RANGE),
        _within("longitude", LONGITUDE_RANGE),
    ]
    return reduce(Column.__and__, checks)


def valid_event() -> Column:
    """True for an alert whose type and severity belong to the vocabularies."""
    return (
        F.col("vehicle_id").isNotNull()
        & F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False))
        & F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False))
    )
