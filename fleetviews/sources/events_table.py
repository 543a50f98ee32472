"""The fleet's three streams, derived from a plain ``events`` table.

The table has ``event_id, ts, user_id, event_type, value, props``. Users fold onto ten
vehicles and time is compressed sixty-fold, so that readings are dense enough for
two-minute correlations. ``view``, ``click`` and ``purchase`` rows become telemetry,
``error`` rows alerts and ``signup`` rows commands. Every column is an expression over
the row, so scans keep column pruning and the filter on ``event_type`` is pushed down.

The derivation is written in SQL expressions: it is long, and one ``selectExpr`` reaches
the JVM in one call.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.views import telemetry_long
from ..schemas import SENSOR_UNITS
from .messages import unified

# Time origin and compression, and the instant the data's "now" lies at.
ORIGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)
ORIGIN_MICROS = 1_704_067_200_000_000
COMPRESSION = 60
AS_OF = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
KINDS = {
    "telemetry": ("view", "click", "purchase"),
    "events": ("error",),
    "commands": ("signup",),
}
VEHICLE = "concat('vehicle_', lpad(CAST(user_id % 10 + 1 AS STRING), 3, '0'))"
TIME = (
    f"timestamp_micros((unix_micros(CAST(ts AS TIMESTAMP)) - {ORIGIN_MICROS}) div {COMPRESSION}"
    f" + {ORIGIN_MICROS})"
)
READINGS = {
    "speed": "CAST(event_id * 29 % 900 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "fuel_level": "CAST(5 AS DOUBLE) + CAST(event_id * 31 % 900 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "engine_temp": "CAST(150 AS DOUBLE) + CAST(event_id * 53 % 1100 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "tire_pressure": "CAST(22 AS DOUBLE) + CAST(event_id * 17 % 160 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "battery_voltage": "CAST(11 AS DOUBLE) + CAST(event_id * 13 % 40 AS DOUBLE) / CAST(10 AS DOUBLE)",
}
POSITION = {
    "latitude": "CAST(42 AS DOUBLE) + CAST(event_id * 37 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)",
    "longitude": "CAST(-71.5 AS DOUBLE) + CAST(event_id * 41 % 997 AS DOUBLE) / CAST(1000 AS DOUBLE)",
}
SEVERITY = "CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END"
COMMAND = (
    "CASE event_id % 3 WHEN 0 THEN 'return_to_base' WHEN 1 THEN 'reduce_speed'"
    " ELSE 'diagnostic_check' END"
)
# Alert kinds by event_id modulo 6: name, the sensor it speaks about, description.
ALERT_KINDS = (
    ("low_fuel", "fuel_level", "Fuel level critical: %.1f%%"),
    ("high_engine_temp", "engine_temp", "Engine temp elevated: %.1f F"),
    ("tire_pressure_warning", "tire_pressure", "Tire pressure anomaly: %.1f psi"),
    ("speed_limit_exceeded", "speed", "Speed %.1f mph exceeds posted limit"),
    ("maintenance_due", None, "Scheduled maintenance interval reached"),
    ("battery_voltage_low", "battery_voltage", "Battery voltage low: %.2fV"),
)
# End of fixed values.


def _per_alert_kind(outcome) -> str:
    """CASE over the alert kinds; ``outcome(name, sensor, description)`` gives each branch."""
    branches = [f"WHEN {i} THEN {outcome(*kind)}" for i, kind in enumerate(ALERT_KINDS)]
    return f"CASE event_id % {len(ALERT_KINDS)} {' '.join(branches)} END"


def _payload(_name: str, sensor: str | None, _description: str) -> str:
    if sensor is None:
        return "'{}'"
    return f"to_json(named_struct('current_value', {READINGS[sensor]}, 'metric', '{sensor}'))"


def _description(_name: str, sensor: str | None, description: str) -> str:
    return f"format_string('{description}', {READINGS[sensor]})" if sensor else f"'{description}'"


BODIES: dict[str, dict[str, str]] = {
    "telemetry": {"vehicle_id": VEHICLE, **READINGS, **POSITION},
    "events": {
        "vehicle_id": VEHICLE,
        "event_type": _per_alert_kind(lambda name, _s, _d: f"'{name}'"),
        "severity": SEVERITY,
        "description": _per_alert_kind(_description),
        "payload": _per_alert_kind(_payload),
    },
    "commands": {
        "vehicle_id": VEHICLE,
        "command_type": COMMAND,
        "parameters": "to_json(named_struct('priority', event_id % 5 + 1))",
        "issued_by": "concat('operator_', CAST(user_id % 5 + 1 AS STRING))",
    },
}
TOPICS = {
    "telemetry": f"concat_ws('/', 'fleet/telemetry', {VEHICLE}, 'metrics')",
    "events": f"concat_ws('/', 'fleet/events', {VEHICLE}, 'alerts', {SEVERITY})",
    "commands": f"concat_ws('/', 'fleet/commands', {VEHICLE}, {COMMAND})",
}
# Body fields that hold JSON and therefore nest in a message.
NESTED = {"payload": "current_value double, metric string", "parameters": "priority bigint"}


def _body_text(kind: str) -> str:
    """JSON text of a message body."""
    fields = [
        f"'{name}', from_json({value}, '{NESTED[name]}')" if name in NESTED else f"'{name}', {value}"
        for name, value in BODIES[kind].items()
    ]
    return f"to_json(named_struct({', '.join(fields)}))"


def _by_kind(outcomes: dict[str, str]) -> str:
    branches = [
        f"WHEN event_type IN ({', '.join(repr(k) for k in KINDS[kind])}) THEN {value}"
        for kind, value in outcomes.items()
    ]
    return f"CASE {' '.join(branches)} END"


class EventsTable:
    """Batch or streaming access to the derived streams of one data folder."""

    # Schemas by path: read from the file footers once, not by a job with every query.
    _schemas: dict[str, StructType] = {}

    def __init__(self, spark: SparkSession, sf_dir: str, streaming: bool = False):
        self.spark = spark
        path = f"{sf_dir}/events.parquet"
        if path not in self._schemas:
            self._schemas[path] = spark.read.parquet(path).schema
        schema = self._schemas[path]
        if streaming:
            # A stream wants a folder or a glob; the bracket makes one of a single file.
            self.raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
        else:
            self.raw = spark.read.schema(schema).parquet(path)

    def _rows(self, kind: str | None, since: datetime | None, until: datetime | None) -> DataFrame:
        """Rows of a kind with event time in (since, until].

        The bounds are stated on the stored ``ts``, where the scan can skip row groups.
        """
        rows = self.raw
        if kind:
            rows = rows.where(F.col("event_type").isin(*KINDS[kind]))
        if since:
            rows = rows.where(F.col("ts") >= _stored(since))
        if until:
            rows = rows.where(F.col("ts") < _stored(until))
        return rows

    def stream_of(self, kind: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """Typed rows of one kind, with envelope columns and a sequence number."""
        body = [f"{value} AS {name}" for name, value in BODIES[kind].items()]
        envelope = [f"{TIME} AS ts", f"{TOPICS[kind]} AS topic", "event_id AS seq"]
        return self._rows(kind, since, until).selectExpr(*body, *envelope)

    def telemetry(self, since=None, until=None) -> DataFrame:
        return self.stream_of("telemetry", since, until)

    def events(self, since=None, until=None) -> DataFrame:
        return self.stream_of("events", since, until)

    def commands(self, since=None, until=None) -> DataFrame:
        return self.stream_of("commands", since, until)

    def messages(self, since=None, until=None) -> DataFrame:
        """All kinds as one message frame with JSON bodies, plus their sequence number.

        One scan: what a row becomes depends on its own ``event_type``.
        """
        return self._rows(None, since, until).selectExpr(
            f"{_by_kind(TOPICS)} AS topic",
            f"{TIME} AS ts",
            "CAST(NULL AS MAP<STRING, STRING>) AS headers",
            f"{_by_kind({kind: _body_text(kind) for kind in BODIES})} AS value",
            "event_id AS seq",
        )

    def unified(self, since=None, until=None) -> DataFrame:
        long = telemetry_long(self.telemetry(since, until).drop("seq"), SENSOR_UNITS)
        events = self.events(since, until).drop("seq")
        commands = self.commands(since, until).select("vehicle_id", "topic", "ts")
        return unified(long, events, commands)


def _stored(bound: datetime) -> Column:
    """First stored time whose event time lies after ``bound``."""
    moved = ORIGIN + (bound - ORIGIN + timedelta(microseconds=1)) * COMPRESSION
    return F.lit(moved.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
