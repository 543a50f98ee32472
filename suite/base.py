"""What every check query needs: the fleet over a data folder, oracles, comparable output."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fleetviews.plans.client import FleetClient
from fleetviews.plans.viewset import ViewSet
from fleetviews.session import work_dir
from fleetviews.sources.events_table import AS_OF, KINDS, EventsTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = "TIMESTAMP '2024-01-01 12:00:00'"
HOUR = timedelta(hours=1)

# The derived streams in the oracle's dialect.
STREAMS = f"""WITH base AS (
  SELECT event_id AS seq, event_id, user_id, event_type AS kind,
    'vehicle_' || lpad(CAST(user_id % 10 + 1 AS VARCHAR), 3, '0') AS vehicle_id,
    CAST(event_id * 29 % 900 AS DOUBLE) / CAST(10 AS DOUBLE) AS speed,
    CAST(5 AS DOUBLE) + CAST(event_id * 31 % 900 AS DOUBLE) / CAST(10 AS DOUBLE) AS fuel_level,
    CAST(150 AS DOUBLE) + CAST(event_id * 53 % 1100 AS DOUBLE) / CAST(10 AS DOUBLE) AS engine_temp,
    CAST(22 AS DOUBLE) + CAST(event_id * 17 % 160 AS DOUBLE) / CAST(10 AS DOUBLE) AS tire_pressure,
    CAST(11 AS DOUBLE) + CAST(event_id * 13 % 40 AS DOUBLE) / CAST(10 AS DOUBLE) AS battery_voltage,
    CAST(42 AS DOUBLE) + CAST(event_id * 37 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS latitude,
    CAST(-71.5 AS DOUBLE) + CAST(event_id * 41 % 997 AS DOUBLE) / CAST(1000 AS DOUBLE) AS longitude,
    CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity,
    make_timestamp((epoch_us(ts) - 1704067200000000) // 60 + 1704067200000000) AS t
  FROM events),
telemetry AS (
  SELECT vehicle_id, speed, fuel_level, engine_temp, tire_pressure, battery_voltage, latitude,
    longitude, t AS recorded_at, 'fleet/telemetry/' || vehicle_id || '/metrics' AS topic, seq
  FROM base WHERE kind IN ('view', 'click', 'purchase')),
alerts AS (
  SELECT vehicle_id,
    CASE event_id % 6 WHEN 0 THEN 'low_fuel' WHEN 1 THEN 'high_engine_temp'
      WHEN 2 THEN 'tire_pressure_warning' WHEN 3 THEN 'speed_limit_exceeded'
      WHEN 4 THEN 'maintenance_due' ELSE 'battery_voltage_low' END AS event_type,
    severity,
    CASE event_id % 6 WHEN 0 THEN printf('Fuel level critical: %.1f%%', fuel_level)
      WHEN 1 THEN printf('Engine temp elevated: %.1f F', engine_temp)
      WHEN 2 THEN printf('Tire pressure anomaly: %.1f psi', tire_pressure)
      WHEN 3 THEN printf('Speed %.1f mph exceeds posted limit', speed)
      WHEN 4 THEN 'Scheduled maintenance interval reached'
      ELSE printf('Battery voltage low: %.2fV', battery_voltage) END AS description,
    CASE event_id % 6 WHEN 4 THEN '{{}}' ELSE
      '{{"current_value":' || CAST(CASE event_id % 6 WHEN 0 THEN fuel_level WHEN 1 THEN engine_temp
        WHEN 2 THEN tire_pressure WHEN 3 THEN speed ELSE battery_voltage END AS VARCHAR)
      || ',"metric":"' || CASE event_id % 6 WHEN 0 THEN 'fuel_level' WHEN 1 THEN 'engine_temp'
        WHEN 2 THEN 'tire_pressure' WHEN 3 THEN 'speed' ELSE 'battery_voltage' END || '"}}' END AS payload,
    t AS occurred_at, 'fleet/events/' || vehicle_id || '/alerts/' || severity AS topic, seq
  FROM base WHERE kind = 'error'),
commands AS (
  SELECT vehicle_id,
    CASE event_id % 3 WHEN 0 THEN 'return_to_base' WHEN 1 THEN 'reduce_speed'
      ELSE 'diagnostic_check' END AS command_type,
    '{{"priority":' || CAST(event_id % 5 + 1 AS VARCHAR) || '}}' AS parameters,
    t AS issued_at, 'operator_' || CAST(user_id % 5 + 1 AS VARCHAR) AS issued_by,
    'fleet/commands/' || vehicle_id || '/' || CASE event_id % 3 WHEN 0 THEN 'return_to_base'
      WHEN 1 THEN 'reduce_speed' ELSE 'diagnostic_check' END AS topic, seq
  FROM base WHERE kind = 'signup'),
context AS (
  SELECT e.vehicle_id, e.event_type, e.severity, e.description, e.occurred_at AS alert_time,
    r.speed, r.fuel_level, r.engine_temp, r.tire_pressure, r.battery_voltage,
    r.recorded_at AS metric_time, epoch_us(e.occurred_at) - epoch_us(r.recorded_at) AS time_before_alert
  FROM alerts e JOIN telemetry r ON e.vehicle_id = r.vehicle_id
    AND r.recorded_at BETWEEN e.occurred_at - INTERVAL 2 MINUTE AND e.occurred_at),
windows AS (
  SELECT vehicle_id, time_bucket(INTERVAL 5 MINUTE, recorded_at, TIMESTAMP '1970-01-01') AS window_start,
    time_bucket(INTERVAL 5 MINUTE, recorded_at, TIMESTAMP '1970-01-01') + INTERVAL 5 MINUTE AS window_end,
    avg(speed) AS avg_speed_mph, max(speed) AS max_speed_mph, min(speed) AS min_speed_mph,
    count(*) AS sample_count
  FROM telemetry GROUP BY ALL),
summary AS (
  SELECT severity, count(*) AS alert_count, count(DISTINCT vehicle_id) AS affected_vehicles
  FROM alerts WHERE occurred_at > {NOW} - INTERVAL 1 HOUR GROUP BY severity),
activity AS (
  SELECT vehicle_id, severity, count(*) AS event_count
  FROM alerts WHERE occurred_at > {NOW} - INTERVAL 1 HOUR GROUP BY vehicle_id, severity),
metrics AS (
  SELECT vehicle_id, metric_type, value, CASE metric_type WHEN 'speed' THEN 'mph'
      WHEN 'fuel_level' THEN 'percent' WHEN 'engine_temp' THEN 'fahrenheit'
      WHEN 'tire_pressure' THEN 'psi' ELSE 'volts' END AS unit,
    latitude, longitude, topic || '/' || metric_type AS topic, recorded_at AS ts
  FROM (UNPIVOT telemetry ON speed, fuel_level, engine_temp, tire_pressure, battery_voltage
        INTO NAME metric_type VALUE value))
"""


def rounded_sql(column: str, places: int) -> str:
    return f"CAST(round(CAST({column} AS DECIMAL(38,10)), {places}) AS DOUBLE)"


class Fleet:
    """The derived streams of one data folder, with "now" at the end of the data."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def table(self) -> EventsTable:
        return EventsTable(self.spark, self.sf_dir)

    @cached_property
    def stream(self) -> EventsTable:
        return EventsTable(self.spark, self.sf_dir, streaming=True)

    @cached_property
    def views(self) -> ViewSet:
        return ViewSet.over(self.table, AS_OF)

    @cached_property
    def zoneless(self) -> ViewSet:
        """The views over times without a zone, as they are compared: converted once a row, not once a pair of rows."""
        return ViewSet(*[
            lambda kind=kind: self.table.stream_of(kind).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
            for kind in KINDS
        ], as_of=AS_OF)

    def recent_views(self, span: timedelta) -> ViewSet:
        """Views whose scans skip what lies before the span, for queries bounded by it."""
        return ViewSet.over(self.table, AS_OF, since=AS_OF - span)

    @cached_property
    def live(self) -> ViewSet:
        return ViewSet.over(self.stream, AS_OF)

    def live_after(self, cut: datetime, reach: timedelta = timedelta(0)) -> ViewSet:
        """Streaming views whose scans skip what lies before the cut, or ``reach`` before it."""
        return ViewSet.over(self.stream, AS_OF, since=cut - reach - timedelta(microseconds=1))

    def live_messages(self, cut: datetime) -> DataFrame:
        """The message stream, whose scan skips what lies before the cut."""
        return self.stream.messages(since=cut - timedelta(microseconds=1)).drop("seq")

    def until(self, cut: datetime) -> ViewSet:
        return ViewSet.over(self.table, AS_OF, until=cut)

    @cached_property
    def client(self) -> FleetClient:
        return FleetClient(self.spark, self.views)

    def recent_client(self, hours: int) -> FleetClient:
        """A client over the last hours, and the reach of a window or context before them."""
        return FleetClient(self.spark, self.recent_views(timedelta(hours=hours, minutes=5)))

    @cached_property
    def unified(self) -> DataFrame:
        return self.table.unified()

    def work(self, name: str) -> str:
        return work_dir(self.spark, name)

    @property
    def telemetry(self) -> DataFrame:
        return self.views["fleet_telemetry_raw"]

    @property
    def events(self) -> DataFrame:
        return self.views["fleet_events_raw"]

    @property
    def commands(self) -> DataFrame:
        return self.views["fleet_commands_raw"]


def _portable(f: T.StructField) -> str:
    name, kind = f"`{f.name}`", f.dataType
    if isinstance(kind, T.TimestampType):
        return f"CAST({name} AS TIMESTAMP_NTZ) AS {name}"
    if isinstance(kind, T.DecimalType):
        return f"CAST({name} AS DOUBLE) AS {name}"
    if isinstance(kind, T.DayTimeIntervalType):
        # Whole seconds and what is left of one: integers, where a decimal would cost more than the row's other work.
        seconds = f"CAST(CAST({name} AS INTERVAL SECOND) AS BIGINT)"
        left = f"CAST(CAST(({name} - {seconds} * INTERVAL '1' SECOND) * 1000000 AS INTERVAL SECOND) AS BIGINT)"
        return f"{seconds} * 1000000 + {left} AS {name}"
    if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        return f"CAST({name} AS BIGINT) AS {name}"
    return name


def comparable(df: DataFrame) -> DataFrame:
    """Portable output types: zone-less times, floating decimals, microsecond intervals."""
    return df.selectExpr(*[_portable(f) for f in df.schema.fields])


def check(name: str, oracle: str | None = None):
    """Register a query: a function of a :class:`Fleet`, and the oracle's statement.

    The statement may start with ``,`` to add tables of its own before its SELECT.
    """

    def register(build: Callable[[Fleet], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = lambda spark, sf_dir: comparable(build(Fleet(spark, sf_dir)))
        if oracle:
            ORACLES[name] = STREAMS + oracle
        return build

    return register
