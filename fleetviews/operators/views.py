"""Routing, catalog and filter views: projections and predicates, no shuffle.

Every function takes a batch or a streaming DataFrame and returns the same kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.topics import topic_like
from ..schemas import ENGINE_TEMP_LIMIT_F, FUEL_ALERT_PCT, REGIONS, SENSORS

POSITION = ("latitude", "longitude")


# --- routing views: name the envelope time after what it means in the stream ---

def telemetry_raw(source: DataFrame, time_column: str = "ts") -> DataFrame:
    return source.select(
        "vehicle_id", *SENSORS, *POSITION, F.col(time_column).alias("recorded_at"), "topic"
    )


def events_raw(source: DataFrame, time_column: str = "ts") -> DataFrame:
    return source.select(
        "vehicle_id", "event_type", "severity", "description", "payload",
        F.col(time_column).alias("occurred_at"), "topic",
    )


def commands_raw(source: DataFrame, time_column: str = "ts") -> DataFrame:
    return source.select(
        "vehicle_id", "command_type", "parameters",
        F.col(time_column).alias("issued_at"), "issued_by", "topic",
    )


# --- catalog views: one per declared event, selected by topic ---

def vehicle_alert(events: DataFrame) -> DataFrame:
    return events.where(topic_like(F.col("topic"), "fleet/events/*/alerts/*")).select(
        "vehicle_id", "event_type", "severity", "description", "payload", "occurred_at", "topic"
    )


def vehicle_command(commands: DataFrame) -> DataFrame:
    return commands.where(topic_like(F.col("topic"), "fleet/commands/*/*")).select(
        "vehicle_id", "command_type", "parameters", "issued_at"
    )


def vehicle_telemetry(telemetry: DataFrame) -> DataFrame:
    return telemetry.where(topic_like(F.col("topic"), "fleet/telemetry/*/metrics")).select(
        "vehicle_id", *SENSORS, *POSITION, "recorded_at", "topic"
    )


# --- severity tiers ---

_TIER = ("vehicle_id", "event_type", "description", "payload", "occurred_at")


def high_severity_alerts(events: DataFrame) -> DataFrame:
    return events.where(F.col("severity") == "high").select(*_TIER, "topic")


def medium_severity_alerts(events: DataFrame) -> DataFrame:
    return events.where(F.col("severity") == "medium").select(*_TIER)


def low_severity_alerts(events: DataFrame) -> DataFrame:
    return events.where(F.col("severity") == "low").select(*_TIER)


def vehicle_high_alerts(events: DataFrame, vehicle_id: str) -> DataFrame:
    """On-demand view of one vehicle's high alerts."""
    return events.where((F.col("vehicle_id") == vehicle_id) & (F.col("severity") == "high"))


# --- sensor and position views ---

def vehicle_speeds(telemetry: DataFrame) -> DataFrame:
    return telemetry.select(
        "vehicle_id", F.col("speed").alias("speed_mph"), *POSITION, "recorded_at", "topic"
    )


def vehicle_fuel_levels(telemetry: DataFrame) -> DataFrame:
    return telemetry.select("vehicle_id", F.col("fuel_level").alias("fuel_pct"), "recorded_at")


def high_engine_temp_vehicles(telemetry: DataFrame, limit_f: float = ENGINE_TEMP_LIMIT_F) -> DataFrame:
    return telemetry.where(F.col("engine_temp") > limit_f).select(
        "vehicle_id", F.col("engine_temp").alias("engine_temp_f"), "recorded_at"
    )


def vehicle_positions(telemetry: DataFrame) -> DataFrame:
    """Every reading's position (the shape behind ``vehicle_last_known_position``)."""
    return telemetry.select(
        "vehicle_id", *POSITION, F.col("speed").alias("speed_mph"), "recorded_at"
    )


def in_bbox(min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> Column:
    """Inclusive on all four sides."""
    return F.col("latitude").between(min_lat, max_lat) & F.col("longitude").between(min_lon, max_lon)


def vehicles_in_region(telemetry: DataFrame, region: str = "boston") -> DataFrame:
    return vehicle_positions(telemetry.where(in_bbox(*REGIONS[region.lower()])))


def region_of(regions: dict[str, tuple[float, float, float, float]] = REGIONS) -> Column:
    """Names of all regions a position lies in, as an array.

    Region boxes are configuration, so they compile into the projection: tagging a
    reading needs no join however many readings there are.
    """
    tags = [F.when(in_bbox(*box), F.lit(name)) for name, box in regions.items()]
    return F.array_compact(F.array(*tags))


def outside_region(telemetry: DataFrame, region: str = "boston") -> DataFrame:
    """Readings outside the region they are expected in (unknown positions excluded)."""
    return vehicle_positions(telemetry.where(~in_bbox(*REGIONS[region.lower()])))


def over_alert_budget(event_counts: DataFrame, limit: int) -> DataFrame:
    """Vehicles and severities with more alerts than allowed."""
    return event_counts.where(F.col("event_count") > limit)


# --- the unified long stream: all kinds in one relation ---

def telemetry_long(telemetry: DataFrame, units: dict[str, str], time_column: str = "ts") -> DataFrame:
    """One row per metric of each reading, addressed to the metric's own topic."""
    long = telemetry.unpivot(
        ["vehicle_id", *POSITION, "topic", time_column], list(SENSORS), "metric_type", "value"
    ).withColumn("topic", F.concat_ws("/", "topic", "metric_type"))
    unit = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])[F.col("metric_type")]
    return long.withColumn("unit", unit).withColumnRenamed(time_column, "ts")


def unified_alerts(unified: DataFrame, severity: str = "high") -> DataFrame:
    return unified.where(F.col("severity") == severity).select(
        "vehicle_id", "event_type", "severity", "description", "payload",
        F.col("ts").alias("event_timestamp"),
    )


def unified_metric(unified: DataFrame, metric: str, name: str) -> DataFrame:
    return unified.where(F.col("metric_type") == metric).select(
        "vehicle_id", F.col("value").alias(name), F.col("ts").alias("event_timestamp")
    )


def unified_fuel_alerts(unified: DataFrame, below: float = FUEL_ALERT_PCT) -> DataFrame:
    return unified_metric(unified.where(F.col("value") < below), "fuel_level", "fuel_level")


def unified_in_region(unified: DataFrame, region: str = "boston") -> DataFrame:
    return unified.where((F.col("metric_type") == "speed") & in_bbox(*REGIONS[region.lower()])).select(
        "vehicle_id", *POSITION, F.col("value").alias("speed"), F.col("ts").alias("event_timestamp")
    )


def carries_alert() -> Column:
    return F.col("severity").isNotNull()


def carries_metric() -> Column:
    return F.col("metric_type").isNotNull()


# --- optional conjunctions ---

def all_of(*conditions: Column | None) -> Column:
    """AND of the conditions that are given; true when none is."""
    return reduce(Column.__and__, [c for c in conditions if c is not None], F.lit(True))


def equals(column: str, value: str | None) -> Column | None:
    """Equality filter, absent for a missing or blank value."""
    return F.col(column) == value if value else None


def severity_is(severity: str) -> Column | None:
    """Severity filter of a live watch; ``all`` disables it."""
    return None if severity == "all" else F.col("severity") == severity
