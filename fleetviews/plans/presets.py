"""Preset, tool and walkthrough queries over a :class:`ViewSet`.

Each is a composition of a view, optional filters, a projection and a top-k. They are
data: one table row per query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timing import interval, moment, preset_duration
from ..functions.topics import topic_matches
from ..functions.values import rounded
from ..operators import joins, topk
from ..operators.views import all_of, carries_alert, carries_metric, equals
from ..operators.windows import unified_speed_avg, vehicle_speed_avg
from .viewset import ViewSet

WINDOW_WIDTH = timedelta(minutes=5)
# How far back the newest rows are looked for, step by step, before everything is read.
STRETCHES = tuple(timedelta(hours=8**n) for n in range(6))


def _round_as(places: int, **names: str) -> list[Column]:
    """``alias=column`` pairs, rounded."""
    return [rounded(F.col(c), places).alias(alias) for alias, c in names.items()]


def _context(short: bool) -> list:
    """Sensor columns of the context row: unit-bearing names, or the sensors' own."""
    one = (
        dict(speed_mph="speed", fuel_pct="fuel_level", engine_temp_f="engine_temp", psi="tire_pressure")
        if short else {s: s for s in ("speed", "fuel_level", "engine_temp", "tire_pressure")}
    )
    volts = {"volts" if short else "battery_voltage": "battery_voltage"}
    return [
        "vehicle_id", "event_type", "severity", "description", "alert_time",
        *_round_as(1, **one), *_round_as(2, **volts), "time_before_alert",
    ]


def _positions(places: int) -> list:
    return [
        "vehicle_id", *_round_as(places, lat="latitude", lon="longitude"),
        *_round_as(1, speed_mph="speed_mph"), "recorded_at",
    ]


@dataclass(frozen=True)
class Preset:
    label: str
    category: str
    view: str
    columns: Callable[[], list]
    time_column: str | None
    by_vehicle: bool = True
    by_severity: bool = False


_ALERT = ["vehicle_id", "event_type", "description", "occurred_at"]

PRESETS: dict[str, Preset] = {
    "fleet_alert_summary": Preset(
        "Fleet Alert Summary", "Alerts", "fleet_alert_summary",
        lambda: ["severity", "alert_count", "affected_vehicles"], None, by_vehicle=False),
    "high_alerts": Preset(
        "High Severity Alerts", "Alerts", "high_severity_alerts",
        lambda: [*_ALERT, "topic"], "occurred_at"),
    "medium_alerts": Preset(
        "Medium Severity Alerts", "Alerts", "medium_severity_alerts", lambda: _ALERT, "occurred_at"),
    "low_alerts": Preset(
        "Low Severity Alerts", "Alerts", "low_severity_alerts", lambda: _ALERT, "occurred_at"),
    "all_alerts": Preset(
        "All Alerts", "Alerts", "fleet_events_raw",
        lambda: ["vehicle_id", "severity", "event_type", "description", "occurred_at", "topic"],
        "occurred_at", by_severity=True),
    "alerts_context": Preset(
        "Alerts With Context", "Alerts", "alerts_with_context",
        lambda: _context(True), "alert_time", by_severity=True),
    "vehicle_activity": Preset(
        "Vehicle Activity (1h)", "Alerts", "vehicle_event_counts_1h",
        lambda: ["vehicle_id", "severity", "event_count"], None, by_severity=True),
    "speed_averages": Preset(
        "Speed Averages (5-min)", "Telemetry", "vehicle_speed_5min_avg",
        lambda: ["vehicle_id", "window_start", "window_end",
                 *_round_as(1, avg_mph="avg_speed_mph", max_mph="max_speed_mph", min_mph="min_speed_mph"),
                 "sample_count"],
        "window_end"),
    "fuel_levels": Preset(
        "Fuel Levels", "Telemetry", "vehicle_fuel_levels",
        lambda: ["vehicle_id", *_round_as(1, fuel_pct="fuel_pct"), "recorded_at"], "recorded_at"),
    "high_engine_temp": Preset(
        "High Engine Temp", "Telemetry", "high_engine_temp_vehicles",
        lambda: ["vehicle_id", *_round_as(1, engine_temp_f="engine_temp_f"), "recorded_at"], "recorded_at"),
    "last_positions": Preset(
        "Last Known Positions", "Telemetry", "vehicle_last_known_position",
        lambda: _positions(4), "recorded_at"),
    "boston_region": Preset(
        "Boston Region", "Telemetry", "vehicles_in_region_boston",
        lambda: _positions(4), "recorded_at", by_vehicle=False),
}


def _stretches(views: ViewSet) -> list[datetime]:
    """Lower bounds of ever longer stretches before "now", where that is an instant."""
    now = views.as_of or datetime.now(timezone.utc)
    if not isinstance(now, datetime):
        return []
    now = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    return [now - span for span in STRETCHES]


def _holds(rows: DataFrame, k: int) -> bool:
    return rows.limit(k).count() >= k


def newest_windows(views: ViewSet, k: int, vehicle_id: str | None = None) -> DataFrame:
    """Speed windows among which are the k newest: those of the shortest stretch that has k.

    Windows that a bound could cut are left out of their stretch. Each stretch is eight times
    the one before, so a search reads little more than what it ends with, and nothing older.
    """
    def windows(of: ViewSet) -> DataFrame:
        return of["vehicle_speed_5min_avg"].where(all_of(equals("vehicle_id", vehicle_id)))

    for since in _stretches(views):
        rows = windows(views.newer(since)).where(F.col("window_start") > moment(since))
        if _holds(rows, k):
            return rows
    return windows(views)


def _newest_stretch(views: ViewSet, k: int, kept: Column) -> tuple[DataFrame, DataFrame]:
    """Alerts that pass ``kept`` and readings of the shortest stretch with k alerts that have context."""
    for since in _stretches(views):
        narrow = views.newer(since - joins.TWO_MINUTES)
        alerts = narrow["fleet_events_raw"].where(kept & (F.col("occurred_at") > moment(since)))
        readings = narrow["fleet_telemetry_raw"]
        if _holds(joins.alerts_that_have_context(alerts, readings).select("occurred_at"), k):
            return alerts, readings
    return views["fleet_events_raw"].where(kept), views["fleet_telemetry_raw"]


def context_top(
    views: ViewSet,
    k: int,
    since: timedelta | None = None,
    vehicle_id: str | None = None,
    severity: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Candidates for the k newest alert-context rows, with the filters below the join.

    ``pattern`` keeps alerts whose own topic it covers.
    """
    bound = moment(views.as_of) - interval(since) if since else None
    kept = all_of(
        equals("vehicle_id", vehicle_id),
        equals("severity", severity),
        F.col("occurred_at") > bound if since else None,
        topic_matches(F.col("topic"), pattern) if pattern else None,
    )
    if since:
        events, telemetry = views["fleet_events_raw"].where(kept), views["fleet_telemetry_raw"]
    else:
        events, telemetry = _newest_stretch(views, k, kept)
    telemetry = telemetry.where(all_of(
        equals("vehicle_id", vehicle_id),
        F.col("recorded_at") > bound - interval(joins.TWO_MINUTES) if since else None,
    ))
    return joins.newest_alerts_with_context(events, telemetry, k, max_group_rows=views.max_group_rows)


def _recent_windows(views: ViewSet, since: timedelta) -> DataFrame:
    """Speed windows ending after the bound, aggregated from only their own readings."""
    bound = moment(views.as_of) - interval(since)
    inside = F.col("recorded_at") > bound - interval(WINDOW_WIDTH)
    return vehicle_speed_avg(views["fleet_telemetry_raw"].where(inside)).where(F.col("window_end") > bound)


def preset(
    views: ViewSet,
    name: str,
    since: str | None = None,
    vehicle_id: str | None = None,
    severity: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """Run a preset. Filters a preset does not support are ignored; so is an unknown duration."""
    if name not in PRESETS:
        raise KeyError(f"unknown preset {name!r}")
    spec = PRESETS[name]
    k = limit
    span = preset_duration(since) if spec.time_column else None
    vehicle = vehicle_id if spec.by_vehicle else None
    level = severity if spec.by_severity else None

    if spec.view == "fleet_alert_summary":
        return topk.by_severity(views[spec.view].select(*spec.columns()))
    if spec.view == "alerts_with_context":
        rows = context_top(views, k, span, vehicle, level)
        return _newest_context(rows, spec.columns(), k)
    if spec.view == "vehicle_speed_5min_avg":
        if span:
            rows = _recent_windows(views, span).where(all_of(equals("vehicle_id", vehicle)))
        else:
            rows = newest_windows(views, k, vehicle)
        return topk.latest_windows(rows.select(*spec.columns()), k)
    bound = moment(views.as_of) - interval(span) if span else None
    asked = [F.col(spec.time_column) > bound if span else None, equals("vehicle_id", vehicle), equals("severity", level)]
    kept = all_of(*asked) if any(c is not None for c in asked) else None
    if spec.view == "vehicle_event_counts_1h":
        rows = views[spec.view] if kept is None else views[spec.view].where(kept)
        return topk.most_active(rows.select(*spec.columns()), k)
    rows = views.newest_rows(spec.view, spec.time_column, k, kept)
    return topk.newest(rows.select(*spec.columns()), spec.time_column, k)


def _newest_context(rows: DataFrame, columns: list, k: int) -> DataFrame:
    """Newest alerts first; inside one alert the reading nearest to it first."""
    order = [topk.descending("alert_time"), topk.ascending("vehicle_id"), topk.ascending("time_before_alert")]
    rest = [c for c in ("severity", "event_type", "description") if c in rows.columns]
    return rows.select(*columns).orderBy(*order, *[topk.ascending(c) for c in rest]).limit(k)


# --- tool queries; limits are the caller's ---


def get_fleet_alert_summary(views: ViewSet) -> DataFrame:
    return preset(views, "fleet_alert_summary")


def get_high_severity_alerts(views: ViewSet, limit: int = 10) -> DataFrame:
    rows = views.newest_rows("high_severity_alerts", "occurred_at", limit)
    return topk.newest(rows.select(*_ALERT), "occurred_at", limit)


def get_vehicle_speed_averages(views: ViewSet, limit: int = 20) -> DataFrame:
    rows = newest_windows(views, limit).select(
        "vehicle_id", *_round_as(1, avg_mph="avg_speed_mph", max_mph="max_speed_mph"),
        "sample_count", "window_end",
    )
    return topk.latest_windows(rows, limit)


def get_alerts_with_context(views: ViewSet, limit: int = 10) -> DataFrame:
    return _newest_context(context_top(views, limit), _context(False), limit)


def get_vehicles_in_boston(views: ViewSet, limit: int = 20) -> DataFrame:
    rows = views.newest_rows("vehicles_in_region_boston", "recorded_at", limit)
    return topk.newest(rows.select(*_positions(4)), "recorded_at", limit)


def get_vehicle_activity(views: ViewSet, limit: int = 20) -> DataFrame:
    return topk.most_active(views["vehicle_event_counts_1h"], limit)


def get_vehicle_details(views: ViewSet, vehicle_id: str, limit: int = 10) -> DataFrame:
    """Newest high alerts of one vehicle."""
    rows = views["fleet_events_raw"].where(
        (F.col("vehicle_id") == vehicle_id) & (F.col("severity") == "high")
    )
    return topk.newest(
        rows.select("vehicle_id", "event_type", "severity", "description", "occurred_at"),
        "occurred_at", limit,
    )


TOOLS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        get_fleet_alert_summary, get_high_severity_alerts, get_vehicle_speed_averages,
        get_alerts_with_context, get_vehicles_in_boston, get_vehicle_activity, get_vehicle_details,
    )
}


# --- walkthrough queries ---

def newest_high_alerts(views: ViewSet) -> DataFrame:
    return get_high_severity_alerts(views, 20)


def newest_speeds(views: ViewSet) -> DataFrame:
    rows = views.newest_rows("vehicle_speeds", "recorded_at", 20)
    return topk.newest(rows.select("vehicle_id", "speed_mph", "latitude", "longitude", "recorded_at"), "recorded_at", 20)


def newest_speed_windows(views: ViewSet) -> DataFrame:
    rows = newest_windows(views, 20).select(
        "vehicle_id", "window_start", "window_end",
        *_round_as(2, avg_mph="avg_speed_mph", max_mph="max_speed_mph"), "sample_count",
    )
    return topk.latest_windows(rows, 20)


def alert_summary(views: ViewSet) -> DataFrame:
    return preset(views, "fleet_alert_summary")


def context_long(views: ViewSet, k: int = 10) -> DataFrame:
    """Alert context in long format."""
    events, telemetry = _newest_stretch(views, k, F.lit(True))
    kth = joins.kth_newest_with_context(events, telemetry, k)
    rows = joins.alerts_with_long_context(
        events.where(F.col("occurred_at") >= kth),
        telemetry.where(F.col("recorded_at") >= kth - interval(joins.TWO_MINUTES)),
    ).select(
        "vehicle_id", "event_type", "severity", "description", "alert_time", "metric_type",
        rounded(F.col("metric_value"), 2).alias("metric_value"), "unit", "time_before_alert",
    )
    order = [topk.descending("alert_time"), *[
        topk.ascending(c) for c in ("vehicle_id", "time_before_alert", "metric_type", "event_type")
    ]]
    return rows.orderBy(*order).limit(k)


def geofence_positions(views: ViewSet) -> DataFrame:
    return topk.newest(views["vehicles_in_region_boston"].select(*_positions(5)), "recorded_at", 10)


def activity_heatmap(views: ViewSet) -> DataFrame:
    return topk.most_active(views["vehicle_event_counts_1h"], 20)


def readme_windows(views: ViewSet) -> DataFrame:
    rows = newest_windows(views, 20).select(
        "vehicle_id", "window_start", "window_end", *_round_as(2, avg_mph="avg_speed_mph"), "sample_count"
    )
    return topk.latest_windows(rows, 20)


def readme_context(views: ViewSet) -> DataFrame:
    return _newest_context(
        context_top(views, 10),
        ["vehicle_id", "event_type", "severity", "speed", "engine_temp", "alert_time", "time_before_alert"],
        10,
    ).drop("alert_time")


def readme_geofence(views: ViewSet) -> DataFrame:
    rows = views["vehicles_in_region_boston"].select(
        "vehicle_id", "latitude", "longitude", "speed_mph", "recorded_at"
    )
    return topk.newest(rows, "recorded_at", 10).drop("recorded_at")


def verification(unified: DataFrame) -> DataFrame:
    """Five newest high alerts after a backfill."""
    rows = unified.where(F.col("severity") == "high").select(
        "vehicle_id", "severity", F.col("ts").alias("event_timestamp")
    )
    return topk.newest(rows, "event_timestamp", 5)


def live_windows(unified: DataFrame) -> DataFrame:
    """Five newest speed windows, as a live loop shows them."""
    rows = unified_speed_avg(unified).select("vehicle_id", "avg_speed", "window_end")
    return topk.latest_windows(rows, 5).drop("window_end")

