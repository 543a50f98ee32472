"""The eighteen named views over three source streams."""

from __future__ import annotations

import copy
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.timing import moment
from ..operators import joins, rolling, views, windows
from ..sources.zones import ZonedView

# View -> the views it reads. Order is creation order; teardown is the reverse.
DEPENDENCIES: dict[str, tuple[str, ...]] = {
    "fleet_telemetry_raw": (),
    "fleet_events_raw": (),
    "fleet_commands_raw": (),
    "vehicle_alert": ("fleet_events_raw",),
    "vehicle_command": ("fleet_commands_raw",),
    "vehicle_telemetry": ("fleet_telemetry_raw",),
    "high_severity_alerts": ("fleet_events_raw",),
    "medium_severity_alerts": ("fleet_events_raw",),
    "low_severity_alerts": ("fleet_events_raw",),
    "vehicle_speeds": ("fleet_telemetry_raw",),
    "vehicle_speed_5min_avg": ("fleet_telemetry_raw",),
    "fleet_alert_summary": ("fleet_events_raw",),
    "vehicle_fuel_levels": ("fleet_telemetry_raw",),
    "high_engine_temp_vehicles": ("fleet_telemetry_raw",),
    "alerts_with_context": ("fleet_events_raw", "fleet_telemetry_raw"),
    "vehicles_in_region_boston": ("fleet_telemetry_raw",),
    "vehicle_last_known_position": ("fleet_telemetry_raw",),
    "vehicle_event_counts_1h": ("fleet_events_raw",),
}

# A source stream, or a function that gives it when a view first needs it.
Source = DataFrame | Callable[[], DataFrame]

ROUTING = ("fleet_telemetry_raw", "fleet_events_raw", "fleet_commands_raw")


class ViewSet:
    """Lazy views by name. Nothing runs until a returned DataFrame is used.

    Views stack by composing DataFrames, so the optimizer sees through the whole stack
    and prunes columns and rows at the scan. A view that must persist is written by
    :mod:`fleetviews.plans.lifecycle`. ``max_group_rows`` splits oversized groups of the
    context join (batch views only).
    """

    def __init__(
        self,
        telemetry: Source,
        events: Source,
        commands: Source,
        as_of=None,
        time_column: str = "ts",
        max_group_rows: int | None = None,
    ):
        def routing(view, source: Source) -> Callable[[], DataFrame]:
            return lambda: view(source() if callable(source) else source, time_column)

        def bounded(source: Source, since: datetime) -> Source:
            return lambda: (source() if callable(source) else source).where(F.col(time_column) > moment(since))

        self._routing = routing
        # The three sources with a strict lower bound on their time.
        self._newer_sources: Callable[[datetime], tuple[Source, ...]] = lambda since: tuple(
            bounded(source, since) for source in (telemetry, events, commands)
        )
        self.as_of = as_of
        self.max_group_rows = max_group_rows
        self._built: dict[str, DataFrame] = {}
        self._zoned: dict[str, ZonedView] = {}
        self._makers: dict[str, Callable[..., DataFrame]] = {
            "fleet_telemetry_raw": routing(views.telemetry_raw, telemetry),
            "fleet_events_raw": routing(views.events_raw, events),
            "fleet_commands_raw": routing(views.commands_raw, commands),
            "vehicle_alert": views.vehicle_alert,
            "vehicle_command": views.vehicle_command,
            "vehicle_telemetry": views.vehicle_telemetry,
            "high_severity_alerts": views.high_severity_alerts,
            "medium_severity_alerts": views.medium_severity_alerts,
            "low_severity_alerts": views.low_severity_alerts,
            "vehicle_speeds": views.vehicle_speeds,
            "vehicle_speed_5min_avg": windows.vehicle_speed_avg,
            "fleet_alert_summary": lambda e: rolling.fleet_alert_summary(e, as_of),
            "vehicle_fuel_levels": views.vehicle_fuel_levels,
            "high_engine_temp_vehicles": views.high_engine_temp_vehicles,
            "alerts_with_context": lambda e, t: joins.alerts_with_context(e, t, max_group_rows=max_group_rows),
            "vehicles_in_region_boston": views.vehicles_in_region,
            "vehicle_last_known_position": views.vehicle_positions,
            "vehicle_event_counts_1h": lambda e: rolling.vehicle_event_counts(e, as_of),
        }
        self.dependencies = dict(DEPENDENCIES)

    @classmethod
    def over(cls, table, as_of=None, since=None, until=None) -> "ViewSet":
        """Views over the streams of a table adapter (``telemetry/events/commands``).

        ``since`` (exclusive) and ``until`` bound what the adapter scans.
        """
        def sources(bound) -> tuple[Source, ...]:
            return (
                lambda: table.telemetry(bound, until),
                lambda: table.events(bound, until),
                lambda: table.commands(bound, until),
            )

        found = cls(*sources(since), as_of)
        found._newer_sources = lambda bound: sources(max(since, bound) if since else bound)
        return found

    def newer(self, since: datetime) -> "ViewSet":
        """The same views over rows after ``since`` only, bounded where the sources are read."""
        other = copy.copy(self)
        other._built, other._zoned, other._makers = {}, {}, dict(self._makers)
        other.dependencies = dict(self.dependencies)
        shapes = (views.telemetry_raw, views.events_raw, views.commands_raw)
        for name, shape, source in zip(ROUTING, shapes, self._newer_sources(since)):
            other._makers[name] = self._routing(shape, source)
        return other

    def names(self) -> list[str]:
        return list(self.dependencies)

    def __contains__(self, name: str) -> bool:
        return name in self.dependencies

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name not in self._makers:
                raise KeyError(f"no view named {name!r}")
            self._built[name] = self._makers[name](*[self[d] for d in self.dependencies[name]])
        return self._built[name]

    def save(self, name: str, path: str, time_column: str) -> ZonedView:
        """Save a view by day with its zone map. From now on it is read from there, and its newest rows
        without older days; views that depend on it and were not built yet read it too."""
        zoned = ZonedView.save(self[name], path, time_column)
        self._zoned[name], self._built[name] = zoned, zoned.read()
        return zoned

    def newest_rows(self, name: str, time_column: str, k: int, kept: Column | None = None) -> DataFrame:
        """Rows of a view that pass, among which are the k newest; of a saved view not more than that needs."""
        zoned = self._zoned.get(name)
        if zoned is not None and zoned.time_column == time_column:
            return zoned.newest_rows(k, kept)
        return self[name] if kept is None else self[name].where(kept)

    def define(self, name: str, depends_on: tuple[str, ...], maker: Callable[..., DataFrame]) -> None:
        """Add a view; an existing name is an error."""
        if name in self:
            raise ValueError(f"view {name!r} exists; drop it first")
        self.dependencies[name] = depends_on
        self._makers[name] = maker

    def define_if_missing(self, name: str, depends_on: tuple[str, ...], maker) -> bool:
        if name in self:
            return False
        self.define(name, depends_on, maker)
        return True

    def dependents(self, name: str) -> list[str]:
        """Views that read ``name`` directly or through others, deepest first."""
        found: list[str] = []
        for view in self.dependencies:
            reads = self.dependencies[view]
            if name in reads or any(r in found for r in reads):
                found.append(view)
        return found[::-1]

    def drop(self, name: str, cascade: bool = False) -> list[str]:
        """Forget a view; returns what was dropped, dependents first. Missing is fine."""
        if name not in self:
            return []
        dependents = self.dependents(name)
        if dependents and not cascade:
            raise ValueError(f"{name!r} is read by {', '.join(dependents)}")
        dropped = [*dependents, name]
        for view in dropped:
            self.dependencies.pop(view)
            self._built.pop(view, None)
            self._zoned.pop(view, None)
            self._makers.pop(view, None)
        return dropped

    def register(
        self, spark: SparkSession, names: list[str] | None = None, topic_as: str = "topic"
    ) -> list[str]:
        """Temp views, for SQL. Re-registering replaces.

        ``topic_as`` renames the topic column, for statements that know it by another name.
        """
        chosen = self.names() if names is None else names
        for name in chosen:
            self[name].withColumnRenamed("topic", topic_as).createOrReplaceTempView(name)
        return chosen
