"""Topic pattern -> view registry."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.topics import is_wild, pattern_regex, pattern_regex_column
from ..schemas import REGISTRY_MAPPING
from . import topic_table


@dataclass(frozen=True)
class Mapping:
    pattern: str
    mv: str
    time_column: str | None = None
    aggregates: dict[str, str] = field(default_factory=dict)
    enriched: str | None = None
    spatial: dict[str, str] = field(default_factory=dict)


# The shipped mappings, in order of precedence.
STATIC_MAPPINGS = (
    Mapping("fleet/telemetry/*/metrics", "fleet_telemetry_raw", "recorded_at",
            aggregates={"window_5min": "vehicle_speed_5min_avg"}),
    Mapping("fleet/events/*/alerts/high", "high_severity_alerts", "occurred_at",
            enriched="alerts_with_context"),
    Mapping("fleet/events/*/alerts/medium", "medium_severity_alerts", "occurred_at"),
    Mapping("fleet/events/*/alerts/low", "low_severity_alerts", "occurred_at"),
    Mapping("fleet/events/*", "fleet_events_raw", "occurred_at"),
    Mapping("fleet/commands/*", "fleet_commands_raw", "issued_at"),
)
# End of fixed values.


class UnknownPattern(LookupError):
    """No registry entry matches a topic pattern."""


def _sample_topic(pattern: str) -> str:
    """A concrete topic under a pattern, used to ask whether another pattern covers it."""
    return pattern.replace("*", "x").replace(">", "x/y")


class Registry:
    """Ordered mappings. They are configuration: a handful of rows, held by the driver."""

    def __init__(self, mappings=STATIC_MAPPINGS):
        self.mappings = tuple(mappings)

    def resolve(self, pattern: str) -> Mapping:
        """Best entry: the same pattern, else one that covers it, else one it covers."""
        tiers = (
            lambda m: m.pattern == pattern,
            lambda m: re.match(pattern_regex(m.pattern), pattern),
            lambda m: re.match(pattern_regex(pattern), _sample_topic(m.pattern)),
        )
        for fits in tiers:
            for mapping in self.mappings:
                if fits(mapping):
                    return mapping
        raise UnknownPattern(f"no view is mapped to {pattern!r}")

    def position_of(self, pattern: Column) -> Column:
        """The same choice for a column of patterns: position of the entry, or NULL.

        The entries compile into one expression over the row: for streams, and a handful of entries.
        """
        regex = pattern_regex_column(pattern)
        tests = []
        for fits in (
            lambda m: pattern == m.pattern,
            lambda m: pattern.rlike(pattern_regex(m.pattern)),
            lambda m: is_wild(pattern) & F.rlike(F.lit(_sample_topic(m.pattern)), regex),
        ):
            tests += [F.when(fits(m), F.lit(i)) for i, m in enumerate(self.mappings)]
        return F.coalesce(*tests)

    def resolved(self, patterns: DataFrame, column: str = "pattern") -> DataFrame:
        """Adds the chosen entry's ``mapped_pattern``, ``mv`` and ``time_column``.

        A batch meets the entries as a table, however many there are; a stream, which cannot be folded to
        its distinct patterns, gets them as an expression.
        """
        if not patterns.isStreaming:
            return topic_table.resolved(self.to_df(patterns.sparkSession), patterns, column)
        position = self.position_of(F.col(column))
        picked = F.get(
            F.array(*[
                F.struct(
                    F.lit(m.pattern).alias("mapped_pattern"),
                    F.lit(m.mv).alias("mv"),
                    F.lit(m.time_column).cast("string").alias("time_column"),
                )
                for m in self.mappings
            ]),
            position,
        )
        return patterns.withColumn("_entry", picked).select(*patterns.columns, "_entry.*")

    # --- as a table ---

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [{"position": i, **asdict(m)} for i, m in enumerate(self.mappings)]
        return spark.createDataFrame(
            [tuple(r[f.name] for f in REGISTRY_MAPPING.fields) for r in rows], REGISTRY_MAPPING
        )

    def write(self, spark: SparkSession, path: str) -> None:
        self.to_df(spark).coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def from_df(cls, table: DataFrame) -> "Registry":
        mappings = [
            Mapping(r["pattern"], r["mv"], r["time_column"], dict(r["aggregates"] or {}),
                    r["enriched"], dict(r["spatial"] or {}))
            for r in table.orderBy("position").toLocalIterator()
        ]
        return cls(mappings)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Registry":
        return cls.from_df(spark.read.schema(REGISTRY_MAPPING).json(path))

    def followed_by(self, *generated: Mapping) -> "Registry":
        """Generated entries come after, so existing ones keep precedence."""
        return Registry(self.mappings + generated)

    # --- listings ---

    def topics(self, spark: SparkSession, backed: bool = False) -> DataFrame:
        """One row per pattern (first entry wins) with whether it has history."""
        seen: dict[str, Mapping] = {}
        for m in self.mappings:
            seen.setdefault(m.pattern, m)
        rows = [
            (m.pattern, m.mv, m.time_column, bool(m.time_column), m.enriched, m.aggregates, m.spatial)
            for m in seen.values() if m.mv or not backed
        ]
        return spark.createDataFrame(
            rows,
            "pattern string, mv string, time_column string, has_history boolean, enriched string,"
            " aggregates map<string,string>, spatial map<string,string>",
        )
