"""Views generated from an event catalog.

The catalog is three tables: events (id, name), event versions (address levels, schema
reference) and schema versions (JSON Schema text). They are joined and turned into view
definitions as DataFrames; only the finished definitions, one per event version, reach
the driver, as DDL does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import topics
from ..functions.values import schema_columns
from ..schemas import CATALOG_EVENT, CATALOG_EVENT_VERSION, CATALOG_SCHEMA_VERSION
from .registry import STATIC_MAPPINGS, Mapping, Registry
from .viewset import ViewSet

# Every column a generated view may select, in select order, and which of
# them each routing view has.
CANONICAL_COLUMNS = [
    "vehicle_id",
    "speed", "fuel_level", "engine_temp", "tire_pressure", "battery_voltage",
    "latitude", "longitude", "recorded_at",
    "event_type", "severity", "description", "payload", "occurred_at",
    "command_type", "parameters", "issued_at", "issued_by",
    "topic",
]
ROUTING_COLUMNS = {
    "fleet_telemetry_raw": [
        "vehicle_id", "speed", "fuel_level", "engine_temp", "tire_pressure", "battery_voltage",
        "latitude", "longitude", "recorded_at", "topic",
    ],
    "fleet_events_raw": [
        "vehicle_id", "event_type", "severity", "description", "payload", "occurred_at", "topic",
    ],
    "fleet_commands_raw": [
        "vehicle_id", "command_type", "parameters", "issued_at", "issued_by", "topic",
    ],
}
DEFAULT_COLUMNS = ["vehicle_id", "topic"]
# End of fixed values.


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalog tables from JSON-lines folders ``events``, ``event_versions``, ``schema_versions``."""
    return (
        spark.read.schema(CATALOG_EVENT).json(f"{path}/events"),
        spark.read.schema(CATALOG_EVENT_VERSION).json(f"{path}/event_versions"),
        spark.read.schema(CATALOG_SCHEMA_VERSION).json(f"{path}/schema_versions"),
    )


def assembled(events: DataFrame, versions: DataFrame, schemas: DataFrame) -> DataFrame:
    """Event versions with their event's name and schema text; either may be missing."""
    names = events.select(F.col("id").alias("event_id"), "name")
    contents = schemas.select(F.col("id").alias("schema_version_id"), "content")
    return (
        versions.join(names, "event_id", "left")
        .join(contents, "schema_version_id", "left")
        .withColumn("name", F.coalesce("name", "event_id"))
    )


def definitions(catalog: DataFrame) -> DataFrame:
    """One view definition per event version.

    Columns are those the schema declares and the routing view has, in select order;
    with none, or without a readable schema, the vehicle and the topic.
    """
    like = topics.levels_to_like(F.col("levels"))
    available = F.create_map(*[
        x for view, columns in ROUTING_COLUMNS.items()
        for x in (F.lit(view), F.array(*[F.lit(c) for c in columns]))
    ])
    wanted = F.array_intersect(
        schema_columns(F.col("content"), CANONICAL_COLUMNS), available[F.col("base_view")]
    )
    default = F.array(*[F.lit(c) for c in DEFAULT_COLUMNS])
    return (
        catalog.withColumn("like_pattern", like)
        .withColumn("base_view", topics.base_view(F.col("like_pattern")))
        .select(
            topics.event_identifier(F.col("name")).alias("view_name"),
            F.col("name").alias("event_name"),
            "version",
            F.get(F.split(F.coalesce("description", "name"), "\n"), F.lit(0)).alias("summary"),
            "base_view",
            "like_pattern",
            F.when(F.size(wanted) > 0, wanted).otherwise(default).alias("columns"),
        )
    )


def registry_rows(defs: DataFrame) -> DataFrame:
    """Registry entries of generated views."""
    return defs.select(
        topics.like_to_pattern(F.col("like_pattern")).alias("pattern"),
        F.col("view_name").alias("mv"),
        topics.inferred_time_column(F.col("like_pattern")).alias("time_column"),
    )


def view_sql(defs: DataFrame) -> DataFrame:
    """Definitions as statements, for review before anything is created."""
    like = F.replace(F.col("like_pattern"), F.lit("'"), F.lit("''"))
    statement = F.concat(
        F.lit("CREATE OR REPLACE TEMPORARY VIEW "), F.col("view_name"), F.lit(" AS SELECT "),
        F.array_join("columns", ", "), F.lit(" FROM "), F.col("base_view"),
        F.lit(" WHERE topic LIKE '"), like, F.lit("'"),
    )
    return defs.select("view_name", statement.alias("statement"))


@dataclass(frozen=True)
class Definition:
    view_name: str
    base_view: str
    like_pattern: str
    columns: tuple[str, ...]

    def build(self, base: DataFrame) -> DataFrame:
        return base.where(F.col("topic").like(self.like_pattern)).select(*self.columns)


def generate(views: ViewSet, defs: DataFrame | None = None, dry_run: bool = False) -> tuple[list[Definition], Registry]:
    """Define the catalog's views and the registry that goes with them.

    Without a catalog only the static entries result. A generated view replaces one of
    the same name. A dry run changes nothing.
    """
    if defs is None:
        return [], Registry(STATIC_MAPPINGS)
    rows = sorted(defs.toLocalIterator(), key=lambda r: r["event_name"])
    made = [
        Definition(r["view_name"], r["base_view"], r["like_pattern"], tuple(r["columns"])) for r in rows
    ]
    entries = [
        Mapping(r["pattern"], r["mv"], r["time_column"])
        for r in sorted(registry_rows(defs).toLocalIterator(), key=lambda r: r["mv"])
    ]
    if not dry_run:
        for d in made:
            views.drop(d.view_name, cascade=True)
            views.define(d.view_name, (d.base_view,), d.build)
    return made, Registry(STATIC_MAPPINGS).followed_by(*entries)
