"""Registry matching and catalog generation, over topics and a catalog found in the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetviews.functions import topics
from fleetviews.functions.values import schema_columns
from fleetviews.operators import sets
from fleetviews.plans import catalog
from fleetviews.plans.registry import STATIC_MAPPINGS, Registry
from fleetviews.sources.events_table import SEVERITY
from .base import check
from .rows import EVENT_ROW, TELEMETRY_ROW

# Every topic that occurs, as it is and with levels widened to wildcards.
PATTERNS = """, seen AS (SELECT DISTINCT topic FROM (SELECT topic FROM telemetry UNION ALL SELECT topic FROM alerts
    UNION ALL SELECT topic FROM commands)),
  patterns AS (SELECT DISTINCT pattern FROM (
    SELECT topic AS pattern FROM seen
    UNION ALL SELECT regexp_replace(topic, 'vehicle_[0-9]+', '*') FROM seen
    UNION ALL SELECT regexp_replace(topic, 'vehicle_.*$', '>') FROM seen
    UNION ALL SELECT regexp_replace(topic, 'vehicle_.*$', '*') FROM seen
    UNION ALL SELECT topic || '/extra' FROM seen))"""

MAPPINGS = """, mapping(pos, mpattern, mregex, msample, mv, tcol) AS (VALUES
    (0, 'fleet/telemetry/*/metrics', '^fleet/telemetry/[^/]+/metrics$', 'fleet/telemetry/x/metrics', 'fleet_telemetry_raw', 'recorded_at'),
    (1, 'fleet/events/*/alerts/high', '^fleet/events/[^/]+/alerts/high$', 'fleet/events/x/alerts/high', 'high_severity_alerts', 'occurred_at'),
    (2, 'fleet/events/*/alerts/medium', '^fleet/events/[^/]+/alerts/medium$', 'fleet/events/x/alerts/medium', 'medium_severity_alerts', 'occurred_at'),
    (3, 'fleet/events/*/alerts/low', '^fleet/events/[^/]+/alerts/low$', 'fleet/events/x/alerts/low', 'low_severity_alerts', 'occurred_at'),
    (4, 'fleet/events/*', '^fleet/events/[^/]+$', 'fleet/events/x', 'fleet_events_raw', 'occurred_at'),
    (5, 'fleet/commands/*', '^fleet/commands/[^/]+$', 'fleet/commands/x', 'fleet_commands_raw', 'issued_at'))"""


def _patterns(f):
    """Folded to distinct topics before anything is made of them."""
    seen = f.table.messages().select("topic").distinct()
    forms = F.array(
        F.col("topic"),
        F.regexp_replace("topic", "vehicle_[0-9]+", "*"),
        F.regexp_replace("topic", "vehicle_.*$", ">"),
        F.regexp_replace("topic", "vehicle_.*$", "*"),
        F.concat("topic", F.lit("/extra")),
    )
    return seen.select(F.explode(forms).alias("pattern")).distinct()


@check("j04_pattern_resolution", PATTERNS + MAPPINGS + """, ranked AS (
    SELECT pattern, mpattern, mv, tcol, row_number() OVER (PARTITION BY pattern ORDER BY tier, pos) AS n FROM (
      SELECT p.pattern, m.*, CASE WHEN p.pattern = mpattern THEN 1 WHEN regexp_matches(p.pattern, mregex) THEN 2
        WHEN (p.pattern LIKE '%*%' OR p.pattern LIKE '%>%') AND regexp_matches(msample,
          '^' || replace(replace(p.pattern, '*', '[^/]+'), '>', '.+') || '$') THEN 3 END AS tier
      FROM patterns p, mapping m) WHERE tier IS NOT NULL)
  SELECT p.pattern, r.mpattern AS mapped_pattern, r.mv, r.tcol AS time_column
  FROM patterns p LEFT JOIN ranked r ON p.pattern = r.pattern AND r.n = 1""")
def _(f):
    return Registry().resolved(_patterns(f))


@check("f14_f18_topic_inference", PATTERNS + """ SELECT pattern,
  CASE WHEN pattern LIKE '%telemetry%' THEN 'recorded_at' WHEN pattern LIKE '%events%' THEN 'occurred_at' ELSE 'issued_at' END AS time_column,
  CASE WHEN pattern LIKE '%telemetry%' THEN 'fleet_telemetry_raw' WHEN pattern LIKE '%events%' THEN 'fleet_events_raw' ELSE 'fleet_commands_raw' END AS base_view,
  replace(replace(pattern, '*', '%'), '>', '%') AS like_form FROM patterns""")
def _(f):
    p = F.col("pattern")
    return _patterns(f).select(
        p, topics.inferred_time_column(p).alias("time_column"), topics.base_view(p).alias("base_view"),
        F.translate(p, "*>", "%%").alias("like_form"),
    )


# A catalog read out of the data: one event per kind of row and severity. The schema
# text depends on the kind; one kind has none and one has text that is not JSON.
CATALOG = """, found AS (SELECT DISTINCT kind, severity FROM base),
  entry AS (SELECT 'ev-' || kind || '-' || severity AS event_id, upper(kind) || ' ' || severity || '-Event' AS name, kind, severity,
    CASE WHEN kind = 'error' THEN 'fleet/events/%/alerts/' || severity WHEN kind = 'signup' THEN 'fleet/commands/%/%'
      ELSE 'fleet/telemetry/%/metrics' END AS like_pattern FROM found),
  defined AS (SELECT lower(replace(replace(name, ' ', '_'), '-', '_')) AS view_name, name AS event_name,
    CASE kind WHEN 'error' THEN 'fleet_events_raw' WHEN 'signup' THEN 'fleet_commands_raw' ELSE 'fleet_telemetry_raw' END AS base_view,
    like_pattern,
    CASE kind WHEN 'error' THEN 'vehicle_id,severity,occurred_at' WHEN 'signup' THEN 'vehicle_id,command_type,issued_at'
      WHEN 'view' THEN 'vehicle_id,speed,recorded_at,topic' ELSE 'vehicle_id,topic' END AS columns FROM entry)"""

_SCHEMAS = {
    "error": '{"properties":{"severity":{},"vehicle_id":{},"unknown":{},"occurred_at":{},"speed":{}}}',
    "signup": '{"properties":{"issued_at":{},"command_type":{},"vehicle_id":{}}}',
    "view": '{"properties":{"topic":{},"speed":{},"vehicle_id":{},"recorded_at":{}}}',
    "click": "not json",
}


def _catalog(f):
    found = f.table.raw.selectExpr("event_type AS kind", f"{SEVERITY} AS severity").distinct()
    key = F.concat_ws("-", F.lit("ev"), "kind", "severity")
    events = found.select(key.alias("id"), F.concat(F.upper("kind"), F.lit(" "), "severity", F.lit("-Event")).alias("name"))

    def levels(*parts):
        return F.array(*[
            F.struct(name.alias("name"), F.lit(kind).alias("addressLevelType")) for name, kind in parts
        ])

    lit, var = "literal", "variable"
    fleet, vehicle = (F.lit("fleet"), lit), (F.lit("vehicle_id"), var)
    address = (
        F.when(F.col("kind") == "error", levels(fleet, (F.lit("events"), lit), vehicle, (F.lit("alerts"), lit), (F.col("severity"), lit)))
        .when(F.col("kind") == "signup", levels(fleet, (F.lit("commands"), lit), vehicle, (F.lit("command_type"), var)))
        .otherwise(levels(fleet, (F.lit("telemetry"), lit), vehicle, (F.lit("metrics"), lit)))
    )
    versions = found.select(
        key.alias("event_id"), F.lit("1.0.0").alias("version"),
        F.concat(F.lit("Rows of "), "kind", F.lit("\nsecond line")).alias("description"),
        F.concat(F.lit("sv-"), "kind").alias("schema_version_id"), address.alias("levels"),
    )
    contents = F.create_map(*[F.lit(x) for pair in _SCHEMAS.items() for x in pair])
    schemas = found.select("kind").distinct().where(F.col("kind").isin(*_SCHEMAS)).select(
        F.concat(F.lit("sv-"), "kind").alias("id"), contents[F.col("kind")].alias("content")
    )
    return events, versions, schemas


@check("j05_catalog_assembly", CATALOG + """ SELECT event_id, name, '1.0.0' AS version, kind IN ('error', 'signup', 'view', 'click') AS has_schema FROM entry""")
def _(f):
    joined = catalog.assembled(*_catalog(f))
    return joined.select("event_id", "name", "version", F.col("content").isNotNull().alias("has_schema"))


@check("s17_catalog_files", CATALOG + """ SELECT event_id, name, like_pattern FROM entry""")
def _(f):
    path = f.work("s17")
    for table, name in zip(_catalog(f), ("events", "event_versions", "schema_versions")):
        table.write.json(f"{path}/{name}")
    joined = catalog.assembled(*catalog.read_catalog(f.spark, path))
    return joined.select("event_id", "name", topics.levels_to_like(F.col("levels")).alias("like_pattern"))


@check("j06_d04_definitions", CATALOG + """ SELECT view_name, event_name, base_view, like_pattern, columns FROM defined""")
def _(f):
    defs = catalog.definitions(catalog.assembled(*_catalog(f)))
    return defs.select("view_name", "event_name", "base_view", "like_pattern", F.array_join("columns", ",").alias("columns"))


@check("f13_f17_names_and_patterns", CATALOG + """ SELECT event_id, lower(replace(replace(name, ' ', '_'), '-', '_')) AS identifier,
  like_pattern, replace(like_pattern, '%', '*') AS pattern FROM entry""")
def _(f):
    like = topics.levels_to_like(F.col("levels"))
    return catalog.assembled(*_catalog(f)).select(
        "event_id", topics.event_identifier(F.col("name")).alias("identifier"),
        like.alias("like_pattern"), topics.like_to_pattern(like).alias("pattern"),
    )


@check("f19_schema_columns", CATALOG + """ SELECT DISTINCT kind, CASE kind WHEN 'error' THEN 'vehicle_id,speed,severity,occurred_at'
  WHEN 'signup' THEN 'vehicle_id,command_type,issued_at' WHEN 'view' THEN 'vehicle_id,speed,recorded_at,topic'
  ELSE 'vehicle_id,topic' END AS columns FROM entry WHERE kind <> 'purchase'""")
def _(f):
    _, _, schemas = _catalog(f)
    columns = schema_columns(F.col("content"), catalog.CANONICAL_COLUMNS)
    return schemas.select(F.expr("substring(id, 4)").alias("kind"), F.array_join(columns, ",").alias("columns"))


@check("d06_definition_statements", CATALOG + """ SELECT view_name, 'CREATE OR REPLACE TEMPORARY VIEW ' || view_name || ' AS SELECT ' ||
  replace(columns, ',', ', ') || ' FROM ' || base_view || ' WHERE topic LIKE ''' || like_pattern || '''' AS statement FROM defined""")
def _(f):
    return catalog.view_sql(catalog.definitions(catalog.assembled(*_catalog(f))))


@check("d10_generated_registry", CATALOG + """ SELECT replace(like_pattern, '%', '*') AS pattern, view_name AS mv,
  CASE base_view WHEN 'fleet_events_raw' THEN 'occurred_at' WHEN 'fleet_commands_raw' THEN 'issued_at' ELSE 'recorded_at' END AS time_column
  FROM defined""")
def _(f):
    return catalog.registry_rows(catalog.definitions(catalog.assembled(*_catalog(f))))


@check("d04_generated_view_rows", "SELECT vehicle_id, severity, occurred_at FROM alerts WHERE topic LIKE 'fleet/events/%/alerts/high'")
def _(f):
    defs = catalog.definitions(catalog.assembled(*_catalog(f)))
    catalog.generate(f.views, defs)
    return f.views["error_high_event"]


@check("d05_static_generation", f"SELECT {TELEMETRY_ROW} FROM telemetry")
def _(f):
    made, registry = catalog.generate(f.views)
    assert not made
    return f.views[registry.resolve("fleet/telemetry/*/metrics").mv]


@check("x04_static_then_generated", CATALOG + MAPPINGS + """ SELECT pos AS position, mpattern AS pattern, mv FROM mapping
  UNION ALL SELECT 6 + row_number() OVER (ORDER BY view_name) - 1, replace(like_pattern, '%', '*'), view_name FROM defined""")
def _(f):
    from pyspark.sql import Window

    rows = catalog.registry_rows(catalog.definitions(catalog.assembled(*_catalog(f))))
    # The generated entries are registry configuration: one row per catalog event.
    place = F.row_number().over(Window.orderBy("mv")) - 1
    generated = rows.withColumn("position", place)
    static = Registry(STATIC_MAPPINGS).to_df(f.spark)
    return sets.static_then_generated(static, generated).select("position", "pattern", "mv")


@check("q08_topics_to_views", f"SELECT {EVENT_ROW}, severity || '_severity_alerts' AS mv FROM alerts")
def _(f):
    """Every alert with the view its own topic resolves to."""
    resolved = Registry().resolved(f.events, "topic")
    return resolved.drop("mapped_pattern", "time_column")
