"""Topic patterns, the registry, and catalog generation."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from fleetviews.functions import topics
from fleetviews.plans import catalog, topic_table
from fleetviews.plans.registry import Mapping, Registry, UnknownPattern
from fleetviews.plans.viewset import ViewSet
from fleetviews.schemas import CATALOG_EVENT, CATALOG_EVENT_VERSION, CATALOG_SCHEMA_VERSION
from fleetviews.session import work_dir
from fleetviews.sources.events_table import EventsTable

EDGES = [
    ("a/*", "a/b", True), ("a/*", "a/b/c", False), ("a/*", "a/", False), ("a/*", "a", False),
    ("a/>", "a/b", True), ("a/>", "a/b/c", True), ("a/>", "a", False), ("a/>", "a/", False),
    (">", "a", True), (">", "a/b", True), ("*", "a", True), ("*", "a/b", False),
    ("a/*/c", "a/b/c", True), ("a/*/c", "a/b/d/c", False), ("*/b/>", "x/b/c/d", True),
    ("a.b/*", "aXb/c", False), ("a.b/*", "a.b/c", True), ("a+(b)/c", "a+(b)/c", True),
    ("a/b", "a/b", True), ("a/b", "a/b/c", False), ("a/>/c", "a/anything", True), ("a b/*", "a b/c", True),
]


def test_pattern_edges(spark):
    for pattern, topic, expected in EDGES:
        row = spark.createDataFrame([(pattern, topic)], "p string, t string")
        by_argument, by_column = row.select(
            topics.topic_matches(F.col("t"), pattern), F.rlike(F.col("t"), topics.pattern_regex_column(F.col("p")))
        ).first()
        assert by_argument == by_column == expected, (pattern, topic)
        assert bool(re.match(topics.pattern_regex(pattern), topic)) == expected


RESOLUTIONS = {
    "fleet/>": "fleet/telemetry/*/metrics",
    "fleet/telemetry/>": "fleet/telemetry/*/metrics",
    "fleet/events/>": "fleet/events/*",
    "fleet/events/*/alerts/*": "fleet/events/*/alerts/high",
    "fleet/events/vehicle_005/alerts/high": "fleet/events/*/alerts/high",
    "fleet/telemetry/*/metrics/speed": None,
    "fleet/commands/v1/reduce_speed": None,
}


@pytest.mark.parametrize("pattern,expected", RESOLUTIONS.items())
def test_resolution_table(spark, pattern, expected):
    registry = Registry()
    if expected is None:
        with pytest.raises(UnknownPattern):
            registry.resolve(pattern)
    else:
        assert registry.resolve(pattern).pattern == expected
    frame = registry.resolved(spark.createDataFrame([(pattern,)], "pattern string"))
    assert frame.first()["mapped_pattern"] == expected


def test_table_resolves_like_the_registry(spark):
    """Random entries and patterns, with empty, odd and repeated levels, against one pattern at a time."""
    rng = random.Random(8)
    words = ("a", "b", "x", "y", "", "*", "*", ">", "a*b", "a.b", "x>")
    text = lambda: "/".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    registry = Registry([Mapping(text(), f"v{i}", rng.choice([None, "t"])) for i in range(60)])
    asked = sorted({text() for _ in range(900)})
    frame = spark.createDataFrame([(t,) for t in asked] + [(asked[5],), (None,)], "pattern string")
    got = registry.resolved(frame).collect()
    assert len(got) == len(asked) + 2

    def expected(pattern):
        try:
            m = registry.resolve(pattern)
            return m.pattern, m.mv, m.time_column
        except UnknownPattern:
            return None, None, None

    found = 0
    for row in got:
        if row["pattern"] is None:
            assert row["mv"] is None
        else:
            assert tuple(row)[1:] == expected(row["pattern"]), row
            found += row["mv"] is not None
    assert found > 300


def test_large_registry_has_no_expression_per_entry(spark):
    entries = spark.range(5000).select(
        F.col("id").alias("position"), F.format_string("site/%d/line/*/m%d", F.col("id") % 700, F.col("id")).alias("pattern"),
        F.concat(F.lit("v"), "id").alias("mv"), F.lit("t").alias("time_column"))
    asked = spark.range(4000).select(F.format_string("site/%d/line/7/m%d", F.col("id") % 700, F.col("id")).alias("pattern"))
    got = topic_table.resolved(entries, asked)
    assert got.where(F.col("mv") == F.concat(F.lit("v"), F.regexp_extract("pattern", "m([0-9]+)$", 1))).count() == 4000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and len(plan) < 20_000 and "Cartesian" not in plan and "NestedLoop" not in plan


def test_registry_round_trip_and_listing(spark):
    extra = Mapping("fleet/telemetry/*/position", "vehicle_speeds", None, spatial={"boston": "vehicles_in_region_boston"})
    repeated = Mapping("fleet/events/*", "other_view", "occurred_at")
    registry = Registry().followed_by(extra, repeated)
    path = work_dir(spark, "registry")
    registry.write(spark, path)
    assert Registry.read(spark, path).mappings == registry.mappings
    listed = {r["pattern"]: r for r in registry.topics(spark).collect()}
    assert len(listed) == 7 and listed["fleet/events/*"]["mv"] == "fleet_events_raw"
    assert not listed["fleet/telemetry/*/position"]["has_history"]


def test_rebuilt_topic(spark):
    row = spark.createDataFrame([("v1", "", "high")], "vehicle_id string, topic string, severity string")
    built = row.select(
        topics.rebuilt_topic("a/*/b/*", row.columns), topics.rebuilt_topic("a/*", row.columns),
        topics.rebuilt_topic("a/>", row.columns), topics.rebuilt_topic("a/*/*/*", row.columns),
        topics.rebuilt_topic("a/*/b/*", ["vehicle_id"]),
    ).first()
    assert list(built) == ["a/v1/b/high", "a/v1", "a/>", "a/v1/high/*", "a/v1/b/unknown"]


def _level(name, kind="literal"):
    return {"name": name, "addressLevelType": kind}


def _small_catalog(spark):
    alert = [_level("fleet"), _level("events"), _level("vehicle_id", "variable"), _level("alerts"), _level("severity", "variable")]
    command = [_level("fleet"), _level("commands"), _level("vehicle_id", "variable"), _level("command_type", "variable")]
    events = spark.createDataFrame([("1", "vehicle-alert"), ("2", "vehicle-command"), ("3", "No Address")], CATALOG_EVENT)
    versions = spark.createDataFrame(
        [
            ("1", "1.0.0", "Alert\nmore", "s1", alert), ("2", "1.0.0", None, "s2", command),
            ("3", "2.0.0", None, None, []), ("4", "1.0.0", None, "s1", alert),
        ],
        CATALOG_EVENT_VERSION,
    )
    schemas = spark.createDataFrame(
        [
            ("s1", '{"properties":{"vehicle_id":{},"event_type":{},"severity":{},"description":{},"payload":{},"occurred_at":{},"topic":{}}}'),
            ("s2", '{"properties":{"vehicle_id":{},"command_type":{},"parameters":{},"issued_at":{}}}'),
        ],
        CATALOG_SCHEMA_VERSION,
    )
    return events, versions, schemas


def test_catalog_definitions(spark):
    defs = {r["view_name"]: r for r in catalog.definitions(catalog.assembled(*_small_catalog(spark))).collect()}
    assert set(defs) == {"vehicle_alert", "vehicle_command", "no_address", "4"}
    assert defs["vehicle_alert"]["like_pattern"] == "fleet/events/%/alerts/%"
    assert defs["vehicle_alert"]["summary"] == "Alert"
    assert defs["vehicle_command"]["columns"] == ["vehicle_id", "command_type", "parameters", "issued_at"]
    assert defs["vehicle_command"]["base_view"] == "fleet_commands_raw"
    assert defs["no_address"]["like_pattern"] == "%" and defs["no_address"]["columns"] == ["vehicle_id", "topic"]
    assert defs["no_address"]["base_view"] == "fleet_telemetry_raw"


def test_generation_and_dry_run(spark):
    views = ViewSet.over(EventsTable(spark, "/root/testdata/sf0.001"))
    defs = catalog.definitions(catalog.assembled(*_small_catalog(spark)))
    before = views.names()
    made, registry = catalog.generate(views, defs, dry_run=True)
    assert views.names() == before and len(made) == 4
    assert registry.resolve("fleet/commands/v1/reduce_speed").mv == "vehicle_command"
    catalog.generate(views, defs)
    assert views["vehicle_command"].columns == ["vehicle_id", "command_type", "parameters", "issued_at"]
    assert views["vehicle_alert"].count() == 201
    made, registry = catalog.generate(views)
    assert not made and len(registry.mappings) == 6


def test_statements_run(spark):
    views = ViewSet.over(EventsTable(spark, "/root/testdata/sf0.001"))
    views.register(spark, ["fleet_telemetry_raw", "fleet_events_raw", "fleet_commands_raw"])
    defs = catalog.definitions(catalog.assembled(*_small_catalog(spark)))
    statement = catalog.view_sql(defs).where("view_name = 'vehicle_alert'").first()["statement"]
    spark.sql(statement)
    assert spark.table("vehicle_alert").count() == 201
