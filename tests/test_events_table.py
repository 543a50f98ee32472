"""The adapter's scan bounds select exactly the rows the event-time bounds select."""

from __future__ import annotations

from datetime import timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fleetviews.functions.timing import moment
from fleetviews.sources.events_table import EventsTable

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("shift", [-1, 0, 1])
@pytest.mark.parametrize("place", [0, 17, 300, 599])
def test_scan_bounds(spark, place, shift):
    table = EventsTable(spark, SF_DIR)
    rows = table.telemetry()
    found = rows.orderBy("ts").select("ts").collect()[place]["ts"].replace(tzinfo=timezone.utc)
    bound = found + timedelta(microseconds=shift)
    after = rows.where(F.col("ts") > moment(bound)).count()
    assert table.telemetry(since=bound).count() == after
    assert table.telemetry(until=bound).count() == 600 - after
    assert table.telemetry(since=bound, until=bound).count() == 0


def test_bounds_reach_the_scan(spark):
    from fleetviews.sources.events_table import AS_OF

    plan = EventsTable(spark, SF_DIR).events(since=AS_OF)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1]
    assert "GreaterThanOrEqual(ts" in pushed and "EqualTo(event_type,error)" in pushed


def test_columns_are_pruned(spark):
    df = EventsTable(spark, SF_DIR).telemetry().select("fuel_level")
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in df._jdf.queryExecution().executedPlan().toString()


def test_streams_partition_the_table(spark):
    table = EventsTable(spark, SF_DIR)
    counts = [table.stream_of(kind).count() for kind in ("telemetry", "events", "commands")]
    assert counts == [600, 201, 199] and table.messages().count() == 1000
    assert table.unified().count() == 600 * 5 + 201 + 199
