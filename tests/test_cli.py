"""The command line prints what the query API answers."""

from __future__ import annotations

import csv
import io
import json

import pytest

from fleetviews import work_dir
from fleetviews.cli import main, printed
from fleetviews.schemas import CATALOG_EVENT, CATALOG_EVENT_VERSION, CATALOG_SCHEMA_VERSION, CONNECTOR_STATUS
from fleetviews.sources import messages
from fleetviews.streaming import readiness

SOURCE = ["--events", "/root/testdata/sf0.001", "--as-of", "2024-01-01T12:00:00"]


@pytest.fixture
def run(spark, capsys):
    def call(*argv: str, form: str = "json", code: int = 0):
        assert main([*SOURCE, "--format", form, *argv], spark) == code
        return capsys.readouterr().out.splitlines()

    return call


def test_query_forms(run):
    lines = [json.loads(line) for line in run("query", "fleet/events/*/alerts/high", "--since", "1h")]
    assert len(lines) == 5 and lines[0]["occurred_at"].endswith("Z")
    table = run("query", "fleet/events/*/alerts/high", "--limit", "3", form="table")
    assert len(table) == 5 and table[0].split()[0] == "vehicle_id"
    rows = list(csv.DictReader(run("query", "fleet/events/*/alerts/high", "--limit", "2", form="csv")))
    assert json.loads(rows[0]["payload"]) is not None
    assert run("query", "--sql", "SELECT count(*) AS n FROM fleet_commands_raw") == ['{"n":199}']
    assert run("query", "nowhere/x", code=1) == []
    assert run("query", "fleet/telemetry/*/metrics", "--since", "1ms", code=1) == []


def test_topics_alerts_presets_tools(run):
    assert len(run("topic", "list", "--backed")) == 6
    assert json.loads(run("topic", "info", "fleet/>")[0])["mv"] == "fleet_telemetry_raw"
    assert "lag_seconds" in json.loads(run("topic", "lag", "fleet/>")[0])
    assert len(run("alert", "list", "--severity", "low", "--limit", "4")) == 4
    assert len(run("alert", "history", "--since", "1h")) == 15
    assert all("time_before_alert" in line for line in run("alert", "history", "--since", "12h", "--enrich"))
    assert len(run("preset", "fuel_levels", "--limit", "7")) == 7
    assert len(run("tool", "get_vehicle_details", "--vehicle", "vehicle_005")) <= 10


def test_watch_and_subscribe(spark, run):
    watched = run("alert", "watch", "--severity", "high", "--once", "--checkpoint", work_dir(spark, "watch"))
    assert len(watched) == 65 and json.loads(watched[0])["source"] == "live"
    both = run("subscribe", "fleet/events/*/alerts/high", "--since", "6h", "--cut", "2024-01-01T08:00:00",
               "--line", "--once", "--checkpoint", work_dir(spark, "sub"))
    kinds = [line.split("]")[0] for line in both]
    assert kinds == sorted(kinds) and {"[history", "[live   "} == set(kinds)


def test_generate(spark, run, tmp_path):
    folder, out = work_dir(spark, "catalog"), work_dir(spark, "registry")
    address = [{"name": n, "addressLevelType": t} for n, t in (
        ("fleet", "literal"), ("commands", "literal"), ("vehicle_id", "variable"), ("command_type", "variable"))]
    for name, schema, row in (
        ("events", CATALOG_EVENT, ("1", "vehicle-command")),
        ("event_versions", CATALOG_EVENT_VERSION, ("1", "1.0.0", None, "s", address)),
        ("schema_versions", CATALOG_SCHEMA_VERSION, ("s", '{"properties":{"vehicle_id":{},"issued_at":{}}}')),
    ):
        spark.createDataFrame([row], schema).write.json(f"{folder}/{name}")
    shown = [json.loads(line) for line in run("generate", "--catalog", folder, "--dry-run")]
    assert shown == [{"view_name": "vehicle_command", "statement":
                      "CREATE OR REPLACE TEMPORARY VIEW vehicle_command AS SELECT vehicle_id, issued_at"
                      " FROM fleet_commands_raw WHERE topic LIKE 'fleet/commands/%/%'"}]
    assert len(run("generate", "--catalog", folder, "--out", out)) == 7
    info = run("--registry", out, "topic", "info", "fleet/commands/v1/reduce_speed")
    assert json.loads(info[0])["mv"] == "vehicle_command"
    assert len(run("generate")) == 6 and run("generate", "--dry-run") == []


def test_marker_and_status(spark, capsys):
    folder, table = work_dir(spark, "in"), work_dir(spark, "status")
    assert main(["--messages", folder, "--as-of", "2024-01-01T12:00:00", "marker"], spark) == 0
    sent = messages.read_messages(spark, folder)
    assert sent.where(readiness.is_marker()).count() == 1 and readiness.business(sent).count() == 0
    show = ["--messages", folder, "status", "--table", table]
    assert main(show, spark) == 0
    assert json.loads(capsys.readouterr().out)["ready"] is True
    row = spark.createDataFrame([("c", False, None, 0, 1, None)], CONNECTOR_STATUS)
    readiness.StatusTable(spark, table).upsert(row, 0)
    assert main([*show, "--connector", "c", "--wait", "0.1"], spark) == 1
    assert main(show, spark) == 0
    assert json.loads(capsys.readouterr().out)["connectors"][0]["total_events_consumed"] == 1


def test_empty_table(spark):
    out = io.StringIO()
    printed(spark.range(0), "table", out)
    assert out.getvalue() == "(no rows)\n"
