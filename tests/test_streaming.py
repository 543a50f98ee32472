"""Streaming forms, readiness protocol, lifecycle and the query API."""

from __future__ import annotations

import json
import os
import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F, types as T

from fleetviews import FleetClient, Registry, ViewSet, work_dir
from fleetviews.operators import joins, topk
from fleetviews.operators import views as ops
from fleetviews.plans import presets
from fleetviews.plans.client import is_safe_select
from fleetviews.plans.lifecycle import LiveViews, drop_registered, ensure_views, persist_view
from fleetviews.functions.values import JSON_TIMES
from fleetviews.schemas import CONNECTOR_STATUS, MESSAGE, SENSORS
from fleetviews.sources import messages, sinks
from fleetviews.sources.events_table import AS_OF, EventsTable
from fleetviews.sources.keyed import KeyedTable
from fleetviews.sources.zones import ZonedView
from fleetviews.streaming import live, readiness, replay, stored, subscription
from fleetviews.streaming.progress import drain_progress, drained, event_time_lag, query_samples, state_rows

SF_DIR = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1, 12)


@pytest.fixture(scope="module")
def views(spark):
    return ViewSet.over(EventsTable(spark, SF_DIR), AS_OF)


@pytest.fixture(scope="module")
def stream(spark):
    return ViewSet.over(EventsTable(spark, SF_DIR, streaming=True), AS_OF)


def rows(df):
    return sorted(map(str, df.collect()))


def test_whole_stream_join_equals_batch(spark, views, stream):
    running = LiveViews(spark)
    joined = live.live_alerts_with_context(stream["fleet_events_raw"], stream["fleet_telemetry_raw"])
    query = running.start("context", joined, available_now=True)
    query.awaitTermination()
    assert rows(running.read("context")) == rows(views["alerts_with_context"])
    # The last, empty batch has moved the watermark and dropped the rows behind it.
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < state_rows(query.recentProgress)


def test_late_rows_find_their_context(spark):
    """Arrivals in any order, equal rows, null times and a batch run again: the pairs of the batch join."""
    rng = random.Random(6)
    topic = lambda kind: f"fleet/{kind}/v/x"
    entries = []
    for _ in range(120):
        at = T0 + timedelta(seconds=rng.randrange(0, 9000))
        body = {"vehicle_id": rng.choice("vw"), "severity": "high", "event_type": "e", "speed": 1.0}
        entries.append((topic(rng.choice(["events", "telemetry", "telemetry"])), at, None, json.dumps(body)))
    entries += entries[:10] + [(topic("events"), None, None, entries[0][3]), (topic("telemetry"), None, None, entries[0][3])]
    rng.shuffle(entries)
    frame = lambda part: spark.createDataFrame(part, MESSAGE)
    parts = [entries[i::4] for i in range(4)]
    typed = lambda m: (ops.events_raw(messages.typed_source(m, "events")), ops.telemetry_raw(messages.typed_source(m, "telemetry")))
    root = work_dir(spark, "late")
    context = stored.StoredContext(spark, f"{root}/context")
    context.start(*typed(_in_files(spark, f"{root}/m", map(frame, parts))), available_now=True).awaitTermination()
    want = rows(joins.alerts_with_context(*typed(frame(entries))))
    assert rows(context.read()) == want and len(want) > 20
    kept = spark.read.schema(context._schema).parquet(f"{root}/context/rows")
    again = kept.where(f"{sinks.BATCH} = 2").drop(sinks.BATCH)
    context._on_batch(spark.createDataFrame(again.collect(), again.schema), 2)
    assert rows(context.read()) == want


def test_late_rows_do_not_store_a_row_a_pair(spark):
    """Two batches of one vehicle within one span: four times the rows are sixteen times the pairs."""
    typed = lambda m: (ops.events_raw(messages.typed_source(m, "events")), ops.telemetry_raw(messages.typed_source(m, "telemetry")))
    size = {}
    for n in (150, 600):
        rng = random.Random(n)
        body = json.dumps({"vehicle_id": "v", "severity": "high", "event_type": "e", "speed": 1.0})
        frame = lambda: spark.createDataFrame([
            (f"fleet/{kind}/v/x", T0 + timedelta(microseconds=rng.randrange(100_000_000)), None, body)
            for kind in ("events", "telemetry") for _ in range(n)
        ], MESSAGE)
        parts, root = [frame(), frame()], work_dir(spark, "late-dense")
        context = stored.StoredContext(spark, f"{root}/context")
        context.start(*typed(_in_files(spark, f"{root}/m", parts)), available_now=True).awaitTermination()
        got, want = context.read(), joins.alerts_with_context(*typed(parts[0].unionByName(parts[1])))
        assert got.columns == want.columns
        told = [f.agg(F.count("*"), F.sum(F.hash(*want.columns).cast("long"))).first() for f in (got, want)]
        assert told[0] == told[1] and told[0][0] > n * n
        size[n] = sum(f.stat().st_size for f in Path(f"{root}/context/pairs").rglob("*.parquet"))
    assert size[600] < 8 * size[150]
    # A batch that an earlier layout wrote holds pairs.
    before = want.limit(40).localCheckpoint()
    sinks.write_batch(before, 7, f"{root}/context/pairs")
    assert Counter(context.read().collect()) == Counter(want.collect()) + Counter(before.collect())


def test_unified_stream_joins_itself(spark, views):
    unified = EventsTable(spark, SF_DIR).unified()
    coming = live.watermarked(EventsTable(spark, SF_DIR, streaming=True).unified(), "ts")
    running = LiveViews(spark)
    running.start("long", joins.unified_alerts_with_context(coming), available_now=True).awaitTermination()
    assert rows(running.read("long")) == rows(joins.unified_alerts_with_context(unified))


def test_open_windows_are_visible_in_update_mode(spark, views, stream):
    running = LiveViews(spark)
    running.start("speed", live.live_speed_avg(stream["fleet_telemetry_raw"]), ["vehicle_id", "window_start"], True)
    assert running.wait()
    progress = running._queries["speed"].recentProgress
    lag = event_time_lag(progress, AS_OF)
    assert timedelta(0) <= lag < timedelta(hours=1)
    assert event_time_lag([], AS_OF) is None
    assert rows(running.read("speed")) == rows(views["vehicle_speed_5min_avg"].select(*running.read("speed").columns))


def test_many_small_batches_equal_one(spark, views):
    """Three-hour slices arriving one by one: watermarks move, state is evicted, nothing is lost."""
    source, table = work_dir(spark, "slices"), EventsTable(spark, SF_DIR).messages().drop("seq").cache()
    for hour in range(0, 12, 3):
        lo, hi = (datetime(2024, 1, 1) + timedelta(hours=h) for h in (hour, hour + 3))
        part = table.where((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1)
        part.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(source)
    frame = messages.stream_messages(spark, source, max_files_per_trigger=1)
    coming = ViewSet(*[messages.typed_source(frame, s) for s in messages.STREAMS])
    running = LiveViews(spark)
    joined = live.live_alerts_with_context(coming["fleet_events_raw"], coming["fleet_telemetry_raw"])
    query = running.start("context", joined, available_now=True)
    running.start("speed", live.live_speed_avg(coming["fleet_telemetry_raw"]), ["vehicle_id", "window_start"], True)
    assert running.wait()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    assert rows(running.read("context")) == rows(views["alerts_with_context"])
    speed = running.read("speed")
    assert rows(speed) == rows(views["vehicle_speed_5min_avg"].select(*speed.columns))
    assert state_rows(query.recentProgress[-2:]) < state_rows(query.recentProgress)


def test_dropped_rows_stay_dropped_in_a_new_session(spark, stream):
    first = LiveViews(spark)
    alerts = stream["high_severity_alerts"]
    first.start("alerts", alerts, available_now=True, state_partitions=3).awaitTermination()
    assert first.read("alerts").count() > 0
    first.drop("alerts")
    # Another object over the same root stands for a new session.
    later = LiveViews(spark, first.root)
    later.start("alerts", alerts.where("false"), available_now=True).awaitTermination()
    assert later.read("alerts").count() == 0
    later.drop("alerts")
    assert LiveViews(spark, first.root)._folder("alerts").endswith("gen-2")
    width = spark.conf.get("spark.sql.shuffle.partitions")
    view = live.live_speed_avg(stream["fleet_telemetry_raw"])
    query = first.start("speed", view, ["vehicle_id", "window_start"], True, state_partitions=3)
    query.awaitTermination()
    operators = [o for p in query.recentProgress for o in p["stateOperators"]]
    assert {o["numShufflePartitions"] for o in operators} == {3}
    assert spark.conf.get("spark.sql.shuffle.partitions") == width


def test_update_table_keeps_the_last_batch(spark):
    path = work_dir(spark, "update")
    frame = lambda *r: spark.createDataFrame(r, "k string, n long")
    sinks.write_batch(frame(("a", 1), ("b", 1)), 0, path)
    sinks.write_batch(frame(("a", 5)), 1, path)
    sinks.write_batch(frame(("a", 7)), 1, path)
    assert sorted(map(tuple, sinks.current_rows(spark, path, ["k"]).collect())) == [("a", 7), ("b", 1)]


def _files(path):
    return sum(len([n for n in names if n.startswith("part-")]) for _, _, names in os.walk(path))


@pytest.mark.parametrize("day_of", [None, "t"])
def test_folded_table_equals_its_batches(spark, day_of):
    """Many small batches, some run again: rows as if never folded, files bounded."""
    path, rng, want = work_dir(spark, "keyed"), random.Random(1), {}
    schema = T.StructType.fromDDL("k string, t timestamp, n long")
    times = [T0, T0 + timedelta(days=1), T0 + timedelta(days=400)] + ([None] if day_of else [])
    table = KeyedTable(spark, path, ["k", "t"], schema, day_of, every=5)
    most = 0
    for batch_id in range(36):
        changed = {(rng.choice("abc"), rng.choice(times)): rng.randrange(1000) for _ in range(2)}
        frame = spark.createDataFrame([(*k, n) for k, n in changed.items()], schema).coalesce(1)
        for _ in range(1 + (batch_id % 7 == 0)):
            table.write(frame, batch_id)
        if batch_id % 20 == 9:  # a new writer goes on, and a batch that is folded already changes nothing
            table = KeyedTable(spark, path, ["k", "t"], schema, day_of, every=5)
            table.write(frame.withColumn("n", F.lit(-1).cast("long")), table.manifest().through)
        want |= changed
        most = max(most, _files(path))
        if batch_id % 6 == 5:
            assert {(r.k, r.t): r.n for r in table.read().collect()} == want
    assert table.manifest().through >= 28 and table.manifest().version >= 5
    assert most <= 3 * (5 + 2) * (4 if day_of else 1) + 3 * 4 * 4 + 3
    if day_of:
        assert table.read(F.to_date(F.lit("2025-01-01"))).select("t").distinct().count() == 1


def test_reader_keeps_its_snapshot(spark):
    """What a reader planned before a fold still reads after it."""
    path = work_dir(spark, "snapshot")
    schema = T.StructType.fromDDL("k string, n long")
    table = KeyedTable(spark, path, ["k"], schema, every=3)
    put = lambda batch_id: table.write(spark.createDataFrame([("a", batch_id), (f"b{batch_id}", 0)], schema), batch_id)
    for batch_id in range(6):
        put(batch_id)
    before = table.read()
    for batch_id in range(6, 10):
        put(batch_id)
    assert before.where("k = 'a'").first()["n"] == 5 and before.count() == 7
    assert table.read().where("k = 'a'").first()["n"] == 9


def test_changes_of_a_keyed_table(spark):
    """Insert, update, retract and insert again; equal rows and batches run again change nothing."""
    path = work_dir(spark, "changes")
    schema = T.StructType.fromDDL("k string, n long, gone boolean")
    table = KeyedTable(spark, path, ["k"], schema, every=2, gone="gone", feed=True)
    table.open_feed()
    frame = lambda *r: spark.createDataFrame(list(r), schema)
    batches = [
        frame(("a", 1, False), ("b", 1, False)), frame(("a", 2, False), ("b", 1, False)), frame(("a", None, True)),
        frame(("z", None, True)), frame(("a", 3, False), (None, 5, False)), frame((None, 6, False)),
    ]
    for batch_id, rows_ in enumerate(batches):
        for _ in range(1 + batch_id % 2):
            table.write(rows_, batch_id)
    sinks.append_stream(table.change_feed(1), f"{path}-out", f"{path}-c", available_now=True).awaitTermination()
    value = lambda image: image["n"] if image else None
    got = sorted((r[sinks.BATCH], r["k"] or "", r["kind"], value(r["before"]), value(r["after"]))
                 for r in spark.read.parquet(f"{path}-out").collect())
    assert got == [(0, "a", "insert", None, 1), (0, "b", "insert", None, 1), (1, "a", "update", 1, 2),
                   (2, "a", "retract", 2, None), (4, "", "insert", None, 5), (4, "a", "insert", None, 3),
                   (5, "", "update", 5, 6)]
    assert {r["k"]: r["n"] for r in table.read().collect()} == {"a": 3, "b": 1, None: 6}


def test_rolling_view_empties_by_ticks(spark, views):
    root = work_dir(spark, "ticks")
    alerts = spark.createDataFrame(
        [("v", "high", T0), ("w", "high", T0 + timedelta(minutes=30)), ("v", "low", T0 + timedelta(minutes=10))],
        "vehicle_id string, severity string, occurred_at timestamp")
    alerts.withColumn("event_hour", F.date_trunc("hour", "occurred_at")).write.partitionBy("event_hour").parquet(f"{root}/s")
    table, seen = live.rolling_table(spark, f"{root}/t", feed=True), []
    table.open_feed()
    for i, minutes in enumerate((40, 59, 61, 75, 200)):
        spark.createDataFrame([(T0 + timedelta(minutes=minutes),)], "timestamp timestamp").write.parquet(f"{root}/ticks/{i}")
        ticks = spark.readStream.schema("timestamp timestamp").parquet(f"{root}/ticks/*")
        live.start_rolling_view(ticks, f"{root}/s", table, f"{root}/c", available_now=True).awaitTermination()
        seen.append({r["severity"]: (r["alert_count"], r["affected_vehicles"]) for r in table.read().collect()})
    both = {"high": (2, 2), "low": (1, 1)}
    assert seen == [both, both, {"high": (1, 1), "low": (1, 1)}, {"high": (1, 1)}, {}]
    kinds = [r["kind"] for r in spark.read.parquet(f"{root}/t/changes").orderBy(sinks.BATCH, "severity").collect()]
    assert kinds == ["insert", "insert", "update", "retract", "retract"]


def test_failed_fold_leaves_the_table_as_it_was(spark, monkeypatch):
    path = work_dir(spark, "broken")
    schema = T.StructType.fromDDL("k string, n long")
    table = KeyedTable(spark, path, ["k"], schema, every=2)
    put = lambda batch_id: table.write(spark.createDataFrame([("a", batch_id)], schema), batch_id)
    put(0), put(1)

    def lost(_manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lost)
        with pytest.raises(OSError):
            put(2)
    assert table.read().first()["n"] == 2 and table.manifest().version == -1
    put(2), put(3)
    assert table.read().first()["n"] == 3 and table.manifest().through == 1


def test_update_table_by_day(spark):
    path = work_dir(spark, "daily")
    frame = lambda *r: spark.createDataFrame(r, "k string, t timestamp, n long")
    sinks.write_batch(frame(("a", T0, 1), ("a", T0 + timedelta(days=1), 2)), 0, path, "t")
    sinks.write_batch(frame(("a", T0, 3)), 1, path, "t")
    read = lambda first=None: sorted(r["n"] for r in sinks.current_rows(spark, path, ["k", "t"], first).collect())
    assert read() == [2, 3]
    assert read(F.to_date(F.lit("2024-01-02"))) == [2]
    plan = sinks.current_rows(spark, path, ["k", "t"], F.to_date(F.lit("2024-01-02")))._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_message_files_round_trip(spark):
    path = work_dir(spark, "messages")
    table = EventsTable(spark, SF_DIR)
    sinks.publish(table.messages().drop("seq"), path)
    assert messages.read_messages(spark, path).count() == 1000
    typed = messages.typed_source(messages.stream_messages(spark, path, max_files_per_trigger=1), "commands")
    running = LiveViews(spark)
    running.start("commands", ops.commands_raw(typed), available_now=True).awaitTermination()
    want = ops.commands_raw(table.commands())
    assert rows(running.read("commands")) == rows(want)


def test_kafka_records(spark):
    records = spark.createDataFrame(
        [(b"fleet/events/v/alerts/low", b"{}", "t", T0, [("x-event", b"y")]), (None, b"{}", "plain", T0, None)],
        "key binary, value binary, topic string, timestamp timestamp, headers array<struct<key string, value binary>>",
    )
    got = messages.from_kafka(records).collect()
    assert [r["topic"] for r in got] == ["fleet/events/v/alerts/low", "plain"]
    assert got[0]["headers"] == {"x-event": "y"} and got[1]["headers"] is None and got[0]["value"] == "{}"


def test_dead_letters(spark):
    bodies = ['{"vehicle_id":"v","speed":1.5}', '{"vehicle_id":"v","speed":"fast"}', "not json", "", None, '{"vehicle_id":"w"}',
              '[1]', '{"vehicle_id":']
    frame = spark.createDataFrame([("fleet/telemetry/v/metrics", T0, None, b) for b in bodies], MESSAGE)
    good, dead = messages.split_dead_letters(messages.decoded(frame, messages.TELEMETRY_BODY))
    assert sorted((r["vehicle_id"], r["speed"]) for r in good.fillna(0.0).collect()) == [("v", 0.0), ("v", 1.5), ("w", 0.0)]
    assert sorted(r["value"] for r in dead.collect()) == ["", "", "[1]", "not json", '{"vehicle_id":']
    assert rows(messages.dead_letters(frame).select("value")) == rows(dead.select("value"))


@pytest.mark.parametrize("streaming", [False, True])
def test_unreadable_lines_are_dead_letters(spark, streaming):
    folder = work_dir(spark, "lines")
    good = '{"topic":"fleet/telemetry/v/metrics","ts":"2024-01-01T12:00:00Z","value":"{\\"vehicle_id\\":\\"v\\"}"}'
    bad = ["no json", '{"topic":"fleet/telemetry/v/metrics","ts":"soon","value":"{}"}', '{"topic":"fleet/eve',
           '{"topic":"fleet/events/v/alerts/low","headers":7,"value":"{}"}']
    spark.createDataFrame([(x,) for x in [good, *bad]], "value string").write.text(folder)
    if streaming:
        path = work_dir(spark, "table")
        read = messages.stream_messages(spark, folder)
        sinks.update_stream(read, path, work_dir(spark, "checkpoint"), available_now=True).awaitTermination()
        frame = spark.read.parquet(path).drop(sinks.BATCH)
    else:
        frame = messages.read_messages(spark, folder)
    assert sorted(r["value"] for r in messages.dead_letters(frame).collect()) == sorted(bad)
    assert frame.where("topic IS NOT NULL").select("topic").count() == 1  # narrow reads judge alike
    assert messages.typed_source(frame, "telemetry").first()["ts"] == T0
    assert messages.typed_source(frame, "events").count() == 0


def test_time_to_live_edge(spark):
    frame = spark.createDataFrame([(T0, T0 + timedelta(seconds=s)) for s in (0, 300, 301)] + [(T0, None)], "ts timestamp, ingest timestamp")
    fresh, expired = messages.split_expired(frame, "ingest")
    assert (fresh.count(), expired.count()) == (3, 1)


def test_rolling_rows_age_without_input(spark, stream):
    root = work_dir(spark, "rolling")
    live.start_rolling_table(stream["fleet_events_raw"], f"{root}/t", f"{root}/c", True).awaitTermination()
    now, later = (live.rolling_alert_summary(spark, f"{root}/t", AS_OF + timedelta(hours=h)) for h in (0, 2))
    assert {r["severity"]: r["alert_count"] for r in now.collect()} == {"high": 5, "medium": 5, "low": 5}
    assert later.count() == 0
    plan = live.rolling_rows(spark, f"{root}/t", AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "event_hour" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


# --- readiness ---

def status(spark, *entries):
    return lambda: spark.createDataFrame(list(entries), CONNECTOR_STATUS)


def unreachable():
    raise ConnectionError("no route")


READY = ("ingest", True, None, 150000, 150000, None)
TRUTH = [
    (lambda s: (lambda: None), (True, False, 0)),
    (lambda s: status(s, READY), (True, True, 1)),
    (lambda s: status(s, ("ingest", False, None, 0, 50000, None)), (False, True, 1)),
    (lambda s: status(s), (False, True, 0)),
    (lambda s: unreachable, (False, False, 0)),
    (lambda s: status(s, ("a", True, None, 100000, 100000, None), ("b", True, None, 50000, 50000, None),
                      ("c", True, None, 10000, 10000, None)), (True, True, 3)),
    (lambda s: status(s, ("a", True, None, 1, 1, None), ("b", False, None, 0, 1, None)), (False, True, 2)),
]


@pytest.mark.parametrize("case", range(len(TRUTH)))
def test_status_truth_table(spark, case):
    make, (ready, exists, count) = TRUTH[case]
    report = readiness.status_report(make(spark))
    assert (report["ready"], report["table_exists"], len(report["connectors"])) == (ready, exists, count)
    assert ("error" in report) == (case == 4)


def test_status_of_one_connector(spark):
    table = status(spark, ("a", True, None, 1, 1, None), ("b", False, None, 0, 1, None))
    assert readiness.status_report(table, "a")["ready"] and not readiness.status_report(table, "b")["ready"]
    assert not readiness.status_report(table, "c")["ready"]


def test_client_readiness(spark, views):
    waiting = FleetClient(spark, views, connector="ingest")
    assert not waiting.is_ready and waiting.readiness_metadata is None
    with pytest.raises(TimeoutError):
        waiting.wait_for_ready(timeout=0.2, pause=0.1)
    ready = FleetClient(spark, views, status=status(spark, READY), connector="ingest")
    assert ready.is_ready and ready.wait_for_ready(timeout=1)["historical_events"] == 150000
    other = FleetClient(spark, views, status=status(spark, READY), connector="other")
    assert not other.is_ready


def test_status_table_life(spark):
    table = readiness.StatusTable(spark, work_dir(spark, "status"))
    assert table.read() is None
    table.create()
    assert table.read().count() == 0
    table.create()
    table.upsert(status(spark, ("a", False, None, 0, 1, None))(), 0)
    table.upsert(status(spark, ("a", True, None, 1, 2, None), ("b", False, None, 0, 0, None))(), 1)
    assert sorted((r["connector_name"], r["is_ready"]) for r in table.read().collect()) == [("a", True), ("b", False)]


def write_messages(spark, path, *entries):
    frame = spark.createDataFrame(
        [("fleet/events/v/alerts/high" if not mark else readiness.MARKER_TOPIC, T0 + timedelta(seconds=s),
          {readiness.MARKER_HEADER: readiness.MARKER_VALUE} if mark else None,
          json.dumps({"vehicle_id": "v", "severity": "high"})) for s, mark in entries],
        MESSAGE,
    )
    frame.coalesce(1).write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


@pytest.mark.parametrize("cached", [False, True])
def test_connector_over_restarts(spark, cached):
    source, root = work_dir(spark, "source"), work_dir(spark, "connector")

    def run():
        connector = readiness.Connector(
            spark, "fleet", root, {"alerts": lambda m: ops.events_raw(messages.typed_source(m, "events"))}, "ts", cached
        )
        connector.start(messages.stream_messages(spark, source), available_now=True).awaitTermination()
        state = connector.status.read().first()
        return connector, (state["is_ready"], state["events_before_sentinel"], state["total_events_consumed"])

    write_messages(spark, source, (1, False), (2, False))
    assert run()[1] == (False, 0, 2)
    write_messages(spark, source, (3, False), (4, True), (5, False))
    connector, state = run()
    assert state == (True, 3, 4) and connector.view("alerts").count() == 4
    assert connector.announcements().count() == 1
    write_messages(spark, source, (6, True), (7, False))
    connector, state = run()
    assert state == (True, 3, 5) and connector.view("alerts").count() == 5
    sent = json.loads(connector.announcements().orderBy("ts").first()["value"])
    assert sent["historical_events_processed"] == 3 and sent["barrier_flush_complete"]
    # A repeated batch replaces what it wrote.
    before = rows(connector.view("alerts"))
    batch = messages.read_messages(spark, source).where(F.col("ts") > T0 + timedelta(seconds=5))
    connector._on_batch(batch, 2)
    assert rows(connector.view("alerts")) == before
    assert connector._state(2)["total"] == 5 and connector._state(2)["markers"] == 2


@pytest.mark.parametrize("order, before", [("arrival", 5), ("ts", 6)])
def test_boundary_does_not_depend_on_batches(spark, order, before):
    """Files in turn, with a late and an early message on both sides of the marker."""
    source = work_dir(spark, "cuts")
    for entries in ([(1, False), (9, False)], [(2, False)], [(3, False), (4, False), (5, True), (0, False)],
                    [(6, False)], [(4, False), (7, True)], [(8, False)]):
        write_messages(spark, source, *entries)
    answers = set()
    for files in (None, 3, 2, 1):
        connector = readiness.Connector(
            spark, "cut", work_dir(spark, "cut"),
            {"alerts": lambda m: ops.events_raw(messages.typed_source(m, "events"))}, order)
        coming = messages.stream_messages(spark, source, files, position=True)
        connector.start(coming, available_now=True).awaitTermination()
        state = connector.status.read().first()
        assert connector.view("alerts").count() == 9
        answers.add((state["is_ready"], state["sentinel_detected_at"], state["events_before_sentinel"],
                     state["total_events_consumed"], connector._state()["markers"]))
    assert answers == {(True, T0 + timedelta(seconds=5), before, 9, 2)}


def test_waiter_is_woken_by_the_announcement(spark, views):
    source, root = work_dir(spark, "w-source"), work_dir(spark, "w-connector")
    write_messages(spark, source, (1, False))
    connector = readiness.Connector(
        spark, "fleet", root, {"alerts": lambda m: ops.events_raw(messages.typed_source(m, "events"))})
    ready = connector.announcement_stream()
    client = lambda name="fleet": FleetClient(spark, views, status=connector.status.read, connector=name)
    with pytest.raises(TimeoutError):
        client().wait_for_ready(2.0, announcements=ready)
    with ThreadPoolExecutor(1) as pool:
        waiting = pool.submit(client().wait_for_ready, 120.0, announcements=ready)
        run = lambda: connector.start(
            messages.stream_messages(spark, source, position=True), available_now=True).awaitTermination()
        run()
        assert not waiting.done() and connector.view("alerts").count() == 1
        write_messages(spark, source, (2, False), (3, True), (4, False))
        run()
        got = waiting.result()
    assert got == {"sentinel_detected_at": T0 + timedelta(seconds=3), "historical_events": 2, "total_events": 3,
                   "source": "announcement"}
    assert client().wait_for_ready(5.0, announcements=ready)["source"] == "status_table"
    with pytest.raises(TimeoutError):
        client("other").wait_for_ready(2.0, announcements=ready)


def test_drain_of_a_stream_without_rows(spark):
    assert drained(spark, [], 0).count() == 0
    reports = [{"timestamp": f"2024-01-01T00:00:0{i}.000Z", "numInputRows": n} for i, n in ((0, 6), (2, 0), (4, 2))]
    got = [(r["depth"], r["percent"], r["rate"] > 0) for r in drained(spark, reports, 8).orderBy("sample_time").collect()]
    assert got == [(8, 0.0, False), (2, 75.0, True), (0, 100.0, True)]


def test_boundary_without_marker(spark):
    path = work_dir(spark, "nomarker")
    write_messages(spark, path, (1, False), (2, False))
    assert list(readiness.boundary_counts(messages.read_messages(spark, path), "ts").first()) == [None, 0, 2, 0]


def test_drain_progress(spark):
    frame = lambda *d: spark.createDataFrame([(T0 + timedelta(seconds=10 * i), n) for i, n in enumerate(d)], "sample_time timestamp, depth long")
    got = [(r["consumed"], r["percent"], r["rate"]) for r in drain_progress(frame(200, 100, 0)).orderBy("sample_time").collect()]
    assert got == [(0, 0.0, 0.0), (100, 50.0, 10.0), (200, 100.0, 10.0)]
    assert [(r["percent"], r["rate"]) for r in drain_progress(frame(0)).collect()] == [(100.0, 0.0)]
    reports = [{"timestamp": "2024-01-01T00:00:00.000Z", "numInputRows": 4}, {"timestamp": "2024-01-01T00:00:02.000Z", "numInputRows": 6}]
    assert [r["depth"] for r in query_samples(spark, reports, 10).collect()] == [6, 0]


# --- lifecycle ---

def test_registered_views(spark, views):
    drop_registered(spark, views)
    assert ensure_views(spark, views) == views.names()
    assert ensure_views(spark, views) == []
    spark.catalog.dropTempView("vehicle_speeds")
    assert ensure_views(spark, views) == ["vehicle_speeds"]
    dropped = drop_registered(spark, views)
    assert len(dropped) == 18 and set(dropped[-3:]) == {"fleet_telemetry_raw", "fleet_events_raw", "fleet_commands_raw"}
    assert drop_registered(spark, views) == []


def test_define_and_drop(spark):
    views = ViewSet.over(EventsTable(spark, SF_DIR), AS_OF)
    incident = lambda e: ops.vehicle_high_alerts(e, "vehicle_001")
    views.define("incident", ("fleet_events_raw",), incident)
    assert not views.define_if_missing("incident", ("fleet_events_raw",), incident)
    with pytest.raises(ValueError):
        views.define("incident", ("fleet_events_raw",), incident)
    views.define("incident_count", ("incident",), lambda i: i.groupBy("event_type").count())
    with pytest.raises(ValueError):
        views.drop("incident")
    assert views.drop("incident", cascade=True) == ["incident_count", "incident"]
    assert views.drop("incident") == [] and "incident" not in views
    dropped = views.drop("fleet_events_raw", cascade=True)
    assert dropped[-1] == "fleet_events_raw" and "alerts_with_context" in dropped
    assert "vehicle_speeds" in views


def test_live_views(spark, stream):
    running = LiveViews(spark)
    view = stream["high_severity_alerts"]
    first = running.start("high", view)
    assert running.start("high", view) is first and running.running() == ["high"]
    first.processAllAvailable()
    assert running.read("high").count() == 65
    assert running.ensure({"high": (view, None)}) == []
    running.stop("high")
    assert running.running() == [] and running.read("high").count() == 65
    assert running.ensure({"high": (view, None)}) == ["high"]
    running._queries["high"].processAllAvailable()
    assert running.read("high").count() == 65
    running.drop("high")
    query = running.start("high", view, available_now=True)
    client = FleetClient(spark, stream)
    assert client.query_new_view(query, lambda: running.read("high"), timeout=60).count() == 65


def test_views_without_rows_yet(spark, stream):
    running = LiveViews(spark)
    nobody = stream["high_severity_alerts"].where("vehicle_id = 'nobody'")
    counts = stream["high_severity_alerts"].where("vehicle_id = 'nobody'").groupBy("vehicle_id").count()
    running.start("rows", nobody, available_now=True)
    running.start("counts", counts, ["vehicle_id"], available_now=True)
    running.start("daily", live.live_speed_avg(stream["fleet_telemetry_raw"].where("vehicle_id = 'nobody'")),
                  ["vehicle_id", "window_start"], True, "window_start")
    assert running.wait()
    assert [running.read(n).count() for n in ("rows", "counts", "daily")] == [0, 0, 0]
    assert running.read("rows").columns == nobody.columns and set(running.read("counts").columns) == {"vehicle_id", "count"}
    assert running.read("daily", F.to_date(F.lit("2024-01-01"))).count() == 0
    connector = readiness.Connector(
        spark, "c", work_dir(spark, "none"),
        {"none": lambda m: ops.events_raw(messages.typed_source(m, "events")).where("vehicle_id = 'nobody'")}, "ts")
    connector.start(EventsTable(spark, SF_DIR, streaming=True).messages(), available_now=True).awaitTermination()
    assert connector.view("none").count() == 0
    assert not connector.status.read().first()["is_ready"]


def test_persisted_view(spark, views):
    kept = persist_view(spark, views["high_severity_alerts"], "high")
    assert rows(kept) == rows(views["high_severity_alerts"])


# --- query API ---

def test_guard():
    safe = ["SELECT 1", "  select a from b;  ", "SELECT created_at FROM t", "WITH a AS (SELECT 1) SELECT * FROM a",
            "SELECT 'please update; now'", "SELECT `drop`, \"it's\" FROM t", "SELECT t.`text` FROM t"]
    unsafe = ["SELECT 1; SELECT 2", "DROP TABLE t", "SELECT 1 UNION DELETE", "", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a",
              "SELECT java_method('java.lang.System', 'getProperty', 'x')", "SELECT `reflect`('a', 'b')",
              "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM `parquet` . `x`", "SELECT r'\\', 1; DROP TABLE t --'",
              "SELECT 1 /* x */", "SELECT 'a' 'b\\'; DROP TABLE t"]
    assert all(map(is_safe_select, safe)) and not any(map(is_safe_select, unsafe))


def test_select_reads_no_file_by_any_name(spark, views):
    client = FleetClient(spark, views)
    classes = ("org.apache.spark.sql.execution.datasources.text.TextFileFormat",
               "org.apache.spark.sql.execution.datasources.v2.text.TextDataSourceV2")
    for name in classes:
        assert spark.sql(f"SELECT * FROM `{name}`.`/etc/hostname`").count() >= 0
        with pytest.raises(AnalysisException):
            client.select(f"SELECT * FROM `{name}`.`/etc/hostname`")
    assert client.select("SELECT count(*) AS n FROM fleet_events_raw").first()["n"] > 0
    assert spark.sql(f"SELECT * FROM `{classes[0]}`.`/etc/hostname`").count() >= 0


def _files_read(df):
    """By the metrics of the scan."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    return run.executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_newest_rows_of_a_saved_view(spark):
    """Forty days of alerts, a few without a time: top-k like over all rows, from the newest files only."""
    n = 4000
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 864)
    telemetry = spark.range(n).select(
        F.format_string("vehicle_%03d", F.col("id") % 7).alias("vehicle_id"), (F.col("id") % 90).cast("double").alias("speed"),
        F.lit(5.0).alias("fuel_level"), (F.lit(150.0) + F.col("id") % 100).alias("engine_temp"), F.lit(30.0).alias("tire_pressure"),
        F.lit(12.0).alias("battery_voltage"), F.lit(42.3).alias("latitude"), F.lit(-71.0).alias("longitude"),
        F.when(F.col("id") % 1000 != 5, at).alias("ts"), F.lit("fleet/telemetry/v/metrics").alias("topic"))
    other = EventsTable(spark, SF_DIR)
    plain = ViewSet(telemetry, other.events(), other.commands(), as_of=AS_OF)
    saved = ViewSet(telemetry, other.events(), other.commands(), as_of=AS_OF)
    zoned = saved.save("vehicle_speeds", work_dir(spark, "zones"), "recorded_at")
    saved.save("high_engine_temp_vehicles", work_dir(spark, "zones"), "recorded_at")
    files = _files_read(zoned.read())
    assert files >= 40
    assert zoned.zones().agg(F.sum("rows")).first()[0] == plain["vehicle_speeds"].count()
    for k in (0, 1, 20, 100, 3990, 5000):
        got = saved.newest_rows("vehicle_speeds", "recorded_at", k)
        assert rows(topk.newest(got, "recorded_at", k)) == rows(topk.newest(plain["vehicle_speeds"], "recorded_at", k))
        if k <= 20:
            assert _files_read(got) <= 3
    for vehicle, since in ((None, None), ("vehicle_003", None), ("nobody", None), ("vehicle_001", "4h")):
        ask = dict(vehicle_id=vehicle, since=since, limit=15)
        assert rows(presets.preset(saved, "high_engine_temp", **ask)) == rows(presets.preset(plain, "high_engine_temp", **ask))
    rare = saved.newest_rows("high_engine_temp_vehicles", "recorded_at", 15, F.col("vehicle_id") == "vehicle_003")
    assert _files_read(rare) < files
    assert rows(presets.newest_speeds(saved)) == rows(presets.newest_speeds(plain))
    empty = ZonedView.save(plain["vehicle_speeds"].where("false"), work_dir(spark, "zones"), "recorded_at")
    assert empty.newest(3).count() == 0


def test_query_errors_and_options(spark, views):
    client = FleetClient(spark, views)
    with pytest.raises(ValueError):
        client.query()
    for bad in (dict(pattern="nowhere/x"), dict(pattern="fleet/commands/*", window="5min"),
                dict(pattern="fleet/commands/*", enrich="x"), dict(pattern="fleet/commands/*", region="boston")):
        with pytest.raises(LookupError):
            client.query(**bad)
    with pytest.raises(ValueError):
        client.query("fleet/events/*", since="soon")
    with pytest.raises(ValueError):
        client.select("DROP TABLE x")
    with pytest.raises(KeyError):
        client.preset("nothing")
    fallback = client.query("fleet/telemetry/*/metrics", window="1h", limit=5)
    assert "avg_speed_mph" in fallback.columns and fallback.count() == 5
    one = client.query("fleet/telemetry/vehicle_002/metrics", limit=1000)
    assert {r["vehicle_id"] for r in one.collect()} == {"vehicle_002"}
    whole = client.query("fleet/telemetry/vehicle_002/metrics", limit=1000, strict=False)
    assert whole.count() == 600
    medium = client.query("fleet/events/vehicle_002/alerts/medium", limit=1000)
    assert {r["vehicle_id"] for r in medium.collect()} == {"vehicle_002"}
    context = client.query("fleet/events/vehicle_002/alerts/high", enrich="context", limit=1000)
    assert {(r["vehicle_id"], r["severity"]) for r in context.collect()} <= {("vehicle_002", "high")}
    assert client.topic_info("fleet/events/*/alerts/high").first()["enriched"] == "alerts_with_context"
    assert client.topic_list(backed=True).count() == 6
    flags = {r["id"]: r[3:] for r in client.preset_list().collect()}
    assert len(flags) == 12 and flags["fleet_alert_summary"] == (False, False, False)
    assert flags["vehicle_activity"] == (False, True, True) and flags["boston_region"] == (True, False, False)
    assert flags["alerts_context"] == (True, True, True) and flags["speed_averages"] == (True, True, False)


def test_clients_do_not_see_each_others_views(spark, views):
    other = ViewSet.over(EventsTable(spark, "/root/testdata/sf0.01"), AS_OF)
    counts = [
        FleetClient(spark, v).query(sql="SELECT count(*) AS n FROM fleet_events_raw").first()["n"]
        for v in (views, other, views)
    ]
    assert counts == [201, 2014, 201]


def test_topic_column_under_another_name(spark, views):
    client = FleetClient(spark, views, topic_as="message_topic")
    found = client.sql("SELECT count(*) AS n FROM fleet_events_raw WHERE message_topic LIKE 'fleet/events/%/alerts/high'")
    assert found.first()["n"] == 65


def test_preset_ignores_unknown_duration(spark, views):
    client = FleetClient(spark, views)
    assert rows(client.preset("fuel_levels", since="2h")) == rows(client.preset("fuel_levels"))
    assert client.preset("fuel_levels", limit=0).count() == 0


def test_subscription_errors(spark, views):
    client = FleetClient(spark, views, status=status(spark, ("a", False, None, 0, 1, None)))
    kinds = [r["type"] for r in client.subscription_log("fleet/events/*/alerts/high", "3h").orderBy("step").collect()]
    assert kinds == ["backfill_status", "status", "error"]
    assert client.subscription_log("nowhere", "4h").where("type = 'error'").count() == 1
    log = client.subscription_log("fleet/events/*/alerts/high", "48h", limit=3).collect()
    assert [r["type"] for r in log] == ["backfill_status", "status", "history_start", "history", "history", "history", "history_done"]


def test_message_forms(spark):
    frame = spark.createDataFrame(
        [("a/v", T0, None, '{"vehicle_id":"v","topic":"x","n":1.5,"none":null,"p":{"q":[1]}}'), ("b", T0, None, "junk"), ("c", T0, None, None)],
        MESSAGE,
    )
    lines = [r["event"] for r in replay.rendered_messages(frame, form="line").orderBy("topic").collect()]
    stamp = "[live   ] 2024-01-01T12:00:00.000000Z"
    assert lines[0] == f'{stamp}  a/v  vehicle=v  n=1.5  p={{"q":[1]}}'
    assert lines[1].startswith(f"{stamp}  b  vehicle=") and lines[2].startswith(f"{stamp}  c  vehicle=")
    texts = [json.loads(r["event"]) for r in replay.rendered_messages(frame).orderBy("topic").collect()]
    assert [t["payload"] for t in texts[1:]] == [{"raw": "junk"}, {}]
    assert texts[0]["payload"]["p"] == {"q": [1]} and texts[0]["source"] == "live"


def test_live_only_subscription(spark, views):
    root = work_dir(spark, "liveonly")
    client = FleetClient(spark, views)
    client.subscribe("fleet/events/vehicle_003/alerts/high", EventsTable(spark, SF_DIR, streaming=True).messages(),
                     f"{root}/t", f"{root}/c", available_now=True).awaitTermination()
    got = spark.read.parquet(f"{root}/t/source=live")
    assert got.count() == views["high_severity_alerts"].where("vehicle_id = 'vehicle_003'").count()


def _in_files(spark, path, parts):
    """A stream that brings each frame of ``parts`` in a batch of its own."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.option("timestampFormat", JSON_TIMES["timestampFormat"]).json(f"{path}/{i:03}")
    return messages.stream_messages(spark, f"{path}/*", max_files_per_trigger=1)


@pytest.mark.parametrize("since, limit, first", [("30m", None, 3), ("24h", 5, 5), ("24h", None, 65)])
def test_subscription_brings_nothing_of_the_view_again(spark, views, since, limit, first):
    """Span and limit bound the whole subscription: what history leaves out does not come back as live."""
    root = work_dir(spark, "nocut")
    client = FleetClient(spark, views)
    coming = EventsTable(spark, SF_DIR, streaming=True).messages()
    for _ in range(2):  # the second start goes on where the first stopped
        client.subscribe("fleet/events/*/alerts/high", coming, f"{root}/t", f"{root}/c", since=since, limit=limit,
                         available_now=True).awaitTermination()
        got = replay.read_replay(spark, f"{root}/t").groupBy("source").count().collect()
        assert [tuple(r) for r in got] == [("history", first)]


def _alert(minute, vehicle="vehicle_001", description="d", second=0):
    body = {"vehicle_id": vehicle, "event_type": "low_fuel", "severity": "high", "description": description}
    return (f"fleet/events/{vehicle}/alerts/high", datetime(2024, 1, 1, 11, minute, second), None, json.dumps(body))


def test_spent_keys_over_batches_and_restarts(spark):
    """A history key keeps one message back, in whatever batch it comes; late and changed ones are live."""
    root = work_dir(spark, "ledger")
    frame = lambda *rows: spark.createDataFrame(list(rows), MESSAGE)
    known = frame(_alert(1), _alert(2), _alert(3), _alert(3, description="other"), _alert(0))
    views = ViewSet(*[messages.typed_source(known, s) for s in ("telemetry", "events", "commands")], as_of=T0)
    client = FleetClient(spark, views)
    batches = [
        frame(_alert(1), _alert(20)),                       # a repeat, a new one
        frame(_alert(1), _alert(2), _alert(2)),             # its key is spent; one of two copies is kept back
        frame(_alert(3, description="third"), _alert(4)),   # same instant, other content; late and unknown
    ]
    more = [
        frame(_alert(2), _alert(3)),                        # spent before the restart; not yet spent
        frame(_alert(0), _alert(0, second=30), (_alert(0)[0], datetime(2024, 1, 1, 10, 59), None, "{}")),
    ]
    for i, part in enumerate(batches):
        part.coalesce(1).write.json(f"{root}/m/{i:03}")
    for again in (False, True):
        if again:
            for i, part in enumerate(more):
                part.coalesce(1).write.json(f"{root}/m/{len(batches) + i:03}")
        coming = messages.stream_messages(spark, f"{root}/m/*", max_files_per_trigger=1)
        client.subscribe("fleet/events/*/alerts/high", coming, f"{root}/t", f"{root}/c", since="3570s",
                         available_now=True).awaitTermination()
    got = replay.read_replay(spark, f"{root}/t")
    live_rows = sorted(
        (r.event_time.minute, r.event_time.second, json.loads(r.event)["payload"]["description"])
        for r in got.where("source = 'live'").collect()
    )
    # Minute 0 is outside the span: neither history nor live.
    assert live_rows == [(1, 0, "d"), (2, 0, "d"), (2, 0, "d"), (3, 0, "third"), (4, 0, "d"), (20, 0, "d")]
    assert got.where("source = 'history'").count() == 4


def test_repeated_batch_keeps_the_same_records(spark):
    """A batch that is run again after a failure finds the ledger as it was."""
    log = subscription.Subscription(spark, work_dir(spark, "again"), work_dir(spark, "again-c"))
    record = lambda minute: ("t", datetime(2024, 1, 1, 11, minute), "e", "")
    rows = lambda *minutes: spark.createDataFrame([record(m) for m in minutes], subscription.STORED)
    log._past(rows(1, 2), F.lit(datetime(2024, 1, 1)), lambda r: r.drop("content"))
    for batch_id, minutes in ((0, (1, 1, 5)), (1, (1, 2, 2)), (1, (1, 2, 2)), (0, (1, 1, 5)), (2, (1, 2))):
        log._write(rows(*minutes), batch_id)
    got = [(r._batch_id, r.event_time.minute) for r in log.live().collect()]
    assert sorted(got) == [(0, 1), (0, 5), (1, 1), (1, 2), (2, 1), (2, 2)]


def test_web_log_in_order(spark, views):
    root = work_dir(spark, "web")
    client = FleetClient(spark, views)
    rows_of = EventsTable(spark, SF_DIR).messages().drop("seq")
    fresh = spark.createDataFrame([_alert(30, "vehicle_009", "new")], MESSAGE)
    coming = _in_files(spark, f"{root}/m", [rows_of.where("ts < '2024-01-01 11:30:00'"), rows_of, fresh])
    args = ("fleet/events/*/alerts/high", coming, f"{root}/t", f"{root}/c", "4h")
    client.web_subscription(*args, available_now=True).awaitTermination()
    log = client.web_records(f"{root}/t", f"{root}/c").collect()
    kinds = [r["type"] for r in log]
    n = views["high_severity_alerts"].where("occurred_at > '2024-01-01 08:00:00'").count()
    before = views["high_severity_alerts"].where(
        "occurred_at > '2024-01-01 08:00:00' AND occurred_at < '2024-01-01 11:30:00'").count()
    # The second file brings the first one's rows again: each key keeps back one message only.
    assert kinds == ["backfill_status", "history_start", *["history"] * n, "history_done", "status", *["live"] * (before + 1)]
    assert log[1]["body"] == f"count={n}" and json.loads(log[-1]["body"])["payload"]["description"] == "new"
    times = [r["event_time"] for r in log if r["type"] == "history"]
    assert times == sorted(times)


def test_web_log_without_history(spark, views):
    root = work_dir(spark, "web-error")
    client = FleetClient(spark, views)
    coming = EventsTable(spark, SF_DIR, streaming=True).messages()
    client.web_subscription("fleet/events/*/alerts/high", coming, f"{root}/t", f"{root}/c", "3h",
                            available_now=True).awaitTermination()
    kinds = [r["type"] for r in client.web_records(f"{root}/t", f"{root}/c").collect()]
    assert kinds == ["backfill_status", "error", "status", *["live"] * 65]


def test_replay_history_can_be_written_again(spark, views, stream):
    root = work_dir(spark, "again")
    cut = datetime(2024, 1, 1, 6)
    for _ in range(2):
        history = replay.history_slice(views["high_severity_alerts"], "occurred_at", None, cut)
        after = replay.live_slice(stream["high_severity_alerts"], "occurred_at", cut)
        replay.start_replay(spark, history, after, f"{root}/t", f"{root}/c", True).awaitTermination()
    assert replay.read_replay(spark, f"{root}/t").count() == 65


def test_replay_without_live_rows(spark, views, stream):
    root, cut = work_dir(spark, "quiet"), datetime(2024, 1, 2)
    history = replay.history_slice(views["high_severity_alerts"], "occurred_at", None, cut)
    after = replay.live_slice(stream["high_severity_alerts"], "occurred_at", cut)
    replay.start_replay(spark, history, after, f"{root}/t", f"{root}/c", True).awaitTermination()
    got = replay.read_replay(spark, f"{root}/t").groupBy("source").count().collect()
    assert [tuple(r) for r in got] == [("history", 65)]


def test_context_across_the_cut(spark, views, stream):
    root = work_dir(spark, "cut")
    replay.context_then_live(
        spark, (views["fleet_events_raw"], views["fleet_telemetry_raw"]),
        (stream["fleet_events_raw"], stream["fleet_telemetry_raw"]),
        datetime(2024, 1, 1, 6), f"{root}/t", f"{root}/c", available_now=True,
    ).awaitTermination()
    got = replay.read_replay(spark, f"{root}/t").drop("source")
    assert rows(got) == rows(views["alerts_with_context"].select(*got.columns))


def test_stored_context_does_not_grow_with_the_pairs(spark, stream):
    """Rows of one vehicle within one span: four times the rows are sixteen times the pairs."""
    size = {}
    for n in (150, 600):
        rng = random.Random(n)
        moments = lambda: [(rng.randrange(100_000_000),) for _ in range(n)]
        at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 05:00:00").cast("timestamp")) + F.col("at"))
        vehicle, some = F.lit("vehicle_001").alias("vehicle_id"), (F.col("at") % 100).cast("double")
        events = spark.createDataFrame(moments(), "at long").select(
            vehicle, F.lit("low_fuel").alias("event_type"), F.lit("high").alias("severity"),
            F.col("at").cast("string").alias("description"), at.alias("occurred_at"))
        telemetry = spark.createDataFrame(moments(), "at long").select(
            vehicle, *[some.alias(c) for c in SENSORS], at.alias("recorded_at"))
        root = work_dir(spark, "dense")
        replay.context_then_live(
            spark, (events, telemetry),
            (stream["fleet_events_raw"].where("false"), stream["fleet_telemetry_raw"].where("false")),
            datetime(2024, 1, 1, 6), f"{root}/t", f"{root}/c", available_now=True,
        ).awaitTermination()
        got = replay.read_replay(spark, f"{root}/t").drop("source")
        want = joins.alerts_with_context(events, telemetry)
        assert got.columns == want.columns
        told = [frame.agg(F.count("*"), F.sum(F.hash(*want.columns).cast("long"))).first() for frame in (got, want)]
        assert told[0] == told[1] and told[0][0] > n * n / 3
        size[n] = sum(f.stat().st_size for f in Path(f"{root}/t/source=history").glob("*.parquet"))
    assert size[600] < 8 * size[150]


def test_registry_is_default(spark, views):
    assert FleetClient(spark, views).registry.mappings == Registry().mappings
