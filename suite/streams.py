"""Streaming forms, run to the end of the data and compared with their batch results."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from fleetviews.functions.timing import moment
from fleetviews.operators.joins import TWO_MINUTES
from fleetviews.operators import rolling, views, windows
from fleetviews.plans import presets
from fleetviews.plans.client import FleetClient
from fleetviews.plans.lifecycle import LiveViews
from fleetviews.plans.live_catalog import LiveCatalog
from fleetviews.plans.viewset import ViewSet
from fleetviews.schemas import EVENT_BODY, TELEMETRY_BODY
from fleetviews.sources import messages, sinks
from fleetviews.sources.events_table import AS_OF
from fleetviews.streaming import live, readiness, replay, stored
from fleetviews.streaming.progress import drained
from .analytics import CONTEXT_ROW, HOPPING, WINDOW_ROW, six
from .base import NOW, check
from .rows import EVENT_ROW, damaged

CUT = AS_OF - timedelta(hours=1)
CUT_SQL = "TIMESTAMP '2024-01-01 11:00:00'"
MARKER_AT = "2024-01-01 06:00:00"


def _maintained(f, name, view, keys=None, day_of=None):
    """A streaming view run over all there is, then read back."""
    running = LiveViews(f.spark, f.work(name))
    running.start(name, view, keys, True, day_of).awaitTermination()
    return running.read(name)


@check("r01_live_filter_view", "SELECT vehicle_id, engine_temp AS engine_temp_f, recorded_at FROM telemetry WHERE engine_temp > 220")
def _(f):
    return _maintained(f, "r01", f.live["high_engine_temp_vehicles"])


@check("r02_live_tumbling_avg", f"SELECT {WINDOW_ROW} FROM windows")
def _(f):
    view = live.live_speed_avg(f.live["fleet_telemetry_raw"])
    return six(_maintained(f, "r02", view, ["vehicle_id", "window_start"], "window_start"), "avg_speed_mph")


@check("w04_live_hopping_avg", HOPPING)
def _(f):
    stream = live.watermarked(f.live["fleet_telemetry_raw"], "recorded_at")
    view = windows.vehicle_speed_avg(stream, slide="1 minute")
    return six(_maintained(f, "w04", view, ["vehicle_id", "window_start"], "window_start"), "avg_speed_mph")


def _rolling_table(f, name):
    root = f.work(name)
    live.start_rolling_table(
        f.live["fleet_events_raw"], f"{root}/table", f"{root}/checkpoint", available_now=True
    ).awaitTermination()
    return f"{root}/table"


@check("r03_rolling_alert_summary", "SELECT * FROM summary")
def _(f):
    return live.rolling_alert_summary(f.spark, _rolling_table(f, "r03s"), AS_OF)


@check("r03_rolling_event_counts", "SELECT * FROM activity")
def _(f):
    return live.rolling_event_counts(f.spark, _rolling_table(f, "r03c"), AS_OF)


@check("r04_live_interval_join", f"SELECT {CONTEXT_ROW}, CASE WHEN alert_time <= {CUT_SQL} THEN 'history' ELSE 'live' END AS source FROM context")
def _(f):
    """The past joins as a batch, alerts after the cut as streams with bounded state."""
    root, past, present = f.work("r04"), f.until(CUT), f.live_after(CUT, TWO_MINUTES)
    replay.context_then_live(
        f.spark,
        (past["fleet_events_raw"], past["fleet_telemetry_raw"]),
        (present["fleet_events_raw"], present["fleet_telemetry_raw"]),
        CUT, f"{root}/table", f"{root}/checkpoint", available_now=True,
    ).awaitTermination()
    return replay.read_replay(f.spark, f"{root}/table")


@check("r05_view_on_view", "SELECT vehicle_id, speed AS speed_mph, latitude, longitude, recorded_at, topic FROM telemetry WHERE speed > 60")
def _(f):
    """A stream over the table another stream maintains."""
    root = f.work("r05")
    first = LiveViews(f.spark, root)
    first.start("speeds", f.live["vehicle_speeds"], available_now=True).awaitTermination()
    table = first.read("speeds")
    feed = live.change_feed(f.spark, f"{root}/speeds/gen-0/table", table.schema)
    second = feed.where(F.col("speed_mph") > 60)
    first.start("fast", second, available_now=True).awaitTermination()
    return first.read("fast")


@check("r06_history_then_live", f"""SELECT topic, occurred_at AS event_time, CASE WHEN occurred_at <= {CUT_SQL} THEN 'history' ELSE 'live' END AS source
  FROM alerts WHERE severity = 'high' AND occurred_at > {NOW} - INTERVAL 4 HOUR""")
def _(f):
    root = f.work("r06")
    f.recent_client(4).subscribe(
        "fleet/events/*/alerts/high", f.live_messages(CUT), f"{root}/table", f"{root}/checkpoint",
        cut=CUT, since="4h", available_now=True,
    ).awaitTermination()
    return replay.read_replay(f.spark, f"{root}/table").drop("event")


OVERLAP_FROM, OVERLAP_TO = "2024-01-01 11:00:00", "2024-01-01 11:10:00"


@check("q06_subscribe_any_topic", f"""SELECT topic, issued_at AS event_time, command_type, vehicle_id FROM commands
  WHERE command_type = 'reduce_speed' AND issued_at > {CUT_SQL}""")
def _(f):
    """No view is mapped to this topic; live messages of it arrive all the same."""
    root = f.work("q06")
    f.client.subscribe(
        "fleet/commands/*/reduce_speed", f.live_messages(CUT), root, f"{root}-checkpoint", CUT, "4h", available_now=True
    ).awaitTermination()
    got = f.spark.read.parquet(f"{root}/source=live")
    fields = [F.get_json_object("event", f"$.payload.{n}").alias(n) for n in ("command_type", "vehicle_id")]
    return got.select("topic", "event_time", *fields)


@check("r06_overlap_deduplicated", f"""SELECT vehicle_id, occurred_at, event_type,
  CASE WHEN occurred_at <= TIMESTAMP '{OVERLAP_TO}' THEN 'history' ELSE 'live' END AS source FROM alerts""")
def _(f):
    """Ten minutes arrive from both sides, and live rows arrive twice; each is kept once."""
    root, columns = f.work("r06o"), ["vehicle_id", "occurred_at", "event_type"]
    history = f.events.select(*columns).where(F.col("occurred_at") <= moment(OVERLAP_TO))
    coming = replay.live_slice(f.live["fleet_events_raw"].select(*columns), "occurred_at", OVERLAP_FROM)
    twice = coming.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    replay.start_overlapping_replay(
        f.spark, history, twice, columns[:2], "occurred_at", OVERLAP_FROM,
        f"{root}/table", f"{root}/checkpoint", available_now=True,
    ).awaitTermination()
    return replay.read_replay(f.spark, f"{root}/table")


@check("r07_live_subscription", f"SELECT {EVENT_ROW} FROM alerts WHERE topic LIKE 'fleet/events/vehicle_004/%'")
def _(f):
    return _maintained(f, "r07", live.subscribed(f.live["fleet_events_raw"], "fleet/events/vehicle_004/>"))


@check("r18_alert_watch", f"SELECT {EVENT_ROW} FROM alerts WHERE severity = 'high'")
def _(f):
    return _maintained(f, "r18", live.alert_watch(f.live["fleet_events_raw"]))


@check("r19_change_feed", """SELECT vehicle_id, count(*) AS n FROM alerts WHERE severity = 'high' GROUP BY vehicle_id""")
def _(f):
    """A consumer triggered by new rows of an append view."""
    root = f.work("r19")
    source = LiveViews(f.spark, root)
    source.start("high", f.live["high_severity_alerts"], available_now=True).awaitTermination()
    feed = live.change_feed(f.spark, f"{root}/high/gen-0/table", source.read("high").schema)
    counts = feed.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("n"))
    source.start("counts", counts, ["vehicle_id"], available_now=True).awaitTermination()
    return source.read("counts")


@check("r20_once_per_key", "SELECT vehicle_id, occurred_at, event_type FROM alerts")
def _(f):
    """Every row offered twice, each key kept once."""
    rows = f.live["fleet_events_raw"].select("vehicle_id", "occurred_at", "event_type")
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return _maintained(f, "r20", replay.once_per_key(twice, ["vehicle_id", "occurred_at"], "occurred_at"))


@check("r20_once_per_key_spread", "SELECT vehicle_id, occurred_at, event_type FROM alerts")
def _(f):
    rows = f.live["fleet_events_raw"].select("vehicle_id", "occurred_at", "event_type")
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    once = replay.once_per_key(twice, ["vehicle_id", "occurred_at"], "occurred_at", spread=True)
    return _maintained(f, "r20s", once)


@check("r21_live_latest_position", """SELECT vehicle_id, arg_max(latitude, recorded_at) AS latitude, arg_max(longitude, recorded_at) AS longitude,
  arg_max(speed, recorded_at) AS speed_mph, max(recorded_at) AS recorded_at FROM telemetry GROUP BY vehicle_id""")
def _(f):
    return _maintained(f, "r21", windows.last_known_position(f.live["fleet_telemetry_raw"]), ["vehicle_id"])


@check("s09_exactly_once_sink", "SELECT topic, seq FROM alerts")
def _(f):
    """The sink runs twice from one checkpoint; the second run finds nothing new."""
    root = f.work("s09")
    for _run in range(2):
        rows = f.stream.events().select("topic", "seq")
        sinks.update_stream(rows, f"{root}/table", f"{root}/checkpoint", available_now=True).awaitTermination()
    return f.spark.read.parquet(f"{root}/table").drop(sinks.BATCH)


@check("s07_live_dead_letters", """SELECT CASE WHEN seq % 50 IN (7, 11) THEN 'dead' ELSE 'good' END AS part, topic, recorded_at AS ts FROM telemetry""")
def _(f):
    """Good rows and dead letters of one stream, written by the same batches."""
    connector = readiness.Connector(
        f.spark, "telemetry", f.work("s07"), {"decoded": lambda m: messages.decoded(m, TELEMETRY_BODY)}, order="ts"
    )
    connector.start(damaged(f.stream.messages()).drop("seq"), available_now=True).awaitTermination()
    parts = zip(("good", "dead"), messages.split_dead_letters(connector.view("decoded")))
    good, dead = (part.select(F.lit(name).alias("part"), "topic", "ts") for name, part in parts)
    return good.unionByName(dead)


# --- readiness ---

def _with_marker(f):
    """The message stream with a boundary marker at six o'clock."""
    folder = f.work("marker")
    readiness.marker(f.spark, MARKER_AT).write.parquet(folder)
    marker = f.spark.readStream.schema(f.spark.read.parquet(folder).schema).parquet(folder)
    return f.stream.messages().drop("seq").unionByName(marker)


def _connected(f, name):
    connector = readiness.Connector(
        f.spark, "fleet_events", f.work(name),
        {
            "alerts": lambda m: views.events_raw(messages.typed_source(m, "events")),
            "dead": lambda m: messages.split_dead_letters(
                messages.decoded(messages.routed(m, "fleet/events/>"), EVENT_BODY))[1],
        },
        order="ts",
    )
    connector.start(_with_marker(f), available_now=True).awaitTermination()
    return connector


BEFORE = f"count(*) FILTER (t < TIMESTAMP '{MARKER_AT}')"


@check("a11_boundary_counts", f"SELECT TIMESTAMP '{MARKER_AT}' AS sentinel_detected_at, {BEFORE} AS events_before_sentinel, count(*) AS total_events_consumed, 0::BIGINT AS duplicate_markers FROM base")
def _(f):
    rows = f.table.messages().drop("seq").unionByName(readiness.marker(f.spark, MARKER_AT))
    return readiness.boundary_counts(rows, "ts")


@check("a11_boundary_by_arrival", f"""SELECT n AS files_a_batch, true AS is_ready, TIMESTAMP '{MARKER_AT}' AS sentinel_detected_at,
    count(*) FILTER (seq % 4 < 2) AS events_before_sentinel, count(*) AS total_events_consumed
  FROM base, (VALUES (0), (7), (2)) v(n) GROUP BY n""")
def _(f):
    """Messages arrive in four files whose event times overlap, the marker between the second and the
    third: however many files a batch takes, what lies before it is what arrived before it."""
    source = f.work("a11")
    rows = f.table.messages()
    for part in range(4):
        if part == 2:
            sinks.publish(readiness.marker(f.spark, MARKER_AT), f"{source}/2-marker")
        sinks.publish(rows.where(F.col("seq") % 4 == part).drop("seq").coalesce(1), f"{source}/{part}-rows")
    answers = []
    for files in (0, 7, 2):
        connector = readiness.Connector(f.spark, "fleet_events", f.work(f"a11-{files}"), {})
        coming = messages.stream_messages(f.spark, f"{source}/*/*", files or None, position=True)
        connector.start(coming, available_now=True).awaitTermination()
        answers.append(connector.status.read().select(
            F.lit(files).alias("files_a_batch"), "is_ready", "sentinel_detected_at", "events_before_sentinel",
            "total_events_consumed",
        ))
    return reduce(DataFrame.unionByName, answers)


@check("s12_folded_view", f"SELECT {WINDOW_ROW} FROM windows")
def _(f):
    """A tumbling view over twelve batches, folded after every third: the rows are those of one batch."""
    rows = f.table.messages()
    coming = _in_batches(f, "s12m", [rows.where(F.col("seq") % 12 == i) for i in range(12)])
    telemetry = views.telemetry_raw(messages.typed_source(coming, "telemetry"))
    running = LiveViews(f.spark, f.work("s12f"))
    # The batches overlap in time by the whole day, so nothing may count as late.
    view = live.live_speed_avg(telemetry, delay="2 days")
    running.start(
        "speeds", view, ["vehicle_id", "window_start"], True, "window_start", compact_every=3
    ).awaitTermination()
    return six(running.read("speeds"), "avg_speed_mph")


@check("s19_marked_messages", "SELECT (SELECT count(*) FROM base) AS business, 1::BIGINT AS markers")
def _(f):
    rows = f.table.messages().drop("seq").unionByName(readiness.marker(f.spark, MARKER_AT))
    return rows.agg(
        F.count_if(~readiness.is_marker()).alias("business"), F.count_if(readiness.is_marker()).alias("markers")
    )


@check("r08_views_without_marker", f"SELECT {EVENT_ROW} FROM alerts")
def _(f):
    return _connected(f, "r08").view("alerts")


@check("r09_r11_connector_status", f"SELECT 'fleet_events' AS connector_name, true AS is_ready, TIMESTAMP '{MARKER_AT}' AS sentinel_detected_at, {BEFORE} AS events_before_sentinel, count(*) AS total_events_consumed FROM base")
def _(f):
    return _connected(f, "r09").status.read().drop("last_updated")


@check("r10_readiness_message", f"""SELECT 'system/connector/fleet_events/ready' AS topic, TIMESTAMP '{MARKER_AT}' AS ts, 'ready' AS status,
  CAST({BEFORE} AS VARCHAR) AS historical, 'true' AS flushed FROM base""")
def _(f):
    sent = _connected(f, "r10").announcements()
    fields = {"status": "status", "historical": "historical_events_processed", "flushed": "barrier_flush_complete"}
    return sent.select("topic", "ts", *[F.get_json_object("value", f"$.{p}").alias(n) for n, p in fields.items()])


@check("s11_status_upsert", """SELECT vehicle_id AS connector_name, true AS is_ready, count(*) AS total_events_consumed FROM alerts GROUP BY ALL""")
def _(f):
    """A first, unfinished status per vehicle, replaced by the finished one."""
    table = readiness.StatusTable(f.spark, f.work("s11"))
    for version, until in enumerate((moment(MARKER_AT), moment(AS_OF))):
        rows = f.events.where(F.col("occurred_at") <= until).groupBy(F.col("vehicle_id").alias("connector_name")).agg(
            F.count(F.lit(1)).alias("total_events_consumed")
        )
        table.upsert(rows.select(
            "connector_name", F.lit(bool(version)).alias("is_ready"), F.lit(None).alias("sentinel_detected_at"),
            F.lit(0).alias("events_before_sentinel"), "total_events_consumed", moment(AS_OF).alias("last_updated"),
        ), version)
    return table.read().select("connector_name", "is_ready", "total_events_consumed")


@check("q07_subscription_log", """, h AS (SELECT occurred_at, vehicle_id FROM alerts WHERE severity = 'high'
    AND occurred_at > TIMESTAMP '2024-01-01 12:00:00' - INTERVAL 4 HOUR)
  SELECT 'backfill_status' AS type, 1 AS n UNION ALL SELECT 'history_start', 1 UNION ALL SELECT 'history_done', 1
  UNION ALL SELECT 'history', count(*) FROM h HAVING count(*) > 0""")
def _(f):
    records = f.recent_client(4).subscription_log("fleet/events/*/alerts/high", "4h")
    return records.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@check("q13_watch_records", "SELECT topic, occurred_at AS event_time FROM alerts WHERE severity = 'low'")
def _(f):
    return _maintained(f, "q13", f.client.alert_watch(f.live["fleet_events_raw"], "low")).select("topic", "event_time")


@check("r17_view_lag", f"SELECT max(recorded_at) AS latest, (epoch_us({NOW}) - epoch_us(max(recorded_at))) // 1000000 AS lag_seconds FROM telemetry WHERE engine_temp > 220")
def _(f):
    table = _maintained(f, "r17", f.live["high_engine_temp_vehicles"])
    return rolling.freshness(table, "recorded_at", AS_OF).drop("lag")


# --- subscriptions fed in several batches ---

# Rows of a message file, where a part has more than one.
BATCH_FILE_ROWS = 100_000


def _in_batches(f, name, parts):
    """A message stream that brings each part of the table's messages in a batch of its own."""
    folder = f.work(name)
    # Every part has as many files, so that many files are one part, however large the table is.
    sizes = reduce(DataFrame.unionAll, [part.select(F.count(F.lit(1)).alias("n")) for part in parts])
    files = max(1, sizes.agg(F.min("n")).first()[0] // BATCH_FILE_ROWS)
    for i, part in enumerate(parts):
        part.drop("seq").repartition(files).write.parquet(f"{folder}/{i:03}")
    schema = f.table.messages().drop("seq").schema
    return f.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/*")


def _payload(records, *more):
    fields = ("vehicle_id", "event_type", "description")
    return records.select(
        *more, "topic", "event_time", *[F.get_json_object("event", f"$.payload.{n}").alias(n) for n in fields]
    )


SPAN = f"occurred_at > {NOW} - INTERVAL 4 HOUR"
RECORD_ROW = "topic, occurred_at AS event_time, vehicle_id, event_type, description"
#: Batches of the tests below: up to ten, everything again, and every sixth alert a third time.
REPEATED = f"""SELECT topic, occurred_at, vehicle_id, event_type, description FROM alerts
    WHERE severity = 'high' AND occurred_at <= TIMESTAMP '2024-01-01 10:00:00' AND {SPAN}
  UNION ALL SELECT topic, occurred_at, vehicle_id, event_type, description FROM alerts
    WHERE severity = 'high' AND seq % 6 = 2 AND {SPAN}"""


def _repeating(f, name):
    rows = f.table.messages()
    return _in_batches(f, name, [
        rows.where(F.col("ts") <= moment("2024-01-01 10:00:00")), rows, rows.where(F.col("seq") % 6 == 2),
    ])


@check("q06_subscribe_without_cut", f"""SELECT 'history' AS source, {RECORD_ROW} FROM alerts WHERE severity = 'high' AND {SPAN}
  UNION ALL SELECT 'live', {RECORD_ROW} FROM ({REPEATED})""")
def _(f):
    """Messages of the view come by again, some twice more: of each history key one stays away."""
    root = f.work("q06n")
    f.client.subscribe(
        "fleet/events/*/alerts/high", _repeating(f, "q06m"), f"{root}/t", f"{root}/c", since="4h", available_now=True
    ).awaitTermination()
    return _payload(replay.read_replay(f.spark, f"{root}/t"), "source")


@check("r06_late_rows_are_live", f"""SELECT CASE WHEN occurred_at <= {CUT_SQL} AND seq % 6 <> 2 THEN 'history' ELSE 'live' END AS source, {RECORD_ROW}
  FROM alerts WHERE severity = 'high' AND {SPAN}""")
def _(f):
    """A third of the alerts up to the cut arrive after history was read; they are live, none is lost."""
    root = f.work("r06l")
    known = ViewSet(*[messages.typed_source(f.table.messages().where(F.col("seq") % 6 != 2), s)
                      for s in ("telemetry", "events", "commands")], as_of=AS_OF)
    rows = f.table.messages()
    coming = _in_batches(f, "r06lm", [rows.where(F.col("seq") % 6 != 2), rows.where(F.col("seq") % 6 == 2)])
    FleetClient(f.spark, known).subscribe(
        "fleet/events/*/alerts/high", coming, f"{root}/t", f"{root}/c", CUT, "4h", available_now=True
    ).awaitTermination()
    return _payload(replay.read_replay(f.spark, f"{root}/t"), "source")


@check("x03_spent_keys", f"SELECT {RECORD_ROW} FROM ({REPEATED})")
def _(f):
    """The one-shot policy as a stream that stops and starts between batches."""
    root, coming = f.work("x03s"), _repeating(f, "x03m")
    for _run in range(2):
        f.client.subscribe(
            "fleet/events/*/alerts/high", coming, f"{root}/t", f"{root}/c", since="4h", limit=1, available_now=True
        ).awaitTermination()
    return _payload(replay.read_replay(f.spark, f"{root}/t").where("source = 'live'"))


@check("q07_web_records", f""", h AS (SELECT {RECORD_ROW} FROM alerts WHERE severity = 'high' AND {SPAN}),
  l AS (SELECT {RECORD_ROW} FROM ({REPEATED}))
  SELECT 'history' AS type, 3 AS step, * FROM h UNION ALL SELECT 'live', 6, * FROM l
  UNION ALL SELECT type, step, body, NULL, NULL, NULL, NULL FROM (VALUES ('backfill_status', 0, 'ready=true'),
    ('status', 5, 'Live messages follow')) v(type, step, body)
  UNION ALL SELECT type, step, 'count=' || n, NULL, NULL, NULL, NULL
    FROM (SELECT count(*) AS n FROM h), (VALUES ('history_start', 2), ('history_done', 4)) v(type, step)""")
def _(f):
    """Every record of a web subscriber's log; what has no topic shows its body there."""
    root = f.work("q07w")
    args = f"{root}/t", f"{root}/c"
    f.client.web_subscription(
        "fleet/events/*/alerts/high", _repeating(f, "q07m"), *args, since="4h", available_now=True
    ).awaitTermination()
    log = f.client.web_records(*args).withColumnRenamed("body", "event")
    topic = F.coalesce(F.get_json_object("event", "$.topic"), F.col("event")).alias("topic")
    return _payload(log.select("type", "step", "event_time", "event", topic), "type", "step")


# --- rows that come late ---

def _scattered(f, name):
    """Messages in five batches, each from all over the day: most rows are hours behind the newest."""
    rows = f.table.messages()
    return _in_batches(f, name, [rows.where(F.col("seq") % 5 == i) for i in (3, 0, 4, 1, 2)])


def _typed(coming, kind):
    return {"events": views.events_raw, "telemetry": views.telemetry_raw}[kind](messages.typed_source(coming, kind))


@check("r04_context_of_late_rows", f"SELECT {CONTEXT_ROW} FROM context")
def _(f):
    """The interval join over stored rows: no pair is lost or doubled by the order of arrival."""
    coming, context = _scattered(f, "r04m"), stored.StoredContext(f.spark, f.work("r04s"))
    context.start(_typed(coming, "events"), _typed(coming, "telemetry"), available_now=True).awaitTermination()
    return context.read()


@check("r20_once_with_late_copies", "SELECT vehicle_id, occurred_at, event_type FROM alerts")
def _(f):
    """Every alert comes twice within its batch and once more in a later one."""
    rows = f.table.messages()
    parts = [rows.where(F.col("seq") % 3 == i) for i in range(3)]
    coming = _in_batches(f, "r20m", [parts[0].unionAll(parts[0]), parts[1].unionAll(parts[0]), parts[2].unionAll(parts[1])])
    stream, root = _typed(coming, "events").select("vehicle_id", "occurred_at", "event_type"), f.work("r20l")
    stored.start_once_per_key(
        stream, ["vehicle_id", "occurred_at"], "occurred_at", f"{root}/t", f"{root}/c", available_now=True
    ).awaitTermination()
    return stored.once_rows(f.spark, f"{root}/t", stream)


# --- kept views and their changes ---

TICKS = ("2024-01-01 11:00:00", "2024-01-01 12:00:00", "2024-01-01 12:20:00", "2024-01-01 12:45:00", "2024-01-01 14:00:00")


@check("r03_rows_leave_by_time", f"""SELECT t AS as_of, severity, count(*) AS alert_count, count(DISTINCT vehicle_id) AS affected_vehicles
  FROM alerts, (VALUES {', '.join(f"(TIMESTAMP '{t}')" for t in TICKS)}) v(t) WHERE occurred_at > t - INTERVAL 1 HOUR GROUP BY ALL""")
def _(f):
    """The rolling summary after each tick; no alert arrives between ticks, and the last one empties it.

    A tick's "now" bounds the hour from below only, as the view does.
    """
    source, folder = _rolling_table(f, "r03t"), f.work("r03k")
    table, states = live.rolling_table(f.spark, f"{folder}/table"), []
    for i, at in enumerate(TICKS):
        f.spark.range(1).select(moment(at).alias("timestamp")).write.parquet(f"{folder}/ticks/{i}")
        ticks = f.spark.readStream.schema("timestamp timestamp").parquet(f"{folder}/ticks/*")
        live.start_rolling_view(ticks, source, table, f"{folder}/checkpoint", available_now=True).awaitTermination()
        state = f"{folder}/state/{i}"
        table.read().select(moment(at).alias("as_of"), "severity", "alert_count", "affected_vehicles").write.parquet(state)
        states.append(f.spark.read.parquet(state))
    return reduce(DataFrame.unionByName, states)


@check("r19_row_versions", """, b AS (SELECT vehicle_id, time_bucket(INTERVAL 5 MINUTE, recorded_at, TIMESTAMP '1970-01-01') AS window_start,
    seq % 3 AS batch, count(*) AS n FROM telemetry GROUP BY ALL),
  v AS (SELECT vehicle_id, window_start, batch, sum(n) OVER w AS after, sum(n) OVER w - n AS before FROM b
    WINDOW w AS (PARTITION BY vehicle_id, window_start ORDER BY batch))
  SELECT vehicle_id, window_start, row_number() OVER w AS version, CASE WHEN before = 0 THEN 'insert' ELSE 'update' END AS kind,
    CAST(nullif(before, 0) AS BIGINT) AS before, CAST(after AS BIGINT) AS after FROM v
    WINDOW w AS (PARTITION BY vehicle_id, window_start ORDER BY batch)""")
def _(f):
    """A consumer of a tumbling view's changes: every version of every window once, although it stops between."""
    rows = f.table.messages()
    root, batches = f.work("r19v"), f.work("r19m")
    running = LiveViews(f.spark, root)
    for i in range(3):
        rows.where(F.col("seq") % 3 == i).drop("seq").write.parquet(f"{batches}/{i}")
        schema = rows.drop("seq").schema
        coming = f.spark.readStream.schema(schema).parquet(f"{batches}/*")
        view = live.live_speed_avg(_typed(coming, "telemetry"), delay="2 days")
        running.start("speeds", view, ["vehicle_id", "window_start"], True, "window_start", compact_every=1, feed=True
                      ).awaitTermination()
        sinks.append_stream(
            running.changes("speeds"), f"{root}/consumed", f"{root}/position", available_now=True
        ).awaitTermination()
    versions = Window.partitionBy("vehicle_id", "window_start").orderBy(sinks.BATCH)
    return f.spark.read.parquet(f"{root}/consumed").select(
        "vehicle_id", "window_start", "kind", F.col("before.sample_count").alias("before"),
        F.col("after.sample_count").alias("after"), F.row_number().over(versions).alias("version"),
    )


@check("a12_stream_drain", """, d AS (SELECT seq % 4 AS part, count(*) AS n FROM base GROUP BY ALL),
  s AS (SELECT 0 AS nth, (SELECT count(*) FROM base) AS depth UNION ALL
    SELECT part + 1, (SELECT count(*) FROM base) - sum(n) OVER (ORDER BY part) FROM d)
  SELECT nth, CAST(depth AS BIGINT) AS depth, CAST(t.n - depth AS BIGINT) AS consumed,
    round(CAST(t.n - depth AS DOUBLE) / t.n * 100, 6) AS percent, nth > 0 AS has_rate
  FROM s, (SELECT count(*) AS n FROM base) t""")
def _(f):
    """The backlog of a stream that reads a file a batch, from what the query reports of its batches."""
    rows, root = f.table.messages(), f.work("a12")
    coming = _in_batches(f, "a12m", [rows.where(F.col("seq") % 4 == i) for i in range(4)])
    query = sinks.append_stream(coming.select("topic", "ts"), f"{root}/t", f"{root}/c", available_now=True)
    query.awaitTermination()
    samples = drained(f.spark, query.recentProgress, rows.count())
    order = Window.orderBy("sample_time")  # a row for each batch
    return six(samples.select(
        (F.row_number().over(order) - 1).alias("nth"), "depth", "consumed", "percent", (F.col("rate") > 0).alias("has_rate")
    ), "percent")


@check("r13_waiters", f"""SELECT who, {BEFORE} AS historical_events, count(*) AS total_events FROM base, (VALUES ('early'), ('late')) v(who) GROUP BY who
  UNION ALL SELECT 'another connector', NULL, NULL""")
def _(f):
    """One waits before the connector starts, one comes when all is over, one waits for somebody else."""
    connector = readiness.Connector(f.spark, "fleet_events", f.work("r13"), {}, order="ts")
    ready = connector.announcement_stream()

    def client(name="fleet_events"):
        return FleetClient(f.spark, f.views, status=connector.status.read, connector=name)

    with ThreadPoolExecutor(1) as pool:
        early = pool.submit(client().wait_for_ready, 300.0, announcements=ready)
        connector.start(_with_marker(f), available_now=True).awaitTermination()
        found = [("early", early.result()), ("late", client().wait_for_ready(300.0, announcements=ready))]
    try:
        client("other").wait_for_ready(3.0, announcements=ready)
    except TimeoutError:
        found.append(("another connector", {"historical_events": None, "total_events": None}))
    return f.spark.createDataFrame(
        [(who, m["historical_events"], m["total_events"]) for who, m in found],
        "who string, historical_events long, total_events long",
    )


@check("r12_r14_late_joiners", f"""SELECT 'fleet_events' AS connector, true AS is_ready, TIMESTAMP '{MARKER_AT}' AS sentinel_detected_at,
    {BEFORE} AS historical_events, true AS all_ready, true AS table_exists FROM base
  UNION ALL SELECT 'other', false, NULL, NULL, false, true""")
def _(f):
    """What clients learn from the status table after the run: their own connector's readiness, and the report."""
    connector, found = _connected(f, "r12"), []
    for name in ("fleet_events", "other"):
        client = FleetClient(f.spark, f.views, status=connector.status.read, connector=name)
        known, report = client.readiness_metadata or {}, client.backfill_status(name)
        found.append((name, client.is_ready, known.get("sentinel_detected_at"), known.get("historical_events"),
                      report["ready"], report["table_exists"]))
    return f.spark.createDataFrame(
        found, "connector string, is_ready boolean, sentinel_detected_at timestamp, historical_events long,"
        " all_ready boolean, table_exists boolean",
    )


@check("q51_newest_speeds_by_zones", "SELECT * FROM (SELECT vehicle_id, speed AS speed_mph, latitude, longitude, recorded_at FROM telemetry ORDER BY recorded_at DESC, vehicle_id, speed, latitude, longitude LIMIT 20)")
def _(f):
    """The view is saved with its zone map; only the newest of it is read again."""
    saved = ViewSet.over(f.table, AS_OF)
    saved.save("vehicle_speeds", f.work("q51z"), "recorded_at")
    return presets.newest_speeds(saved)


@check("q29_high_engine_temp_by_zones", """SELECT vehicle_id, engine_temp AS engine_temp_f, recorded_at FROM telemetry
  WHERE engine_temp > 220 AND vehicle_id = 'vehicle_008' ORDER BY recorded_at DESC LIMIT 30""")
def _(f):
    """With a condition, the stretch that is read grows until it holds thirty rows that pass."""
    saved = ViewSet.over(f.table, AS_OF)
    zoned = saved.save("high_engine_temp_vehicles", f.work("q29z"), "recorded_at")
    return zoned.newest(30, F.col("vehicle_id") == "vehicle_008").select("vehicle_id", "engine_temp_f", "recorded_at")


# What a new driver has to bring along: how views are made from those they read.
MAKERS = {
    "by_vehicle": lambda spark, rows: rows.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("n")),
    "changes_of": lambda spark, changes: changes.select("vehicle_id", "kind", F.col("after.n").alias("n")),
    "of_severity": lambda spark, rows, severity: rows.where(F.col("severity") == severity),
}


def _half_messages(f, name):
    """A folder of messages and a function that writes one half of them into it."""
    path, rows = f.work(name), f.table.messages()
    arrive = lambda half: rows.where(F.col("seq") % 2 == half).drop("seq").write.mode("append").option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return path, arrive


def _alerts(catalog, path):
    options = {"path": path, "view": "fleet_events_raw"}
    catalog.create("alerts", "named_view", options=options, available_now=True)
    catalog.create("counts", "by_vehicle", ["alerts"], ["vehicle_id"], feed=True, available_now=True)
    catalog.create("changes", "changes_of", ["counts"], available_now=True)


@check("d09_restored_views", """, n AS (SELECT vehicle_id, count(*) FILTER (seq % 2 = 0) AS before, count(*) AS after FROM alerts GROUP BY ALL)
  SELECT vehicle_id, before, after, (before > 0)::BIGINT + (after > before)::BIGINT AS changes FROM n""")
def _(f):
    """Views on views, before and after another driver has taken over from the catalog alone."""
    path, arrive = _half_messages(f, "d09m")
    arrive(0)
    first = LiveCatalog(f.spark, f.work("d09"), MAKERS)
    _alerts(first, path)
    before = f.work("d09b")
    first.read("counts").write.parquet(before)
    arrive(1)
    second = LiveCatalog(f.spark, first.root, MAKERS)
    if second.ensure(available_now=True) != ["alerts", "counts", "changes"]:
        raise AssertionError("restored in another order")
    changes = second.read("changes").groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("changes"))
    was = f.spark.read.parquet(before).select("vehicle_id", F.col("n").alias("before"))
    both = second.read("counts").withColumnRenamed("n", "after").join(was, "vehicle_id", "left")
    return both.join(changes, "vehicle_id", "left").select(
        "vehicle_id", F.coalesce("before", F.lit(0)).alias("before"), "after", "changes"
    )


@check("d02_d08_incident_views", """SELECT 'alerts' AS name, TRUE AS wanted, (SELECT count(*) FROM alerts) AS rows
  UNION ALL SELECT 'counts', FALSE, NULL UNION ALL SELECT 'changes', FALSE, NULL
  UNION ALL SELECT 'incident', TRUE, (SELECT count(*) FROM alerts WHERE severity = 'high')""")
def _(f):
    """A view for an incident beside others; all are dropped, dependents first, and two created anew."""
    path, arrive = _half_messages(f, "d08m")
    arrive(0)
    catalog = LiveCatalog(f.spark, f.work("d08"), MAKERS)
    _alerts(catalog, path)
    catalog.create("incident", "of_severity", ["alerts"], options={"severity": "high"}, available_now=True)
    if catalog.drop("alerts", cascade=True) != ["incident", "changes", "counts", "alerts"]:
        raise AssertionError("dropped in another order")
    arrive(1)
    catalog.create("alerts", "named_view", options={"path": path, "view": "fleet_events_raw"}, available_now=True)
    catalog.create("incident", "of_severity", ["alerts"], options={"severity": "high"}, available_now=True)
    rows = reduce(DataFrame.unionAll, [
        catalog.read(name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        for name in ("alerts", "incident")
    ])
    return catalog.status().select("name", "wanted").join(rows, "name", "left")
