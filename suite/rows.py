"""Sources, projections, filters and row functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetviews.functions import topics, values
from fleetviews.functions.values import JSON_TIMES
from fleetviews.functions.timing import (
    duration_column, epoch_millis_to_iso, interval, micros_between, moment, newer_than,
)
from fleetviews.operators import joins, rolling, sets, views
from fleetviews.operators.views import all_of, equals
from fleetviews.schemas import SENSORS, TELEMETRY_BODY, valid_event, valid_telemetry
from fleetviews.sources import messages, sinks
from fleetviews.sources.events_table import AS_OF
from fleetviews.streaming.replay import rendered
from .base import HOUR, NOW, check, rounded_sql

SENSOR_LIST = ", ".join(SENSORS)

# --- sources ---


@check("s01_telemetry_source", f"""SELECT vehicle_id, {SENSOR_LIST}, latitude, longitude, topic,
  recorded_at AS ts FROM telemetry""")
def _(f):
    return messages.typed_source(f.table.messages(), "telemetry").drop("headers", "seq")


@check("s02_events_source", """SELECT vehicle_id, event_type, severity, description, payload, topic,
  occurred_at AS ts FROM alerts""")
def _(f):
    return messages.typed_source(f.table.messages(), "events").drop("headers", "seq")


@check("s03_commands_source", """SELECT vehicle_id, command_type, parameters, issued_by, topic,
  issued_at AS ts FROM commands""")
def _(f):
    return messages.typed_source(f.table.messages(), "commands").drop("headers", "seq")


@check("s04_envelope_metadata", """SELECT topic, recorded_at AS ts, seq FROM telemetry
  UNION ALL SELECT topic, occurred_at, seq FROM alerts UNION ALL SELECT topic, issued_at, seq FROM commands""")
def _(f):
    return f.table.messages().select("topic", "ts", "seq")


@check("s05_json_decode", """SELECT seq, vehicle_id,
  CAST(json_extract(payload, '$.current_value') AS DOUBLE) AS current_value,
  json_extract_string(payload, '$.metric') AS metric FROM alerts""")
def _(f):
    rows = messages.typed_source(f.table.messages(), "events")
    body = F.from_json("payload", "current_value double, metric string")
    return rows.select("seq", "vehicle_id", body["current_value"].alias("current_value"), body["metric"].alias("metric"))


@check("s06_topic_split", """SELECT 'telemetry' AS stream, topic, seq FROM telemetry
  UNION ALL SELECT 'events', topic, seq FROM alerts UNION ALL SELECT 'commands', topic, seq FROM commands""")
def _(f):
    return f.table.messages().select(messages.stream_name().alias("stream"), "topic", "seq")


@check("s06_routed_events", "SELECT topic, seq FROM alerts")
def _(f):
    return messages.routed(f.table.messages().select("topic", "seq"), "fleet/events/>")


def damaged(frame):
    """Telemetry messages of which some are cut short, mistyped in a field, or empty."""
    turn = F.col("seq") % 50
    value = (
        F.when(turn == 7, F.expr("left(value, length(value) - 3)"))
        .when(turn == 9, F.regexp_replace("value", '"speed":[0-9.]+', '"speed":"fast"'))
        .when(turn != 11, F.col("value"))
    )
    return messages.routed(frame, "fleet/telemetry/>").withColumn("value", value)


@check("s07_dead_letters", "SELECT topic, recorded_at AS ts, count(*) AS n FROM telemetry WHERE seq % 50 IN (7, 11) GROUP BY ALL")
def _(f):
    _, dead = messages.split_dead_letters(messages.decoded(damaged(f.table.messages()), TELEMETRY_BODY))
    return dead.groupBy("topic", "ts").agg(F.count("value").alias("n"))


@check("s07_good_rows", f"""SELECT vehicle_id, {SENSOR_LIST.replace("speed", "CASE WHEN seq % 50 <> 9 THEN speed END AS speed", 1)},
  latitude, longitude, topic, recorded_at AS ts FROM telemetry WHERE seq % 50 NOT IN (7, 11)""")
def _(f):
    """A mistyped field is NULL; the rest of its row stays."""
    good, _ = messages.split_dead_letters(messages.decoded(damaged(f.table.messages()), TELEMETRY_BODY))
    return good.drop("headers", "seq")


@check("s07_unreadable_lines", """SELECT 'good' AS part, topic, recorded_at AS ts, vehicle_id AS body FROM telemetry WHERE seq % 50 NOT IN (3, 5, 7, 11)
  UNION ALL SELECT 'dead', NULL, NULL, 'line ' || seq FROM telemetry WHERE seq % 50 = 3
  UNION ALL SELECT 'dead', NULL, NULL, '{"topic":"' || topic || '","ts":"soon"}' FROM telemetry WHERE seq % 50 = 5
  UNION ALL SELECT 'dead', topic, recorded_at, NULL FROM telemetry WHERE seq % 50 IN (7, 11)""")
def _(f):
    """Message files of which some lines are no JSON or have a time that is none: no line is lost."""
    folder, turn = f.work("s07_lines"), F.col("seq") % 50
    frame = damaged(f.table.messages())
    line = F.to_json(F.struct("topic", "ts", "headers", "value"), JSON_TIMES)
    soon = F.concat(F.lit('{"topic":"'), "topic", F.lit('","ts":"soon"}'))
    line = F.when(turn == 3, F.concat(F.lit("line "), "seq")).when(turn == 5, soon).otherwise(line)
    frame.select(line.alias("line")).write.text(folder)
    read = messages.read_messages(f.spark, folder)
    good = messages.typed_source(read, "telemetry").select(F.lit("good").alias("part"), "topic", "ts", F.col("vehicle_id").alias("body"))
    body = F.when(F.col("topic").isNull(), F.col("value")).alias("body")
    return good.unionByName(messages.dead_letters(read).select(F.lit("dead").alias("part"), "topic", "ts", body))


@check("s08_expired_messages", """SELECT 'fresh' AS part, topic, seq FROM alerts WHERE seq % 400 <= 300
  UNION ALL SELECT 'expired', topic, seq FROM alerts WHERE seq % 400 > 300""")
def _(f):
    waited = F.make_dt_interval(secs=(F.col("seq") % 400).cast("decimal(18,6)"))
    rows = f.table.events().withColumn("ingest_ts", F.col("ts") + waited)
    parts = messages.split_expired(rows, "ingest_ts")
    fresh, expired = (
        p.select(F.lit(name).alias("part"), "topic", "seq") for p, name in zip(parts, ("fresh", "expired"))
    )
    return fresh.unionByName(expired)


@check("s10_unified_source", """SELECT vehicle_id, NULL::VARCHAR AS event_type, metric_type, NULL::VARCHAR AS severity,
  value, unit, latitude, longitude, NULL::VARCHAR AS description, NULL::VARCHAR AS payload, topic, ts FROM metrics
  UNION ALL SELECT vehicle_id, event_type, NULL, severity, NULL, NULL, NULL, NULL, description, payload, topic, occurred_at FROM alerts
  UNION ALL SELECT vehicle_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, topic, issued_at FROM commands""")
def _(f):
    return f.unified


@check("s12_persisted_view", """SELECT vehicle_id, window_start, window_end, round(avg_speed_mph, 6) AS avg_speed_mph,
  max_speed_mph, min_speed_mph, sample_count, CAST(window_start AS DATE) AS event_date FROM windows""")
def _(f):
    from fleetviews.plans.lifecycle import persist_view

    view = persist_view(f.spark, f.views["vehicle_speed_5min_avg"], "speed", f.work("s12"), "window_start")
    return view.withColumn("avg_speed_mph", F.round("avg_speed_mph", 6)).withColumn("event_date", F.to_date("event_date"))


@check("s13_published_messages", """SELECT topic, recorded_at AS ts, 'fleet_telemetry' AS tree FROM telemetry
  UNION ALL SELECT topic, occurred_at, 'fleet_events' FROM alerts
  UNION ALL SELECT topic, issued_at, 'fleet_commands' FROM commands""")
def _(f):
    path = f.work("s13")
    sinks.publish(f.table.messages().drop("seq"), path)
    return f.spark.read.schema("topic string, ts timestamp, value string, tree string").json(path).drop("value")


@check("s14_command_messages", """SELECT topic, issued_at AS ts, vehicle_id, command_type, issued_by, parameters FROM commands""")
def _(f):
    sent = sinks.command_messages(f.commands)
    fields = {n: F.get_json_object("value", f"$.{n}").alias(n) for n in ("vehicle_id", "command_type", "issued_by", "parameters")}
    return sent.select("topic", "ts", *fields.values())


@check("s15_json_lines", "SELECT vehicle_id, severity, event_type, description, occurred_at, topic FROM alerts")
def _(f):
    path = f.work("s15j")
    sinks.write_json_lines(f.events.drop("payload"), path)
    return f.spark.read.schema(f.events.drop("payload").schema).json(path)


@check("s15_csv", "SELECT vehicle_id, event_type, severity, description, payload, occurred_at, topic FROM alerts")
def _(f):
    path = f.work("s15c")
    sinks.write_csv(f.events, path)
    return f.spark.read.schema(f.events.schema).option("header", True).csv(path)


ISO = "strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"


@check("s16_event_lines", f"""SELECT '[history] ' || {ISO} || '  ' || topic || '  vehicle=' || vehicle_id
  || '  event_type=' || event_type || '  severity=' || severity || '  description=' || description
  || '  payload=' || payload || '  occurred_at=' || {ISO} AS event FROM alerts""")
def _(f):
    return rendered(f.events, "history", "fleet/events/*/alerts/*", "occurred_at", "line").select("event")


@check("s16_event_json", f"""SELECT 'live' AS source, topic, {ISO} AS event_time, vehicle_id, description FROM alerts""")
def _(f):
    text = rendered(f.events, "live", "fleet/events/*/alerts/*", "occurred_at").select("event")
    paths = {"source": "source", "topic": "topic", "event_time": "event_time",
             "vehicle_id": "payload.vehicle_id", "description": "payload.description"}
    return text.select(*[F.get_json_object("event", f"$.{p}").alias(n) for n, p in paths.items()])


@check("s20_topic_fields", """SELECT split_part(topic, '/', 2) AS stream, split_part(topic, '/', 3) AS vehicle,
  nullif(split_part(topic, '/', 5), '') AS detail, seq FROM
  (SELECT topic, seq FROM telemetry UNION ALL SELECT topic, seq FROM alerts UNION ALL SELECT topic, seq FROM commands)""")
def _(f):
    return messages.topic_fields(
        f.table.messages().select("topic", "seq"), [None, "stream", "vehicle", None, "detail"]
    ).drop("topic")


@check("v01_valid_rows", """SELECT 'telemetry' AS stream, count(*) AS valid FROM telemetry
  UNION ALL SELECT 'events', count(*) FROM alerts""")
def _(f):
    counted = [
        df.where(ok).agg(F.count(F.lit(1)).alias("valid")).select(F.lit(n).alias("stream"), "valid")
        for n, df, ok in (("telemetry", f.telemetry, valid_telemetry()), ("events", f.events, valid_event()))
    ]
    return counted[0].unionByName(counted[1])


# --- projections and filters ---

TELEMETRY_ROW = f"vehicle_id, {SENSOR_LIST}, latitude, longitude, recorded_at, topic"
EVENT_ROW = "vehicle_id, event_type, severity, description, payload, occurred_at, topic"
POSITION_ROW = "vehicle_id, latitude, longitude, speed AS speed_mph, recorded_at"
BOSTON = "latitude BETWEEN 42.2 AND 42.5 AND longitude BETWEEN -71.2 AND -70.9"

_VIEW_ORACLES = {
    "p01_fleet_telemetry_raw": f"SELECT {TELEMETRY_ROW} FROM telemetry",
    "p02_fleet_events_raw": f"SELECT {EVENT_ROW} FROM alerts",
    "p03_fleet_commands_raw": "SELECT vehicle_id, command_type, parameters, issued_at, issued_by, topic FROM commands",
    "p04_vehicle_alert": f"SELECT {EVENT_ROW} FROM alerts WHERE topic LIKE 'fleet/events/%/alerts/%'",
    "p05_vehicle_command": "SELECT vehicle_id, command_type, parameters, issued_at FROM commands WHERE topic LIKE 'fleet/commands/%/%'",
    "p06_vehicle_telemetry": f"SELECT {TELEMETRY_ROW} FROM telemetry WHERE topic LIKE 'fleet/telemetry/%/metrics'",
    "p07_high_severity_alerts": "SELECT vehicle_id, event_type, description, payload, occurred_at, topic FROM alerts WHERE severity = 'high'",
    "p08_medium_severity_alerts": "SELECT vehicle_id, event_type, description, payload, occurred_at FROM alerts WHERE severity = 'medium'",
    "p09_low_severity_alerts": "SELECT vehicle_id, event_type, description, payload, occurred_at FROM alerts WHERE severity = 'low'",
    "p10_vehicle_speeds": "SELECT vehicle_id, speed AS speed_mph, latitude, longitude, recorded_at, topic FROM telemetry",
    "p11_vehicle_fuel_levels": "SELECT vehicle_id, fuel_level AS fuel_pct, recorded_at FROM telemetry",
    "p12_high_engine_temp_vehicles": "SELECT vehicle_id, engine_temp AS engine_temp_f, recorded_at FROM telemetry WHERE engine_temp > 220",
    "p13_vehicles_in_region_boston": f"SELECT {POSITION_ROW} FROM telemetry WHERE {BOSTON}",
    "p14_vehicle_last_known_position": f"SELECT {POSITION_ROW} FROM telemetry",
}
for _name, _sql in _VIEW_ORACLES.items():
    check(_name, _sql)(lambda f, view=_name[4:]: f.views[view])


@check("p13_region_tags", f"SELECT vehicle_id, recorded_at, CASE WHEN {BOSTON} THEN 'boston' ELSE '' END AS regions FROM telemetry")
def _(f):
    return f.telemetry.select("vehicle_id", "recorded_at", F.array_join(views.region_of(), ",").alias("regions"))


# Boxes that overlap, that share an edge with a cell, and that no reading is in.
REGION_ROWS = (("boston", 42.2, 42.5, -71.2, -70.9), ("west", 42.0, 42.3, -71.5, -71.0), ("far", 10.0, 12.0, 20.0, 21.0),
               ("square", 42.5, 42.75, -71.0, -70.75))


@check("p13_region_table", f"""SELECT vehicle_id, recorded_at, latitude, longitude, region FROM telemetry
  JOIN (VALUES {", ".join(map(str, REGION_ROWS))}) r(region, min_lat, max_lat, min_lon, max_lon)
    ON latitude BETWEEN min_lat AND max_lat AND longitude BETWEEN min_lon AND max_lon""")
def _(f):
    regions = f.spark.createDataFrame(
        REGION_ROWS, "region string, min_lat double, max_lat double, min_lon double, max_lon double"
    )
    found = joins.in_regions(f.telemetry, regions, cell=0.25)
    return found.select("vehicle_id", "recorded_at", "latitude", "longitude", "region")


# A region around every third reading, from a hundred metres to some degrees wide.
SIZED_REGIONS = ("concat('r', seq) AS region", "latitude - size AS min_lat", "latitude + size AS max_lat",
                 "longitude - size AS min_lon", "longitude + size AS max_lon")


@check("p13_regions_of_all_sizes", """, sized AS (
    SELECT *, CASE seq % 15 WHEN 0 THEN 0.0005 WHEN 3 THEN 0.002 WHEN 6 THEN 0.004 WHEN 9 THEN 0.015 ELSE 0.03 END::DOUBLE AS size
    FROM telemetry WHERE seq % 3 = 0),
  regions AS (SELECT latitude - size AS min_lat, latitude + size AS max_lat, longitude - size AS min_lon,
    longitude + size AS max_lon FROM sized)
  SELECT vehicle_id, recorded_at, seq, count(*) AS regions FROM telemetry JOIN regions
    ON latitude BETWEEN min_lat AND max_lat AND longitude BETWEEN min_lon AND max_lon GROUP BY ALL""")
def _(f):
    """How many regions of a large table each reading is in."""
    readings = f.table.telemetry()
    size = F.expr("CASE seq % 15 WHEN 0 THEN 0.0005D WHEN 3 THEN 0.002D WHEN 6 THEN 0.004D WHEN 9 THEN 0.015D ELSE 0.03D END")
    regions = readings.where("seq % 3 = 0").withColumn("size", size).selectExpr(*SIZED_REGIONS)
    positions = readings.selectExpr("vehicle_id", "ts AS recorded_at", "seq", "latitude", "longitude")
    found = joins.in_regions(positions, regions, counted="regions")
    return found.groupBy("vehicle_id", "recorded_at", "seq").agg(F.sum("regions").alias("regions"))


@check("p15_vehicle_high_alerts", f"SELECT {EVENT_ROW} FROM alerts WHERE vehicle_id = 'vehicle_003' AND severity = 'high'")
def _(f):
    return views.vehicle_high_alerts(f.events, "vehicle_003")


@check("p16_topic_like", f"SELECT {EVENT_ROW} FROM alerts WHERE topic LIKE 'fleet/events/%/high'")
def _(f):
    return f.events.where(topics.topic_like(F.col("topic"), "fleet/events/>/high"))


@check("p17_fuel_alerts", "SELECT vehicle_id, value AS fuel_level, ts AS event_timestamp FROM metrics WHERE metric_type = 'fuel_level' AND value < 10.0")
def _(f):
    return views.unified_fuel_alerts(f.unified)


@check("p18_metric_filter", "SELECT vehicle_id, value AS speed_mph, ts AS event_timestamp FROM metrics WHERE metric_type = 'speed'")
def _(f):
    return views.unified_metric(f.unified, "speed", "speed_mph")


@check("p19_presence_filter", """SELECT 'alert' AS part, vehicle_id, occurred_at AS ts FROM alerts
  UNION ALL SELECT 'metric', vehicle_id, ts FROM metrics""")
def _(f):
    alerts = f.unified.where(views.carries_alert()).select(F.lit("alert").alias("part"), "vehicle_id", "ts")
    metrics = f.unified.where(views.carries_metric()).select(F.lit("metric").alias("part"), "vehicle_id", "ts")
    return alerts.unionByName(metrics)


@check("p20_unified_in_boston", f"SELECT vehicle_id, latitude, longitude, value AS speed, ts AS event_timestamp FROM metrics WHERE metric_type = 'speed' AND {BOSTON}")
def _(f):
    return views.unified_in_region(f.unified)


@check("p21_unified_high_alerts", "SELECT vehicle_id, event_type, severity, description, payload, occurred_at AS event_timestamp FROM alerts WHERE severity = 'high'")
def _(f):
    return views.unified_alerts(f.unified)


@check("p22_since_filter", f"SELECT {EVENT_ROW} FROM alerts WHERE occurred_at > {NOW} - INTERVAL 1 HOUR")
def _(f):
    return f.recent_views(HOUR)["fleet_events_raw"].where(newer_than("occurred_at", "1h", AS_OF))


@check("p23_vehicle_filter", f"SELECT {TELEMETRY_ROW} FROM telemetry WHERE vehicle_id = 'vehicle_005'")
def _(f):
    return f.client.vehicle_rows("fleet_telemetry_raw", "vehicle_005")


@check("p24_severity_filter", f"SELECT {EVENT_ROW} FROM alerts WHERE severity = 'medium'")
def _(f):
    return f.events.where(equals("severity", "medium"))


@check("p25_filter_conjunction", f"""SELECT {EVENT_ROW} FROM alerts
  WHERE occurred_at > {NOW} - INTERVAL 4 HOUR AND vehicle_id = 'vehicle_007'""")
def _(f):
    return f.events.where(all_of(
        newer_than("occurred_at", "4h", AS_OF), equals("vehicle_id", "vehicle_007"), equals("severity", ""), None,
    ))


@check("p27_view_by_name", "SELECT vehicle_id, fuel_level AS fuel_pct, recorded_at FROM telemetry")
def _(f):
    f.views.register(f.spark, ["vehicle_fuel_levels"])
    return f.spark.table("vehicle_fuel_levels")


@check("p28_outside_region", f"SELECT {POSITION_ROW} FROM telemetry WHERE NOT ({BOSTON})")
def _(f):
    return views.outside_region(f.telemetry)


@check("p28_over_alert_budget", "SELECT vehicle_id, severity, event_count FROM activity WHERE event_count > 5")
def _(f):
    return views.over_alert_budget(f.recent_views(HOUR)["vehicle_event_counts_1h"], 5)


# --- row functions ---

@check("f01_rounding", f"""SELECT seq, {rounded_sql('speed * 1.2345', 1)} AS r1, {rounded_sql('fuel_level / 7', 2)} AS r2,
  {rounded_sql('latitude / 3', 4)} AS r4, {rounded_sql('longitude / 3', 5)} AS r5 FROM telemetry""")
def _(f):
    c = F.col
    return f.table.telemetry().select(
        "seq", values.rounded(c("speed") * 1.2345, 1).alias("r1"), values.rounded(c("fuel_level") / 7, 2).alias("r2"),
        values.rounded(c("latitude") / 3, 4).alias("r4"), values.rounded(c("longitude") / 3, 5).alias("r5"),
    )


@check("f02_case_rank", "SELECT seq, CAST(CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS BIGINT) AS severity_rank FROM alerts")
def _(f):
    return f.table.events().select("seq", values.severity_rank(F.col("severity")).alias("severity_rank"))


@check("f04_f06_time_arithmetic", f"""SELECT seq, recorded_at - INTERVAL 2 MINUTE AS two_minutes_before,
  epoch_us({NOW}) - epoch_us(recorded_at) AS age, recorded_at > {NOW} - INTERVAL 90 MINUTE AS is_recent FROM telemetry""")
def _(f):
    from fleetviews.functions.timing import parse_duration

    t = F.col("ts")
    return f.table.telemetry().select(
        "seq", (t - interval(parse_duration("2min"))).alias("two_minutes_before"),
        (moment(AS_OF) - t).alias("age"), (t > moment(AS_OF) - interval(parse_duration("90min"))).alias("is_recent"),
    )


@check("f07_f09_predicates", """SELECT seq, speed BETWEEN 20 AND 60 AS cruising, topic LIKE '%/vehicle_00_/%' AS low_number,
  vehicle_id IN ('vehicle_001', 'vehicle_010') AS ends, fuel_level IS NOT NULL AS has_fuel FROM telemetry""")
def _(f):
    c = F.col
    return f.table.telemetry().select(
        "seq", c("speed").between(20, 60).alias("cruising"), c("topic").like("%/vehicle_00_/%").alias("low_number"),
        c("vehicle_id").isin("vehicle_001", "vehicle_010").alias("ends"), c("fuel_level").isNotNull().alias("has_fuel"),
    )


@check("f10_aggregates", """SELECT vehicle_id, count(*) AS n, count(DISTINCT speed) AS speeds, round(avg(speed), 6) AS mean,
  max(speed) AS top, min(speed) AS low FROM telemetry GROUP BY vehicle_id""")
def _(f):
    return f.telemetry.groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("speed").alias("speeds"), F.round(F.avg("speed"), 6).alias("mean"),
        F.max("speed").alias("top"), F.min("speed").alias("low"),
    )


@check("f11_duration_column", """, d AS (SELECT seq, ' ' || CAST(seq % 90 AS VARCHAR) ||
    CASE seq % 7 WHEN 0 THEN 'd' WHEN 1 THEN 'H' WHEN 2 THEN 'hr' WHEN 3 THEN 'min' WHEN 4 THEN 'm' WHEN 5 THEN 's' ELSE 'w' END AS txt
  FROM telemetry)
  SELECT seq, CASE WHEN seq % 7 = 6 THEN NULL ELSE CAST(regexp_extract(trim(txt), '^([0-9]+)', 1) AS BIGINT) *
    CASE seq % 7 WHEN 0 THEN 86400 WHEN 1 THEN 3600 WHEN 2 THEN 3600 WHEN 3 THEN 60 WHEN 4 THEN 60 ELSE 1 END * 1000000 END AS span
  FROM d""")
def _(f):
    units = F.element_at(F.array(*[F.lit(u) for u in ("d", "H", "hr", "min", "m", "s", "w")]), (F.col("seq") % 7 + 1).cast("int"))
    text = F.concat(F.lit(" "), (F.col("seq") % 90).cast("string"), units)
    return f.table.telemetry().select("seq", duration_column(text).alias("span"))


@check("f15_topic_patterns", """SELECT seq, topic,
  regexp_matches(topic, '^fleet/events/.+$') AS all_events,
  regexp_matches(topic, '^fleet/[^/]+/vehicle_003/.+$') AS one_vehicle,
  regexp_matches(topic, '^fleet/events/[^/]+/alerts/high$') AS high,
  regexp_matches(topic, '^fleet/commands/[^/]+$') AS one_level,
  topic = 'fleet/events/vehicle_003/alerts/high' AS exact
  FROM (SELECT seq, topic FROM telemetry UNION ALL SELECT seq, topic FROM alerts UNION ALL SELECT seq, topic FROM commands)""")
def _(f):
    patterns = {
        "all_events": "fleet/events/>", "one_vehicle": "fleet/*/vehicle_003/>", "high": "fleet/events/*/alerts/high",
        "one_level": "fleet/commands/*", "exact": "fleet/events/vehicle_003/alerts/high",
    }
    return f.table.messages().select(
        "seq", "topic", *[topics.topic_matches(F.col("topic"), p).alias(n) for n, p in patterns.items()]
    )


@check("f20_payload_time", """SELECT vehicle_id, occurred_at AS event_time FROM alerts
  UNION ALL SELECT vehicle_id, issued_at FROM commands UNION ALL SELECT vehicle_id, recorded_at FROM telemetry""")
def _(f):
    rows = f.telemetry.select("vehicle_id", "recorded_at").unionByName(
        f.events.select("vehicle_id", "occurred_at"), allowMissingColumns=True
    ).unionByName(f.commands.select("vehicle_id", "issued_at"), allowMissingColumns=True)
    return rows.select("vehicle_id", values.payload_time(rows.columns).alias("event_time"))


@check("f21_rebuilt_topic", "SELECT seq, topic FROM alerts UNION ALL SELECT seq, topic FROM commands")
def _(f):
    alerts = f.table.events().drop("topic")
    commands = f.table.commands().drop("topic")
    return alerts.select("seq", topics.rebuilt_topic("fleet/events/*/alerts/*", alerts.columns).alias("topic")).unionByName(
        commands.select("seq", topics.rebuilt_topic("fleet/commands/*/*", commands.columns).alias("topic"))
    )


@check("f22_decoded_or_raw", """SELECT seq, CASE WHEN seq % 4 = 1 THEN vehicle_id END AS raw,
  CASE WHEN seq % 4 <> 1 THEN CAST(json_extract(payload, '$.current_value') AS DOUBLE) END AS current_value,
  CASE WHEN seq % 4 <> 1 THEN json_extract_string(payload, '$.metric') END AS metric FROM alerts""")
def _(f):
    text = F.when(F.col("seq") % 4 == 1, F.col("vehicle_id")).otherwise(F.col("payload"))
    rows = f.table.events().select("seq", values.decoded_or_raw(text).alias("body"))
    kinds = {"raw": "string", "current_value": "double", "metric": "string"}
    return rows.select("seq", *[F.try_variant_get("body", f"$.{n}", k).alias(n) for n, k in kinds.items()])


@check("f23_epoch_iso", "SELECT seq, strftime(date_trunc('millisecond', occurred_at), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS iso FROM alerts")
def _(f):
    return f.table.events().select("seq", epoch_millis_to_iso(F.unix_millis("ts")).alias("iso"))


@check("f24_serialised_values", f"""SELECT seq, '{{"seq":' || CAST(seq AS VARCHAR) || ',"occurred_at":"' || {ISO} || '","amount":' ||
  CAST(CAST(seq AS DOUBLE) / 4 AS VARCHAR) || '}}' AS txt FROM alerts""")
def _(f):
    rows = f.table.events().select(
        "seq", F.col("ts").alias("occurred_at"), (F.col("seq").cast("decimal(10,2)") / 4).cast("decimal(12,2)").alias("amount")
    )
    return rows.select("seq", values.row_json(rows).alias("txt"))


@check("f25_topic_composition", "SELECT seq, 'fleet/commands/' || vehicle_id || '/' || command_type AS topic FROM commands")
def _(f):
    made = topics.build_topic("fleet", "commands", F.col("vehicle_id"), F.col("command_type"))
    return f.table.commands().select("seq", made.alias("topic"))


@check("f26_alert_descriptions", "SELECT event_type, description, count(*) AS n FROM alerts GROUP BY ALL")
def _(f):
    return f.events.groupBy("event_type", "description").agg(F.count(F.lit(1)).alias("n"))


@check("f27_unit_names", "SELECT speed AS speed_mph, fuel_level AS fuel_pct, tire_pressure AS psi, battery_voltage AS volts FROM telemetry")
def _(f):
    named = {"speed": "speed_mph", "fuel_level": "fuel_pct", "tire_pressure": "psi", "battery_voltage": "volts"}
    return f.telemetry.select(*named).withColumnsRenamed(named)


# --- union and de-duplication of history and live rows ---

CUT = "TIMESTAMP '2024-01-01 06:10:00'"
LIVE_FROM = "TIMESTAMP '2024-01-01 06:00:00'"


def _slices(f):
    rows = f.table.telemetry().select("vehicle_id", F.col("ts").alias("event_time"), "speed", "seq")
    cut, live_from = moment("2024-01-01 06:10:00"), moment("2024-01-01 06:00:00")
    return rows.where(F.col("event_time") <= cut), rows.where(F.col("event_time") > live_from)


@check("x01_history_and_live", f"""SELECT 'history' AS source, vehicle_id, recorded_at AS event_time, speed, seq FROM telemetry WHERE recorded_at <= {CUT}
  UNION ALL SELECT 'live', vehicle_id, recorded_at, speed, seq FROM telemetry WHERE recorded_at > {LIVE_FROM}""")
def _(f):
    return sets.history_and_live(*_slices(f))


@check("x02_live_not_in_history", f"""SELECT DISTINCT vehicle_id, recorded_at AS event_time, speed, seq FROM telemetry WHERE recorded_at > {CUT}""")
def _(f):
    history, live = _slices(f)
    return sets.live_not_in_history(history, live.unionByName(live), arrival="seq")


@check("x03_one_shot_repeat", f""", live AS (SELECT vehicle_id, recorded_at AS event_time, speed, seq * 2 + copy AS arrival
    FROM telemetry, (VALUES (0), (1)) c(copy) WHERE recorded_at > {LIVE_FROM}),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id, event_time ORDER BY arrival) AS n FROM live)
  SELECT vehicle_id, event_time, speed, arrival FROM numbered WHERE NOT (n = 1 AND event_time <= {CUT})""")
def _(f):
    history, live = _slices(f)
    twice = live.withColumn("arrival", F.explode(F.array(F.col("seq") * 2, F.col("seq") * 2 + 1))).drop("seq")
    return sets.live_minus_first_repeat(history, twice, "arrival")


@check("a10_distinct_values", """SELECT 'severity' AS column_name, severity AS value, count(*) AS row_count FROM alerts GROUP BY ALL
  UNION ALL SELECT 'event_type', event_type, count(*) FROM alerts GROUP BY ALL
  UNION ALL SELECT 'vehicle_id', vehicle_id, count(*) FROM alerts GROUP BY ALL""")
def _(f):
    return rolling.distinct_values(f.events, ["severity", "event_type", "vehicle_id"])


@check("a10_null_counts", "SELECT " + ", ".join(
    f"count(*) FILTER ({c} IS NULL) AS {c}" for c in ("vehicle_id", *SENSORS, "latitude", "longitude", "recorded_at", "topic")
) + " FROM telemetry")
def _(f):
    return rolling.null_counts(f.telemetry)


@check("f06_interval_micros", "SELECT seq, epoch_us(TIMESTAMP '2024-01-01 12:00:00') - epoch_us(occurred_at) AS micros FROM alerts")
def _(f):
    return f.table.events().select("seq", micros_between(moment(AS_OF), F.col("ts")).alias("micros"))
