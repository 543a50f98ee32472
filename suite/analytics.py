"""Aggregates, windows, joins and the query API."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from fleetviews.functions.timing import preset_duration
from fleetviews.operators import joins, rolling, topk, windows
from fleetviews.operators.views import in_bbox
from fleetviews.plans import presets
from fleetviews.sources.events_table import AS_OF
from fleetviews.streaming.progress import drain_progress
from .base import HOUR, NOW, check, rounded_sql
from .rows import BOSTON, EVENT_ROW, TELEMETRY_ROW

CONTEXT_ROW = """vehicle_id, event_type, severity, description, alert_time, speed, fuel_level, engine_temp,
  tire_pressure, battery_voltage, metric_time, time_before_alert"""


def six(df, *columns):
    """Averages at six places: their sums depend on the order of addition."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- aggregates ---

WINDOW_ROW = """vehicle_id, window_start, window_end, round(avg_speed_mph, 6) AS avg_speed_mph, max_speed_mph,
  min_speed_mph, sample_count"""


@check("a01_vehicle_speed_5min_avg", f"SELECT {WINDOW_ROW} FROM windows")
def speed_windows(f):
    return six(f.views["vehicle_speed_5min_avg"], "avg_speed_mph")


@check("a02_fleet_alert_summary", "SELECT * FROM summary")
def _(f):
    return f.recent_views(HOUR)["fleet_alert_summary"]


@check("a03_vehicle_event_counts_1h", "SELECT * FROM activity")
def _(f):
    return f.recent_views(HOUR)["vehicle_event_counts_1h"]


@check("a04_row_count", "SELECT count(*) AS row_count FROM telemetry")
def _(f):
    return rolling.row_count(f.telemetry)


@check("a05_freshness", f"""SELECT max(occurred_at) AS latest, epoch_us({NOW}) - epoch_us(max(occurred_at)) AS lag,
  (epoch_us({NOW}) - epoch_us(max(occurred_at))) // 1000000 AS lag_seconds FROM alerts""")
def _(f):
    return rolling.freshness(f.events, "occurred_at", AS_OF)


@check("a06_severity_columns", """SELECT coalesce(sum(alert_count) FILTER (severity = 'high'), 0)::BIGINT AS high,
  coalesce(sum(alert_count) FILTER (severity = 'medium'), 0)::BIGINT AS medium,
  coalesce(sum(alert_count) FILTER (severity = 'low'), 0)::BIGINT AS low FROM summary""")
def _(f):
    return rolling.severity_columns(f.recent_views(HOUR)["fleet_alert_summary"])


@check("a07_all_ready", """, s AS (SELECT vehicle_id, max(occurred_at) > TIMESTAMP '2024-01-01 11:30:00' AS is_ready FROM alerts GROUP BY ALL)
  SELECT count(*) AS connectors, bool_and(is_ready) AS ready FROM s""")
def _(f):
    status = f.events.groupBy("vehicle_id").agg(
        (F.max("occurred_at") > F.to_timestamp(F.lit("2024-01-01 11:30:00"))).alias("is_ready")
    )
    return rolling.all_ready(status)


@check("a08_unified_speed_avg", """SELECT vehicle_id, window_start, window_end, round(avg_speed_mph, 6) AS avg_speed,
  max_speed_mph AS max_speed, sample_count FROM windows""")
def _(f):
    return six(windows.unified_speed_avg(f.unified), "avg_speed")


@check("a09_unified_alert_summary", "SELECT * FROM summary")
def _(f):
    return rolling.unified_alert_summary(f.table.unified(since=AS_OF - HOUR), AS_OF)


@check("a12_drain_progress", """, h AS (SELECT date_trunc('hour', recorded_at) + INTERVAL 1 HOUR AS sample_time, count(*) AS n FROM telemetry GROUP BY ALL
    UNION ALL SELECT TIMESTAMP '2024-01-01 00:00:00', 0),
  d AS (SELECT sample_time, (SELECT count(*) FROM telemetry) - sum(n) OVER (ORDER BY sample_time) AS depth FROM h)
  SELECT sample_time, CAST(depth AS BIGINT) AS depth, CAST(t.n - depth AS BIGINT) AS consumed,
    round(CAST(t.n - depth AS DOUBLE) / t.n * 100, 6) AS percent,
    CAST(epoch(sample_time) - epoch(TIMESTAMP '2024-01-01 00:00:00') AS DOUBLE) AS elapsed_seconds,
    CASE WHEN sample_time > TIMESTAMP '2024-01-01 00:00:00' THEN round(CAST(t.n - depth AS DOUBLE)
      / (epoch(sample_time) - epoch(TIMESTAMP '2024-01-01 00:00:00')), 6) ELSE 0.0 END AS rate
  FROM d, (SELECT count(*) AS n FROM telemetry) t""")
def _(f):
    """Hourly depth of a queue that held all readings at midnight."""
    from pyspark.sql import Window

    hourly = f.telemetry.groupBy(
        (F.date_trunc("hour", "recorded_at") + F.expr("INTERVAL 1 HOUR")).alias("sample_time")
    ).agg(F.count(F.lit(1)).alias("n"))
    start = f.spark.range(1).select(
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("sample_time"), F.lit(0).cast("bigint").alias("n")
    )
    total = f.telemetry.agg(F.count(F.lit(1))).scalar()
    # One row per hour of data reaches this window, not one per reading.
    drained = F.sum("n").over(Window.orderBy("sample_time"))
    samples = hourly.unionByName(start).select("sample_time", (total - drained).alias("depth"))
    return six(drain_progress(samples), "percent", "rate")


# --- windows ---

@check("w01_tumbled_rows", """SELECT vehicle_id, recorded_at, time_bucket(INTERVAL 5 MINUTE, recorded_at, TIMESTAMP '1970-01-01') AS window_start,
  time_bucket(INTERVAL 5 MINUTE, recorded_at, TIMESTAMP '1970-01-01') + INTERVAL 5 MINUTE AS window_end FROM telemetry""")
def _(f):
    return windows.tumbled(f.telemetry.select("vehicle_id", "recorded_at"), "recorded_at")


@check("w02_latest_position", """SELECT vehicle_id, arg_max(latitude, recorded_at) AS latitude, arg_max(longitude, recorded_at) AS longitude,
  arg_max(speed, recorded_at) AS speed_mph, max(recorded_at) AS recorded_at FROM telemetry GROUP BY vehicle_id""")
def _(f):
    return windows.last_known_position(f.telemetry)


RUNS = """, numbered AS (SELECT vehicle_id, recorded_at, engine_temp > 220 AS hot,
    row_number() OVER (PARTITION BY vehicle_id ORDER BY recorded_at) AS n,
    row_number() OVER (PARTITION BY vehicle_id, engine_temp > 220 ORDER BY recorded_at) AS m FROM telemetry)
  SELECT vehicle_id, count(*) AS run_length, min(recorded_at) AS run_start, max(recorded_at) AS run_end
  FROM numbered WHERE hot GROUP BY vehicle_id, n - m HAVING count(*) >= 4"""


@check("w03_consecutive_high_temp", RUNS)
def _(f):
    return windows.consecutive_runs(f.telemetry, F.col("engine_temp") > 220, 4)


@check("w03_hot_chunks_split", RUNS)
def _(f):
    return windows.consecutive_runs(f.telemetry, F.col("engine_temp") > 220, 4, max_chunk_rows=5)


HOPPING = """, hop AS (SELECT t.*, time_bucket(INTERVAL 1 MINUTE, recorded_at, TIMESTAMP '1970-01-01') - to_minutes(CAST(k AS INTEGER)) AS window_start
    FROM telemetry t, range(5) r(k))
  SELECT vehicle_id, window_start, window_start + INTERVAL 5 MINUTE AS window_end, round(avg(speed), 6) AS avg_speed_mph,
    max(speed) AS max_speed_mph, min(speed) AS min_speed_mph, count(*) AS sample_count FROM hop GROUP BY vehicle_id, window_start"""


@check("w04_hopping_avg", HOPPING)
def _(f):
    return six(windows.hopping_speed_avg(f.telemetry), "avg_speed_mph")


@check("w05_versus_fleet", """, w AS (SELECT vehicle_id, speed, time_bucket(INTERVAL 5 MINUTE, recorded_at, TIMESTAMP '1970-01-01') AS window_start FROM telemetry),
  fleet AS (SELECT window_start, avg(speed) AS fleet_avg, stddev_pop(speed) AS dev FROM w GROUP BY ALL),
  v AS (SELECT vehicle_id, window_start, avg(speed) AS vehicle_avg FROM w GROUP BY ALL)
  SELECT vehicle_id, window_start, round(vehicle_avg, 9) AS vehicle_avg, round(fleet_avg, 9) AS fleet_avg,
    round(vehicle_avg - fleet_avg, 9) AS difference,
    CASE WHEN dev > 0 THEN round((vehicle_avg - fleet_avg) / dev, 6) END AS z_score
  FROM v JOIN fleet USING (window_start)""")
def _(f):
    out = windows.versus_fleet(f.telemetry)
    places = {"vehicle_avg": 9, "fleet_avg": 9, "difference": 9, "z_score": 6}
    return out.withColumns({c: F.round(c, n) for c, n in places.items()})


# --- joins ---

@check("j01_alerts_with_context", f"SELECT {CONTEXT_ROW} FROM context")
def _(f):
    return f.zoneless["alerts_with_context"]


@check("j01_hot_groups_split", f"SELECT {CONTEXT_ROW} FROM context")
def _(f):
    return joins.alerts_with_context(f.zoneless["fleet_events_raw"], f.zoneless["fleet_telemetry_raw"], max_group_rows=2)


@check("j01_alerts_that_have_context", f"""SELECT {EVENT_ROW} FROM alerts e WHERE EXISTS (SELECT 1 FROM telemetry r
  WHERE r.vehicle_id = e.vehicle_id AND r.recorded_at BETWEEN e.occurred_at - INTERVAL 2 MINUTE AND e.occurred_at)""")
def _(f):
    return joins.alerts_that_have_context(f.events, f.telemetry)


@check("j02_unified_self_join", """SELECT e.vehicle_id, e.event_type, e.severity, e.description, e.occurred_at AS alert_time,
  m.metric_type, m.value AS metric_value, m.unit, m.ts AS metric_time, epoch_us(e.occurred_at) - epoch_us(m.ts) AS time_before_alert
  FROM alerts e JOIN metrics m ON e.vehicle_id = m.vehicle_id AND m.ts BETWEEN e.occurred_at - INTERVAL 2 MINUTE AND e.occurred_at""")
def _(f):
    return joins.alerts_with_long_context(f.zoneless["fleet_events_raw"], f.zoneless["fleet_telemetry_raw"])


@check("j03_events_of_vehicles_in_region", f"""SELECT vehicle_id, event_type, description, occurred_at FROM alerts
  WHERE severity = 'high' AND topic LIKE 'fleet/events/%' AND vehicle_id IN (SELECT vehicle_id FROM telemetry
    WHERE {BOSTON})""")
def _(f):
    region = f.views["vehicles_in_region_boston"]
    high = f.events.where((F.col("severity") == "high") & F.col("topic").like("fleet/events/%"))
    return joins.events_of_vehicles_in(high, region).select("vehicle_id", "event_type", "description", "occurred_at")


@check("j03_events_of_vehicles_in_box", f"""SELECT {EVENT_ROW} FROM alerts WHERE vehicle_id IN (SELECT vehicle_id
  FROM telemetry WHERE latitude BETWEEN 42.3 AND 42.35 AND longitude BETWEEN -71.1 AND -71.06)""")
def _(f):
    """A box so small that some vehicles never enter it."""
    region = f.telemetry.where(in_bbox(42.3, 42.35, -71.1, -71.06))
    return joins.events_of_vehicles_in(f.events, region)


# --- orderings and top-k ---

def placed(rows):
    """Numbers rows as they come: a limited order comes in one partition."""
    return rows.withColumn("place", F.monotonically_increasing_id() + 1)


def place_sql(order):
    return f"row_number() OVER (ORDER BY {order}) AS place"


@check("t01_newest", f"""SELECT {TELEMETRY_ROW}, {place_sql("recorded_at DESC, vehicle_id")} FROM telemetry
  ORDER BY recorded_at DESC, vehicle_id LIMIT 20""")
def _(f):
    return placed(topk.newest(f.telemetry, "recorded_at"))


@check("t02_by_severity", """SELECT severity, alert_count, affected_vehicles, row_number() OVER (ORDER BY CASE severity
  WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS place FROM summary""")
def _(f):
    from fleetviews.functions.values import severity_rank

    ordered = topk.by_severity(f.recent_views(HOUR)["fleet_alert_summary"])
    return ordered.withColumn("place", severity_rank(F.col("severity")))


@check("t03_most_active", f"""SELECT *, {place_sql("event_count DESC, vehicle_id, severity")} FROM activity
  ORDER BY event_count DESC, vehicle_id, severity LIMIT 12""")
def _(f):
    return placed(topk.most_active(f.recent_views(HOUR)["vehicle_event_counts_1h"], 12))


@check("t04_latest_windows", f"""SELECT {WINDOW_ROW}, {place_sql("window_end DESC, vehicle_id")} FROM windows
  ORDER BY window_end DESC, vehicle_id LIMIT 25""")
def _(f):
    return six(placed(topk.latest_windows(f.views["vehicle_speed_5min_avg"], 25)), "avg_speed_mph")


@check("t05_oldest_first", f"""SELECT {EVENT_ROW}, {place_sql("occurred_at, vehicle_id")} FROM alerts
  ORDER BY occurred_at, vehicle_id LIMIT 500""")
def _(f):
    return placed(topk.oldest_first(f.events, "occurred_at", 500))


@check("t06_adhoc_cap", f"SELECT {EVENT_ROW} FROM alerts ORDER BY occurred_at DESC, vehicle_id LIMIT 1000")
def _(f):
    return topk.newest(f.events, "occurred_at", 1000)


@check("t07_tool_cap", "SELECT vehicle_id, event_type, description, occurred_at FROM alerts WHERE severity = 'high' ORDER BY occurred_at DESC, vehicle_id LIMIT 20")
def _(f):
    return presets.get_high_severity_alerts(f.views, 20)


# --- pattern API ---

HIGH_ROW = "vehicle_id, event_type, description, payload, occurred_at, topic"


@check("q01_query_since", f"""SELECT {HIGH_ROW} FROM alerts WHERE severity = 'high' AND occurred_at > {NOW} - INTERVAL 1 HOUR
  ORDER BY occurred_at DESC, vehicle_id LIMIT 20""")
def _(f):
    return f.recent_client(1).query("fleet/events/*/alerts/high", since="1h")


@check("q01_query_concrete_topic", f"""SELECT {HIGH_ROW} FROM alerts WHERE topic = 'fleet/events/vehicle_005/alerts/high'
  ORDER BY occurred_at DESC LIMIT 20""")
def _(f):
    return f.client.query("fleet/events/vehicle_005/alerts/high")


@check("q01_query_whole_tree", f"SELECT {EVENT_ROW} FROM alerts ORDER BY occurred_at DESC, vehicle_id LIMIT 30")
def _(f):
    return f.client.query("fleet/events/>", limit=30)


@check("q02_query_window", f"SELECT {WINDOW_ROW} FROM windows")
def _(f):
    """Ten vehicles in half a day have at most 1440 windows, so the limit keeps them all."""
    return six(f.client.query("fleet/telemetry/*/metrics", window="5min", limit=2000), "avg_speed_mph")


@check("q03_query_enrich", f"""SELECT {CONTEXT_ROW} FROM context WHERE alert_time > {NOW} - INTERVAL 4 HOUR
  ORDER BY alert_time DESC, vehicle_id, event_type, severity, description, speed LIMIT 30""")
def _(f):
    return f.recent_client(4).query("fleet/events/*/alerts/high", enrich="context", since="4h", limit=30)


@check("q04_query_region", f"SELECT vehicle_id, latitude, longitude, speed AS speed_mph, recorded_at FROM telemetry WHERE {BOSTON} ORDER BY recorded_at DESC, vehicle_id LIMIT 20")
def _(f):
    from fleetviews.plans.client import FleetClient
    from fleetviews.plans.registry import Mapping, Registry

    spatial = Mapping("fleet/telemetry/*/position", "fleet_telemetry_raw", "recorded_at",
                      spatial={"boston": "vehicles_in_region_boston"})
    client = FleetClient(f.spark, f.views, Registry().followed_by(spatial))
    return client.query("fleet/telemetry/*/position", region="Boston")


@check("q05_query_sql", "SELECT severity, count(*) AS n FROM alerts GROUP BY severity")
def _(f):
    return f.client.query(sql="SELECT severity, count(*) AS n FROM fleet_events_raw GROUP BY severity")


@check("q09_topic_lag", f"""SELECT 'high_severity_alerts' AS mv, max(occurred_at) AS latest, epoch_us({NOW}) - epoch_us(max(occurred_at)) AS lag,
  (epoch_us({NOW}) - epoch_us(max(occurred_at))) // 1000000 AS lag_seconds FROM alerts WHERE severity = 'high'""")
def _(f):
    return f.client.topic_lag("fleet/events/*/alerts/high")


@check("q11_alert_list", "SELECT vehicle_id, event_type, description, payload, occurred_at FROM alerts WHERE severity = 'medium' ORDER BY occurred_at DESC, vehicle_id LIMIT 20")
def _(f):
    return f.client.alert_list("medium")


@check("q12_alert_history", f"SELECT {EVENT_ROW} FROM alerts WHERE occurred_at > {NOW} - INTERVAL 4 HOUR ORDER BY occurred_at DESC, vehicle_id LIMIT 50")
def _(f):
    return f.recent_client(4).alert_history()


@check("q12_alert_history_enriched", f"""SELECT {CONTEXT_ROW} FROM context WHERE alert_time > {NOW} - INTERVAL 4 HOUR AND severity = 'high'
  ORDER BY alert_time DESC, vehicle_id, event_type, severity, description, speed LIMIT 50""")
def _(f):
    return f.recent_client(4).alert_history(severity="high", enrich=True)


@check("q14_guarded_select", "SELECT vehicle_id, count(*) AS n FROM telemetry WHERE engine_temp > 220 GROUP BY vehicle_id")
def _(f):
    return f.client.select("SELECT vehicle_id, count(*) AS n FROM high_engine_temp_vehicles GROUP BY vehicle_id;")


@check("q15_parameterised_sql", "SELECT count(*) AS n FROM alerts WHERE severity = 'low' AND vehicle_id = 'vehicle_002'")
def _(f):
    return f.client.sql(
        "SELECT count(*) AS n FROM fleet_events_raw WHERE severity = :s AND vehicle_id = :v",
        {"s": "low", "v": "vehicle_002"},
    )


@check("q18_fleet_stats", """SELECT coalesce(sum(alert_count) FILTER (severity = 'high'), 0)::BIGINT AS high,
  coalesce(sum(alert_count) FILTER (severity = 'medium'), 0)::BIGINT AS medium,
  coalesce(sum(alert_count) FILTER (severity = 'low'), 0)::BIGINT AS low, 10::BIGINT AS vehicles, true AS backfill_ready FROM summary""")
def _(f):
    return f.recent_client(1).fleet_stats(10)


# --- presets ---

BY_SEVERITY = "SELECT severity, alert_count, affected_vehicles FROM summary"


def alert_oracle(columns: str, where: str, k: int = 100) -> str:
    return f"SELECT {columns} FROM alerts WHERE {where} ORDER BY occurred_at DESC, vehicle_id LIMIT {k}"


def context_oracle(named: bool, where: str, k: int) -> str:
    names = dict(zip(
        ("speed", "fuel_level", "engine_temp", "tire_pressure"),
        ("speed_mph", "fuel_pct", "engine_temp_f", "psi") if named else
        ("speed", "fuel_level", "engine_temp", "tire_pressure"),
    ))
    shown = ", ".join(f"{rounded_sql(c, 1)} AS {n}" for c, n in names.items())
    volts = f"{rounded_sql('battery_voltage', 2)} AS {'volts' if named else 'battery_voltage'}"
    return f"""SELECT vehicle_id, event_type, severity, description, alert_time, {shown}, {volts}, time_before_alert
      FROM context WHERE {where} ORDER BY alert_time DESC, vehicle_id, time_before_alert LIMIT {k}"""


def reading_oracle(column: str, where: str, k: int = 100) -> str:
    return f"SELECT vehicle_id, {column}, recorded_at FROM telemetry WHERE {where} ORDER BY recorded_at DESC, vehicle_id LIMIT {k}"


def position_oracle(places: int, where: str, k: int) -> str:
    return reading_oracle(
        f"{rounded_sql('latitude', places)} AS lat, {rounded_sql('longitude', places)} AS lon, {rounded_sql('speed', 1)} AS speed_mph", where, k)


def window_oracle(columns: str, where: str, k: int) -> str:
    return f"SELECT {columns} FROM windows WHERE {where} ORDER BY window_end DESC, vehicle_id LIMIT {k}"


LAST_HOUR = f"occurred_at > {NOW} - INTERVAL 1 HOUR"
AVG1, MAX1, MIN1 = (
    f"{rounded_sql(f'{x}_speed_mph', 1)} AS {x}_mph" for x in ("avg", "max", "min")
)
AVG2, MAX2 = (f"{rounded_sql(f'{x}_speed_mph', 2)} AS {x}_mph" for x in ("avg", "max"))
SHORT = "vehicle_id, event_type, description, occurred_at"

_PRESETS = {
    "q20_preset_fleet_alert_summary": (("fleet_alert_summary", {}), BY_SEVERITY),
    "q21_preset_high_alerts": (
        ("high_alerts", {"since": "1h", "vehicle_id": "vehicle_004"}),
        alert_oracle(f"{SHORT}, topic", f"severity = 'high' AND vehicle_id = 'vehicle_004' AND {LAST_HOUR}")),
    "q22_preset_medium_alerts": (("medium_alerts", {"limit": 40}), alert_oracle(SHORT, "severity = 'medium'", 40)),
    "q23_preset_low_alerts": (("low_alerts", {"since": "4h"}), alert_oracle(SHORT, f"severity = 'low' AND occurred_at > {NOW} - INTERVAL 4 HOUR")),
    "q24_preset_all_alerts": (
        ("all_alerts", {"since": "8h", "severity": "medium"}),
        alert_oracle("vehicle_id, severity, event_type, description, occurred_at, topic",
                     f"severity = 'medium' AND occurred_at > {NOW} - INTERVAL 8 HOUR")),
    "q25_preset_alerts_context": (("alerts_context", {}), context_oracle(True, "true", 100)),
    "q25_preset_alerts_context_filtered": (
        ("alerts_context", {"since": "8h", "vehicle_id": "vehicle_006", "severity": "high"}),
        context_oracle(True, f"alert_time > {NOW} - INTERVAL 8 HOUR AND vehicle_id = 'vehicle_006' AND severity = 'high'", 100)),
    "q26_preset_vehicle_activity": (
        ("vehicle_activity", {"severity": "high"}),
        "SELECT * FROM activity WHERE severity = 'high' ORDER BY event_count DESC, vehicle_id LIMIT 100"),
    "q27_preset_speed_averages": (
        ("speed_averages", {}),
        window_oracle(f"vehicle_id, window_start, window_end, {AVG1}, {MAX1}, {MIN1}, sample_count", "true", 100)),
    "q27_preset_speed_averages_since": (
        ("speed_averages", {"since": "15m", "vehicle_id": "vehicle_001"}),
        window_oracle(f"vehicle_id, window_start, window_end, {AVG1}, {MAX1}, {MIN1}, sample_count",
                      f"vehicle_id = 'vehicle_001' AND window_end > {NOW} - INTERVAL 15 MINUTE", 100)),
    "q28_preset_fuel_levels": (
        ("fuel_levels", {"since": "30m"}),
        reading_oracle(f"{rounded_sql('fuel_level', 1)} AS fuel_pct", f"recorded_at > {NOW} - INTERVAL 30 MINUTE")),
    "q29_preset_high_engine_temp": (
        ("high_engine_temp", {"vehicle_id": "vehicle_008"}),
        reading_oracle(f"{rounded_sql('engine_temp', 1)} AS engine_temp_f", "engine_temp > 220 AND vehicle_id = 'vehicle_008'")),
    "q30_preset_last_positions": (("last_positions", {}), position_oracle(4, "true", 100)),
    "q31_preset_boston_region": (
        ("boston_region", {"since": "24h", "vehicle_id": "ignored"}),
        position_oracle(4, f"{BOSTON} AND recorded_at > {NOW} - INTERVAL 24 HOUR", 100)),
}
def _run_preset(f, name: str, args: dict):
    """A bounded preset scans only its span, and the reach of a window or context before it."""
    views = f.views
    if "since" in args:
        views = f.recent_views(preset_duration(args["since"]) + timedelta(minutes=5))
    elif name in ("fleet_alert_summary", "vehicle_activity"):
        views = f.recent_views(HOUR)
    return presets.preset(views, name, **args)


for _name, ((_preset, _args), _sql) in _PRESETS.items():
    check(_name, _sql)(lambda f, p=_preset, a=_args: _run_preset(f, p, a))

_TOOLS = {
    "q40_tool_fleet_alert_summary": (("get_fleet_alert_summary", {}), BY_SEVERITY),
    "q41_tool_high_severity_alerts": (("get_high_severity_alerts", {}), alert_oracle(SHORT, "severity = 'high'", 10)),
    "q42_tool_speed_averages": (
        ("get_vehicle_speed_averages", {}), window_oracle(f"vehicle_id, {AVG1}, {MAX1}, sample_count, window_end", "true", 20)),
    "q43_tool_alerts_with_context": (("get_alerts_with_context", {"limit": 15}), context_oracle(False, "true", 15)),
    "q44_tool_vehicles_in_boston": (("get_vehicles_in_boston", {}), position_oracle(4, BOSTON, 20)),
    "q45_tool_vehicle_activity": (
        ("get_vehicle_activity", {}), "SELECT * FROM activity ORDER BY event_count DESC, vehicle_id, severity LIMIT 20"),
    "q46_tool_vehicle_details": (
        ("get_vehicle_details", {"vehicle_id": "vehicle_005"}),
        alert_oracle("vehicle_id, event_type, severity, description, occurred_at", "severity = 'high' AND vehicle_id = 'vehicle_005'", 10)),
}
for _name, ((_tool, _args), _sql) in _TOOLS.items():
    check(_name, _sql)(lambda f, t=_tool, a=_args: f.client.tool(t, **a))

_WALKTHROUGH = {
    "q50_newest_high_alerts": (presets.newest_high_alerts, alert_oracle(SHORT, "severity = 'high'", 20)),
    "q51_newest_speeds": (presets.newest_speeds, reading_oracle("speed AS speed_mph, latitude, longitude", "true", 20)),
    "q52_newest_speed_windows": (
        presets.newest_speed_windows,
        window_oracle(f"vehicle_id, window_start, window_end, {AVG2}, {MAX2}, sample_count", "true", 20)),
    "q53_alert_summary": (presets.alert_summary, BY_SEVERITY),
    "q55_geofence_positions": (presets.geofence_positions, position_oracle(5, BOSTON, 10)),
    "q56_activity_heatmap": (
        presets.activity_heatmap, "SELECT * FROM activity ORDER BY event_count DESC, vehicle_id, severity LIMIT 20"),
    "q57_readme_windows": (
        presets.readme_windows, window_oracle(f"vehicle_id, window_start, window_end, {AVG2}, sample_count", "true", 20)),
    "q57_readme_context": (
        presets.readme_context,
        """SELECT vehicle_id, event_type, severity, speed, engine_temp, time_before_alert FROM
           (SELECT * FROM context ORDER BY alert_time DESC, vehicle_id, time_before_alert LIMIT 10)"""),
    "q57_readme_geofence": (
        presets.readme_geofence,
        f"""SELECT vehicle_id, latitude, longitude, speed AS speed_mph FROM
            (SELECT * FROM telemetry WHERE {BOSTON} ORDER BY recorded_at DESC, vehicle_id LIMIT 10)"""),
}
for _name, (_query, _sql) in _WALKTHROUGH.items():
    check(_name, _sql)(lambda f, q=_query: q(f.views))


@check("q54_context_long", f"""SELECT e.vehicle_id, e.event_type, e.severity, e.description, e.occurred_at AS alert_time, m.metric_type,
  {rounded_sql('m.value', 2)} AS metric_value, m.unit, epoch_us(e.occurred_at) - epoch_us(m.ts) AS time_before_alert
  FROM alerts e JOIN metrics m ON e.vehicle_id = m.vehicle_id AND m.ts BETWEEN e.occurred_at - INTERVAL 2 MINUTE AND e.occurred_at
  ORDER BY alert_time DESC, e.vehicle_id, time_before_alert, metric_type, event_type LIMIT 10""")
def _(f):
    return presets.context_long(f.views)


@check("q58_verification", "SELECT vehicle_id, severity, occurred_at AS event_timestamp FROM alerts WHERE severity = 'high' ORDER BY occurred_at DESC, vehicle_id LIMIT 5")
def _(f):
    return presets.verification(f.unified)


@check("q59_live_windows", """SELECT vehicle_id, avg_speed FROM (SELECT vehicle_id, round(avg_speed_mph, 6) AS avg_speed, window_end
  FROM windows ORDER BY window_end DESC, vehicle_id LIMIT 5)""")
def _(f):
    return six(presets.live_windows(f.unified), "avg_speed")


@check("q59_live_summary", "SELECT * FROM summary")
def _(f):
    return rolling.unified_alert_summary(f.table.unified(since=AS_OF - timedelta(hours=1)), AS_OF)
