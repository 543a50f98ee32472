"""Boundaries of the operators, and brute-force comparisons on small random data."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetviews.functions import timing, values
from fleetviews.operators import covers, joins, rolling, sets, skew, topk, views, windows
from fleetviews.plans import presets
from fleetviews.plans.viewset import ViewSet
from fleetviews.schemas import SENSORS, valid_event
from suite.base import comparable

T0 = datetime(2024, 1, 1, 12)
READING = "vehicle_id string, recorded_at timestamp, speed double, engine_temp double, latitude double, longitude double"


def readings(spark, rows):
    full = [(v, t, s, 0.0, 42.3, -71.0) if len(r) == 3 else r for r in rows for v, t, s, *_ in [r]]
    return spark.createDataFrame(full, READING)


def sensors(df):
    return df.withColumns({c: F.lit(1.0) for c in ("fuel_level", "tire_pressure", "battery_voltage")})


def alerts(spark, rows):
    df = spark.createDataFrame(rows, "vehicle_id string, severity string, occurred_at timestamp")
    return df.withColumns({
        "event_type": F.lit("low_fuel"), "description": F.lit("d"), "payload": F.lit("{}"),
        "topic": F.concat(F.lit("fleet/events/"), "vehicle_id", F.lit("/alerts/"), "severity"),
    })


def test_window_edges_and_nulls(spark):
    df = readings(spark, [
        ("v", T0, 10.0), ("v", T0 + timedelta(minutes=5) - timedelta(microseconds=1), None),
        ("v", T0 + timedelta(minutes=5), 30.0), ("v", None, 99.0),
    ])
    rows = {r["window_start"]: r for r in windows.vehicle_speed_avg(df).collect()}
    assert set(rows) == {T0, T0 + timedelta(minutes=5)}
    first = rows[T0]
    assert (first["avg_speed_mph"], first["sample_count"], first["window_end"]) == (10.0, 2, T0 + timedelta(minutes=5))


def test_interval_ends_are_inclusive(spark):
    offsets = [timedelta(0), timedelta(minutes=2), timedelta(minutes=2, microseconds=1), timedelta(microseconds=-1)]
    tel = sensors(readings(spark, [("v", T0 - o, float(i)) for i, o in enumerate(offsets)]))
    ev = alerts(spark, [("v", "high", T0)])
    for bins in (1, 2, 4, 7):
        got = {r["speed"] for r in joins.alerts_with_context(ev, tel, bins_per_span=bins).collect()}
        assert got == {0.0, 1.0}


def test_rolling_bound_is_strict(spark):
    ev = alerts(spark, [
        ("v", "high", T0 - timedelta(hours=1)), ("v", "high", T0 - timedelta(hours=1) + timedelta(microseconds=1)),
        ("w", "high", T0 + timedelta(days=1)), (None, "high", T0),
    ])
    row = rolling.fleet_alert_summary(ev, T0).first()
    assert (row["alert_count"], row["affected_vehicles"]) == (3, 2)
    assert rolling.vehicle_event_counts(ev, T0).count() == 3


def test_bbox_corners_and_limits(spark):
    df = spark.createDataFrame(
        [("a", T0, 1.0, 220.0, 42.2, -71.2), ("b", T0, 1.0, 220.1, 42.5, -70.9), ("c", T0, 1.0, None, 42.51, -71.0),
         ("d", T0, 1.0, 0.0, None, -71.0)], READING)
    assert {r["vehicle_id"] for r in views.vehicles_in_region(df).collect()} == {"a", "b"}
    assert {r["vehicle_id"] for r in views.outside_region(df).collect()} == {"c"}
    assert {r["vehicle_id"] for r in views.high_engine_temp_vehicles(df).collect()} == {"b"}
    assert [r[0] for r in df.orderBy("vehicle_id").select(views.region_of()).collect()] == [["boston"], ["boston"], [], []]


def test_region_table(spark):
    edges = [-0.5, 0.0, 0.25, 0.5, 1.0, 1.5, 2.0]
    points = [(f"v{i}", T0, 1.0, 0.0, x, y) for i, (x, y) in enumerate([(a, b) for a in edges for b in edges])]
    boxes = [("a", 0.0, 1.0, 0.0, 1.0), ("b", 0.5, 0.5, -1.0, 3.0), ("c", -0.5, -0.1, 0.25, 2.0), ("none", 1.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame([*points, ("n", T0, 1.0, 0.0, None, 0.5)], READING)
    regions = spark.createDataFrame(boxes, "region string, min_lat double, max_lat double, min_lon double, max_lon double")
    want = sorted((p[0], r[0]) for p in points for r in boxes if r[1] <= p[4] <= r[2] and r[3] <= p[5] <= r[4])
    for cell in (0.25, 0.3, 1.0, 10.0):
        found = joins.in_regions(df, regions, cell)
        assert found.columns == [*df.columns, "region"]
        assert sorted((r["vehicle_id"], r["region"]) for r in found.collect()) == want


REGIONS = "region string, min_lat double, max_lat double, min_lon double, max_lon double"


def test_region_table_of_all_sizes(spark):
    """Boxes from a hundred metres to the whole earth and beyond, most rows at one depot."""
    rng = random.Random(3)
    inf, nan = float("inf"), float("nan")
    spots = [(42.36, -71.06)] * 200 + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(100)]
    spots += [(42.36 + rng.uniform(-1, 1) * 10.0 ** -rng.randrange(5), -71.06) for _ in range(100)]
    points = [(f"v{i}", T0, 1.0, 0.0, x, y) for i, (x, y) in enumerate([*spots, (nan, 0.0), (1e6, 1e6), (0.0, -inf)])]
    boxes = [("everywhere", -inf, inf, -inf, inf), ("earth", -90.0, 90.0, -180.0, 180.0), ("beyond", 1e5, 1e7, 1e5, inf)]
    for i in range(60):
        x, y = rng.choice(spots)
        size = 10.0 ** rng.uniform(-4, 2)
        boxes.append((f"r{i}", x - size * rng.random(), x + size, y - size, y + size * rng.random()))
    boxes += [("point", 42.36, 42.36, -71.06, -71.06), ("null", None, 1.0, 0.0, 1.0)]
    regions = spark.createDataFrame(boxes, REGIONS)
    sizes = joins.region_cells(regions).groupBy("region").count().collect()
    assert len(sizes) == len(boxes) - 1 and max(r["count"] for r in sizes) <= (joins.REACH + 2) ** 2
    df = spark.createDataFrame(points, READING)
    want = sorted(
        (p[0], r[0]) for p in points for r in boxes
        if r[1] is not None and r[1] <= p[4] <= r[2] and r[3] <= p[5] <= r[4]
    )
    assert sorted((r["vehicle_id"], r["region"]) for r in joins.in_regions(df, regions).collect()) == want
    assert joins.in_regions(df, regions.limit(0)).isEmpty()
    counts = joins.in_regions(df, regions, counted="regions")
    assert counts.columns == [*df.columns, "regions"]
    assert {r["vehicle_id"]: r["regions"] for r in counts.collect()} == Counter(v for v, _ in want)
    assert joins.in_regions(df, regions.limit(0), counted="regions").isEmpty()


@pytest.mark.parametrize("points_of_a_slab", [20, 150, 20_000])
def test_regions_counted(spark, monkeypatch, points_of_a_slab):
    """Positions on edges and corners of boxes, on the same spots, and none; repeated boxes count each time."""
    monkeypatch.setattr(covers, "SLAB_POINTS", points_of_a_slab)
    rng = random.Random(5)
    some = [-0.0, 0.0, 0.5, 1.0, 1.5, float("nan"), float("inf"), -float("inf"), *[rng.uniform(-1, 3) for _ in range(30)]]
    points = [(f"v{i}", T0, 1.0, 0.0, rng.choice(some), rng.choice(some)) for i in range(300)]
    points += [points[0], ("n", T0, 1.0, 0.0, None, 0.5), (None, None, None, None, 0.5, 0.5)]
    boxes = [(f"r{i}", *(rng.choice(some) for _ in range(4))) for i in range(150)]
    boxes += [boxes[0], (None, 0.0, 1.0, 0.0, 1.0), ("null", 0.0, None, 0.0, 1.0), ("point", 0.5, 0.5, 0.5, 0.5)]
    df, regions = spark.createDataFrame(points, READING), spark.createDataFrame(boxes, REGIONS)
    pairs = df.join(regions, F.expr("latitude BETWEEN min_lat AND max_lat AND longitude BETWEEN min_lon AND max_lon"))
    want = Counter(r["vehicle_id"] for r in pairs.collect())
    found = joins.in_regions(df, regions, counted="n")
    got = found.groupBy("vehicle_id").agg(F.sum("n").alias("n")).collect()
    assert {r["vehicle_id"]: r["n"] for r in got} == want and None in want


def test_counted_regions_form_no_pairs(spark, tmp_path):
    """Four thousand positions, each in four thousand boxes: positions and boxes are never joined."""
    df = spark.range(4000).selectExpr("id", "id / 4000D AS latitude", "id * 7 % 4000 / 4000D AS longitude")
    regions = df.selectExpr(
        "string(id) AS region", "latitude - 2 AS min_lat", "latitude + 2 AS max_lat", "longitude - 2 AS min_lon",
        "longitude + 2 AS max_lon",
    )
    found = joins.in_regions(df, regions, counted="regions")
    assert found.where("regions = 4000").count() == 4000
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joined = [line for line in plan if "Join" in line]
    assert joined and not any(column in line for line in joined for column in ("min_", "max_"))


def test_depots_do_not_meet_in_one_cell(spark):
    """A thousand depots in one degree: a position is tested against those around it only."""
    depots = spark.range(1000).selectExpr(
        "concat('d', id) AS region", "id % 32 / 32D AS min_lat", "id % 32 / 32D + 0.002 AS max_lat",
        "id div 32 / 32D AS min_lon", "id div 32 / 32D + 0.002 AS max_lon",
    )
    cells = joins.region_cells(depots)
    assert cells.groupBy("_level", "_row", "_column").count().agg(F.max("count")).first()[0] == 1
    positions = depots.selectExpr("min_lat + 0.001 AS latitude", "min_lon + 0.001 AS longitude", "region AS at")
    found = joins.in_regions(positions, depots)
    assert found.count() == 1000 and found.where("at != region").isEmpty()


def test_oversized_groups(spark):
    df = spark.range(60).selectExpr("id % 6 AS k", "id AS v")
    assert skew.oversized(df, ["k"], 10).isEmpty()
    assert skew.with_parts(df, skew.oversized(df, ["k"], 10), ["k"]).select(skew.PARTS).distinct().collect() == [(1,)]
    assert sorted(map(tuple, skew.oversized(df, ["k"], 4).collect())) == [(k, 3) for k in range(6)]
    assert skew.with_parts(df, skew.oversized(df, ["k"], 4), ["k"]).count() == 60


def random_fleet(seed, vehicles=3, n=150, span=1800):
    rng = random.Random(seed)
    # One vehicle holds most rows, and times repeat.
    pick = lambda: "hot" if rng.random() < 0.6 else f"v{rng.randrange(vehicles)}"
    at = lambda: T0 + timedelta(seconds=rng.randrange(span), microseconds=rng.choice((0, 0, 1)))
    tel = [(pick(), at(), float(i), rng.choice((200.0, 230.0, 240.0)), 0.0, 0.0) for i in range(n)]
    ev = [(pick(), rng.choice(("high", "low")), at()) for _ in range(n // 3)]
    return tel, ev


@pytest.mark.parametrize("seed", range(4))
def test_interval_join_against_brute_force(spark, seed):
    tel, ev = random_fleet(seed)
    want = sorted(
        (v, t, s) for v, _, t in ev for w, r, s, *_ in tel if v == w and t - timedelta(minutes=2) <= r <= t
    )
    df, events = sensors(spark.createDataFrame(tel, READING)), alerts(spark, ev)
    for tuning in ({}, {"bins_per_span": 1}, {"max_group_rows": 3}, {"max_group_rows": 1, "bins_per_span": 1}):
        got = joins.alerts_with_context(events, df, **tuning)
        assert sorted((r["vehicle_id"], r["alert_time"], r["speed"]) for r in got.collect()) == want
    touched = joins.alerts_that_have_context(events, df)
    exists = sorted((v, t) for v, _, t in ev if any((v, t) == w[:2] for w in want))
    assert sorted((r["vehicle_id"], r["occurred_at"]) for r in touched.collect()) == exists
    for k in (1, 3, 10, 1000):
        rows = joins.newest_alerts_with_context(events, df, k)
        newest = sorted((r["alert_time"] for r in rows.collect()), reverse=True)[:k]
        assert newest == sorted((t for _, t, _ in want), reverse=True)[:k]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("chunk", [timedelta(seconds=30), timedelta(minutes=10), timedelta(days=1)])
def test_runs_against_brute_force(spark, seed, chunk):
    tel, _ = random_fleet(seed)
    tel = [(v, t, s, temp if i % 9 else None, 0.0, 0.0) for i, (v, t, s, temp, *_) in enumerate(tel)]
    want = []
    for vehicle in {r[0] for r in tel}:
        run: list = []
        for row in [*sorted((r for r in tel if r[0] == vehicle), key=lambda r: (r[1], r[2])), None]:
            if row and row[3] and row[3] > 220:
                run.append(row[1])
                continue
            if len(run) >= 3:
                want.append((vehicle, len(run), run[0], run[-1]))
            run = []
    df = spark.createDataFrame(tel, READING)
    for most in (None, 4):
        got = windows.consecutive_runs(
            df, F.col("engine_temp") > 220, 3, tie_breaker="speed", chunk=chunk, max_chunk_rows=most
        )
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("a", 2, 2, "z"), ("b", 1, 1, None)], "k string, t int, id int, p string")
    got = windows.latest_per_key(df, ["k"], ["t", "id"])
    assert sorted((r["k"], r["p"] or "") for r in got.collect()) == [("a", "z"), ("b", "")]


def _emulated(history, live):
    """Both policies, one row at a time."""
    known, once, shot = set(history), [], []
    seen, pending = set(known), set(known)
    for i, key in enumerate(live):
        if key not in seen:
            seen.add(key)
            once.append(i)
        if key in pending:
            pending.discard(key)
        else:
            shot.append(i)
    return once, shot


@pytest.mark.parametrize("seed", range(3))
def test_deduplication_policies(spark, seed):
    rng = random.Random(seed)
    key = lambda: (rng.choice(("a", "b", None)), rng.randrange(6))
    history, live = [key() for _ in range(8)], [key() for _ in range(40)] + [("a", 1)] * 20
    h = spark.createDataFrame(history, "vehicle_id string, event_time int")
    n = spark.createDataFrame([(*k, i) for i, k in enumerate(live)], "vehicle_id string, event_time int, arrival int")
    once, shot = _emulated(history, live)
    assert sorted(r["arrival"] for r in sets.live_not_in_history(h, n, arrival="arrival").collect()) == once
    assert sorted(r["arrival"] for r in sets.live_minus_first_repeat(h, n, "arrival").collect()) == shot
    tagged = sets.history_and_live(h, n).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in tagged} == {"history": 8, "live": 60}


def test_orderings(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 2), ("d", 2)], "vehicle_id string, t int")
    assert [r[0] for r in topk.newest(df, "t", 3).collect()] == ["b", "c", "d"]
    assert [r[0] for r in topk.oldest_first(df, "t").collect()] == ["a", "c", "d", "b"]
    summary = spark.createDataFrame([("low", 1), ("odd", 2), ("high", 3), ("medium", 4)], "severity string, alert_count int")
    assert [r[0] for r in topk.by_severity(summary).collect()] == ["high", "medium", "low", "odd"]


def test_empty_views(spark):
    none = alerts(spark, []).limit(0)
    assert rolling.freshness(none, "occurred_at", T0).first()[:] == (None, None, None)
    assert list(rolling.severity_columns(rolling.fleet_alert_summary(none, T0)).first()) == [0, 0, 0]
    assert list(rolling.all_ready(none.select(F.lit(True).alias("is_ready"))).first()) == [0, False]


def test_durations(spark):
    assert timing.parse_duration(" 30MIN ") == timedelta(minutes=30)
    assert timing.parse_duration("2d") == timedelta(days=2) and timing.parse_duration("4hr") == timedelta(hours=4)
    for bad in ("", "h", "1 h", "1w", "-1h", "1.5h"):
        with pytest.raises(ValueError):
            timing.parse_duration(bad)
    assert timing.preset_duration(" 1H ") == timedelta(hours=1)
    assert timing.preset_duration("2h") is None and timing.preset_duration(None) is None
    texts = spark.createDataFrame([("10s",), ("1w",), (None,), (" 2D ",)], "t string")
    got = [r[0] for r in texts.select(timing.duration_column(F.col("t"))).collect()]
    assert got == [timedelta(seconds=10), None, None, timedelta(days=2)]


def test_values(spark):
    row = spark.createDataFrame([(0.25, "not json", "", '{"a":1}')], "x double, bad string, empty string, good string")
    got = row.select(
        values.rounded(F.col("x"), 1).cast("string"),
        *[F.to_json(values.decoded_or_raw(F.col(c))) for c in ("bad", "empty", "good")],
    ).first()
    assert list(got) == ["0.3", '{"raw":"not json"}', "{}", '{"a":1}']
    ev = spark.createDataFrame([("v", "odd", "high"), ("v", "low_fuel", "high"), (None, "low_fuel", "low"), ("v", None, "low")],
                               "vehicle_id string, event_type string, severity string")
    assert ev.where(valid_event()).count() == 1


def test_hopping_counts_each_row_once_per_window(spark):
    df = readings(spark, [("v", T0 + timedelta(seconds=30), 1.0), ("w", T0, None), ("w", T0 + timedelta(minutes=4), 3.0)])
    direct, paned = windows.vehicle_speed_avg(df, slide="1 minute"), windows.hopping_speed_avg(df)
    assert direct.where("vehicle_id = 'v'").count() == 5
    assert sorted(map(str, paned.collect())) == sorted(map(str, direct.collect()))
    with pytest.raises(ValueError):
        windows.hopping_speed_avg(df, slide=timedelta(minutes=2))


def test_conditions(spark):
    df = alerts(spark, [("a", "high", T0), ("b", "low", T0)])
    assert df.where(views.all_of()).count() == 2
    assert df.where(views.all_of(views.equals("vehicle_id", ""), views.severity_is("all"))).count() == 2
    assert df.where(views.all_of(views.equals("vehicle_id", "a"), views.severity_is("low"))).count() == 0


def test_parts_of_groups_do_not_grow_with_the_square(spark):
    """Left rows are repeated a bounded number of times, but a group with most of the rows has many parts."""
    left = spark.range(1).select(F.lit("a").alias("k"), F.lit(0).alias("_bin"))
    on = ["k", "_bin"]
    for n in (100, 1000):
        right = spark.range(n * 20).selectExpr("concat('g', id % 20) AS k", "0 AS _bin", "id")
        lefts, _ = joins._split_hot_groups(right.select(*on).distinct(), right, on, 2)
        assert lefts.count() == 20 * joins.SMALL_PARTS
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        right = spark.range(1000).selectExpr("'a' AS k", "0 AS _bin", "id")
        lefts, rights = joins._split_hot_groups(left, right, on, 2)
        assert lefts.count() == 40 and rights.select("_part").distinct().count() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(width))


def test_one_bucket_with_most_rows_is_split(spark):
    """A third of all readings in one (vehicle, bin): adaptive execution cuts the partition."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        n = 120_000
        tel = sensors(spark.range(0, n, 1, 8).selectExpr(
            "IF(id % 3 = 0, 'hot', concat('v', id % 997)) AS vehicle_id",
            "timestamp_micros(1704110400000000 + IF(id % 3 = 0, id % 1000, id * 1000)) AS recorded_at",
            "CAST(id AS DOUBLE) AS speed", "0D AS engine_temp", "0D AS latitude", "0D AS longitude",
        ))
        ev = alerts(spark, [("hot", "high", T0 + timedelta(seconds=1)), ("v5", "low", T0 + timedelta(seconds=60))])
        joined = joins.alerts_with_context(ev, tel)
        got = joined.groupBy("vehicle_id").count().collect()
        want = tel.where("vehicle_id = 'v5' AND recorded_at <= timestamp_micros(1704110460000000)").count()
        assert {r["vehicle_id"]: r["count"] for r in got} == {"hot": n // 3, "v5": want}
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_scores_at_large_offsets(spark):
    rows = [(f"v{i}", datetime(2024, 1, 1, 0, 1, i), 1e9 + 10 * i) for i in range(4)]
    df = spark.createDataFrame(rows, "vehicle_id string, recorded_at timestamp, speed double")
    got = {r.vehicle_id: round(r.z_score, 6) for r in windows.versus_fleet(df).collect()}
    assert got == {"v0": -1.341641, "v1": -0.447214, "v2": 0.447214, "v3": 1.341641}
    assert [r.z_score for r in windows.versus_fleet(df.limit(1)).collect()] == [None]


def test_runs_of_equal_times_have_one_answer(spark):
    at = [datetime(2024, 1, 1, 0, 0, s) for s in (1, 2, 2, 2, 3, 4)]
    hits = [True, True, False, True, True, True]
    answers = set()
    for order in ([0, 1, 2, 3, 4, 5], [5, 3, 2, 1, 0, 4], [2, 0, 3, 1, 5, 4]):
        rows = [("a", at[i], hits[i]) for i in order]
        df = spark.createDataFrame(rows, "vehicle_id string, recorded_at timestamp, hit boolean").repartition(3)
        runs = windows.consecutive_runs(df, F.col("hit"), 1).collect()
        answers.add(tuple(sorted(r.run_length for r in runs)))
    assert answers == {(1, 4)}


def test_durations_beyond_every_limit(spark):
    texts = ["1000000000000s", "999999999999d", "9" * 40 + "h", "9223372036854s", "9223372036855s", "2d", "00030min", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(timing.duration_column(F.col("t")).cast("interval second").cast("decimal(38,6)")).collect()]
    assert got[0] == 10**12 and got[1] is None and got[2] is None and got[7] is None
    assert (got[3], got[4], got[5], got[6]) == (9223372036854, None, 172800, 1800)


def test_a_limit_is_obeyed_in_order(spark):
    df = spark.range(40).selectExpr("concat('v', id) AS vehicle_id", "timestamp_seconds(id) AS window_end")
    assert [r.vehicle_id for r in topk.latest_windows(df, 3).collect()] == ["v39", "v38", "v37"]


def test_long_context_equals_the_unfolded_join(spark):
    events = spark.createDataFrame(
        [("a", "low_fuel", "high", "x", datetime(2024, 1, 1, 0, 2)), ("b", "low_fuel", "low", "y", datetime(2024, 1, 1))],
        "vehicle_id string, event_type string, severity string, description string, occurred_at timestamp",
    )
    readings = [("a", datetime(2024, 1, 1, 0, m, 0), float(m), None, 2.0, 3.0, 4.0) for m in range(4)]
    telemetry = spark.createDataFrame(
        readings, "vehicle_id string, recorded_at timestamp, speed double, fuel_level double, engine_temp double,"
        " tire_pressure double, battery_voltage double",
    )
    got = joins.alerts_with_long_context(events, telemetry)
    assert got.count() == 15
    assert {r.metric_value for r in got.where("metric_type = 'speed'").collect()} == {0.0, 1.0, 2.0}
    assert {(r.metric_value, r.unit is None) for r in got.where("metric_type = 'fuel_level'").collect()} == {(None, False)}


def _fleet(spark, minutes):
    """One reading and one alert of two vehicles at each of the given minutes before noon."""
    noon = datetime(2024, 1, 1, 12)
    readings, alerts = [], []
    for i, ago in enumerate(minutes):
        at = noon - timedelta(minutes=ago)
        for name in ("a", "b"):
            readings.append((name, at, float(i)))
            alerts.append((name, at, "high", f"t/{i}"))
    reading = "vehicle_id string, ts timestamp_ntz, speed double"
    alert = "vehicle_id string, ts timestamp_ntz, severity string, topic string"
    telemetry = spark.createDataFrame(readings, reading).withColumn("ts", F.col("ts").cast("timestamp"))
    events = spark.createDataFrame(alerts, alert).withColumn("ts", F.col("ts").cast("timestamp"))
    none = F.lit(None)
    telemetry = telemetry.withColumns({
        "topic": F.lit("t"), **{c: none.cast("double") for c in (*SENSORS, "latitude", "longitude") if c != "speed"},
    })
    events = events.withColumns({c: none.cast("string") for c in ("event_type", "description", "payload")})
    return ViewSet(telemetry, events, events.limit(0), noon)


@pytest.mark.parametrize("k", [1, 3, 6, 7, 40])
def test_newest_rows_are_found_backwards(spark, k):
    """The stretch that is read gives what everything gives, bounds, gaps and rows of the future included."""
    minutes = [-30, 0, 2, 59, 60, 61, 300, 478, 480, 483, 10_000, 900_000, 90_000_000]
    fleet = _fleet(spark, minutes)
    want = topk.latest_windows(fleet["vehicle_speed_5min_avg"], k).collect()
    assert topk.latest_windows(presets.newest_windows(fleet, k), k).collect() == want
    one = fleet["vehicle_speed_5min_avg"].where("vehicle_id = 'b'")
    assert topk.latest_windows(presets.newest_windows(fleet, k, "b"), k).collect() == topk.latest_windows(one, k).collect()
    want = topk.newest(fleet["alerts_with_context"], "alert_time", k).collect()
    assert topk.newest(presets.context_top(fleet, k), "alert_time", k).collect() == want


def test_newest_rows_bound_the_scan(spark, tmp_path):
    fleet = _fleet(spark, range(0, 600, 10))
    for name in ("fleet_telemetry_raw", "fleet_events_raw"):
        fleet[name].withColumnRenamed("recorded_at", "ts").withColumnRenamed("occurred_at", "ts").write.parquet(
            f"{tmp_path}/{name}"
        )
    telemetry, events = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("fleet_telemetry_raw", "fleet_events_raw"))
    stored = ViewSet(telemetry, events, events.limit(0), datetime(2024, 1, 1, 12))
    plan = presets.newest_windows(stored, 3)._jdf.queryExecution().toString()
    assert "GreaterThan(ts,2024-01-01" in plan


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_pairs_cost_no_calendar_arithmetic(spark, kind):
    """Ends of the span, nulls and times before 1970; what is done for a pair is on numbers (F2, F5)."""
    edge = [T0, T0 - timedelta(minutes=2), T0 - timedelta(minutes=2, microseconds=1), T0 + timedelta(microseconds=1), None]
    old = datetime(1969, 12, 31, 23, 59, 59, 999_999)
    tel = [("v", t, float(i), 0.0, 0.0, 0.0) for i, t in enumerate([*edge, old, old - timedelta(seconds=120)])]
    tel += [(None, T0, 9.0, 0.0, 0.0, 0.0)]
    ev = [("v", "high", t) for t in (T0, T0 + timedelta(microseconds=1), None, old)] + [(None, "high", T0)]
    readings = sensors(spark.createDataFrame(tel, READING)).withColumn("recorded_at", F.col("recorded_at").cast(kind))
    events = alerts(spark, ev).withColumn("occurred_at", F.col("occurred_at").cast(kind))
    want = sorted(
        (s, t - r) for v, _, t in ev for w, r, s, *_ in tel
        if v and v == w and t and r and t - timedelta(minutes=2) <= r <= t
    )
    got = joins.alerts_with_context(events, readings)
    assert sorted((r["speed"], r["time_before_alert"]) for r in got.collect()) == want
    long = joins.alerts_with_long_context(events, readings)
    assert sorted(r["time_before_alert"] for r in long.collect()) == sorted(d for _, d in want for _ in range(5))
    for df in (got, long):
        above = df._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")
        assert "INTERVAL '-0 00:02:00'" not in above[1].split("\n")[0] and " - metric_time" not in above[0]


def test_intervals_as_microseconds(spark):
    spans = [0, 1, -1, 999_999, 1_000_000, -1_000_001, 120_000_000, 2**62, -(2**62), None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(spans)], "i int, n long")
    out = comparable(df.select("i", (F.lit(timedelta(microseconds=1)) * F.col("n")).alias("x")))
    assert out.schema["x"].dataType.typeName() == "long"
    assert [r["x"] for r in out.orderBy("i").collect()] == spans


@pytest.mark.parametrize("reach, bins, block_rows", [(7, 2, 3), (7, 1, 1), (7, 3, 512), (0, 2, 4), (1, 2, 2)])
def test_folded_join_holds_the_pairs(spark, reach, bins, block_rows):
    """Equal rows and times, ends of spans, missing keys and times, in blocks that groups do not fit into."""
    rng = random.Random(reach * 100 + bins)
    at = lambda: rng.choice([None, *[datetime(1969, 12, 31, 23, 59, 59) + timedelta(seconds=1, microseconds=i - 12) for i in range(24)]])
    some = lambda n: [(rng.choice(["a", "b", None]), at(), rng.randint(0, 2)) for _ in range(n)]
    left = spark.createDataFrame(some(60), "k string, lt timestamp, l int")
    right = spark.createDataFrame(some(90), "k string, rt timestamp, r int")
    sides = (left, right, "k", "lt", "rt", timedelta(microseconds=reach), bins)
    folded = joins.folded_interval_join(*sides, block_rows)
    sizes = folded.agg(F.max(F.size(joins.LEFTS)), F.max(F.size(joins.RIGHTS))).first()
    assert max(sizes) <= block_rows
    want = joins.interval_join(*sides, apart="d")
    got = joins.unfolded(folded, apart="d")
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(got.select(*want.columns).collect()) == Counter(want.collect())
    assert want.count() > 0


def test_one_group_is_unfolded_in_many_tasks(spark):
    """All rows of one key in one bin, stored in one file."""
    n = 3000
    sides = [spark.range(n).selectExpr("'hot' AS k", f"timestamp_micros(1704110400000000 + id) AS {t}", f"id AS {v}")
             for t, v in (("lt", "l"), ("rt", "r"))]
    got = joins.unfolded(joins.folded_interval_join(*sides, "k", "lt", "rt").coalesce(1))
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == n * (n + 1) // 2
    assert max(tasks) < 0.6 * sum(tasks)
