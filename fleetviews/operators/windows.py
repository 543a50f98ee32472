"""Windowed and per-vehicle time-series operators.

A vehicle can hold a large share of all rows, so nothing here sorts or folds a whole
vehicle in one task: windows are aggregates with map-side combine, "latest" is an
aggregate, and run detection works chunk by chunk.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from .skew import PARTS, oversized, with_parts

FIVE_MINUTES = "5 minutes"


def tumbled(df: DataFrame, time_column: str, width: str = FIVE_MINUTES) -> DataFrame:
    """Adds ``window_start`` and ``window_end`` (epoch-aligned, end exclusive) to each row."""
    span = F.window(time_column, width)
    return (
        df.withColumn("_window", span)
        .withColumn("window_start", F.col("_window.start"))
        .withColumn("window_end", F.col("_window.end"))
        .drop("_window")
    )


def _speed_stats(value: str) -> list[Column]:
    return [
        F.avg(value).alias("avg_speed_mph"),
        F.max(value).alias("max_speed_mph"),
        F.min(value).alias("min_speed_mph"),
        F.count(F.lit(1)).alias("sample_count"),
    ]


def vehicle_speed_avg(
    telemetry: DataFrame,
    width: str = FIVE_MINUTES,
    slide: str | None = None,
    time_column: str = "recorded_at",
) -> DataFrame:
    """Speed statistics per vehicle and window; hopping when ``slide`` is given.

    Also valid on a stream with a watermark, in update or complete mode for results
    that are visible before the window closes.
    """
    span = F.window(time_column, width, slide) if slide else F.window(time_column, width)
    return (
        telemetry.groupBy("vehicle_id", span.alias("_window"))
        .agg(*_speed_stats("speed"))
        .select(
            "vehicle_id",
            F.col("_window.start").alias("window_start"),
            F.col("_window.end").alias("window_end"),
            "avg_speed_mph", "max_speed_mph", "min_speed_mph", "sample_count",
        )
    )


def hopping_speed_avg(
    telemetry: DataFrame,
    width: timedelta = timedelta(minutes=5),
    slide: timedelta = timedelta(minutes=1),
    time_column: str = "recorded_at",
) -> DataFrame:
    """Hopping windows of a batch, built from panes.

    A hopping window over rows copies every row into each window it falls in. Here rows
    are folded once, to panes as long as the slide, and only the panes are copied. The
    slide must divide the width. Streams use :func:`vehicle_speed_avg` with ``slide``.
    """
    if width % slide:
        raise ValueError("the slide must divide the width")
    length, step = (f"{span // timedelta(microseconds=1)} microseconds" for span in (width, slide))
    panes = (
        telemetry.groupBy("vehicle_id", F.window(time_column, step).alias("_pane"))
        .agg(
            F.sum("speed").alias("_sum"), F.count("speed").alias("_n"), F.max("speed").alias("_max"),
            F.min("speed").alias("_min"), F.count(F.lit(1)).alias("_rows"),
        )
        .withColumn("_start", F.col("_pane.start"))
    )
    return (
        panes.groupBy("vehicle_id", F.window("_start", length, step).alias("_window"))
        .agg(
            F.try_divide(F.sum("_sum"), F.sum("_n")).alias("avg_speed_mph"),
            F.max("_max").alias("max_speed_mph"),
            F.min("_min").alias("min_speed_mph"),
            F.sum("_rows").alias("sample_count"),
        )
        .select(
            "vehicle_id",
            F.col("_window.start").alias("window_start"),
            F.col("_window.end").alias("window_end"),
            "avg_speed_mph", "max_speed_mph", "min_speed_mph", "sample_count",
        )
    )


def unified_speed_avg(unified: DataFrame, width: str = FIVE_MINUTES) -> DataFrame:
    """Tumbling average, maximum and count of the speed metric of the long stream."""
    return (
        unified.where(F.col("metric_type") == "speed")
        .groupBy("vehicle_id", F.window("ts", width).alias("_window"))
        .agg(
            F.avg("value").alias("avg_speed"),
            F.max("value").alias("max_speed"),
            F.count(F.lit(1)).alias("sample_count"),
        )
        .select(
            "vehicle_id",
            F.col("_window.start").alias("window_start"),
            F.col("_window.end").alias("window_end"),
            "avg_speed", "max_speed", "sample_count",
        )
    )


def latest_per_key(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None
) -> DataFrame:
    """The newest row of each key by ``order`` (all descending, compared left to right).

    An aggregate of one struct, so each map task sends one row per key however many
    rows the key has.
    """
    kept = [c for c in (columns or df.columns) if c not in keys]
    rest = [c for c in kept if c not in order]
    newest = F.max(F.struct(*order, *rest)).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in kept])


def last_known_position(telemetry: DataFrame) -> DataFrame:
    """Latest position of each vehicle."""
    named = telemetry.withColumnRenamed("speed", "speed_mph")
    return latest_per_key(
        named, ["vehicle_id"], ["recorded_at"],
        ["vehicle_id", "latitude", "longitude", "speed_mph", "recorded_at"],
    )


def consecutive_runs(
    df: DataFrame,
    condition: Column,
    at_least: int,
    key: str = "vehicle_id",
    time_column: str = "recorded_at",
    tie_breaker: str | None = None,
    chunk: timedelta = timedelta(minutes=10),
    max_chunk_rows: int | None = None,
) -> DataFrame:
    """Maximal runs of consecutive readings of a key that satisfy ``condition``.

    A run is numbered by how many breaks precede it. That running count is built in
    two levels: inside a (key, time chunk) window, and over the per-chunk totals, of
    which there are as many as chunks, not rows. Runs may cross any number of chunks.
    Of readings with equal times, those that fail the condition come first, unless
    ``tie_breaker`` orders them.
    ``max_chunk_rows`` cuts (key, chunk) groups that hold more rows into shorter chunks;
    it is meant for batches and costs one counting pass.
    """
    micros = int(chunk.total_seconds() * 1_000_000)
    order = [F.col(time_column).asc(), F.col(tie_breaker or "_hit").asc()]
    inside = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rows = df.where(F.col(time_column).isNotNull()).select(
        key, time_column, *([tie_breaker] if tie_breaker else []),
        F.coalesce(condition, F.lit(False)).alias("_hit"),
        F.floor(F.unix_micros(time_column) / F.lit(micros)).alias("_chunk"),
    )
    if max_chunk_rows:
        group = [key, "_chunk"]
        into = F.unix_micros(time_column) - F.col("_chunk") * micros
        rows = with_parts(rows, oversized(rows, group, max_chunk_rows), group).withColumn(
            "_chunk", F.struct("_chunk", F.floor(into * F.col(PARTS) / F.lit(micros)).alias("_shorter"))
        ).drop(PARTS)
    pieces = (
        rows.withColumn("_breaks", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(inside))
        .where("_hit")
        .groupBy(key, "_chunk", "_breaks")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(time_column).alias("_first"),
            F.max(time_column).alias("_last"),
        )
    )
    # The totals come from the rows, not the pieces: counted before they travel, they
    # cost a scan of three columns instead of a second sort of everything.
    totals = rows.groupBy(key, "_chunk").agg(F.count_if(~F.col("_hit")).alias("_total"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        key, "_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )
    return (
        pieces.join(offsets, [key, "_chunk"])
        .groupBy(key, (F.col("_offset") + F.col("_breaks")).alias("_run"))
        .agg(
            F.sum("_n").alias("run_length"),
            F.min("_first").alias("run_start"),
            F.max("_last").alias("run_end"),
        )
        .where(F.col("run_length") >= at_least)
        .drop("_run")
    )


def versus_fleet(
    telemetry: DataFrame,
    value: str = "speed",
    width: str = FIVE_MINUTES,
    time_column: str = "recorded_at",
) -> DataFrame:
    """Each vehicle's window average next to the fleet's, with difference and z-score.

    Both are aggregates that combine on the map side, and the deviation merges counts,
    means and squared distances, so large values lose nothing. The fleet's windows, one
    row each, are joined back. Without any deviation there is no score.
    """
    rows = telemetry.select(
        "vehicle_id", F.col(value).alias("_x"), F.window(time_column, width)["start"].alias("window_start")
    )
    per_vehicle = rows.groupBy("vehicle_id", "window_start").agg(F.avg("_x").alias("vehicle_avg"))
    fleet = rows.groupBy("window_start").agg(
        F.avg("_x").alias("fleet_avg"), F.stddev_pop("_x").alias("_deviation")
    )
    return (
        per_vehicle.join(fleet, "window_start")
        .withColumn("difference", F.col("vehicle_avg") - F.col("fleet_avg"))
        .withColumn("z_score", F.when(F.col("_deviation") > 0, F.col("difference") / F.col("_deviation")))
        .select("vehicle_id", "window_start", "vehicle_avg", "fleet_avg", "difference", "z_score")
    )
