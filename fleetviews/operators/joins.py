"""Interval and semi joins."""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timing import interval
from ..schemas import SENSOR_UNITS, SENSORS
from .covers import boxes_around
from .skew import PARTS, ROWS, oversized, with_parts

TWO_MINUTES = timedelta(minutes=2)


# Microseconds of the two times, for as long as a join's rows are between its two sides and its result.
END, AT = "_end", "_at"
# Columns of a folded join, and how many rows of a side one of its rows holds at most.
LEFTS, RIGHTS, FIRST, COUNT = "_lefts", "_rights", "_first", "_count"
BLOCK = 512


def _bin(time: Column, width_micros: int) -> Column:
    return _bin_of(F.unix_micros(time), width_micros)


def _bin_of(micros: Column, width_micros: int) -> Column:
    return F.floor(micros / F.lit(width_micros))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    span: timedelta = TWO_MINUTES,
    bins_per_span: int = 2,
    max_group_rows: int | None = None,
    apart: str | None = None,
) -> DataFrame:
    """Inner join on ``key`` with ``right_time`` in ``[left_time - span, left_time]``.

    ``apart`` names a column for the interval from ``right_time`` to ``left_time``.

    A join on the key alone would compare every pair of a vehicle's rows, and put a
    busy vehicle into one task. Time is cut into bins of a fraction of the span and the
    bin joins the key, so the join is an equi-join on (key, bin). The left side, the
    rarer one, is repeated for the bins its interval touches; each right row stays in
    its one bin, so no pair appears twice. Finer bins waste fewer comparisons and spread a
    busy vehicle wider, but repeat the left side more often.

    ``max_group_rows`` also splits single (key, bin) groups that hold more right rows
    than that: the right rows of such a group are dealt into as many parts as needed, or as
    many as the cluster can use (:func:`_most_parts`), and the left rows are repeated for each.
    Groups that stay below pass unchanged. It is meant for batches and costs counting passes.
    Column names other than ``key`` must differ between the two sides.

    Pairs can be far more than rows, and arithmetic on timestamps goes by the calendar. So a batch turns times
    into microseconds once a row, and does no more than compare and subtract those for a pair. A stream
    compares the times themselves: from that it learns which rows to forget.
    """
    lefts, rights, reach = _binned(left, right, left_time, right_time, span, bins_per_span)
    on = [key, "_bin"]
    if max_group_rows:
        lefts, rights = _split_hot_groups(lefts, rights, on, max_group_rows)
        on = [*on, "_part"]
    if left.isStreaming or right.isStreaming:
        in_span = F.col(right_time).between(F.col(left_time) - interval(span), F.col(left_time))
        distance = F.col(left_time) - F.col(right_time)
    else:
        in_span = F.col(AT).between(F.col(END) - reach, F.col(END))
        distance = F.lit(timedelta(microseconds=1)) * (F.col(END) - F.col(AT))
    joined = lefts.join(rights, on).where(in_span)
    return (joined.withColumn(apart, distance) if apart else joined).drop("_bin", "_part", END, AT)


def _width(reach: int, bins_per_span: int) -> int:
    return max(1, math.ceil(reach / bins_per_span))


def _binned(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, span: timedelta, bins_per_span: int
) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with their times in microseconds and their bins, and the span in microseconds."""
    reach = round(span.total_seconds() * 1_000_000)
    width = _width(reach, bins_per_span)
    lefts = left.where(F.col(left_time).isNotNull()).withColumn(END, F.unix_micros(F.col(left_time).cast("timestamp")))
    rights = right.where(F.col(right_time).isNotNull()).withColumn(AT, F.unix_micros(F.col(right_time).cast("timestamp")))
    left_bins = F.sequence(_bin_of(F.col(END) - reach, width), _bin_of(F.col(END), width))
    lefts = lefts.withColumn("_bin", F.explode(left_bins))
    return lefts, rights.withColumn("_bin", _bin_of(F.col(AT), width)), reach


def folded_interval_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    span: timedelta = TWO_MINUTES,
    bins_per_span: int = 2,
    block_rows: int = BLOCK,
) -> DataFrame:
    """The pairs of :func:`interval_join`, each side's rows held once a bin instead of once a pair.

    A row holds up to ``block_rows`` left rows and as many right rows of one key and bin. Right rows are in
    order of time, so those that pair with a left row follow each other: it carries the first's place and their
    number. A table of such rows grows with the input, where pairs grow with the square of a group; only of
    groups larger than a block is one side repeated for each block of the other. Every pair is found
    here: :func:`unfolded` spreads them out, and compares nothing. For batches only.

    No two rows are compared either. A bin is never wider than the span, so a span that ends in it began before it
    and meets its first right rows, and any other meets its last ones: one place among them tells which.
    """
    lefts, rights, reach = _binned(left, right, left_time, right_time, span, bins_per_span)
    on = [key, "_bin"]
    ends_here = F.col("_bin") == _bin_of(F.col(END), _width(reach, bins_per_span))
    # At equal times a beginning comes before the right rows, and an end after them.
    probes = lefts.select(
        *on, F.when(ends_here, F.col(END)).otherwise(F.col(END) - reach).alias("_time"),
        F.when(ends_here, 2).otherwise(0).alias("_side"), F.struct(*[c for c in lefts.columns if c not in on]).alias("row"),
    )
    row = probes.schema["row"].dataType
    marks = rights.select(*on, F.col(AT).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(row).alias("row"))
    so_far = Window.partitionBy(*on).orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = probes.unionByName(marks).select(
        *on, "_side", "row", F.count_if(F.col("_side") == 1).over(so_far).alias("_passed"),
        F.count_if(F.col("_side") != 1).over(so_far).alias("_place"),
    ).where(F.col("_side") != 1)
    left_blocks = placed.groupBy(*on, _block("_place", block_rows).alias("_left_block")).agg(F.collect_list(F.struct(
        "row", F.when(F.col("_side") == 0, F.col("_passed")).otherwise(0).alias("passed"),
        F.when(F.col("_side") == 2, F.col("_passed")).alias("reached"),
    )).alias(LEFTS))
    # The time comes first in a row, so that the array is in its order.
    in_time = F.struct(AT, *[c for c in rights.columns if c not in (*on, AT)])
    numbered = rights.withColumn("_place", F.row_number().over(Window.partitionBy(*on).orderBy(AT)))
    right_blocks = numbered.groupBy(*on, _block("_place", block_rows).alias("_right_block")).agg(
        F.sort_array(F.collect_list(in_time)).alias(RIGHTS))

    skipped = F.col("_right_block") * block_rows

    def within(one: Column) -> Column:
        begin = F.greatest(one["passed"] - skipped, F.lit(0))
        end = F.least(one["reached"] - skipped, F.size(RIGHTS))
        return F.struct(
            one["row"].alias("row"), (begin + 1).cast("int").alias(FIRST), (end - begin).cast("int").alias(COUNT)
        )

    paired = F.filter(F.transform(LEFTS, within), lambda one: one[COUNT] > 0)
    met = left_blocks.join(right_blocks, on).select(key, paired.alias(LEFTS), RIGHTS)
    return met.where(F.size(LEFTS) > 0)


def _block(place: str, rows: int) -> Column:
    return F.floor((F.col(place) - 1) / rows)


def unfolded(folded: DataFrame, apart: str | None = None) -> DataFrame:
    """The pairs of a folded join, a row each.

    Folded rows are few bytes for the pairs that they hold, and would be read in few and unequal tasks. They are
    dealt anew first, so that a busy group, which is many blocks, is spread out by all tasks.
    """
    rest = [c for c in folded.columns if c not in (LEFTS, RIGHTS)]
    dealt = folded.repartition(int(folded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lefts = dealt.select(*rest, RIGHTS, F.explode(LEFTS).alias("_left"))
    its_rights = F.slice(RIGHTS, F.col(f"_left.{FIRST}"), F.col(f"_left.{COUNT}"))
    joined = lefts.select(*rest, "_left.row.*", F.inline(its_rights))
    distance = F.lit(timedelta(microseconds=1)) * (F.col(END) - F.col(AT))
    return (joined.withColumn(apart, distance) if apart else joined).drop(END, AT)


def _split_hot_groups(
    lefts: DataFrame, rights: DataFrame, on: list[str], max_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Adds ``_part`` to both sides: right rows are dealt, left rows repeated.

    Rows are dealt by a hash of their values, so a task that runs again deals alike;
    exact copies stay together and are left to adaptive skew handling.
    """
    groups = oversized(rights, on, max_rows, _most_parts(rights))
    dealt = F.pmod(F.xxhash64(*rights.columns), F.col(PARTS)).cast("int")
    repeated = F.explode(F.sequence(F.lit(0), F.col(PARTS) - 1))
    return (
        with_parts(lefts, groups, on).withColumn("_part", repeated).drop(PARTS),
        with_parts(rights, groups, on).withColumn("_part", dealt).drop(PARTS),
    )


# Parts that any oversized group may have; more are for groups of more than so many tasks' shares.
SMALL_PARTS = 8


def _most_parts(rows: DataFrame) -> Column:
    """Parts of a group that the work can use: ``SMALL_PARTS``, or as many fair shares as it holds.

    Left rows are repeated for each part, so parts that grow with a group would make repeats that grow with
    the square of the input. A fair share is what one of the shuffle's partitions gets of all rows.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return F.greatest(F.lit(SMALL_PARTS), F.ceil(F.col(ROWS) * width / total).cast("int"))


def _alert_side(events: DataFrame) -> DataFrame:
    return events.select(
        "vehicle_id", "event_type", "severity", "description", F.col("occurred_at").alias("alert_time")
    )


def _reading_side(telemetry: DataFrame) -> DataFrame:
    return telemetry.select("vehicle_id", *SENSORS, F.col("recorded_at").alias("metric_time"))


def _before_alerts(alerts: DataFrame, rows: DataFrame, span: timedelta, **tuning) -> DataFrame:
    return interval_join(
        alerts, rows, "vehicle_id", "alert_time", "metric_time", span, apart="time_before_alert", **tuning
    )


def _context_columns(joined: DataFrame) -> DataFrame:
    return joined.select(
        "vehicle_id", "event_type", "severity", "description", "alert_time",
        *SENSORS, "metric_time", "time_before_alert",
    )


def alerts_with_context(
    events: DataFrame,
    telemetry: DataFrame,
    span: timedelta = TWO_MINUTES,
    since: Column | None = None,
    **tuning,
) -> DataFrame:
    """Each alert with every reading of its vehicle in the span before it, ends included.

    ``since`` is a strict lower bound on the alert time. It implies one on the reading
    time, which the optimizer cannot derive, so both sides are pruned here.
    """
    alerts, readings = _alert_side(events), _reading_side(telemetry)
    if since is not None:
        alerts = alerts.where(F.col("alert_time") > since)
        readings = readings.where(F.col("metric_time") > since - interval(span))
    return _context_columns(_before_alerts(alerts, readings, span, **tuning))


def folded_alerts_with_context(events: DataFrame, telemetry: DataFrame, span: timedelta = TWO_MINUTES) -> DataFrame:
    """The rows of :func:`alerts_with_context`, folded for a table that does not grow with the pairs."""
    return folded_interval_join(
        _alert_side(events), _reading_side(telemetry), "vehicle_id", "alert_time", "metric_time", span
    )


def unfolded_context(rows: DataFrame) -> DataFrame:
    """Rows of :func:`folded_alerts_with_context` as alerts beside readings; rows that are not folded stay."""
    if LEFTS not in rows.columns:
        return rows
    return _context_columns(unfolded(rows, apart="time_before_alert"))


def alerts_that_have_context(
    events: DataFrame, telemetry: DataFrame, span: timedelta = TWO_MINUTES
) -> DataFrame:
    """Alerts with at least one reading in the span before them, without forming pairs.

    With bins as wide as the span, an alert in bin b has a reading in reach exactly when
    the earliest reading of b is not after it, or the latest reading of b - 1 is not
    before the span's start. Two numbers per (vehicle, bin) decide, and those are a
    small aggregate of the readings.
    """
    width = math.ceil(span.total_seconds() * 1_000_000)
    bounds = (
        telemetry.where(F.col("recorded_at").isNotNull())
        .groupBy("vehicle_id", _bin(F.col("recorded_at"), width).alias("_bin"))
        .agg(F.min("recorded_at").alias("_earliest"), F.max("recorded_at").alias("_latest"))
    )
    unknown = F.lit(None).cast("timestamp")
    seen_from = F.array(
        F.struct(F.col("_bin"), F.col("_earliest"), unknown.alias("_previous")),
        F.struct((F.col("_bin") + 1).alias("_bin"), unknown.alias("_earliest"), F.col("_latest").alias("_previous")),
    )
    reach = (
        bounds.select("vehicle_id", F.inline(seen_from))
        .groupBy("vehicle_id", "_bin")
        .agg(F.min("_earliest").alias("_earliest"), F.min("_previous").alias("_previous"))
    )
    alerts = events.withColumn("_bin", _bin(F.col("occurred_at"), width))
    touched = (F.col("_earliest") <= F.col("occurred_at")) | (
        F.col("_previous") >= F.col("occurred_at") - interval(span)
    )
    return alerts.join(reach, ["vehicle_id", "_bin"]).where(touched).select(*events.columns)


def kth_newest_with_context(
    events: DataFrame, telemetry: DataFrame, k: int, span: timedelta = TWO_MINUTES
) -> Column:
    """Time of the k-th newest alert that has context (the oldest one, of fewer), as a scalar."""
    times = alerts_that_have_context(events, telemetry, span).select("occurred_at")
    return times.orderBy(F.col("occurred_at").desc()).limit(k).agg(F.min("occurred_at")).scalar()


def newest_alerts_with_context(
    events: DataFrame, telemetry: DataFrame, k: int, span: timedelta = TWO_MINUTES, **tuning
) -> DataFrame:
    """All context rows that can be among the k newest: a top-k pushed below the join.

    Every alert with context yields at least one row, so no row older than the k-th
    newest such alert can be in the answer. Its time bounds both sides of the join;
    the caller still orders and limits. Joining everything to keep k rows would form
    all pairs first.
    """
    kth = kth_newest_with_context(events, telemetry, k, span)
    return alerts_with_context(
        events.where(F.col("occurred_at") >= kth),
        telemetry.where(F.col("recorded_at") >= kth - interval(span)),
        span, **tuning,
    )


def unified_alerts_with_context(
    unified: DataFrame, span: timedelta = TWO_MINUTES, **tuning
) -> DataFrame:
    """Self-join of the unified stream: one row per alert and preceding metric row."""
    alerts = unified.where(F.col("severity").isNotNull()).select(
        "vehicle_id", "event_type", "severity", "description", F.col("ts").alias("alert_time")
    )
    metrics = unified.where(F.col("metric_type").isNotNull()).select(
        "vehicle_id", "metric_type", F.col("value").alias("metric_value"), "unit",
        F.col("ts").alias("metric_time"),
    )
    return _before_alerts(alerts, metrics, span, **tuning).select(
        "vehicle_id", "event_type", "severity", "description", "alert_time",
        "metric_type", "metric_value", "unit", "metric_time", "time_before_alert",
    )


def alerts_with_long_context(
    events: DataFrame, telemetry: DataFrame, span: timedelta = TWO_MINUTES,
    units: dict[str, str] = SENSOR_UNITS, **tuning,
) -> DataFrame:
    """The same rows from the two streams: one per alert, preceding reading and metric.

    A reading travels to the join once, and is unfolded into its metrics afterwards.
    """
    joined = _before_alerts(_alert_side(events), _reading_side(telemetry), span, **tuning)
    metrics = F.array(*[
        F.struct(F.lit(m).alias("metric_type"), F.col(m).alias("metric_value"), F.lit(units.get(m)).alias("unit"))
        for m in SENSORS
    ])
    return joined.select(
        "vehicle_id", "event_type", "severity", "description", "alert_time", F.inline(metrics), "metric_time",
        "time_before_alert",
    )


def events_of_vehicles_in(events: DataFrame, region_view: DataFrame) -> DataFrame:
    """Events whose vehicle occurs in a region view.

    The view is reduced to its distinct vehicles first. Which way the semi join runs is
    decided at run time from that list's measured size; a busy vehicle's partition is
    split by adaptive skew handling.
    """
    vehicles = region_view.select("vehicle_id").distinct()
    return events.join(vehicles, "vehicle_id", "left_semi")


# Beyond this many degrees all coordinates fall into the outermost cells.
EDGE = 720.0
FINEST = 0.001
REACH = 4


def _placed(degrees: str, level: Column, cell: float) -> Column:
    """Number of the cell of a level that a coordinate is in. It never falls as the coordinate rises."""
    within = F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.col(degrees)))
    return F.floor(within / (F.lit(cell) * F.pow(F.lit(4.0), level)))


def region_cells(regions: DataFrame, cell: float = FINEST) -> DataFrame:
    """Regions under the cells that their boxes touch: at most ``(REACH + 2) ** 2`` rows each.

    Cells of level ``n`` are ``cell * 4 ** n`` degrees wide. A box is listed on the finest level on which
    ``REACH`` cells are as long as it, so a depot lies in cells of its own size and a continent in few.
    A box with a null, or with a minimum above its maximum, has no cell.
    """
    box = [c for side in ("lat", "lon") for c in (f"min_{side}", f"max_{side}")]
    extent = F.greatest(*[
        F.least(F.lit(EDGE), F.col(f"max_{s}")) - F.greatest(F.lit(-EDGE), F.col(f"min_{s}")) for s in ("lat", "lon")
    ])
    level = F.greatest(F.lit(0), F.ceil(F.log(4.0, extent / F.lit(REACH * cell)))).cast("int")
    listed = regions.where("min_lat <= max_lat AND min_lon <= max_lon").select("region", *box, level.alias("_level"))
    for axis, side in (("_row", "lat"), ("_column", "lon")):
        ends = [_placed(f"{end}_{side}", F.col("_level"), cell) for end in ("min", "max")]
        listed = listed.withColumn(axis, F.explode(F.sequence(*ends)))
    return listed


def in_regions(
    positions: DataFrame, regions: DataFrame, cell: float = FINEST, counted: str | None = None
) -> DataFrame:
    """Every position beside each region of a table that it lies in.

    ``regions`` has ``region`` and an inclusive box: ``min_lat``, ``max_lat``, ``min_lon``,
    ``max_lon``. Regions are listed under cells as large as they are (:func:`region_cells`). A position is
    in one cell of each level that a region uses, and the two meet on level and cell, so it meets only
    regions that are near for their size. A position without coordinates, or in no region, gives no row.
    ``cell`` is the width of the finest cells in degrees; regions much smaller share those.

    With ``counted``, a position in any region gives one row, beside the number of its regions under that name.
    Such pairs are counted and not formed (:func:`boxes_around`): they grow with the square of the tables.
    """
    if counted:
        around = boxes_around(positions, regions)
        same_place = (F.col("latitude").cast("double") == around["lat"]) & (F.col("longitude").cast("double") == around["lon"])
        return positions.join(around, same_place).select(*[positions[c] for c in positions.columns], around["n"].alias(counted))
    listed = region_cells(regions, cell)
    # A handful of numbers, found when the query runs.
    levels = listed.select(F.array_sort(F.collect_set("_level"))).scalar()
    located = positions.where("latitude IS NOT NULL AND longitude IS NOT NULL").withColumn("_levels", levels)
    placed = located.withColumn("_level", F.explode("_levels")).withColumns({
        "_row": _placed("latitude", F.col("_level"), cell), "_column": _placed("longitude", F.col("_level"), cell),
    })
    inside = F.expr("latitude BETWEEN min_lat AND max_lat AND longitude BETWEEN min_lon AND max_lon")
    met = placed.join(listed, ["_level", "_row", "_column"]).where(inside)
    return met.select(*[placed[c] for c in positions.columns], "region")
