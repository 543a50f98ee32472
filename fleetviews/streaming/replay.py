"""History first, then live.

A fixed cut replaces the race between a replay and a live buffer: history is a batch up
to the cut, live is a stream after it. Duplicates can then only come from sources that
repeat rows around the cut, which the de-duplication policies remove.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timing import interval, moment, parse_duration
from ..functions.topics import rebuilt_topic
from ..functions.values import event_json, event_line, message_json, message_line
from ..operators.joins import TWO_MINUTES, folded_alerts_with_context, unfolded_context
from ..operators.sets import known_keys, same_key, tagged
from ..operators.topk import oldest_first
from ..sources.sinks import append_stream, stored
from .live import DELAY, live_alerts_with_context, watermarked


def history_slice(
    view: DataFrame, time_column: str, since: timedelta | str | None = None, cut=None, as_of=None,
    limit: int | None = None, cut_column: str | None = None,
) -> DataFrame:
    """Oldest-first rows after ``now - since`` and up to the cut.

    The cut is on the event time, or on ``cut_column``. Where rows can arrive late, cut
    on an arrival time: a late row is then live, and not lost between the two parts.
    """
    rows = view
    if since is not None:
        rows = rows.where(F.col(time_column) > moment(as_of) - interval(parse_duration(since)))
    if cut is not None:
        rows = rows.where(F.col(cut_column or time_column) <= moment(cut))
    return oldest_first(rows, time_column, limit)


def live_slice(stream: DataFrame, time_column: str, cut) -> DataFrame:
    """Rows after the cut; cut both parts on the same column."""
    return stream.where(F.col(time_column) > moment(cut))


def rendered(
    view: DataFrame, source: str, pattern: str, time_column: str, form: str = "json", content: Column | None = None,
) -> DataFrame:
    """Rows as emitted events; a view without a topic gets one rebuilt from the pattern.

    ``content`` is carried along under that name.
    """
    topic = rebuilt_topic(pattern, view.columns)
    render = event_json if form == "json" else event_line
    return view.select(
        F.lit(source).alias("source"),
        topic.alias("topic"),
        F.col(time_column).alias("event_time"),
        render(view, source, topic, F.col(time_column)).alias("event"),
        *([content.alias("content")] if content is not None else []),
    )


def rendered_messages(
    frame: DataFrame, source: str = "live", form: str = "json", content: Column | None = None
) -> DataFrame:
    """Messages as emitted events, with whatever their body holds as payload."""
    topic, time = F.col("topic"), F.col("ts")
    if form == "json":
        event = message_json(source, topic, time, F.col("value"))
    else:
        event = message_line(source, topic, time, F.col("value"))
    return frame.select(
        F.lit(source).alias("source"), "topic", time.alias("event_time"), event.alias("event"),
        *([content.alias("content")] if content is not None else []),
    )


def start_replay(
    spark: SparkSession, history: DataFrame, live: DataFrame, path: str, checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Start the live part, and write the history part while it runs.

    Both land in one table, told apart by ``source``. Returns when history is complete.
    Writing history again after a failure replaces it.
    """
    query = append_stream(live, f"{path}/source=live", checkpoint, available_now)
    try:
        history.write.mode("overwrite").parquet(f"{path}/source=history")
    except Exception:
        query.stop()
        raise
    return query


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    """History and live rows with their ``source``; there may be no live rows yet."""
    history = unfolded_context(spark.read.parquet(f"{path}/source=history"))
    live = stored(spark, f"{path}/source=live", history.schema).select(*history.columns)
    return tagged(history, "history").unionByName(tagged(live, "live"))


def once_per_key(
    live: DataFrame, keys: list[str], time_column: str, delay: str = DELAY, spread: bool = False
) -> DataFrame:
    """Streaming de-duplication with state bounded by the watermark.

    Copies of one key meet in one task. Where a key may have very many, ``spread`` first
    folds them per input partition, in as many tasks, at the price of a second state.
    """
    rows = watermarked(live, time_column, delay)
    if spread:
        marked = rows.withColumn("_partition", F.spark_partition_id())
        rows = marked.dropDuplicatesWithinWatermark([*keys, "_partition"]).drop("_partition")
    return rows.dropDuplicatesWithinWatermark(keys)


def start_overlapping_replay(
    spark: SparkSession, history: DataFrame, live: DataFrame, keys: list[str], time_column: str,
    overlap_from, path: str, checkpoint: str, delay: str = DELAY, available_now: bool = False,
) -> StreamingQuery:
    """History and a live stream that repeats rows: each key is kept once, history first.

    Only history after ``overlap_from``, where the live stream begins, can be repeated.
    The keys of that stretch are written once, so that the stream does not scan history
    again with every batch.
    """
    in_overlap = history.where(F.col(time_column) > moment(overlap_from))
    known_keys(in_overlap, tuple(keys)).write.mode("overwrite").parquet(f"{checkpoint}-keys")
    known = spark.read.parquet(f"{checkpoint}-keys")
    fresh = once_per_key(live, keys, time_column, delay).join(known, same_key(tuple(keys)), "left_anti")
    return start_replay(spark, history, fresh, path, checkpoint, available_now)


def context_then_live(
    spark: SparkSession, history: tuple[DataFrame, DataFrame], live: tuple[DataFrame, DataFrame],
    cut, path: str, checkpoint: str, span: timedelta = TWO_MINUTES, delay: str = DELAY,
    available_now: bool = False,
) -> StreamingQuery:
    """Alert context with the past joined in batch and only the present held as state.

    Alerts up to the cut are joined as a batch. Later alerts are joined as streams,
    together with readings from one span before the cut on, since an early live alert
    reaches back over it. State size depends on the watermark, not on history. The cut
    must be old enough for everything before it to have arrived. The past is stored folded,
    as pairs of alert and reading grow with the square of the input; :func:`read_replay` gives the pairs.
    ``history`` and ``live`` are (events, telemetry) routing views.
    """
    events, telemetry = history
    past = folded_alerts_with_context(
        events.where(F.col("occurred_at") <= moment(cut)),
        telemetry.where(F.col("recorded_at") <= moment(cut)),
        span,
    )
    live_events, live_telemetry = live
    present = live_alerts_with_context(
        live_slice(live_events, "occurred_at", cut),
        live_telemetry.where(F.col("recorded_at") >= moment(cut) - interval(span)),
        span, delay,
    )
    return start_replay(spark, past, present, path, checkpoint, available_now)
