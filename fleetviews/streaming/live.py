"""Continuously maintained forms of the views.

Stateless views need nothing special: the functions of ``operators.views`` accept
streams. This module adds what a stream needs beyond that: watermarks, state that
spreads, and rolling results that age without input.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.timing import interval, moment, parse_duration
from ..functions.topics import topic_matches
from ..operators.joins import TWO_MINUTES, alerts_with_context
from ..operators.rolling import HOUR, fleet_alert_summary, vehicle_event_counts
from ..operators.views import all_of, severity_is
from ..operators.windows import FIVE_MINUTES, vehicle_speed_avg
from ..sources.keyed import KeyedTable
from ..sources.sinks import started

DELAY = "10 minutes"
ALERT_TREE = "fleet/events/>"


def watermarked(stream: DataFrame, time_column: str, delay: str = DELAY) -> DataFrame:
    """Rows more than ``delay`` behind the newest may be dropped by stateful operators."""
    return stream.withWatermark(time_column, delay)


def live_speed_avg(telemetry: DataFrame, width: str = FIVE_MINUTES, delay: str = DELAY) -> DataFrame:
    """Tumbling averages; run in update mode to see a window before it closes."""
    return vehicle_speed_avg(watermarked(telemetry, "recorded_at", delay), width)


def live_alerts_with_context(
    events: DataFrame, telemetry: DataFrame, span: timedelta = TWO_MINUTES, delay: str = DELAY
) -> DataFrame:
    """Stream-stream interval join, append mode.

    The time bin is part of the join key here too, so a busy vehicle's state is spread
    over many state partitions. The range condition lets both sides forget rows the
    watermark has passed.
    """
    return alerts_with_context(
        watermarked(events, "occurred_at", delay),
        watermarked(telemetry, "recorded_at", delay),
        span,
    )


def subscribed(stream: DataFrame, pattern: str, severity: str = "all") -> DataFrame:
    """Live rows of a topic pattern, optionally of one severity."""
    return stream.where(all_of(topic_matches(F.col("topic"), pattern), severity_is(severity)))


def alert_watch(events: DataFrame, severity: str = "high") -> DataFrame:
    return subscribed(events, ALERT_TREE, severity)


# --- rolling views: an append-only table by hour, read against "now" ---

def start_rolling_table(
    events: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append alerts to a table partitioned by the hour they occurred in."""
    rows = events.withColumn("event_hour", F.date_trunc("hour", "occurred_at"))
    writer = (
        rows.writeStream.format("parquet").outputMode("append").partitionBy("event_hour")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return started(rows, writer, available_now)


def rolling_rows(spark: SparkSession, path: str, as_of=None, span=HOUR) -> DataFrame:
    """The rows of the span before "now": only its hours' folders are listed and read.

    Rows leave as time passes although nothing arrives, since "now" is a read argument.
    """
    bound = moment(as_of) - interval(parse_duration(span))
    rows = spark.read.parquet(path)
    in_hours = F.col("event_hour").cast("timestamp") >= F.date_trunc("hour", bound)
    return rows.where(in_hours & (F.col("occurred_at") > bound)).drop("event_hour")


def rolling_alert_summary(spark: SparkSession, path: str, as_of=None, span=HOUR) -> DataFrame:
    return fleet_alert_summary(rolling_rows(spark, path, as_of, span), as_of, span)


def rolling_event_counts(spark: SparkSession, path: str, as_of=None, span=HOUR) -> DataFrame:
    return vehicle_event_counts(rolling_rows(spark, path, as_of, span), as_of, span)


def rolling_table(
    spark: SparkSession, path: str, build: Callable[..., DataFrame] = fleet_alert_summary,
    keys: tuple[str, ...] = ("severity",), feed: bool = False,
) -> KeyedTable:
    """The table that :func:`start_rolling_view` keeps; its columns are those of ``build``."""
    no_rows = spark.createDataFrame([], "vehicle_id string, severity string, occurred_at timestamp")
    rows = StructType([*build(no_rows).schema.fields, StructField("gone", BooleanType())])
    return KeyedTable(spark, path, list(keys), rows, gone="gone", feed=feed)


def start_rolling_view(
    ticks: DataFrame, source: str, table: KeyedTable, checkpoint: str,
    build: Callable[..., DataFrame] = fleet_alert_summary, span=HOUR, available_now: bool = False,
) -> StreamingQuery:
    """A rolling view that is kept: its rows change and leave as time passes, without new input.

    ``ticks`` is a stream with a ``timestamp``, such as Spark's rate source; the newest tick of a batch is
    its "now". Each batch builds the view over the span's rows of the rolling table ``source``, whose hours
    bound what is read, and writes what differs from the state before it: new and changed rows, and the
    keys that no row supports any more as gone. Distinct vehicles are counted anew and therefore exact.
    """
    spark = ticks.sparkSession

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        now = batch.agg(F.max("timestamp")).first()[0]
        if now is None:
            return
        current = build(rolling_rows(spark, source, F.lit(now), span), F.lit(now), span)
        measures = [c for c in current.columns if c not in table.keys]
        was = table.read(before=batch_id).select(*table.keys, F.struct(*measures).alias("_was"))
        both = current.select(*table.keys, F.struct(*measures).alias("_is")).join(was, table.keys, "full")
        differs = both.where(~F.col("_is").eqNullSafe(F.col("_was")))
        table.write(
            differs.select(*table.keys, *[F.col(f"_is.{c}").alias(c) for c in measures], F.col("_is").isNull().alias("gone")),
            batch_id,
        )

    writer = ticks.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return started(ticks, writer, available_now)


def change_feed(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """New rows of an append view's table as a stream, to trigger a consumer."""
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(path)
