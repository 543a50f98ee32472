"""Stateful views over stored rows, for which no row is too late.

Spark's stateful operators forget rows the watermark has passed, without a trace. Here the state is a
table: every batch stores its rows by the hour of their time, meets what is stored in the hours it
reaches, and writes what is new under its batch number. Only those hours are read, so a batch costs what
its own rows and their neighbourhood cost, however long the stream has run. A batch that is run again
sees the same rows, those of batches up to its own, and replaces what it wrote.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.timing import interval
from ..operators.joins import LEFTS, RIGHTS, TWO_MINUTES, alerts_with_context, folded_alerts_with_context, unfolded_context
from ..operators.sets import known_keys, same_key
from ..sources.sinks import BATCH, batch_schema, started, stored, write_batch

HOUR = "_hour"
NONE = timedelta(0)


def hour_of(time: Column) -> Column:
    """Hours since the epoch; NULL for no time."""
    return F.floor(F.unix_micros(time) / 3_600_000_000)


def hours_reached(rows: DataFrame, time_column: str, back: timedelta = NONE, ahead: timedelta = NONE) -> list[int]:
    """Hours between ``back`` before and ``ahead`` after any of the rows: as many as the rows are spread over."""
    time = F.col(time_column)
    reached = F.sequence(hour_of(time - interval(back)), hour_of(time + interval(ahead)))
    found = rows.where(time.isNotNull()).select(F.explode(reached).alias(HOUR)).distinct()
    return [row[HOUR] for row in found.collect()]


def _in_hours(hours: list[int]) -> Column:
    return F.col(HOUR).isin(hours) if hours else F.lit(False)


class StoredContext:
    """Alerts with the readings before them, kept up from two streams; every pair appears once, in the
    batch that brought the later arrival of the two, however late either comes by its own time.

    A batch stores its pairs folded, as they grow with the square of the rows; :meth:`read` gives the pairs.
    """

    def __init__(self, spark: SparkSession, path: str, span: timedelta = TWO_MINUTES):
        self.spark, self.path, self.span = spark, path, span
        self._schema: T.StructType | None = None
        self._pairs: T.StructType | None = None

    def start(self, events: DataFrame, telemetry: DataFrame, available_now: bool = False) -> StreamingQuery:
        def side(rows: DataFrame, name: str, other: str, others: DataFrame, time_column: str) -> DataFrame:
            parts = {
                name: F.struct(*[F.col(c) for c in rows.columns]),
                other: F.lit(None).cast(others.schema),
                "side": F.lit(name),
                HOUR: hour_of(F.col(time_column)),
            }
            return rows.select(*[parts[c].alias(c) for c in ("alert", "reading", "side", HOUR)])

        both = side(events, "alert", "reading", telemetry, "occurred_at").unionByName(
            side(telemetry, "reading", "alert", events, "recorded_at"))
        self._schema = T.StructType([*both.schema.fields, T.StructField(BATCH, T.LongType())])
        folded = folded_alerts_with_context(events, telemetry, self.span).schema
        # Tables of an earlier layout hold pairs; a row has the columns of one layout, and those of the other are null.
        pairs = alerts_with_context(events, telemetry, self.span).schema
        self._pairs = batch_schema(T.StructType([*pairs.fields, folded[LEFTS], folded[RIGHTS]]))
        writer = both.writeStream.foreachBatch(self._on_batch).option("checkpointLocation", f"{self.path}/checkpoint")
        return started(both, writer, available_now)

    def _side(self, name: str) -> DataFrame:
        rows = stored(self.spark, f"{self.path}/rows", self._schema)
        return rows.where(F.col("side") == name).select(f"{name}.*", HOUR, BATCH)

    def _on_batch(self, batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn(BATCH, F.lit(batch_id).cast("long")).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("side", HOUR, BATCH).parquet(f"{self.path}/rows")
        )
        alerts, readings = self._side("alert"), self._side("reading")
        now = F.col(BATCH) == batch_id
        new_alerts, new_readings = alerts.where(now), readings.where(now)
        near_alerts = _in_hours(hours_reached(new_alerts, "occurred_at", back=self.span))
        near_readings = _in_hours(hours_reached(new_readings, "recorded_at", ahead=self.span))
        known = readings.where((F.col(BATCH) <= batch_id) & near_alerts)
        earlier = alerts.where((F.col(BATCH) < batch_id) & near_readings)
        own = [BATCH, HOUR]
        pairs = folded_alerts_with_context(new_alerts.drop(*own), known.drop(*own), self.span).unionByName(
            folded_alerts_with_context(earlier.drop(*own), new_readings.drop(*own), self.span))
        write_batch(pairs, batch_id, f"{self.path}/pairs")

    def read(self) -> DataFrame:
        rows = stored(self.spark, f"{self.path}/pairs", self._pairs).drop(BATCH)
        folded = rows.where("alert_time IS NULL").select("vehicle_id", LEFTS, RIGHTS)
        pairs = rows.where("alert_time IS NOT NULL").drop(LEFTS, RIGHTS)
        return unfolded_context(folded).unionByName(pairs)


def start_once_per_key(
    stream: DataFrame, keys: list[str], time_column: str, path: str, checkpoint: str, available_now: bool = False,
) -> StreamingQuery:
    """Each key once, as its first batch brings it, into a table by hour; read it with :func:`once_rows`.

    ``time_column`` is one of the keys, so copies of a key lie in one hour and only the hours of a batch are
    looked at. Of copies in one batch the smallest row stays; they are folded before they meet the table.
    Rows without a time are one such hour.
    """
    rest = [c for c in stream.columns if c not in keys]
    schema = once_schema(stream)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        folded = batch.groupBy(*keys).agg(F.min(F.struct(*rest) if rest else F.lit(0)).alias("_row"))
        rows = folded.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).persist()
        try:
            near = _in_hours(hours_reached(rows, time_column)) | F.col(HOUR).isNull()
            known = stored(spark, path, schema).where((F.col(BATCH) < batch_id) & near)
            fresh = rows.join(known_keys(known, tuple(keys)), same_key(tuple(keys)), "left_anti")
            (
                fresh.select(*stream.columns, hour_of(F.col(time_column)).alias(HOUR), F.lit(batch_id).cast("long").alias(BATCH))
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(HOUR, BATCH).parquet(path)
            )
        finally:
            rows.unpersist()

    spark = stream.sparkSession
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return started(stream, writer, available_now)


def once_schema(stream: DataFrame) -> T.StructType:
    return T.StructType([*stream.schema.fields, T.StructField(HOUR, T.LongType()), T.StructField(BATCH, T.LongType())])


def once_rows(spark: SparkSession, path: str, stream: DataFrame) -> DataFrame:
    return stored(spark, path, once_schema(stream)).select(*stream.columns)
