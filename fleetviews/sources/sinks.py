"""Where results go: message folders, view tables, text output, exactly-once batches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..functions.topics import build_topic
from ..functions.values import JSON_TIMES, row_json

BATCH = "_batch_id"
DAY = "event_date"


def to_messages(df: DataFrame, topic: Column, time_column: str, headers: Column | None = None) -> DataFrame:
    """Rows as a message frame: the whole row is the JSON body."""
    none = F.lit(None).cast("map<string,string>")
    body = row_json(df, [c for c in df.columns if c not in ("topic", "headers")])
    return df.select(
        topic.alias("topic"),
        F.col(time_column).alias("ts"),
        (headers if headers is not None else none).alias("headers"),
        body.alias("value"),
    )


def command_messages(commands: DataFrame, time_column: str = "issued_at") -> DataFrame:
    """Commands addressed to their vehicles."""
    topic = build_topic("fleet", "commands", F.col("vehicle_id"), F.col("command_type"))
    return to_messages(commands, topic, time_column)


def publish(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Message folder with one sub-folder per topic tree (``tree=fleet/events`` …).

    The tree is a low-cardinality prefix; a folder per full topic would mean one per vehicle.
    """
    tree = F.concat_ws("_", F.slice(F.split("topic", "/"), 1, 2))
    (
        messages.withColumn("tree", tree)
        .write.mode(mode)
        .option("timestampFormat", JSON_TIMES["timestampFormat"])
        .partitionBy("tree")
        .json(path)
    )


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(row_json(df).alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; fields that need quoting are quoted."""
    flat = df.select(*[
        F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() in ("interval", "variant") else F.col(f.name)
        for f in df.schema.fields
    ])
    writer = flat.write.mode(mode).option("header", True)
    writer.option("timestampFormat", JSON_TIMES["timestampFormat"]).csv(path)


def save_view(view: DataFrame, path: str, time_column: str | None = None, mode: str = "overwrite") -> None:
    """Materialise a batch view, by day of its time so that later time filters prune.

    Rows are rebalanced by day first: a day's files are few and even, however the rows
    were spread and however busy the day.
    """
    if not time_column:
        view.write.mode(mode).parquet(path)
        return
    dated = view.withColumn(DAY, F.to_date(time_column))
    dated.hint("rebalance", DAY).write.mode(mode).partitionBy(DAY).parquet(path)


def append_stream(
    view: DataFrame, path: str, checkpoint: str, available_now: bool = False, state_partitions: int | None = None
) -> StreamingQuery:
    """Stateless or append-mode view into a Parquet table; the file sink is exactly-once."""
    writer = view.writeStream.format("parquet").outputMode("append").option("path", path)
    return started(view, writer.option("checkpointLocation", checkpoint), available_now, state_partitions)


def write_batch(df: DataFrame, batch_id: int, path: str, day_of: str | None = None) -> None:
    """One micro-batch into its own partition, below the day of a time column if given.

    A batch that is run again after a failure replaces the partitions it wrote before,
    so rows are neither lost nor doubled.
    """
    rows = df.withColumn(BATCH, F.lit(batch_id).cast("bigint"))
    if day_of:
        rows = rows.withColumn(DAY, F.to_date(day_of))
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*([DAY] if day_of else []), BATCH)
        .parquet(path)
    )


def update_stream(
    view: DataFrame, path: str, checkpoint: str, available_now: bool = False, day_of: str | None = None,
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Changed rows of an aggregate view after each batch; read with :func:`current_rows`."""
    writer = (
        view.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch_id: write_batch(df, batch_id, path, day_of))
    )
    return started(view, writer, available_now, state_partitions)


def stored(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table as it was written so far.

    With its schema given, a table without files, or not yet there, has no rows; without
    it that is an error.
    """
    if schema is None:
        return spark.read.parquet(path)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def batch_schema(rows: T.StructType, day_of: str | None = None) -> T.StructType:
    """Schema of what :func:`write_batch` writes."""
    day = [T.StructField(DAY, T.DateType())] if day_of else []
    return T.StructType([*rows.fields, *day, T.StructField(BATCH, T.LongType())])


def current_rows(
    spark: SparkSession, path: str, keys: list[str], first_day: Column | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """State of an update table: each key's row from the last batch that changed it.

    In a table partitioned by day, ``first_day`` bounds which days are read at all. The
    day must follow from the key, as a window's start does.
    """
    rows = stored(spark, path, schema)
    if first_day is not None:
        rows = rows.where(F.col(DAY) >= first_day)
    rest = [c for c in rows.columns if c not in (*keys, BATCH, DAY)]
    last = rows.groupBy(*keys).agg(F.max(F.struct(BATCH, *rest)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def started(
    stream: DataFrame, writer: DataStreamWriter, available_now: bool = False, state_partitions: int | None = None
) -> StreamingQuery:
    """Start a stream whose state is as wide as the cluster (or as told).

    Adaptive execution does not resize streaming state, and the width it starts with
    stays with its checkpoint. So it follows the number of cores, not the batch setting.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    batch_width = conf.get(key)
    conf.set(key, state_partitions or stream.sparkSession.sparkContext.defaultParallelism)
    try:
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        conf.set(key, batch_width)
