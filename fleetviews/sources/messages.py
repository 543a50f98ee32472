"""Message frames: reading them, decoding bodies, routing, and what goes wrong.

A message frame has the envelope columns of ``schemas.MESSAGE``: ``topic``, ``ts``,
``headers`` and the raw body ``value``. Every function serves batch and stream.
"""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.topics import topic_level, topic_matches
from ..functions.timing import interval
from ..schemas import COMMAND_BODY, EVENT_BODY, MESSAGE, TELEMETRY_BODY, UNIFIED

# Topic trees of the three streams, and the queue time-to-live.
STREAMS = {
    "telemetry": ("fleet/telemetry/>", TELEMETRY_BODY),
    "events": ("fleet/events/>", EVENT_BODY),
    "commands": ("fleet/commands/>", COMMAND_BODY),
}
TIME_TO_LIVE = timedelta(seconds=300)
# End of fixed values.

CORRUPT = "_corrupt_record"
_LINES = T.StructType([*MESSAGE.fields, T.StructField(CORRUPT, T.StringType())])


#: Where a message lies in its folder: files by age, then name, then block. Rows of a block are numbered when
#: a batch is at hand, see ``readiness.numbered``.
POSITION = "position"


def _position() -> Column:
    place = [F.col(f"_metadata.{n}") for n in ("file_modification_time", "file_path", "file_block_start")]
    return F.struct(*place).alias(POSITION)


def _envelopes(lines: DataFrame, position: bool = False) -> DataFrame:
    """Message rows of parsed lines. A line that is not JSON, or whose envelope has a field of the
    wrong type, keeps nothing but its text, as ``value``: no topic leads it anywhere but to
    :func:`dead_letters`.
    """
    fields = [f for f in MESSAGE.fieldNames() if f != "value"]
    # Naming every field keeps a narrower query from reading, and judging, less of the line.
    missing = [F.col(f).isNull() for f in MESSAGE.fieldNames()]
    bad = F.col(CORRUPT).isNotNull() & reduce(Column.__or__, missing)
    return lines.select(
        *[F.when(~bad, F.col(f)).alias(f) for f in fields],
        F.when(bad, F.col(CORRUPT)).otherwise(F.col("value")).alias("value"),
        *([_position()] if position else []),
    )


def read_messages(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    """Batch of JSON-lines message files; ``position`` adds where each message lies."""
    lines = spark.read.schema(_LINES).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return _envelopes(lines, position)


def stream_messages(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None, position: bool = False
) -> DataFrame:
    """The same folder as a stream; the trigger bound is the back-pressure knob."""
    reader = spark.readStream.schema(_LINES).option("columnNameOfCorruptRecord", CORRUPT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _envelopes(reader.json(path), position)


def kafka_messages(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """Stream from Kafka (needs the Kafka package)."""
    records = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribePattern", topics)
        .option("includeHeaders", "true")
        .options(**options)
        .load()
    )
    return from_kafka(records)


def from_kafka(records: DataFrame) -> DataFrame:
    """Kafka records as message frames. The hierarchical topic travels in the record key."""
    return records.select(
        F.coalesce(F.col("key").cast("string"), F.col("topic")).alias("topic"),
        F.col("timestamp").alias("ts"),
        F.map_from_entries(
            F.transform("headers", lambda h: F.struct(h["key"], h["value"].cast("string")))
        ).alias("headers"),
        F.col("value").cast("string").alias("value"),
    )


def routed(messages: DataFrame, pattern: str) -> DataFrame:
    """The messages one subscription receives."""
    return messages.where(topic_matches(F.col("topic"), pattern))


def stream_name() -> Column:
    """Stream a message belongs to by its topic, NULL for none: all routes in one pass."""
    return F.coalesce(*[
        F.when(topic_matches(F.col("topic"), pattern), F.lit(name))
        for name, (pattern, _) in STREAMS.items()
    ])


def decoded(messages: DataFrame, body: T.StructType) -> DataFrame:
    """Body fields as columns, envelope columns kept, undecodable text in ``_corrupt_record``.

    A field of the wrong type is NULL and the others stay. A body that is no JSON object at all
    leaves its text there.
    """
    parsed = F.from_json("value", body)
    others = [c for c in messages.columns if c != "value"]
    # Exploding a one-element array pins the parsed body to a column. As a plain
    # expression it would be repeated, and every message parsed again, in each filter
    # on a body field.
    out = messages.select(*others, "value", F.explode(F.array(parsed)).alias("_body"))
    return out.select(
        *[F.col(f"_body.{f.name}").alias(f.name) for f in body.fields],
        *others,
        F.when(_undecodable(), F.coalesce("value", F.lit(""))).alias(CORRUPT),
    )


def _undecodable() -> Column:
    """Whether a body is missing or anything but a JSON object."""
    return F.json_object_keys("value").isNull()


def dead_letters(messages: DataFrame) -> DataFrame:
    """What no typed source takes, in one pass: unreadable lines (without a topic), and messages of
    the three streams whose body cannot be decoded."""
    of_stream = stream_name().isNotNull() & _undecodable()
    lost = messages.where(F.col("topic").isNull() | of_stream)
    return lost.withColumn("value", F.coalesce("value", F.lit("")))


def split_dead_letters(decoded_messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters). Dead letters keep their envelope and original text."""
    bad = F.col(CORRUPT).isNotNull()
    envelope = [c for c in ("topic", "ts", "headers") if c in decoded_messages.columns]
    return (
        decoded_messages.where(~bad).drop(CORRUPT),
        decoded_messages.where(bad).select(*envelope, F.col(CORRUPT).alias("value")),
    )


def split_expired(
    messages: DataFrame, ingest_column: str, sent_column: str = "ts", ttl: timedelta = TIME_TO_LIVE
) -> tuple[DataFrame, DataFrame]:
    """(fresh, expired) by how long a message waited. Unknown waits count as fresh."""
    late = F.coalesce(F.col(ingest_column) - F.col(sent_column) > interval(ttl), F.lit(False))
    return messages.where(~late), messages.where(late)


def typed_source(messages: DataFrame, stream: str) -> DataFrame:
    """One of the three typed streams out of a message frame; what it leaves out is in
    :func:`dead_letters`."""
    pattern, body = STREAMS[stream]
    good, _ = split_dead_letters(decoded(routed(messages, pattern), body))
    return good


def topic_fields(messages: DataFrame, names: list[str | None]) -> DataFrame:
    """Columns out of topic levels, for publishers that put data there, not in the body.

    ``names[i]`` names level i; None skips it.
    """
    fields = [topic_level(F.col("topic"), i).alias(n) for i, n in enumerate(names) if n]
    return messages.select(*messages.columns, *fields)


def header(name: str) -> Column:
    return F.try_element_at("headers", F.lit(name))


def unified(telemetry_long: DataFrame, events: DataFrame, commands: DataFrame) -> DataFrame:
    """One wide, mostly-NULL relation of all message kinds."""
    parts = telemetry_long.unionByName(events, allowMissingColumns=True)
    return parts.unionByName(commands, allowMissingColumns=True).to(UNIFIED)
