"""One subscription: the history of a span, then live messages, without a gap and without doubles.

The live stream starts at the beginning of its checkpoint, before history is read, so nothing that
arrives in between is lost, however late its event time is. What history already holds comes by
again on that stream: the keys of the span are written once, and each suppresses the first live
record that matches, and no later one. Which keys are spent is a table of its own: every batch
writes the records it suppressed beside those it kept, in one write under its batch number, and a
batch looks only at what batches before it spent. So a batch that is repeated after a failure, and a
subscription that starts again, go on with the same ledger.

A key is topic, event time and content: the plain body fields that the view shares with messages of
its stream. Two messages of one topic and instant are therefore told apart, and equal history rows
are one key. ``since`` bounds history and live records alike; a limit shortens history only, and what
it leaves out is still known.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.timing import interval, moment
from ..operators.sets import known_keys, same_key
from ..sources.messages import STREAMS
from ..sources.sinks import BATCH, started, stored

KEY = ("topic", "event_time", "content")
RECORD = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("event", T.StringType()),
])
STORED = T.StructType([*RECORD.fields, T.StructField("content", T.StringType())])
#: Body fields that hold JSON: their text depends on who wrote it.
NESTED = ("payload", "parameters")


def shared_fields(pattern: str, columns: list[str]) -> T.StructType:
    """Plain body fields of the stream a pattern speaks about that a view has too."""
    bodies = [body for tree, body in STREAMS.values() if pattern.split("/")[:2] == tree.split("/")[:2]]
    fields = bodies[0].fields if bodies else []
    return T.StructType([f for f in fields if f.name in columns and f.name not in NESTED])


def content_of_row(fields: T.StructType) -> Column:
    """The shared fields of a view's row as one text."""
    return F.to_json(F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields.fields])) if fields.fields else F.lit("")


def content_of_message(fields: T.StructType) -> Column:
    """The same of a message's body."""
    if not fields.fields:
        return F.lit("")
    body = F.from_json("value", fields)
    return F.to_json(F.struct(*[body[f.name].alias(f.name) for f in fields.fields]))


def written(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def split_repeats(batch: DataFrame, open_keys: DataFrame) -> DataFrame:
    """``batch`` with ``source``: ``repeat`` for one record of each open key, else ``live``.

    Equal records are folded to a count before they meet, and unfolded after, so that a key with
    very many copies is no row more than another.
    """
    folded = batch.groupBy(*STORED.fieldNames()).agg(F.count(F.lit(1)).alias("_copies"))
    first = Window.partitionBy(*KEY).orderBy("event")
    ranked = folded.withColumn("_rank", F.row_number().over(first))
    marked = ranked.join(open_keys.withColumn("_open", F.lit(1)), same_key(KEY), "left")
    spent = F.when((F.col("_rank") == 1) & F.col("_open").isNotNull(), 1).otherwise(0)
    parts = F.array(
        F.struct(F.lit("repeat").alias("source"), spent.alias("n")),
        F.struct(F.lit("live").alias("source"), (F.col("_copies") - spent).cast("int").alias("n")),
    )
    each = marked.select(*STORED.fieldNames(), F.explode(parts).alias("_part")).where("_part.n > 0")
    one = F.explode(F.sequence(F.lit(1), F.col("_part.n"))).alias("_copy")
    return each.select(*STORED.fieldNames(), F.col("_part.source").alias("source"), one).drop("_copy")


class Subscription:
    """The tables of one subscription below ``path``, and its stream."""

    def __init__(self, spark: SparkSession, path: str, checkpoint: str):
        self.spark, self.path, self.checkpoint = spark, path, checkpoint

    def _past(self, past: DataFrame, bound: Column, ordered: Callable[[DataFrame], DataFrame]) -> bool:
        """History and its keys, written once; the history table comes last and says that all is there.

        False when they were there already.
        """
        if written(self.spark, f"{self.path}/source=history"):
            return False
        self.spark.range(1).select(bound.alias("bound")).write.mode("overwrite").parquet(f"{self.checkpoint}-bound")
        span = f"{self.checkpoint}-span"
        since = F.lit(self._bound())
        past.where(F.col("event_time") > since).write.mode("overwrite").parquet(span)
        whole = self.spark.read.schema(STORED).parquet(span)
        known_keys(whole, KEY).write.mode("overwrite").parquet(f"{self.checkpoint}-keys")
        ordered(whole).write.mode("overwrite").parquet(f"{self.path}/source=history")
        return True

    def _bound(self) -> datetime:
        return self.spark.read.parquet(f"{self.checkpoint}-bound").first()["bound"]

    def _open_keys(self, batch_id: int) -> DataFrame:
        """Known keys that no batch before this one has spent."""
        known = self.spark.read.parquet(f"{self.checkpoint}-keys")
        schema = T.StructType([*STORED.fields, T.StructField(BATCH, T.LongType())])
        repeats = stored(self.spark, f"{self.path}/source=repeat", schema)
        return known.join(repeats.where(F.col(BATCH) < batch_id), same_key(KEY), "left_anti")

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        rows = split_repeats(batch, self._open_keys(batch_id)).withColumn(BATCH, F.lit(batch_id).cast("long"))
        (
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("source", BATCH).parquet(self.path)
        )

    def start(
        self, past: DataFrame, coming: DataFrame, span, as_of, ordered: Callable[[DataFrame], DataFrame],
        available_now: bool = False, deliver: Callable[[DataFrame], None] | None = None,
    ) -> StreamingQuery:
        """``past`` and ``coming`` are records with their content; ``ordered`` puts history in its order and
        cuts it to its limit. ``deliver`` gets history when it is new, and the kept records of each batch after
        they are written."""
        if self._past(past, moment(as_of) - interval(span), ordered) and deliver:
            deliver(self.history().orderBy("event_time", "event"))
        bounded = coming.where(F.col("event_time") > F.lit(self._bound())).select(*STORED.fieldNames())

        def on_batch(batch: DataFrame, batch_id: int) -> None:
            self._write(batch, batch_id)
            if deliver:
                deliver(self.live().where(F.col(BATCH) == batch_id).orderBy("event_time", "event"))

        writer = bounded.writeStream.foreachBatch(on_batch).option("checkpointLocation", self.checkpoint)
        return started(bounded, writer, available_now)

    def history(self) -> DataFrame:
        return stored(self.spark, f"{self.path}/source=history", RECORD)

    def live(self) -> DataFrame:
        """Kept live records with the batch that brought them."""
        schema = T.StructType([*RECORD.fields, T.StructField(BATCH, T.LongType())])
        return stored(self.spark, f"{self.path}/source=live", schema)
