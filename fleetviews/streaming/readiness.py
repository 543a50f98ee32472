"""The backfill boundary: marker, barrier, connector status and readiness.

A marker message divides history from live data. The connector takes it out of the
data, lets every view finish what came before it, and only then reports ready.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType, TimestampType

from ..functions.timing import moment
from ..functions.topics import build_topic
from ..operators.rolling import all_ready
from ..schemas import CONNECTOR_STATUS, MESSAGE
from ..sources.messages import POSITION, header
from ..sources.keyed import EVERY, KeyedTable
from ..sources.sinks import BATCH, batch_schema, started, stored, to_messages, write_batch

# How a marker is recognised and where readiness is announced.
MARKER_HEADER = "x-backfill-sentinel"
MARKER_VALUE = "backfill-complete"
MARKER_TOPIC = "fleet/system/sentinel"
READY_HEADER = ("x-event", "connector-ready")
# End of fixed values.
READY_MESSAGE = "History is complete and every view holds it: queries see all of it."
ARRIVAL = "arrival"

#: Batches whose totals are kept, in a ring of folders.
STATES = 4

log = logging.getLogger(__name__)


def marker(spark: SparkSession, at=None, topic: str = MARKER_TOPIC) -> DataFrame:
    """One marker message."""
    published = moment(at)
    return spark.range(1).select(
        F.lit(topic).alias("topic"),
        published.alias("ts"),
        F.create_map(F.lit(MARKER_HEADER), F.lit(MARKER_VALUE)).alias("headers"),
        F.to_json(F.struct(
            F.lit("Backfill boundary marker.").alias("message"),
            published.cast("string").alias("published_at"),
        )).alias("value"),
    ).to(MESSAGE)


def is_marker() -> Column:
    return F.coalesce(header(MARKER_HEADER) == MARKER_VALUE, F.lit(False))


def business(messages: DataFrame) -> DataFrame:
    """Messages without markers: what views may see."""
    return messages.where(~is_marker())


def numbered(batch: DataFrame) -> DataFrame:
    """A batch of messages with ``arrival`` in place of their position: one order over all batches.

    Files count by age, name and block, and rows within a block as they are read. However a stream is cut
    into batches, the same files give the same order.
    """
    row = F.monotonically_increasing_id()
    return batch.withColumn(ARRIVAL, F.struct(f"{POSITION}.*", row.alias("row"))).drop(POSITION)


def boundary_counts(messages: DataFrame, order: str) -> DataFrame:
    """One row: marker time, events before the first marker, all events, extra markers.

    Without a marker nothing precedes it: zero events, no time.
    """
    first = messages.where(is_marker()).agg(F.min(order)).scalar()
    tested = messages.withColumn("_before", F.coalesce(F.col(order) < first, F.lit(False)))
    return tested.agg(
        F.min(F.when(is_marker() & (F.col(order) == first), F.col("ts"))).alias("sentinel_detected_at"),
        F.count_if(~is_marker() & F.col("_before")).alias("events_before_sentinel"),
        F.count_if(~is_marker()).alias("total_events_consumed"),
        F.greatest(F.count_if(is_marker()) - 1, F.lit(0)).alias("duplicate_markers"),
    )


def _literal(value) -> Column:
    return F.struct(*[_literal(v) for v in value]) if isinstance(value, Row) else F.lit(value)


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


class StatusTable:
    """Connector status, keyed by connector: a :class:`KeyedTable` that one writer fills.

    An upsert is a version; readers see the newest of each connector. A version
    written again under the same number replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = EVERY):
        self._table = KeyedTable(spark, path, ["connector_name"], CONNECTOR_STATUS, every=every)

    def upsert(self, rows: DataFrame, version: int) -> None:
        self._table.write(rows.select(*[F.col(f.name).cast(f.dataType) for f in CONNECTOR_STATUS.fields]), version)

    def read(self) -> DataFrame | None:
        """Newest row of each connector; None when there is no table."""
        return self._table.read() if self._table.exists() else None

    def create(self) -> None:
        """The table without rows, unless it exists."""
        self._table.create()


def status_report(read: Callable[[], DataFrame | None], connector: str | None = None) -> dict:
    """Readiness over all connectors, or one.

    No table: ready, since no backfill is configured. No rows: not ready. Rows: ready
    when all are. Any failure to read: not ready, with the error.
    """
    try:
        table = read()
        if table is None:
            return {"ready": True, "connectors": [], "table_exists": False,
                    "message": "No backfill status table: running in live-only mode"}
        if connector:
            table = table.where(F.col("connector_name") == connector)
        rows = [r.asDict() for r in table.orderBy("connector_name").toLocalIterator()]
        if not rows:
            return {"ready": False, "connectors": [], "table_exists": True,
                    "message": "No connector has written a status so far"}
        verdict = all_ready(table).first()
        return {"ready": verdict["ready"], "connectors": rows, "table_exists": True}
    except Exception as error:
        log.warning("status table cannot be read: %s", error)
        return {"ready": False, "connectors": [], "table_exists": False, "error": str(error)}


def readiness_metadata(table: DataFrame | None, connector: str) -> dict | None:
    """What a late joiner learns from the status table; None when not ready."""
    if table is None:
        return None
    row = table.where((F.col("connector_name") == connector) & F.col("is_ready")).first()
    if row is None:
        return None
    return {
        "sentinel_detected_at": row["sentinel_detected_at"],
        "historical_events": row["events_before_sentinel"],
        "total_events": row["total_events_consumed"],
        "source": "status_table",
    }


def wait_for_ready(
    read: Callable[[], DataFrame | None], connector: str, timeout: float = 600.0, pause: float = 1.0
) -> dict:
    """Readiness metadata as soon as the status table shows it; TimeoutError otherwise."""
    deadline = time.monotonic() + timeout
    while True:
        found = readiness_metadata(read(), connector)
        if found:
            return found
        left = deadline - time.monotonic()
        if left <= 0:
            raise TimeoutError(f"connector {connector!r} not ready within {timeout}s")
        time.sleep(min(pause, left))


def wait_for_announcement(announcements: DataFrame, connector: str, checkpoint: str, timeout: float = 600.0) -> dict:
    """Readiness metadata as soon as a stream of messages announces the connector; TimeoutError otherwise.

    The caller sleeps until the stream's batch with the announcement wakes it. Announcements that were made
    before are on the stream too, so it does not matter who comes first.
    """
    woken, found = threading.Event(), []
    topic = F.concat_ws("/", F.lit("system"), F.lit("connector"), F.lit(connector), F.lit("ready"))
    own = announcements.where((F.col("topic") == topic) & (header(READY_HEADER[0]) == READY_HEADER[1]))
    body = F.from_json("value", "sentinel_detected_at timestamp, historical_events_processed long, total_events_consumed long")

    def on_batch(batch: DataFrame, _batch_id: int) -> None:
        first = batch.orderBy("ts").select(F.inline(F.array(body))).first()
        if first is not None:
            found.append(first)
            woken.set()

    query = own.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).start()
    try:
        woken.wait(timeout)
        if not found and query.exception():
            raise query.exception()
    finally:
        query.stop()
    if not found:
        raise TimeoutError(f"connector {connector!r} not announced within {timeout}s")
    return {
        "sentinel_detected_at": found[0]["sentinel_detected_at"],
        "historical_events": found[0]["historical_events_processed"],
        "total_events": found[0]["total_events_consumed"],
        "source": "announcement",
    }


def readiness_messages(status: DataFrame) -> DataFrame:
    """Readiness events of the connectors that are ready, as messages."""
    ready = status.where("is_ready").select(
        "connector_name",
        F.lit("ready").alias("status"),
        "sentinel_detected_at",
        F.col("events_before_sentinel").alias("historical_events_processed"),
        "total_events_consumed",
        F.lit(True).alias("barrier_flush_complete"),
        F.lit(READY_MESSAGE).alias("message"),
    )
    topic = build_topic("system", "connector", F.col("connector_name"), "ready")
    mark = F.create_map(*[F.lit(x) for x in READY_HEADER])
    return to_messages(ready, topic, "sentinel_detected_at", mark)


class Connector:
    """Feeds a message stream into views and keeps the readiness protocol.

    Every micro-batch writes all views first and the status after them, so a status
    that says ready implies views that hold everything before the marker: that order is
    the barrier. Each write is addressed by batch number, so a batch repeated after a
    failure changes nothing.

    ``views`` maps a name to a function from business messages to the view's rows.
    ``order`` is the column that says which messages lie before the marker; by default the
    ``arrival`` of messages read with their position, which does not depend on how the stream
    is cut into batches. With an event time, messages that arrive late are counted before it.
    Totals run along: a batch starts from the state its predecessor left. The order of every
    message is kept until the first marker is known, since only then it shows which of them
    lie before it; later markers are duplicates. ``cache_batches``
    keeps a batch while its views are written: worth it for many views over small live
    batches, not for a backlog that arrives as one large batch.
    """

    def __init__(self, spark: SparkSession, name: str, root: str,
                 views: dict[str, Callable[[DataFrame], DataFrame]], order: str = ARRIVAL,
                 cache_batches: bool = False):
        self.spark, self.name, self.root, self.views, self.order = spark, name, root, views, order
        self.cache_batches = cache_batches
        self.status = StatusTable(spark, f"{root}/status")
        self._schemas: dict[str, StructType] = {}
        self._known: Row | None = None

    def view(self, name: str) -> DataFrame:
        """Rows of a view so far. Once started, a view that got no rows yet is empty."""
        return stored(self.spark, f"{self.root}/views/{name}", self._schemas.get(name)).drop(BATCH)

    def announcements(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/ready").where(F.col(BATCH) >= 0).drop(BATCH)

    def announcement_stream(self) -> DataFrame:
        """Announcements as they are made; can be followed before the connector starts."""
        empty = self.spark.createDataFrame([], MESSAGE)
        empty.write.mode("ignore").parquet(f"{self.root}/ready/{BATCH}=-1")
        return self.spark.readStream.schema(MESSAGE).parquet(f"{self.root}/ready").select(*MESSAGE.fieldNames())

    def _state(self, batch_id: int | None = None) -> Row | None:
        """Running totals after a batch, or after the last one."""
        if self._known is not None and self._known[BATCH] == batch_id:
            return self._known
        slot = "" if batch_id is None else f"/slot={batch_id % STATES}"
        try:
            rows = self.spark.read.parquet(f"{self.root}/log{slot}")
        except AnalysisException as error:
            if _missing(error):
                return None
            raise
        if batch_id is not None:
            rows = rows.where(F.col(BATCH) == batch_id)
        return rows.orderBy(F.col(BATCH).desc()).first()

    def _on_batch(self, batch: DataFrame, batch_id: int) -> None:
        if self.cache_batches:
            batch = batch.persist()
        try:
            seen = business(batch).drop(POSITION)
            for name, build in self.views.items():
                write_batch(build(seen), batch_id, f"{self.root}/views/{name}")
            last = self._state(batch_id - 1)
            state = self._count(numbered(batch) if POSITION in batch.columns else batch, batch_id, last)
        finally:
            if self.cache_batches:
                batch.unpersist()
        self._report(state, last)
        self._known = state

    def _count(self, batch: DataFrame, batch_id: int, last: Row | None) -> Row:
        """The state after a batch, from the one before it and the batch's own rows."""
        first = last["first"] if last else None
        places = batch.select(F.col(self.order).alias("place"), is_marker().alias("marker"), "ts")
        if first is None:
            path = f"{self.root}/arrivals/{BATCH}={batch_id}"
            places.write.mode("overwrite").parquet(path)
            places = self.spark.read.parquet(path)
        kind = places.schema["place"].dataType
        before = F.lit(False) if first is None else F.col("place") < _literal(first["place"]).cast(kind)
        found = places.agg(
            F.count_if(~F.col("marker")).alias("total"),
            F.count_if("marker").alias("markers"),
            F.count_if(~F.col("marker") & before).alias("before"),
            F.min(F.when(F.col("marker"), F.struct("place", "ts"))).alias("first"),
        ).first()
        n_before = found["before"] + (last["before"] if last else 0)
        if first is None and found["first"] is not None:
            first = found["first"]
            known = self.spark.read.parquet(f"{self.root}/arrivals").where(F.col(BATCH) <= batch_id)
            n_before = known.where(~F.col("marker") & (F.col("place") < _literal(first["place"]).cast(kind))).count()
        state = Row(BATCH, "total", "markers", "before", "first")(
            batch_id, found["total"] + (last["total"] if last else 0),
            found["markers"] + (last["markers"] if last else 0), n_before, first,
        )
        schema = StructType.fromDDL(f"{BATCH} long, total long, markers long, before long").add(
            "first", StructType([StructField("place", kind), StructField("ts", TimestampType())]))
        self.spark.createDataFrame([state], schema).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/log/slot={batch_id % STATES}")
        return state

    def _report(self, state: Row, last: Row | None) -> None:
        """Status after a batch, whose predecessor left ``last``."""
        batch_id = state[BATCH]
        first, markers = state["first"], state["markers"]
        if markers > max(1, last["markers"] if last else 0):
            log.warning("%s: %d further boundary markers ignored", self.name, markers - 1)
        row = (self.name, first is not None, first["ts"] if first else None, state["before"], state["total"])
        status = self.spark.createDataFrame([(*row, None)], CONNECTOR_STATUS)
        self.status.upsert(status.withColumn("last_updated", F.current_timestamp()), batch_id)
        if first is not None and not (last and last["first"] is not None):
            self._announce(batch_id)

    def _announce(self, version: int) -> None:
        write_batch(readiness_messages(self.status.read()), version, f"{self.root}/ready")

    def start(self, messages: DataFrame, available_now: bool = False) -> StreamingQuery:
        """Run from the checkpoint on. If the marker was already seen, readiness is
        announced again for subscribers that came later."""
        self._schemas = {
            name: batch_schema(build(business(messages)).schema) for name, build in self.views.items()
        }
        state = self._state()
        if state is not None:
            self._report(state, state)
            if state["first"] is not None:
                self._announce(state[BATCH])
        writer = messages.writeStream.foreachBatch(self._on_batch).option(
            "checkpointLocation", f"{self.root}/checkpoint"
        )
        return started(messages, writer, available_now)
