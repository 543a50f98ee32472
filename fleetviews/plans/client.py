"""The query API: topic patterns in, DataFrames out."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timing import moment, newer_than, parse_duration, preset_duration
from ..functions.topics import rebuilt_topic, topic_matches
from ..operators import rolling, topk
from ..operators.views import all_of, equals
from ..session import work_dir
from ..sources import sinks
from ..sources.messages import routed
from ..streaming import live as live_views
from ..streaming import readiness, replay, subscription
from . import presets
from .registry import Mapping, Registry, UnknownPattern
from .viewset import ViewSet

#: Statements that could follow a WITH or hide behind one; quoted texts and names may use the words.
CHANGES = ("insert", "update", "delete", "merge", "drop", "create", "alter", "truncate")
#: Functions that call Java code, and formats whose name before a path makes a table of any file.
CALLS = ("java_method", "reflect", "try_reflect")
FILE_FORMATS = ("text", "csv", "json", "xml", "parquet", "orc", "avro", "binaryfile")
_QUOTED = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`(?:[^`]|``)*`""", re.DOTALL)
_FORBIDDEN = re.compile(
    rf"""\b(?:{'|'.join(CALLS)})\b|\b(?:{'|'.join(FILE_FORMATS)})`?\s*\.\s*`|\br['"]|--|/\*""", re.IGNORECASE
)

#: Records of a web subscriber; ``step`` orders the kinds.
LOG = "type string, body string, step int, batch long, event_time timestamp"
TIERS = {s: f"{s}_severity_alerts" for s in ("high", "medium", "low")}


def is_safe_select(sql: str) -> bool:
    """One SELECT statement, or a WITH before one, that changes nothing, reads no file by its path and
    calls no Java code. Comments and raw texts, which could hide such a thing, are refused."""
    text = sql.strip().rstrip(";")
    plain = _QUOTED.sub("''", text)
    changes = re.search(rf"\b(?:{'|'.join(CHANGES)})\b", plain, re.IGNORECASE)
    reads = re.match(r"(?:SELECT|WITH)\b", plain, re.IGNORECASE)
    return bool(reads) and ";" not in plain and not changes and not _FORBIDDEN.search(text)


class FleetClient:
    """Queries over a :class:`ViewSet` through a topic registry.

    Every query method returns a lazy DataFrame.
    """

    def __init__(
        self,
        spark: SparkSession,
        views: ViewSet,
        registry: Registry | None = None,
        status: Callable[[], DataFrame | None] | None = None,
        connector: str = "fleet_events",
        topic_as: str = "topic",
    ):
        self.spark = spark
        self.views = views
        self.registry = registry or Registry()
        self.connector = connector
        self.topic_as = topic_as
        self._status = status or (lambda: None)

    @property
    def as_of(self):
        return self.views.as_of

    # --- patterns ---

    def _narrowed(self, rows: DataFrame, entry: Mapping, pattern: str, strict: bool) -> DataFrame:
        """Only the rows whose topic the asked pattern covers.

        An entry may be wider than the pattern that led to it. A view's own topic is
        tested as it is, so that scans can skip by its prefix; a view without one gets
        it rebuilt from the entry's pattern.
        """
        if not strict or entry.pattern == pattern:
            return rows
        own = "topic" in rows.columns
        topic = F.col("topic") if own else rebuilt_topic(entry.pattern, rows.columns)
        return rows.where(topic_matches(topic, pattern))

    def query(
        self,
        pattern: str | None = None,
        since: str | timedelta | None = None,
        limit: int = 20,
        window: str | None = None,
        enrich: str | None = None,
        region: str | None = None,
        sql: str | None = None,
        strict: bool = True,
    ) -> DataFrame:
        """Newest rows of the view behind a pattern, or of one of its derived views.

        ``window`` picks an aggregate (an unknown one the first there is; ``since`` does
        not apply), ``enrich`` the joined view, ``region`` a spatial view, ``sql`` runs
        as it is. ``strict=False`` returns the whole view for a concrete pattern.
        """
        if sql:
            return self.sql(sql)
        if not pattern:
            raise ValueError("a pattern is required unless sql is given")
        entry = self.registry.resolve(pattern)
        if window:
            name = entry.aggregates.get(f"window_{window.replace(' ', '')}") or next(
                iter(entry.aggregates.values()), None
            )
            if not name:
                raise UnknownPattern(f"no windowed view for {pattern!r}")
            rows = self._narrowed(self.views[name], entry, pattern, strict)
            if "window_end" in rows.columns:
                return topk.latest_windows(rows, limit)
            return rows.orderBy(*topk.tie_breakers(rows, [])).limit(limit)
        if enrich:
            if not entry.enriched:
                raise UnknownPattern(f"no enriched view for {pattern!r}")
            return self._enriched(entry, pattern, since, limit, strict)
        if region:
            name = entry.spatial.get(region.lower())
            if not name:
                raise UnknownPattern(f"no view for region {region!r}; known: {list(entry.spatial)}")
        else:
            name = entry.mv
        rows = self.views[name]
        if entry.time_column and not since and (not strict or entry.pattern == pattern):
            rows = self.views.newest_rows(name, entry.time_column, limit)
        rows = self._narrowed(rows, entry, pattern, strict)
        if not entry.time_column:
            return rows.orderBy(*topk.tie_breakers(rows, [])).limit(limit)
        if since:
            rows = rows.where(newer_than(entry.time_column, since, self.as_of))
        return topk.newest(rows, entry.time_column, limit)

    def _enriched(self, entry: Mapping, pattern: str, since, limit: int, strict: bool) -> DataFrame:
        span = parse_duration(since) if since else None
        if entry.enriched == "alerts_with_context":
            narrow = pattern if strict and entry.pattern != pattern else None
            rows = presets.context_top(self.views, limit, span, pattern=narrow)
            return topk.newest(rows, "alert_time", limit)
        rows = self._narrowed(self.views[entry.enriched], entry, pattern, strict)
        if span:
            rows = rows.where(newer_than(entry.time_column, span, self.as_of))
        return topk.newest(rows, entry.time_column, limit)

    def topic_info(self, pattern: str) -> DataFrame:
        return Registry([self.registry.resolve(pattern)]).topics(self.spark)

    def topic_lag(self, pattern: str) -> DataFrame:
        entry = self.registry.resolve(pattern)
        if not entry.time_column:
            raise ValueError(f"{entry.mv!r} has no time column: lag is not measurable")
        fresh = rolling.freshness(self.views[entry.mv], entry.time_column, self.as_of)
        return fresh.select(F.lit(entry.mv).alias("mv"), "*")

    def topic_list(self, backed: bool = False) -> DataFrame:
        return self.registry.topics(self.spark, backed)

    # --- alerts ---

    def alert_list(self, severity: str = "high", limit: int = 20) -> DataFrame:
        return topk.newest(self.views.newest_rows(TIERS[severity], "occurred_at", limit), "occurred_at", limit)

    def alert_history(self, since="4h", severity: str = "all", enrich: bool = False, limit: int = 50) -> DataFrame:
        """Alerts of the span, newest first."""
        if enrich:
            level = None if severity == "all" else severity
            rows = presets.context_top(self.views, limit, parse_duration(since), None, level)
            return topk.newest(rows, "alert_time", limit)
        name = "fleet_events_raw" if severity == "all" else TIERS[severity]
        rows = self.views[name].where(newer_than("occurred_at", since, self.as_of))
        return topk.newest(rows, "occurred_at", limit)

    # --- subscriptions ---

    def _replayable(self, pattern: str) -> Mapping | None:
        """The entry whose view can be replayed for a pattern: it exists and has a time."""
        try:
            entry = self.registry.resolve(pattern)
        except UnknownPattern:
            return None
        return entry if entry.time_column else None

    def history(self, pattern: str, since: str | timedelta, cut=None, limit: int | None = None,
                form: str = "json") -> DataFrame | None:
        """Event records of the span, oldest first.

        None when the pattern has no view, or a view without a time: then there is
        nothing to replay and a subscription is live only.
        """
        span = parse_duration(since)
        entry = self._replayable(pattern)
        if entry is None:
            return None
        rows = self._narrowed(self.views[entry.mv], entry, pattern, True)
        past = replay.history_slice(rows, entry.time_column, span, cut, self.as_of, limit)
        return replay.rendered(past, "history", entry.pattern, entry.time_column, form)

    def subscribe(self, pattern: str, live: DataFrame, path: str, checkpoint: str, cut=None,
                  since: str | timedelta | None = None, limit: int | None = None,
                  available_now: bool = False, form: str = "json",
                  deliver: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
        """History of the span and the live messages after it, as event records.

        ``live`` is a streaming message frame: any topic can be subscribed to, whether or
        not a view is mapped to it. ``since`` bounds both parts; without it, or without a
        view that has a time, there is no history, and ``cut`` is where live begins. With
        it, history is what the view holds at the first start (up to ``cut``), and each of
        its rows keeps one live message from coming again, see :mod:`..streaming.subscription`:
        what arrives late, or while history is read, is live. ``limit`` shortens history
        only. Read the result with :func:`replay.read_replay`.
        """
        coming = routed(live, pattern)
        entry = self._replayable(pattern) if since is not None else None
        if entry is None:
            if cut is not None:
                coming = replay.live_slice(coming, "ts", cut)
            after = replay.rendered_messages(coming, form=form).drop("source")
            if deliver:
                def on_batch(batch: DataFrame, _id: int) -> None:
                    deliver(batch)

                writer = after.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
                return sinks.started(after, writer, available_now)
            return replay.append_stream(after, f"{path}/source=live", checkpoint, available_now)
        rows = self._narrowed(self.views[entry.mv], entry, pattern, True)
        if cut is not None:
            rows = rows.where(F.col(entry.time_column) <= moment(cut))
        fields = subscription.shared_fields(entry.pattern, rows.columns)
        past = replay.rendered(rows, "history", entry.pattern, entry.time_column, form,
                               subscription.content_of_row(fields))
        after = replay.rendered_messages(coming, form=form, content=subscription.content_of_message(fields))
        return subscription.Subscription(self.spark, path, checkpoint).start(
            past.drop("source"), after.drop("source"), parse_duration(since), self.as_of,
            lambda records: topk.oldest_first(records, "event_time", limit).drop("content"),
            available_now, deliver,
        )

    def _log_head(self, pattern: str, since: str | None) -> tuple[list[tuple], str | None]:
        """The first records of a web subscriber as (type, body, step), and why there is no history."""
        report = self.backfill_status()
        head = [("backfill_status", f"ready={str(report['ready']).lower()}", 0)]
        if not report["ready"] and report["table_exists"]:
            head.append(("status", "Backfill in progress: history may be incomplete", 1))
        if since is None:
            return head, None
        try:
            entry = self.registry.resolve(pattern)
        except UnknownPattern:
            entry = None
        error = None
        if preset_duration(since) is None:
            error = f'Unknown duration "{since}"'
        elif entry is None:
            error = f'Topic "{pattern}" not found in registry: live only'
        elif not entry.time_column:
            error = f'Topic "{pattern}" has no time column: live only'
        return head + ([("error", error, 2)] if error else []), error

    def _log_of(self, head: list[tuple], history: DataFrame | None) -> DataFrame:
        """Head records, and history between its start and its end with their count."""
        log = self.spark.createDataFrame(head, LOG)
        if history is None:
            return log
        counted = history.agg(F.concat(F.lit("count="), F.count(F.lit(1))).alias("body"))
        for kind, step in (("history_start", 2), ("history_done", 4)):
            log = log.unionByName(
                counted.select(F.lit(kind).alias("type"), "body", F.lit(step).alias("step")), allowMissingColumns=True
            )
        return log.unionByName(
            history.select(F.lit("history").alias("type"), F.col("event").alias("body"), F.lit(3).alias("step"),
                           "event_time"),
            allowMissingColumns=True,
        )

    def subscription_log(self, pattern: str, since: str, limit: int | None = None) -> DataFrame:
        """Records a web subscriber receives before live ones: readiness, a count, history.

        An unknown duration or pattern yields an error record instead of history.
        """
        head, error = self._log_head(pattern, since)
        if error:
            return self.spark.createDataFrame([h[:3] for h in head], "type string, body string, step int")
        history = self.history(pattern, preset_duration(since), None, limit)
        return self._log_of([(*h, None, None) for h in head], history).select("type", "body", "step", "event_time").orderBy(
            "step", "event_time", "body"
        )

    def web_subscription(self, pattern: str, live: DataFrame, path: str, checkpoint: str,
                         since: str | None = None, limit: int | None = None,
                         available_now: bool = False) -> StreamingQuery:
        """A web subscriber's whole log: status, history between its counts, then live records.

        Read it with :meth:`web_records`. A duration that is not on the list, or a pattern without
        history, leaves an error record and a live subscription. Starting again goes on with the log.
        """
        head, error = self._log_head(pattern, since)
        head.append(("status", "Live messages follow", 5))
        span = None if error or since is None else preset_duration(since)
        self.spark.createDataFrame(head, "type string, body string, step int").coalesce(1).write.mode(
            "ignore").parquet(f"{checkpoint}-head")
        return self.subscribe(pattern, live, path, checkpoint, None, span, limit, available_now)

    def web_records(self, path: str, checkpoint: str) -> DataFrame:
        """The log of :meth:`web_subscription` so far, in order: type, body, step, batch, event_time."""
        log = subscription.Subscription(self.spark, path, checkpoint)
        head = [tuple(r) for r in self.spark.read.parquet(f"{checkpoint}-head").collect()]
        replayed = not any(kind == "error" for kind, _, _ in head) and subscription.written(
            self.spark, f"{path}/source=history")
        records = self._log_of([(*h, None, None) for h in head], log.history() if replayed else None)
        live = log.live().select(
            F.lit("live").alias("type"), F.col("event").alias("body"), F.lit(6).alias("step"),
            F.col(sinks.BATCH).alias("batch"), "event_time",
        )
        return records.unionByName(live, allowMissingColumns=True).orderBy("step", "batch", "event_time", "body")

    def alert_watch(self, live_events: DataFrame, severity: str = "high") -> DataFrame:
        """Streaming alerts of a severity, as event records."""
        rows = live_views.alert_watch(live_events, severity)
        return replay.rendered(rows, "live", live_views.ALERT_TREE, "occurred_at")

    # --- presets, tools, SQL ---

    def preset(self, name: str, since=None, vehicle_id=None, severity=None, limit: int = 100) -> DataFrame:
        return presets.preset(self.views, name, since, vehicle_id, severity, limit)

    def preset_list(self) -> DataFrame:
        """The presets with the filters each supports."""
        rows = [
            (name, p.label, p.category, p.time_column is not None, p.by_vehicle, p.by_severity)
            for name, p in presets.PRESETS.items()
        ]
        return self.spark.createDataFrame(
            rows,
            "id string, label string, category string, supports_since boolean,"
            " supports_vehicle boolean, supports_severity boolean",
        )

    def tool(self, name: str, **arguments) -> DataFrame:
        return presets.TOOLS[name](self.views, **arguments)

    def select(self, sql: str, limit: int = 100) -> DataFrame:
        """Guarded ad-hoc SELECT over the registered views.

        While the statement is analysed, Spark takes no path for a table, whatever format or class
        stands before it.
        """
        if not is_safe_select(sql):
            raise ValueError("only a single SELECT statement is allowed")
        files = "spark.sql.runSQLOnFiles"
        before = self.spark.conf.get(files)
        self.spark.conf.set(files, "false")
        try:
            return self.sql(sql.strip().rstrip(";")).limit(limit)
        finally:
            self.spark.conf.set(files, before)

    def sql(self, statement: str, args: dict | list | None = None) -> DataFrame:
        """Parameterised SQL (``:name`` or ``?`` markers) over this client's views.

        The views a statement mentions are registered again each time: another client
        of the session may have registered its own under the same names.
        """
        mentioned = [n for n in self.views.names() if n in statement.lower()]
        self.views.register(self.spark, mentioned, self.topic_as)
        return self.spark.sql(statement, args)

    def vehicle_rows(self, view: str, vehicle_id: str | None = None) -> DataFrame:
        return self.views[view].where(all_of(equals("vehicle_id", vehicle_id)))

    # --- readiness ---

    @property
    def readiness_metadata(self) -> dict | None:
        return readiness.readiness_metadata(self._status(), self.connector)

    @property
    def is_ready(self) -> bool:
        return self.readiness_metadata is not None

    def wait_for_ready(self, timeout: float = 600.0, pause: float = 1.0, announcements: DataFrame | None = None) -> dict:
        """Metadata when the connector is ready: at once where the status says so, else woken by the stream of
        ``announcements``; without one the status is looked at again after each pause."""
        if announcements is None:
            return readiness.wait_for_ready(self._status, self.connector, timeout, pause)
        known = self.readiness_metadata
        return known or readiness.wait_for_announcement(
            announcements, self.connector, work_dir(self.spark, "waiter"), timeout
        )

    def query_new_view(self, maintained: StreamingQuery, read: Callable[[], DataFrame],
                       timeout: float = 30.0) -> DataFrame:
        """Read a view created after go-live once its own backfill query has finished."""
        if not maintained.awaitTermination(int(timeout)):
            raise TimeoutError(f"view not filled within {timeout}s")
        return read()

    def backfill_status(self, connector: str | None = None) -> dict:
        return readiness.status_report(self._status, connector)

    def fleet_stats(self, vehicles: int | None = None) -> DataFrame:
        """Alert counts per severity next to readiness, one row."""
        stats = rolling.severity_columns(self.views["fleet_alert_summary"])
        return stats.select(
            "*",
            F.lit(vehicles).cast("int").alias("vehicles"),
            F.lit(self.backfill_status()["ready"]).alias("backfill_ready"),
        )
