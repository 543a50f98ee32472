"""Command line over the query API: ``python -m fleetviews SOURCE COMMAND ...``.

SOURCE is ``--messages FOLDER`` (message files) or ``--events FOLDER`` (a folder with an
``events.parquet`` table). Results are printed as a table, JSON lines or CSV.
"""

from __future__ import annotations

import argparse
import csv
import json
import sys
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

from .functions.values import row_json
from .operators import views as ops
from .plans import catalog
from .plans.client import FleetClient
from .plans.presets import PRESETS, TOOLS
from .plans.registry import Registry, UnknownPattern
from .plans.viewset import ViewSet
from .session import build_session
from .sources import messages
from .sources.events_table import EventsTable
from .sources.sinks import publish, started
from .streaming import live, readiness, replay

ROUTES = {"telemetry": ops.telemetry_raw, "events": ops.events_raw, "commands": ops.commands_raw}


PAGE = 500


def printed(df: DataFrame, form: str, out=None) -> None:
    """Rows as a table (page by page), JSON lines or quoted CSV, never held as a whole."""
    out = out or sys.stdout
    if form == "json":
        for row in df.select(row_json(df).alias("line")).toLocalIterator():
            print(row["line"], file=out)
        return
    rows = df.toLocalIterator()
    if form == "csv":
        writer = csv.writer(out)
        writer.writerow(df.columns)
        writer.writerows(rows)
        return
    empty = True
    while page := list(islice(rows, PAGE)):
        empty = False
        text = [df.columns, *([str(v) for v in row] for row in page)]
        widths = [max(len(line[i]) for line in text) for i in range(len(df.columns))]
        text.insert(1, ["-" * w for w in widths])
        for line in text:
            print("  ".join(cell.ljust(w) for cell, w in zip(line, widths)).rstrip(), file=out)
    if empty:
        print("(no rows)", file=out)


def views_over(spark: SparkSession, args: argparse.Namespace, streaming: bool = False) -> ViewSet:
    if args.events:
        return ViewSet.over(EventsTable(spark, args.events, streaming), args.as_of)
    read = messages.stream_messages if streaming else messages.read_messages
    frame = read(spark, args.messages)
    return ViewSet(*[messages.typed_source(frame, s) for s in messages.STREAMS], as_of=args.as_of)


def live_messages(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.events:
        return EventsTable(spark, args.events, streaming=True).messages()
    return messages.stream_messages(spark, args.messages)


def show(batch: DataFrame, _batch_id: int = 0) -> None:
    for row in batch.toLocalIterator():
        print(row["event"], flush=True)


def follow(events: DataFrame, checkpoint: str, once: bool) -> None:
    """Print the records of a stream of rendered events as they come."""
    writer = events.writeStream.foreachBatch(show).option("checkpointLocation", checkpoint)
    started(events, writer, once).awaitTermination()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fleetviews", description=__doc__.split("\n")[0])
    source = top.add_mutually_exclusive_group(required=True)
    source.add_argument("--messages", help="folder of message files")
    source.add_argument("--events", help="folder with an events.parquet table")
    top.add_argument("--registry", help="registry folder (default: the static mappings)")
    top.add_argument("--as-of", help='ISO time that stands for "now"')
    top.add_argument("--format", choices=("table", "json", "csv"), default="table")
    commands = top.add_subparsers(dest="command", required=True)

    query = commands.add_parser("query", help="newest rows behind a topic pattern")
    query.add_argument("pattern", nargs="?")
    for option in ("window", "enrich", "region", "sql", "since"):
        query.add_argument(f"--{option}")
    query.add_argument("--limit", type=int, default=20)

    topic = commands.add_parser("topic", help="registry and freshness").add_subparsers(dest="action", required=True)
    for action in ("info", "lag"):
        topic.add_parser(action).add_argument("pattern")
    topic.add_parser("list").add_argument("--backed", action="store_true")

    alert = commands.add_parser("alert", help="alert shortcuts").add_subparsers(dest="action", required=True)
    listed = alert.add_parser("list")
    listed.add_argument("--severity", choices=("high", "medium", "low"), default="high")
    listed.add_argument("--limit", type=int, default=20)
    history = alert.add_parser("history")
    history.add_argument("--since", default="4h")
    history.add_argument("--severity", choices=("high", "medium", "low", "all"), default="all")
    history.add_argument("--enrich", action="store_true")
    watch = alert.add_parser("watch")
    watch.add_argument("--severity", choices=("high", "medium", "low", "all"), default="high")

    subscribe = commands.add_parser("subscribe", help="history, then live events")
    subscribe.add_argument("pattern")
    subscribe.add_argument("--since")
    for streaming in (watch, subscribe):
        streaming.add_argument("--line", action="store_true", help="compact lines instead of JSON")
        streaming.add_argument("--once", action="store_true", help="stop at the end of what is there")
        streaming.add_argument("--checkpoint", required=True, help="shared folder that remembers progress")
        streaming.add_argument("--cut", help="ISO time where history ends and live begins")

    preset = commands.add_parser("preset", help="a preset query")
    preset.add_argument("name", choices=PRESETS)
    for option in ("since", "vehicle", "severity"):
        preset.add_argument(f"--{option}")
    preset.add_argument("--limit", type=int, default=100)
    tool = commands.add_parser("tool", help="a tool query")
    tool.add_argument("name", choices=TOOLS)
    tool.add_argument("--vehicle")
    tool.add_argument("--limit", type=int)
    generate = commands.add_parser("generate", help="views and registry from an event catalog")
    generate.add_argument("--catalog", help="folder of catalog tables (default: static entries only)")
    generate.add_argument("--dry-run", action="store_true", help="only show the view statements")
    generate.add_argument("--out", help="folder to write the registry to")
    marker = commands.add_parser("marker", help="append the backfill boundary to the message folder")
    marker.add_argument("--topic", default=readiness.MARKER_TOPIC)
    status = commands.add_parser("status", help="readiness of the connectors")
    status.add_argument("--table", required=True, help="folder of the status table")
    status.add_argument("--connector")
    status.add_argument("--wait", type=float, metavar="SECONDS", help="wait until the connector is ready")
    return top


def administer(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    """Commands about views, registry and readiness rather than rows."""
    if args.command == "generate":
        defs = catalog.definitions(catalog.assembled(*catalog.read_catalog(spark, args.catalog))) if args.catalog else None
        if args.dry_run:
            empty = spark.createDataFrame([], "view_name string, statement string")
            return catalog.view_sql(defs).orderBy("view_name") if defs is not None else empty
        _, registry = catalog.generate(views_over(spark, args), defs)
        if args.out:
            registry.write(spark, args.out)
        return registry.topics(spark)
    if args.command == "marker":
        if not args.messages:
            raise ValueError("a marker needs --messages")
        publish(readiness.marker(spark, args.as_of, args.topic), args.messages)
        return None
    read = readiness.StatusTable(spark, args.table).read
    if args.wait is not None:
        if not args.connector:
            raise ValueError("--wait needs --connector")
        readiness.wait_for_ready(read, args.connector, args.wait)
    print(json.dumps(readiness.status_report(read, args.connector), default=str))
    return None


def answer(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    """The result of a command; None when it printed a stream itself."""
    if args.command in ("generate", "marker", "status"):
        return administer(spark, args)
    registry = Registry.read(spark, args.registry) if args.registry else Registry()
    client = FleetClient(spark, views_over(spark, args), registry)
    if args.command == "query":
        return client.query(
            args.pattern, args.since, args.limit, args.window, args.enrich, args.region, args.sql
        )
    if args.command == "topic":
        if args.action == "list":
            return client.topic_list(args.backed)
        return client.topic_info(args.pattern) if args.action == "info" else client.topic_lag(args.pattern)
    if args.command == "preset":
        return client.preset(args.name, args.since, args.vehicle, args.severity, args.limit)
    if args.command == "tool":
        given = {"vehicle_id": args.vehicle, "limit": args.limit}
        return client.tool(args.name, **{k: v for k, v in given.items() if v is not None})
    if args.command == "alert" and args.action == "list":
        return client.alert_list(args.severity, args.limit)
    if args.command == "alert" and args.action == "history":
        return client.alert_history(args.since, args.severity, args.enrich)
    form = "line" if args.line else "json"
    if args.command == "alert":
        rows = live.alert_watch(views_over(spark, args, streaming=True)["fleet_events_raw"], args.severity)
        follow(replay.rendered(rows, "live", live.ALERT_TREE, "occurred_at", form), args.checkpoint, args.once)
        return None
    client.subscribe(
        args.pattern, live_messages(spark, args), f"{args.checkpoint}-log", args.checkpoint, args.cut, args.since,
        available_now=args.once, form=form, deliver=show,
    ).awaitTermination()
    return None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or build_session()
    try:
        result = answer(spark, args)
    except (UnknownPattern, ValueError, TimeoutError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    if result is not None:
        printed(result, args.format)
    return 0
