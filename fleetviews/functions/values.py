"""Rounding, ranking and JSON rendering of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def rounded(value: Column, places: int) -> Column:
    """Decimal rounding (half away from zero) of a floating value."""
    return F.round(value.cast("decimal(38,10)"), places)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 1).when(severity == "medium", 2).otherwise(3)


def payload_time(columns: list[str]) -> Column:
    """First time field a payload carries."""
    known = [c for c in ("recorded_at", "occurred_at", "issued_at") if c in columns]
    return F.coalesce(*[F.col(c) for c in known]) if known else F.lit(None).cast("timestamp")


def decoded_or_raw(text: Column) -> Column:
    """JSON text as VARIANT; text that is not JSON becomes ``{"raw": text}``; none ``{}``."""
    wrapped = F.to_variant_object(F.struct(text.alias("raw")))
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.parse_json(F.lit("{}"))).otherwise(
        F.coalesce(F.try_parse_json(text), wrapped)
    )


def _plain(field: T.StructField, column: Column) -> Column:
    """JSON-friendly form: times ISO (by the writer), decimals floating, intervals text."""
    if isinstance(field.dataType, T.DecimalType):
        return column.cast("double").alias(field.name)
    if isinstance(field.dataType, T.DayTimeIntervalType):
        return column.cast("string").alias(field.name)
    return column.alias(field.name)


JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def row_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """All (or the named) columns of a row as one JSON object."""
    names = columns or df.columns
    return F.to_json(
        F.struct(*[_plain(df.schema[n], F.col(n)) for n in names]), JSON_TIMES
    )


def event_json(df: DataFrame, source: str, topic: Column, event_time: Column) -> Column:
    """``{source, topic, event_time, payload}`` with the whole row as payload."""
    payload = F.struct(*[_plain(f, F.col(f.name)) for f in df.schema.fields])
    return F.to_json(
        F.struct(
            F.lit(source).alias("source"),
            topic.alias("topic"),
            event_time.alias("event_time"),
            payload.alias("payload"),
        ),
        JSON_TIMES,
    )


def event_line(df: DataFrame, source: str, topic: Column, event_time: Column) -> Column:
    """Compact one-line form: ``[source] time  topic  vehicle=…  key=value …``.

    The topic and the vehicle are not repeated among the values; NULLs are left out.
    """

    def text(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.TimestampType):
            return F.date_format(F.col(field.name), JSON_TIMES["timestampFormat"])
        return F.col(field.name).cast("string")

    pairs = [
        F.concat(F.lit(f.name + "="), text(f))
        for f in df.schema.fields
        if f.name not in ("topic", "vehicle_id")
    ]
    return F.concat_ws(
        "  ",
        F.concat(
            F.lit(f"[{source:7}] "), F.date_format(event_time, JSON_TIMES["timestampFormat"])
        ),
        topic,
        F.concat(F.lit("vehicle="), F.coalesce(F.col("vehicle_id"), F.lit(""))),
        F.concat_ws("  ", *pairs),
    )


def message_json(source: str, topic: Column, event_time: Column, body: Column) -> Column:
    """The same record for a raw message body."""
    return F.to_json(
        F.struct(
            F.lit(source).alias("source"),
            topic.alias("topic"),
            event_time.alias("event_time"),
            decoded_or_raw(body).alias("payload"),
        ),
        JSON_TIMES,
    )


def message_line(source: str, topic: Column, event_time: Column, body: Column) -> Column:
    """The same line for a raw message body: its top-level fields as ``key=value``."""
    fields = F.map_entries(F.from_json(body, "map<string,string>"))
    shown = F.filter(fields, lambda e: e["value"].isNotNull() & ~e["key"].isin("topic", "vehicle_id"))
    pairs = F.transform(shown, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws(
        "  ",
        F.concat(F.lit(f"[{source:7}] "), F.date_format(event_time, JSON_TIMES["timestampFormat"])),
        topic,
        F.concat(F.lit("vehicle="), F.coalesce(F.get_json_object(body, "$.vehicle_id"), F.lit(""))),
        F.array_join(pairs, "  "),
    )


def schema_columns(content: Column, canonical: list[str]) -> Column:
    """Columns a JSON Schema declares, in canonical order.

    Text that is not JSON falls back to the vehicle and the topic.
    """
    parsed = F.try_parse_json(content)
    properties = F.json_object_keys(F.get_json_object(content, "$.properties"))
    known = F.array_intersect(F.array(*[F.lit(c) for c in canonical]), properties)
    fallback = F.array(F.lit("vehicle_id"), F.lit("topic"))
    none = F.array().cast("array<string>")
    return F.when(parsed.isNull(), fallback).otherwise(F.coalesce(known, none))
