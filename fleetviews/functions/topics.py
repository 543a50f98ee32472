"""Topic patterns as native predicates.

A topic is ``/``-delimited. In a pattern ``*`` stands for exactly one level and ``>``
for one or more trailing levels. Everything here compiles to built-in expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Streams by the word that names them in a topic: routing view and time column.
STREAMS = {
    "telemetry": {"view": "fleet_telemetry_raw", "time": "recorded_at"},
    "events": {"view": "fleet_events_raw", "time": "occurred_at"},
    "commands": {"view": "fleet_commands_raw", "time": "issued_at"},
}
ONE_LEVEL, REST = "*", ">"
_REGEX_SPECIALS = r"([\\.\[\]{}()*+\-?^$|&#~ ])"


def pattern_levels(pattern: str) -> list[str]:
    """Levels of a pattern, up to and including the first ``>``."""
    levels = pattern.split("/")
    return levels[: levels.index(REST) + 1] if REST in levels else levels


def pattern_regex(pattern: str) -> str:
    """Anchored regular expression for a pattern given as an argument."""
    wild = {ONE_LEVEL: "[^/]+", REST: ".+"}
    body = "/".join(
        wild.get(level) or re.sub(_REGEX_SPECIALS, r"\\\1", level)
        for level in pattern_levels(pattern)
    )
    return f"^{body}$"


def pattern_regex_column(pattern: Column) -> Column:
    """The same expression for a column of patterns."""
    levels = F.split(pattern, "/")
    rest_at = F.array_position(levels, REST)
    kept = F.when(rest_at > 0, F.slice(levels, F.lit(1), rest_at.cast("int"))).otherwise(levels)

    def one(level: Column) -> Column:
        return (
            F.when(level == ONE_LEVEL, F.lit("[^/]+"))
            .when(level == REST, F.lit(".+"))
            .otherwise(F.regexp_replace(level, _REGEX_SPECIALS, r"\\$1"))
        )

    return F.concat(F.lit("^"), F.array_join(F.transform(kept, one), "/"), F.lit("$"))


def topic_matches(topic: Column, pattern: str) -> Column:
    """Whole-level match.

    The literal head of the pattern is also stated as a prefix (or an equality), which
    a Parquet scan can use to skip row groups; the regular expression decides.
    """
    levels = pattern_levels(pattern)
    wild = [i for i, level in enumerate(levels) if level in (ONE_LEVEL, REST)]
    if not wild:
        return topic == pattern
    head = "".join(level + "/" for level in levels[: wild[0]])
    if wild[0] == len(levels) - 1 and levels[-1] == REST:
        return topic.startswith(head) & (F.length(topic) > len(head))
    exact = topic.rlike(pattern_regex(pattern))
    return topic.startswith(head) & exact if head else exact


def is_wild(pattern: Column) -> Column:
    return pattern.contains(ONE_LEVEL) | pattern.contains(REST)


def pattern_to_like(pattern: str) -> str:
    """LIKE form of a pattern. ``%`` also spans level boundaries; see :func:`topic_matches`."""
    return re.sub(r"[*>]", "%", pattern)


def topic_like(topic: Column, pattern: str) -> Column:
    return topic.like(pattern_to_like(pattern))


def levels_to_like(levels: Column) -> Column:
    """LIKE pattern of address levels: literals kept, variables become ``%``.

    A missing or empty address matches every topic.
    """
    parts = F.transform(
        levels,
        lambda lvl: F.when(lvl["addressLevelType"] == "literal", lvl["name"]).otherwise(F.lit("%")),
    )
    return F.when(F.coalesce(F.size(levels), F.lit(0)) > 0, F.array_join(parts, "/")).otherwise(F.lit("%"))


def like_to_pattern(like: Column) -> Column:
    return F.replace(like, F.lit("%"), F.lit(ONE_LEVEL))


def event_identifier(name: Column) -> Column:
    """SQL identifier of an event name."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_")


def _of_stream(pattern: Column, field: str) -> Column:
    """A field of the first stream of ``STREAMS`` that the pattern names, else of the first of all."""
    named = [F.when(pattern.contains(word), F.lit(stream[field])) for word, stream in STREAMS.items()]
    return F.coalesce(*named, F.lit(next(iter(STREAMS.values()))[field]))


def inferred_time_column(pattern: Column) -> Column:
    """Time column of the stream a pattern speaks about; telemetry when unclear."""
    return _of_stream(pattern, "time")


def base_view(pattern: Column) -> Column:
    """Routing view a pattern reads from; telemetry when unclear."""
    return _of_stream(pattern, "view")


def build_topic(*parts: Column | str) -> Column:
    """Topic from its levels: strings are literals, columns are values."""
    return F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def topic_level(topic: Column, index: int) -> Column:
    """Zero-based level of a topic, NULL when there is none."""
    return F.get(F.split(topic, "/"), F.lit(index))


def rebuilt_topic(pattern: str, columns: list[str]) -> Column:
    """Topic of a row: its own when present, else the pattern with wildcards filled.

    The first ``*`` takes the vehicle, the second the severity, metric or command,
    whichever the row has; ``columns`` are the columns the row offers.
    """

    def present(name: str) -> list[Column]:
        return [F.nullif(F.col(name), F.lit(""))] if name in columns else []

    vehicle = F.coalesce(*present("vehicle_id"), F.lit("unknown"))
    detail = F.coalesce(
        *present("severity"), *present("metric_type"), *present("command_type"), F.lit("unknown")
    )
    first, *others = pattern.split(ONE_LEVEL, 2)
    parts = [F.lit(first)]
    for filler, piece in zip((vehicle, detail), others):
        parts += [filler, F.lit(piece)]
    return F.coalesce(*present("topic"), F.concat(*parts))
