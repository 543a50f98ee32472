"""Durations, the explicit "now", and time bounds."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

# Accepted duration units, and the closed list the web queries accept.
DURATION_PATTERN = r"^(\d+)(d|h|hr|min|m|s)$"
UNIT_SECONDS = {"d": 86400, "h": 3600, "hr": 3600, "min": 60, "m": 60, "s": 1}
PRESET_DURATIONS = {
    "15m": timedelta(minutes=15),
    "30m": timedelta(minutes=30),
    "1h": timedelta(hours=1),
    "4h": timedelta(hours=4),
    "8h": timedelta(hours=8),
    "24h": timedelta(hours=24),
    "48h": timedelta(hours=48),
}
# End of fixed values.
MOST_SECONDS = (2**63 - 1) // 1_000_000


def parse_duration(text: str | timedelta) -> timedelta:
    """``1h``, ``30min``, ``2d``, ``10s`` as an interval; anything else is an error."""
    if isinstance(text, timedelta):
        return text
    found = re.match(DURATION_PATTERN, text.strip(), re.IGNORECASE)
    if not found:
        raise ValueError(f"invalid duration {text!r}: use e.g. 1h, 30min, 2d, 10s")
    return timedelta(seconds=int(found[1]) * UNIT_SECONDS[found[2].lower()])


def duration_column(text: Column) -> Column:
    """The same for a column of texts, as a day-time interval; NULL when invalid, or longer than an
    interval can be (2 ** 63 microseconds)."""
    clean = F.lower(F.trim(text))
    amount = F.regexp_extract(clean, DURATION_PATTERN, 1)
    unit = F.regexp_extract(clean, DURATION_PATTERN, 2)
    factor = F.create_map(*[F.lit(x) for pair in UNIT_SECONDS.items() for x in pair])[unit]
    seconds = F.try_multiply(F.nullif(amount, F.lit("")).try_cast("bigint"), factor)
    rest = F.pmod(seconds, F.lit(86400))
    days = ((seconds - rest) / 86400).cast("int")
    return F.when(
        seconds <= MOST_SECONDS, F.make_dt_interval(days=days, secs=rest.cast("decimal(18,6)"))
    )


def preset_duration(text: str | None) -> timedelta | None:
    """Duration from the closed list; an unknown text gives no bound."""
    return PRESET_DURATIONS.get(text.strip().lower()) if text else None


def moment(value: datetime | str | Column | None) -> Column:
    """"Now" as a column: the given instant (naive means UTC) or the current time."""
    if value is None:
        return F.current_timestamp()
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    text = value.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f+00:00")
    return F.to_timestamp(F.lit(text))


def interval(span: timedelta) -> Column:
    return F.lit(span)


def newer_than(time_column: str, span: timedelta | str, as_of=None) -> Column:
    """Strict lower bound, no upper bound."""
    return F.col(time_column) > moment(as_of) - interval(parse_duration(span))


def micros_between(later: Column, earlier: Column) -> Column:
    """Interval as microseconds, for outputs that cannot carry an interval."""
    return F.unix_micros(later) - F.unix_micros(earlier)


def epoch_millis_to_iso(millis: Column, as_of=None) -> Column:
    """ISO text in UTC of an epoch-millisecond column; "now" when absent."""
    instant = F.coalesce(F.timestamp_millis(millis), moment(as_of))
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
