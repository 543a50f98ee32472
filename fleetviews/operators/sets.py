"""History and live rows as one sequence, and the two de-duplication policies.

Copies of one key may be many: they are always folded by an aggregate (combined on the
map side) before any join, and joins then meet unique keys only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

DEDUP_KEY = ("vehicle_id", "event_time")


def tagged(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(source))


def history_and_live(history: DataFrame, live: DataFrame) -> DataFrame:
    """Both parts, each row tagged with where it came from."""
    return tagged(history, "history").unionByName(
        tagged(live, "live"), allowMissingColumns=True
    )


def known_keys(history: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Distinct history keys under names of their own."""
    return history.select(*[F.col(k).alias(f"_known_{k}") for k in keys]).distinct()


def same_key(keys: tuple[str, ...]) -> Column:
    """Key equality in which NULL equals NULL; still an equi-join for the planner."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in keys])


def live_not_in_history(
    history: DataFrame,
    live: DataFrame,
    keys: tuple[str, ...] = DEDUP_KEY,
    arrival: str | None = None,
) -> DataFrame:
    """Buffer policy: a key is emitted once, and not at all if history has it.

    Of several live rows with one key the earliest by ``arrival`` stays (the smallest
    row, without it).
    """
    rest = [c for c in live.columns if c not in keys]
    rest.sort(key=lambda c: c != arrival)
    if rest:
        folded = live.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
        once = folded.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    else:
        once = live.distinct()
    return once.join(known_keys(history, keys), same_key(keys), "left_anti").select(*live.columns)


def live_minus_first_repeat(
    history: DataFrame,
    live: DataFrame,
    arrival: str,
    keys: tuple[str, ...] = DEDUP_KEY,
) -> DataFrame:
    """One-shot policy: a history key suppresses only the first live row with that key.

    ``arrival`` numbers live rows uniquely in arrival order. The suppressed rows are the
    minimum arrival of each known key; they leave by a join on that unique number.
    """
    first = live.groupBy(*keys).agg(F.min(arrival).alias("_first"))
    suppressed = first.join(known_keys(history, keys), same_key(keys), "left_semi").select(
        F.col("_first").alias("_suppressed")
    )
    return live.join(suppressed, F.col(arrival) == F.col("_suppressed"), "left_anti")


def static_then_generated(static: DataFrame, generated: DataFrame) -> DataFrame:
    """Static mappings followed by generated ones; ``position`` keeps the precedence."""
    offset = static.agg(F.coalesce(F.max("position") + 1, F.lit(0))).scalar()
    moved = generated.withColumn("position", (F.col("position") + offset).cast("int"))
    return static.unionByName(moved, allowMissingColumns=True)
