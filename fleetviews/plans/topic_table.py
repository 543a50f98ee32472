"""Topic patterns against a registry of any size, by equality of shapes and texts.

A pattern's shape says where its wildcards are: how many levels it fixes, which of them are ``*``, and
whether ``>`` follows. A topic matches a pattern exactly when the topic, with the shape's ``*`` levels and
trailing levels put in, reads like the pattern. So matching is an equi-join on shape and text: every topic is
read in the shapes there are for its number of levels, which are few however many patterns there are. No
expression, regular expression or comparison is made per registry entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.topics import ONE_LEVEL, REST

SHAPE = ("_rest", "_stars")


def _levels(text: Column) -> Column:
    return F.split(text, "/")


def shaped(patterns: DataFrame, pattern: str) -> DataFrame:
    """``patterns`` with its shape (``_rest``; ``_stars``, a digit for each fixed level) and ``_text``."""
    levels = _levels(F.col(pattern))
    rest_at = F.array_position(levels, REST)
    fixed = F.when(rest_at > 0, F.slice(levels, F.lit(1), (rest_at - 1).cast("int"))).otherwise(levels)
    digits = F.transform(fixed, lambda level: F.when(level == ONE_LEVEL, "1").otherwise("0"))
    return patterns.select(
        "*", (rest_at > 0).alias("_rest"), F.array_join(digits, "").alias("_stars"), F.array_join(fixed, "/").alias("_text")
    )


def read_as(topics: DataFrame, topic: str, shapes: DataFrame) -> DataFrame:
    """Every topic as it reads in each of the shapes that its levels fit; empty levels fit no wildcard."""
    known = shapes.select(*SHAPE).distinct().select("*", F.length("_stars").alias("_depth"))
    size = F.size("_levels")
    whole = F.struct(F.lit(False).alias("_rest"), size.alias("_depth"))
    heads = F.transform(F.sequence(F.lit(0), size - 1), lambda n: F.struct(F.lit(True).alias("_rest"), n.alias("_depth")))
    cut = topics.withColumn("_levels", _levels(F.col(topic))).select(
        "*", F.inline(F.concat(F.array(whole), heads))
    ).where(~F.col("_rest") | (size - F.col("_depth") > 1) | (F.element_at("_levels", -1) != ""))
    starred = lambda i: F.substr(F.col("_stars"), i + 1, F.lit(1)) == "1"
    head = F.slice("_levels", F.lit(1), F.col("_depth"))
    fits = ~F.exists(F.transform(head, lambda x, i: starred(i) & (x == "")), lambda lost: lost)
    text = F.array_join(F.transform(head, lambda x, i: F.when(starred(i), ONE_LEVEL).otherwise(x)), "/")
    return cut.join(known, ["_rest", "_depth"]).where(fits).select(*topics.columns, *SHAPE, text.alias("_text"))


def _least(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("position").alias("position"))


def resolved(entries: DataFrame, patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """``patterns`` with the ``mapped_pattern``, ``mv`` and ``time_column`` of the entry chosen for each.

    ``entries`` has ``position``, ``pattern``, ``mv`` and ``time_column``. The choice is that of
    :meth:`Registry.resolve`: the same text, else an entry that covers the pattern, else one that it covers,
    and the first of several. Each distinct pattern is resolved once.
    """
    asked = patterns.select(F.col(column).alias("_asked")).where(F.col(column).isNotNull()).distinct()
    shapes = shaped(entries.select("position", "pattern"), "pattern")
    same = _least(entries, "pattern").select(F.col("pattern").alias("_asked"), "position")
    covering = read_as(asked, "_asked", shapes).join(_least(shapes, *SHAPE, "_text"), [*SHAPE, "_text"])
    wild = shaped(asked.where(F.col("_asked").contains(ONE_LEVEL) | F.col("_asked").contains(REST)), "_asked")
    sample = F.replace(F.replace("pattern", F.lit(ONE_LEVEL), F.lit("x")), F.lit(REST), F.lit("x/y"))
    covered = _least(read_as(entries.select("position", sample.alias("_topic")), "_topic", wild), *SHAPE, "_text")
    tiers = (asked.join(same, "_asked"), covering, wild.join(covered, [*SHAPE, "_text"]))
    ranked = [t.select("_asked", F.struct(F.lit(i).alias("tier"), "position").alias("_choice")) for i, t in enumerate(tiers)]
    choice = ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).groupBy("_asked").agg(F.min("_choice").alias("_choice"))
    named = entries.select(
        F.col("position").alias("_position"), F.col("pattern").alias("mapped_pattern"), "mv",
        F.col("time_column").cast("string").alias("time_column"),
    )
    chosen = choice.join(named, F.col("_choice.position") == F.col("_position")).select(
        "_asked", "mapped_pattern", "mv", "time_column"
    )
    return patterns.join(chosen, F.col(column) == F.col("_asked"), "left").drop("_asked")
