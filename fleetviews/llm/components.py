"""Connected components by contraction, for links that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def roots(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of longs, in any order and repeated. Returns (node, root) for every node.

    Each round hangs every node below its smallest neighbour, or itself, and carries the links
    over to those; rounds are logarithmic in the longest path. Everything is an aggregation with
    map-side combining or a join that adaptive execution may split, so a hub may have any number
    of links. Every round is written to the shared folder.
    """
    links = common.saved(links.filter("a != b").distinct(), "links")
    known: DataFrame | None = None
    while not links.isEmpty():
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = common.saved(
            both.groupBy("a").agg(F.min("b").alias("least")).select(
                F.col("a").alias("node"), F.least("a", "least").alias("root")
            ),
            "parents",
        )
        if known is None:
            known = up
        else:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            known = common.saved(
                known.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots"
            )
        left = up.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = up.select(F.col("node").alias("b"), F.col("root").alias("y"))
        links = common.saved(
            links.join(left, "a").join(right, "b").filter("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "links",
        )
    return known if known is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
