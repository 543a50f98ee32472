"""Mixing sources to target weights as a subset-sum fit over exact lengths.

A source with target T and total size S takes every document T div S times; the rest of its
budget is fitted by lengths. Documents are counted by exact length. Every length first gives its
share of the rest, rounded down; then seeded lengths give one document more while the open budget
exceeds ``WINDOW`` words; what is still open is filled by bounded-knapsack dynamic programming
over the documents that are left. Which documents of a length are taken is decided by a seeded
hash of the row key: those with the smallest hashes, found by counts of hash ranges, so that no
length has to be ranked as a whole, however many documents share it.

One task sees the lengths of one source: d different lengths add up to more than d * d / 2 words,
so they are at most the square root of twice the source's size. Sources stay a table, however many
there are: their order, which decides their weights, comes from range partitions and the row counts
of those, and each round of sharing again is one aggregation whose few sums the driver reads.

Null and empty texts have size 0 and are never taken. Null is a source of its own, last in order.
Rows that repeat an id are documents of their own. An empty table gives an empty result. Other
columns are carried by ``mixed`` unchanged.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Open budget, in words, that dynamic programming closes.
WINDOW = 8192
SEED = 17
#: Documents per hash range, about.
RANGE = 256


def n_words(data: bytes) -> int:
    """The number of words of a UTF-8 text: bytes that are no white space, at the start or after white space."""
    codes = np.frombuffer(data, np.uint8)
    space = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    return int(np.count_nonzero(space[:-1] & ~space[1:])) + int(len(space) > 0 and not space[0])


def sizes(docs: DataFrame, key: str) -> DataFrame:
    """key, doc_id, source and the number of words of every document.

    Words are counted in place. A regular expression's count would first list all words of a text, which
    takes an executor many times the memory of its texts.
    """

    def run(batches):
        for batch in batches:
            counts = [n_words(x.as_buffer()) for x in batch.column("text")]
            columns = [batch.column(c) for c in ("key", "doc_id", "source")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], ["key", "doc_id", "source", "size"])

    rows = docs.select(
        F.col(key).alias("key"), F.col("doc_id").cast("long"), F.col("source"),
        common.text_of().cast("binary").alias("text"),
    )
    kind = rows.schema["source"].dataType.simpleString()
    return rows.mapInArrow(run, f"key long, doc_id long, source {kind}, size long")


def targets(totals: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS) -> DataFrame:
    """``totals`` (no_source, source, source_size) with the target of each source: its weight's part
    of the budget, at most ``most`` times its size; what is above is shared again among the others by
    weight, until no target is above."""
    order = ["no_source", "source"]
    placed = common.saved(
        totals.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources"
    )
    before = F.sum("n_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # One row a partition, so this window is as small as the list of tasks.
    starts = placed.groupBy("part").agg(F.count("*").alias("n_part")).select(
        "part", F.coalesce(before, F.lit(0)).alias("start")
    )
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = common.saved(
        placed.join(F.broadcast(starts), "part").select(*order, "source_size", weight.alias("weight")), "weights"
    )

    def above(level: float | None) -> Column:
        return F.lit(False) if level is None else F.col("weight") * F.lit(level) > most * F.col("source_size")

    level, full = None, -1
    while True:
        found = weighed.agg(
            F.sum("source_size").alias("size"),
            F.count_if(above(level)).alias("full"),
            F.sum(F.when(above(level), most * F.col("source_size"))).alias("given"),
            F.sum(F.when(~above(level), F.col("weight"))).alias("open"),
        ).first()
        if not found.open or found.full == full:
            break
        level, full = (share * found.size - (found.given or 0)) / found.open, found.full
    target = F.when(above(level), (most * F.col("source_size")).cast("double"))
    return weighed.select(
        *order, "source_size", target.otherwise(F.col("weight") * F.lit(level).cast("double")).alias("target")
    )


def fitted(lengths: list[int], counts: list[int], budget: int, seed: int, window: int = WINDOW) -> list[int]:
    """How many documents of each length to take so that the lengths add up to ``budget`` as nearly
    as the last ``window`` words allow, never above it."""
    whole = sum(n * c for n, c in zip(lengths, counts))
    if not whole or budget <= 0:
        return [0] * len(lengths)
    if budget >= whole:
        return list(counts)
    taken = [c * budget // whole for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken))
    order = list(range(len(lengths)))
    random.Random(seed).shuffle(order)
    while left > window:
        before = left
        for i in order:
            if left > window and lengths[i] <= left and taken[i] < counts[i]:
                taken[i] += 1
                left -= lengths[i]
        if left == before:
            break
    # Bounded knapsack: bit s is set when some choice adds up to s. Counts split into powers of two.
    window = min(left, window)
    mask, items, reached = (1 << window + 1) - 1, [], [1]
    for i in order:
        more, lot = min(counts[i] - taken[i], window // lengths[i] if lengths[i] else 0), 1
        while more > 0:
            lot = min(lot, more)
            grown = reached[-1] | reached[-1] << lot * lengths[i] & mask
            if grown != reached[-1]:
                items.append((i, lot))
                reached.append(grown)
            more, lot = more - lot, lot * 2
        if reached[-1] >> window & 1:
            break
    total = reached[-1].bit_length() - 1
    for place in range(len(items), 0, -1):
        if not reached[place - 1] >> total & 1:
            i, lot = items[place - 1]
            taken[i] += lot
            total -= lot * lengths[i]
    return taken


def _chance(seed: int) -> Column:
    """A seeded hash of the key, as a number from 0 to 2 ** 62."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("key")), 2)


def copies(rows: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS, seed=SEED) -> DataFrame:
    """``rows`` (key, doc_id, source, size) with source_size, target and the times each is taken."""
    # Nulls get a name of their own beside the source, so that joins need no null-safe keys.
    rows = common.saved(
        rows.withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit(""))),
        "sizes",
    )
    group = ["no_source", "source"]
    lengths = common.saved(rows.groupBy(*group, "size").agg(F.count("*").alias("n")), "lengths")
    totals = lengths.groupBy(*group).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = targets(totals, weights, share, most)

    def fit(lots: pd.DataFrame) -> pd.DataFrame:
        lots = lots.sort_values("size")
        size, target = int(lots.source_size.iloc[0]), round(float(lots.target.iloc[0]))
        epochs = min(target // size, most) if size else 0
        rest = target - epochs * size if epochs < most else 0
        taken = fitted(lots["size"].tolist(), lots.n.tolist(), rest, seed)
        return lots[["no_source", "source", "size", "n", "source_size", "target"]].assign(epochs=epochs, extra=taken)

    chosen = common.saved(
        lengths.join(plan, group).groupBy(*group).applyInPandas(
            fit, "no_source boolean, source string, size long, n long, source_size long, target double,"
            " epochs long, extra long"
        ),
        "chosen",
    )
    # Ranges of the hash: full ones below the cut are taken whole, the one at the cut is ranked.
    lot = [*group, "size"]
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n") / RANGE)).cast("long")
    marked = rows.withColumn("chance", _chance(seed)).join(chosen, lot).withColumn(
        "range", (F.col("chance") / F.lit(float(1 << 62)) * ranges).cast("long")
    )
    partial = marked.filter("extra > 0 AND extra < n")
    before = F.sum("in_range").over(
        Window.partitionBy(*lot).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    )
    cuts = (
        partial.groupBy(*lot, "extra", "range").agg(F.count("*").alias("in_range"))
        .withColumn("below", F.coalesce(before, F.lit(0)))
        .filter("below < extra AND below + in_range >= extra")
        .select(*lot, F.col("range").alias("cut_range"), (F.col("extra") - F.col("below")).alias("at_cut"))
    )
    cuts = common.saved(cuts, "cuts")
    ranked = (
        partial.join(cuts.withColumnRenamed("cut_range", "range"), [*lot, "range"])
        .withColumn("rank", F.row_number().over(Window.partitionBy(*lot).orderBy("chance", "key")))
        .filter("rank <= at_cut")
        .select("key", F.lit(True).alias("picked"))
    )
    marked = marked.join(cuts, lot, "left").join(ranked, "key", "left")
    extra = (
        F.when(F.col("extra") >= F.col("n"), 1)
        .when(F.col("extra") == 0, 0)
        .when(F.col("range") < F.col("cut_range"), 1)
        .when(F.col("picked"), 1)
        .otherwise(0)
    )
    times = F.when(F.col("size") > 0, F.col("epochs") + extra).otherwise(0).cast("long")
    source = F.when(F.col("no_source"), F.lit(None)).otherwise(F.col("source"))
    return marked.select("key", "doc_id", source.alias("source"), "size", "source_size", "target", times.alias("times"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns."""
    rows, key = common.keyed(docs)
    times = free = common.free_name(rows, "times")
    chosen = copies(sizes(rows, key)).filter("times > 0").select(F.col("key").alias(key), F.col("times").alias(times))
    taken = rows.join(common.saved(chosen, "copies"), key)
    return taken.withColumn(free, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = common.keyed(common.documents(spark, sf_dir))
    return copies(sizes(docs, key)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )
