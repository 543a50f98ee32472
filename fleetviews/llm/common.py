"""What the operators share: row keys, tables in the shared folder, bounded membership bitmaps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetviews.session import work_dir

#: The white space of every contract: blank, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, no executor holds it."""
    path = work_dir(df.sparkSession, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row.

    The optimizer puts the definition of a column wherever a later filter or function uses it, inside
    lambdas too. Unpacking an array of one struct keeps it from doing so.
    """
    struct = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(struct)))


def keyed(docs: DataFrame, id_column: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with a long column that tells rows apart and sorts like the id; its name.

    Where ids are unique and not null, the id is the key and only the id column is read to
    know it. Otherwise rows are numbered by id (nulls last) in a table in the shared folder,
    so that every later read finds the same numbers.
    """
    key = free_name(docs, "row_key")
    repeated = docs.groupBy(id_column).count().filter((F.col("count") > 1) | F.col(id_column).isNull())
    if repeated.isEmpty():
        return docs.withColumn(key, F.col(id_column).cast("long")), key
    tie = free_name(docs, "tie")
    numbered = (
        docs.withColumn(tie, F.monotonically_increasing_id())
        .orderBy(F.col(id_column).asc_nulls_last(), tie)
        .withColumn(key, F.monotonically_increasing_id())
        .drop(tie)
    )
    return saved(numbered, "numbered"), key


def bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """One bit for each value of a long column, by its low bits: ``bits`` (a power of two) in all.

    The result has bits / 8 bytes however many keys there are; that is all that reaches the
    driver. A hit may be false, a miss never is.
    """
    slot = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1
    pages = keys.select(
        F.bitmap_bucket_number(slot).alias("page"), F.bitmap_bit_position(slot).alias("place")
    ).groupBy("page").agg(F.bitmap_construct_agg("place").alias("bitmap"))
    found = np.zeros(max(bits // 8, 4096), np.uint8)
    for page, piece in pages.collect():
        found[(page - 1) * 4096 : page * 4096] = np.frombuffer(bytes(piece), np.uint8)
    return found


def in_bitmap(found: np.ndarray, bits: int, values: np.ndarray) -> np.ndarray:
    """For each 64-bit value, whether its bit is set."""
    slot = values.astype(np.uint64) & np.uint64(bits - 1)
    return (found[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
