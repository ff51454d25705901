"""The labelled rows that a classifier learns from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of at most ``max_rows`` labelled rows outside the held-out fifth.

    Where there are more, those with the smallest hashes of their id are taken.
    The ids are broadcast, being bounded by ``max_rows``. Null labels and ids
    take no part; an id counts once, with its greatest label and text.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    picked = rows.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    return found.groupBy("id").agg(F.coalesce(F.max("text"), F.lit("")).alias("text"), F.max("y").alias("y")).select("text", "y")
