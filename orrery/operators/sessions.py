"""Sessions, runs and spans: ordered rows cut into islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str | Column], starts: Column, name: str = "island") -> DataFrame:
    """Number the islands of each key from 1; ``starts`` says where a new one begins (null: no)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.coalesce(starts.cast("int"), F.lit(0))).withColumn(name, 1 + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.first("_new").over(w)).drop("_new")


def gap_sessions(df: DataFrame, keys: list[str], at: str, gap: float, *, ties: list[str] | None = None, name: str = "session") -> DataFrame:
    """Sessions of rows at most ``gap`` apart (a gap of exactly ``gap`` joins)."""
    order = [at, *(ties or [])]
    w = Window.partitionBy(*keys).orderBy(*order)
    return islands(df, keys, order, F.col(at) - F.lag(at).over(w) > gap, name)


def runs(df: DataFrame, keys: list[str], order: list[str], changing: str, name: str = "run") -> DataFrame:
    """Runs of consecutive rows with the same value of ``changing`` (null equals null)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(F.struct(changing)).over(w)
    return islands(df, keys, order, before.isNotNull() & ~F.col(changing).eqNullSafe(before[changing]), name)


def merged_spans(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Spans of each key, with overlapping (or touching) ones merged into one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return islands(df, keys, [start, end], F.col(start) > reach, "_span").groupBy(*keys, "_span").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_span")


def state_spans(df: DataFrame, keys: list[str], order: list[str], at: str) -> DataFrame:
    """Each row's state lasts until the next row of its key: adds ``until`` (null for the last)."""
    return df.withColumn("until", F.lead(at).over(Window.partitionBy(*keys).orderBy(*order)))
