"""Structured Streaming jobs: windows, latest values, deduplication, debouncing and state machines.

Every job can be run over what there is (``run_once``, trigger availableNow) or
kept running. Sinks are idempotent: a micro-batch that is run again overwrites
its own folder.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orrery.operators.upsert import last_wins
from orrery.session import shared_dir, staged


def table_stream(spark: SparkSession, sf_dir: str, name: str, *, files: int | None = None) -> DataFrame:
    """A table's files as a stream; ``files`` bounds a micro-batch."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path + "*")


def run_once(stream: DataFrame, keys: list[str], mode: str = "update", rest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all there is; the last row of each key (all rows, if no keys).

    Each micro-batch writes its own folder under the shared one, so that a
    retried batch replaces itself. ``rest`` makes the rows that are due once
    the stream has ended from the states left: (key, state), both structs.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    schema = stream.schema.add("_batch", "long")

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{base}/out/{batch}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").start()
    q.awaitTermination()
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out") if q.lastProgress else spark.createDataFrame([], schema)
    done = (last_wins(rows, keys, ["_batch"]) if keys else rows).drop("_batch")
    if rest is None or not q.lastProgress:
        return done
    states = spark.read.format("statestore").load(f"{base}/checkpoint").select("key", F.col("value.groupState").alias("state"))
    return done.unionByName(staged(rest(states), "stream-rest"))


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], base: str) -> None:
    """Hand every micro-batch of what there is to ``write``, which may get one again after a restart; ``base`` holds the checkpoint."""
    q = stream.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").start()
    q.awaitTermination()


def windowed(stream: DataFrame, at: str, length: str, aggregates: list[Column], *, slide: str | None = None, keys: list[str] = (), late: str = "2 hours", start: str | None = None) -> DataFrame:
    """Aggregates by (sliding) event-time window and keys, under a watermark."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    w = F.window("_at", length, slide, start) if start else F.window("_at", length, slide) if slide else F.window("_at", length)
    out = timed.groupBy(w.alias("window"), *keys).agg(*aggregates)
    return out.select(F.unix_micros("window.start").alias("began"), *keys, *[c for c in out.columns if c not in ("window", *keys)])


def latest(stream: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The latest row of each key, as a late subscriber gets it."""
    best = stream.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_x"))
    return best.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in columns])


def deduplicated(stream: DataFrame, keys: list[str], at: str | None = None, late: str = "1 day") -> DataFrame:
    """One row per key; with ``at``, only repeats within the watermark are remembered."""
    if at is None:
        return stream.dropDuplicates(keys)
    return stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(keys)


def _timed(stream: DataFrame, key: str, columns: list[str], at: str, late: str) -> DataFrame:
    """The columns, with the seconds of ``at`` as an event time under a watermark."""
    return stream.select(key, *columns, F.col(at).cast("timestamp").alias("_at")).withWatermark("_at", late).groupBy(key)


def _wake(state: GroupState, seconds: float) -> bool:
    """Set the key's timer; false if the watermark is past it already."""
    at = math.ceil(seconds * 1000) + 1
    if at <= state.getCurrentWatermarkMs():
        return False
    state.setTimeoutTimestamp(at)
    return True


def debounced(stream: DataFrame, key: str, at: str, quiet: float, longest: float, late: str = "1 day") -> DataFrame:
    """Kicks merged into runs: a run is due at min(last kick + quiet, first kick + longest).

    ``at`` is a double of seconds. A run is emitted, with its number of kicks,
    when a later kick of the key or the watermark (``late`` behind the latest
    kick of any key) shows that it was due; the state is one run per key, and
    none once it is emitted. Runs that neither has reached when a stream ends
    are made by ``last_runs``.
    """

    def merge(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (None, None, 0)
        out = []
        for t in sorted(x for b in batches for x in b[at]):
            due = None if first is None else min(last + quiet, first + longest)
            if due is not None and t > due:
                out.append((k[0], first, due, n))
                first = None
            first, last, n = (t, t, 1) if first is None else (first, t, n + 1)
        due = min(last + quiet, first + longest)
        state.update((first, last, n))
        if state.hasTimedOut or not _wake(state, due):
            out.append((k[0], first, due, n))
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[key, "first", "due", "kicks"])

    kind = dict(stream.dtypes)[key]
    return _timed(stream, key, [at], at, late).applyInPandasWithState(merge, f"`{key}` {kind}, first double, due double, kicks long", "first double, last double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def last_runs(states: DataFrame, key: str, quiet: float, longest: float) -> DataFrame:
    """The runs of ``debounced`` that no later kick has shown to be due: all are once the stream has ended."""
    due = F.least(F.col("state.last") + quiet, F.col("state.first") + longest)
    return states.select(F.col(f"key.{key}").alias(key), "state.first", due.alias("due"), F.col("state.n").alias("kicks"))


def watched(stream: DataFrame, key: str, at: str, value: str, *, start: float, fade: float, fades: int = 2, timeout: float = 90 * 86_400.0, late: str = "1 day") -> DataFrame:
    """A watch per key: opened by a value of ``start`` or more, ended by ``fades`` values under ``fade``, or by ``timeout`` without a new value.

    ``at`` is a double of seconds; transitions (key, at, state, reason) are
    emitted. An ended watch can open again. Rows of a micro-batch are taken in
    the order of (at, value). A timeout is emitted at the key's next value or
    when the watermark (``late`` behind the latest row of any key) is past it;
    a key without an open watch leaves no state. Watches that are open when a
    stream ends are ended by ``last_timeouts``.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, low, seen = state.get if state.exists else (False, 0, 0.0)
        out = []
        for t, v in sorted((t, v) for b in batches for t, v in zip(b[at], b[value])):
            if opened and t - seen > timeout:
                out.append((k[0], seen + timeout, "ended", "timeout"))
                opened, low = False, 0
            if opened:
                low = low + 1 if v < fade else 0
                if low >= fades:
                    out.append((k[0], t, "ended", "faded"))
                    opened, low = False, 0
            elif v >= start:
                out.append((k[0], t, "watching", "rose"))
                opened, low = True, 0
            seen = t
        state.update((opened, low, seen))
        if opened and (state.hasTimedOut or not _wake(state, seen + timeout)):
            out.append((k[0], seen + timeout, "ended", "timeout"))
            opened = False
        if not opened:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[key, "at", "state", "reason"])

    kind = dict(stream.dtypes)[key]
    return _timed(stream, key, list(dict.fromkeys([at, value])), at, late).applyInPandasWithState(step, f"`{key}` {kind}, at double, state string, reason string", "opened boolean, low long, seen double", "append", GroupStateTimeout.EventTimeTimeout)


def last_timeouts(states: DataFrame, key: str, timeout: float = 90 * 86_400.0) -> DataFrame:
    """The ends of the watches of ``watched`` that are open when the stream has ended."""
    at = (F.col("state.seen") + timeout).alias("at")
    return states.filter("state.opened").select(F.col(f"key.{key}").alias(key), at, F.lit("ended").alias("state"), F.lit("timeout").alias("reason"))
