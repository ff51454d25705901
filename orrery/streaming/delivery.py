"""What listeners and alerts need of a stream: live curves, replay from an id, and alerts that are sent once.

All state is in folders of the shared file system, written whole and named by
the micro-batch or attempt that writes them; a batch that is run again replaces
its own folder, so a restart at any point repeats nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.functions.sky import finite


def live_bins(stream: DataFrame, keys: list[str], at: Column, value: str, error: str, width: float) -> DataFrame:
    """Bins of a live curve: of each key and stretch of ``width``, rows and weighted sums.

    The sums are whole numbers (of millionths of a value, weighted by the
    inverse square of the error in whole units), so that bins are the same
    however rows are split into micro-batches and in whatever order they come;
    a micro-batch re-makes the bins of its own rows only. Values and errors that
    are null or not finite, and errors of zero or less, take no part.
    """
    good = stream.filter((finite(error) > 0) & finite(value).isNotNull() & at.isNotNull())
    weight = F.greatest(F.lit(1), F.round(1e4 / (F.col(error) * F.col(error)))).cast("decimal(18,0)")
    level = F.round(F.col(value) * 1e6).cast("decimal(18,0)")
    rows = good.select(*keys, F.floor(at / width).alias("bin"), weight.alias("_w"), level.alias("_v"))
    return rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.sum("_w").alias("weight"), F.sum((F.col("_w") * F.col("_v")).cast("decimal(38,0)")).alias("weighted"), F.min("_v").alias("low"), F.max("_v").alias("high"))


def live_curve(bins: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Means and errors of bins: key, time of the bin's middle, mean, error, n and range."""
    mean = (F.col("weighted").cast("double") / F.col("weight").cast("double")) / 1e6
    return bins.select(*keys, ((F.col("bin") + 0.5) * width).alias("at"), mean.alias("mean"), (100 / F.sqrt(F.col("weight").cast("double"))).alias("error"), "n", ((F.col("high") - F.col("low")).cast("double") / 1e6).alias("range"))


class EventRing:
    """The last ``size`` events of each topic, by an id that grows, for listeners that come back.

    ``append`` is for foreachBatch. Batches are kept apart until ``trim`` puts
    them into one ring; what a listener gets is the same before and after.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, topic: str = "topic", id_col: str = "id", size: int = 1000):
        self.spark, self.root, self.schema, self.topic, self.id, self.size = spark, root.rstrip("/"), schema, topic, id_col, size

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _parts(self) -> list[str]:
        """Folders that count: the newest ring and the batches after it."""
        fs, at = self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration()), self._path("")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        rings = [int(n.split("-")[1]) for n in names if n.startswith("ring-")]
        newest = max(rings, default=-1)
        batches = [n for n in names if n.startswith("batch-") and int(n.split("-")[1]) > newest]
        return [f"{self.root}/{n}" for n in [*([f"ring-{newest}"] if rings else []), *batches]]

    def _last(self, rows: DataFrame) -> DataFrame:
        by = Window.partitionBy(self.topic).orderBy(F.desc(self.id))
        return rows.dropDuplicates([self.topic, self.id]).withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= self.size).drop("_n")

    def append(self, df: DataFrame, batch: int) -> None:
        """Keep a micro-batch: of each topic, no more than the ring holds."""
        self._last(df).write.mode("overwrite").parquet(f"{self.root}/batch-{batch}")

    def events(self) -> DataFrame:
        parts = self._parts()
        rows = self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)
        return self._last(rows)

    def trim(self, batch: int) -> None:
        """Put everything up to a batch that is done into one ring; a ring is seen once it is whole."""
        staging = f"{self.root}/_ring-{uuid.uuid4().hex}"
        self.events().write.parquet(staging)
        fs = self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.rename(self._path(staging.rpartition("/")[2]), self._path(f"ring-{batch}"))

    def catch_up(self, after: dict[str, int]) -> DataFrame:
        """What listeners (topic: the last id they saw) have missed, in order; ``refetch`` where the ring no longer reaches back to it.

        A listener that saw nothing (0) has loaded the present state itself and
        gets nothing but the topic's latest event.
        """
        seen = self.spark.createDataFrame(list(after.items()), f"`{self.topic}` string, _after long")
        held = self.events().join(F.broadcast(seen), self.topic)  # a row for each listener's topic
        all_of = Window.partitionBy(self.topic)
        held = held.withColumns({"_first": F.min(self.id).over(all_of), "_newest": F.max(self.id).over(all_of), "_held": F.count("*").over(all_of)})
        missed = F.when(F.col("_after") == 0, F.col(self.id) == F.col("_newest")).otherwise(F.col(self.id) > F.col("_after"))
        lost = (F.col("_after") > 0) & (F.col("_held") >= self.size) & (F.col("_first") > F.col("_after") + 1)
        return held.filter(missed).withColumn("refetch", lost).drop("_after", "_first", "_newest", "_held")


class SendFailed(Exception):
    """A send that certainly did not happen, and may be tried again."""


class AlertOutbox:
    """Alerts that are claimed before they are sent, and sent once.

    ``claim`` stores those of a micro-batch whose key has no claim yet;
    ``deliver`` sends what is due, ``most`` at a time, marking each as being sent
    before it is: one whose outcome is unknown (a crash in between) is never sent
    again, one that certainly failed is, up to ``attempts`` times.
    """

    def __init__(self, spark: SparkSession, root: str, columns: str, key: str, attempts: int = 5):
        self.spark, self.root, self.columns, self.key, self.attempts = spark, root.rstrip("/"), columns, key, attempts

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/{name}")

    def claims(self) -> DataFrame:
        return self._read("claims", f"{self.columns}, _batch long")

    def claim(self, df: DataFrame, batch: int, first: list[Column] = ()) -> None:
        """For foreachBatch: of each key the row that comes first in the order of ``first``."""
        names = [c for c in df.columns if c != self.key]
        order = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(first or map(F.col, names))))
        fresh = df.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min_by(F.struct(*names), order).alias("_row")).select(self.key, "_row.*").select(*df.columns)
        # a batch that is run again is compared with the claims of the others
        other = self.claims().filter(F.col("_batch") != batch).select(self.key)
        fresh.join(other, self.key, "left_anti").select(*df.columns).withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.root}/claims/{batch}")

    def states(self) -> DataFrame:
        """Each claim with its ``state`` (waiting, sent, failed or unknown) and ``tries``."""
        kind = dict(self.claims().dtypes)[self.key]
        marks = self._read("marks", f"`{self.key}` {kind}, attempt string, mark string")
        by_try = marks.groupBy(self.key, "attempt").agg(F.max(F.when(F.col("mark") != "sending", F.col("mark"))).alias("end"))
        per = by_try.groupBy(self.key).agg(F.count("*").alias("tries"), F.max(F.col("end") == "sent").alias("_sent"), F.max(F.col("end").isNull()).alias("_open"))
        state = F.when(F.col("_sent"), "sent").when(F.col("_open"), "unknown").when(F.col("tries") >= self.attempts, "failed").otherwise("waiting")
        return self.claims().join(per, self.key, "left").withColumns({"state": state, "tries": F.coalesce("tries", F.lit(0))}).drop("_sent", "_open", "_batch")

    def _mark(self, keys: list, attempt: str, mark: str) -> None:
        kind = dict(self.claims().dtypes)[self.key]
        rows = self.spark.createDataFrame([(k, attempt, mark) for k in keys], f"`{self.key}` {kind}, attempt string, mark string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/marks/{attempt}-{mark}")

    def deliver(self, send: Callable[[dict], None], most: int = 100) -> int:
        """Send up to ``most`` alerts from the driver; how many were sent. ``send`` raises SendFailed for a send that did not happen."""
        due = [r.asDict() for r in self.states().filter("state = 'waiting'").orderBy("tries", self.key).limit(most).collect()]
        if not due:
            return 0
        attempt, sent, failed = uuid.uuid4().hex, [], []
        self._mark([r[self.key] for r in due], attempt, "sending")
        try:
            for r in due:
                try:
                    send({k: v for k, v in r.items() if k not in ("state", "tries")})
                    sent.append(r[self.key])
                except SendFailed:
                    failed.append(r[self.key])
        finally:  # what came before an unknown outcome is known
            begun = len(sent) + len(failed)
            for keys, mark in ((sent, "sent"), (failed + [r[self.key] for r in due[begun + 1 :]], "failed")):
                if keys:
                    self._mark(keys, attempt, mark)
        return len(sent)
