"""A verified, versioned mirror of inputs: a table that changes as a whole or not at all.

A version is built in a folder of its own, one piece an input. A piece is done
when it has been read back with the rows and the order-free digest of its input;
a record of that is written beside it. A run that is cut leaves done pieces and
their records, which the next run of the same version keeps if the input's
digest is still the same, and the old version stays what readers see. When every
input is done, a manifest with all records is put in its place by one rename,
which is what makes the version current; versions beyond the last ``keep`` are
then removed.

Folders below the root: ``data/<version>/<input>``, ``records/<version>``,
``manifests/<version>``. A version is a number that grows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "input string, rows long, xor long, sum long"


class MirrorError(RuntimeError):
    """A mirror that can't be read, or a piece that isn't its input."""


def digests(df: DataFrame, by: str) -> DataFrame:
    """Rows, and an order-free digest of them, by the value of a column (null: the empty string)."""
    h = F.xxhash64(*[c for c in sorted(df.columns) if c != by])
    return df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("input")).agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).cast("decimal(38,0)").alias("_sum")).select("input", "rows", "xor", F.pmod("_sum", F.lit(2**61)).cast("long").alias("sum"))


class Mirror:
    """``root`` is a folder that driver and executors share; ``by`` the column that names an input."""

    def __init__(self, spark: SparkSession, root: str, by: str, keep: int = 2):
        if keep < 1:
            raise ValueError("the current version is kept: keep >= 1")
        self.spark, self.root, self.by, self.keep = spark, root.rstrip("/"), by, keep

    def _path(self, *parts: object):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *map(str, parts)]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions that were completed, in order; the last is the current one."""
        at, fs = self._path("manifests"), self._fs()
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n) for n in found if n.isdigit())

    def records(self, version: int) -> DataFrame:
        """What is done of a version."""
        at = self._path("records", version)
        if not self._fs().exists(at):
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.option("recursiveFileLookup", "true").schema(RECORD).parquet(at.toString())

    def build(self, df: DataFrame, version: int, limit: int | None = None) -> bool:
        """Add what a version lacks, ``limit`` inputs at most (for runs of bounded length); whether it is complete now.

        All pieces of a run are written by one job and read back by another;
        nothing but counts and digests comes back, a row for each input.
        """
        if version in self.versions():
            raise MirrorError(f"version {version} is complete")
        wanted = digests(df, self.by)
        same = ["input", "rows", "xor", "sum"]
        done = self.records(version).distinct()
        todo = wanted.join(done, same, "left_anti")
        names = [r[0] for r in (todo.orderBy("input").limit(limit) if limit else todo).select("input").collect()]  # one name an input
        if names:
            chosen = df.withColumn("_input", F.coalesce(F.col(self.by).cast("string"), F.lit(""))).filter(F.col("_input").isin(names))
            at = self._path("data", version).toString()
            # the empty name is a value like others; a piece that was begun before is replaced whole
            labelled = chosen.withColumn("_piece", F.hex(F.col("_input").cast("binary"))).withColumn("_piece", F.concat(F.lit("x"), "_piece")).drop("_input")
            labelled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_piece").parquet(at)
            checked = digests(self._pieces(version).filter(F.col("_piece").isin(["x" + n.encode().hex().upper() for n in names])).drop("_piece"), self.by)
            good = checked.join(wanted, same)
            good.write.parquet(self._path("records", version, uuid.uuid4().hex).toString())
        state = wanted.join(self.records(version).distinct().withColumn("done", F.lit(True)), same, "left")
        if not state.filter("done is null").isEmpty():
            return False
        building = self._path(f".manifest-{version}-{uuid.uuid4().hex}")
        state.drop("done").coalesce(1).write.parquet(building.toString())
        fs = self._fs()
        fs.mkdirs(self._path("manifests"))
        if not fs.rename(building, self._path("manifests", version)):
            raise MirrorError(f"version {version} could not be put in place")
        self._prune()
        return True

    def _prune(self) -> None:
        kept = self.versions()
        for old in kept[: -self.keep]:
            # readers lose sight of a version before its data go
            for part in ("manifests", "records", "data"):
                self._fs().delete(self._path(part, old), True)

    def _pieces(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self._path("data", version).toString())

    def read(self, version: int | None = None, *, verify: bool = False) -> DataFrame:
        """The rows of a complete version (the current one); ``verify`` compares every piece with the manifest first."""
        there = self.versions()
        if not there or version is not None and version not in there:
            raise MirrorError(f"no complete version {version if there and version is not None else ''} below {self.root}")
        version = there[-1] if version is None else version
        manifest = self.spark.read.parquet(self._path("manifests", version).toString())
        # pieces of inputs that have gone from a version while it was built are not in its manifest
        listed = manifest.select(F.concat(F.lit("x"), F.hex(F.col("input").cast("binary"))).alias("_piece"))
        rows = self._pieces(version).join(listed, "_piece", "left_semi").drop("_piece")
        if verify:
            same = ["input", "rows", "xor", "sum"]
            found = digests(rows, self.by)
            wrong = manifest.join(found, same, "left_anti").unionByName(found.join(manifest, same, "left_anti"))
            bad = [r[0] for r in wrong.select("input").distinct().orderBy("input").limit(5).collect()]
            if bad:
                raise MirrorError(f"damaged pieces of version {version}: {bad}")
        return rows
