"""Session settings, table loading and cluster-shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", app: str = "orrery", **extra: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow; ``extra`` adds settings (dots as ``__``)."""
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where a local session names none (tests) a temporary folder is made once and
    kept for the session; on a cluster the setting is required.
    """
    sc = spark.sparkContext
    found = sc.getConf().get(CHECKPOINT_CONF) or getattr(sc, "_orrery_shared", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="orrery-")
        sc._orrery_shared = found
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage with files that survive lost executors, and gives later
    plans true sizes. The folder is scratch space owned by the cluster.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
