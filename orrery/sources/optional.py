"""Tables and columns that a deployment may lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def has_table(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def has_column(spark: SparkSession, path: str, column: str) -> bool:
    """Whether the table is there and has the column (by its exact name); only the schema is read."""
    return has_table(spark, path) and column in spark.read.parquet(path).columns


def optional_table(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """The table's ``columns`` (types by name): null where it lacks one, no rows where there is no table."""
    schema = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    if not has_table(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(path)
    there = set(rows.columns)
    return rows.select(*((F.col(f"`{c}`") if c in there else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))
