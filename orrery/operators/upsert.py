"""Write semantics as rewrites: upserts, mirrors, change lists and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of the greatest version of each key; an aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], only: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key; with ``only``, these columns of them."""
    if only is None:
        return new.select(*old.columns).unionByName(old.join(new, keys, "left_anti"))
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"a.{c}", f"b.{c}").alias(c)
        mine, theirs = F.col(f"a.{c}"), F.col(f"b.{c}")
        newer = F.when(F.col("_new"), theirs).otherwise(mine) if c in only else F.when(F.col("_old"), mine).otherwise(theirs)
        return newer.alias(c)

    return both.select(*map(value, old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.select(*old.columns).join(old, keys, "left_anti"))


def changes(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys whose ``columns`` differ (null-safe), with the kind of change and both values."""
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")
    differ = F.lit(False)
    for c in columns:
        differ |= ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    out = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys] + [kind.alias("change")]
    return both.filter(differ).select(*out, *[F.col(f"{s}.{c}").alias(f"{n}_{c}") for c in columns for s, n in (("a", "old"), ("b", "new"))])


def inventory_changes(stored: DataFrame, listed: DataFrame, key: str = "key", etag: str = "etag", *, complete: bool = True) -> DataFrame:
    """What a listing means for the stored inventory: added, changed and deleted keys.

    A partial listing never counts as deletions.
    """
    found = changes(stored, listed, [key], [etag])
    return found if complete else found.filter("change <> 'removed'")


def mirror(path: str, result: DataFrame, partition: str, scope: list | None = None) -> None:
    """Publish and prune: replace the partitions that the result has.

    ``scope`` names the partitions that were computed (a list of the caller,
    such as the nights of a run): those of them that the result lacks are
    deleted. Partitions outside it stay as they are.
    """
    result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    if not scope:
        return
    spark = result.sparkSession
    kept = {r[0] for r in result.filter(F.col(partition).isin(scope)).select(F.col(partition).cast("string")).distinct().collect()}  # at most the scope
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for value in {str(v) for v in scope} - kept:
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(partition, value)
        gone = jvm.org.apache.hadoop.fs.Path(path, name)
        gone.getFileSystem(conf).delete(gone, True)


def later_twins(df: DataFrame, same: list[str], by: str) -> DataFrame:
    """Rows for which an earlier row (less ``by``) has the same values."""
    first = df.groupBy(*same).agg(F.min(by).alias("_first"))
    return df.join(first, same).filter(F.col(by) > F.col("_first")).drop("_first")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free digest of all rows: xor and sum of their hashes, and their number."""
    h = F.xxhash64(*columns)
    return df.agg(F.bit_xor(h).alias("xor"), F.sum((h % 1_000_000_007).cast("long")).alias("sum"), F.count("*").alias("rows"))
