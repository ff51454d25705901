"""Catalogue upkeep: deltas, polygons, status updates and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.upsert import last_wins


def unbroken(deltas: DataFrame, since: DataFrame, hour: str = "hour") -> DataFrame:
    """The deltas that follow the full copy without a gap: those of its next hour, the one after, and so on.

    ``since`` is one row with the hour of the full copy. Hours are few (a list
    of files), so they are ranked as one list.
    """
    hours = deltas.select(hour).distinct().crossJoin(F.broadcast(since.select(F.col(hour).alias("_since")))).filter(F.col(hour) > F.col("_since"))
    ranked = hours.withColumn("_n", F.row_number().over(Window.orderBy(hour))).filter(F.col(hour) == F.col("_since") + F.col("_n"))
    return deltas.join(ranked.select(hour), hour, "left_semi")


def apply_deltas(full: DataFrame, deltas: DataFrame, key: str, hour: str = "hour") -> DataFrame:
    """The full copy with the rows of later hours over it, up to the first hour that lacks."""
    since = full.agg(F.max(hour).alias(hour))
    return last_wins(full.unionByName(unbroken(deltas, since, hour)), [key], [hour])


def inside_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd crossing test of a point in the plane."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        if y1 == y2:
            continue
        at = x1 + (y - y1) / (y2 - y1) * (x2 - x1)
        crossings = crossings + F.when(((y > y1) != (y > y2)) & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def set_status(rows: DataFrame, selected: DataFrame, key: str, status: str) -> DataFrame:
    """Rows with the status of the selected ones overwritten; ``changed`` where that made a difference."""
    marked = rows.join(selected.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    return marked.withColumn("changed", hit & ~F.col("status").eqNullSafe(F.lit(status))).withColumn("status", F.when(hit, status).otherwise(F.col("status"))).drop("_hit")


def dirty_parents(changed: DataFrame, parent: str) -> DataFrame:
    """The parents of rows that were changed, to be built anew."""
    return changed.filter("changed").select(parent).distinct()


def moonfree_brightness(samples: DataFrame, preferred: list[str], *, least: int, nights: int) -> DataFrame:
    """Median of the newest nights' medians, of each night's first preferred filter with ``least`` Moon-down samples.

    Rows: site, night, filter, moon_altitude, sky.
    """
    order = F.array_position(F.array(*map(F.lit, preferred)), F.col("filter"))
    dark = samples.filter((F.col("moon_altitude") < 0) & (order > 0) & F.col("sky").isNotNull()).withColumn("_o", order)
    per = dark.groupBy("site", "night", "filter", "_o").agg(F.count("*").alias("n"), F.median("sky").alias("sky")).filter(F.col("n") >= least)
    first = per.groupBy("site", "night").agg(F.min_by("sky", "_o").alias("sky"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("night")))
    newest = first.withColumn("_r", rank).filter(F.col("_r") <= nights)
    return newest.groupBy("site").agg(F.round(F.median("sky"), 2).alias("sky"), F.count("*").alias("nights"))


def subsets(members: str, least: int, most: int) -> Column:
    """All subsets of ``least`` to ``most`` members of an array, in its order; an array of over 20 is an error."""
    def chosen(mask: Column) -> Column:
        return F.filter(members, lambda _, i: F.getbit(mask, i) == 1)

    size = F.when(F.size(members) <= 20, F.size(members)).when(F.col(members).isNotNull(), F.raise_error(F.lit("subsets of over 20 members")).cast("int"))
    masks = F.filter(F.sequence(F.lit(1), F.pow(F.lit(2), size).cast("int") - 1), lambda m: F.bit_count(m).between(least, most))
    return F.transform(masks, chosen)


def claims(waiting: DataFrame, running: DataFrame, target: str, order: list[str]) -> DataFrame:
    """The first waiting task, by ``order``, of each target without a running one; an aggregate, so it combines before the shuffle."""
    free = waiting.join(running.select(target).distinct(), target, "left_anti")
    first = free.groupBy(target).agg(F.min(F.struct(*order)).alias("_f"))
    return first.select(target, *[F.col(f"_f.{c}").alias(c) for c in order])


def stale_keys(stored: DataFrame, now: DataFrame, key: str, checksum: str) -> DataFrame:
    """Keys that have inputs now and whose stored checksum is missing or another."""
    old = stored.select(key, F.col(checksum).alias("_old"))
    return now.join(old, key, "left").filter(~F.col(checksum).eqNullSafe(F.col("_old"))).select(key)
