"""Candidates and sources: linking, entity resolution, alerts and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.sky import separation
from orrery.operators.entity import connected_components
from orrery.operators.matching import cone_join


def resolved_sources(candidates: DataFrame, radius_arcsec: float = 5.0) -> DataFrame:
    """Candidates (id, object, ra, dec) with source, the least id of all that lie within the radius of each other, chained."""
    other = candidates.select(F.col("id").alias("id2"), F.col("object").alias("object2"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    near = cone_join(candidates.select("id", "object", "ra", "dec"), other, radius_arcsec / 3600).filter("id < id2 and object = object2")
    parts = connected_components(near.select(F.col("id").alias("a"), F.col("id2").alias("b")))
    return candidates.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("source", F.coalesce("component", "id")).drop("component")


def linked_tracks(detections: DataFrame, *, gap: float, radius: float, least: int = 5) -> DataFrame:
    """Straight tracks of moving detections (id, night, at, x, y).

    Pairs at most ``gap`` apart in time predict where the rest should lie; a
    detection within ``radius`` of the line's prediction is a hit. Tracks of
    ``least`` hits stay; of tracks that share three, the one of most hits.
    """
    a = detections.select("night", F.col("id").alias("a"), F.col("at").alias("t0"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    b = detections.select("night", F.col("id").alias("b"), F.col("at").alias("t1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    buckets = lambda t: F.floor(t / gap)
    pairs = a.withColumn("k", F.explode(F.array(buckets(F.col("t0")), buckets(F.col("t0")) + 1))).join(b.withColumn("k", buckets(F.col("t1"))), ["night", "k"]).filter("t1 > t0").filter(F.col("t1") - F.col("t0") <= gap)
    vx, vy = (F.col("x1") - F.col("x0")) / (F.col("t1") - F.col("t0")), (F.col("y1") - F.col("y0")) / (F.col("t1") - F.col("t0"))
    lines = pairs.select("night", "a", "b", "t0", "x0", "y0", vx.alias("vx"), vy.alias("vy"))
    times = detections.select("night", "at").distinct()
    cell = lambda c: F.floor(c / radius)
    places = lines.join(times, "night").withColumn("px", F.col("x0") + F.col("vx") * (F.col("at") - F.col("t0"))).withColumn("py", F.col("y0") + F.col("vy") * (F.col("at") - F.col("t0")))
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    places = places.withColumn("i", F.explode(F.transform(around, lambda d: cell(F.col("px")) + d))).withColumn("j", F.explode(F.transform(around, lambda d: cell(F.col("py")) + d)))
    found = detections.select("night", "at", F.col("id").alias("hit"), "x", "y", cell(F.col("x")).alias("i"), cell(F.col("y")).alias("j"))
    hits = places.join(found, ["night", "at", "i", "j"]).filter((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2 <= radius**2)
    tracks = hits.groupBy("night", "a", "b", "vx", "vy").agg(F.array_sort(F.collect_set("hit")).alias("hits")).filter(F.size("hits") >= least).withColumn("n", F.size("hits"))
    # a track falls to a better one that shares three hits
    one = tracks.select("night", "a", "b", "n", "hits", F.explode("hits").alias("hit"))
    other = tracks.select("night", F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("n").alias("n2"), F.explode("hits").alias("hit"))
    shared = one.join(other, ["night", "hit"]).filter("a <> a2 or b <> b2").groupBy("night", "a", "b", "n", "a2", "b2", "n2").agg(F.count("*").alias("s")).filter("s >= 3")
    worse = shared.filter("n2 > n or (n2 = n and (a2 < a or (a2 = a and b2 < b)))").select("night", "a", "b").distinct()
    return tracks.join(worse, ["night", "a", "b"], "left_anti")


def on_known_path(finds: DataFrame, alerted: DataFrame, *, days: float = 7.0, base_arcsec: float = 10.0, share: float = 0.03) -> DataFrame:
    """Finds (id, object, day, ra, dec) that lie where an alerted mover (rates in degrees a day) should be."""
    a = alerted.select("object", F.col("id").alias("alert"), F.col("day").alias("day0"), F.col("ra").alias("ra0"), F.col("dec").alias("dec0"), "rate_ra", "rate_dec")
    dt = F.col("day") - F.col("day0")
    moved = F.hypot(F.col("rate_ra") * F.cos(F.radians("dec0")), "rate_dec") * F.abs(dt)
    off = separation(F.col("ra"), F.col("dec"), F.col("ra0") + F.col("rate_ra") * dt, F.col("dec0") + F.col("rate_dec") * dt)
    same = (F.abs(dt) <= days) & (off * 3600 <= base_arcsec + share * moved * 3600)
    return finds.join(a, "object").filter(same).select("id", "alert", (off * 3600).alias("off_arcsec"))


def recommended_exposures(candidates: DataFrame, keys: list[str], *, tolerance: float = 0.05) -> DataFrame:
    """The shortest unblocked exposure whose signal is within ``tolerance`` of the best.

    Rows: keys, exposure, noise_share, overhead, kept, blocked.
    """
    eff = F.col("noise_share") * F.col("exposure") / (F.col("exposure") + F.col("overhead")) * F.col("kept")
    c = candidates.withColumn("efficiency", F.when(~F.col("blocked"), eff))
    best = c.groupBy(*keys).agg(F.max("efficiency").alias("best"))
    near = c.join(best, keys).filter(F.sqrt(F.col("efficiency") / F.col("best")) >= 1 - tolerance)
    return near.groupBy(*keys).agg(F.min_by(F.struct("exposure", "efficiency"), F.col("exposure")).alias("r")).select(*keys, "r.exposure", "r.efficiency")


def skyline(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Per azimuth bin (0 to 359): the upper median of the edges seen, at least the greatest lower bound; gaps interpolated, conflicts flagged.

    Rows: keys, bin, edge, lower.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, "bin").orderBy("edge")
    ranked = edges.withColumn("_r", F.when(F.col("edge").isNotNull(), F.row_number().over(w.orderBy(F.asc_nulls_last("edge"))))).withColumn("_n", F.count("edge").over(Window.partitionBy(*keys, "bin")))
    per = ranked.groupBy(*keys, "bin").agg(F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("edge"))).alias("edge"), F.max("lower").alias("lower"))
    per = per.withColumn("conflict", F.coalesce(F.col("lower") > F.col("edge"), F.lit(False))).withColumn("height", F.greatest("edge", "lower"))
    grid = per.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(359)))).join(per, [*keys, "bin"], "left")
    by = Window.partitionBy(*keys).orderBy("bin")
    known = F.when(F.col("height").isNotNull(), F.struct("bin", "height"))
    before, after = F.last(known, True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(by.rowsBetween(0, Window.unboundedFollowing))
    span = after["bin"] - before["bin"]
    line = before["height"] + (after["height"] - before["height"]) * F.try_divide(F.col("bin") - before["bin"], span)
    value = F.coalesce("height", line, before["height"], after["height"])
    return grid.select(*keys, "bin", value.alias("height"), F.coalesce("conflict", F.lit(False)).alias("conflict"), F.col("height").isNull().alias("filled"))
