"""Percentiles, robust statistics, fits and shrinkage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import staged

MAD_SCALE = 1.4826


def real(x: str | Column) -> Column:
    """A double with NaN as null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x), x)


def percentile(x: str | Column, p: float) -> Column:
    """Linear interpolation between ranks, NaN and null left out."""
    return F.percentile(real(x), F.lit(p))


def nearest_rank(x: str, p: float) -> Column:
    """The value at rank ceil(p n), 0 where there is none."""
    return F.coalesce(F.expr(f"percentile_disc({p}) within group (order by {x})"), F.lit(0))


def order_statistics(df: DataFrame, groups: list[str], x: str, ranks: dict[str, Column]) -> DataFrame:
    """For each group, ``n`` and the values at the given ranks (from 0, in terms of ``n``); null and NaN left out.

    Exact, and no task or state holds a group: values are counted, the counts
    range-partitioned, and ranks are the counts of the partitions before plus
    those before within the partition. A rank outside 0 .. n - 1 gives null.
    """
    counts = df.select(*groups, real(x).alias("_x")).filter("_x is not null").groupBy(*groups, "_x").agg(F.count("*").alias("_n"))
    # staged: the partition's number must not change between the two passes
    ranged = staged(counts.repartitionByRange(*groups, "_x").withColumn("_part", F.spark_partition_id()), "ranks")
    parts = ranged.groupBy(*groups, "_part").agg(F.sum("_n").alias("_m"))
    whole = Window.partitionBy(*groups)
    sums = F.sum("_m").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_part").alias("_p"), F.coalesce(sums, F.lit(0)).alias("_before"), F.sum("_m").over(whole).alias("n"))
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    end = F.col("_before") + F.sum("_n").over(Window.partitionBy(*groups, "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.join(parts, same).withColumn("_end", end)
    picked = [F.max(F.when((rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_n")), F.col("_x"))).alias(name) for name, rank in ranks.items()]
    return placed.groupBy(*groups).agg(F.max("n").alias("n"), *picked)


def exact_percentiles(df: DataFrame, groups: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles by linear interpolation between ranks, of groups of any size (see ``order_statistics``)."""
    at = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in shares.items()}
    ranks = {f"_{name}_{side}": cut(at[name]) for name in at for side, cut in (("low", F.floor), ("high", F.ceil))}
    found = order_statistics(df, groups, x, ranks)
    # the weights of the built-in percentile, so that results agree to the last digit
    share = {n: at[n] - F.floor(at[n]) for n in at}
    mixed = [F.when(share[n] > 0, (F.ceil(at[n]) - at[n]) * F.col(f"_{n}_low") + share[n] * F.col(f"_{n}_high")).otherwise(F.col(f"_{n}_low")).alias(n) for n in at]
    return found.select(*groups, "n", *mixed)


def by_group(a: DataFrame, b: DataFrame, groups: list[str], how: str = "inner") -> DataFrame:
    """``a`` with the columns of ``b``, which has one row per group; null equals null, no groups mean one row."""
    same = F.lit(True)
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_b_{g}"))
    return a.join(b.withColumnsRenamed({g: f"_b_{g}" for g in groups}), same, how).drop(*[f"_b_{g}" for g in groups])


def capped_scores(df: DataFrame, groups: list[str], raw: str, p: float = 0.9, *, counted: Column | None = None) -> DataFrame:
    """``score``: the raw weight over the group's ``p`` percentile, at most 1; 0 where either is missing.

    ``counted`` says which rows the percentile takes.
    """
    taken = df.filter(counted) if counted is not None else df
    reference = exact_percentiles(taken, groups, raw, {"reference": p}).drop("n")
    good = (F.col(raw) > 0) & (F.col("reference") > 0)
    return by_group(df, reference, groups, "left").withColumn("score", F.coalesce(F.when(good, F.least(F.lit(1.0), F.col(raw) / F.when(F.col("reference") > 0, F.col("reference")))), F.lit(0.0)))


def mad(df: DataFrame, groups: list[str], x: str) -> DataFrame:
    """Median and scaled median absolute deviation of each group."""
    med = exact_percentiles(df, groups, x, {"median": 0.5}).drop("n")
    off = by_group(df, med, groups).withColumn("_off", F.abs(F.col(x) - F.col("median")))
    return by_group(med, exact_percentiles(off, groups, "_off", {"mad": 0.5}).drop("n"), groups).withColumn("mad", MAD_SCALE * F.col("mad"))


def trimmed_range(df: DataFrame, groups: list[str], x: str, share: float = 0.01) -> DataFrame:
    """Peak to peak after max(1, round(share n)) values fell at either end."""
    ranked = df.filter(F.col(x).isNotNull()).withColumn("_n", F.count("*").over(Window.partitionBy(*groups))).withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy(x)))
    cut = F.greatest(F.lit(1), F.round(F.col("_n") * share))
    inside = ranked.filter((F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut))
    return inside.groupBy(*groups).agg((F.max(x) - F.min(x)).alias("peak_to_peak"))


def clipped(df: DataFrame, groups: list[str], x: str, sigmas: float = 3.0, rounds: int = 3) -> DataFrame:
    """Median, deviation and number after ``rounds`` rounds of leaving out what is over ``sigmas`` off the median.

    Null and NaN take no part. A round is an exact median by range-partitioned
    counts, a deviation and a filter against both; no state holds a group.
    """
    left = df.select(*groups, real(x).alias(x)).filter(F.col(x).isNotNull())
    for i in range(rounds + 1):
        median = exact_percentiles(left, groups, x, {"median": 0.5})
        now = by_group(median, left.groupBy(*groups).agg(F.stddev_pop(x).alias("deviation")), groups)
        if i < rounds:
            now = staged(now.drop("n"), "clip")
            left = by_group(left, now, groups).filter(F.abs(F.col(x) - F.col("median")) <= sigmas * F.col("deviation")).select(*groups, x)
    return now.select(*groups, "median", "deviation", "n")


def weighted_line(x: str, y: str, w: str) -> tuple[Column, Column]:
    """(slope, intercept) of the weighted least squares line, from sums."""
    s, sx, sy = F.sum(w), F.sum(F.col(w) * F.col(x)), F.sum(F.col(w) * F.col(y))
    sxx, sxy = F.sum(F.col(w) * F.col(x) * F.col(x)), F.sum(F.col(w) * F.col(x) * F.col(y))
    slope = F.try_divide(s * sxy - sx * sy, s * sxx - sx * sx)
    return slope, F.try_divide(sy - slope * sx, s)


def histogram(x: str, edges: list[float]) -> Column:
    """Bin number from 0; bins are closed below, the last one also above; null outside."""
    last = len(edges) - 2
    out = F.when(F.col(x) == edges[-1], F.lit(last))
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        out = out.when((F.col(x) >= a) & (F.col(x) < b), F.lit(i))
    return out


def most_common(df: DataFrame, groups: list[str], x: str) -> DataFrame:
    """The commonest value of each group; ties go to the least."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*groups, x).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct(x, "n"), F.struct(-F.col("n"), F.col(x)))
    return counts.groupBy(*groups).agg(best.alias("_b")).select(*groups, F.col(f"_b.{x}").alias(x), F.col("_b.n").alias("n"))


def design_effect(df: DataFrame, cell: list[str], cluster: str, kept: Column) -> DataFrame:
    """Kept rate of each cell and the design effect of clustered rows.

    The effect is the ratio of the variance between clusters to the binomial
    one, at least 1.
    """
    per = df.groupBy(*cell, cluster).agg(F.count("*").alias("n"), F.sum(kept.cast("long")).alias("k"))
    rate = per.groupBy(*cell).agg(F.sum("n").alias("subs"), F.sum("k").alias("kept"), F.count("*").alias("clusters"))
    p = F.col("kept") / F.col("subs")
    out = per.join(rate, cell).groupBy(*cell).agg(F.first("subs").alias("subs"), F.first("kept").alias("kept"), F.first("clusters").alias("clusters"), F.sum((F.col("k") - p * F.col("n")) ** 2).alias("_v"))
    binomial = p * (1 - p) * F.col("subs")
    scaled = F.col("_v") * F.col("clusters") / F.when(F.col("clusters") > 1, F.col("clusters") - 1)
    return out.withColumn("rate", p).withColumn("effect", F.greatest(F.lit(1.0), F.coalesce(F.try_divide(scaled, binomial), F.lit(1.0)))).drop("_v")


def shrunk_rates(df: DataFrame, levels: list[str], kept: Column, prior: float = 40.0) -> DataFrame:
    """Kept rates by ever finer levels, each shrunk to its parent with ``prior`` pseudo-rows.

    One rollup makes all levels; the root has a Beta(1, 1) prior.
    """
    counts = df.rollup(*levels).agg(F.count("*").alias("n"), F.sum(kept.cast("long")).alias("k"), F.grouping_id().alias("_g"))
    root = counts.filter(F.col("_g") == 2 ** len(levels) - 1).select(((F.col("k") + 1) / (F.col("n") + 2)).alias("_parent"))  # one row
    rows, parent = None, None
    for i in range(1, len(levels) + 1):
        own = levels[:i]
        level = counts.filter(F.col("_g") == 2 ** (len(levels) - i) - 1).select(*own, "n", "k")
        joined = level.crossJoin(F.broadcast(root)) if i == 1 else level.join(parent, own[:-1])
        done = joined.withColumn("rate", (F.col("k") + prior * F.col("_parent")) / (F.col("n") + prior)).drop("_parent")
        parent = done.select(*own, F.col("rate").alias("_parent"))
        done = done.withColumn("level", F.lit(i))
        rows = done if rows is None else rows.unionByName(done, allowMissingColumns=True)
    return rows


def leave_one_out_rates(df: DataFrame, levels: list[str], unit: str, kept: Column, prior: float = 40.0) -> DataFrame:
    """``shrunk_rates`` of the finest cells of each unit (a night), as fitted to all rows but the unit's own.

    Nothing is refitted: rows are counted once by unit and finest cell, and a
    unit's counts are taken from those of the whole at every level that it has
    cells of. Columns: unit, levels, n and k (without the unit), rate, own_n and
    own_k. Rows with a null unit or level take no part.
    """
    base = staged(df.dropna(subset=[unit, *levels]).groupBy(unit, *levels).agg(F.count("*").alias("n"), F.sum(kept.cast("long")).alias("k")), "unit-counts")
    sums = F.sum("n").alias("n"), F.sum("k").alias("k")
    whole = base.agg(*sums)  # one row
    mine = base.groupBy(unit).agg(F.sum("n").alias("own_n"), F.sum("k").alias("own_k"))
    parent = mine.crossJoin(F.broadcast(whole)).select(unit, ((F.col("k") - F.col("own_k") + 1) / (F.col("n") - F.col("own_n") + 2)).alias("_parent"))
    for i in range(1, len(levels) + 1):
        cell = levels[:i]
        mine = base.groupBy(unit, *cell).agg(F.sum("n").alias("own_n"), F.sum("k").alias("own_k"))
        both = mine.join(base.groupBy(*cell).agg(*sums), cell).join(parent, [unit, *cell[:-1]])
        both = both.withColumns({"n": F.col("n") - F.col("own_n"), "k": F.col("k") - F.col("own_k")})
        both = both.withColumn("rate", (F.col("k") + prior * F.col("_parent")) / (F.col("n") + prior)).drop("_parent")
        parent = both.select(unit, *cell, F.col("rate").alias("_parent"))
    return both.select(unit, *levels, "n", "k", "rate", "own_n", "own_k")


def neighbourhood_max(df: DataFrame, groups: list[str], x: str, score: str, *, least: int = 5, ratios: tuple[float, ...] = (2.0, 4.0, 8.0)) -> DataFrame:
    """``best``: the greatest score among rows whose ``x`` is within a ratio of the row's own.

    The first ratio with ``least`` rows counts, else the whole group. All
    ratios are range frames over one sort of the logarithm.
    """
    logged = df.withColumn("_log", F.log(x).cast("double"))
    by = Window.partitionBy(*groups)
    out = F.max(score).over(by)
    for r in reversed(ratios):
        reach = f"CAST({math.log(r) + 1e-12!r} AS DOUBLE)"
        frame = f"OVER (PARTITION BY {', '.join(groups)} ORDER BY _log RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)"
        out = F.when(F.expr(f"count(*) {frame}") >= least, F.expr(f"max({score}) {frame}")).otherwise(out)
    return logged.withColumn("best", out).drop("_log")


def expected_score(samples: DataFrame, asked: DataFrame, on: list[str], quality: str, ratio: str, *, step: float = 0.05, steps: int = 4, least: int = 20) -> DataFrame:
    """Median ratio of past rows within k steps of the asked quality, for the first k with ``least`` rows."""
    pairs = asked.join(samples.select(*on, F.col(quality).alias("_q"), F.col(ratio).alias("_r")), on, "left")
    off = F.abs(F.col(quality) - F.col("_q"))
    level = F.coalesce(*[F.when(off <= k * step + 1e-9, F.lit(k)) for k in range(1, steps + 1)])
    keys = asked.columns
    near = pairs.withColumn("_k", level)
    aggs = [F.count(F.when(F.col("_k") <= k, 1)).alias(f"_n{k}") for k in range(1, steps + 1)] + [F.median(F.when(F.col("_k") <= k, F.col("_r"))).alias(f"_m{k}") for k in range(1, steps + 1)]
    pick = F.coalesce(*[F.when(F.col(f"_n{k}") >= least, F.col(f"_m{k}")) for k in range(1, steps + 1)])
    return near.groupBy(*keys).agg(*aggs).withColumn("expected", pick).select(*keys, "expected")
