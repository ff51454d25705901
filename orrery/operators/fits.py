"""Fits of all groups at once: every pass is one aggregate of mergeable sums, and no group meets in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.session import staged


def rejecting_fit(df: DataFrame, keys: list[str], y: str, xs: list[str], *, clip: float = 3.0, rounds: int = 10, least: int = 4) -> DataFrame:
    """``y`` as a linear function of one or two ``xs`` and a constant, by group, refitted without the rows that lie off.

    A row is off where its residual is over ``clip`` times the root mean square
    of the residuals of the rows that the last fit took; the fit is made anew
    from all rows that are not, until none changes sides, ``rounds`` times at
    most. A fit that would leave under ``least`` rows is not made. Columns: keys,
    ``constant``, ``slope`` of each x, ``rms``, ``n`` taken, ``rejected`` and
    ``rounds``. Sums are of values less the group's means, so that large values
    lose no digits. Rows with a null are left out; groups that don't determine
    the fit (too few rows, no spread) have null slopes.
    """
    if not 1 <= len(xs) <= 2:
        raise ValueError("one or two regressors")
    rows = df.dropna(subset=[*keys, y, *xs]).select(*keys, *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([y, *xs])))
    names = [f"_{i}" for i in range(len(xs) + 1)]
    means = staged(rows.groupBy(*keys).agg(*(F.avg(c).alias(f"{c}m") for c in names)), "fit-means")
    rows = staged(rows.join(means, keys).select(*keys, *((F.col(c) - F.col(f"{c}m")).alias(c) for c in names)), "fit-rows")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = [F.sum(c).alias(f"s{c}") for c in names] + [F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in pairs]

    def fitted(kept: DataFrame) -> DataFrame:
        """Coefficients of the centred rows."""
        got = kept.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
        cov = {(a, b): F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("n") for a, b in pairs}
        got = got.select(*keys, "n", *(F.col(f"s{c}").alias(f"s{c}") for c in names), *(v.alias(f"c{a}{b}") for (a, b), v in cov.items()))
        c = lambda a, b: F.col(f"c{a}{b}")
        if len(xs) == 1:
            spread = c("_1", "_1")
            slopes = [F.when(spread > 0, c("_0", "_1") / spread)]
        else:
            det = c("_1", "_1") * c("_2", "_2") - c("_1", "_2") ** 2
            fine = det > 1e-12 * c("_1", "_1") * c("_2", "_2")
            slopes = [F.when(fine, (c("_0", "_1") * c("_2", "_2") - c("_0", "_2") * c("_1", "_2")) / det), F.when(fine, (c("_0", "_2") * c("_1", "_1") - c("_0", "_1") * c("_1", "_2")) / det)]
        got = got.withColumns({f"b{i}": s for i, s in enumerate(slopes, 1)})
        level = (F.col("s_0") - sum((F.col(f"b{i}") * F.col(f"s_{i}") for i in range(1, len(xs) + 1)), F.lit(0.0))) / F.col("n")
        off = c("_0", "_0") - sum((F.col(f"b{i}") * c("_0", f"_{i}") for i in range(1, len(xs) + 1)), F.lit(0.0))
        return got.select(*keys, "n", level.alias("b0"), *(f"b{i}" for i in range(1, len(xs) + 1)), F.sqrt(F.greatest(F.lit(0.0), off / F.col("n"))).alias("rms"))

    own = ["n", "b0", *(f"b{i}" for i in range(1, len(xs) + 1)), "rms"]
    fit = staged(fitted(rows).withColumns({"rounds": F.lit(1), "open": F.lit(True)}), "fits")
    for _ in range(rounds - 1):
        residual = F.abs(F.col("_0") - F.col("b0") - sum((F.col(f"b{i}") * F.col(f"_{i}") for i in range(1, len(xs) + 1)), F.lit(0.0)))
        kept = rows.join(fit.filter("open"), keys).filter(residual <= clip * F.col("rms") + 1e-300).select(*keys, *names)
        new = fitted(kept).filter(F.col("n") >= least).select(*keys, F.struct(*own).alias("new"))
        both = fit.join(new, keys, "left")
        # the same rows give the same count and the same fit
        moved = F.col("open") & F.col("new").isNotNull() & ((F.col("new.n") != F.col("n")) | (F.abs(F.col("new.b0") - F.col("b0")) > 1e-12 * (F.col("rms") + 1e-300)) | F.col("new.b1").isNull())
        moved = F.coalesce(moved, F.lit(False))
        fit = staged(both.select(*keys, *(F.when(moved, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in own), (F.col("rounds") + moved.cast("int")).alias("rounds"), moved.alias("open")), "fits")
        if fit.filter("open").isEmpty():
            break
    totals = rows.groupBy(*keys).agg(F.count("*").alias("_all"))
    done = fit.join(means, keys).join(totals, keys)
    constant = F.col("_0m") + F.col("b0") - sum((F.col(f"b{i}") * F.col(f"_{i}m") for i in range(1, len(xs) + 1)), F.lit(0.0))
    return done.select(*keys, constant.alias("constant"), *(F.col(f"b{i}").alias(f"slope_{x}") for i, x in enumerate(xs, 1)), "rms", "n", (F.col("_all") - F.col("n")).alias("rejected"), "rounds")


def searched(df: DataFrame, keys: list[str], cost: Callable[[Column], Column], low: float, high: float, *, steps: int = 16, rounds: int = 12) -> DataFrame:
    """The parameter between ``low`` and ``high`` that makes the sum of a row's ``cost`` least, by group, and that ``least`` sum.

    A round sums the costs of ``steps`` + 1 evenly spaced parameters of each
    group in one aggregate, and the next looks between the neighbours of the
    best: for costs with one minimum the parameter is within (high - low) * (2 /
    steps) ** rounds. Of equal sums the smaller parameter counts; rows whose cost
    is null are left out.
    """
    bounds = df.select(*keys).distinct().withColumns({"_lo": F.lit(float(low)), "_hi": F.lit(float(high))})
    bounds = staged(bounds, "search")
    for _ in range(rounds):
        at = lambda j: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (j / steps)
        found = df.join(bounds, keys).groupBy(*keys, "_lo", "_hi").agg(*(F.sum(cost(at(j))).alias(f"_c{j}") for j in range(steps + 1)))
        best = F.array_min(F.array(*(F.struct(F.col(f"_c{j}").alias("cost"), at(j).alias("at"), F.lit(j).alias("j")) for j in range(steps + 1))))
        found = found.select(*keys, "_lo", "_hi", best.alias("best"))
        step = (F.col("_hi") - F.col("_lo")) / steps
        bounds = staged(found.select(*keys, F.greatest(F.lit(float(low)), F.col("best.at") - step).alias("_lo"), F.least(F.lit(float(high)), F.col("best.at") + step).alias("_hi"), F.col("best.at").alias("parameter"), F.col("best.cost").alias("least")), "search")
        rest = bounds.select(*keys, "parameter", "least")
        bounds = bounds.select(*keys, "_lo", "_hi")
    return rest
