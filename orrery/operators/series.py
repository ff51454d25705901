"""Time series: folding, periodograms, box search, verdicts, ephemerides and light-curve fits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.sky import finite
from orrery.operators.stats import by_group, exact_percentiles, order_statistics, percentile
from orrery.session import staged


def phase(t: Column, epoch: Column, period: Column) -> Column:
    """Phase from 0 to 1."""
    cycles = (t - epoch) / period
    return cycles - F.floor(cycles)


def periodogram(points: DataFrame, keys: list[str], t: str, y: str, frequencies: list[float]) -> DataFrame:
    """Power of each series at a grid of frequencies, relative to its variance.

    The grid is a literal array that each point explodes; sines and cosines
    are summed with partial aggregation, so no series is collected.
    """
    mean = points.groupBy(*keys).agg(F.avg(y).alias("_mean"), F.var_pop(y).alias("_var"))
    grid = F.array(*map(F.lit, frequencies))
    p = points.join(mean, keys).select(*keys, "_var", (F.col(y) - F.col("_mean")).alias("_y"), F.col(t).alias("_t"), F.explode(grid).alias("frequency"))
    angle = 2 * math.pi * F.col("frequency") * F.col("_t")
    sums = p.groupBy(*keys, "frequency").agg(F.sum(F.col("_y") * F.cos(angle)).alias("c"), F.sum(F.col("_y") * F.sin(angle)).alias("s"), F.count("*").alias("n"), F.first("_var").alias("_var"))
    return sums.select(*keys, "frequency", F.try_divide((F.col("c") ** 2 + F.col("s") ** 2) / F.col("n"), F.col("_var")).alias("power"))


def box_search(points: DataFrame, keys: list[str], t: str, y: str, *, period: float, bins: int, lengths: int) -> DataFrame:
    """The strongest dip of the folded series: start bin, length in bins, -sum / sqrt(n)."""
    mean = points.groupBy(*keys).agg(F.avg(y).alias("_mean"))
    bin_ = F.floor(phase(F.col(t), F.lit(0.0), F.lit(period)) * bins)
    folded = points.join(mean, keys).groupBy(*keys, bin_.alias("bin")).agg(F.sum(F.col(y) - F.col("_mean")).alias("s"), F.count("*").alias("n"))
    # a bin belongs to the boxes of each length that start at it or shortly before, around the circle
    boxes = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(lengths)), lambda k: F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(F.pmod(F.col("bin") - i, F.lit(bins)).alias("start"), k.cast("long").alias("length")))))
    box = folded.select(*keys, "s", "n", F.explode(boxes).alias("b")).groupBy(*keys, "b").agg((-F.sum("s") / F.sqrt(F.sum("n"))).alias("strength"))
    best = F.min_by(F.struct("b", "strength"), F.struct(-F.col("strength"), F.col("b")))
    return box.groupBy(*keys).agg(best.alias("_x")).select(*keys, F.col("_x.b.start").alias("start"), F.col("_x.b.length").alias("length"), F.col("_x.strength").alias("strength"))


# Fixed values of the verdict: epochs that an object, a variable band and a flat band have at least; amplitudes in median errors;
# shares of deviant epochs; the trimmed share at each end of a peak; a flat amplitude's share of the claim.
OBJECT_EPOCHS, VARIABLE_EPOCHS, FLAT_EPOCHS = 5, 10, 20
VARIABLE_NOISE, CLAIM_NOISE, FLAT_NOISE, FLAT_ERRORS = 4.5, 2.0, 4.5, 3.0
DEVIANTS, DEVIANT_SHARE, FLAT_DEVIANT_SHARE, ECLIPSE_SHARE, ECLIPSE_BRIGHT = 5, 0.02, 0.01, 0.01, 0.25
PEAK_TRIM, FLAT_SHARE = 0.01, 1 / 3


def band_statistics(points: DataFrame, star: str, band: str, obj: str, y: str, error: str, change: float) -> DataFrame:
    """By star and band: epochs, amplitude (p95 - p5), peak (trimmed range), median error and level, deviant and fainter epochs.

    Residuals are about the median of each object (one field and chip) within
    the band, so that offsets between fields are no variation. Points whose value
    or error is not positive and finite take no part. All ranks are those of
    range-partitioned counts, so a curve of any length is fine.
    """
    good = points.filter((finite(y) > 0) & (finite(error) > 0)).select(star, band, obj, y, error)
    med = exact_percentiles(good, [star, band, obj], y, {"_m": 0.5}).filter(F.col("n") >= OBJECT_EPOCHS).drop("n")
    r = staged(by_group(good, med, [star, band, obj]).withColumn("_r", F.col(y) - F.col("_m")).drop("_m"), "residuals")
    far = (F.abs("_r") > change / 2) & (F.abs("_r") > 5 * F.col(error))
    counts = r.groupBy(star, band).agg(F.count("*").alias("epochs"), F.count_if(far).alias("deviant"), F.count_if(far & (F.col("_r") > 0)).alias("fainter"))
    trim = F.greatest(F.lit(1), F.round(PEAK_TRIM * F.col("n"))).cast("long")
    peaks = order_statistics(r, [star, band], "_r", {"_low": trim, "_high": F.col("n") - 1 - trim}).withColumn("peak", F.when(F.col("n") > 2 * trim, F.col("_high") - F.col("_low")).otherwise(0.0)).select(star, band, "peak")
    spread = exact_percentiles(r, [star, band], "_r", {"_p5": 0.05, "_p95": 0.95}).select(star, band, (F.col("_p95") - F.col("_p5")).alias("amplitude"))
    middle = exact_percentiles(r, [star, band], error, {"error": 0.5}).drop("n"), exact_percentiles(r, [star, band], y, {"level": 0.5}).drop("n")
    for more in (peaks, spread, *middle):
        counts = by_group(counts, more, [star, band])
    return counts


def verdicts(points: DataFrame, star: str, band: str, obj: str, y: str, error: str, *, change: float, level: tuple[float, float]) -> DataFrame:
    """What a survey says about a claimed ``change`` of each star: variable, flat or unknown, with the band behind it.

    Of the bands whose median is within ``level``, one varies by its amplitude in
    errors or by enough deviant epochs (all or nearly all fainter ones, if it is
    an eclipse); it confirms the claim if its peak reaches it within the errors,
    and of several the one of the greatest peak counts. A band that varies by less
    makes the star unknown, with that peak. Else the flat band of most epochs, if
    there is one, makes it flat.
    """
    s = band_statistics(points, star, band, obj, y, error, change)
    n, deviant, fainter = F.col("epochs"), F.col("deviant"), F.col("fainter")
    eclipse = (fainter >= F.greatest(F.lit(float(DEVIANTS)), ECLIPSE_SHARE * n)) & (deviant - fainter <= ECLIPSE_BRIGHT * fainter)
    dips = (deviant >= F.greatest(F.lit(float(DEVIANTS)), DEVIANT_SHARE * n)) | eclipse
    varies = (n >= VARIABLE_EPOCHS) & ((F.col("amplitude") >= VARIABLE_NOISE * F.col("error")) | dips)
    claimed = F.col("peak") + CLAIM_NOISE * F.col("error") >= change
    flat = (n >= FLAT_EPOCHS) & (FLAT_ERRORS * F.col("error") <= change) & (F.col("amplitude") < FLAT_SHARE * change) & (F.col("amplitude") < FLAT_NOISE * F.col("error")) & (deviant <= F.greatest(F.lit(1.0), FLAT_DEVIANT_SHARE * n))
    usable = F.col("level").between(*level)
    kind = F.when(varies & claimed, 0).when(varies, 1).when(flat, 2).otherwise(3)
    # of a kind, the greatest peak (of flat ones, the most epochs) and then the first band
    order = F.struct(kind.alias("kind"), F.when(kind < 2, -F.col("peak")).when(kind == 2, -n.cast("double")).alias("less"), F.col(band).alias("first"))
    own = F.struct(F.col(band).alias("band"), kind.alias("kind"), F.when(kind < 2, F.col("peak")).when(kind == 2, F.col("amplitude")).otherwise(0.0).alias("amplitude"))
    best = s.filter(usable).groupBy(star).agg(F.min_by(own, order).alias("_b"), F.count("*").alias("bands"))
    every = s.select(star).distinct().join(best, star, "left")
    k = F.col("_b.kind")
    return every.select(star, F.when(k == 0, "variable").when(k == 2, "flat").otherwise("unknown").alias("verdict"), F.when(k < 3, F.col("_b.band")).alias("band"), F.coalesce("_b.amplitude", F.lit(0.0)).alias("amplitude"), F.coalesce("bands", F.lit(0)).alias("bands"))


def predictions(ephemerides: DataFrame, epoch: str, period: str, start: float, end: float, *, epoch_error: Column, period_error: Column, at_phase: float = 0.0) -> DataFrame:
    """All times epoch + (n + phase) period in a range, with sigma = hypot(epoch error, n period error)."""
    first = F.ceil((start - F.col(epoch)) / F.col(period) - at_phase)
    last = F.floor((end - F.col(epoch)) / F.col(period) - at_phase)
    n = F.explode(F.when(first <= last, F.sequence(first, last)))
    out = ephemerides.withColumn("n", n)
    return out.withColumn("mid", F.col(epoch) + (F.col("n") + at_phase) * F.col(period)).withColumn("sigma", F.hypot(epoch_error, F.col("n") * period_error))


def timing_residuals(times: DataFrame, keys: list[str], n: str, t: str, least: int = 3) -> DataFrame:
    """Observed minus calculated times of each series' least squares ephemeris."""
    fit = times.groupBy(*keys).agg(F.regr_slope(t, n).alias("period"), F.regr_intercept(t, n).alias("epoch"), F.count("*").alias("_k")).filter(F.col("_k") >= least).drop("_k")
    return times.join(fit, keys).withColumn("residual", F.col(t) - (F.col("epoch") + F.col(n) * F.col("period")))


def seasons(points: DataFrame, keys: list[str], t: str, gap: float = 60.0) -> DataFrame:
    """Season numbers: a new one after a pause of over ``gap``."""
    w = Window.partitionBy(*keys).orderBy(t)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(0))
    return points.withColumn("_new", new).withColumn("season", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def floating_mean_power(t: np.ndarray, y: np.ndarray, w: np.ndarray, frequencies: np.ndarray) -> np.ndarray:
    """Generalised Lomb-Scargle power (floating mean) of one weighted series."""
    w = w / w.sum()
    angle = 2 * np.pi * np.outer(frequencies, t)
    c, s = np.cos(angle), np.sin(angle)
    my, mc, ms = w @ y, c @ w, s @ w
    yy = w @ (y * y) - my * my
    yc, ys = c @ (w * y) - my * mc, s @ (w * y) - my * ms
    cc, ss, cs = (c * c) @ w - mc * mc, (s * s) @ w - ms * ms, (c * s) @ w - mc * ms
    d = cc * ss - cs * cs
    with np.errstate(divide="ignore", invalid="ignore"):
        power = (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * d)
    return np.nan_to_num(np.where(d > 1e-12, power, 0.0))


def best_periods(points: DataFrame, key: str, t: str, y: str, error: str, *, f_min: float, f_max: float, steps: int = 2000) -> DataFrame:
    """The best period of each series by the floating-mean periodogram, refined twentyfold, with its power.

    A series is one group of a grouped map: it is one star's light curve.
    """

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        tt, yy, ww = pdf[t].to_numpy(), pdf[y].to_numpy(), 1 / np.maximum(pdf[error].to_numpy(), 1e-9) ** 2
        grid = np.linspace(f_min, f_max, steps)
        power = floating_mean_power(tt, yy, ww, grid)
        step = grid[1] - grid[0]
        fine = grid[power.argmax()] + np.linspace(-step, step, 41)
        power = floating_mean_power(tt, yy, ww, fine)
        k = power.argmax()
        return pd.DataFrame({key: [pdf[key].iloc[0]], "period": [1 / fine[k]], "power": [power[k]], "n": [len(pdf)]})

    kind = dict(points.dtypes)[key]
    return points.select(key, t, y, error).dropna().groupBy(key).applyInPandas(search, f"`{key}` {kind}, period double, power double, n long")


def polynomial(points: DataFrame, keys: list[str], x: str, y: str, error: str, degree: int = 2) -> DataFrame:
    """Weighted least squares polynomial: the normal equations' sums are aggregated, then solved row by row."""
    w = 1 / F.col(error) ** 2
    sums = [F.sum(w * F.col(x) ** i).alias(f"_x{i}") for i in range(2 * degree + 1)] + [F.sum(w * F.col(y) * F.col(x) ** i).alias(f"_y{i}") for i in range(degree + 1)]
    agg = points.groupBy(*keys).agg(*sums, F.count("*").alias("n"))
    kinds = ", ".join(f"`{k}` {v}" for k, v in agg.select(*keys).dtypes)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            xs, ys = pdf[[f"_x{i}" for i in range(2 * degree + 1)]].to_numpy(), pdf[[f"_y{i}" for i in range(degree + 1)]].to_numpy()
            out = [np.linalg.lstsq(np.array([[a[i + j] for j in range(degree + 1)] for i in range(degree + 1)]), b, rcond=None)[0].tolist() for a, b in zip(xs, ys)]
            yield pdf[[*keys, "n"]].assign(beta=out)

    return agg.mapInPandas(solve, f"{kinds}, n long, beta array<double>")
