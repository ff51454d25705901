"""Bodies in motion: Kepler orbits, sky-event search, season planning and eclipse timing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.sky import separation

#: Fixed value: the Sun's gravitational parameter in au^3 / day^2 (Gaussian constant squared).
MU = 0.01720209895**2


def stumpff(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Stumpff functions c2 and c3."""
    near, root = np.abs(z) < 1e-3, np.sqrt(np.maximum(np.abs(z), 1e-12))
    up, down = np.minimum(root, 50.0), root
    c2 = np.where(z > 0, (1 - np.cos(down)) / np.where(near, 1, z), (1 - np.cosh(up)) / np.where(near, 1, z))
    c3 = np.where(z > 0, (down - np.sin(down)) / down**3, (np.sinh(up) - up) / up**3)
    return np.where(near, 0.5 - z / 24 + z * z / 720, c2), np.where(near, 1 / 6 - z / 120 + z * z / 5040, c3)


def perihelion_state(q: np.ndarray, e: np.ndarray, dt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In-plane position (au) a time after perihelion, for any eccentricity, by universal variables."""
    q, e, dt = (np.asarray(v, float) for v in np.broadcast_arrays(q, e, dt))
    alpha = (1 - e) / q
    goal = np.sqrt(MU) * dt
    # the distance is never under q, which brackets the root; a step out of the bracket is halved instead
    low, high = np.minimum(0, goal / q), np.maximum(0, goal / q)
    s = (low + high) / 2
    for _ in range(200):
        c2, c3 = stumpff(alpha * s * s)
        over = (1 - alpha * q) * s**3 * c3 + q * s - goal
        low, high = np.where(over < 0, s, low), np.where(over > 0, s, high)
        new = s - over / ((1 - alpha * q) * s * s * c2 + q)
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        moved = np.abs(new - s)
        s = np.where(over == 0, s, new)
        if np.all(moved < 1e-14 * np.maximum(1, np.abs(s))):
            break
    z = alpha * s * s
    c2, c3 = stumpff(z)
    x = q - s * s * c2
    y = (dt - s**3 * c3 / np.sqrt(MU)) * np.sqrt(MU * (1 + e) / q)
    return x, y


def heliocentric(q, e, inclination, node, argument, dt) -> np.ndarray:
    """Ecliptic positions (n, 3) of orbits by perihelion distance and angles (degrees)."""
    x, y = perihelion_state(q, e, dt)
    i, o, w = (np.radians(np.asarray(v, float)) for v in (inclination, node, argument))
    px = np.cos(w) * np.cos(o) - np.sin(w) * np.sin(o) * np.cos(i)
    py = np.cos(w) * np.sin(o) + np.sin(w) * np.cos(o) * np.cos(i)
    pz = np.sin(w) * np.sin(i)
    qx = -np.sin(w) * np.cos(o) - np.cos(w) * np.sin(o) * np.cos(i)
    qy = -np.sin(w) * np.sin(o) + np.cos(w) * np.cos(o) * np.cos(i)
    qz = np.cos(w) * np.sin(i)
    return np.stack([x * px + y * qx, x * py + y * qy, x * pz + y * qz], -1)


def orbit_positions(orbits: DataFrame, times: list[float]) -> DataFrame:
    """(id, t, x, y, z) of every orbit (id, q, e, inclination, node, argument, perihelion) at the given days."""
    grid = np.array(times, float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = len(f)
            rep = f.loc[f.index.repeat(len(grid))].reset_index(drop=True)
            t = np.tile(grid, n)
            p = heliocentric(rep["q"], rep["e"], rep["inclination"], rep["node"], rep["argument"], t - rep["perihelion"].to_numpy())
            yield pd.DataFrame({"id": rep["id"], "t": t, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return orbits.mapInPandas(run, "id long, t double, x double, y double, z double")


def hermite(t, t0, t1, p0, v0, p1, v1):
    """Cubic Hermite interpolation of positions from states at both ends."""
    h = t1 - t0
    u = (t - t0) / h
    return (2 * u**3 - 3 * u**2 + 1) * p0 + (u**3 - 2 * u**2 + u) * h * v0 + (-2 * u**3 + 3 * u**2) * p1 + (u**3 - u**2) * h * v1


def close_passes(tracks: DataFrame, degrees: float, step: float, gap: float = 2.0) -> DataFrame:
    """Runs of time steps in which two bodies (body, t, ra, dec) stand within an angle.

    Pairs meet by time step; hits at most ``gap`` steps apart are one event:
    a, b, began, ended, closest, at.
    """
    a = tracks.select("t", F.col("body").alias("a"), F.col("ra").alias("ra1"), F.col("dec").alias("dec1"))
    b = tracks.select("t", F.col("body").alias("b"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    hits = a.join(b, "t").filter("a < b").withColumn("off", separation("ra1", "dec1", "ra2", "dec2")).filter(F.col("off") <= degrees)
    w = Window.partitionBy("a", "b").orderBy("t")
    new = F.coalesce((F.col("t") - F.lag("t").over(w) > gap * step + 1e-9).cast("int"), F.lit(0))
    runs = hits.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("a", "b", "run").agg(F.min("t").alias("began"), F.max("t").alias("ended"), F.min("off").alias("closest"), F.min_by("t", "off").alias("at")).drop("run")


def season_plan(items: DataFrame, group: str, hours: float, step: float = 1.0, most: int = 50) -> DataFrame:
    """Hours given per season to a group's items (item, need, weight), step by step to the item of the least weighted share done.

    The order of steps matters, so a group (one observatory's list) is one
    grouped map.
    """

    def plan(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("item").reset_index(drop=True)
        need, weight, done = f["need"].to_numpy(float), np.maximum(f["weight"].to_numpy(float), 1e-9), np.zeros(len(f))
        rows = []
        for season in range(1, most + 1):
            given, left = np.zeros(len(f)), hours
            while left > 1e-9 and (done < need - 1e-9).any():
                share = np.where(done < need - 1e-9, done / np.maximum(need, 1e-9) / weight, np.inf)
                k = int(share.argmin())
                part = min(step, left, need[k] - done[k])
                done[k] += part
                given[k] += part
                left -= part
            rows += [(f[group].iloc[0], season, item, float(g), bool(d >= n - 1e-9)) for item, g, d, n in zip(f["item"], given, done, need)]
            if (done >= need - 1e-9).all():
                break
        return pd.DataFrame(rows, columns=[group, "season", "item", "hours", "finished"])

    kind = dict(items.dtypes)
    return items.groupBy(group).applyInPandas(plan, f"`{group}` {kind[group]}, season int, item {kind['item']}, hours double, finished boolean")


def mirrored_minimum(t: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(time, error) of a minimum: where the curve differs least from its mirror image (parabola through three trials)."""
    order = np.argsort(t)
    t, y = t[order], y[order]
    step = (t[-1] - t[0]) / max(1, len(t) - 1)
    even = np.arange(t[0], t[-1] + step / 2, step)
    v = np.interp(even, t, y)
    n = len(v)
    middle = int(np.clip(np.argmin(np.convolve(v, np.ones(3) / 3, "same")[n // 4 : n - n // 4]) + n // 4, 2, n - 3))

    def cost(k: float) -> tuple[float, int]:
        reach = int(min(k, n - 1 - k))
        d = np.arange(1, reach)
        return float(((np.interp(k - d, np.arange(n), v) - np.interp(k + d, np.arange(n), v)) ** 2).sum() / max(1, len(d))), max(1, len(d))

    ks = np.array([middle - 0.5, middle, middle + 0.5])
    s = np.array([cost(k)[0] for k in ks])
    a, b, c = np.polyfit(ks, s, 2)
    if a <= 0:
        return float(even[middle]), float(step)
    best = -b / (2 * a)
    error = math.sqrt(max(0.0, (4 * a * c - b * b) / (4 * a * a * max(1, cost(middle)[1] - 1))))
    return float(even[0] + best * step), float(error * step)
