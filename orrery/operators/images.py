"""Image planes as array columns: backgrounds, sources, apertures and stacks.

A plane is one row (id, width, height, pixels as binary float32). Work inside
one plane is a small numpy helper; what crosses planes (stacks) is exploded to
blocks of pixels and grouped by block, so memory is bounded by a block's depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plane(pixels: bytes, width: int) -> np.ndarray:
    return np.frombuffer(pixels, "<f4").reshape(-1, width)


def clipped_mode(v: np.ndarray, rounds: int = 5) -> tuple[float, float]:
    """Background level and sigma of pixels: 3-sigma clipped about the mean, mode 2.5 median - 1.5 mean unless crowded."""
    v = v[np.isfinite(v)]
    if len(v) < 10:
        return float("nan"), float("nan")
    for _ in range(rounds):
        m, s = v.mean(), v.std()
        kept = v[np.abs(v - m) <= 3 * s]
        if len(kept) == len(v) or len(kept) < 10:
            break
        v = kept
    mean, med, s = float(v.mean()), float(np.median(v)), float(v.std())
    return (2.5 * med - 1.5 * mean if s and abs(mean - med) / s < 0.3 else med), s


def background(image: np.ndarray, box: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Level and sigma of boxes, holes filled from the mean of their neighbours, 3 x 3 median filtered."""
    h, w = image.shape
    rows, cols = -(-h // box), -(-w // box)
    mesh = np.array([[clipped_mode(image[i * box : (i + 1) * box, j * box : (j + 1) * box]) for j in range(cols)] for i in range(rows)])
    out = []
    for k in (0, 1):
        m = mesh[:, :, k].copy()
        while np.isnan(m).any() and not np.isnan(m).all():
            pad = np.pad(m, 1, constant_values=np.nan)
            near = np.stack([pad[1 + i : rows + 1 + i, 1 + j : cols + 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)])
            known = ~np.isnan(near)
            fill = np.where(known, near, 0).sum(0) / np.maximum(1, known.sum(0))
            m = np.where(np.isnan(m) & known.any(0), fill, m)
        pad = np.pad(m, 1, mode="edge")
        out.append(np.median(np.stack([pad[1 + i : rows + 1 + i, 1 + j : cols + 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)]), 0))
    return out[0], out[1]


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of 8-connected pixels, by propagating least labels until nothing changes (0: none)."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        pad = np.pad(np.where(labels == 0, mask.size + 1, labels), 1, constant_values=mask.size + 1)
        least = np.min(np.stack([pad[1 + i : mask.shape[0] + 1 + i, 1 + j : mask.shape[1] + 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)]), 0)
        new = np.where(mask, least, 0)
        flat = np.r_[0, new.ravel()]
        new = np.where(mask, flat[new], 0)  # jump to the label's own label
        if (new == labels).all():
            return labels
        labels = new


def extract(image: np.ndarray, threshold: float, least: int = 5) -> list[dict]:
    """Sources: connected pixels over the threshold, with centroid, shape, flux, peak and area."""
    labels = components(image > threshold)
    out = []
    for k in np.unique(labels[labels > 0]):
        y, x = np.nonzero(labels == k)
        if len(x) < least:
            continue
        v = image[y, x].astype(float)
        f = v.sum()
        cx, cy = (v * x).sum() / f, (v * y).sum() / f
        xx, yy, xy = (v * (x - cx) ** 2).sum() / f, (v * (y - cy) ** 2).sum() / f, (v * (x - cx) * (y - cy)).sum() / f
        root = np.sqrt(max(0.0, ((xx - yy) / 2) ** 2 + xy**2))
        edge = bool((x == 0).any() or (y == 0).any() or (x == image.shape[1] - 1).any() or (y == image.shape[0] - 1).any())
        out.append({"x": float(cx), "y": float(cy), "flux": float(f), "peak": float(v.max()), "area": len(x), "a": float(np.sqrt(max(0, (xx + yy) / 2 + root))), "b": float(np.sqrt(max(0, (xx + yy) / 2 - root))), "edge": edge})
    return out


def aperture(image: np.ndarray, x: float, y: float, radius: float, sub: int = 5) -> float:
    """Flux in a circle, edge pixels by ``sub`` x ``sub`` subpixels."""
    h, w = image.shape
    y0, y1, x0, x1 = max(0, int(y - radius - 1)), min(h, int(y + radius + 3)), max(0, int(x - radius - 1)), min(w, int(x + radius + 3))
    step = (np.arange(sub) + 0.5) / sub - 0.5
    yy = (np.arange(y0, y1)[:, None] + step).ravel()
    xx = (np.arange(x0, x1)[:, None] + step).ravel()
    inside = ((yy[:, None] - y) ** 2 + (xx[None, :] - x) ** 2 <= radius**2).reshape(y1 - y0, sub, x1 - x0, sub).mean((1, 3))
    return float((np.nan_to_num(image[y0:y1, x0:x1]) * inside).sum())


def half_flux_radius(image: np.ndarray, x: float, y: float, radius: float = 10.0) -> float:
    """Radius that holds half of the flux within ``radius``, by bisection."""
    total, lo, hi = aperture(image, x, y, radius), 0.0, radius
    for _ in range(20):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if aperture(image, x, y, mid) < total / 2 else (lo, mid)
    return (lo + hi) / 2


def median_filter(image: np.ndarray, size: int = 3) -> np.ndarray:
    """NaN-aware median of a square around each pixel, edges reflected."""
    r = size // 2
    pad = np.pad(image, r, mode="reflect")
    return np.nanmedian(np.lib.stride_tricks.sliding_window_view(pad, (size, size)), axis=(2, 3))


def block_mean(image: np.ndarray, k: int) -> np.ndarray:
    """NaN-aware means of k x k blocks; what is over at the edges is left out."""
    h, w = image.shape[0] // k * k, image.shape[1] // k * k
    return np.nanmean(image[:h, :w].reshape(h // k, k, w // k, k), axis=(1, 3))


def sources(planes: DataFrame, sigmas: float = 5.0, least: int = 5) -> DataFrame:
    """Sources of every plane (id, width, pixels) over its background."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, width, pixels in zip(f["id"], f["width"], f["pixels"]):
                image = plane(pixels, int(width))
                level, sigma = clipped_mode(image.ravel())
                if sigma == sigma:
                    rows += [{"id": key, **s} for s in extract(image - level, sigmas * sigma, least)]
            yield pd.DataFrame(rows, columns=["id", "x", "y", "flux", "peak", "area", "a", "b", "edge"])

    return planes.select("id", "width", "pixels").mapInPandas(find, "id long, x double, y double, flux double, peak double, area int, a double, b double, edge boolean")


def clipped_stack(planes: DataFrame, group: str, *, rows_per_block: int = 16, drop: int = 4, sigmas: float = 3.0, floor: float = 0.0) -> DataFrame:
    """Per pixel of a group's planes: centre and spread without the ``drop`` extremes, then the clipped weighted mean.

    Planes are cut into blocks of rows; a task holds one block of all planes.
    Columns: group, block, width, pixels (binary float32).
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for g, width, weight, pixels in zip(f[group], f["width"], f["weight"], f["pixels"]):
                size = 4 * int(width) * rows_per_block
                out += [(g, b, int(width), float(weight), pixels[a : a + size]) for b, a in enumerate(range(0, len(pixels), size))]
            yield pd.DataFrame(out, columns=[group, "block", "width", "weight", "pixels"])

    def combine(f: pd.DataFrame) -> pd.DataFrame:
        v = np.stack([np.frombuffer(p, "<f4").astype(float) for p in f["pixels"]])
        w = np.broadcast_to(f["weight"].to_numpy()[:, None], v.shape)
        ordered = np.sort(v, 0)
        inner = ordered[drop:-drop] if len(v) > 2 * drop + 1 else ordered
        centre, spread = np.nanmean(inner, 0), np.maximum(np.nanstd(inner, 0), floor)
        good = np.isfinite(v) & (np.abs(v - centre) <= sigmas * np.where(spread > 0, spread, np.inf))
        total = np.where(good, w, 0).sum(0)
        mean = np.where(total > 0, np.where(good, w * v, 0).sum(0) / np.where(total > 0, total, 1), np.nan)
        return pd.DataFrame({group: [f[group].iloc[0]], "block": [f["block"].iloc[0]], "width": [f["width"].iloc[0]], "pixels": [mean.astype("<f4").tobytes()]})

    kind = dict(planes.dtypes)[group]
    blocks = planes.select(group, "width", "weight", "pixels").mapInPandas(cut, f"`{group}` {kind}, block int, width int, weight double, pixels binary")
    return blocks.groupBy(group, "block").applyInPandas(combine, f"`{group}` {kind}, block int, width int, pixels binary")


def weighted_update(values: DataFrame, keys: list[str], x: str, w: str) -> DataFrame:
    """Mergeable weighted mean and variance: sums only, so updates combine in any order."""
    s, sx, sxx = F.sum(w), F.sum(F.col(w) * F.col(x)), F.sum(F.col(w) * F.col(x) * F.col(x))
    return values.groupBy(*keys).agg(s.alias("weight"), (sx / s).alias("mean"), F.greatest(F.lit(0.0), sxx / s - (sx / s) ** 2).alias("variance"), F.count("*").alias("n"))
