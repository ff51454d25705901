"""A hierarchical equal-area index of the sky, and searches that read only the part they need.

Pixels are those of the nested HEALPix scheme (Gorski et al. 2005): 12 base
pixels, each cut in four ``order`` times. A pixel's descendants at any deeper
order are a range of numbers, so a region of the sky is a few ranges, which
become filters that reach the Parquet scan. A catalogue written in order of its
pixels (``write_by_pixel``) has narrow ranges in every file and row group, and
all others are passed over.

Defined results: positions that are null or not finite have no pixel and lie in
no region; right ascensions may be outside 0..360; equal rows all stay; an empty
catalogue gives an empty result; a column called ``pixel`` is replaced.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.sky import _c, finite, in_box, separation

#: Of catalogues: pixels of 0.23 degrees.
ORDER = 8
#: Against rounding, in radians.
SLACK = 1e-9
# Fixed values of the scheme: ring and longitude of the base pixels' lowest corners, in units of the pixel's side.
BASE_RING = [2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4]
BASE_TURN = [1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7]


#: The bits of a byte at the even places of a number: its binary digits, read to base 4.
SPREAD = [int(f"{v:b}", 4) for v in range(256)]


def _spread(v: Column, order: int) -> Column:
    """The bits of a number at the even places of another, byte by byte."""
    table = F.array(*map(F.lit, SPREAD))  # folded into a constant by the optimizer
    parts = (F.shiftleft(table[F.shiftright(v, at).bitwiseAND(F.lit(255)).cast("int")].cast("long"), 2 * at) for at in range(0, max(order, 1), 8))
    return functools.reduce(lambda a, b: a + b, parts)


def sky_pixel(ra, dec, order: int = ORDER) -> Column:
    """Nested pixel of a position (degrees) at an order up to 29.

    Cases are sums of products instead of branches: what stands in a branch is
    worked out anew wherever it is used, all else once a row.
    """
    side = 1 << order
    ra, dec = finite(_c(ra)), finite(_c(dec))
    z = F.sin(F.radians(dec))
    turn = F.pmod(ra, F.lit(360.0)) / 90  # quarters

    def either(case: Column, a: Column, b: Column) -> Column:
        case = case.cast("long")
        return case * a + (1 - case) * b

    # between the polar caps: numbers of the ascending and descending edge lines
    down, up = (F.floor(side * (0.5 + turn - 0.75 * z)), F.floor(side * (0.5 + turn + 0.75 * z)))
    face_down, face_up = F.shiftright(down, order), F.shiftright(up, order)
    belt_face = either(face_down == face_up, F.pmod(face_down, F.lit(4)) + 4, either(face_down < face_up, face_down, face_up + 8))
    belt_x, belt_y = up.bitwiseAND(F.lit(side - 1)), side - 1 - down.bitwiseAND(F.lit(side - 1))
    # in a polar cap: distance from the pole in rings, shared out over the quarter
    quarter = F.least(F.floor(turn), F.lit(3))
    rest = turn - quarter
    rings = side * F.cos(F.radians(dec)) * F.sqrt(3 / (1 + F.abs(z)))
    a, b = (F.least(F.floor(part * rings), F.lit(side - 1)) for part in (rest, 1 - rest))
    belt, north = F.abs(z) <= 2 / 3, z > 0
    face = either(belt, belt_face, either(north, quarter, quarter + 8))
    x = either(belt, belt_x, either(north, side - 1 - b, a))
    y = either(belt, belt_y, either(north, side - 1 - a, b))
    return F.shiftleft(face, 2 * order) + _spread(x, order) + F.shiftleft(_spread(y, order), 1)


def pixel_centre(order: int, pixel: int) -> tuple[float, float]:
    """(ra, dec) of a nested pixel's centre."""
    side, face = 1 << order, pixel >> 2 * order
    x = sum((pixel >> 2 * k & 1) << k for k in range(order))
    y = sum((pixel >> 2 * k + 1 & 1) << k for k in range(order))
    ring = BASE_RING[face] * side - x - y - 1
    if ring < side:
        n, z, odd = ring, 1 - ring * ring / (3 * side * side), 0
    elif ring > 3 * side:
        n = 4 * side - ring
        z, odd = n * n / (3 * side * side) - 1, 0
    else:
        n, z, odd = side, (2 * side - ring) * 2 / (3 * side), (ring - side) & 1
    place = (BASE_TURN[face] * n + x - y + 1 + odd) // 2
    return (place - (odd + 1) / 2) * 90 / n % 360, math.degrees(math.asin(z))


def _angle(a: tuple[float, float], b: tuple[float, float]) -> float:
    """Angle in radians between two positions in degrees."""
    (ra, dec), (ra2, dec2) = (map(math.radians, p) for p in (a, b))
    h = math.sin((dec2 - dec) / 2) ** 2 + math.cos(dec) * math.cos(dec2) * math.sin((ra2 - ra) / 2) ** 2
    return 2 * math.asin(math.sqrt(min(1.0, h)))


def pixel_reach(order: int) -> float:
    """The greatest angle (radians) between a pixel's centre and any of its points."""
    side = 1 << order
    at = lambda z, phi: (math.degrees(phi), math.degrees(math.asin(z)))
    return _angle(at(2 / 3, math.pi / (4 * side)), at(1 - (1 - 1 / side) ** 2 / 3, 0.0))


def cone_cover(ra: float, dec: float, radius: float, order: int = ORDER, most: int = 64) -> list[tuple[int, int]]:
    """Ranges (first, last) of pixels that hold every point within ``radius`` degrees.

    Pixels are cut in four as long as the border has at most ``most`` of them;
    pixels that lie inside whole are cut no further. So the number of ranges is
    bounded whatever the radius, and a cover may hold pixels without a point.
    """
    r, at = math.radians(radius), (ra, dec)
    ranges: list[tuple[int, int]] = []
    border, depth = list(range(12)), 0
    while True:
        open_, reach = [], pixel_reach(depth) + SLACK
        width = 2 * (order - depth)
        for p in border:
            away = _angle(pixel_centre(depth, p), at)
            if away + reach <= r:
                ranges.append((p << width, (p + 1 << width) - 1))
            elif away <= r + reach:
                open_.append(p)
        if depth == order or 4 * len(open_) > most:
            ranges += [(p << width, (p + 1 << width) - 1) for p in open_]
            break
        border, depth = [4 * p + c for p in open_ for c in range(4)], depth + 1
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if merged and lo == merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], hi)
        else:
            merged.append((lo, hi))
    return merged


def in_ranges(column: str, ranges: list[tuple[int, int]]) -> Column:
    """A filter that Parquet scans take: any of the ranges, as a tree of even depth."""
    parts = [f"`{column}` BETWEEN {lo} AND {hi}" for lo, hi in ranges] or ["false"]
    while len(parts) > 1:
        parts = [f"({' OR '.join(parts[i : i + 2])})" for i in range(0, len(parts), 2)]
    return F.expr(parts[0])


def write_by_pixel(df: DataFrame, path: str, *, ra: str = "ra", dec: str = "dec", order: int = ORDER, files: int | None = None, group_bytes: int | None = None) -> None:
    """Write a catalogue with its ``pixel``, in order of it: ranges of pixels by file, sorted within.

    Crowded parts of the sky get more files, as ranges are cut by rows. Rows
    without a position come first.
    """
    placed = df.drop("pixel").withColumn("pixel", sky_pixel(ra, dec, order))
    # the position parts the rows of one crowded pixel
    keys = ["pixel", dec, ra]
    dealt = placed.repartitionByRange(files, *keys) if files else placed.repartitionByRange(*keys)
    out = dealt.sortWithinPartitions(*keys).write.mode("overwrite")
    if group_bytes:
        out = out.option("parquet.block.size", group_bytes)
    out.parquet(path)


def read_cone(spark: SparkSession, path: str, at: tuple[float, float], radius: float, *, ra: str = "ra", dec: str = "dec", order: int = ORDER) -> DataFrame:
    """The catalogue's rows within ``radius`` degrees of a position, with their ``separation``."""
    near = spark.read.parquet(path).filter(in_ranges("pixel", cone_cover(*at, radius, order)))
    return near.withColumn("separation", separation(ra, dec, *map(float, at))).filter(F.col("separation") <= radius)


def read_box(spark: SparkSession, path: str, ra_min: float, ra_max: float, dec_min: float, dec_max: float, *, ra: str = "ra", dec: str = "dec", order: int = ORDER) -> DataFrame:
    """The catalogue's rows inside a box of right ascension (which may run over 0) and declination.

    The box is covered by the circle about its middle through its farthest
    corner, or taken by declination alone where that is no small circle.
    """
    width = (ra_max - ra_min) % 360 if ra_max != ra_min + 360 else 360.0
    centre = ((ra_min + width / 2) % 360, (dec_min + dec_max) / 2)
    rows = spark.read.parquet(path)
    if width < 90:  # then the farthest point is a corner
        radius = math.degrees(max(_angle(centre, (ra_min, d)) for d in (dec_min, dec_max, max(dec_min, min(dec_max, 0.0)))))
        rows = rows.filter(in_ranges("pixel", cone_cover(*centre, radius, order)))
    inside = in_box(F.pmod(F.col(ra), F.lit(360.0)), dec, ra_min, ra_max, dec_min, dec_max)
    return rows.filter(F.col(dec).between(dec_min, dec_max)).filter(inside)
