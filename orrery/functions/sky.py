"""Sky geometry and brightness as column expressions; degrees unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | float | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def separation(ra1, dec1, ra2, dec2) -> Column:
    """Angle between two positions (haversine)."""
    ra1, dec1, ra2, dec2 = map(_c, (ra1, dec1, ra2, dec2))
    a = F.sin(F.radians(dec2 - dec1) / 2) ** 2 + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.sin(F.radians(ra2 - ra1) / 2) ** 2
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


def angle_between(a, b) -> Column:
    """Difference of two angles, 0 to 180."""
    d = F.pmod(F.abs(_c(a) - _c(b)), F.lit(360.0))
    return F.least(d, 360 - d)


def rotation_fits(a, b, tolerance: float = 1.5) -> Column:
    """Angles within the tolerance, a missing one fitting any."""
    a, b = _c(a), _c(b)
    return a.isNull() | b.isNull() | (angle_between(a, b) <= tolerance)


def in_box(ra, dec, ra_min: float, ra_max: float, dec_min: float, dec_max: float) -> Column:
    """Inside a box of right ascension and declination, which may run over 0."""
    ra, dec = _c(ra), _c(dec)
    inside = ra.between(ra_min, ra_max) if ra_min <= ra_max else (ra >= ra_min) | (ra <= ra_max)
    return inside & dec.between(dec_min, dec_max)


def unit_vector(ra, dec) -> Column:
    ra, dec = F.radians(_c(ra)), F.radians(_c(dec))
    return F.array(F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec))


def rotated(ra, dec, rows: list[list[float]]) -> tuple[Column, Column]:
    """(ra, dec) of a position turned by a rotation matrix."""
    v = unit_vector(ra, dec)
    x, y, z = (sum((F.lit(m) * v[i] for i, m in enumerate(row)), F.lit(0.0)) for row in rows)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))


# The rotation from galactic to equatorial (J2000) axes, and from B1950 to J2000.
GALACTIC = [
    [-0.0548755604162154, 0.4941094278755837, -0.8676661490190047],
    [-0.8734370902348850, -0.4448296299600112, -0.1980763734312015],
    [-0.4838350155487132, 0.7469822444972189, 0.4559837761750669],
]
B1950 = [
    [0.9999256782, -0.0111820611, -0.0048579477],
    [0.0111820610, 0.9999374784, -0.0000271765],
    [0.0048579479, -0.0000271474, 0.9999881997],
]


def galactic_to_equatorial(l, b) -> tuple[Column, Column]:  # noqa: E741
    return rotated(l, b, GALACTIC)


def b1950_to_j2000(ra, dec) -> tuple[Column, Column]:
    return rotated(ra, dec, B1950)


def precessed(ra, dec, years) -> tuple[Column, Column]:
    """J2000 position to the equinox of ``years`` later (low precision)."""
    ra, dec, t = _c(ra), _c(dec), _c(years)
    m, n = 3.07496 + 0.0000186 * t, 1.33621 - 0.0000057 * t  # seconds of time a year; the latter also times 15 arcseconds
    da = (m + n * F.sin(F.radians(ra)) * F.tan(F.radians(dec))) * 15 / 3600 * t
    dd = n * 15 / 3600 * F.cos(F.radians(ra)) * t
    return F.pmod(ra + da, F.lit(360.0)), dec + dd


def propagated(ra, dec, pm_ra, pm_dec, years) -> tuple[Column, Column]:
    """Position after proper motion (mas a year, along a great circle); unknown motion leaves it."""
    ra, dec, years = _c(ra), _c(dec), _c(years)
    pm_ra, pm_dec = (F.when(~F.isnan(_c(p)), _c(p)) for p in (pm_ra, pm_dec))
    rate = F.sqrt(pm_ra**2 + pm_dec**2)
    d, pa = F.radians(rate * years / 3.6e6), F.atan2(pm_ra, pm_dec)
    d0 = F.radians(dec)
    s = F.sin(d0) * F.cos(d) + F.cos(d0) * F.sin(d) * F.cos(pa)
    new_dec = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)))
    turn = F.atan2(F.sin(pa) * F.sin(d) * F.cos(d0), F.cos(d) - F.sin(d0) * s)
    moved = rate > 0
    return F.when(moved, F.pmod(ra + F.degrees(turn), F.lit(360.0))).otherwise(ra), F.when(moved, F.degrees(new_dec)).otherwise(dec)


def tangent_plane(ra, dec, ra0, dec0) -> tuple[Column, Column]:
    """Gnomonic (xi, eta) of a position about a centre, in degrees."""
    ra, dec, ra0, dec0 = (F.radians(_c(x)) for x in (ra, dec, ra0, dec0))
    cosine = F.sin(dec0) * F.sin(dec) + F.cos(dec0) * F.cos(dec) * F.cos(ra - ra0)
    xi = F.try_divide(F.cos(dec) * F.sin(ra - ra0), cosine)
    eta = F.try_divide(F.cos(dec0) * F.sin(dec) - F.sin(dec0) * F.cos(dec) * F.cos(ra - ra0), cosine)
    return F.degrees(xi), F.degrees(eta)


def off_tangent(ra0, dec0, xi, eta) -> tuple[Column, Column]:
    """(ra, dec) of gnomonic coordinates (degrees) about a centre."""
    x, y, d0 = F.radians(_c(xi)), F.radians(_c(eta)), F.radians(_c(dec0))
    down = F.cos(d0) - y * F.sin(d0)
    return F.pmod(_c(ra0) + F.degrees(F.atan2(x, down)), F.lit(360.0)), F.degrees(F.atan2(F.sin(d0) + y * F.cos(d0), F.sqrt(x * x + down * down)))


def sky_to_pixel(ra, dec, ra0, dec0, crpix: tuple[float, float], cd: list[list[float]]) -> tuple[Column, Column]:
    """Pixel of a position under a gnomonic solution with a CD matrix."""
    xi, eta = tangent_plane(ra, dec, ra0, dec0)
    (a, b), (c, d) = cd
    det = a * d - b * c
    return (d * xi - b * eta) / det + crpix[0], (a * eta - c * xi) / det + crpix[1]


def pixel_to_sky(x, y, ra0, dec0, crpix: tuple[float, float], cd: list[list[float]]) -> tuple[Column, Column]:
    """Position of a pixel under a gnomonic solution with a CD matrix."""
    dx, dy = _c(x) - crpix[0], _c(y) - crpix[1]
    return off_tangent(ra0, dec0, cd[0][0] * dx + cd[0][1] * dy, cd[1][0] * dx + cd[1][1] * dy)


def days_2000(mjd) -> Column:
    return _c(mjd) - 51_544.5


def sun_position(mjd) -> tuple[Column, Column]:
    """(ra, dec) of the Sun, to a hundredth of a degree."""
    d = days_2000(mjd)
    g = F.radians(357.529 + 0.98560028 * d)
    lam = F.radians(280.459 + 0.98564736 * d + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    eps = F.radians(23.439 - 0.00000036 * d)
    return F.pmod(F.degrees(F.atan2(F.cos(eps) * F.sin(lam), F.cos(lam))), F.lit(360.0)), F.degrees(F.asin(F.sin(eps) * F.sin(lam)))


def moon_position(mjd) -> tuple[Column, Column]:
    """(ra, dec) of the Moon's centre, to some tenths of a degree."""
    d = days_2000(mjd)
    ml, m, f = 218.316 + 13.176396 * d, F.radians(134.963 + 13.064993 * d), F.radians(93.272 + 13.229350 * d)
    lam, beta = F.radians(ml + 6.289 * F.sin(m)), F.radians(5.128 * F.sin(f))
    eps = F.radians(F.lit(23.439))
    x, y, z = F.cos(beta) * F.cos(lam), F.cos(beta) * F.sin(lam), F.sin(beta)
    y2, z2 = F.cos(eps) * y - F.sin(eps) * z, F.sin(eps) * y + F.cos(eps) * z
    return F.pmod(F.degrees(F.atan2(y2, x)), F.lit(360.0)), F.degrees(F.asin(z2))


def moon_illumination(mjd) -> Column:
    """Lit share of the Moon's disc."""
    elongation = separation(*sun_position(mjd), *moon_position(mjd))
    return (1 - F.cos(F.radians(elongation))) / 2


def sidereal_time(mjd, longitude) -> Column:
    """Local mean sidereal time in degrees."""
    return F.pmod(280.46061837 + 360.98564736629 * days_2000(mjd) + _c(longitude), F.lit(360.0))


def altitude(ra, dec, mjd, latitude, longitude) -> Column:
    """Altitude of a position above a site's horizon."""
    h = F.radians(sidereal_time(mjd, longitude) - _c(ra))
    dec, lat = F.radians(_c(dec)), F.radians(_c(latitude))
    return F.degrees(F.asin(F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.cos(h)))


def heliocentric_days(mjd, ra, dec) -> Column:
    """What is to be added to a time for the light's way to the Sun, in days."""
    sun_ra, sun_dec = sun_position(mjd)
    d = days_2000(mjd)
    g = F.radians(357.529 + 0.98560028 * d)
    r = 1.00014 - 0.01671 * F.cos(g) - 0.00014 * F.cos(2 * g)
    s, v = unit_vector(sun_ra, sun_dec), unit_vector(ra, dec)
    return -r * (s[0] * v[0] + s[1] * v[1] + s[2] * v[2]) * 499.004784 / 86_400


def hg_magnitude(h, g, r, delta, phase) -> Column:
    """Magnitude of an asteroid by the H, G law; distances in au, phase in degrees."""
    t = F.tan(F.radians(_c(phase)) / 2)
    p1, p2 = F.exp(-3.33 * t**0.63), F.exp(-1.87 * t**1.22)
    lit = (1 - _c(g)) * p1 + _c(g) * p2
    return F.when(lit > 0, _c(h) + 5 * F.log10(_c(r) * _c(delta)) - 2.5 * F.log10(lit))


def magnitude(flux, zero=0.0) -> Column:
    return F.when(_c(flux) > 0, _c(zero) - 2.5 * F.log10(_c(flux)))


def flux(mag, zero=0.0) -> Column:
    return F.pow(F.lit(10.0), (_c(zero) - _c(mag)) / 2.5)


def raw_weight(sky, hfr) -> Column:
    """1 / (sky hfr^4), null unless both are positive."""
    return F.when((_c(sky) > 0) & (_c(hfr) > 0), 1 / (_c(sky) * _c(hfr) ** 4))


def clarity(transparency, hfr) -> Column:
    return F.try_divide(_c(transparency) ** 2, _c(hfr) ** 4)


def decimal(x) -> Column:
    """The double that a 32-bit float's shortest decimal stands for."""
    return _c(x).cast("float").cast("string").cast("double")


def finite(x) -> Column:
    """Null for what is not a finite number."""
    return F.when(~F.isnan(_c(x)) & (F.abs(_c(x)) != float("inf")), _c(x))


def quantised(x, step: float) -> Column:
    """To the nearest multiple, halves away from zero."""
    return F.round(_c(x) / step) * step


RADIAN = math.pi / 180
