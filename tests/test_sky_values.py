"""Sky functions that other tests only use, against known values and plain formulas."""

import math
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from orrery.functions import sky
from orrery.functions.time import season_of


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def mjd(*date):
    return (datetime(*date, tzinfo=UTC) - datetime(1858, 11, 17, tzinfo=UTC)).total_seconds() / 86400


def test_moon_at_eclipses_and_phases(spark):
    """The Moon is full and opposite to the Sun at a lunar eclipse, and before it at a solar one."""
    lunar, solar = F.lit(mjd(2022, 11, 8, 10, 59)), F.lit(mjd(2024, 4, 8, 18, 18))
    ra, dec = sky.moon_position(lunar)
    sun = sky.sun_position(lunar)
    got = one(spark, sky.moon_illumination(lunar), sky.separation(ra, dec, sun[0] + 180, -sun[1]), sky.moon_illumination(solar), sky.separation(*sky.moon_position(solar), *sky.sun_position(solar)))
    assert got[0] > 0.999 and got[1] < 1.5 and got[2] < 0.001 and got[3] < 1.5


def test_sidereal_time(spark):
    """Greenwich mean sidereal time at 0 h of 10 April 1987 is 13 h 10 m 46.3668 s."""
    got = one(spark, sky.sidereal_time(F.lit(mjd(1987, 4, 10)), 0.0), sky.sidereal_time(F.lit(mjd(1987, 4, 10)), 300.0))
    want = (13 + 10 / 60 + 46.3668 / 3600) * 15
    assert got[0] == pytest.approx(want, abs=0.003) and got[1] == pytest.approx((want + 300) % 360, abs=0.003)


def test_vectors_and_tangent_plane(spark):
    got = one(spark, sky.unit_vector(30.0, -60.0), *sky.tangent_plane(10.0, 21.0, 10.0, 20.0), *sky.tangent_plane(11.0, 0.0, 10.0, 0.0), *sky.tangent_plane(190.0, 0.0, 10.0, 0.0))
    assert got[0] == pytest.approx([0.5 * math.cos(math.pi / 6), 0.25, -math.sin(math.pi / 3)])
    one_degree = math.degrees(math.tan(math.radians(1)))
    assert got[1:5] == pytest.approx((0.0, one_degree, one_degree, 0.0), abs=1e-12)


def test_brightness(spark):
    got = one(spark, sky.hg_magnitude(3.34, 0.12, 2.5, 1.5, 0.0), sky.hg_magnitude(10.0, 0.15, 1.0, 1.0, 20.0), sky.magnitude(100.0, 25.0), sky.magnitude(-1.0), sky.flux(20.0, 25.0))
    assert got[0] == pytest.approx(3.34 + 5 * math.log10(3.75))
    t = math.tan(math.radians(10))
    assert got[1] == pytest.approx(10 - 2.5 * math.log10(0.85 * math.exp(-3.33 * t**0.63) + 0.15 * math.exp(-1.87 * t**1.22)))
    assert got[2] == pytest.approx(20.0) and got[3] is None and got[4] == pytest.approx(100.0)


def test_weights_and_steps(spark):
    got = one(spark, sky.raw_weight(2.0, 0.5), sky.raw_weight(0.0, 1.0), sky.clarity(0.5, 2.0), sky.clarity(0.5, 0.0), sky.quantised(2.5, 1.0), sky.quantised(-2.5, 1.0), sky.quantised(0.34, 0.25))
    assert got == (8.0, None, 0.25 / 16, None, 3.0, -3.0, 0.25)


def test_seasons(spark):
    """An object at 0 h stands opposite to the Sun in September, one at 12 h in March."""
    us = lambda *d: F.lit(int(datetime(*d, tzinfo=UTC).timestamp() * 1e6))
    got = one(spark, season_of(us(2024, 9, 22), 0.0), season_of(us(2024, 4, 1), 0.0), season_of(us(2024, 3, 10), 0.0), season_of(us(2024, 3, 21), 12.0), season_of(us(2023, 10, 1), 12.0), season_of(us(2024, 8, 1), 12.0))
    assert got == (2024, 2024, 2023, 2024, 2024, 2024)
