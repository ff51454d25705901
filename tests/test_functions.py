"""Column functions against textbook values and plain loops."""

import math

import pytest

from orrery.functions import sky, text
from orrery.operators import catalogue, stats, upsert
from pyspark.sql import functions as F


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_frames_and_precession(spark):
    ra, dec = sky.b1950_to_j2000(F.lit(0.0), F.lit(0.0))
    got = one(spark, ra, dec, *sky.precessed(F.lit(0.0), F.lit(0.0), F.lit(50.0)))
    # the full transformation, with the terms that a rotation leaves out (under 0.35 arcseconds), gives 0.640691 and 0.278409
    assert got[0] == pytest.approx(0.640691, abs=0.35 / 3600) and got[1] == pytest.approx(0.278409, abs=0.35 / 3600)
    assert got[2] == pytest.approx(got[0], abs=1e-3) and got[3] == pytest.approx(got[1], abs=1e-3)


def test_proper_motion(spark):
    north = sky.propagated(F.lit(10.0), F.lit(20.0), F.lit(0.0), F.lit(3.6e6), F.lit(1.0))
    unknown = sky.propagated(F.lit(10.0), F.lit(20.0), F.lit(None).cast("double"), F.lit(float("nan")), F.lit(1.0))
    got = one(spark, *north, *unknown)
    assert got[0] == pytest.approx(10.0) and got[1] == pytest.approx(21.0)
    assert tuple(got)[2:] == (10.0, 20.0)


def test_light_time_to_the_sun(spark):
    mjd = F.lit(60000.0)
    ra, dec = sky.sun_position(mjd)
    ahead, behind = one(spark, sky.heliocentric_days(mjd, ra, dec), sky.heliocentric_days(mjd, ra + 180, -dec))
    assert ahead == pytest.approx(-behind, rel=1e-9) and 0.98 < behind * 86400 / 499.004784 < 1.02


def test_positions_in_prose(spark):
    got = one(spark, text.positions(F.lit("seen at 05:34:31.9, +22:00:52 and 12:01:02 -03:04:05.5; not 1:2:3")))[0]
    assert [tuple(r) for r in got] == [("05:34:31.9", "+22:00:52"), ("12:01:02", "-03:04:05.5")]


def test_fingerprint(spark):
    rows = [(1, "a"), (2, None), (3, "c"), (3, "c")]
    of = lambda r: tuple(upsert.fingerprint(spark.createDataFrame(r, "k long, v string").repartition(3), ["k", "v"]).first())
    assert of(rows) == of(rows[::-1])
    assert len({of(rows), of(rows[:3]), of([(1, "b"), *rows[1:]]), of([])}) == 4


def test_subsets(spark):
    got = spark.createDataFrame([(["a", "b", "c", "d"],), ([],), (None,)], "m array<string>").select(catalogue.subsets("m", 2, 3).alias("s")).collect()
    assert len(got[0].s) == len({tuple(x) for x in got[0].s}) == math.comb(4, 2) + math.comb(4, 3)
    assert got[1].s == [] and got[2].s is None
    with pytest.raises(Exception, match="over 20 members"):
        spark.createDataFrame([([str(i) for i in range(21)],)], "m array<string>").select(catalogue.subsets("m", 2, 3)).collect()


def test_mirror_prunes_its_scope(spark, tmp_path):
    path = str(tmp_path / "mirror")
    rows = [(1, "a"), (2, "b"), (3, "c")]
    upsert.mirror(path, spark.createDataFrame(rows, "k long, night string"), "night")
    new = spark.createDataFrame([(9, "a")], "k long, night string")
    upsert.mirror(path, new, "night", scope=["a", "b"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "night").collect()) == [(3, "c"), (9, "a")]


def test_clipped_equals_plain_rounds(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    values = {g: np.concatenate([rng.normal(0, 1, 300), rng.normal(0, 40, 12)]) for g in ("x", None)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("x", None)], "g string, v double").repartition(4)
    for r in stats.clipped(df, ["g"], "v").collect():
        v = values[r.g]
        for _ in range(3):
            v = v[abs(v - np.median(v)) <= 3 * v.std()]
        assert (r.n, r.median) == (len(v), pytest.approx(np.median(v))) and r.deviation == pytest.approx(v.std())
