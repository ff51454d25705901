import math

import numpy as np

from orrery.operators import motion


def test_kepler():
    year = 2 * math.pi / math.sqrt(motion.MU)
    x, y = motion.perihelion_state(np.array([1.0, 0.5]), np.array([0.0, 0.5]), np.array([year / 4, year]))
    assert np.allclose([x[0], y[0]], [0, 1], atol=1e-9) and np.allclose([x[1], y[1]], [0.5, 0], atol=1e-6)
    # parabola: Barker's equation
    d = math.tan(math.radians(35))
    dt = math.sqrt(2 / motion.MU) * (d + d**3 / 3)
    x, y = motion.perihelion_state(1.0, 1.0, dt)
    assert np.allclose([math.hypot(x, y), math.atan2(y, x)], [1 + d * d, 2 * math.atan(d)], atol=1e-9)
    x, y = motion.perihelion_state(1.0, 1.5, 400.0)
    r = math.hypot(float(x), float(y))
    assert abs(r - 1.0 * 2.5 / (1 + 1.5 * float(x) / r)) < 1e-9


def test_orbits_and_passes(spark):
    o = spark.createDataFrame([(1, 1.0, 0.0, 90.0, 0.0, 0.0, 0.0)], "id long, q double, e double, inclination double, node double, argument double, perihelion double")
    year = 2 * math.pi / math.sqrt(motion.MU)
    rows = motion.orbit_positions(o, [0.0, year / 4]).collect()
    assert np.allclose([rows[1]["x"], rows[1]["y"], rows[1]["z"]], [0, 0, 1], atol=1e-9)
    t = [(b, float(i), 10.0 + (i * 0.5 if b == "m" else 3.0), 0.0) for b in ("m", "p") for i in range(20)]
    got = motion.close_passes(spark.createDataFrame(t, "body string, t double, ra double, dec double"), 1.1, 1.0).collect()
    assert [(g["began"], g["ended"], g["at"]) for g in got] == [(4.0, 8.0, 6.0)]
    assert motion.hermite(0.5, 0.0, 1.0, 0.0, 0.0, 1.0, 3.0) == 0.125


def test_seasons_and_minimum(spark):
    items = spark.createDataFrame([(1, "a", 10.0, 1.0), (1, "b", 5.0, 1.0)], "g long, item string, need double, weight double")
    rows = motion.season_plan(items, "g", 8.0).collect()
    assert sum(r["hours"] for r in rows) == 15 and max(r["season"] for r in rows) == 2 and all(r["finished"] for r in rows if r["season"] == 2)
    t = np.linspace(0, 1, 101)
    mid, error = motion.mirrored_minimum(t, (t - 0.437) ** 2 + np.random.default_rng(0).normal(0, 0.001, 101))
    assert abs(mid - 0.437) < 0.01 and error < 0.02
