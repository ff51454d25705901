import datetime
import math

import numpy as np
import pytest

from orrery.functions import special
from orrery.operators import calibration, finds, series
from orrery.operators.entity import connected_components
from pyspark.sql import functions as F

D = datetime.date
FRAME = "id long, kind string, object string, night date, at double, filter string, exposure double, gain double, offset double, set_temp double, bin_x int, rotator double"


def frames(spark):
    rows, n = [], 0

    def add(k, kind, night, at, **v):
        nonlocal n
        for i in range(k):
            n += 1
            x = {"object": None, "filter": None, "exposure": 60.0, "gain": 100.0, "offset": 10.0, "set_temp": -10.0, "bin_x": 1, "rotator": None} | v
            rows.append((n, kind, x["object"], night, at + i * 60.0, x["filter"], x["exposure"], x["gain"], x["offset"], x["set_temp"], x["bin_x"], x["rotator"]))

    day = 86400.0
    add(25, "DARK", D(2026, 1, 1), 0.0)
    add(25, "DARK", D(2026, 1, 3), 2.9 * day)  # over 36 hours later: a set of its own
    add(5, "DARK", D(2026, 1, 4), 3.9 * day, set_temp=None, exposure=120.0)
    add(4, "BIAS", D(2026, 1, 1), 0.5 * day, exposure=0.0)
    add(10, "FLAT", D(2026, 1, 3), 2.0 * day, object="A", filter="L", exposure=1.0, rotator=90.2)
    add(10, "FLAT", D(2026, 1, 5), 4.0 * day, object="A", filter="L", exposure=1.0, rotator=89.9)
    add(7, "LIGHT", D(2026, 1, 4), 3.2 * day, object="A", filter="L", rotator=90.4)
    add(3, "LIGHT", D(2026, 1, 4), 3.3 * day, object="B", filter="R", exposure=300.0, rotator=10.0, gain=0.0)
    return spark.createDataFrame(rows, FRAME)


def test_coverage(spark):
    f = frames(spark)
    sets = calibration.calibration_sets(f).collect()
    assert sorted((s["kind"], s["frames"]) for s in sets) == [("BIAS", 4), ("DARK", 5), ("DARK", 25), ("DARK", 25), ("FLAT", 10), ("FLAT", 10)]
    rows = {r["object"]: r for r in calibration.coverage(f).collect()}
    assert rows["A"]["dark_grade"] == "exact" and rows["B"]["dark_grade"] == "missing"
    by = {s["set_id"]: s for s in sets}
    assert by[rows["A"]["dark"]]["night"] == D(2026, 1, 3)
    assert by[rows["A"]["flat"]]["night"] == D(2026, 1, 5) and rows["A"]["flat_grade"] == "fallback"  # a tie goes to the later night
    assert rows["B"]["bias_grade"] == "missing" and rows["A"]["bias_grade"] == "fallback"  # exact on the lights' own night only
    gaps = calibration.dark_gaps(f).collect()
    assert [(g["exposure"], g["lights"]) for g in gaps] == [(300.0, 3)]
    todo = calibration.bias_backlog(f).collect()
    assert [(b["gain"], b["missing"], b["thin"], b["priority"]) for b in todo] == [(0.0, 3, 0, 1), (100.0, 0, 7, 2)]
    assert calibration.calibration_runs(f).count() == 6


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for l in links if l[0] != l[1] for x in l}
    assert got == {x: find(x) for x in linked}


def test_sources_and_tracks(spark):
    c = spark.createDataFrame([(1, "o", 10.0, 20.0), (2, "o", 10.0005, 20.0), (3, "o", 10.0012, 20.0), (4, "o", 11.0, 20.0), (5, "p", 10.0, 20.0), (6, "o", 359.9999, 89.99), (7, "o", 180.0, 89.9999)], "id long, object string, ra double, dec double")
    got = {r["id"]: r["source"] for r in finds.resolved_sources(c).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    rng = np.random.default_rng(3)
    rows = [(100 + i, 1, float(i), 10 + 3.0 * i, 20 - 2.0 * i) for i in range(8)]
    rows += [(200 + i, 1, float(rng.integers(0, 8)), float(rng.uniform(0, 100)), float(rng.uniform(0, 100))) for i in range(30)]
    tracks = finds.linked_tracks(spark.createDataFrame(rows, "id long, night int, at double, x double, y double"), gap=2.0, radius=0.5, least=6).collect()
    assert [t["hits"] for t in tracks] == [list(range(100, 108))]
    alert = spark.createDataFrame([(9, "o", 1.0, 10.0, 0.0, 0.5, 0.0)], "id long, object string, day double, ra double, dec double, rate_ra double, rate_dec double")
    new = spark.createDataFrame([(1, "o", 3.0, 11.0, 0.005), (2, "o", 3.0, 11.2, 0.0), (3, "o", 9.0, 14.0, 0.0)], "id long, object string, day double, ra double, dec double")
    assert [r["id"] for r in finds.on_known_path(new, alert).collect()] == [1]


def test_special_functions(spark):
    assert abs(float(special.incomplete_beta(0.3, 2.0, 5.0)) - 0.579825) < 1e-6
    assert abs(float(special.beta_quantile(0.579825, 2.0, 5.0)) - 0.3) < 1e-5
    assert abs(special.chi_square_tail(3.841459, 1) - 0.05) < 1e-6 and abs(special.chi_square_tail(18.307, 10) - 0.05) < 1e-4
    row = spark.createDataFrame([(0.5, 1.0, 1.0)], "x double, a double, b double").select(special.beta_cdf("x", "a", "b"), special.beta_ppf("x", "a", "b"), special.chi_tail("x", "a")).first()
    assert row[0] == pytest.approx(0.5) and row[1] == pytest.approx(0.5) and row[2] == pytest.approx(math.erfc(math.sqrt(0.25)))


def test_periods_and_polynomials(spark):
    rng = np.random.default_rng(1)
    t = rng.uniform(0, 30, 300)
    rows = [(1, float(x), float(15 + 0.3 * math.sin(2 * math.pi * x / 1.7) + e), 0.05) for x, e in zip(t, rng.normal(0, 0.05, 300))]
    df = spark.createDataFrame(rows, "star long, t double, y double, e double")
    got = series.best_periods(df, "star", "t", "y", "e", f_min=0.1, f_max=2).first()
    assert abs(got["period"] - 1.7) < 0.01 and got["power"] > 0.8
    p = spark.createDataFrame([(1, float(x), 2 + 3.0 * x - 0.5 * x * x, 1.0) for x in range(10)], "k long, x double, y double, e double")
    assert np.allclose(series.polynomial(p, ["k"], "x", "y", "e").first()["beta"], [2, 3, -0.5])
    s = series.seasons(df.select("star", "t").unionByName(spark.createDataFrame([(1, 200.0)], "star long, t double")), ["star"], "t")
    assert s.agg(F.max("season")).first()[0] == 1


def test_recommendation_and_skyline(spark):
    c = spark.createDataFrame([(1, 30.0, 0.7, 10.0, 0.95, False), (1, 60.0, 0.85, 10.0, 0.94, False), (1, 120.0, 0.9, 10.0, 0.9, False), (1, 300.0, 0.99, 10.0, 0.9, True)], "k long, exposure double, noise_share double, overhead double, kept double, blocked boolean")
    assert finds.recommended_exposures(c, ["k"]).first()["exposure"] == 60.0
    e = spark.createDataFrame([(1, 10, 20.0, None), (1, 10, 30.0, None), (1, 20, 40.0, 45.0), (1, 5, None, 12.0)], "k long, bin int, edge double, lower double")
    got = {r["bin"]: r for r in finds.skyline(e, ["k"]).collect()}
    assert got[10]["height"] == 30 and got[15]["height"] == 37.5 and got[20]["height"] == 45 and got[20]["conflict"] and got[0]["height"] == 12
    assert len(got) == 360


def test_order_statistics_equal_sorted_values(spark):
    """Ties, nulls, NaN, null groups and single values; the percentiles are numpy's."""
    import numpy as np

    from orrery.operators import stats

    rng = np.random.default_rng(5)
    values = {"a": np.r_[rng.normal(size=501), np.zeros(300)], "b": rng.integers(0, 4, 100).astype(float), None: np.array([7.0]), "d": np.array([])}
    rows = [(g, float(v)) for g, own in values.items() for v in own] + [("a", None), ("b", float("nan")), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r for r in stats.exact_percentiles(df, ["g"], "x", {"p05": 0.05, "p50": 0.5, "p1": 1.0}).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        assert r["n"] == len(values[g])
        np.testing.assert_allclose([r["p05"], r["p50"], r["p1"]], np.percentile(values[g], [5, 50, 100]), atol=1e-12)


def test_nearest_equals_all_pairs(spark):
    """Ties either way, equal places, null keys and times, keys without a partner."""
    import random

    from orrery.operators import matching

    random.seed(6)
    left = [(i, random.choice("abc"), random.randrange(60)) for i in range(200)] + [(900, None, 5), (901, "z", 5), (902, "a", None)]
    right = [(random.choice("abx"), random.randrange(0, 60, 4), v) for v in range(60)] + [(None, 5, 99), ("a", None, 98)]
    l, r = spark.createDataFrame(left, "id int, k string, at int"), spark.createDataFrame(right, "k string, at int, v int")
    for later in (True, False):
        got = {x["id"]: x["v"] for x in matching.nearest(l, r, ["k"], "at", "v", later=later).collect()}
        assert len(got) == len(left)
        for i, k, at in left:
            near = [(abs(b - at), -b, v) if later else (abs(b - at), v) for a, b, v in right if a is not None and a == k and at is not None and b is not None]
            assert got[i] == (min(near)[-1] if near else None)
