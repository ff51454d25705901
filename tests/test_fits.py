import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import matching
from orrery.operators.fits import rejecting_fit, searched
from orrery.operators.stats import leave_one_out_rates


def plain_fit(x, y, clip, rounds, least=4):
    a = np.c_[np.ones(len(y)), x]
    kept = np.ones(len(y), bool)
    for _ in range(rounds):
        b = np.linalg.lstsq(a[kept], y[kept], rcond=None)[0]
        rms = np.sqrt(np.mean((y[kept] - a[kept] @ b) ** 2))
        new = np.abs(y - a @ b) <= clip * rms
        if (new == kept).all() or new.sum() < least:
            break
        kept = new
    b = np.linalg.lstsq(a[kept], y[kept], rcond=None)[0]
    return b, kept.sum()


@pytest.mark.parametrize("n_x", [1, 2])
def test_fits_equal_a_plain_loop(spark, n_x):
    rnd = np.random.default_rng(n_x)
    rows, want = [], {}
    for g in range(8):
        n = int(rnd.integers(30, 120))
        x = rnd.normal(1e5, 3, (n, n_x))
        y = 7 + x @ rnd.normal(0, 2, n_x) + rnd.normal(0, 0.1, n)
        y[rnd.random(n) < 0.1] += rnd.normal(0, 30)
        rows += [(f"g{g}", float(v), *map(float, u), *([0.0] if n_x == 1 else [])) for u, v in zip(x, y)]
        want[f"g{g}"] = plain_fit(x - x.mean(0), y, 2.5, 8)
    rows += [("none", 1.0, None, 1.0), ("few", 1.0, 2.0, 3.0), ("flat", 1.0, 2.0, 2.0), ("flat", 2.0, 2.0, 2.0), ("flat", 4.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, y double, x double, z double")
    got = {r["g"]: r for r in rejecting_fit(df, ["g"], "y", ["x", "z"][:n_x], clip=2.5, rounds=8).collect()}
    for g, (b, n) in want.items():
        assert got[g]["n"] == n and abs(got[g]["slope_x"] - b[1]) < 1e-7 and got[g]["rejected"] == sum(r[0] == g for r in rows) - n
        if n_x == 2:
            assert abs(got[g]["slope_z"] - b[2]) < 1e-7
    assert got["flat"]["slope_x"] is None and got["few"]["slope_x"] is None and "none" not in got
    with pytest.raises(ValueError):
        rejecting_fit(df, ["g"], "y", [])


def test_search_finds_the_least_cost_of_each_group(spark):
    rnd, rows = random.Random(2), []
    want = {}
    for g in range(6):
        p = rnd.uniform(0.2, 2.8)
        rows += [(g, t, 3 * t**-p * rnd.uniform(0.97, 1.03)) for t in [rnd.uniform(1, 20) for _ in range(40)]]
    df = spark.createDataFrame([*rows, (0, None, 1.0)], "g long, t double, s double")
    cost = lambda p: (F.log("s") - F.log(F.lit(3.0)) + p * F.log("t")) ** 2
    got = {r["g"]: r for r in searched(df, ["g"], cost, 0.0, 3.0, rounds=9).collect()}
    for g in range(6):
        u, v = np.array([(np.log(t), np.log(s / 3)) for k, t, s in rows if k == g]).T
        want[g] = -(u @ v) / (u @ u)
        assert abs(got[g]["parameter"] - want[g]) < 1e-5 and abs(got[g]["least"] - ((v + want[g] * u) ** 2).sum()) < 1e-9
    edge = searched(df, ["g"], lambda p: p, 0.5, 3.0, rounds=3).collect()
    assert all(r["parameter"] == 0.5 for r in edge)


def test_leaving_a_night_out_equals_refitting(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["R", "Ha"]), rnd.randrange(3), rnd.randrange(9), rnd.random() < 0.6) for _ in range(400)] + [("O", 7, 3, True)] * 5
    df = spark.createDataFrame([*rows, (None, 1, 1, True), ("R", 1, None, True)], "filter string, bin long, night long, kept boolean")
    got = {(r["night"], r["filter"], r["bin"]): r for r in leave_one_out_rates(df, ["filter", "bin"], "night", F.col("kept")).collect()}
    assert got.keys() == {(n, f, b) for f, b, n, _ in rows}
    for (night, filt, b), r in got.items():
        rest = [x for x in rows if x[2] != night]
        rate = (sum(x[3] for x in rest) + 1) / (len(rest) + 2)
        for own in ([x for x in rest if x[0] == filt], [x for x in rest if x[:2] == (filt, b)]):
            rate = (sum(x[3] for x in own) + 40 * rate) / (len(own) + 40)
        assert abs(r["rate"] - rate) < 1e-12 and r["n"] == len(own) and r["own_n"] == sum(x[:3] == (filt, b, night) for x in rows)


def test_rematching_equals_matching_all_anew(spark):
    rnd = random.Random(7)
    left = spark.createDataFrame([(i, rnd.randrange(12), float(rnd.randrange(100))) for i in range(300)], "id long, g long, at double")
    old = [(rnd.randrange(10), float(rnd.randrange(100)), 1000 + i) for i in range(60)]
    gone, new = [c for c in old if c[0] == 3][:2], [(4, 50.0, 2000), (11, 5.0, 2001), (4, 50.0, 2000)]
    fields = "g long, at double, value long"
    match = lambda a, b: matching.nearest(a, b, ["g"], "at", "value").drop("distance")
    recorded = match(left.filter("id < 290"), spark.createDataFrame(old, fields))
    right = spark.createDataFrame([c for c in old if c not in gone] + new, fields)
    got = matching.rematched(recorded, left, right, spark.createDataFrame(gone + new, fields), ["g"], match, "value")
    want = {r["id"]: r["value"] for r in match(left, right).collect()}
    rows = got.collect()
    assert {r["id"]: r["value"] for r in rows} == want and len(rows) == 300
    assert {r["id"]: r["was"] for r in rows if r["id"] < 290} == {r["id"]: r["value"] for r in recorded.collect()}
    # what is matched anew are the changed groups and the rows without a record
    seen = []
    matching.rematched(recorded, left, right, spark.createDataFrame(gone + new, fields), ["g"], lambda a, b: (seen.append((a, b)), match(a, b))[1], "value")
    fresh = {r["g"] for r in left.filter("id >= 290").collect()}
    assert {r["g"] for r in seen[0][1].collect()} <= {3, 4, 11} | fresh
