"""Choices of calibration sets, case by case."""

from datetime import date, timedelta

import pytest

from orrery.operators import calibration

FRAME = "id long, kind string, object string, night date, at double, filter string, exposure double, gain double, offset double, set_temp double, bin_x int, rotator double"
NIGHT = date(2026, 1, 10)


def frames(spark, *sets):
    """(kind, frames, nights from NIGHT, changed fields) as frames."""
    rows = []
    for k, (kind, n, days, more) in enumerate(sets):
        x = {"object": "A", "filter": "L", "exposure": 60.0, "gain": 100.0, "offset": 10.0, "set_temp": -10.0, "bin_x": 1, "rotator": 90.0} | more
        for i in range(n):
            rows.append((1000 * k + i, kind, x["object"], NIGHT + timedelta(days), days * 86400.0 + 60.0 * i + x.get("later", 0.0), x["filter"], x["exposure"], x["gain"], x["offset"], x["set_temp"], x["bin_x"], x["rotator"]))
    return spark.createDataFrame(rows, FRAME)


def chosen(spark, name, *sets, **light):
    """(grade, night, frames, gain and rotator) of the choice for a night's lights."""
    f = frames(spark, ("LIGHT", 4, 0, light), *sets)
    r = calibration.coverage(f).first()
    found = calibration.calibration_sets(f).filter(f"set_id = {r[name]}").first() if r[name] is not None else None
    return r[f"{name}_grade"], found


@pytest.mark.parametrize(
    "flats,grade,days",
    [
        ([("FLAT", 20, 0, {})], "exact", 0),
        ([("FLAT", 20, 0, {"gain": 0.0})], "fallback", 0),  # of another gain
        ([("FLAT", 20, 0, {"rotator": 60.0})], "fallback", 0),  # at another rotation
        ([("FLAT", 20, 0, {"rotator": None})], "exact", 0),
        ([("FLAT", 20, 0, {"rotator": 60.0}), ("FLAT", 20, 5, {})], "fallback", 5),  # a fitting one wins over the own night's
        ([("FLAT", 20, 0, {"rotator": 60.0}), ("FLAT", 20, 9, {"rotator": 85.0})], "fallback", 9),  # of those that don't fit, the nearest angle
        ([("FLAT", 20, 3, {"gain": 0.0}), ("FLAT", 20, 7, {"rotator": 91.0})], "fallback", 7),  # then the same gain, whatever the angle within the tolerance
        ([("FLAT", 20, -2, {}), ("FLAT", 20, 2, {})], "fallback", 2),  # a tie goes to the later night
        ([("FLAT", 2, 0, {}), ("FLAT", 3, 4, {})], "fallback", 4),  # two frames make no master
        ([("FLAT", 20, 0, {"filter": "R"}), ("FLAT", 20, 0, {"bin_x": 2})], "missing", None),
    ],
)
def test_flats(spark, flats, grade, days):
    got, found = chosen(spark, "flat", *flats)
    assert got == grade and (found and (found["night"] - NIGHT).days) == days


@pytest.mark.parametrize(
    "darks,light,grade,frames_",
    [
        ([("DARK", 25, 0, {}), ("DARK", 24, 0, {"set_temp": -10.5})], {}, "exact", 25),
        ([("DARK", 24, 0, {}), ("DARK", 25, 3, {"set_temp": -10.5})], {}, "exact", 25),  # under 120 s a full set has 25
        ([("DARK", 9, 0, {"exposure": 120.0}), ("DARK", 10, 3, {"exposure": 120.0, "set_temp": -10.5})], {"exposure": 120.0}, "exact", 10),  # from 120 s on, 10
        ([("DARK", 10, 3, {"exposure": 119.0, "set_temp": -10.5}), ("DARK", 5, 3, {"exposure": 119.0})], {"exposure": 119.0}, "exact", 5),
        ([("DARK", 30, 0, {"exposure": 300.0}), ("DARK", 30, 0, {"exposure": 30.0})], {}, "fallback", 30),
        ([("DARK", 30, 0, {"set_temp": None})], {}, "fallback", 30),
        ([("DARK", 30, 0, {"set_temp": 1.0}), ("DARK", 2, 0, {})], {}, "missing", None),
    ],
)
def test_darks(spark, darks, light, grade, frames_):
    got, found = chosen(spark, "dark", *darks, **light)
    assert got == grade and (found and found["frames"]) == frames_


def test_biases(spark):
    assert chosen(spark, "bias", ("BIAS", 3, 0, {"exposure": 0.0}))[0] == "exact"
    got, found = chosen(spark, "bias", ("BIAS", 2, 0, {"exposure": 0.0}), ("BIAS", 5, -4, {"exposure": 0.0}), ("BIAS", 4, 4, {"exposure": 0.0}))
    assert got == "fallback" and found["frames"] == 4  # not the two of the own night; on a tie the later


def test_bias_backlog(spark):
    light = lambda days, **more: ("LIGHT", 6, days, more)
    bias = lambda n, days, **more: ("BIAS", n, days, {"exposure": 0.0, **more})
    f = frames(spark, light(0), bias(29, 1), light(0, gain=0.0), bias(29, 1, gain=0.0), bias(30, 9, gain=0.0), light(0, gain=50.0), bias(30, -9, gain=50.0), bias(29, 1, gain=50.0), light(0, gain=25.0), light(2, gain=None), light(2, offset=None))
    got = [(r["gain"], r["missing"], r["thin"], r["priority"]) for r in calibration.bias_backlog(f).orderBy("priority").collect()]
    # 0: a full set was taken later; 50: the full one is older
    assert got == [(25.0, 6, 0, 1), (50.0, 0, 6, 2), (100.0, 0, 6, 3)]
    assert [tuple(r) for r in calibration.unschedulable(f).collect()] == [("no gain or offset", 12)]
