import glob
import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from orrery.operators.skyindex import _angle, cone_cover, pixel_centre, pixel_reach, read_box, read_cone, sky_pixel, write_by_pixel

FIELDS = "id long, ra double, dec double, pixel string, g double"


def somewhere(rnd, n):
    """Positions all over, at the poles, on edges of pixels and around 0 hours."""
    out = [(0.0, 90.0), (10.0, -90.0), (0.0, 0.0), (45.0, 0.0), (360.0, 0.0), (90.0, math.degrees(math.asin(2 / 3))), (-10.0, 5.0), (719.0, -5.0)]
    for _ in range(n):
        dec = math.degrees(math.asin(rnd.uniform(-1, 1)))
        out.append((rnd.uniform(0, 360), math.copysign(90 - rnd.random() * 0.2, dec) if rnd.random() < 0.1 else dec))
    return out


@pytest.fixture(scope="module")
def stars():
    rnd = random.Random(5)
    crowd = [(rnd.gauss(359.5, 1.5) % 360, rnd.gauss(30, 1.5)) for _ in range(4000)] + [(rnd.uniform(0, 360), 90 - abs(rnd.gauss(0, 1))) for _ in range(2000)]
    return [(i, *p, "x", rnd.uniform(10, 20)) for i, p in enumerate(somewhere(rnd, 4000) + crowd)]


def pixels(spark, places, order):
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "i long, ra double, dec double")
    return [r[0] for r in df.select("i", sky_pixel("ra", "dec", order).alias("p")).orderBy("i").select("p").collect()]


def test_pixels_nest_and_hold_their_centres(spark):
    places = somewhere(random.Random(1), 3000)
    by_order = {o: pixels(spark, places, o) for o in (0, 1, 3, 8, 14, 29)}
    for o, own in by_order.items():
        assert all(0 <= p < 12 << 2 * o for p in own)
        assert [p >> 2 * (29 - o) for p in by_order[29]] == own
    for o in (0, 1, 2, 3, 5):
        every = range(12 << 2 * o)
        assert pixels(spark, [pixel_centre(o, p) for p in every], o) == list(every)
    for o in (3, 8):
        assert all(_angle(p, pixel_centre(o, k)) <= pixel_reach(o) + 1e-12 for p, k in zip(places, by_order[o]))
    assert pixels(spark, [(math.nan, 1.0), (1.0, math.inf)], 5) == [None, None]


def test_pixels_are_of_equal_area(spark):
    rows = spark.range(200_000).select((F.rand(1) * 360).alias("ra"), F.degrees(F.asin(F.rand(2) * 2 - 1)).alias("dec"))
    got = [r[1] for r in rows.groupBy(sky_pixel("ra", "dec", 2)).count().collect()]
    assert len(got) == 192 and all(abs(n - 200_000 / 192) < 6 * math.sqrt(200_000 / 192) for n in got)


@pytest.mark.parametrize("most", [20, 256, 5000])
def test_cover_holds_every_point_in_the_cone(spark, most):
    rnd = random.Random(most)
    cones = [(*p, 0.01 + rnd.random() * 3) for p in somewhere(rnd, 60)] + [(10.0, 20.0, 170.0), (0.0, 90.0, 0.0)]
    for order in (3, 6):
        near = []
        for k, (ra, dec, r) in enumerate(cones):
            spots = [(ra + rnd.uniform(-4, 4) * r, max(-90.0, min(90.0, dec + rnd.uniform(-1, 1) * r))) for _ in range(60)] + [(ra, dec)]
            near += [(k, p) for p in spots if _angle((ra, dec), p) <= math.radians(r)]
        covers = [cone_cover(*c, order, most) for c in cones]
        assert all(a <= b < 12 << 2 * order for c in covers for a, b in c) and all(len(c) <= 12 + most for c in covers)
        assert all(x[1] + 1 < y[0] for c in covers for x, y in zip(c, c[1:]))
        for (k, place), p in zip(near, pixels(spark, [p for _, p in near], order)):
            assert any(a <= p <= b for a, b in covers[k]), (order, cones[k], place)


def test_cone_and_box_equal_a_search_of_all(spark, stars, tmp_path):
    path = f"file://{tmp_path}/stars"
    write_by_pixel(spark.createDataFrame([*stars, (-1, None, 3.0, "x", 1.0), (-2, 3.0, math.nan, "x", 1.0)], FIELDS), path, files=24)
    for ra, dec, r in [(359.5, 30.0, 1.2), (0.3, 29.0, 0.4), (120.0, 89.5, 1.0), (100.0, -89.9, 0.3), (10.0, 0.0, 100.0), (40.0, -40.0, 1e-9)]:
        want = sorted(s[0] for s in stars if _angle((ra, dec), s[1:3]) <= math.radians(r))
        assert sorted(r[0] for r in read_cone(spark, path, (ra, dec), r).select("id").collect()) == want
    for a, b, c, d in [(358.5, 0.5, 29.0, 31.0), (10.0, 80.0, -60.0, 70.0), (0.0, 360.0, 80.0, 90.0), (100.0, 20.0, -5.0, 5.0)]:
        want = sorted(s[0] for s in stars if c <= s[2] <= d and (a <= s[1] % 360 <= b if a <= b else s[1] % 360 >= a or s[1] % 360 <= b))
        assert sorted(r[0] for r in read_box(spark, path, a, b, c, d).select("id").collect()) == want and want


def test_scan_takes_the_ranges_and_skips_the_rest(spark, stars, tmp_path):
    path = f"file://{tmp_path}/stars"
    write_by_pixel(spark.createDataFrame(stars, FIELDS), path, files=24)
    ranges = cone_cover(359.5, 30.0, 1.2)
    groups = [f.metadata.row_group(i).column(f.schema_arrow.get_field_index("pixel")).statistics for f in map(pq.ParquetFile, glob.glob(f"{tmp_path}/stars/*.parquet")) for i in range(f.metadata.num_row_groups)]
    met = [s for s in groups if any(s.min <= b and a <= s.max for a, b in ranges)]
    assert len(groups) >= 20 and 0 < len(met) < len(groups) * 2 / 3
    found = read_cone(spark, path, (359.5, 30.0), 1.2)
    plan = found._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "GreaterThanOrEqual(pixel" in text.split("PushedFilters")[1]
    assert found.count() > 100
    assert read_cone(spark, f"file://{tmp_path}/stars", (200.0, -50.0), 0.0).count() == 0


def test_empty_catalogue(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    write_by_pixel(spark.createDataFrame([], FIELDS), path)
    assert read_cone(spark, path, (1.0, 2.0), 3.0).count() == 0


def test_pixels_are_worked_out_without_branches_or_texts(spark):
    """What stands in a branch is worked out anew wherever it is used."""
    plan = spark.range(3).select(sky_pixel(F.col("id") * 1.5, F.col("id") * 2.0).alias("pixel"))._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan and plan.count("CASE WHEN") <= plan.count("isnan(")
