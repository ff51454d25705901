import pytest
from pyspark.sql import functions as F

from orrery.functions import sky
from orrery.sources.optional import has_column, has_table, optional_table


def test_tables_and_columns_that_may_be_lacking(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(1, "a"), (2, None)], "k long, `odd.name` string").write.parquet(path)
    assert has_table(spark, path) and not has_table(spark, path + "2")
    assert has_column(spark, path, "k") and has_column(spark, path, "odd.name") and not has_column(spark, path, "K") and not has_column(spark, path + "2", "k")
    got = optional_table(spark, path, {"odd.name": "string", "k": "int", "note": "double"})
    assert got.dtypes == [("odd.name", "string"), ("k", "int"), ("note", "double")] and sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [("a", 1, None), (None, 2, None)]
    none = optional_table(spark, path + "2", {"k": "long", "note": "string"})
    assert none.dtypes == [("k", "bigint"), ("note", "string")] and none.count() == 0


def test_pixels_and_back(spark):
    """A plate solution inverted, near the pole and over 0 hours too."""
    cd, ref = [[-0.0005, 0.0001], [0.0002, 0.0006]], (1024.0, 768.0)
    spots = spark.createDataFrame([(float(x), float(y), ra, dec) for x in (0, 1024, 3000) for y in (-50, 768, 2000) for ra, dec in ((30.0, 20.0), (359.9, -45.0), (120.0, 89.7))], "x double, y double, ra0 double, dec0 double")
    there = spots.select("*", *(c.alias(n) for c, n in zip(sky.pixel_to_sky("x", "y", "ra0", "dec0", ref, cd), ("ra", "dec"))))
    back = there.select("x", "y", "ra", *(c.alias(n) for c, n in zip(sky.sky_to_pixel("ra", "dec", "ra0", "dec0", ref, cd), ("x2", "y2"))))
    for r in back.collect():
        assert r["x2"] == pytest.approx(r["x"], abs=1e-6) and r["y2"] == pytest.approx(r["y"], abs=1e-6) and 0 <= r["ra"] < 360
    centre = spark.range(1).select(*sky.pixel_to_sky(F.lit(1024.0), F.lit(768.0), 30.0, 20.0, ref, cd)).first()
    assert tuple(centre) == pytest.approx((30.0, 20.0))
