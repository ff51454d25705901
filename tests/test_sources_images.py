import json

import numpy as np
import zstandard

from orrery.operators import images
from orrery.sources import formats
from pyspark.sql import functions as F


def test_fits_round_trip(spark, tmp_path):
    image = np.random.default_rng(0).normal(100, 5, (20, 30)).astype(np.float32)
    (tmp_path / "a.fits").write_bytes(formats.fits_bytes(image, {"OBJECT": "O'Neill 1", "FILTER": "Ha"}))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    row = formats.fits_headers(files).first()
    assert row["cards"]["OBJECT"] == "O'Neill 1" and row["cards"]["NAXIS1"] == "30"
    assert np.array_equal(formats.fits_image((tmp_path / "a.fits").read_bytes()), image)


def test_attachment():
    data = np.arange(12, dtype="<u2").reshape(3, 4)
    raw = np.frombuffer(data.tobytes(), np.uint8).reshape(-1, 2).T.tobytes()
    got = formats.attachment(zstandard.ZstdCompressor().compress(raw), "zstd+sh", "UInt16", "little", (3, 4))
    assert np.allclose(got, data / 65535)


def test_text_formats(spark, tmp_path):
    lines = spark.createDataFrame([("V001  12.345 -5.1",), ("V002   x.345     ",)], "value string")
    rows = formats.fixed_width(lines, [formats.Field("name", 1, 4, "string"), formats.Field("ra", 6, 12), formats.Field("dec", 13, 17)], required=["ra"]).collect()
    assert [(r["name"], r["ra"], r["dec"], r["bad"]) for r in rows] == [("V001", 12.345, -5.1, False), ("V002", None, None, True)]
    (tmp_path / "x.csv").write_text("# %ECSV 1.0\n# x\nid,mag\n1,2.5\n2,null\n")
    assert [tuple(r) for r in formats.ecsv(spark, str(tmp_path / "x.csv"), "id long, mag double").collect()] == [(1, 2.5), (2, None)]
    (tmp_path / "v.tsv").write_text("#c\nid\tmag\n \tmag\n---\t---\n5\t1.5\n6\t \n")
    assert [tuple(r) for r in formats.commented_tsv(spark, str(tmp_path / "v.tsv"), {"id": "long", "mag": "double"}).collect()] == [(5, 1.5), (6, None)]
    t = spark.createDataFrame([("head\n$$SOE\n 1, 2\n3, 4\n$$EOE\nend",)], "t string").select(formats.between_marks(F.col("t")).alias("x")).first()["x"]
    assert t == ["1, 2", "3, 4"]
    j = spark.createDataFrame([(json.dumps({"fields": ["a", "b"], "data": [["1", "x"], ["2", "y"]]}),)], "j string")
    assert j.select(formats.field_rows(F.col("j"), ["a"]).alias("r")).first()["r"][1] == {"a": "2", "b": "y"}
    logs = spark.createDataFrame([('{"time": "2026-01-02T03:04:05", "level": "INFO", "message": "ok"}',), ("broken",)], "value string")
    assert [r["broken"] for r in formats.log_lines(logs).collect()] == [False, True]
    atlas = spark.createDataFrame([("###MJD m dm uJy duJy F",), ("59000.1 17.1 0.1 500 5 o",), ("59000.2 17.1 0.1 500 0 o",)], "value string")
    assert formats.forced_photometry(atlas).count() == 1


def star(h, w, x, y, flux, s=1.5):
    yy, xx = np.mgrid[:h, :w]
    return flux / (2 * np.pi * s * s) * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * s * s))


def test_sources_and_apertures(spark):
    rng = np.random.default_rng(1)
    image = (rng.normal(50, 1, (64, 80)) + star(64, 80, 20.3, 30.6, 3000) + star(64, 80, 60, 10, 2000)).astype(np.float32)
    df = spark.createDataFrame([(7, 80, image.tobytes())], "id long, width int, pixels binary")
    got = sorted(images.sources(df).collect(), key=lambda r: r["x"])
    assert len(got) == 2 and abs(got[0]["x"] - 20.3) < 0.2 and abs(got[0]["y"] - 30.6) < 0.2
    clean = star(64, 80, 20.3, 30.6, 3000)
    assert abs(images.aperture(clean, 20.3, 30.6, 8) - 3000) < 10
    assert abs(images.half_flux_radius(clean, 20.3, 30.6) - 1.5 * 1.1774) < 0.1
    level, sigma = images.background(image, 16)
    assert abs(np.median(level) - 50) < 0.5 and 0.7 < np.median(sigma) < 1.4
    labels = images.components(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool))
    assert len(np.unique(labels[labels > 0])) == 2


def test_clipped_stack(spark):
    rng = np.random.default_rng(2)
    cube = rng.normal(10, 1, (20, 40, 24)).astype(np.float32)
    cube[3, 5, 5] = 900
    df = spark.createDataFrame([(1, 24, 1.0, c.tobytes()) for c in cube], "g long, width int, weight double, pixels binary")
    blocks = sorted(images.clipped_stack(df, "g").collect(), key=lambda r: r["block"])
    out = np.concatenate([images.plane(b["pixels"], 24) for b in blocks])
    assert out.shape == (40, 24) and abs(out[5, 5] - np.delete(cube[:, 5, 5], 3).mean()) < 0.5
    assert np.abs(out - np.median(cube, 0)).max() < 1.2
