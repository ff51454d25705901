import glob
import math
import random
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from orrery.sources.tiles import cone_tiles, good_epoch, packed, read_tiles, unpacked, write_tiles

FIELDS = "ra double, dec double, object long, time double, mag double, err double, flags long, note string"


def epochs():
    rnd = random.Random(8)
    rows = []
    for obj in range(60):
        ra, dec = (10.0, 20.0) if obj < 40 else (rnd.uniform(0, 360), rnd.uniform(-80, 80))  # one tile of most rows
        for _ in range(rnd.randrange(150)):
            mag = rnd.choice([rnd.uniform(12, 20), rnd.uniform(12, 20), math.nan, None, -1.0])
            rows.append((ra, dec, obj, rnd.choice([58000.0, rnd.uniform(58000, 59000)]), mag, rnd.choice([0.01, 0.0, rnd.random()]), rnd.choice([0, 0, 0, 32768]), "x"))
    return rows + [rows[0], rows[0], (None, 1.0, 3, 1.0, 15.0, 0.1, 0, "x"), (1.0, 1.0, None, 1.0, 15.0, 0.1, 0, "x"), (1.0, 1.0, 4, None, 15.0, 0.1, 0, "x")]


def same(a, b):
    bits = lambda v: v if v is None or isinstance(v, int) else struct.pack("<d", v)
    return sorted(tuple(map(str, map(bits, r))) for r in a) == sorted(tuple(map(str, map(bits, r))) for r in b)


@pytest.mark.parametrize("column", [pa.array([], pa.float64()), pa.array([1.5, None, math.nan, -0.0, math.inf, 1e-310]), pa.array([2**62, -(2**63), None, 0, 7]), pa.array([None, None], pa.int64())])
def test_columns_come_back_bit_for_bit(column):
    back = unpacked(packed(column), column.type)
    assert back.type == column.type and same([(v,) for v in back.to_pylist()], [(v,) for v in column.to_pylist()])
    assert back.is_null().to_pylist() == column.is_null().to_pylist()


def test_round_trip_in_bounded_blocks(spark, tmp_path):
    rows, path = epochs(), f"file://{tmp_path}/tiles"
    write_tiles(spark.createDataFrame(rows, FIELDS), path, ["mag", "err", "flags"], files=12, block=64)
    kinds = {"mag": "double", "err": "double", "flags": "long"}
    got = read_tiles(spark, path, kinds).drop("tile").collect()
    assert same(map(tuple, got), [(r[2], r[3], *r[4:7]) for r in rows if None not in r[:4]])
    parts = [pq.read_table(f) for f in glob.glob(f"{tmp_path}/tiles/*.parquet")]
    sizes = [n for p in parts for n in p["epochs"].to_pylist()]
    assert max(sizes) == 64 and sum(sizes) == len(got)
    hot = max({t for p in parts for t in p["tile"].to_pylist()}, key=lambda t: sum(n for p in parts for k, n in zip(p["tile"].to_pylist(), p["epochs"].to_pylist()) if k == t))
    assert sum(hot in p["tile"].to_pylist() for p in parts) >= 6  # a tile of most rows is spread over tasks
    for p in parts:
        ends = list(zip(p["tile"].to_pylist(), p["first_object"].to_pylist(), p["first_time"].to_pylist()))
        assert ends == sorted(ends)


def test_reads_take_only_the_blocks_they_need(spark, tmp_path):
    rows, path = [r for r in epochs() if None not in r[:4]], f"file://{tmp_path}/tiles"
    write_tiles(spark.createDataFrame(rows, FIELDS), path, ["mag", "err"], good=good_epoch("flags", "mag", "err"), files=6, block=32)
    fine = [r for r in rows if r[6] == 0 and r[4] is not None and not math.isnan(r[4]) and r[4] > 0 and r[5] > 0]
    kinds = {"mag": "double", "err": "double"}
    assert same(map(tuple, read_tiles(spark, path, kinds, objects=(7, 9)).drop("tile").collect()), [r[2:6] for r in fine if 7 <= r[2] <= 9])
    near = read_tiles(spark, path, kinds, tiles=cone_tiles(10.0, 20.0, 0.5))
    assert "GreaterThanOrEqual(tile" in near._jdf.queryExecution().executedPlan().toString()
    assert {r[1] for r in near.collect()} >= {r[2] for r in fine if r[2] < 40} and near.count() < len(fine)
    write_tiles(spark.createDataFrame([], FIELDS), path, ["mag"])
    assert read_tiles(spark, path, {"mag": "double"}).count() == 0
    with pytest.raises(ValueError):
        write_tiles(spark.createDataFrame([], FIELDS), path, ["note"])
