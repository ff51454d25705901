import glob
import os

import pytest

from orrery.operators.mirrors import Mirror, MirrorError

FIELDS = "file string, star long, g double"


@pytest.fixture
def rows(spark):
    def made(shift=0.0, files=("a.csv", "b.csv", "", None, "c/d=é")):
        return spark.createDataFrame([(f, i, i + shift) for f in files for i in range(40)] + [("a.csv", 1, 1.0 + shift)] * 2, FIELDS)

    return made


def listed(df):
    return sorted(map(str, map(tuple, df.select("file", "star", "g").collect())))


def test_a_run_cut_half_way_leaves_the_old_version_and_goes_on(spark, rows, tmp_path):
    m = Mirror(spark, f"file://{tmp_path}/gaia", "file")
    with pytest.raises(MirrorError):
        m.read()
    assert m.build(rows(), 1)
    old = listed(rows())
    assert listed(m.read(verify=True)) == old
    new = rows(0.5)
    assert not m.build(new, 2, limit=1)
    assert m.versions() == [1] and listed(m.read()) == old and m.records(2).count() == 1
    first = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/gaia/data/2/*/*.parquet")}
    # a piece that was begun and has no record, as a lost run leaves it
    new.filter("file = 'b.csv'").limit(3).write.parquet(f"file://{tmp_path}/gaia/data/2/_piece=x{b'b.csv'.hex().upper()}")
    assert not m.build(new, 2, limit=2) and m.versions() == [1]
    assert m.build(new, 2) and m.versions() == [1, 2]
    assert {f: os.stat(f).st_mtime_ns for f in first} == first  # done pieces were not written again
    assert listed(m.read(verify=True)) == listed(new) and listed(m.read(1)) == old
    with pytest.raises(MirrorError):
        m.build(new, 2)


def test_inputs_that_change_while_a_version_is_built(spark, rows, tmp_path):
    m = Mirror(spark, f"file://{tmp_path}/gaia", "file", keep=1)
    assert not m.build(rows(), 1, limit=3)
    later = rows(2.0, ("a.csv", None, "e"))
    assert m.build(later, 1) and listed(m.read(verify=True)) == listed(later)
    assert m.build(rows(3.0), 2) and m.versions() == [2]
    assert not os.path.exists(f"{tmp_path}/gaia/data/1") and not os.path.exists(f"{tmp_path}/gaia/records/1")
    with pytest.raises(MirrorError):
        m.read(1)


def test_damage_is_found(spark, rows, tmp_path):
    m = Mirror(spark, f"file://{tmp_path}/gaia", "file")
    m.build(rows(), 7)
    gone = glob.glob(f"{tmp_path}/gaia/data/7/*/*.parquet")[0]
    os.remove(gone)
    with pytest.raises(MirrorError, match="damaged"):
        m.read(verify=True)
    with pytest.raises(ValueError):
        Mirror(spark, "x", "file", keep=0)
