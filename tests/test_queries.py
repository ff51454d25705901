"""Every query with SQL gives the SQL's rows; the rest run."""

import pytest

from orrery.plans import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        said = compare(spark, name, QUERIES[name], ORACLES[name], SF)
        assert said is None or said.endswith("no rows"), said
    else:
        assert QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
