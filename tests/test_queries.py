"""Every registered query of the library against its DuckDB counterpart."""

import pytest

from dossier.plans.catalogue import ORACLES, QUERIES

from .oracle import connect, duck_rows, spark_rows

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = spark_rows(df)
    assert got[0]
    if name in ORACLES:
        want = duck_rows(duck, ORACLES[name])
        assert got[0] == want[0]
        assert got[1] == want[1], [x for x in zip(got[1], want[1]) if x[0] != x[1]][:3]
