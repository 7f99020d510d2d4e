"""Every registered query against its SQL at the smallest scale."""

import pytest

import oracle
from gridmosaic.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = oracle.compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, note


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
