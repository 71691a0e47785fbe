"""Every query against its SQL on the smallest tables."""

import pytest

from framelode.plans.registry import ORACLES, QUERIES

from .oracle import compare, connect


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    assert compare(spark, duck, QUERIES[name], ORACLES[name], sf) == ""


def test_sample_is_the_same_each_time(spark, sf):
    a, b = (sorted(map(tuple, QUERIES["deterministic_sample"](spark, sf).collect())) for _ in range(2))
    assert a == b and len(a) == 25


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
