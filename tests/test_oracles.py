"""Every registered query beside its oracle on the smallest tables."""

import pytest
from compare import compare, duck_connection

from __spark_entry__ import entry
from tallystone.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_gives_rows(spark):
    assert entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    problems = compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert [p for p in problems if p != "no rows at all"] == []
