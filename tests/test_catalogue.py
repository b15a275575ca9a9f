"""Every registered query against its SQL twin at the smallest scale."""

import pytest

import __spark_entry__ as entry
import check
from crawlkit.plans import catalogue, oracles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_every_query_has_a_twin():
    assert set(catalogue.QUERIES) == set(oracles.ORACLES)
    assert set(catalogue.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    verdict = check.compare(spark, con, name, SF)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    assert entry.entry(spark).count() > 0
