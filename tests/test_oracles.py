"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import pytest

from plumbline.plans.catalog import ORACLES, QUERIES
from tests.duck import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_seeded_sample_is_stable_and_without_replacement(spark):
    one = [r.doc_id for r in QUERIES["seeded_sample"](spark, SF).collect()]
    assert len(one) == len(set(one)) == 100
    assert set(one) == {r.doc_id for r in QUERIES["seeded_sample"](spark, SF).collect()}
