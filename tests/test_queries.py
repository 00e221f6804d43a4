"""Every registered query against its SQL, on the smallest tables."""

import pytest

from check import compare, connect
from workload.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    ok, note = compare(spark, db, sf, name)
    assert ok or note.endswith("EMPTY"), note


def test_every_expected_result_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
