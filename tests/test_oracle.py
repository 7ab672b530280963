"""Every registered query against its SQL counterpart; the others must give the same rows twice."""

import pytest

from checks import ORACLES, QUERIES
from checks.compare import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_repeatable(spark, name):
    first, again = (sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first and first == again


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
