"""Every registered query with an oracle must match DuckDB on the driver tables."""

import pytest

from tests.compare import compare_frames, duck_connect, spark_rows
from tests.conftest import SF_ORACLE

import __spark_entry__ as E

ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    cols, rows = spark_rows(QUERIES[name](spark, SF_ORACLE))
    ok, msg = compare_frames(cols, rows, duck, ORACLES[name])
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns[:2] == ["ordinal", "column"]
