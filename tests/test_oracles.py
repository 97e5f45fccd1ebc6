"""Every registered query that SQL can express equals its SQL on the smallest tables."""

import check
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def database():
    return check.database(FOLDER)


@pytest.mark.parametrize("name", [n for n in ORACLES if not n.endswith("_stream")])
def test_query_equals_sql(spark, database, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = database.sql(ORACLES[name]).df()
    assert check.compare(got, want) == "ok"


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
