"""Every query of the library runs, and agrees with its SQL."""

import pytest
from compare import rows, tables

from lodestone.plans import build_queries, composed, lookup_queries  # noqa: F401  register their queries
from lodestone.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(DATA)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.endswith("_whole")))  # the others are second names
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        want = con.execute(SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
