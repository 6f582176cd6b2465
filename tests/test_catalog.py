"""Every registered query of the engine against its SQL."""

import pytest

from marketloom.plans import audits, catalog, desk, drafts, helpers, newsroom, office, pages, products, reports, streams, translation  # noqa: F401 - they add to the catalogue
from tests.oracle import connect, rows


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, con, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    if name in catalog.SQL:
        want = con.execute(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0


def test_entry_without_text_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
