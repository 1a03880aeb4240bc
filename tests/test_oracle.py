"""Every registered query against its SQL twin on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from check import TABLES, compare  # noqa: E402
from jobloom.plans import catalog  # noqa: E402

QUERIES, SQL = catalog.load()
#: queries that SQL cannot express, and the tests that check what they give
COVERED = {
    "html_to_text_exact": "test_golden", "geo_enrich_provinces": "test_summaries", "overview_document": "test_summaries",
    "publish_gold": "test_summaries", "gold_refresh": "test_summaries", "scheduled_refresh": "test_summaries",
}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    status, rows, note = compare(spark, con, QUERIES[name], SQL.get(name), sf)
    assert status == "ok" or status == "rows" and name in COVERED and rows, note


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)
