"""The published summaries hold what the roll-ups they are made of give."""

import json

import pytest

from jobloom.operators import rollups as A
from jobloom.plans import catalog, gold
from jobloom.plans.rollup_queries import DOC_SOURCES
from jobloom.plans.stream_queries import raw_and_master

QUERIES = catalog.load()[0]


def rows(df):
    return [json.loads(r[0]) for r in df.selectExpr("to_json(struct(*), map('ignoreNullFields', 'false'))").collect()]


def unordered(values):
    return sorted(json.dumps(v, sort_keys=True) for v in values)


@pytest.fixture(scope="module")
def tables(spark, sf):
    return raw_and_master(spark, sf)


def test_overview(spark, sf, tables):
    raw, master = tables
    document = json.loads(QUERIES["overview_document"](spark, sf).first()["data"])
    assert (document["totalUnified"], document["totalRawJobs"]) == (master.count(), raw.count())
    for name, df in gold.overview_sections(raw, master, DOC_SOURCES).items():
        want = rows(df)
        if len(df.columns) > 1:
            assert unordered(document[name]) == unordered(want), name
        else:
            assert [document[name]] == [w[df.columns[0]] for w in want], name


def test_refresh_publishes_all(spark, sf, tables):
    _, master = tables
    found = {r["name"]: json.loads(r["data"]) for r in QUERIES["gold_refresh"](spark, sf).collect()}
    assert set(found) == set(gold.DOCUMENTS)
    assert unordered(found["skill_trends"]["trends"]) == unordered(rows(A.skill_trends(master)))
    assert found["company_stats"]["totalCompanies"] == A.company_profile(master).count()


def test_publish_stamps(spark, sf, tables):
    (r,) = QUERIES["publish_gold"](spark, sf).collect()
    raw, master = tables
    assert r["stamped"] and unordered(json.loads(r["data"])["sources"]) == unordered(rows(A.source_health(raw, master, DOC_SOURCES)))


def test_scheduled_run_publishes_all(spark, sf):
    found = {r["name"]: json.loads(r["data"]) for r in QUERIES["scheduled_refresh"](spark, sf).collect()}
    assert set(found) == set(gold.DOCUMENTS)
    assert found["overview"]["totalUnified"] == QUERIES["total_count"](spark, sf).first()[0]


def test_provinces_on_the_map(spark, sf):
    out = QUERIES["geo_enrich_provinces"](spark, sf).collect()
    assert out and len({tuple(r) for r in out}) == len(out)
