"""The distributed merge gives the sequential scan's result, pair by pair."""

import datetime
import random

import pytest

from jobloom.operators import resolve as D
from scan import Posting, scan

SCHEMA = ("job_url string, source string, job_title string, company_name string, salary string, "
          "level string, created_at timestamp")
SOURCES = ["a", "b", "c"]


def make(seed, n, companies=None, titles=None, shared_urls=True):
    rng = random.Random(seed)
    companies = companies or ["Công ty TNHH Acme", "Acme", "Acmes", "acme global", "ACME Global Ltd", "", None,
                              "Abacus Soft", "Abacus Softs", "Ab", "Abc", "Zeta Corp", "acme globals"]
    words = "senior java developer backend engineer tester nhân viên kinh doanh remote lead of data".split()
    titles = titles or [" ".join(rng.sample(words, rng.randint(1, 5))) for _ in range(12)]
    rows = []
    for i in range(n):
        title = rng.choice(titles)
        if rng.random() < 0.5:
            at = rng.randrange(len(title) + 1)
            title = title[:at] + rng.choice("xyz ") + title[at:]
        if rng.random() < 0.2:
            w = title.split()
            rng.shuffle(w)
            title = " ".join(w)
        url = f"u{rng.randrange(n * 2 if shared_urls else 10 ** 9)}"
        rows.append(dict(
            job_url=url, source=rng.choice(SOURCES + ["z"]), job_title=title, company_name=rng.choice(companies),
            salary=rng.choice([None, "10 triệu", "11 triệu", "Thương lượng", "20 - 30 triệu"]),
            level=rng.choice([None, "Senior", "Junior", "Seniors"]),
            created_at=datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(50))))
    seen, out = set(), []
    for r in rows:  # a URL occurs once per source
        if (r["source"], r["job_url"]) not in seen:
            seen.add((r["source"], r["job_url"]))
            out.append(r)
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def plain(spark, rows):
    return [Posting(r.source, r.job_url, r.created_at, r.c, r.t, r.s, r.l, r.block)
            for r in D.comparable(frame(spark, rows), D.MatchRule()).collect()]


def run(spark, rows, master=None, t=0.9, characters=True, crowded=D.CROWDED):
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    old = None
    if master is not None:
        old = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in master], SCHEMA)
    out = D.resolve(df, old, SOURCES, D.MatchRule(t, characters), crowded)
    return sorted((r.source, r.job_url, r.status, r.kept_url or "") for r in out.collect() if r.status != "existing")


def expect(spark, rows, master=(), **kw):
    return sorted((s, u, st, k or "") for s, u, st, k in scan(plain(spark, rows), SOURCES, plain(spark, master) if master else (), **kw))


@pytest.mark.parametrize("seed,crowded", [(1, 50), (3, -1)])
def test_equals_scan(spark, seed, crowded):
    rows = make(seed, 120)
    got = run(spark, rows, crowded=crowded)
    assert got == expect(spark, rows)
    assert {s for _, _, s, _ in got} == {"kept", "duplicate"}


@pytest.mark.parametrize("t,characters", [(0.9, False), (0.75, True), (0.5, True), (1.0, True)])
def test_other_thresholds(spark, t, characters):
    rows = make(7, 80)
    assert run(spark, rows, t=t, characters=characters) == expect(spark, rows, t=t, characters=characters)


@pytest.mark.parametrize("crowded", [50, -1])
def test_incremental(spark, crowded):
    rows = make(11, 120)
    master, batch = rows[:50], rows[50:]
    assert run(spark, batch, master, crowded=crowded) == expect(spark, batch, master=master)


@pytest.mark.parametrize("crowded", [50, 5])
def test_crowd_of_near_copies(spark, crowded):
    """A third of all postings are near copies of one another, all texts different."""
    rows = make(13, 60, shared_urls=False)
    for i in range(60):
        rows.append(dict(rows[0], job_url=f"near{i}", source="c", company_name="Acme",
                         job_title=f"Senior backend engineer for payments number {i:03d}", salary=None))
    assert run(spark, rows, crowded=crowded) == expect(spark, rows)


def test_second_run_adds_nothing(spark):
    rows = make(17, 100)
    kept = {(s, u) for s, u, st, _ in run(spark, rows) if st == "kept"}
    master = [r for r in rows if (r["source"], r["job_url"]) in kept]
    assert not [x for x in run(spark, rows, master) if x[2] == "kept"]


def test_three_in_a_row(spark):
    """2 ~ 1 and 3 ~ 2 but not 3 ~ 1: the third is kept because the second is a copy."""
    base = dict(company_name="Acme", salary=None, level=None, source="a")
    at = datetime.datetime(2024, 1, 1)
    titles = ["abcdefghij", "abcdefghijX", "abcdefghXYijX"]
    rows = [dict(base, job_url=f"u{i}", job_title=t, created_at=at + datetime.timedelta(minutes=i))
            for i, t in enumerate(titles)]
    assert run(spark, rows) == expect(spark, rows)


def test_links_and_report(spark):
    rows = make(19, 100)
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    decisions = D.resolve(df, sources=SOURCES)
    links = D.link_duplicates(decisions)
    want = {(k, s, u) for s, u, st, k in scan(plain(spark, rows), SOURCES) if st == "duplicate" and k != u}
    assert {tuple(r) for r in links.collect()} == want
    report = {r.source: (r.total, r.new, r.duplicate) for r in D.sync_report(decisions).collect()}
    total = report.pop(None)
    assert total == tuple(map(sum, zip(*report.values()))) and total[0] == len(rows)
    kept = D.new_postings(df, decisions)
    for r in D.attach_links(kept, links).collect():
        listed = r.extra_info.duplicate_sources
        assert sorted(map(tuple, listed or [])) == sorted((s, u) for k, s, u in want if k == r.job_url)


def test_links_of_a_crowd_are_all_kept(spark):
    from jobloom.operators.rollups import merged_count

    kept = spark.createDataFrame([("u",), ("v",)], "job_url string")
    links = spark.range(12_000).selectExpr("'u' AS kept_url", "'s' AS source", "concat('c', id) AS job_url")
    out = D.attach_links(kept, links)
    assert {r.job_url: r.n for r in out.selectExpr("job_url", "size(extra_info.duplicate_sources) AS n").collect()}["u"] == 12_000
    assert merged_count(out).first()[0] == 1
