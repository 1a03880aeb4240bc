"""The candidate query lists every matching pair, however crowded a company is."""

import pytest

from jobloom.operators import resolve as D
from jobloom.plans import catalog


@pytest.fixture
def crowd(spark, tmp_path):
    """160 near copies of one document, two of another."""
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i:03d}")
    base = " ".join(f"word{word(i)}" for i in range(40))
    texts = [f"one two three {base} end{word(i)}" for i in range(160)] + ["four five six seven eight", "four five six seven eight"]
    rows = [(i, t, "en", f"src{i % 20}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_pairs_of_a_crowd_are_all_listed(spark, crowd):
    got = [tuple(r) for r in catalog.load()[0]["candidate_edges_tokens"](spark, crowd).collect()]
    url = lambda i: f"https://docs.example/{i}"
    order = sorted(range(160), key=lambda i: (i % 20, i))     # sources first, then time
    assert len(got) == len(set(got)) == 160 * 159 // 2
    assert set(got) == {(url(b), url(a)) for k, a in enumerate(order) for b in order[k + 1:]}


def test_edges_of_the_merge_are_among_them(spark, crowd):
    from jobloom.plans.resolve_queries import SOURCES, TOKENS
    from jobloom.plans.views import document_postings

    ranked, texts = D._ranked(document_postings(spark, crowd), None, SOURCES, TOKENS)
    nodes = D.saved(D._nodes(D._with_shared_url(D.saved(ranked))))
    pairs = lambda e: {(bytes(r.profile) if not isinstance(r.profile, str) else r.profile,
                        bytes(r.candidate) if not isinstance(r.candidate, str) else r.candidate) for r in e.collect()}
    some, every = pairs(D.match_edges(nodes, texts, TOKENS)), pairs(D.all_edges(nodes, texts, TOKENS))
    assert some < every
