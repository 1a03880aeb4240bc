"""The language models know every character, and score as plain counting does."""

import collections
import math
import os
import sys

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, os.path.dirname(__file__))

import pytest  # noqa: E402

pytest.importorskip("jobloom.llm")
from jobloom.llm import lm  # noqa: E402

#: Letters of four scripts, so that most are none of the commonest.
LATIN, GREEK, RUNES = "abcdefghijklmnopqrstuvwxyz0123456789.,;:!?()-'\"/", "αβγδεζηθικλμνξ", "ᚠᚢᚦᚨᚱᚲ"


def plain_losses(texts, flags, vocabulary):
    """Mean losses of both models by dictionaries."""
    coded = [["^"] * 3 + [" " if c.isspace() else c for c in (t or "").lower()] + ["$"] for t in texts]
    coded = [["$"] * 3 + s[3:] for s in coded]
    counts = [collections.Counter(), collections.Counter()]
    for s, good in zip(coded, flags):
        for i in range(3, len(s)):
            g = tuple(s[i - 3:i + 1])
            counts[1][g] += 1
            counts[0][g] += good
    scale = sum(counts[0].values()) / sum(counts[1].values())
    counts[1] = {g: n * scale for g, n in counts[1].items()}

    def model(count):
        by = []
        for k in range(1, 5):
            c, total, kinds = collections.Counter(), collections.Counter(), collections.Counter()
            for g, n in count.items():
                c[g[4 - k:]] += n
            for g, n in c.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += n > 0
            by.append((c, total, kinds))

        def p(g):
            if not g:
                return 1 / vocabulary
            c, total, kinds = by[len(g) - 1]
            kind = max(kinds[g[:-1]], 1)
            return (c[g] + kind * p(g[1:])) / (total[g[:-1]] + kind)
        return p

    models = [model(c) for c in counts]
    return [[sum(-math.log(p(tuple(s[i - 3:i + 1]))) for i in range(3, len(s))) / (len(s) - 3) for p in models] for s in coded]


def frames(spark, texts, good):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")


def test_losses_are_those_of_plain_counting_over_all_characters(spark):
    texts = [LATIN * 3, GREEK + " " + GREEK[::-1], RUNES * 2, "abc αβγ\tᚠᚢ", None, "", "aβc", GREEK[:5] + LATIN[:9]]
    good = [1, 0, 1, 0, 0, 1, 1, 0]
    docs, labels = frames(spark, texts, good)
    models = lm.fit(docs, labels)
    every = {c for t in texts for c in (t or "").lower()} - {"\t"}
    assert len(every) > lm.SYMBOLS and models.base == len(every) + 2
    got = {r.doc_id: r for r in lm.score_documents(docs, models).collect()}
    for i, (target, background) in enumerate(plain_losses(texts, good, models.base)):
        assert math.isclose(got[i].target_loss, target, rel_tol=1e-5)
        assert math.isclose(got[i].background_loss, background, rel_tol=1e-5)
        assert got[i].n_tokens == len(texts[i] or "") + 1


def test_texts_of_rare_characters_are_told_apart(spark):
    """The good ones are Greek, the others runes; either is rare beside Latin."""
    texts = [LATIN * 20] * 5 + [GREEK] * 4 + [RUNES] * 4
    docs, labels = frames(spark, texts, [0] * 5 + [1] * 2 + [0] * 6)
    score = {r.doc_id: r.score for r in lm.score_documents(docs, lm.fit(docs, labels)).collect()}
    assert score[7] < 0 < score[11] and score[5] == score[8]


def test_other_documents_and_more_characters_than_one_symbol_each(spark, monkeypatch):
    docs, labels = frames(spark, [LATIN + GREEK, RUNES], [1, 0])
    models = lm.fit(docs, labels)
    other = spark.createDataFrame([(0, "ab ᛒᛖ zq βα"), (1, RUNES)], "doc_id long, text string")
    rows = lm.score_documents(other, models).orderBy("doc_id").collect()
    assert all(math.isfinite(r.score) for r in rows) and rows[1].score > 0
    monkeypatch.setattr(lm, "LIMIT", 50)
    table = lm.symbol_table([ord(c) for c in LATIN + GREEK + RUNES])
    assert lm.vocabulary(len(LATIN + GREEK + RUNES)) == 51
    written = [tuple(lm._coded(c, table)) for c in LATIN + GREEK + RUNES]
    assert len(set(written)) == len(written) and {len(w) for w in written} == {1, 2}
    text = "aᚠbᚢ"
    assert sum((list(lm._coded(c, table)) for c in text), []) == list(lm._coded(text, table))
