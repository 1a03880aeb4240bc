"""The character ratio worked out in Spark equals that of a plain matcher, one pair after the other."""

import random
from difflib import SequenceMatcher

import pytest

from jobloom.functions import similarity as S
from jobloom.operators import matching, resolve
from scan import scan
from test_resolve import SCHEMA, SOURCES, frame, plain


def pairs():
    """Texts below and above the length from which popular characters count less, edited copies and strangers."""
    rng = random.Random(4)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    rows = []
    for i in range(160):
        letters = rng.choice(["ab", "abcdefghijklmnopqrst ", "aaaaaaaaaaab cdefgh"])
        a = text(rng.randint(1, rng.choice([5, 60, 199, 420])), letters)
        b = list(a) if rng.random() < 0.6 else list(text(rng.randint(1, 420), letters))
        for _ in range(rng.randint(0, 1 + len(b) // 12)):
            at = rng.randrange(len(b) + 1)
            b[at: at + rng.randint(0, 3)] = text(rng.randint(0, 3), letters + "zq1é漢")
        rows.append((i, a, "".join(b)))
    return rows + [(900, None, "a"), (901, "", ""), (902, "", "x"), (903, "a" * 300 + "q", "a" * 250 + "z"),
                   (904, "the " * 80 + "xyz", "the " * 70), (905, "same", "same"), (906, "aaab", "baca"), (907, "baca", "aaab")]


@pytest.mark.parametrize("few", [500_000, 40])
def test_ratios_equal_plain_ones(spark, monkeypatch, few):
    """Also with so small a bound that most rectangles begin as rows of islands."""
    monkeypatch.setattr(matching, "FEW", few)
    rows = pairs() if few > 1000 else pairs()[:24] + pairs()[-8:]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    got = {r.id: r.ratio for r in S.with_ratios(df, {"ratio": ("a", "b")}).collect()}
    assert len(got) == len(rows)
    for i, a, b in rows:
        want = None if a is None or b is None else SequenceMatcher(None, a, b).ratio()
        assert got[i] == want, (a, b)


def test_ratios_of_nothing(spark):
    empty = spark.createDataFrame([], "a string, b string")
    assert S.with_ratios(empty, {"ratio": ("a", "b")}).count() == 0


def test_long_titles_with_repeated_words(spark):
    """Word sets may be alike while the numbers of words are not, and texts may differ far from their start."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(400)}" for _ in range(260)]
    more = words + words[:60]                       # the same set of words, many more words
    other = words[:200] + [f"v{i}" for i in range(60)]   # agrees for its first 200 words only
    near = words[:-2] + ["x", "y"]
    rows = [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], (f"u{i}", "a", " ".join(t), "Acme", None, None, None)))
            for i, t in enumerate([words, more, other, near])]
    for characters in (False, True):
        rule = resolve.MatchRule(0.9, characters)
        got = sorted((r.source, r.job_url, r.status, r.kept_url) for r in resolve.resolve(frame(spark, rows), None, SOURCES, rule).collect())
        assert got == sorted(scan(plain(spark, rows), SOURCES, characters=characters))
        assert [s for _, _, s, _ in got] == ["kept", "duplicate", "kept", "duplicate"]


def test_pairs_of_common_size_stay_in_tasks(spark, monkeypatch):
    """Only a pair too large for a task has its equal characters as rows."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(n))
    rows = [(text(3000), text(3000)), ("x" + text(400), "x" + text(900)), ("ab" * 90, "ba" * 99)]
    asked = []
    monkeypatch.setattr(matching, "_in_rows", lambda texts: asked.append(texts.count()) or [])
    got = {(r.a, r.b): r.ratio for r in S.with_ratios(spark.createDataFrame(rows, "a string, b string"), {"ratio": ("a", "b")}).collect()}
    assert got == {(a, b): SequenceMatcher(None, a, b).ratio() for a, b in rows} and not asked
    monkeypatch.setattr(matching, "FEW", 100)
    S.with_ratios(spark.createDataFrame(rows, "a string, b string"), {"ratio": ("a", "b")}).collect()
    assert sum(asked) == 1          # in the long texts every letter is too frequent to be joined


def test_trigram_similarity_equals_that_of_sets(spark, capsys):
    """Texts are matched as arrays of numbers, not by a native list of strings for each text."""
    rng = random.Random(8)
    words = ["alpha", "Beta", "été", "ΣΊΣΥΦΟΣ", "İstanbul", "漢字", "𝒳𝒴𝒵", "x", "42", "a-b", "--", "\n", ""]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(200)]
    rows += [(900, None, None), (901, None, "a"), (902, "", " .,"), (903, "ab " * 3000, "ab ba " * 2000)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    new, old = S.trigram_similarity("a", "b"), S.set_overlap(S.trigrams("a"), S.trigrams("b"))
    assert df.where(~new.eqNullSafe(old)).count() == 0 and df.where(new.isNull()).count() == 0
    df.select(new.alias("sim")).explain()
    assert "transform(" not in capsys.readouterr().out
