"""Periodic runs against plain versions, and on awkward tables."""

import hashlib
import random
import re
import sys
import zlib
from fractions import Fraction
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import awkward  # noqa: E402
from jobloom.llm import queries, runs  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every maximal stretch of at least two periods, by comparing each word with the one a period on."""
    number = {}
    w = [number.setdefault(x, len(number)) for x in words]
    least = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                least.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in least.items())


def long_runs(words):
    return [r for r in plain_runs(words) if r[1] >= max(24, 3 * r[2])]


def collapsed(words, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_small_sequences():
    rng = random.Random(1)
    for _ in range(1500):
        w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 40))]
        assert runs.runs_of(w) == plain_runs(w), w


def texts():
    """Runs of all kinds among other words: nested ones, neighbours, near the least length, across white space, at both ends."""
    rng = random.Random(9)
    out = []
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 6)):
            words += rng.choices("a b c the of dog cat x y z".split(), k=rng.randint(0, 30))
            part = rng.choices(["a", "b", "q", "The", "the"], k=rng.choice([1, 2, 3, 5, 8, 9, 12, 30]))
            many = rng.choice([22, 23, 24, 25, 3 * len(part) - 1, 3 * len(part), 4 * len(part) + 1])
            words += (part * 30)[:many]
        out.append("".join(w + rng.choice([" ", "\n", "\t \x0b", " "]) for w in words))
    inner = (["u"] * 25 + ["v"]) * 4
    out += [" ".join(inner), " ".join(["long"] * 3000), "  ".join(["x"] * 40), "a b " * 40, "x " * 24, "x " * 23, None, "", " \n"]
    return out


def test_found_runs_equal_plain_ones(spark):
    table = list(enumerate(texts()))
    got = {r["_key"]: r for r in runs.find_runs(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()}
    some = 0
    for i, text in table:
        words = WORD.findall(text or "")
        want = long_runs(words)
        want.sort(key=lambda r: (r[0], r[2]))
        some += len(want)
        assert [tuple(r) for r in got[i].runs] == want, text
        assert (got[i].n_words, got[i].n_runs, got[i].collapsed) == (len(words), len(want), collapsed(words, want))
        best = max(want, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if want else (None,) * 3
        assert (got[i].start, got[i].length, got[i].period) == best
    assert some > 150


def test_awkward_rows_and_empty_tables(spark):
    plain = runs.find_runs(awkward.docs(spark)).collect()
    clashing = runs.find_runs(awkward.clashing(awkward.docs(spark)).selectExpr("*", "1 AS n_runs", "2 AS runs", "3 AS collapsed")).collect()
    assert sorted(map(str, plain)) == sorted(map(str, clashing)) and len(plain) == len(awkward.rows())
    assert sum(r["_key"] is None for r in plain) == 2
    assert runs.find_runs(awkward.none(spark)).count() == 0


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query_equals_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words, r = planted(doc_id, text), got[doc_id]
        if len(words) > 1500:   # the plain version takes the square of the length
            continue
        want = sorted(long_runs(words), key=lambda x: (x[0], x[2]))
        listed = "".join(f"{a},{n},{q}\n" for a, n, q in want)
        assert (r.n_runs, r.runs_sha256) == (len(want), hashlib.sha256(listed.encode()).hexdigest())
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, want).encode()).hexdigest()
        if want:
            best = max(want, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (*best, 1000 * best[1] // best[2])
        else:
            assert r.start is r.length is r.period is r.exponent_milli is None
    assert sum(r.n_runs > 0 for r in got.values()) > 5
