"""The operators against plain versions, and on awkward tables."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql.group import GroupedData
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

import awkward  # noqa: E402
from jobloom.llm import decontaminate, exact, licenses, lm, mixing, near, pages, passages, queries, stages, tokens, toxicity  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
PAGES = "page_id long, url string, html string"
ROWS = len(awkward.rows())


def labels(spark, values=((1, 1, 0), (7, 1, 1), (5, 0, 0), (8, 1, None), (None, 1, 1), (7, 1, 0), (999, 0, 1))):
    return spark.createDataFrame(list(values), "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and the dog lay down by"), (2, None), (None, "too short"), (3, "")],
                                 "item_id long, text string")


OPERATORS = {
    "tokens": lambda s, d: tokens.token_counts(d, BPE),
    "near": lambda s, d: near.near_classes(d),
    "near_rows": lambda s, d: near.near_dedup(d),
    "contamination": lambda s, d: decontaminate.find_contamination(d, bench(s)),
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, bench(s)),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, toxicity.train(d, labels(s))),
    "licenses": lambda s, d: licenses.scan_licenses(d),
    "exact": lambda s, d: exact.exact_dedup(d, single=True),
    "lm": lambda s, d: lm.score_documents(d, lm.fit(d, labels(s))),
    "passages": lambda s, d: passages.remove_repeats(d),
    "mixing": lambda s, d: mixing.plan_mix(d),
    "mix": lambda s, d: mixing.mix_sources(d),
}
ALL_ROWS = ("tokens", "near", "toxicity", "licenses", "lm", "passages", "mixing")


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    plain = OPERATORS[name](spark, awkward.docs(spark)).collect()
    clashing = OPERATORS[name](spark, awkward.clashing(awkward.docs(spark))).collect()
    assert len(plain) == len(clashing)
    if name in ALL_ROWS:
        assert len(plain) == ROWS


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, awkward.none(spark)).count() == 0


def test_token_counts_equal_the_library(spark, sf):
    rng = random.Random(3)
    parts = ["a", "b", " ", "\n", "é", "1", ".", "the", "'s", "\x1c", "\u0085", "　", "漢", "ha", "<|endoftext|>"]
    texts = [t for (t,) in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [
        "".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(500)] + ["a" * 5000, "0" * 3001, "ha" * 2000, None, ""]
    library = Tokenizer.from_file(BPE)
    want = Counter((len(library.encode(t or "", add_special_tokens=False).ids), len((t or "").encode())) for t in texts)
    got = tokens.token_counts(spark.createDataFrame([(t,) for t in texts], "text string"), BPE).collect()
    assert Counter((r.n_tokens, r.n_bytes) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i: i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def classes(texts, n=5, percent=80):
    """Smallest id reachable, by comparing every pair."""
    sets = {i: shingles(t, n) for i, t in texts}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            changed |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return label, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("n", [4, 5])
def test_near_classes_equal_all_pairs(spark, n):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(400)]
    texts, number = [], 0
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([3, 5, 9, 40, 120, 300]))
        for _ in range(rng.choice([1, 1, 3, 12])):
            copy = [w if rng.random() > rng.choice([0, 0.01, 0.03]) else rng.choice(words) for w in base]
            texts.append((number, " ".join(copy)))
            number += 1
    # a chain: each text is near the next one only
    line = rng.choices(words, k=420)
    texts += [(number + k, " ".join(line[12 * k: 12 * k + 200])) for k in range(18)]
    rng.shuffle(texts)
    want, sizes = classes(texts, n)
    got = near.near_classes(spark.createDataFrame(texts, "doc_id long, text string"), n=n).collect()
    assert {r._key: r.component_id for r in got} == want
    assert {r._key: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r._key == r.component_id) for r in got)


def test_near_dedup_tells_rows_apart_by_id_and_text(spark):
    one, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, one), (9, one), (9, other), (None, one), (None, ""), (None, ""), (4, None), (None, "c d e f g h")]
    got = near.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(
        [(3, one), (9, other), (None, ""), (None, ""), (4, None), (None, "c d e f g h")])
    # texts near each other, all without an id or all of one id: one of them stays
    copies = [one + f" z{i}" for i in range(5)]
    for key in (None, 7):
        got = near.near_dedup(spark.createDataFrame([(key, t) for t in copies], "doc_id long, text string")).collect()
        assert len(got) == 1 and got[0].text in copies


def test_a_crowd_costs_a_comparison_a_member(spark, monkeypatch):
    """Candidate pairs of a group of near copies grow with its members, not with their square or their bands."""
    counts = []
    estimated = near._estimated

    def counted(pairs, info, percent):
        counts[-1] += pairs.count()
        return estimated(pairs, info, percent)

    monkeypatch.setattr(near, "_estimated", counted)
    for size in (150, 600):
        rng = random.Random(size)
        base, texts = [f"v{i}" for i in range(120)], []
        for i in range(size):
            copy = list(base)
            copy[rng.randrange(120)] = f"x{rng.randrange(500)}"
            texts.append((i, " ".join(copy)))
        counts.append(0)
        got = near.near_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()
        assert all(r.component_id == 0 for r in got)
    assert all(n <= 3 * size for n, size in zip(counts, (150, 600)))


def test_near_classes_of_a_crowd(spark):
    """One large group of near copies around a text, most of them linked."""
    rng = random.Random(9)
    base = [f"v{i}" for i in range(60)]
    texts = []
    for i in range(400):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            copy[rng.randrange(60)] = f"x{rng.randrange(500)}"
        texts.append((i, " ".join(copy)))
    want, _ = classes(texts, 4)
    got = near.near_classes(spark.createDataFrame(texts, "doc_id long, text string"), n=4).collect()
    assert {r._key: r.component_id for r in got} == want


def test_a_crowd_below_the_threshold_makes_no_rows_of_pairs(spark, monkeypatch):
    """Texts that are near a common one, but hardly near each other: candidate rows grow with the members."""
    counts = []
    estimated = near._estimated

    def counted(pairs, info, percent):
        counts[-1] += pairs.count()
        return estimated(pairs, info, percent)

    monkeypatch.setattr(near, "_estimated", counted)
    for size in (100, 400):
        rng = random.Random(size)
        texts = []
        for i in range(size):
            gone = set(rng.sample(range(60), 4))
            texts.append((i, " ".join(f"v{k}" for k in range(120) if k // 2 not in gone or k % 2)))
        counts.append(0)
        want, _ = classes(texts, 5)
        got = near.near_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()
        assert {r._key: r.component_id for r in got} == want
        assert len(set(want.values())) > size / 2
    assert counts[1] <= 8 * counts[0], counts


def test_crowded_buckets_are_compared_as_rows_of_blocks(spark, monkeypatch):
    """A group that meets in many buckets: each node is packed once, and rows of blocks are far fewer than nodes."""
    counts = []
    grouped = GroupedData.applyInPandas

    def counted(self, *args, **kwargs):
        counts.append(self._df.count())
        return grouped(self, *args, **kwargs)

    monkeypatch.setattr(GroupedData, "applyInPandas", counted)
    monkeypatch.setattr(near, "BLOCK", 64)
    rng = random.Random(3)
    texts = []
    for i in range(400):
        gone = set(rng.sample(range(60), 4))
        texts.append((i, " ".join(f"v{k}" for k in range(120) if k // 2 not in gone or k % 2)))
    want, _ = classes(texts, 5)
    got = near.near_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r._key: r.component_id for r in got} == want
    assert counts and max(counts) <= 100, counts


def test_buckets_that_hang_together_are_one_group_if_that_is_less(spark):
    entries = [(b, n, n % 7) for b in range(5) for n in range(40)]                # five buckets of the same nodes
    entries += [(100 + k, n, n) for k in range(3) for n in (1000 + k, 1001 + k)]      # a chain: cheaper one by one
    got = near._groups(spark.createDataFrame(entries, "bucket long, node long, comp long")).collect()
    nodes = defaultdict(list)
    for r in got:
        nodes[r.group].append(r.node)
    assert sorted(map(sorted, nodes.values())) == [list(range(40)), [1000, 1001], [1001, 1002], [1002, 1003]]
    rows = [(1, n, 1 if n < 700 else n) for n in range(1000)]
    blocks = near._blocks(spark.createDataFrame(rows, "group long, node long, comp long")).collect()
    assert sorted(r.node for r in blocks) == list(range(1000))
    assert {(r.comp, r.only) for r in blocks if r.only is not None} == {(1, 1)}
    assert max(Counter(r.block for r in blocks).values()) < 2 * near.BLOCK and len({r.block for r in blocks}) == 5


def test_blocks_find_the_links_of_all_pairs():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 6000))).astype(np.uint64) for _ in range(30)]
    assert near._shared_counts(sets[:10], sets[10:]).tolist() == [[len(np.intersect1d(x, y)) for y in sets[10:]] for x in sets[:10]]
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    kept = list(zip(*(x.tolist() for x in near._forest(a, b))))
    label = {int(n): int(n) for n in np.concatenate([a, b])}
    for _ in range(400):
        for x, y in zip(a.tolist(), b.tolist()):
            label[x] = label[y] = min(label[x], label[y])
    assert dict(kept) == {n: c for n, c in label.items() if n != c}


def test_registers_estimate_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100).astype(np.uint64)])     # 0.8
    k = near.registers(np.concatenate([a, b, a]), np.repeat([0, 1, 2], 900), np.array([900.0] * 3))
    assert (k[0] == k[2]).all()
    assert abs((k[0] == k[1]).mean() - 0.81) < 0.1
    # registers of a union are the larger ones
    both = np.unique(np.concatenate([a, b]))
    assert (near.registers(both, np.zeros(len(both), int), np.array([float(len(both))]))[0] == np.maximum(k[0], k[1])).all()
    far = near.registers(rng.integers(0, 2**63, 900).astype(np.uint64), np.zeros(900, int), np.array([900.0]))[0]
    ask = lambda x, y: near.doubtful(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([900.0]), np.array([900.0]), 80)[0]
    assert ask(k[0], k[1]) and not ask(k[0], far)


def test_alignment_equals_the_table():
    def table(a, b):
        h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
                best = max(best, h[i, j])
        return best

    rng = np.random.default_rng(1)
    pairs = [(rng.integers(1, 6, rng.integers(1, 20)).astype(np.uint64), rng.integers(1, 6, rng.integers(1, 40)).astype(np.uint64))
             for _ in range(60)]
    assert decontaminate.align(pairs)[0].tolist() == [table(a, b) for a, b in pairs]


def test_contamination_finds_copies_and_edited_copies_only(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    clean = [f"u{i} v{i % 7} of the w{i * i % 101} and" for i in range(300)]
    rng, made, want = random.Random(4), [], set()
    for n, r in enumerate(items):
        words = r.text.split()
        edited = [("zz" if rng.random() < 0.12 else w) for w in words]
        for kind, body in enumerate((words, edited, [w.upper() + "," if w.isascii() else w for w in words])):
            made.append((3 * n + kind, " ".join(clean[n: n + 9] + body + clean[n + 9: n + 20])))
            if len(re.findall(r"\w+", r.text)) >= decontaminate.ITEM_WORDS:
                want.add((3 * n + kind, r.item_id))
    made += [(10_000 + i, " ".join(clean[i: i + 40])) for i in range(100)]
    got = decontaminate.find_contamination(spark.createDataFrame(made, "doc_id long, text string"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    found = {(r._key, r._item) for r in got.collect()}
    assert want <= found
    assert not [k for k, _ in found if k >= 10_000]


def test_decontaminate_judges_each_row_by_its_text(spark):
    item = "the cat sat on the mat and the dog lay down by"
    rows = [(None, item), (None, "clean"), (None, None), (7, f"oh {item}"), (7, "clean too"), (8, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = decontaminate.decontaminate(docs, bench(spark))
    assert left.columns == ["doc_id", "text"]
    assert {tuple(r) for r in left.collect()} == {(None, "clean"), (None, None), (7, "clean too"), (8, "clean")}


def test_contamination_in_blocks_is_the_same(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {tuple(r) for r in decontaminate.find_contamination(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 3000)
    pieces = decontaminate.find_contamination(docs, items).collect()
    assert whole and {tuple(r)[:2] for r in pieces} == {w[:2] for w in whole}


@pytest.mark.parametrize("copies", [1, 20, 2000])
@pytest.mark.parametrize("step, score", [(4, 0.6375), (5, 0.7125), (6, 0.775)])
def test_contamination_finds_edited_copies_however_many(spark, copies, step, score):
    item = [f"q{i}" for i in range(40)]
    made = [(n, " ".join([f"a{n}"] * 30 + [f"x{n}" if i % step == step - 1 else w for i, w in enumerate(item)] + [f"b{n}"] * 30))
            for n in range(copies)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = decontaminate.find_contamination(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {(r._key, round(r.score, 4)) for r in got} == {(n, score) for n in range(copies)}


def test_contamination_equals_aligning_every_pair(spark, monkeypatch):
    """Every pair that shares three words in a row and aligns well is found, and no other."""
    rng, words = random.Random(11), [f"w{i}" for i in range(40)]
    items = [(n, [rng.choice(words) for _ in range(rng.randint(8, 40))]) for n in range(25)]
    docs = []
    for n in range(120):
        body = [w for w in rng.choice(items)[1] for w in ([] if rng.random() < 0.1 else [w] if rng.random() < 0.8 else ["no", w])]
        docs.append((n, rng.choices(words, k=rng.randint(0, 150)) + body + rng.choices(words, k=rng.randint(0, 150))))
    number = {w: np.uint64(i) for i, w in enumerate([*words, "no"])}
    hashed = [[(k, np.array([number[w] for w in ws], np.uint64)) for k, ws in table] for table in (docs, items)]
    triples = lambda ws: set(zip(ws, ws[1:], ws[2:]))
    want = set()
    for (d, text), (_, dw) in zip(hashed[0], docs):
        score = decontaminate.align([(item, text) for _, item in hashed[1]])[0]
        want |= {(d, i) for (i, item), (_, iw), s in zip(hashed[1], items, score)
                 if s >= decontaminate.LEAST * decontaminate.MATCH * len(item) and triples(dw) & triples(iw)}
    frame = lambda table, key: spark.createDataFrame([(k, " ".join(ws)) for k, ws in table], f"{key} long, text string")
    for rows in (decontaminate.HIT_ROWS, 5):
        monkeypatch.setattr(decontaminate, "HIT_ROWS", rows)
        got = {(r._key, r._item) for r in decontaminate.find_contamination(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
        assert got == want


def test_toxicity_on_held_out_labels(spark):
    """Learns what marks one class, from labels outside the fold only."""
    rng = random.Random(8)
    words, bad = ["".join(rng.choices("abcdeo", k=4)) for _ in range(300)], ["zorgle", "quixat"]
    rows, marks = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        text = rng.choices(words, k=rng.randint(5, 120))
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(bad) + rng.choice(["s", "d", ""])
        rows.append((i, " ".join(text)))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        marks.append((i, 1, int(toxic) if not held else 1 - int(toxic)))     # the fold's labels are wrong on purpose
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels(spark, marks))).withColumn("held", toxicity.held_out()).collect()
    fold = [r for r in scored if r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert sum((r.predicted == 1) == (r.doc_id % 5 == 0) for r in fold) / len(fold) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)


def test_toxicity_without_labels(spark):
    docs = awkward.docs(spark)
    assert {r.predicted for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels(spark).limit(0))).collect()} == {0}


def base_places(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i: i + len(p)] == p]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), \
        ",".join(sorted({x for _, x in found}))


def test_license_base_equals_a_plain_search(spark, sf):
    rng = random.Random(6)
    parts = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "x", "2", "é", "K", "CC", "License"]
    texts = [t for (t,) in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [
        rng.choice(["", " ", "-"]) + rng.choice([" ", "-", "\n", ", "]).join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(800)] + [
        "apache license apache license mit license", "cc by cc by", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_places(texts[r.doc_id]), texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


@pytest.mark.parametrize("text, labels_, spans", [
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0", 1),        # contained mentions go
    ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0", 1),
    ("the GNU Lesser General\nPublic License version 2.1 or the BSD-3-Clause", "bsd-3-clause,lgpl-2.1", 2),
    ("MIT License and again MIT License", "mit", 2),
    ("see https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa-4.0", 1),
    ("CC BY-NC 4.0", "cc-by,cc-by-nc-4.0", 1),
    ("ein Text mit Lizenz, cc an alle", "", 0),
])
def test_license_rules(spark, text, labels_, spans):
    (r,) = licenses.scan_licenses(spark.createDataFrame([(text,)], "text string")).collect()
    assert (r.labels, len(r.detections)) == (labels_, spans)
    assert all(0 <= d.start < d.end <= len(text) for d in r.detections)


def test_license_rules_are_gated_safely():
    """Every rule's texts hold its keyword and one of the gate's words."""
    rules = licenses.rules()
    assert len(rules) > 200
    names = {"spdx": "spdx-license-identifier: {0}", "cc": "cc {1}", "creative commons": "creative commons", "creativecommons.org": "creativecommons.org/licenses"}
    for r in rules:
        assert re.compile(r.pattern)
    for keyword in {r.keyword for r in rules}:
        plain = {"spdx": "spdx", "cc": "cc by", "creativecommons.org": "creative"}.get(keyword, keyword)
        needs = [r.pattern for r in rules if r.keyword == keyword]
        assert all("licen[cs]e" in p or any(g in p.replace("[ -]", " ").replace("creativecommons", "creative") or g == plain or g in plain
                                             for g in licenses.GATE) for p in needs), keyword
    assert names


def test_license_rules_match_wrapped_text(spark):
    """Every license reads the same where lines break, blanks double or comment marks stand between its words."""
    def plain(pattern):
        one = re.sub(r"\(\?:([^()|]*)[^()]*\)", r"\1", re.sub(r"\(\?:[^()]*\)\?", "", pattern)).split("|")[0]
        return re.sub(r".\?", "", one.replace("[cs]", "s").replace("[ -]", " "))

    names = [(plain(name), stem, versions) for _, name, stem, versions in licenses.FAMILIES.values()]
    names += [("creative commons zero", "cc0", ("1.0",))]
    names += [(f"creative commons {plain(name)}", f"cc-{kind}", licenses.COMMONS_VERSIONS) for kind, name in licenses.COMMONS.items()]
    names += [(f"cc {kind}", f"cc-{kind}", licenses.COMMONS_VERSIONS) for kind in licenses.COMMONS]
    cases = [("this is in the public domain now", "public-domain"), ("copyright me all rights reserved", "proprietary")]
    for name, stem, versions in names:
        cases += [(f"see the {name} here", stem)]
        for v in versions[-1:]:
            version = v if stem.startswith("cc-") and name.startswith("cc") else f"version {v}"
            cases += [(f"see the {name} {version}", f"{stem}-{v}"), (f"licensed under the terms of the {name} {version}", f"{stem}-{v}")]
    forms = (" ", "  ", "\n", "\r\n * ")
    rows = [(n, k, text.replace(" ", form)) for n, (text, _) in enumerate(cases) for k, form in enumerate(forms)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "n int, k int, text string").repartition(8)).collect()
    read = {(r.n, r.k): (r.labels, r.score) for r in got}
    assert len(read) == len(rows)
    for n, (text, label) in enumerate(cases):
        assert label in read[n, 0][0].split(","), (text, read[n, 0])
        for k, form in enumerate(forms):
            assert read[n, k] == read[n, 0], (text, form, read[n, k], read[n, 0])


def test_exact_groups(spark):
    rows = [(1, "a b"), (2, "ab "), (3, "a\tb  "), (4, "x"), (5, None), (6, " "), (9, "a b"), (None, "x")]
    got = {r.doc_id: r for r in exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: (got[i].keep_id, got[i].group_size, got[i].kept) for i in (1, 2, 3, 4, 5, 6, 9)} == {
        1: (3, 4, False), 2: (3, 4, False), 3: (3, 4, True), 9: (3, 4, False), 4: (4, 2, True), 5: (6, 2, False), 6: (6, 2, True)}
    assert got[1].text_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert (got[None].keep_id, got[None].kept) == (4, False)


def test_exact_single_keeps_one_row(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "ab"), (3, "c")]
    got = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), single=True).where("kept").collect()
    assert sorted(r.doc_id for r in got) == [1, 3]


def test_exact_filter_lets_no_copy_pass(spark, monkeypatch):
    """Also when the filter is far too small."""
    monkeypatch.setattr(exact, "BITS_PER_ROW", 0)
    rows = [(i, f"text {i % 40}") for i in range(120)]
    got = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.keep_id == r.doc_id % 40 and r.group_size == 3 for r in got)


def test_language_models_tell_targets(spark):
    rng = random.Random(2)
    good, noise = ["stone", "river", "meadow", "lantern"], ["%%&", "#$#", "zzqx", "!!"]
    rows, marks = [], []
    for i in range(200):
        rows.append((i, " ".join(rng.choices(good if i % 2 else noise, k=rng.randint(3, 60)))))
        marks.append((i, i % 2, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scored = lm.score_documents(docs, lm.fit(docs, labels(spark, marks))).collect()
    assert all((r.score < 0) == (r.doc_id % 2 == 1) for r in scored)
    assert all(abs(r.score - (r.target_loss - r.background_loss)) < 1e-12 for r in scored)


def test_language_model_counts_equal_a_plain_count(spark):
    texts = ["Ab a\tb", "", None, "ab" * 30]
    docs = spark.createDataFrame([(t or "", False) for t in texts], "_text string, _target boolean")
    symbols = lm.symbol_table([97, 32, 98])
    want = defaultdict(int)
    for t in texts:
        s = [lm.END] * (lm.ORDER - 1) + [{"a": 0, " ": 1, "\t": 1, "b": 2}[c] for c in (t or "").lower()] + [lm.END]
        for i in range(len(s) - lm.ORDER + 1):
            want[sum(v * lm.SYMBOLS ** (lm.ORDER - 1 - k) for k, v in enumerate(s[i: i + lm.ORDER]))] += 1
    assert {r.gram: r.background for r in lm.gram_counts(docs, symbols).collect()} == dict(want)
    loss = lm.losses(np.random.default_rng(0).integers(0, 3, lm.SYMBOLS ** lm.ORDER).astype(np.float32))
    assert np.allclose(np.exp(-loss).reshape(-1, lm.SYMBOLS).sum(axis=1), 1, atol=1e-4)


def plain_removal(docs):
    seen, out = set(), {}
    for i, t in sorted(docs):
        data = t.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - passages.LENGTH + 1):
            w = data[p: p + passages.LENGTH]
            if w in seen:
                gone[p: p + passages.LENGTH] = b"\1" * passages.LENGTH
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_passages_equal_a_plain_removal(spark):
    rng = random.Random(11)
    words = ["the", "of", "and", "é", "\0", "on"] + ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(200)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    shared, docs = [text(rng.randint(15, 60)) for _ in range(8)], []
    for i in range(150):
        t = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 2)
            t += p[a: rng.randint(a, len(p))] + text(rng.randint(0, 25))
        docs.append((i, t))
    docs += [(1000 + i, docs[i][1]) for i in range(0, 60, 3)] + [(2000, "a" * 500), (2001, "ab" * 300), (2002, "a" * 99), (2003, ""),
                                                              (2004, "a" * 100), (2005, "abc" * 40 + "a" * 150)]
    docs += [(3000 + i, shared[3] + text(5) + shared[4]) for i in range(60)] + [(4000, "x\0" * 80), (4001, "x\0" * 70 + "y")]
    rng.shuffle(docs)
    got = passages.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain_removal(docs)


def _line_in_many(n):
    """Texts of which each has the same line of 56 bytes, then one of 180, in surroundings of its own."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    line, passage = "this line stands in each document of the whole corpus :)", " ".join(f"shared{i:03d}" for i in range(18))
    body = lambda: " ".join(word() for _ in range(14))
    return [(i, f"{body()} {line} {body()} {passage} {body()}") for i in range(n)]


def test_passages_with_grams_at_many_places_equal_a_plain_removal(spark):
    docs = _line_in_many(120)
    docs += [(500 + i, docs[i][1][20:320]) for i in range(40)]
    got = passages.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), hot_places=8).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain_removal(docs)


def test_no_range_of_suffixes_grows_with_a_line_of_all_documents(spark):
    """A line that stands in every document would put most bytes of all runs into one range."""
    for n in (300, 3000):
        docs = spark.createDataFrame(_line_in_many(n), "id long, text string").repartition(4).selectExpr("id", "xxhash64(text) AS print", "text")

        def sizes(hot_places):
            runs = passages.repeat_runs(docs, 64, hot_places).where("part >= 0").selectExpr("part", "length(run) AS bytes")
            return [r[1] for r in runs.groupBy("part").sum("bytes").collect()]

        spread = sizes(100)
        assert len(spread) == 64 and max(spread) < 3 * sum(spread) / 64
        together = sizes(10**9)
        assert max(together) > sum(together) / 8


def test_tables_kept_for_passages_are_few_bytes_of_the_texts(spark, monkeypatch):
    """Places and runs are not written as tables beside their shuffles."""
    kept = []
    saved = passages.saved

    def counted(df):
        out = saved(df)
        for c, kind in out.dtypes:
            if kind == "binary":
                kept.append(out.selectExpr(f"coalesce(sum(length({c})), 0)").first()[0])
        return out

    monkeypatch.setattr(passages, "saved", counted)
    rng = random.Random(8)
    docs = [(i, "".join(rng.choices("abcdefgh ", k=4000))) for i in range(60)]
    docs += [(100 + i, docs[i][1][500:900] + docs[i + 1][1][:300]) for i in range(20)]
    got = passages.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain_removal(docs)
    assert {r.doc_id: r.text for r in got} == dict(docs)
    assert sum(kept) < sum(len(t) for _, t in docs) / 20


def test_places_and_texts_are_the_same_after_packing():
    rng = np.random.default_rng(4)
    places = np.zeros(5000, passages.PLACE)
    places["hash"], places["id"] = rng.integers(0, 2**63, 5000), np.sort(rng.integers(-50, 900, 5000))
    places["print"], places["at"], places["count"] = places["id"] * 7919, np.arange(5000), 1
    again = passages._unflat(passages._flat(places))
    assert np.array_equal(again, places) and len(passages._flat(places)) < places.nbytes / 2
    assert len(passages._unflat(passages._flat(places[:0]))) == 0
    for data in (b"", b"a", bytes(range(256)) * 50):
        assert passages._unpacked(passages._packed(data)) == data


def test_picked_places_are_dealt_evenly():
    """Places have the smallest hashes of their strings, and still no range gets more than the others."""
    data = np.random.default_rng(5).integers(97, 123, 400_000).astype(np.uint8)
    hashes, *_ = passages.picked(data, np.array([0]), np.array([len(data)]))
    count = np.bincount(passages._by_range(hashes, 64), minlength=64)
    assert len(count) == 64 and count.max() < 2 * count.mean()


def test_passages_of_long_texts_in_pieces(monkeypatch):
    """A text cut into overlapping pieces picks the same places for all its strings."""
    rng = random.Random(1)
    text = "".join(rng.choices("abcd ", k=3000)).encode()

    def strings(piece):
        monkeypatch.setattr(passages, "PIECE", piece)
        found = set()
        for _, offsets, parts in passages._pieces([text]):
            size = np.array([len(p) for p in parts])
            begin = np.cumsum(size) - size
            for h, own, at, least, most in zip(*passages.picked(np.frombuffer(b"".join(parts), np.uint8), begin, size)):
                place = at - begin[own] + offsets[own]
                found |= {(int(h), int(place - o)) for o in range(least, most + 1)}
        return found

    assert strings(8_000_000) == strings(700)
    assert {p for _, p in strings(700)} == set(range(2901))


def test_merge_of_front_coded_runs():
    rng = random.Random(3)
    made = []
    for _ in range(5):
        texts = sorted("".join(rng.choices("ab", k=passages.LENGTH)).encode() for _ in range(rng.randint(1, 40)))
        shared = [0] + [next((i for i in range(passages.LENGTH) if a[i] != b[i]), passages.LENGTH) for a, b in zip(texts, texts[1:])]
        record = np.zeros(len(texts), passages.RUN)
        record["shared"], record["rest"] = shared, [passages.LENGTH - s for s in shared]
        made.append((texts, np.int64(len(texts)).tobytes() + record.tobytes() + b"".join(t[s:] for t, s in zip(texts, shared))))
    order, shares = passages.merge([passages.Run(d) for _, d in made])
    queues = [list(t) for t, _ in made]
    out = [queues[r].pop(0) for r in order]
    assert out == sorted(t for texts, _ in made for t in texts)
    common = lambda a, b: next((i for i in range(passages.LENGTH) if a[i] != b[i]), passages.LENGTH)
    assert shares[1:] == [common(a, b) for a, b in zip(out, out[1:])]


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 400), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # plainly: hand out by weight, cap, hand out the rest again
    names, weight = ["a", "b", "c", "d", None], {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    size = {"a": 10, "b": 1000, "c": 500, "d": 0, None: 400}
    target, open_, left = {}, set(names), 1910.0
    while True:
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] > 3 * size[n]}
        if not over:
            target |= share
            break
        for n in over:
            target[n] = 3.0 * size[n]
        left -= sum(target[n] for n in over)
        open_ -= over
    assert got == pytest.approx(target)


def test_mix_meets_targets_and_agrees(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (sorted(map(tuple, queries.op10_source_mix(spark, sf).collect())) for _ in range(2))
    assert a == b
    size, taken, target = defaultdict(int), defaultdict(int), {}
    source = {r.doc_id: r.source for r in docs.collect()}
    for doc_id, n, total, goal, took, _ in a:
        assert took <= 3 * n and took % max(n, 1) == 0
        size[source[doc_id]] += n
        taken[source[doc_id]] += took
        target[source[doc_id]] = goal
        assert total >= n
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s, goal in target.items():
        assert goal <= 3 * size[s] + 1e-6 and abs(taken[s] - goal) <= 0.1 * goal + 60


def test_splitting_tree_is_exact():
    quotas = np.array([100, 3, 0, 57])
    counts = mixing.split_quotas(quotas, 7, 1)
    assert (counts.sum(axis=0) == quotas).all() and (counts >= 0).all()
    assert counts.sum(axis=1).max() - counts.sum(axis=1).min() <= 2


def test_mix_deals_every_copy_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(docs).collect()}
    dealt = Counter(r.doc_id for r in mixing.mix_sources(docs).collect())
    assert dealt == {i: n for i, n in plan.items() if n}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Home<li>About</ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>One   <b>two</b><br>three<p>Caf&eacute;
<script>var x = "</p>";</script><div class="ad">Buy</div><ul><li>first<li>second</ul></article><aside>Side</aside>
<section id="comments"><p>I disagree</section><form>Name <input></form><footer>End</footer></body></html>"""


def test_page_text(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "odd", ""), (4, "http://a.example/y", "just text &lt;b&gt;"),
            (1, "http://a.example/x", PAGE)]
    got = pages.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()
    text = {r.page_id: r.text for r in got}
    assert text == {1: "Head & line\nOne two three\nCafé\nfirst\nsecond", 2: "", 3: "", 4: "just text <b>"}
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert pages.extract_main_text(spark.createDataFrame([], PAGES)).count() == 0
    clash = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS text", "2 AS host", "3 AS _host", "4 AS n_chars")
    assert {r.page_id: r.text for r in pages.extract_main_text(clash).collect()} == text


def test_style_tree_removes_what_a_site_repeats(spark):
    """A block that says the same on all pages of a host goes, without any telling name."""
    page = "<html><body><div class='k1'>Welcome to our place</div><div class='k2'><p>{0} first part</p><p>then {0}</p></div></body></html>"
    rows = [(i, f"https://h.example/{i}", page.format(f"story{i}")) for i in range(12)] + [(100, "https://other.example/", page.format("alone"))]
    text = {r.page_id: r.text for r in pages.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert text[3] == "story3 first part\nthen story3"
    assert text[100].startswith("Welcome")        # one page shows nothing about its host


@pytest.mark.parametrize("n", [40, 1500])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_headings_stay_on_hosts_of_every_size(spark, n, tag):
    heads = ["Background", "Method", "Results", "Conclusion"]
    page = "<html><body><ul class='k1'><li>Home</li><li>About us</li></ul><{1} class='k2'><h2>{2}</h2><p>story {0}</p><h2>Notes</h2><p>told {0}</p></{1}></body></html>"
    rows = [(i, f"https://h.example/{i}", page.format(i, tag, heads[i % 4])) for i in range(n)]
    text = {r.page_id: r.text for r in pages.extract_main_text(spark.createDataFrame(rows, PAGES).repartition(4)).collect()}
    assert text == {i: f"{heads[i % 4]}\nstory {i}\nNotes\ntold {i}" for i in range(n)}


@pytest.mark.parametrize("html, want", [
    ("<div class=content>one</div><div class=advert>buy</div><div class=content>two</div>", "one\ntwo"),
    ("<div class=post><div class=entry>a</div></div><div class=post>b</div><div>c</div>", "a\nb"),
    ("<div class=entry>teaser</div><div class='content'><p>body</p></div>", "teaser\nbody"),
    ("<article><h1 class=entry-header>T</h1><h2 id=related-work>R</h2><section id=social-impact>S</section>"
     "<div id=legal-basis>L</div><div class=share>no</div></article>", "T\nR\nS\nL"),
    ("<div class=content><h2 id=related-work>R</h2><section id=social-impact>S</section><div class=share-box>no</div></div>", "R\nS"),
    ("<div id=sidebar>no</div><h1 class=site-header>T</h1><p>text</p>", "T\ntext"),
])
def test_all_content_branches_and_slugs_stay(html, want):
    assert "\n".join(pages.main_blocks(f"<html><body>{html}</body></html>", {})) == want


def test_copies_of_a_page_are_not_furniture(spark):
    rows = [(i, "https://h.example/", PAGE) for i in range(20)]
    assert {r.text for r in pages.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()} == {
        "Head & line\nOne two three\nCafé\nfirst\nsecond"}


def test_stages_keep_the_columns(spark, sf):
    for docs in (awkward.docs(spark), awkward.none(spark)):
        for stage in (stages.drop_toxic, stages.drop_exact_copies, stages.drop_near_copies, stages.drop_contaminated):
            docs = stage(spark, docs, sf)
            assert docs.columns == [c.split()[0] for c in awkward.DOCS.split(", ")]
        assert stages.mix(spark, docs, sf).count() >= 0


def test_pipeline_run_against_plain_stages(spark, sf):
    """Whole run on the given tables; exact and near dedup compared with plain versions on their own input."""
    import corpus_pipeline

    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = corpus_pipeline.saved(stage(spark, docs, sf))
        kept[name] = (before, docs.collect())
        assert {r.doc_id for r in kept[name][1]} <= {r.doc_id for r in before}
    before, after = kept["exact dedup"]
    assert len(after) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in before})
    before, after = kept["near dedup"]
    label, _ = classes([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(i for i in label if label[i] == i)
    mixed = corpus_pipeline.run(spark, sf).collect()
    last = {r.doc_id: r.text for r in kept["decontamination"][1]}
    assert mixed and all(last[r.doc_id] == r.text for r in mixed)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
