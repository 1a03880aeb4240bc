"""Operators on vectors against plain versions, and on awkward tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import ann, negatives, queries

VECTORS = "vec_id long, embedding array<float>, label int"


def awkward_rows():
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], i % 3) for i in range(260)]
    rows += [(300 + i, rows[100][1], i % 2) for i in range(40)]         # a group of equal vectors
    rows += [rows[100], rows[100], (200, rows[7][1], 1), (200, rows[8][1], 2)]   # repeated rows and ids
    rows += [(500, None, 1), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (502, [float("nan")] * 6, 1), (503, [float("inf")] + [0.0] * 5, 1),
             (504, [0.0] * 6, 1), (505, [], 1), (600, [1.0, 2.0], 1), (601, [0.5] * 6, None), (None, [0.5] * 6, 1), (700, [1e18] * 6, 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def clashing(df):
    return df.selectExpr("*", *(f"CAST(NULL AS long) AS {c}" for c in "_key _label _vec tile rank node query_id anchor_id score part".split()))


def kept_rows(rows, label):
    """One row for each id that takes part, vectors padded to the longest."""
    ok = [(i, label(i, c), [float(np.float32(x)) for x in v]) for i, v, c in rows
          if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    one = {}
    for i, c, v in sorted(ok, reverse=True):
        one[i] = (c, v)
    most = max((len(v) for _, v in one.values()), default=0)
    return {i: (c, v + [0.0] * (most - len(v))) for i, (c, v) in one.items()}


# ---- hard negatives ---------------------------------------------------------------------

@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 65, 70), (130, 64, 257), (0, 5, 3), (100, 100, 100), (64, 200, 1)])
def test_product_is_exact(shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    for most in (300, 2 ** 28):
        a, b = rng.integers(-most, most, (m, k)), rng.integers(-most, most, (k, n))
        assert (negatives.product(a, b) == a @ b).all()


def plain_negatives(rows, label, wanted, positives=5, most=10):
    table = kept_rows(rows, label)
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, (_, v) in table.items()}
    out = []
    for anchor in table:
        if not wanted(anchor):
            continue
        score = {i: sum(x * y for x, y in zip(whole[anchor], whole[i])) for i in table if i != anchor}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if table[i][0] == table[anchor][0]][:positives]:
            fits = [i for i in order if table[i][0] != table[anchor][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(anchor, p, r, i, score[p], score[i]) for r, i in enumerate(fits[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("tiles", [(256, 1024), (3, 5)])
def test_negatives_equal_brute_force(spark, monkeypatch, tiles):
    monkeypatch.setattr(negatives, "ANCHORS", tiles[0])
    monkeypatch.setattr(negatives, "CANDIDATES", tiles[1])
    monkeypatch.setattr(negatives, "GROUP", 4)
    monkeypatch.setattr(negatives, "HELD", 2)
    rows = [r for r in awkward_rows() if r[0] != 700]   # its scores leave the range of long
    label = lambda i, c: (c + 1) % 10 if i % 7 == 0 else c
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    for df in (frame(spark, rows), clashing(frame(spark, rows))):
        got = negatives.mine_negatives(df, F.col("_key") % 20 == 0, label=moved)
        assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, label, lambda i: i % 20 == 0)


def test_negatives_of_little(spark):
    assert negatives.mine_negatives(frame(spark, []), F.col("_key") % 100 == 0).count() == 0
    assert negatives.mine_negatives(frame(spark, [(100, [1.0], 1), (1, [2.0], 2)]), F.col("_key") % 100 == 0).count() == 0
    assert negatives.mine_negatives(frame(spark, awkward_rows()), F.col("_key") % 100 == 0).count() > 0


def test_hot_label_is_many_groups(spark):
    """The largest share of pairs of tiles that one join key brings together does not grow with the rows."""
    most = []
    for n in (20_000, 60_000):
        tiles = spark.range(n // 1000).selectExpr("1L AS part", "id AS tile")
        met = negatives._met(spark.range(2).selectExpr("1L AS part", "id AS tile"), tiles)
        assert met.count() == 2 * n // 1000
        most.append(tiles.join(tiles.groupBy("part").agg(F.ceil(F.count("*") / negatives.GROUP).alias("n")), "part")
                    .groupBy(F.pmod(F.xxhash64("tile"), F.col("n"))).count().agg(F.max("count")).first()[0])
    assert max(most) <= 2 * negatives.GROUP


def test_negatives_query(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = con.execute(queries.SQL["op11_hard_negatives"]).fetchall()
    assert sorted(tuple(r) for r in queries.op11_hard_negatives(spark, sf).collect()) == sorted(want)


# ---- nearest neighbours -----------------------------------------------------------------

def plain_neighbours(rows, wanted, k=10):
    table = {i: np.array(v) for i, (_, v) in kept_rows([(i, v, 0) for i, v, _ in rows], lambda i, c: 0).items() if any(v)}
    out = {}
    for q in table:
        if wanted(q):
            d = sorted((float(np.sqrt(((table[q] - v) ** 2).sum())), i) for i, v in table.items() if i != q)
            out[q] = d[:k]
    return out


def found_neighbours(df, wanted, **kw):
    out = {}
    for r in sorted(ann.neighbours(ann.build(df), df.where(wanted), **kw).collect()):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_neighbours_equal_brute_force(spark):
    """So few rows that the search sees all of them: equal vectors, ties, repeated rows, rows that take no part.

    Not the row so far out that its distances to all others agree in every digit.
    """
    rows = [r for r in awkward_rows() if r[0] != 700]
    want = plain_neighbours(rows, lambda i: i % 20 == 0)
    for df in (frame(spark, rows), clashing(frame(spark, rows))):
        got = found_neighbours(df, "vec_id % 20 = 0")
        assert got.keys() == want.keys()
        for q in want:
            assert [i for _, i in got[q]] == [i for _, i in want[q]], q
            assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-12, atol=0)


def test_neighbours_of_little(spark):
    assert ann.neighbours(ann.build(frame(spark, [])), frame(spark, [])).count() == 0
    one = frame(spark, [(100, [1.0, 2.0], 1), (1, [0.0, 0.0], 1)])
    assert ann.neighbours(ann.build(one), one).count() == 0
    two = frame(spark, [(100, [1.0, 2.0], 1), (1, [1.0, 2.0, 0.0], 1), (2, [-0.0, 5.0], 1)])
    assert found_neighbours(two, "vec_id = 100")[100] == [(0.0, 1), (float(np.sqrt(10)), 2)]


def test_recall_beside_a_crowd(spark):
    """A third of all rows are one vector, a tenth are near one another, the others lie all around."""
    rng = np.random.default_rng(3)
    loose, near = rng.normal(size=(3400, 24)), rng.normal(size=24) + 0.01 * rng.normal(size=(600, 24))
    x = np.concatenate([loose, near, np.repeat(loose[:1], 2000, axis=0)]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    got = found_neighbours(frame(spark, rows), "vec_id % 100 = 0")
    hit = []
    for q in range(0, len(x), 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        if d[best[-1]] == 0:
            assert [i for _, i in got[q]] == best.tolist()
        hit.append(len(set(best.tolist()) & {i for _, i in got[q]}) / 10)
    assert np.mean(hit) >= 0.95


def test_query_recall(spark, sf):
    rows = [(r.vec_id, list(r.embedding), 0) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = plain_neighbours(rows, lambda i: i % 100 == 0)
    got = {}
    for r in queries.op12_nearest_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got.keys() == want.keys()
    assert np.mean([len(got[q] & {i for _, i in want[q]}) / 10 for q in want]) >= 0.98
