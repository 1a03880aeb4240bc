"""Nearest neighbours by NN-descent: a graph of neighbours, improved by joins of neighbours of neighbours.

1. **Nodes.**  Rows of equal vectors are one node, named by a hash of the vector, with its few smallest ids as members; so a
   vector that a third of all rows have is one node.  A node carries its vector as one byte a component and a scale, enough
   to compare distances; results use the vectors themselves.
2. **Start.**  Nodes are sorted by the signs of random projections, ``TABLES`` times, and stretches of
   ``STRETCH`` nodes compared all with all.  The order, not the size of a bucket, cuts the stretches.
3. **Descent.**  A node's list of ``NEIGHBOURS`` and those that list it meet at that node: edges are joined with the bytes of
   their ends, brought together by node, and compared with one another there unless both were compared before.  Only pairs that
   enter a list come out.  Rounds end when few edges are new.  A node that very many list is handled in
   parts, each a group of its own.
4. **Search.**  Each query keeps a beam of the nearest nodes seen.  A round joins the nodes of all beams that were not yet opened
   with the graph, in both directions, and takes in what is nearer than the beam's last.  It ends when no beam changes.
5. **Result.**  The best of each beam are compared in double precision, and nodes give way to their members.

What is approximate: which nodes a beam meets.  Every node is in the graph, and no list of a node is cut other than to its
``NEIGHBOURS`` nearest.

Defined cases: see ``vectors`` for rows that take part; vectors of zeros take no part either.  A query is never its own
neighbour; other rows with its vector are, at distance 0.  Squares must stay within doubles, i.e. components below
about 1e150; beyond, distances are infinite and such pairs are not found.  Of more different nodes at one distance than are compared
in double precision (``EXACT``), any may be returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.vectors import as_bytes, fixed, matrix, usable
from jobloom.session import saved

NEIGHBOURS = 16
TABLES = 4
STRETCH = 64
PART = 48              # about how many nodes meet at a part of a much listed node
SETTLED = 0.12         # share of new edges below which the descent ends
ROUNDS = 16
BEAM = 448
ENTRIES = 16           # nodes that every query starts from, beside its own
EXACT = 48             # nodes of a beam that are compared in double precision
SALTS = 16
_EDGE = "node long, other long, d double"


@dataclass(frozen=True)
class Index:
    nodes: DataFrame      # node, code, scale, norm, vector
    members: DataFrame    # node, _key: the smallest ids of each node
    graph: DataFrame      # node, other, d
    dims: int


def _wide(df: DataFrame) -> DataFrame:
    """Rows of a small table, each costly to handle, dealt over all cores."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


# ---- nodes ------------------------------------------------------------------------------

def _coded(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch["_vec"], dims)
            scale = np.maximum(np.abs(x).max(axis=1) / 127, 1e-300)
            code = np.rint(x / scale[:, None]).astype(np.int8)
            norm = (code.astype(np.float64) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch["node"], as_bytes(code), pa.array(scale), pa.array(norm), as_bytes(x)], names=["node", "code", "scale", "norm", "vector"])

    return run


def _distances(scale: np.ndarray, norm: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs along the last axes; sums of bytes are exact."""
    dot = np.matmul(code, np.swapaxes(code, -1, -2)).astype(np.float64)
    own = scale * scale * norm
    return own[..., :, None] + own[..., None, :] - 2 * scale[..., :, None] * scale[..., None, :] * dot


# ---- comparing nodes that meet ----------------------------------------------------------

def _best(ids: np.ndarray, d: np.ndarray, most: int) -> list[np.ndarray]:
    """(node, other, d): for each row of each group the ``most`` least finite distances."""
    if d.shape[-1] > most:
        at = np.argpartition(d, most - 1, axis=-1)[..., :most]
        d = np.take_along_axis(d, at, -1)
    else:
        at = np.broadcast_to(np.arange(d.shape[-1]), d.shape)
    g, i, k = np.nonzero(np.isfinite(d))
    return [ids[g, i], ids[g, at[g, i, k]], d[g, i, k]]


def _compared(groups: list[pd.DataFrame], sizes: np.ndarray, most: int) -> pd.DataFrame:
    """Pairs within groups that may enter a list; the groups' rows follow one another."""
    rows = pd.concat(groups, ignore_index=True)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    code = np.frombuffer(b"".join(rows["code"]), dtype=np.int8).reshape(len(rows), -1)
    found, order = [], np.argsort(sizes, kind="stable")
    for some in np.array_split(order, max(1, len(order) // 64)):   # groups of like sizes together
        width = int(sizes[some].max())
        if width < 2:
            continue
        at = begin[some][:, None] + np.arange(width)[None, :]
        there = np.arange(width)[None, :] < sizes[some][:, None]
        at = np.where(there, at, begin[some][:, None])
        ids, fresh = rows["member"].to_numpy()[at], rows["fresh"].to_numpy()[at]
        d = _distances(rows["scale"].to_numpy()[at], rows["norm"].to_numpy()[at], code[at].astype(np.float32))
        ok = (fresh[:, :, None] | fresh[:, None, :]) & there[:, :, None] & there[:, None, :] \
            & (ids[:, :, None] != ids[:, None, :]) & (d < rows["reach"].to_numpy()[at][:, :, None])
        found.append(_best(ids, np.where(ok, np.maximum(d, 0), np.inf), most))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    return pd.DataFrame(dict(zip(["node", "other", "d"], columns)))


def _in_groups(most: int, stretch: int = 0):
    """Compares within groups: rows of equal (hub, part) that follow one another, or stretches of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            if stretch:
                cuts = np.arange(stretch, len(pdf), stretch)
            else:
                hub, part = pdf["hub"].to_numpy(), pdf["part"].to_numpy()
                cuts = np.flatnonzero((hub[1:] != hub[:-1]) | (part[1:] != part[:-1])) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            if last:
                yield _compared([pdf.iloc[:last]], np.diff(np.concatenate([[0], cuts])), most)
            rest = pdf.iloc[last:]
        if rest is not None and len(rest):
            yield _compared([rest], np.array([len(rest)]), most)

    return run


def _nearest(edges: DataFrame, most: int) -> DataFrame:
    """(node, other, d, fresh): the nearest ones of each node; an edge that was there before is not fresh."""
    once = edges.repartition("node").groupBy("node", "other").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    at = F.row_number().over(Window.partitionBy("node").orderBy("d", "other"))
    return saved(once.withColumn("_at", at).where(F.col("_at") <= most).drop("_at"))


def _started(nodes: DataFrame, dims: int, most: int, count: int) -> DataFrame:
    """A first graph, from stretches of nodes in the order of random projections' signs."""
    bits = max(1, min(48, math.ceil(math.log2(max(count, 2) / STRETCH + 1)) + 2))

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(7).standard_normal((TABLES, dims, bits)).astype(np.float32)
        for batch in batches:
            if not len(batch):
                continue
            code = fixed(batch["code"], np.int8).astype(np.float32)
            for t in range(TABLES):
                place = (code @ planes[t] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(batch), t)), pa.array(place), *(batch[c] for c in ("node", "code", "scale", "norm"))],
                    names=["turn", "place", "member", "code", "scale", "norm"])

    placed = saved(nodes.select("node", "code", "scale", "norm").mapInArrow(
        signs, "turn long, place long, member long, code binary, scale double, norm double"))
    sorted_ = placed.repartitionByRange("turn", "place", "member").sortWithinPartitions("turn", "place", "member")
    rows = sorted_.select("member", "code", "scale", "norm", F.lit(True).alias("fresh"), F.lit(float("inf")).alias("reach"))
    return _nearest(rows.mapInPandas(_in_groups(most, STRETCH), _EDGE).withColumn("fresh", F.lit(True)), most)


def _both_ways(graph: DataFrame, *more: str) -> DataFrame:
    return graph.select("node", "other", *more).union(graph.select("other", "node", *more))


def _parted(ends: DataFrame, hub: str, member: str) -> DataFrame:
    """Rows (hub, member, ...) with the part of the hub's list they belong to."""
    parts = ends.groupBy(hub).agg(F.ceil(F.count("*") / PART).alias("parts"))
    return ends.join(parts, hub).withColumn("part", F.pmod(F.xxhash64(member), F.col("parts"))).drop("parts")


def _round(graph: DataFrame, codes: DataFrame, most: int) -> DataFrame:
    """The graph after nodes that meet at a node were compared."""
    ends = saved(_both_ways(graph, "fresh").groupBy(F.col("node").alias("hub"), F.col("other").alias("member"))
                 .agg(F.max("fresh").alias("fresh")))
    ends = ends.join(ends.where("fresh").select("hub").distinct(), "hub", "left_semi")
    reach = graph.groupBy(F.col("node").alias("member")).agg(F.max("d").alias("d"), F.count("*").alias("n")).select(
        "member", F.when(F.col("n") >= most, F.col("d")).otherwise(float("inf")).alias("reach"))
    known = codes.withColumnRenamed("node", "member").join(reach, "member", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    met = _parted(ends, "hub", "member").join(known, "member").repartition("hub", "part").sortWithinPartitions("hub", "part")
    found = met.select("hub", "part", "member", "code", "scale", "norm", "fresh", "reach").mapInPandas(_in_groups(most), _EDGE)
    return _nearest(graph.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True))), most)


def build(df: DataFrame, key: str = "vec_id", vector: str = "embedding", neighbours: int = NEIGHBOURS, members: int = 11) -> Index:
    """An index of all rows that take part; ``members`` bounds how many ids of equal vectors a result can name."""
    rows = _rows(df, key, vector)
    at = Window.partitionBy("node").orderBy("_key")
    listed = saved(rows.withColumn("_at", F.row_number().over(at)).where(F.col("_at") <= members))
    first = listed.where("_at = 1")
    dims = max(first.agg(F.max(F.size("_vec"))).first()[0] or 0, 1)
    nodes = saved(first.select("node", "_vec").mapInArrow(
        _coded(dims), "node long, code binary, scale double, norm double, vector binary"))
    codes = nodes.select("node", "code", "scale", "norm")
    count = nodes.count()
    graph = _started(nodes, dims, neighbours, count)
    for _ in range(ROUNDS):
        graph = _round(graph, codes, neighbours)
        fresh, all_ = graph.agg(F.count_if("fresh"), F.count("*")).first()
        if fresh <= SETTLED * all_:
            break
    return Index(nodes, listed.select("node", "_key"), graph.drop("fresh"), dims)


def _rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(_key, _vec, node) of the rows that take part.  Negative zeros and zeros at the end do not tell vectors apart."""
    rows = usable(df, key, vector).withColumn("_vec", F.transform("_vec", lambda x: x + 0.0))
    used = F.coalesce(F.array_max(F.transform("_vec", lambda x, i: F.when(x != 0, i + 1).otherwise(0))), F.lit(0))
    rows = rows.withColumn("_vec", F.slice("_vec", 1, used)).where(F.size("_vec") > 0)
    return rows.withColumn("node", F.xxhash64("_vec"))


# ---- search -----------------------------------------------------------------------------

def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Squared distances of pairs by bytes, of those that are nearer than ``worst``."""
    for batch in batches:
        if not len(batch):
            continue
        a, b = (fixed(batch[c], np.int8).astype(np.float32) for c in ("code", "q_code"))
        s, t, n, m = (batch[c].to_numpy() for c in ("scale", "q_scale", "norm", "q_norm"))
        dot = np.einsum("ij,ij->i", a, b).astype(np.float64)
        d = np.maximum(s * s * n + t * t * m - 2 * s * t * dot, 0)
        ok = np.flatnonzero(d < batch["worst"].to_numpy())
        yield pa.RecordBatch.from_arrays(
            [pa.array(batch["query"].to_numpy()[ok]), pa.array(batch["other"].to_numpy()[ok]), pa.array(d[ok])], names=["query", "other", "d"])


def _exactly(dims: int):
    """Distances in double precision, of the vectors themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (fixed(batch[c], np.float64) for c in ("vector", "q_vector"))
                yield pa.RecordBatch.from_arrays([batch["query"], batch["other"], pa.array(np.sqrt(((a - b) ** 2).sum(axis=1)))],
                                                 names=["query", "other", "score"])

    return run


def _beams(index: Index, wanted: DataFrame, beam: int) -> DataFrame:
    """(query, other, d): the nearest nodes that the search finds for each node of ``wanted``."""
    codes = index.nodes.select(F.col("node").alias("other"), "code", "scale", "norm")
    asked = saved(index.nodes.select("node", "code", "scale", "norm").join(wanted, "node").select(
        F.col("node").alias("query"), F.col("code").alias("q_code"), F.col("scale").alias("q_scale"), F.col("norm").alias("q_norm")))
    ends = _parted(saved(_both_ways(index.graph).toDF("opened", "other").distinct()), "opened", "other")
    lists = saved(ends.groupBy("opened", "part").agg(F.collect_list("other").alias("others")).drop("part"))
    entries = [r[0] for r in index.nodes.select("node").orderBy(F.xxhash64("node")).limit(ENTRIES).collect()]

    def taken(pairs: DataFrame) -> DataFrame:
        known = pairs.join(codes, "other").join(asked, "query")
        return known.select("query", "other", "worst", "code", "q_code", "scale", "q_scale", "norm", "q_norm").mapInArrow(
            _measured, "query long, other long, d double")

    infinite = F.lit(float("inf")).alias("worst")
    starts = F.array_union(F.array(*[F.lit(e) for e in entries]).cast("array<long>"), F.array("query"))
    seen = taken(_wide(asked.select("query", F.explode(starts).alias("other"), infinite))).withColumn("opened", F.lit(False))
    at = F.row_number().over(Window.partitionBy("query").orderBy("d", "other"))
    while True:
        once = seen.groupBy("query", "other").agg(F.min("d").alias("d"), F.max("opened").alias("opened"))
        state = saved(once.withColumn("_at", at).where(F.col("_at") <= beam).drop("_at"))
        if state.where("NOT opened").isEmpty():
            return state.drop("opened")
        worst = state.groupBy("query").agg(F.max("d").alias("d"), F.count("*").alias("n")).select(
            "query", F.when(F.col("n") >= beam, F.col("d")).otherwise(float("inf")).alias("worst"))
        front = state.where("NOT opened").select("query", F.col("other").alias("opened")).join(worst, "query")
        near = _wide(front).join(lists, "opened").select("query", F.explode("others").alias("other"), "worst")
        seen = state.withColumn("opened", F.lit(True)).unionByName(taken(near).withColumn("opened", F.lit(False)))


def neighbours(index: Index, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest rows found for each row of ``queries``, which are rows of the index:
    query_id, rank, vec_id, score (Euclidean distance)."""
    asked = saved(_rows(queries, key, vector).select(F.col("_key").alias("query_id"), "node"))
    found = _beams(index, asked.select("node").distinct(), beam)
    best = Window.partitionBy("query").orderBy("d", "other")
    few = found.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= max(EXACT, 3 * k))
    vectors = index.nodes.select(F.col("node").alias("other"), "vector")
    exact = few.join(vectors, "other").join(vectors.toDF("query", "q_vector"), "query").select("query", "other", "vector", "q_vector") \
        .mapInArrow(_exactly(index.dims), "query long, other long, score double")
    named = exact.join(index.members.withColumnRenamed("node", "other"), "other")
    first = Window.partitionBy("query").orderBy("score", "_key")
    answers = named.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= k + 1) \
        .groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "_key"))).alias("answers"))
    # one node may be asked for by very many rows
    salted = answers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("query", "node")
    given = asked.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int")).join(salted, ["node", "salt"])
    others = F.slice(F.filter("answers", lambda a: a["_key"] != F.col("query_id")), 1, k)
    return given.select("query_id", F.posexplode(others).alias("_at", "_a")).select(
        "query_id", (F.col("_at") + 1).alias("rank"), F.col("_a._key").alias("vec_id"), F.col("_a.score").alias("score"))
