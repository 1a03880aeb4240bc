"""Hard negatives by exact inner products of integer tiles, multiplied by Strassen's recursion.

1. **Tiles.**  Vectors are scaled and floored to integers and packed into tiles of rows.  Anchors are tiles
   as well, of fewer rows.  Every pair of an anchor tile and a candidate tile that can matter is one product.
2. **Products.**  Strassen's recursion over int64 blocks: operands of odd size get a row or column of zeros,
   seven half-sized products take the place of eight, and all sums are exact integer sums.  Below ``LEAF`` a
   block is multiplied plainly (in doubles where its numbers are so small that no sum can be inexact).
3. **Heaps.**  A task keeps, for each anchor of a tile, the best positives, or for each window of an anchor the best
   negatives.  Heaps of tasks merge by rank, as each holds all that its rows could add to the result.
4. Positives are sought among tiles of the anchor's own label only.  Their scores give the windows, and a second pass over
   mixed tiles fills them.

How tiles meet: candidate tiles are dealt to groups of about ``GROUP`` tiles, and anchor tiles, the smaller side, go to
every group.  So a label that holds a third of all rows is many groups, and neither side is held whole anywhere.

Defined cases: see ``vectors`` for rows that take part; a null label takes no part either.  Rows with the
anchor's own id are never its positives or negatives.  Scores are long integers; numbers so large that
a score leaves the range wrap around as Spark's own sums do.  Empty vectors score 0.  An anchor without positives, or
a positive without negatives in its window, gives no row.  Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.vectors import fixed, matrix, usable
from jobloom.session import saved

ANCHORS = 256          # rows of an anchor tile
CANDIDATES = 1024      # rows of a candidate tile
GROUP = 16             # candidate tiles that meet the anchor tiles together
HELD = 32              # anchor tiles whose heaps a task holds at a time
LEAF = 32              # least side of blocks that are split further
SCALE = 256
_EXACT = float(1 << 53)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The int64 product of two int64 blocks."""
    if min(*a.shape, b.shape[1]) <= LEAF:
        return _leaf(a, b)
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1, p2, p3 = product(a11 + a22, b11 + b22), product(a21 + a22, b11), product(a11, b12 - b22)
    p4, p5 = product(a22, b21 - b11), product(a11 + a12, b22)
    p6, p7 = product(a21 - a11, b11 + b12), product(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * l), dtype=np.int64)
    out[:i, :l], out[:i, l:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :l], out[i:, l:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), dtype=np.int64)
    most = np.abs(a.astype(np.float64)).max() * np.abs(b.astype(np.float64)).max() * a.shape[1]
    if most < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


# ---- tiles ------------------------------------------------------------------------------

_TILE = "part long, tile long, ids binary, labels binary, kind string, numbers binary{0}"
_WINDOWS = ", others binary, scores binary"


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes."""
    low, high = (int(numbers.min()), int(numbers.max())) if numbers.size else (0, 0)
    return numbers.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64)
                               if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _tiles(rows: DataFrame, most: int, dims: int, pure: bool, windows: int = 0) -> DataFrame:
    """Rows (_key, _label, _numbers) packed into tiles, of one label each if ``pure``.

    Rows with windows also carry ``_others``, their positives as (id, score).
    """
    def pack(part: int, table: pa.Table) -> pa.RecordBatch:
        ids = table["_key"].to_numpy()
        order = np.argsort(ids, kind="stable")
        numbers = _narrow(matrix(table["_numbers"], dims)[order])
        columns = [[part], [int(ids[order[0]])], [ids[order].tobytes()], [table["_label"].to_numpy()[order].tobytes()],
                   [numbers.dtype.str], [numbers.tobytes()]]
        if windows:
            both = [matrix(table[c], windows)[order] for c in ("_ids", "_scores")]
            # a window without a positive has the id of its anchor, which no positive has
            size = table["_ids"].combine_chunks().value_lengths().to_numpy()[order]
            both[0][np.arange(windows)[None, :] >= size[:, None]] = np.repeat(ids[order], windows - size)
            columns += [[x.astype(np.int64).tobytes()] for x in both]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
        names = ["part", "tile", "ids", "labels", "kind", "numbers", "others", "scores"]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=names[: len(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, label = [], None
        for batch in batches:
            labels = batch["_label"].to_numpy()
            cuts = np.flatnonzero(np.diff(labels)) + 1 if pure else np.empty(0, np.int64)
            for a, b in zip([0, *cuts], [*cuts, len(labels)]):
                if a == b:
                    continue
                if pure and held and label != labels[a]:
                    yield pack(int(label), pa.Table.from_batches(held))
                    held = []
                label = labels[a]
                while a < b:
                    room = most - sum(len(h) for h in held)
                    held.append(batch.slice(a, min(room, b - a)))
                    a += len(held[-1])
                    if sum(len(h) for h in held) == most:
                        yield pack(int(label) if pure else 0, pa.Table.from_batches(held))
                        held = []
        if held:
            yield pack(int(label) if pure else 0, pa.Table.from_batches(held))

    if pure:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(tasks, "_label", F.xxhash64("_key")).sortWithinPartitions("_label")
    return saved(rows.mapInArrow(run, _TILE.format(_WINDOWS if windows else "")))


def _met(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs of an anchor tile and a candidate tile of equal ``part``."""
    groups = candidates.groupBy("part").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("n"))
    there = candidates.join(groups, "part").withColumn("group", F.pmod(F.xxhash64("tile"), F.col("n")).cast("int")).drop("n")
    here = anchors.join(groups, "part").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    here = here.withColumnsRenamed({c: f"a_{c}" for c in anchors.columns if c != "part"})
    return there.join(here, ["part", "group"]).drop("part", "group")


class _Heaps:
    """The best entries of every slot of an anchor tile, by score and then by id."""

    def __init__(self, slots: int, size: int):
        self.ids, self.scores = np.zeros((slots, size), np.int64), np.zeros((slots, size), np.int64)
        self.used, self.size = np.zeros(slots, np.int64), size

    def add(self, slot: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(ids):
            return
        n = self.used[slot]
        ids, scores = np.concatenate([self.ids[slot, :n], ids]), np.concatenate([self.scores[slot, :n], scores])
        best = np.lexsort((ids, -scores))[: self.size]
        self.used[slot] = len(best)
        self.ids[slot, : len(best)], self.scores[slot, : len(best)] = ids[best], scores[best]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, id, score) of all entries."""
        slot, at = np.nonzero(np.arange(self.size)[None, :] < self.used[:, None])
        return slot, self.ids[slot, at], self.scores[slot, at]


Rows = Callable[[dict, dict, np.ndarray, _Heaps], None]


def _filled(pairs: DataFrame, dims: int, slots: int, size: int, add: Rows, schema: str,
            out: Callable[[dict, _Heaps], pa.RecordBatch]) -> DataFrame:
    """The heaps of every task over its pairs of tiles."""

    def tile(row: dict, mark: str) -> dict:
        whole = lambda c: np.frombuffer(row[mark + c], dtype=np.int64)
        found = {"ids": whole("ids"), "labels": whole("labels"),
                 "numbers": np.frombuffer(row[mark + "numbers"], dtype=row[mark + "kind"]).reshape(-1, dims).astype(np.int64)}
        for c in ("others", "scores"):
            if mark + c in row:
                found[c] = whole(c).reshape(len(found["ids"]), -1)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[dict, _Heaps]] = {}
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                name = row["a_tile"]
                if name not in held:
                    if len(held) == HELD:
                        yield from (out(*x) for x in held.values())
                        held = {}
                    anchors = tile(row, "a_")
                    held[name] = anchors, _Heaps(len(anchors["ids"]) * slots, size)
                anchors, heaps = held[name]
                rows = tile(row, "")
                add(anchors, rows, product(anchors["numbers"], rows["numbers"].T), heaps)
        yield from (out(*x) for x in held.values())

    return pairs.mapInArrow(run, schema)


def _batch(*columns: np.ndarray, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names.split())


# ---- positives, windows, negatives ------------------------------------------------------

def _positives(anchors: DataFrame, candidates: DataFrame, dims: int, most: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the best other rows of the anchor's label."""

    def add(here: dict, there: dict, scores: np.ndarray, heaps: _Heaps) -> None:
        for i, anchor in enumerate(here["ids"]):
            ok = np.flatnonzero(there["ids"] != anchor)
            s = scores[i, ok]
            if len(s) > most:   # with all that tie with the last one
                best = s >= np.partition(s, len(s) - most)[len(s) - most]
                ok, s = ok[best], s[best]
            heaps.add(i, there["ids"][ok], s)

    def out(here: dict, heaps: _Heaps) -> pa.RecordBatch:
        slot, other, score = heaps.entries()
        return _batch(here["ids"][slot], other, score, names="anchor_id positive_id positive_score")

    found = _filled(_met(anchors, candidates), dims, 1, most, add, "anchor_id long, positive_id long, positive_score long", out)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= most).drop("_at")


def _negatives(anchors: DataFrame, candidates: DataFrame, dims: int, windows: int, most: int, low: int, high: int) -> DataFrame:
    """The best rows of other labels in each window, with their rank."""

    def add(here: dict, there: dict, scores: np.ndarray, heaps: _Heaps) -> None:
        for i, anchor in enumerate(here["ids"]):
            ok = np.flatnonzero((there["labels"] != here["labels"][i]) & (there["ids"] != anchor))
            order = np.argsort(-scores[i, ok], kind="stable")   # ids of a tile ascend, so ties are in order
            ids, down = there["ids"][ok[order]], -scores[i, ok[order]]
            for w in range(windows):
                if here["others"][i, w] == anchor:
                    break
                score = int(here["scores"][i, w])
                # low * score <= 100 * s <= high * score, in whole numbers
                first = np.searchsorted(down, -(high * score // 100), "left")
                last = np.searchsorted(down, low * score // -100, "right")
                last = min(last, first + most)
                if first < last:
                    heaps.add(i * windows + w, ids[first:last], -down[first:last])

    names = "anchor_id positive_id positive_score negative_id negative_score"

    def out(here: dict, heaps: _Heaps) -> pa.RecordBatch:
        slot, other, score = heaps.entries()
        i, w = slot // windows, slot % windows
        return _batch(here["ids"][i], here["others"][i, w], here["scores"][i, w], other, score, names=names)

    found = _filled(_met(anchors, candidates), dims, windows, most, add, ", ".join(f"{c} long" for c in names.split()), out)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def mine_negatives(df: DataFrame, anchor: Column, key: str = "vec_id", label: str | Column = "label", vector: str = "embedding",
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """For the rows where ``anchor`` (a condition on the column ``_key``) holds: their ``positives`` best rows of equal
    label, and for each the ``negatives`` best rows of other labels that score from ``low`` to ``high``
    percent of it.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    wanted = F.col(label) if isinstance(label, str) else label
    whole = F.transform("_vec", lambda x: F.floor(x * SCALE))
    rows = saved(usable(df, key, vector, _label=wanted.cast("long")).select("_key", "_label", whole.alias("_numbers")))
    dims = max(rows.agg(F.max(F.size("_numbers"))).first()[0] or 0, 1)
    few = rows.where(anchor)
    found = saved(_positives(_tiles(few, ANCHORS, dims, True), _tiles(rows, CANDIDATES, dims, True), dims, positives))
    order = F.array_sort(F.collect_list(F.struct((-F.col("positive_score")).alias("down"), "positive_id")))
    windows = found.groupBy(F.col("anchor_id").alias("_key")).agg(order.alias("_all")).select(
        "_key", F.transform("_all", lambda x: x["positive_id"]).alias("_ids"), F.transform("_all", lambda x: -x["down"]).alias("_scores"))
    return _negatives(_tiles(few.join(windows, "_key"), ANCHORS, dims, False, positives), _tiles(rows, CANDIDATES, dims, False),
                      dims, positives, negatives, low, high).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
