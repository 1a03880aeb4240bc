"""Near-duplicates by SetSketch registers, joint likelihood and exact verification.

1. **Sketch.**  Each word shingle is the source of a Poisson process of arrivals at random registers; a
   register holds the earliest arrival of any shingle of the text, as a truncated logarithm.  Registers
   of two texts merge by the larger value, and two texts agree in a register with a probability close to
   their Jaccard similarity.  A text's arrivals are made only up to the time by which all registers are
   surely filled, so the work is a fixed part per text and a small one per shingle.
2. **Bands.**  Six registers make a band; texts that agree in a band share a bucket.  With 42 bands, a pair
   of similarity 0.8 is missed with a probability below 3e-6.
3. **Pairs.**  Texts with equal shingle sets are one node from the start.  A bucket does not pair all its
   nodes: each is compared with the bucket's leader.  Of its buckets' leaders a node first meets the one it
   shares most buckets with, and the others only if they are in another component by then, so a group of
   many copies costs one comparison a member.  In buckets whose nodes are not all in one component after that,
   every pair across components is compared or ruled out: shingles that no other text of these buckets has
   bound what a text can share.  Buckets of few nodes make rows of pairs; larger ones that share nodes are
   joined if that leaves fewer pairs, and cut into blocks, one row each.  A task multiplies the sets of two blocks
   as arrays.  Nothing is capped.
4. **Likelihood.**  The numbers of registers in which one text is ahead, behind or equal, with the known
   set sizes, give the likelihood of every similarity.  Pairs that are surely below the threshold go.
5. **Verification.**  The others are compared on their whole sets.  Of the links found, one for each node and
   component of the other side goes on, and components of components are merged by these.

Defined cases: null counts as empty; a text without words has an empty set and is linked with nothing; a
text of fewer words than a shingle has its whole sequence as its only shingle; equal ids are one document
for ``kept``; a null id never names a component that has another id.  ``near_dedup`` tells rows apart by id and
text, and of a component the rows of one id and text stay: the smallest id, then the smaller hash of the
text.  Shingles are compared by 48 bits of
their hash, sets by 64.  Columns of the input with the name of a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import chunks, free_name, gram_hashes, mix, text_of, word_hashes
from jobloom.session import saved

REGISTERS = 256
BASE = 1.05            # of the logarithm that registers hold
OFFSET = 200           # keeps the registers of the smallest sets above 0
BAND = 6               # registers of a band
BANDS = REGISTERS // BAND
SHINGLE = 5
PERCENT = 80           # least similarity
DOUBT = 16.0           # log likelihood by which a pair must be worse at the threshold to be dropped
PAIRED = 8             # nodes of a bucket up to which they are paired as rows
BLOCK = 256            # nodes of a larger bucket that are compared as arrays with as many others
COLUMNS = 4096         # shingles of one round of that
FEWER_FILES = 8        # times fewer than shuffle partitions, for tables of links and labels
BROADCAST_ROWS = 1_000_000   # of numbers, some 16 bytes each
_ODD = np.uint64(0x9E3779B97F4A7C15)


def registers(h: np.ndarray, owner: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Registers of each of ``len(size)`` sets; ``h`` are the members, ``owner`` their sets, ``size`` > 0."""
    first = np.full((len(size), REGISTERS), np.inf)
    until = (np.log(REGISTERS) + 6) / size
    wanted = np.arange(len(size))
    while len(wanted):
        chosen = np.zeros(len(size), dtype=bool)
        chosen[wanted] = True
        live = np.flatnonzero(chosen[owner])
        x, own = h[live], owner[live]
        time, turn = np.zeros(len(x)), 0
        while len(x):
            turn += 1
            with np.errstate(over="ignore"):
                r = mix(x + np.uint64(turn) * _ODD)
            time = time - np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0 ** -53) / REGISTERS
            going = time < until[own]
            x, own, time, r = x[going], own[going], time[going], r[going]
            np.minimum.at(first.reshape(-1), own * REGISTERS + (r & np.uint64(REGISTERS - 1)).astype(np.int64), time)
        wanted = np.flatnonzero(np.isinf(first).any(axis=1))
        until[wanted] *= 2
    return np.clip(np.floor(1 - np.log(first) / np.log(BASE)) + OFFSET, 0, 65535).astype(np.uint16)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of each row of registers."""
    bands = sketch[:, : BANDS * BAND].reshape(len(sketch), BANDS, BAND).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD + np.zeros((len(sketch), 1), np.uint64)
        for k in range(BAND):
            h = mix(h + bands[:, :, k] * _ODD + np.uint64(k))
    return h.view(np.int64)


_P = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
_GRID = np.linspace(0.0, 1.0, 101)


def doubtful(ahead: np.ndarray, behind: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may reach the threshold, from register comparisons and set sizes."""
    u, v = (a / (a + b))[:, None], (b / (a + b))[:, None]
    most = np.minimum(u / v, v / u)
    j = np.minimum(_GRID[None, :], most)
    up, down = np.clip(_P(u - v * j), 1e-9, 1), np.clip(_P(v - u * j), 1e-9, 1)
    same = np.clip(1 - up - down, 1e-9, 1)
    log = ahead[:, None] * np.log(up) + behind[:, None] * np.log(down) + (REGISTERS - ahead - behind)[:, None] * np.log(same)
    reached = np.where(_GRID[None, :] >= percent / 100 - 1e-9, log, -np.inf).max(axis=1)
    return log.max(axis=1) - reached <= DOUBT


def _pack(values: np.ndarray) -> bytes:
    """Sorted 48-bit numbers in 6 bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


_SKETCHED = "_key long, row long, n_shingles long, node long, bands array<long>, sketch binary, members binary"


def _sketches(n: int, percent: int):
    """Sets, sketches and band keys of texts.  A node's set comes once per task.

    Sets so small that one different member ends the similarity need no bands: equal ones share a node.
    """
    least = next(s for s in range(1, 1000) if 100 * s >= percent * (s + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            texts, keys, row = pdf["_text"].tolist(), pdf["_key"].tolist(), pdf["row"].tolist()
            for start, group in chunks(texts):
                words, own = word_hashes(group)
                h, own, _ = gram_hashes(words, own, n, len(group), short=True)
                order = np.lexsort((h & np.uint64(2**48 - 1), own))
                h, own = (h & np.uint64(2**48 - 1))[order], own[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
                h, own = h[new], own[new]
                size = np.bincount(own, minlength=len(group))
                end = np.cumsum(size)
                with np.errstate(over="ignore"):
                    mixed = mix(h * _ODD + np.uint64(1))
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
                    node = mix(sums[end] - sums[end - size] + size.astype(np.uint64) * _ODD).view(np.int64)
                fresh = []
                for i in range(len(group)):
                    fresh.append(bool(size[i] >= least and int(node[i]) not in seen))
                    seen.add(int(node[i]))
                if len(seen) > 1_000_000:
                    seen.clear()
                number = np.cumsum(fresh) - 1
                took = np.array(fresh, dtype=bool)
                part = took[own] if len(own) else np.zeros(0, bool)
                sketch = registers(mix(h[part]), number[own[part]], size[took].astype(np.float64))
                bands = band_keys(sketch)
                rows = []
                for i in range(len(group)):
                    key = keys[start + i]
                    key = None if pd.isna(key) else int(key)
                    first = (key, row[start + i], int(size[i]), int(node[i]))
                    if fresh[i]:
                        rows.append((*first, bands[number[i]], sketch[number[i]].tobytes(), _pack(h[end[i] - size[i]: end[i]])))
                    else:
                        rows.append((*first, None, None, None))
                out = pd.DataFrame(rows, columns=["_key", "row", "n_shingles", "node", "bands", "sketch", "members"])
                yield out.assign(_key=out["_key"].astype("Int64"))

    return run


def _kept(df: DataFrame) -> DataFrame:
    """A saved table of links, labels or candidates: few bytes a row, so few files."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(df.coalesce(max(1, tasks // FEWER_FILES)))


def _small(df: DataFrame) -> DataFrame:
    """A saved table of numbers with a broadcast hint where its row count allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _estimated(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs whose registers allow the similarity."""
    side = lambda s: info.select(F.col("node").alias(s), F.col("sketch").alias(f"k{s}"), F.col("n_shingles").alias(f"n{s}"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), dtype=np.uint16).reshape(len(pdf), REGISTERS) for c in ("ka", "kb"))
                ok = doubtful((x > y).sum(axis=1), (x < y).sum(axis=1), pdf["na"].to_numpy(float), pdf["nb"].to_numpy(float), percent)
                yield pdf.loc[ok, ["a", "b"]]

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ka", "kb", "na", "nb")
    return joined.mapInPandas(keep, "a long, b long")


def _verified(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs that reach the similarity on their whole sets."""
    side = lambda s: info.select(F.col("node").alias(s), F.col("members").alias(f"m{s}"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["ma"], pdf["mb"]):
                both = len(np.intersect1d(_unpack(x), _unpack(y), assume_unique=True))
                ok.append(100 * both >= percent * ((len(x) + len(y)) // 6 - both))
            yield pdf.loc[np.array(ok, dtype=bool), ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb").mapInPandas(keep, "a long, b long")


def _own_shingles(nodes: DataFrame, info: DataFrame) -> DataFrame:
    """(node, own): how many shingles of a node no other one of ``nodes`` has, where there are any."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 200):
                sets = [_unpack(m).astype(np.int64) for m in pdf["members"].iloc[a: a + 200]]
                if sets:
                    yield pd.DataFrame({"shingle": np.concatenate(sets),
                                        "node": np.repeat(pdf["node"].iloc[a: a + 200].to_numpy(), [len(s) for s in sets])})

    spread = info.select("node", "members").join(_small(nodes), "node", "left_semi").mapInPandas(rows, "shingle long, node long")
    return spread.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1") \
        .groupBy("node").agg(F.count("*").alias("own"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node of ``edges`` (a, b).

    Each round takes the smallest label among neighbours and then that label's own label, so the
    length of a chain halves.
    """
    both = _kept(edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
                 .union(edges.select("b", "a")).distinct())
    labels = _kept(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("comp")))
    while True:
        of_other = labels.select(F.col("node").alias("other"), F.col("comp").alias("theirs"))
        near = both.join(of_other, "other").groupBy("node").agg(F.min("theirs").alias("least"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "least").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        after = _kept(lower.join(jump, "comp", "left").select(
            "node", "old", F.least(F.col("comp"), F.coalesce("next", "comp")).alias("comp")))
        labels = after.select("node", "comp")
        if after.where("old <> comp").isEmpty():
            return labels


def _found(pairs: DataFrame, info: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) of pairs (a, b, comp): one for each ``a`` and component of ``b``."""
    links = saved(_verified(_estimated(pairs, info, percent), info, percent))
    theirs = labels.select(F.col("node").alias("b"), "comp")
    return _kept(links.join(theirs, "b", "left").groupBy("a", F.coalesce("comp", "b").alias("comp")).agg(F.min("b").alias("b"))
                 .select("a", "b"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links, of which only those between components count."""
    of = lambda s: labels.select(F.col("node").alias(s), F.col("comp").alias(f"comp_{s}"))
    across = links.join(of("a"), "a", "left").join(of("b"), "b", "left") \
        .select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")).where("a <> b").distinct()
    of_comp = components(across).select(F.col("node").alias("old"), F.col("comp").alias("new"))
    moved = labels.join(of_comp, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp"))
    # a node without a link so far is a component of its own
    alone = of_comp.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("comp"))
    return _kept(moved.unionByName(alone))


def _mixed(entries: DataFrame) -> DataFrame:
    """``entries`` of the buckets that hold several components, with the ``size`` of their bucket."""
    several = entries.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("size")) \
        .where("c1 <> c2").select("bucket", "size")
    return entries.join(several, "bucket")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links ``a``, ``b`` connect, each to the smallest number reachable."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a):]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, x, least)
        np.minimum.at(after, y, least)
        after = after[after]
        if (after == label).all():
            moved = np.flatnonzero(label < np.arange(len(names)))
            return names[moved], names[label[moved]]
        label = after


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set on the left has in common with each on the right."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def columns(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        hit = both[at] == values if len(both) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], row[hit][order]

    (col_l, row_l), (col_r, row_r) = columns(left), columns(right)
    counts = np.zeros((len(left), len(right)), np.float64)
    for low in range(0, len(both), COLUMNS):
        tables = []
        for col, row, n in ((col_l, row_l, len(left)), (col_r, row_r, len(right))):
            some = slice(*np.searchsorted(col, [low, low + COLUMNS]))
            table = np.zeros((n, min(COLUMNS, len(both) - low)), np.float32)
            table[row[some], col[some] - low] = 1
            tables.append(table)
        counts += tables[0] @ tables[1].T      # of ones, COLUMNS at most: exact
    return counts


def _groups(entries: DataFrame) -> DataFrame:
    """(group, node, comp): the nodes that are to be compared with each other, from ``entries`` of buckets.

    Near copies meet again in most of their buckets.  Where all nodes of the buckets that hang together make no more
    pairs than these buckets one by one, they are one group, so a pair is compared once; else a bucket is a group.
    """
    sizes = _kept(entries.groupBy("bucket").agg(F.min("node").alias("b"), F.count("*").alias("size")))
    edges = _kept(entries.join(_small(sizes), "bucket").select(F.col("node").alias("a"), "b").distinct())
    hang = components(edges).withColumnRenamed("comp", "cluster")
    of_bucket = sizes.join(hang.withColumnRenamed("node", "b"), "b")
    whole = _kept(of_bucket.groupBy("cluster").agg(F.sum(F.col("size") * F.col("size")).alias("alone"))
                  .join(hang.groupBy("cluster").agg(F.count("*").alias("nodes")), "cluster").where("nodes * nodes <= alone")
                  .select("cluster", F.col("cluster").alias("whole")))
    group = _kept(of_bucket.join(_small(whole), "cluster", "left").select("bucket", F.coalesce("whole", "bucket").alias("group")))
    return _kept(entries.join(_small(group), "bucket").select("group", "node", "comp").distinct())


def _blocks(nodes: DataFrame) -> DataFrame:
    """``nodes`` (group, node, comp) with a ``block`` of about ``BLOCK`` nodes.  A component with more nodes in its group has
    blocks of its own, which ``only`` names by it; the others share blocks."""
    of_comp = _kept(nodes.groupBy("group", "comp").agg(F.count("*").alias("n")).withColumn("only", F.when(F.col("n") > BLOCK, F.col("comp"))))
    total = _small(_kept(of_comp.groupBy("group", "only").agg(F.sum("n").alias("total"))))
    number = F.pmod(F.xxhash64("node"), F.ceil(F.col("total") / BLOCK))
    placed = of_comp.alias("c").join(total.alias("t"), F.expr("c.group = t.group AND c.only <=> t.only")) \
        .select("c.group", "comp", "c.only", "total")
    return nodes.join(placed, ["group", "comp"]).select("group", "node", "comp", "only", F.xxhash64("only", number).alias("block"))


def _across(entries: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components of each bucket, found on whole sets.

    Nodes are packed into blocks, one row each, and a task has the sets of two blocks: it compares all their nodes as
    arrays and returns a forest of the links, so rows grow with the nodes and not with their pairs.  Blocks of one
    component are not compared with each other.
    """
    nodes = saved(_blocks(_groups(entries)))
    packed = saved(nodes.join(info.select("node", "members"), "node").groupBy("group", "block")
                   .agg(F.collect_list(F.struct("comp", "members")).alias("sets")))
    block = nodes.select("group", "block", "only").distinct()
    first, second = (block.select("group", F.col("block").alias(s), F.col("only").alias(f"only_{s}")) for s in "ij")
    tiles = first.join(second, "group").where("i <= j AND coalesce(only_i <> only_j, true)") \
        .select("group", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf.iloc[0], pdf.iloc[-1]
        x, y = ([_unpack(m) for m in side["members"]] for side in (left, right))
        both = _shared_counts(x, y)
        union = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - both
        a, b = np.asarray(left["comps"]), np.asarray(right["comps"])
        k, m = np.nonzero((100 * both >= percent * union) & (a[:, None] != b[None, :]))
        return pd.DataFrame(dict(zip("ab", _forest(a[k], b[m]))))

    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.join(packed, ["group", "block"]).select("group", "i", "j", F.col("sets.comp").alias("comps"), F.col("sets.members").alias("members"))
    return dealt.repartition(tasks, "group", "i", "j").groupBy("group", "i", "j").applyInPandas(compare, "a long, b long")


def _classes(df: DataFrame, text: str, key: str, n: int, percent: int) -> DataFrame:
    """One row per row of ``df``: ``_key``, ``row`` (hash of its text), ``n_shingles``, ``comp`` (null for an
    empty set) and ``component_id``."""
    docs = saved(df.select(F.col(key).cast("long").alias("_key"), text_of(text).alias("_text"))
                 .withColumn("row", F.xxhash64("_text")).mapInPandas(_sketches(n, percent), _SKETCHED))
    held = docs.where("bands IS NOT NULL")
    entries = held.select(F.posexplode("bands").alias("band", "bucket"), "node", "n_shingles")
    shared = entries.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last")
    buckets = saved(entries.join(shared.select("bucket", "leader"), "bucket").distinct())
    apart = "100 * least(n_a, n_b) >= {0} * greatest(n_a, n_b)".format(percent)

    leaders = buckets.where("node = leader").select("bucket", F.col("node").alias("b"), F.col("n_shingles").alias("n_b"))
    pairs = saved(buckets.where("node <> leader").select("bucket", F.col("node").alias("a"), F.col("n_shingles").alias("n_a"))
                  .join(leaders, "bucket").where(apart).groupBy("a", "b").agg(F.count("*").alias("buckets")))
    touched = _kept(buckets.select("node").distinct())
    info = saved(held.select("node", "n_shingles", "bands", "sketch", "members").join(_small(touched), "node", "left_semi")
                 .dropDuplicates(["node"]))
    best = _kept(pairs.groupBy("a").agg(F.min(F.struct(-F.col("buckets"), "b"))["b"].alias("b")))
    labels = components(saved(_verified(_estimated(best, info, percent), info, percent)))
    of = lambda s: labels.select(F.col("node").alias(s), F.col("comp").alias(f"comp_{s}"))
    others = saved(pairs.select("a", "b").join(best, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
                   .where("coalesce(comp_a, a) <> coalesce(comp_b, b)").select("a", "b"))
    found = _found(others, info, labels, percent)
    if not found.isEmpty():
        labels = _merged(labels, found)
    now = buckets.select("band", "bucket", "node", "n_shingles").join(labels.select("node", "comp"), "node", "left") \
        .withColumn("comp", F.coalesce("comp", "node"))
    rest = _kept(_mixed(now))
    if not rest.isEmpty():
        own = _small(_kept(_own_shingles(_kept(rest.select("node").distinct()), info)))
        # n_shingles less those that nobody else has is the most a node can share
        rest = rest.join(own, "node", "left").withColumn("most", F.col("n_shingles") - F.coalesce("own", F.lit(0))) \
            .where("100 * most >= {0} * n_shingles".format(percent)).drop("own", "size")
        rest = _kept(_mixed(rest))
        few = rest.where(F.col("size") <= PAIRED).join(info.select("node", "bands"), "node")
        side = lambda s: few.select("bucket", "band", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "comp", "n_shingles", "most", "bands")])
        # Each pair once: in the first band it shares.
        share = "least(most_a, most_b)"
        met = side("a").join(side("b").drop("band"), "bucket").where("comp_a <> comp_b and node_a < node_b") \
            .where(f"100 * {share} >= {percent} * (n_shingles_a + n_shingles_b - {share})") \
            .where(~F.arrays_overlap(F.slice("bands_a", F.lit(1), F.col("band")), F.slice("bands_b", F.lit(1), F.col("band"))))
        pairs = saved(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
        found = _found(pairs, info, labels, percent)
        crowded = rest.where(F.col("size") > PAIRED)
        if not crowded.isEmpty():
            found = found.unionByName(saved(_across(crowded, info, percent)))
        if not found.isEmpty():
            labels = _merged(labels, found)

    # the smallest id of each component
    least = docs.where("n_shingles > 0").groupBy("node").agg(F.min("_key").alias("least"))
    of_node = least.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_comp = of_node.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = _kept(of_node.join(of_comp, "comp").select(F.col("node").alias("_node"), "comp", "component_id"))
    named = docs.select("_key", "row", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")) \
        .join(named, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_key"))
    return named.select("_key", "row", "n_shingles", "comp", component.alias("component_id"))


def near_classes(df: DataFrame, text: str = "text", key: str = "doc_id", n: int = SHINGLE,
                 percent: int = PERCENT) -> DataFrame:
    """One row per row of ``df``: ``_key`` (its id), ``n_shingles``, ``component_id`` and ``kept``."""
    return _classes(df, text, key, n, percent).select(
        "_key", "n_shingles", "component_id", F.col("_key").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", n: int = SHINGLE,
               percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` that stay: one document of each component."""
    rows = saved(_classes(df, text, key, n, percent).where("comp IS NOT NULL").select(
        "comp", F.struct(F.col("_key").isNull().alias("unnamed"), "_key", "row").alias("this")).distinct())
    stays = rows.groupBy("comp").agg(F.min("this").alias("first"), F.count("*").alias("n")).where("n > 1").select("comp", "first")
    name, row = free_name(df, "_dropped"), free_name(df, "_dropped_row")
    dropped = _kept(rows.join(stays, "comp").where("this <> first").select(
        F.col("this._key").alias(name), F.col("this.row").alias(row)).distinct())
    same = F.col(key).cast("long").eqNullSafe(F.col(name)) & (F.xxhash64(text_of(text)) == F.col(row))
    return df.join(_small(dropped), same, "left_anti")
