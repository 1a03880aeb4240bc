"""Mixing sources to target weights by exact quotas and a splitting tree.

1. **Targets.**  A source may be used up to three times.  Its target is the smaller of that cap and
   its weight times a level; the level is the one at which all targets add up to all words.
2. **Blocks.**  Each source is cut into at most ``BLOCKS`` blocks by a seeded hash of the id, so a
   source that holds a third of all rows is many narrow aggregates.  A target that is ``f`` times the
   source and a rest takes every block ``f`` times, and for the rest once more the blocks that fit, in
   permuted order.
3. **Shards.**  The blocks drawn are the quota of a source.  A binary tree over the output shards
   splits all quotas at once: each node hands its left half an exact share, drawn without replacement
   from the quotas of all sources (a multivariate hypergeometric draw), until one shard is left.  The
   blocks of a source in permuted order then fill the counts of the shards, so shards are disjoint.
4. **Order.**  Rows are put in a seeded order within each task's part of a shard.

Every draw depends on the seed and on names, never on partitions, so reruns agree.

Defined cases: null text has size 0; a null source comes last; a source without words has target 0; an
empty table gives an empty mix; repeated rows are taken alike.  Columns of the input that have the
name of a result column are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import WORD, free_name, text_of
from jobloom.session import saved

BLOCKS = 1024        # of a source; a source's taken words miss its target by less than one block
MOST_REPEATS = 3     # times a source may be used
SHARDS = 16
BROADCAST_ROWS = 100_000   # of block plans, some 50 bytes each
SEED = 20_240_601
RESULTS = ("size", "source_size", "target", "taken", "copies", "shards")


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources take the weights in turn, by code point, null last.  With the sources in the order of cap
    over weight, the level is the largest of (words left) / (weights left) over all starts.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighted = sizes.withColumn("_w", F.get(F.array(*map(F.lit, weights)), turn.cast("int")).cast("double")) \
        .withColumn("_cap", (F.col("source_size") * most).cast("double"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    level = (F.sum("source_size").over(everywhere) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(everywhere) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    return weighted.withColumn("_level", level).withColumn("_level", F.max("_level").over(everywhere)) \
        .select("source", "source_size", F.least("_cap", F.col("_w") * F.col("_level")).alias("target"))


def _block(key: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(BLOCKS)).cast("int")


def _random(seed: int, *name: object) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(repr(name).encode())])


def _draw(seed: int):
    """How often each block of one source is drawn: every block ``full`` times, and once more
    those that fit the rest in permuted order."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        source, full = pdf["source"].iloc[0], int(pdf["full"].iloc[0])
        place = _random(seed, "blocks", source).permutation(BLOCKS)[pdf["block"].to_numpy()]
        pdf = pdf.assign(place=place).sort_values("place")
        left, draws = float(pdf["rest"].iloc[0]), []
        for words in pdf["words"]:
            fits = words <= left
            left -= words if fits else 0
            draws.append(full + int(fits))
        # one more block where that comes nearer to the target
        over = [(abs(words - left), i) for i, (words, n) in enumerate(zip(pdf["words"], draws)) if n == full]
        if over and min(over)[0] < left:
            draws[min(over)[1]] += 1
        return pd.DataFrame({"source": pdf["source"], "block": pdf["block"], "place": pdf["place"], "draws": draws})

    return draw


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Exact quotas of each shard: rows are shards, columns are sources."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def descend(low: int, high: int, quota: np.ndarray) -> None:
        if high - low == 1:
            out[low] = quota
            return
        middle = (low + high) // 2
        total = int(quota.sum())
        share = total * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left, remaining, wanted = np.zeros_like(quota), total, share
        for i, q in enumerate(quota):          # one hypergeometric draw per source
            others = remaining - int(q)
            left[i] = rng.hypergeometric(int(q), others, wanted) if wanted and q else 0
            remaining, wanted = others, wanted - int(left[i])
        descend(low, middle, left)
        descend(middle, high, quota - left)

    descend(0, shards, quotas)
    return out


def plan_mix(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source",
             shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of ``df`` with ``size``, ``source_size``, ``target``, ``taken``, ``copies`` and
    ``shards`` (the output shard of each copy)."""
    df = df.drop(*(c for c in df.columns if c.lower() in RESULTS and c != source))
    name, number, of_plan, of_block, of_goal = (
        free_name(df, n) for n in ("_source", "_block", "_plan_source", "_plan_block", "_goal_source"))
    rows = df.withColumn(name, F.col(source).cast("string")).withColumn(number, _block(key, seed)) \
        .withColumn("size", words_in(text_of(text)))
    blocks = saved(rows.groupBy(F.col(name).alias("source"), F.col(number).alias("block")).agg(F.sum("size").alias("words")))
    targets = saved(source_targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size"))))

    full = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0))
    quota = targets.select(F.col("source").alias("_s"), full.alias("full"),
                           (F.col("target") - full * F.col("source_size")).alias("rest"))
    drawn = saved(blocks.join(quota, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
                  .groupBy("source").applyInPandas(_draw(seed), "source string, block int, place int, draws long"))
    dealt = saved(_deal(drawn, shards, seed))

    # at most BLOCKS short rows a source; where that is many, the planner joins by key
    plan = dealt.select(F.col("source").alias(of_plan), F.col("block").alias(of_block), "shards")
    goals = targets.select(F.col("source").alias(of_goal), "source_size", "target")
    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    return rows.join(small(plan), F.col(name).eqNullSafe(F.col(of_plan)) & (F.col(number) == F.col(of_block)), "left") \
        .join(small(goals), F.col(name).eqNullSafe(F.col(of_goal)), "left") \
        .withColumn("copies", F.size("shards").cast("long")) \
        .select(*df.columns, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "shards")


def _deal(drawn: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, block, shards): the shard of each draw of a block."""

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", na_position="last")
        counts = split_quotas(pdf["quota"].to_numpy(dtype=np.int64), shards, seed)
        return pd.DataFrame({"source": pdf["source"].to_numpy(), "counts": list(counts.T)})

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.repeat(np.arange(shards), np.asarray(pdf["counts"].iloc[0], dtype=np.int64))
        pdf = pdf.sort_values("place")
        n, lots, at = pdf["draws"].to_numpy(dtype=np.int64), [[] for _ in range(len(pdf))], 0
        rng = _random(seed, "turns", pdf["source"].iloc[0])
        for turn in range(int(n.max(initial=0))):   # all blocks once, in permuted order, before any again
            for i in rng.permutation(np.flatnonzero(n > turn)):
                lots[i].append(int(order[at]))
                at += 1
        return pd.DataFrame({"source": pdf["source"], "block": pdf["block"], "shards": lots})

    # the tree needs all sources at once: one row each
    counts = drawn.groupBy("source").agg(F.sum("draws").alias("quota")).groupBy() \
        .applyInPandas(tree, "source string, counts array<long>").withColumnRenamed("source", "_c")
    return drawn.join(counts, F.col("source").eqNullSafe(F.col("_c"))).drop("_c").groupBy("source") \
        .applyInPandas(deal, "source string, block int, shards array<int>")


def mix_sources(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source",
                shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: one row per copy taken, with ``shard`` and ``copy``, in seeded order."""
    planned = plan_mix(df, text, key, source, shards, seed)
    rows = planned.select(*planned.columns, F.posexplode("shards").alias("copy", "shard")).drop("shards")
    lot = F.xxhash64(F.col(key), F.col("copy"), F.lit(seed))
    part = F.pmod(lot, F.lit(64))
    return rows.repartition("shard", part).sortWithinPartitions("shard", lot)
