"""Exact deduplication by two passes with a Bloom filter, in DataFrame functions only.

Texts are equal when identical after deleting white space.  The first pass gives every text a
few bits of a filter word, keeps the bit patterns that more than one row has, and so ends in a
table of filter words.  The second pass tests each row against its word.  A row whose bits are
not all set has no equal: it passes straight through.  Only the others are shuffled by their
fingerprint.  The filter is a table, joined by its word number: the planner broadcasts it where
its measured size allows, and joins narrow keys otherwise, so it may grow with the input.

Defined cases: null text counts as empty, and all such texts are equal; of equal texts the one
with the most code points stays, then the smallest id; a null id never wins over another of the
same length; rows that repeat id and text are all marked as kept unless ``single`` is asked for.
Columns of the input that have the name of a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import SPACES, free_name, text_of
from jobloom.session import saved

BITS_PER_ROW = 16   # of the filter; about one distinct row in 300 is shuffled in vain
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def fingerprint(text: Column) -> Column:
    """SHA-256 of the text without white space, in lower-case hex."""
    return F.sha2(F.translate(text, SPACES, "").cast("binary"), 256)


def _filter_bits(sha: Column) -> Column:
    """Three of the 64 bits of a filter word."""
    h = F.xxhash64(sha, F.lit(1))
    # shiftleft takes a fixed number of places, so the bits come from a table of powers
    power = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    bit = lambda by: F.get(power, F.shiftright(h, by).bitwiseAND(F.lit(63)).cast("int"))
    return bit(5).bitwiseOR(bit(23)).bitwiseOR(bit(41))


def exact_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", single: bool = False) -> DataFrame:
    """The rows of ``df`` with ``keep_id`` (id of the row that stays), ``group_size``, ``kept`` and
    ``text_sha256``.  With ``single``, rows repeating the id of a kept row are dropped."""
    df = df.drop(*(c for c in df.columns if c.lower() in RESULTS))
    sha, word, bits, size, held, maybe, longest = (
        free_name(df, n) for n in ("_sha", "_word", "_bits", "_size", "_held", "_maybe", "_longest"))
    rows = saved(df.select(F.unhex(fingerprint(text_of(text))).alias(sha), F.length(text_of(text)).alias(size),
                           F.col(key).alias("_key")))
    words = max(1, rows.count() * BITS_PER_ROW // 64)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(words))

    # first pass: the filter holds the bit patterns that several rows have
    patterns = rows.groupBy(place(F.col(sha)).alias(word), _filter_bits(F.col(sha)).alias(bits)).count()
    repeated = saved(patterns.where("count > 1").groupBy(word).agg(F.expr(f"bit_or({bits})").alias(held)))

    # among the rows the filter lets through, the one that stays of each group
    marked = lambda d: d.join(repeated, word, "left").withColumn(
        maybe, F.coalesce(F.col(held).bitwiseAND(F.col(bits)) == F.col(bits), F.lit(False)))
    tested = lambda d: marked(d.withColumn(word, place(F.col(sha))).withColumn(bits, _filter_bits(F.col(sha))))
    sizes = tested(rows).where(maybe).groupBy(sha, size).agg(F.min("_key").alias("_least"), F.count("*").alias("_n"))
    groups = saved(sizes.groupBy(sha).agg(
        F.max_by("_least", size).alias("keep_id"), F.max(size).alias(longest), F.sum("_n").alias("group_size")))

    # second pass over the rows themselves
    wide = tested(df.withColumn(sha, F.unhex(fingerprint(text_of(text)))).withColumn(size, F.length(text_of(text))))
    alone = wide.where(~F.col(maybe)).select(
        *df.columns, F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.lower(F.hex(sha)).alias("text_sha256"))
    grouped = wide.where(maybe).join(groups, sha).select(
        *df.columns, "keep_id", "group_size",
        (F.col(key).eqNullSafe(F.col("keep_id")) & (F.col(size) == F.col(longest))).alias("kept"),
        F.lower(F.hex(sha)).alias("text_sha256"))
    if single:
        lone = grouped.where("NOT kept OR group_size = 1")
        grouped = lone.unionByName(grouped.where("kept AND group_size > 1").dropDuplicates(["text_sha256"]))
    return alone.unionByName(grouped)
