"""What the operators of this package share: tables, text columns, word and n-gram hashes.

Word and n-gram hashing works on whole batches of texts as one byte array, so Python runs a
fixed number of numpy calls per batch and not per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\x0c\r "          # the characters of [\x20\x09-\x0D]
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1_000_000             # texts handled by one round of numpy calls; longer ones go alone
BATCH_ROWS = 2_000                  # rows of an Arrow batch, as texts may be long

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_BASE = np.uint64(0x5851F42D4C957F2D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.  Arrow batches are kept small, since texts can be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not use yet."""
    used = {c.lower() for c in df.columns}
    while wanted.lower() in used:
        wanted = f"_{wanted}"
    return wanted


def give_back_memory() -> None:
    """Returns freed memory to the system.  Python workers live on after a task and would hold its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def chunks(texts: Sequence[str | None], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 texts) in groups of about ``most`` bytes."""
    start, group, size = 0, [], 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8") if isinstance(text, str) else b""
        if group and size + len(data) > most:
            yield start, group
            start, group, size = i, [], 0
        group.append(data)
        size += len(data)
    if group:
        yield start, group


def _classes(word_bytes: str) -> np.ndarray:
    """Which bytes belong to words: all but white space, or only letters, digits and non-ASCII."""
    table_ = np.ones(256, dtype=bool)
    if word_bytes == "not space":
        table_[[ord(c) for c in SPACES]] = False
    else:
        table_[:128] = [chr(i).isalnum() for i in range(128)]
    return table_


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = {kind: _classes(kind) for kind in ("not space", "letters")}
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, as far as needed."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
            _inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]), dtype=np.uint64)
    return _powers, _inverse


def word_hashes(group: list[bytes], kind: str = "not space") -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text) over a group of UTF-8 texts, A-Z lower-cased.

    A word's hash is a polynomial of its bytes, taken from running sums over the whole group.
    """
    data = np.frombuffer(b" ".join(group) + b" ", dtype=np.uint8)
    lower = _LOWER[data]
    inside = _IS_WORD[kind][lower]
    # blanks between texts end words, so a word never crosses texts
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    power, inverse = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * inverse[start] + _ODD * (end - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in group])
    return h, np.searchsorted(ends, start, side="right")


def gram_hashes(words: np.ndarray, owner: np.ndarray, n: int, n_texts: int,
                short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, index of the first word) of every run of n words within a text.

    With ``short``, a text of fewer words gives its whole sequence as one run.
    """
    count = np.bincount(owner, minlength=n_texts)
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
        for k in range(n):
            h = mix(h + words[k: k + len(h)] + np.uint64(k + 1) * _ODD)
        whole = owner[: len(h)] == owner[n - 1:] if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        h, own = h[at], owner[at]
        if short:
            few = np.flatnonzero((count > 0) & (count < n))
            if len(few):
                extra = np.zeros(len(few), dtype=np.uint64)
                for k in range(n - 1):
                    has = count[few] > k
                    extra[has] = mix(extra[has] + words[begin[few[has]] + k] + np.uint64(k + 1) * _ODD)
                extra = mix(extra + count[few].astype(np.uint64) * _M2)
                h, own, at = np.concatenate([h, extra]), np.concatenate([own, few]), np.concatenate([at, begin[few]])
    return h, own, at
