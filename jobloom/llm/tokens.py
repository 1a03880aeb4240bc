"""Token counts by merging all pre-tokens of a batch at once, rank by rank.

A byte-level BPE splits a text into pre-tokens and, within each, keeps merging the adjacent pair of
lowest rank.  Here the pre-tokens of a batch are one ragged array of symbols.  In each round every
pre-token looks up the ranks of its pairs, and all places of its own lowest-ranked pair merge
together, in runs of one symbol every other place from the left.  Pre-tokens without a pair that
merges leave the array; the symbols they are left with are their tokens.  A merge only makes pairs of
higher rank, so this gives the same as merging one pair at a time.

Most pre-tokens of a batch have been seen before, so their counts are kept in a table of bounded size.

Defined cases: null counts as empty and has 0 tokens; special strings inside a text count as one token
each, as the tokenizer's file has them; texts of any length are counted whole.  Columns of the input
that have the name of a result column are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import text_of

#: Fixed value: the pre-token pattern of the byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 1024
MEMO = 400_000          # counts of pre-tokens kept by a task
PIECE_CHARS = 1_000_000  # texts whose pre-tokens are held at once; longer ones go alone
_NONE = np.int32(2**31 - 1)


class Merges:
    """The merge table as a hash table of two levels in numpy, for whole arrays of pairs."""

    SLOTS = 21

    def __init__(self, first: np.ndarray, second: np.ndarray, merged: np.ndarray, byte_ids: np.ndarray):
        self.byte_ids = byte_ids.astype(np.int64)
        self.size = int(max(first.max(initial=0), second.max(initial=0), merged.max(initial=0), byte_ids.max())) + 1
        self.keys = first.astype(np.int64) * self.size + second
        self.merged = merged.astype(np.int64)
        self.levels: list[tuple[np.uint64, np.ndarray]] = []
        rest = np.arange(len(self.keys), dtype=np.int32)
        odd = 0x9E3779B97F4A7C15
        while len(rest) or not self.levels:
            level = np.full(1 << self.SLOTS, -1, dtype=np.int32)
            factor = np.uint64(odd)
            at = self._slot(self.keys[rest], factor)
            level[at] = rest
            self.levels.append((factor, level))
            rest = rest[level[at] != rest]
            odd = (odd * 0x5851F42D4C957F2D + 0x14057B7EF767814F) % 2**64 | 1

    def _slot(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * factor) >> np.uint64(64 - self.SLOTS)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        out = np.full(len(keys), _NONE, dtype=np.int32)
        for factor, level in self.levels:
            found = level[self._slot(keys, factor)]
            hit = (found >= 0) & (self.keys[found] == keys)
            out[hit] = found[hit]
        return out

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty piece once no pair of it merges."""
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        result = lengths.copy()
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        who = np.arange(len(pieces))
        while len(symbols):
            owner = np.repeat(np.arange(len(lengths)), lengths)
            rank = np.full(len(symbols), _NONE, dtype=np.int32)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inside] = self.ranks(symbols[inside], symbols[inside + 1])
            starts = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(rank, starts)
            live = lowest < _NONE
            result[who[~live]] = lengths[~live]
            here = np.repeat(live, lengths)
            symbols, rank, owner = symbols[here], rank[here], owner[here]
            who, lowest = who[live], lowest[live]
            owner = (np.cumsum(live) - 1)[owner]
            if not len(symbols):
                break
            places = np.flatnonzero(rank == lowest[owner])
            # neighbouring places are a run of one symbol: every other one merges
            new_run = np.concatenate([[True], np.diff(places) != 1])
            run_start = places[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
            places = places[(places - run_start) % 2 == 0]
            symbols[places] = self.merged[rank[places]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[places + 1] = False
            symbols = symbols[keep]
            lengths = np.bincount(owner[keep], minlength=len(who))
        return result


def byte_letters() -> list[str]:
    """The letter of each byte in the tokenizer's files: printable bytes stand for themselves, the
    others follow from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    moved = {b: 256 + i for i, b in enumerate(others)}
    return [chr(moved.get(b, b)) for b in range(256)]


def load_merges(path: str) -> tuple[Merges, list[str]]:
    """Merge table and special strings of a byte-level BPE file (tokenizers' JSON)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    column = lambda values: np.array(list(values), dtype=np.int64)
    merges = Merges(column(vocab[a] for a, _ in pairs), column(vocab[b] for _, b in pairs),
                    column(vocab[a + b] for a, b in pairs), column(vocab[c] for c in byte_letters()))
    return merges, [t["content"] for t in spec.get("added_tokens", [])]


def counter(merges: Merges, special: list[str], pattern: str = PATTERN):
    """A function from texts to their token counts, with a memory for pre-tokens."""
    split = regex.compile(pattern).findall
    parts = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))).split if special else None
    tokens_in = regex.compile("|".join(map(regex.escape, special))).findall if special else None
    memo: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        split_texts, extra, new = [], [], set()
        for text in texts:
            if special and any(s in text for s in special):
                found = [p for part in parts(text) for p in split(part)]
                extra.append(len(tokens_in(text)))
            else:
                found = split(text)
                extra.append(0)
            split_texts.append(found)
            new.update(found)
        if len(memo) > MEMO:
            memo.clear()
        fresh = list(new.difference(memo)) if memo else list(new)
        for i in range(0, len(fresh), 100_000):
            some = fresh[i: i + 100_000]
            memo.update(zip(some, merges.count([p.encode("utf-8") for p in some]).tolist()))
        get = memo.__getitem__
        return [sum(map(get, found)) + more for found, more in zip(split_texts, extra)]

    return count


def token_counts(df: DataFrame, tokenizer_path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The rows of ``df`` with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    merges, special = load_merges(tokenizer_path)

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(merges, special)
        for batch in batches:
            out, group, size = [], [], 0
            for value in batch:
                if group and size + len(value) > PIECE_CHARS:
                    out += count(group)
                    group, size = [], 0
                group.append(value)
                size += len(value)
            yield pd.Series(out + (count(group) if group else []), dtype="int64")

    return df.withColumn("n_bytes", F.octet_length(text_of(text)).cast("long")) \
        .withColumn("n_tokens", n_tokens(text_of(text))) \
        .withColumn("over_limit", F.col("n_tokens") > limit)
