"""Periodic runs of words: maximal stretches that repeat with a period, found by suffix trees.

1. **Stretches.**  A run of period q and length of at least max(24, 3 q) holds every stretch of ``GRAM`` of its
   words twice, q words apart.  Words are hashed for whole batches of texts at once, and the stretches that are
   covered by repeated grams are the only places where runs can be; a run lies within one of them.
2. **Trees.**  For such a stretch and its reversal Ukkonen's algorithm builds a suffix tree each.  An Euler tour of
   the tree with a table of minima gives the longest common extension of any two places in constant time: to the right
   by the tree of the stretch, to the left by that of its reversal.
3. **Roots.**  Suffix ranks under an order of words and under the opposite order give the longest Lyndon word that starts at
   each place.  Every run has a root among these, so each is extended to both sides, and those that repeat are the runs.

Equality of words is decided on the words themselves; hashes only choose stretches, and equal words hash equally.  A stretch
is handled whole, whatever its length; memory grows in proportion to the longest one.

Defined cases: null and empty texts have no words and no runs, and collapse to the empty text; other columns of
the input do not matter; a null id gives a null id; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import bind
from jobloom.llm.common import chunks, mix, word_hashes

GRAM = 16       # a run of at least LEAST words and three periods agrees with itself, a period on, over this many
LEAST = 24
TIMES = 3
WORD_GAP = r"[\x20\x09-\x0D]+"
_ODD = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]   # start, length, period


# ---- suffix trees -----------------------------------------------------------------------

class SuffixTree:
    """Ukkonen's tree of a sequence of small numbers, with longest common prefixes of its suffixes."""

    def __init__(self, symbols: list[int]):
        self.n = len(symbols)
        self._build([*symbols, max(symbols, default=0) + 1])

    def _build(self, text: list[int]) -> None:
        size = len(text)
        width = max(text) + 1
        start, end, link, leaf_of = [0], [0], [0], [-1]
        child: dict[int, int] = {}   # node * width + first symbol -> node
        node = edge = length = open_suffixes = 0
        for i, c in enumerate(text):
            open_suffixes += 1
            waiting = 0              # an inner node whose suffix link is to be set
            while open_suffixes:
                if not length:
                    edge = i
                key = node * width + text[edge]
                at = child.get(key)
                if at is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(size)
                    link.append(0)
                    leaf_of.append(i - open_suffixes + 1)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    a = start[at]
                    e = end[at]
                    span = (e if e <= i else i + 1) - a
                    if length >= span:
                        edge += span
                        length -= span
                        node = at
                        continue
                    if text[a + length] == c:
                        if waiting and node:
                            link[waiting] = node
                        length += 1
                        break
                    inner = len(start)
                    child[key] = inner
                    start.append(a)
                    end.append(a + length)
                    link.append(0)
                    leaf_of.append(-1)
                    start[at] = a + length
                    child[inner * width + text[a + length]] = at
                    child[inner * width + c] = inner + 1
                    start.append(i)
                    end.append(size)
                    link.append(0)
                    leaf_of.append(i - open_suffixes + 1)
                    if waiting:
                        link[waiting] = inner
                    waiting = inner
                open_suffixes -= 1
                if not node and length:
                    length -= 1
                    edge = i - open_suffixes + 1
                else:
                    node = link[node]
        keys = np.fromiter(child.keys(), np.int64, len(child))
        nodes = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)   # by parent, then by first symbol
        self._children = nodes[order]
        parents = keys[order] // width
        self._first = np.searchsorted(parents, np.arange(len(start) + 1))
        self._span = np.array(end) - np.array(start)
        self._leaf_of = np.array(leaf_of)

    def tour(self) -> None:
        """The Euler tour with its table of minima, and the leaves in the order of the tour."""
        first, children, span, leaf_of = (x.tolist() for x in (self._first, self._children, self._span, self._leaf_of))
        depths, seen, leaves = [], [0] * (self.n + 1), []
        depth_of = [0] * len(span)
        stack = [0]
        while stack:
            at = stack.pop()
            if at < 0:             # back at a node after one of its children
                depths.append(depth_of[~at])
                continue
            depth = depth_of[at]
            suffix = leaf_of[at]
            if suffix >= 0:
                seen[suffix] = len(depths)
                leaves.append(suffix)
                depths.append(depth)
                continue
            depths.append(depth)
            for k in range(first[at + 1] - 1, first[at] - 1, -1):
                below = children[k]
                depth_of[below] = depth + span[below]
                stack.append(~at)
                stack.append(below)
        self._seen = np.array(seen)
        level = np.array(depths, dtype=np.int32)
        self._table = [level]
        while 2 ** len(self._table) <= len(level):
            half = 2 ** (len(self._table) - 1)
            self._table.append(np.minimum(self._table[-1][:-half], self._table[-1][half:]))
        #: rank of each suffix, the end mark being the largest symbol
        self.rank = np.argsort(np.array(leaves))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols in which the suffixes from i and from j (different ones) agree at the start."""
        a, b = self._seen[i], self._seen[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level):
            of = level == k
            row = self._table[k]
            out[of] = np.minimum(row[a[of]], row[b[of] - 2 ** int(k) + 1])
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one whose suffix ranks lower, else the end."""
    out, open_ = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return out


def runs_of(symbols: list[int]) -> list[Run]:
    """All runs of a sequence: maximal stretches of smallest period q and a length of at least 2 q.

    The end mark counts as a symbol, so the opposite order of suffixes is the same order backwards.  The first root of a
    run ends before the run does, so places whose longest Lyndon word reaches the end need no extension.
    """
    n = len(symbols)
    if n < 2:
        return []
    right, left = SuffixTree(symbols), SuffixTree(symbols[::-1])
    right.tour()
    left.tour()
    found = []
    for rank in (right.rank, n - right.rank):
        j = np.array(_next_smaller(rank.tolist()))[:n]
        i = np.flatnonzero(j < n)
        j = j[i]
        ahead, behind = right.common(i, j), np.zeros(len(i), dtype=np.int64)
        inner = i > 0
        behind[inner] = left.common(n - i[inner], n - j[inner])
        whole = ahead + behind >= j - i
        found.append(np.stack([i - behind, j + ahead - i + behind, j - i], axis=1)[whole])
    return [tuple(r) for r in np.unique(np.concatenate(found), axis=0).tolist()]


# ---- texts ------------------------------------------------------------------------------

def _stretches(group: list[bytes]) -> list[tuple[int, int, int]]:
    """(text, first word, end) of the stretches of texts in which runs can be."""
    words, owner = word_hashes(group)
    if len(words) < LEAST:
        return []
    h, reach = words, 1
    while reach < GRAM:
        with np.errstate(over="ignore"):
            h = mix(h[:-reach] * _ODD + h[reach:])
        reach *= 2
    at = np.flatnonzero(owner[: len(h)] == owner[GRAM - 1:])
    with np.errstate(over="ignore"):
        key = mix(h[at] + owner[at].astype(np.uint64) * _ODD)   # grams of different texts never meet
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(again):
        return []
    this, next_ = at[order[again]], at[order[again + 1]]
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    marked = np.union1d(this, next_)
    edges[marked] += 1
    edges[marked + GRAM] -= 1
    inside = np.cumsum(edges)[:-1] > 0
    fresh = inside & ~(np.concatenate([[False], inside[:-1]]) & (owner == np.concatenate([[-1], owner[:-1]])))
    first = np.flatnonzero(fresh)
    size = np.bincount(np.cumsum(fresh)[inside] - 1, minlength=len(first))
    # a run has two grams one period apart, and at least three periods
    of, of_next = (np.searchsorted(first, x, side="right") - 1 for x in (this, next_))
    near = (of == of_next) & (TIMES * (next_ - this) <= size[of]) & (size[of] >= LEAST)
    begin = np.searchsorted(owner, np.arange(len(group)))
    return [(int(owner[first[k]]), int(first[k] - begin[owner[first[k]]]), int(first[k] - begin[owner[first[k]]] + size[k]))
            for k in np.unique(of[near])]


def _runs_within(words: list[bytes], first: int, end: int) -> list[Run]:
    number: dict[bytes, int] = {}
    symbols = [number.setdefault(w, len(number)) for w in words[first:end]]
    return [(first + a, size, q) for a, size, q in runs_of(symbols) if size >= max(LEAST, TIMES * q)]


def _collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    stays = np.ones(len(words), dtype=bool)
    for start, size, period in runs:
        stays[start + period: start + size] = False
    return [words[i] for i in np.flatnonzero(stays)]


_FOUND = ("_key long, n_words long, n_runs long, start long, length long, period long, "
          "runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys, texts = pdf["_key"].tolist(), pdf["_text"].tolist()
        for begin, group in chunks(texts):
            places: dict[int, list[tuple[int, int]]] = {}
            for text, first, end in _stretches(group):
                places.setdefault(text, []).append((first, end))
            rows = []
            for i, data in enumerate(group):
                words = data.split()   # of bytes: at the six ASCII white spaces
                runs = sorted({r for first, end in places.get(i, ()) for r in _runs_within(words, first, end)})
                runs.sort(key=lambda r: (r[0], r[2]))
                best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
                kept = _collapsed(words, runs) if runs else words
                key = keys[begin + i]
                rows.append((None if pd.isna(key) else int(key), len(words), len(runs), *best,
                             [{"start": a, "length": n, "period": q} for a, n, q in runs], b" ".join(kept).decode("utf-8")))
            out = pd.DataFrame(rows, columns="_key n_words n_runs start length period runs collapsed".split())
            yield out.astype({c: "Int64" for c in ("_key", "start", "length", "period")})


def find_runs(df: DataFrame, text: str | Column = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: ``_key``, ``n_words``, ``n_runs``, the run of the greatest exponent (``start``,
    ``length``, ``period``; ties by start, then period; null without runs), all ``runs`` by start and period, and
    ``collapsed``, the words that stay when every run keeps its first period only, joined by one blank."""
    text = F.col(text) if isinstance(text, str) else text
    return df.select(F.col(key).cast("long").alias("_key"), F.coalesce(text, F.lit("")).alias("_text")).mapInPandas(_rows, _FOUND)


def repeated(text: Column, first: Column, period: Column) -> Column:
    """A text in whose words the ``period`` words from number ``first`` on repeat to the end.

    Both numbers may use ``words_in`` of the text; they and the words are evaluated once a row.
    """
    def turned(p: Column) -> Column:
        at = lambda i: F.when(i < p["first"], i).otherwise(p["first"] + F.pmod(i - p["first"], p["period"]))
        return F.array_join(F.transform(p["words"], lambda _, i: F.get(p["words"], at(i).cast("int"))), " ")

    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    return bind(F.struct(words.alias("words"), first.alias("first"), period.alias("period")), turned)


def words_in(text: Column) -> Column:
    """How many words a text has."""
    return F.size(F.filter(F.split(text, WORD_GAP), lambda w: w != ""))
