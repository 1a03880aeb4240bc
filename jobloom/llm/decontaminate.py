"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

1. The words of the test items are a query set.  It is taken in blocks of bounded size, so one block can be
   sent to every task whatever the benchmark grows to; each block is held against all documents.
2. Every word n-gram of an item is a seed, however often the documents hold it: in an edited copy any of them
   may be all that is left.  An item that shares a seed with a document is dropped again only where the
   alignment cannot reach ``least``: at least that share of the item's words has to stand in the document,
   and in a stretch of it no longer than an alignment with so few gaps can be.
3. Seeds of one item on nearby diagonals make a candidate passage, which is aligned with the item by
   Smith-Waterman over words (match +2, mismatch and gap -1).  A document and an item are reported when the
   alignment reaches ``LEAST`` of the item's own score, which exact, edited and partly reordered copies do.
   A copy in which no three words in a row are left has no seed and is not seen.

Words are runs of letters, digits and non-ASCII characters in lower case, so punctuation and line
breaks do not matter.

Defined cases: null counts as empty; items of fewer than ``ITEM_WORDS`` words are too short to tell and
match nothing; equal items are all reported; a null item or document id is reported as null; a document
with several passages of one item is reported once, with the best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import chunks, free_name, gram_hashes, text_of, word_hashes
from jobloom.session import saved

GRAM = 3
LEAST = 0.5
ITEM_WORDS = 8
BLOCK_CHARS = 4_000_000   # of items sent to tasks at once
CELLS = 1_000_000         # of the rows that one numpy call aligns
HIT_ROWS = 1_000_000      # of seeds met in a document, handled at once
MATCH, MISMATCH, GAP = 2, -1, -1
HITS = "_key long, _item long, score double, first_word long, last_word long"


@dataclass(frozen=True)
class Block:
    """The words of some items, and their n-grams as seeds, sorted by n-gram."""

    ids: list[int | None]
    words: list[np.ndarray]
    grams: np.ndarray        # different n-gram hashes
    first: np.ndarray        # row of the first place of each
    item: np.ndarray         # rows: an item and a place in it
    place: np.ndarray
    vocabulary: np.ndarray   # different words
    spelled: np.ndarray      # index in the vocabulary of each word of all items
    begin: np.ndarray        # of each item in ``spelled``, and the end

    @staticmethod
    def of(items: list[tuple[int | None, str]]) -> Block:
        ids, words = [], []
        for start, group in chunks([t for _, t in items]):
            w, own = word_hashes(group, "letters")
            cut = np.searchsorted(own, np.arange(1, len(group)))
            for i, part in enumerate(np.split(w, cut)):
                if len(part) >= ITEM_WORDS:
                    ids.append(items[start + i][0])
                    words.append(part)
        every = np.concatenate([np.empty(0, np.uint64), *words])
        begin = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        gram, item, place = gram_hashes(every, np.repeat(np.arange(len(words)), np.diff(begin)), GRAM, len(words), short=False)
        order = np.argsort(gram, kind="stable")
        grams, first = np.unique(gram[order], return_index=True)
        vocabulary, spelled = np.unique(every, return_inverse=True)
        return Block(ids, words, grams, np.append(first, len(gram)), item[order], (place - begin[item])[order],
                     vocabulary, spelled, begin)

    def likely(self, candidates: np.ndarray, text: np.ndarray, least: float) -> np.ndarray:
        """Those of the items whose words stand in the text to at least the share ``least``."""
        has = np.zeros(len(self.vocabulary), dtype=bool)
        met = _lookup(self.vocabulary, text)
        has[met[met >= 0]] = True
        length = np.diff(self.begin)[candidates]
        start = np.cumsum(length) - length
        at = np.arange(length.sum()) + np.repeat(self.begin[candidates] - start, length)
        return candidates[np.add.reduceat(has[self.spelled[at]], start, dtype=np.int64) / length >= least]

    def hits(self, grams: np.ndarray, at: np.ndarray, text: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, place, place in the text) of the seeds met in a text, ``HIT_ROWS`` or one item at a time.

        ``grams``: indices of the n-grams met, ``at``: where.
        """
        order = np.argsort(grams, kind="stable")
        at = at[order]
        gram, begin, often = np.unique(grams[order], return_index=True, return_counts=True)
        times = self.first[gram + 1] - self.first[gram]
        row = np.arange(times.sum()) + np.repeat(self.first[gram] - (np.cumsum(times) - times), times)
        begin, often = np.repeat(begin, times), np.repeat(often, times)
        good = np.isin(self.item[row], self.likely(np.unique(self.item[row]), text, least))
        row, begin, often = row[good], begin[good], often[good]
        order = np.argsort(self.item[row], kind="stable")
        row, begin, often = row[order], begin[order], often[order]
        if not len(row):
            return
        ends = np.append(np.flatnonzero(np.diff(self.item[row])) + 1, len(row))   # of the items
        total = np.cumsum(often)
        done = 0
        while done < len(row):
            fits = np.searchsorted(total[ends - 1], (total[done - 1] if done else 0) + HIT_ROWS, side="right")
            upto = ends[max(fits - 1, np.searchsorted(ends, done, side="right"))]
            n = often[done:upto]
            of = np.repeat(row[done:upto], n)
            where = np.repeat(begin[done:upto] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield self.item[of], self.place[of], at[where]
            done = upto


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(score, last word of the passage) of the best local alignment of each (item, passage).

    All pairs of a batch go through the rows of their matrices together; a gap along a row is a running
    maximum of the scores freed of its slope.
    """
    scores, last = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    while order:
        size = 1
        while size < len(order) and (size + 1) * len(pairs[order[size]][1]) <= CELLS:
            size += 1
        batch, order = order[:size], order[size:]
        high, width = (max(len(pairs[i][k]) for i in batch) for k in (0, 1))
        x, y = np.zeros((size, high), np.uint64), np.ones((size, width), np.uint64)
        for k, i in enumerate(batch):     # words are made even, so that the filling never matches
            x[k, : len(pairs[i][0])] = pairs[i][0] << np.uint64(2) | np.uint64(2)
            y[k, : len(pairs[i][1])] = pairs[i][1] << np.uint64(2) | np.uint64(2)
        slope = np.arange(width, dtype=np.int32) * -GAP
        row, best, end = np.zeros((size, width), np.int32), np.zeros(size, np.int32), np.zeros(size, np.int64)
        for k in range(high):
            step = np.where(x[:, k: k + 1] == y, MATCH, MISMATCH).astype(np.int32)
            step[:, 1:] += row[:, :-1]
            np.maximum(step, row + GAP, out=step)
            row = np.maximum(np.maximum.accumulate(step + slope, axis=1) - slope, 0)
            top = row.argmax(axis=1)
            value = row[np.arange(size), top]
            end[value > best] = top[value > best]
            np.maximum(best, value, out=best)
        scores[batch], last[batch] = best, end
    return scores, last


def _passages(words: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], block: Block,
              least: float) -> Iterator[tuple[int, int, int]]:
    """(item, first, last + 1 word) of the passages of one document worth aligning.

    ``found``: item, place in the item and place in the document of each seed met.
    """
    item, place, at = found
    order = np.lexsort((at, at - place, item))
    item, place, at = item[order], place[order], at[order]
    for mine in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
        i = int(item[mine[0]])
        shift = (at - place)[mine]
        length = len(block.words[i])
        slack = max(4, length // 2)
        # passages whose begin differs by more than the item's length are apart
        for part in np.split(shift, np.flatnonzero(np.diff(shift) > slack) + 1):
            low = max(0, int(part[0]) - slack)
            high = min(len(words), int(part[-1]) + length + slack)
            for a, b in _dense(words[low:high], block.words[i], least):
                yield i, low + a, low + b


def _dense(passage: np.ndarray, item: np.ndarray, least: float) -> list[tuple[int, int]]:
    """The parts of a passage in which an alignment can reach ``least``.

    It matches that share of the item's words, and each gap takes 1 of the 2 a match gives, so the share left
    bounds the gaps and with them the length of the stretch.
    """
    inside = np.isin(passage, item)
    width = min(len(passage), len(item) + int(2 * (1 - least) * len(item)) + 1)
    sums = np.concatenate([[0], np.cumsum(inside)])
    good = np.flatnonzero((sums[width:] - sums[:-width]) / len(item) >= least)      # begins of such stretches
    parts = np.split(good, np.flatnonzero(np.diff(good) > width) + 1) if len(good) else []
    ranges = [(int(p[0]), int(p[-1]) + width) for p in parts]
    return [(a, b) for a, b in ranges if np.isin(item, passage[a:b]).mean() >= least]


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id",
                       item_text: str = "text", item_key: str = "item_id", least: float = LEAST) -> DataFrame:
    """(``_key``, ``_item``, score, first_word, last_word) of every document and item that match.

    ``score`` is the alignment's share of the item's own; the words are those of the document's passage.
    """
    docs = docs.select(F.col(key).cast("long").alias("_key"), F.lower(text_of(text)).alias("_text"))
    items = items.select(F.col(item_key).cast("long").alias("_item"), F.lower(text_of(item_text)).alias("_text"))
    sizes = items.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-sizes // BLOCK_CHARS))
    result = None
    for number in range(blocks):
        part = items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == number)
        hits = _block_hits(docs, Block.of(sorted(((r["_item"], r["_text"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0], x[1]))), least)
        result = hits if result is None else result.unionByName(hits)
    best = F.max(F.struct("score", "first_word", "last_word")).alias("best")
    return result.groupBy("_key", "_item").agg(best).select("_key", "_item", "best.*")


def _block_hits(docs: DataFrame, block: Block, least: float) -> DataFrame:
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(block)     # of at most BLOCK_CHARS of text

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = shared.value
        for pdf in batches:
            keys, jobs, where = pdf["_key"].tolist(), [], []
            for start, group in chunks(pdf["_text"].tolist()):
                words, owner = word_hashes(group, "letters")
                g, own, at = gram_hashes(words, owner, GRAM, len(group), short=False)
                which = _lookup(items.grams, g)
                met = np.flatnonzero(which >= 0)
                begin = np.searchsorted(owner, np.arange(len(group) + 1))
                for mine in np.split(met, np.flatnonzero(np.diff(own[met])) + 1) if len(met) else []:
                    d = int(own[mine[0]])
                    text_words = words[begin[d]: begin[d + 1]]
                    for found in items.hits(which[mine], at[mine] - begin[d], text_words, least):
                        for i, low, high in _passages(text_words, found, items, least):
                            jobs.append((items.words[i], text_words[low:high]))
                            where.append((keys[start + d], i, low))
            score, last = align(jobs)
            share = score / np.array([MATCH * len(a) for a, _ in jobs] or [1])
            good = np.flatnonzero(share >= least).tolist() if jobs else []
            # the alignment of the reversed words ends where the passage begins
            back = align([(jobs[i][0][::-1], jobs[i][1][last[i]::-1]) for i in good])[1]
            found = [(where[i][0], items.ids[where[i][1]], float(share[i]), int(where[i][2] + last[i] - b), int(where[i][2] + last[i]))
                     for i, b in zip(good, back)]
            out = pd.DataFrame(found, columns=["_key", "_item", "score", "first_word", "last_word"])
            yield out.astype({"_key": "Int64", "_item": "Int64"})

    return docs.mapInPandas(match, HITS)


def _lookup(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def decontaminate(df: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **named: object) -> DataFrame:
    """The rows of ``df`` that match no item.  A row is judged by its own text, whatever id it has or shares."""
    print_, name = free_name(df, "_print"), free_name(df, "_hit")
    rows = df.withColumn(print_, F.xxhash64(text_of(text)))
    hits = saved(find_contamination(rows, items, text, print_, **named).select(F.col("_key").alias(name)).distinct())
    small = F.broadcast(hits) if hits.count() <= 1_000_000 else hits
    return rows.join(small, F.col(print_) == F.col(name), "left_anti").drop(print_)
