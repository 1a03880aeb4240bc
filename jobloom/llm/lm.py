"""Language-model scoring by cross-entropy difference.

A target model and a background model are n-gram models of the same order over one vocabulary: all
characters of all documents (lower case, white space as one blank), one symbol for characters that the models
have not seen and one for the ends of a text.  The background counts every n-gram of all documents, the target
those of the documents labelled as good.  Background counts are scaled to the target's total, so both models are
smoothed alike.  A document's score is the mean over its tokens of target loss less background loss, in nats:
below 0 it is more like the target.

What is counted are all n-grams of all texts, and the tables of those that occur go to the tasks.  N-grams of the
``SYMBOLS`` commonest symbols are looked up by place, all others in sorted tables; that is a matter of speed only.

Defined cases: null counts as empty; an empty text still ends, so it has one token; without target
documents both models are the same and every score is 0; repeated rows count as often as they occur;
of several labels of one document the largest counts; a character past the ``LIMIT`` commonest is two tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import free_name, text_of

SYMBOLS = 48        # symbols of which n-grams have a fixed place
ORDER = 4
LIMIT = 50_000      # characters of one symbol each, so that an n-gram is one number
OTHER, END = SYMBOLS - 2, SYMBOLS - 1
POINTS = 0x110000
PIECE_CHARS = 1_000_000
BROADCAST_ROWS = 1_000_000


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``PIECE_CHARS`` characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > PIECE_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if len(texts) > start:
        yield start, len(texts)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def symbol_counts(docs: DataFrame) -> DataFrame:
    """(point, n) of the characters of ``_text``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(POINTS, dtype=np.int64)
        for pdf in batches:
            texts = pdf["_text"].tolist()
            for a, b in _pieces(texts):
                total += np.bincount(_points("".join(texts[a:b])), minlength=POINTS)
        total[32] += total[9:14].sum()
        total[9:14] = 0
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"point": seen, "n": total[seen]})

    return docs.select("_text").mapInPandas(run, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))


def symbol_table(points: list[int]) -> np.ndarray:
    """Symbol of each code point, given those that occur with the commonest first."""
    out = np.full(POINTS, OTHER, dtype=np.int64)
    rank = np.arange(len(points))
    out[points] = np.where(rank < OTHER, rank, rank + SYMBOLS - OTHER)
    out[9:14] = out[32]          # white space is one symbol
    return out


def vocabulary(points: int) -> int:
    """Size of the vocabulary for so many different characters."""
    ids = points + SYMBOLS - OTHER
    return max(SYMBOLS, ids if ids <= LIMIT else LIMIT + -(-(ids - LIMIT) // LIMIT))


def _coded(text: str, symbols: np.ndarray) -> np.ndarray:
    """The symbols of a text; those past ``LIMIT`` are written as two."""
    s = symbols[_points(text)]
    wide = s >= LIMIT
    if wide.any():
        over = s[wide] - LIMIT
        s = np.repeat(s, 1 + wide)
        second = np.flatnonzero(wide) + np.arange(1, len(over) + 1)
        s[second - 1], s[second] = LIMIT + over // LIMIT, over % LIMIT
    return s


def grams(texts: list[str], symbols: np.ndarray, base: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, rare, numbers, tokens of each text) of the n-grams of all texts in order.  Texts begin after ends.

    An n-gram's number is in the given base, its place that in base ``SYMBOLS``; ``rare`` is where a symbol has no place
    and ``numbers`` belongs to these.
    """
    begin = np.full(ORDER - 1, END)
    parts, lengths = [], []
    for t in texts:
        s = _coded(t, symbols)
        parts += [begin, s, [END]]
        lengths.append(len(s) + 1)
    flat = np.concatenate(parts).astype(np.int64)
    lengths = np.array(lengths)
    start = np.cumsum(lengths + ORDER - 1) - lengths
    keep = np.arange(lengths.sum()) + np.repeat(start - (np.cumsum(lengths) - lengths), lengths)   # where tokens are
    number = np.zeros(len(flat), dtype=np.int64)
    for k in range(ORDER):                 # the token itself is the last digit
        number[ORDER - 1:] += flat[k: len(flat) - ORDER + 1 + k] * SYMBOLS ** (ORDER - 1 - k)
    number = number[keep]
    far, rare = flat >= SYMBOLS, np.zeros(len(flat), dtype=bool)
    for k in range(ORDER) if far.any() else ():
        rare[ORDER - 1:] |= far[k: len(flat) - ORDER + 1 + k]
    rare = np.flatnonzero(rare[keep])
    at = keep[rare]
    numbers = sum(flat[at - k] * base ** k for k in range(ORDER))
    return number, rare, numbers, lengths


def rebased(place: np.ndarray, base: int) -> np.ndarray:
    """Numbers of n-grams in the given base, from their places."""
    return sum(place // SYMBOLS ** k % SYMBOLS * base ** k for k in range(ORDER))


def _summed(gram: np.ndarray, *count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams and the sums of their counts."""
    found, at = np.unique(gram, return_inverse=True)
    return found, np.stack([np.bincount(at, c, len(found)) for c in count])


def gram_counts(docs: DataFrame, symbols: np.ndarray, base: int = SYMBOLS) -> DataFrame:
    """(gram, target, background) over documents with ``_text`` and the flag ``_target``."""
    shared = docs.sparkSession.sparkContext.broadcast(symbols)   # one number for each code point

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros((2, SYMBOLS ** ORDER), dtype=np.int32)
        others, waiting = (np.zeros(0, np.int64), np.zeros((2, 0))), []

        def gathered() -> tuple[np.ndarray, np.ndarray]:
            many = [(others[0], *others[1]), *waiting]
            return _summed(*(np.concatenate(x) for x in zip(*many)))

        for pdf in batches:
            for flag in (False, True):
                texts = pdf.loc[pdf["_target"] == flag, "_text"].tolist()
                for a, b in _pieces(texts):
                    place, rare, numbers, _ = grams(texts[a:b], shared.value, base)
                    np.add.at(count[int(flag)], np.delete(place, rare), 1)
                    found, n = np.unique(numbers, return_counts=True)
                    waiting.append((found, n * (not flag), n * flag))
            if sum(len(x[0]) for x in waiting) > PIECE_CHARS + len(others[0]):
                others, waiting = gathered(), []
        others = gathered()
        seen = np.flatnonzero(count.any(axis=0))
        gram = np.append(rebased(seen, base), others[0])
        other, target = (np.append(c[seen], o).astype(np.int64) for c, o in zip(count, others[1]))
        yield pd.DataFrame({"gram": gram, "target": target, "background": target + other})

    return docs.select("_text", "_target").mapInPandas(run, "gram long, target long, background long") \
        .groupBy("gram").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


@dataclass(frozen=True)
class Level:
    """N-grams of one order in sorted order with their probabilities in both models; contexts with the share they leave
    to the next lower order."""

    gram: np.ndarray
    p: np.ndarray
    context: np.ndarray
    rest: np.ndarray


def levels(gram: np.ndarray, count: np.ndarray, base: int) -> list[Level]:
    """From order 1 up: each order is smoothed with the next lower one, by as much as its context has different
    continuations.  ``gram`` is sorted, ``count`` has a row for each model."""
    tables = [(gram, count)]
    for k in range(ORDER - 1, 0, -1):
        tables.append(_summed(tables[-1][0] % base ** k, *tables[-1][1]))
    out = []
    for k, (g, c) in enumerate(reversed(tables)):
        context, at = np.unique(g // base, return_inverse=True)
        total = np.stack([np.bincount(at, x, len(context)) for x in c])
        kinds = np.stack([np.maximum(np.bincount(at, x > 0, len(context)), 1) for x in c])
        lower = out[-1].p[:, np.searchsorted(out[-1].gram, g % base ** k)] if out else 1 / base
        rest = kinds / (total + kinds)
        out.append(Level(g, (c + kinds[:, at] * lower) / (total + kinds)[:, at], context, rest))
    return out


def losses(count: np.ndarray) -> np.ndarray:
    """Loss of the last symbol of every n-gram of the ``SYMBOLS`` symbols, by place."""
    return -np.log(levels(np.arange(len(count)), count[None].astype(np.float64), SYMBOLS)[-1].p[0])


@dataclass(frozen=True)
class Models:
    symbols: np.ndarray
    base: int
    levels: list[Level]
    placed: np.ndarray      # losses in both models by place, NaN for n-grams that were not seen

    def losses_of(self, numbers: np.ndarray) -> np.ndarray:
        """Losses of n-grams in both models; what was not seen takes its context's share of the next lower order."""
        p, left, g = np.ones((2, len(numbers))), np.arange(len(numbers)), numbers

        def found(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(table, values), max(len(table) - 1, 0))
            return at, table[at] == values if len(table) else np.zeros(len(values), dtype=bool)

        for k, level in zip(range(ORDER - 1, -1, -1), reversed(self.levels)):
            at, hit = found(level.gram, g)
            p[:, left[hit]] *= level.p[:, at[hit]]
            left, g = left[~hit], g[~hit]
            at, hit = found(level.context, g // self.base)
            p[:, left[hit]] *= level.rest[:, at[hit]]
            g = g % self.base ** k
        p[:, left] /= self.base
        return -np.log(p)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Models:
    """Both models, from all documents and from those whose label is 1."""
    good = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_good")).agg(F.max(label).alias("_l")) \
        .where("_l = 1").select("_good")
    good = F.broadcast(good) if labels.count() <= BROADCAST_ROWS else good
    rows = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text")) \
        .join(good, F.col("_key") == F.col("_good"), "left").select("_text", F.col("_good").isNotNull().alias("_target"))
    every = symbol_counts(docs.select(text_of(text).alias("_text"))).orderBy(F.desc("n"), "point")   # at most all of Unicode
    points = [r["point"] for r in every.collect()]
    symbols, base = symbol_table(points), vocabulary(len(points))
    counted = gram_counts(rows, symbols, base).toArrow().sort_by("gram")
    gram, target, background = (counted[c].to_numpy() for c in ("gram", "target", "background"))
    count = np.stack([target if target.any() else background, background]).astype(np.float64)
    if target.any():
        count[1] *= count[0].sum() / count[1].sum()
    found = levels(gram, count, base)
    placed = np.full((2, SYMBOLS ** ORDER), np.nan, dtype=np.float32)
    place = sum(gram // base ** k % base * SYMBOLS ** k for k in range(ORDER))
    near = np.all([gram // base ** k % base < SYMBOLS for k in range(ORDER)], axis=0)
    placed[:, place[near]] = -np.log(found[-1].p[:, near])
    return Models(symbols, base, found, placed)


def score_documents(df: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """The rows of ``df`` with ``n_tokens``, ``target_loss``, ``background_loss`` and ``score``."""
    shared = df.sparkSession.sparkContext.broadcast(models)      # all n-grams that occur

    @F.pandas_udf("n_tokens long, target_loss double, background_loss double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            texts, out = batch.tolist(), []
            for a, b in _pieces(texts):
                place, rare, numbers, n = grams(texts[a:b], m.symbols, m.base)
                place[rare] = 0
                loss = m.placed[:, place].astype(np.float64)
                loss[:, rare] = m.losses_of(numbers)
                new = np.flatnonzero(np.isnan(loss[0]))
                loss[:, new] = m.losses_of(rebased(place[new], m.base))
                first = np.cumsum(n) - n
                out.append(pd.DataFrame({"n_tokens": n} | {
                    f"{k}_loss": np.add.reduceat(row, first) / n for k, row in zip(("target", "background"), loss)}))
            yield pd.concat(out) if out else pd.DataFrame({"n_tokens": [], "target_loss": [], "background_loss": []})

    scored = free_name(df, "_scored")
    out = df.withColumn(scored, score(text_of(text)))
    for name in ("n_tokens", "target_loss", "background_loss"):
        out = out.withColumn(name, F.col(f"{scored}.{name}"))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss")).drop(scored)
