"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its character n-grams (lower case, hashed).  On labelled texts, the log of the
ratio of an n-gram's share among toxic and among clean texts scales the n-gram; a logistic regression
learns one weight for each on top of that.  Scoring is one pass over the documents.

The fit uses a bounded sample of labelled rows (``SAMPLE_ROWS`` of either class, those of the smallest
seeded hash of the id) in one task.  Scores of all documents are made where the documents are.

Defined cases: null counts as empty, an empty text scores by its padding alone; labels that are null, or
belong to no document, are left out; of several labels of one document the largest counts; without
labels of both classes every score is the share of toxic ones (0 without any label).  Columns of the
input with the name of a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import text_of

BITS = 18                 # of the hashed n-gram space
ORDERS = (3, 4, 5)
SAMPLE_ROWS = 3_000       # labelled rows of either class that the fit sees at most
EPOCHS = 10
STEP = 1.0
SEED = 17
FOLDS = 5


class GramSet:
    """Hashed character n-grams of a text, each once."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BITS, dtype=bool)

    def of(self, text: str) -> np.ndarray:
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for n in ORDERS:
            if len(points) >= n:
                h = np.zeros(len(points) - n + 1, dtype=np.uint32)
                for k in range(n):
                    h = (h ^ points[k: k + len(h)]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA6B)
                self.seen[h >> np.uint32(32 - BITS)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found.astype(np.int32)


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray    # of each n-gram, its ratio included
    bias: float

    def scores(self, texts: Iterator[str], grams: GramSet) -> np.ndarray:
        z = np.array([self.weights[grams.of(t)].sum(dtype=np.float64) for t in texts], dtype=np.float64) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(sets: list[np.ndarray], toxic: np.ndarray, share: float) -> Classifier:
    """Fits a classifier to n-gram sets; ``share`` is that of toxic texts among all labelled ones."""
    size = 1 << BITS
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if not len(sets) or toxic.min() == toxic.max():
        return Classifier(np.zeros(size, np.float32), prior)
    count = np.zeros((2, size), dtype=np.int64)
    for s, y in zip(sets, toxic.tolist()):
        count[y, s] += 1
    texts = np.bincount(toxic, minlength=2)
    ratio = np.log((count[1] + 1) / (texts[1] + 2)) - np.log((count[0] + 1) / (texts[0] + 2))
    ratio[count[0] + count[1] < 2] = 0          # seen in one text only
    ratio /= np.sqrt(np.mean([np.sum(ratio[s] ** 2) for s in sets]) or 1.0)
    balance = len(toxic) / 2 / texts            # both classes weigh the same
    weights, bias, rng = np.zeros(size), 0.0, np.random.default_rng(SEED)
    for epoch in range(EPOCHS):
        step = STEP / (1 + epoch)
        for i in rng.permutation(len(sets)):
            s, y = sets[i], int(toxic[i])
            z = float(weights[s] @ ratio[s]) + bias
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance[y]
            weights[s] -= step * error * ratio[s]
            bias -= 0.1 * step * error
    return Classifier((weights * ratio).astype(np.float32), bias)


def held_out(key: str = "doc_id") -> Column:
    """Rows that labels are not learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
          label: str = "toxic", rows: int = SAMPLE_ROWS) -> Classifier:
    """Fits the classifier to at most ``rows`` labelled documents of either class outside the held-out fold."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)) \
        .groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_toxic"))
    counts = {r["_toxic"]: r["count"] for r in usable.groupBy("_toxic").count().collect()}
    if not counts:
        return Classifier(np.zeros(1 << BITS, np.float32), -30.0)
    sample = None
    for value in (0, 1):
        some = usable.where(F.col("_toxic") == value).orderBy(F.xxhash64("_key", F.lit(SEED)), "_key").limit(rows)
        sample = some if sample is None else sample.unionByName(some)

    def grams_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = GramSet()
        for pdf in batches:
            yield pd.DataFrame({"_key": pdf["_key"], "_toxic": pdf["_toxic"], "grams": [grams.of(t).tobytes() for t in pdf["_text"]]})

    # the sample's size is bounded by ``rows``
    chosen = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text")).join(F.broadcast(sample), "_key") \
        .mapInPandas(grams_of, "_key long, _toxic int, grams binary")
    share = counts.get(1, 0) / sum(counts.values())

    def fit_all(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", "grams"])
        model = fit([np.frombuffer(g, dtype=np.int32) for g in pdf["grams"]], pdf["_toxic"].to_numpy(np.int64), share)
        return pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    # one task fits the sample; only the weights come to the driver
    fitted = chosen.groupBy().applyInPandas(fit_all, "weights binary, bias double").first()
    if fitted is None:
        return fit([], np.empty(0, np.int64), share)
    return Classifier(np.frombuffer(fitted["weights"], dtype=np.float32), fitted["bias"])


def score_toxicity(df: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """The rows of ``df`` with ``score`` (0 to 1) and ``predicted``."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed size

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams = GramSet()
        for batch in batches:
            yield pd.Series(shared.value.scores(batch, grams))

    return df.withColumn("score", score(text_of(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
