"""Similarity of short texts: trigrams, token overlap, character ratio and their mix."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from jobloom.functions.text import WORD, bind, col, is_unstated, normalize_text
from jobloom.operators.matching import matched_of, with_ratios
from jobloom.session import picked, saved


# ---- trigrams ---------------------------------------------------------------------------

def trigrams(c: str | Column) -> Column:
    """Distinct trigrams of every word, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(F.array_distinct(words), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    per_word = F.transform(padded, lambda p: F.transform(
        F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(per_word))


def set_overlap(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays of distinct values; 0 when both are empty."""
    def share(p: Column) -> Column:
        return bind(F.size(F.array_intersect(p["a"], p["b"])), lambda shared: F.when(
            F.size(p["a"]) + F.size(p["b"]) > 0, shared / (F.size(p["a"]) + F.size(p["b"]) - shared)).otherwise(0.0))

    return bind(F.struct(a.alias("a"), b.alias("b")), share)


def trigram_list(text: str) -> list[str]:
    """Trigrams of one search text, so they are built once and not per row."""
    words = "".join(ch if ch.isalnum() else " " for ch in (text or "").lower()).split()
    return list(dict.fromkeys(f"  {w} "[i:i + 3] for w in words for i in range(len(w) + 1)))


def padded_words(c: str | Column) -> Column:
    """The words of a text with blanks around them.  Of the trigrams of this text, those of
    the words are exactly the ones that do not end in two blanks."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(words == "", "").otherwise(F.concat(F.lit("  "), F.replace(words, F.lit(" "), F.lit("   ")), F.lit(" ")))


def _packed_trigrams(padded: str) -> np.ndarray:
    """Sorted, distinct trigrams of ``padded_words``: three code points of 21 bits make one exact number."""
    x = np.frombuffer(padded.encode("utf-32-le"), np.uint32).astype(np.int64)
    of_word = (x[1:-1] != 32) | (x[2:] != 32)
    return np.unique((x[:-2] << 42 | x[1:-1] << 21 | x[2:])[of_word])


@F.pandas_udf(DoubleType())
def _trigram_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = _packed_trigrams(x), _packed_trigrams(y)
        shared = len(np.intersect1d(x, y, assume_unique=True))
        every = len(x) + len(y) - shared
        out.append(shared / every if every else 0.0)
    return pd.Series(out, dtype="float64")


def trigram_similarity(a: str | Column, b: str | Column) -> Column:
    """Shared over all trigrams of two texts, worked out as arrays of numbers; 0 when neither has any."""
    return _trigram_overlap(padded_words(a), padded_words(b))


def trigram_similarity_to(c: str | Column, text: str) -> Column:
    """Trigram similarity to one search text.

    Its trigrams are looked up in the padded words by plain substring tests; the column's
    own trigrams are counted only in rows that share at least one.
    """
    grams = trigram_list(text)
    if not grams:
        return F.lit(0.0)
    def shared(padded: Column) -> Column:
        hits = [F.contains(padded, F.lit(g)).cast("int") for g in grams]
        return sum(hits[1:], hits[0])

    def share(n: Column) -> Column:
        return F.when(n > 0, n / (F.size(trigrams(c)) + len(grams) - n)).otherwise(0.0)

    return bind(bind(padded_words(c), shared), share)


# ---- tokens and characters --------------------------------------------------------------

def tokens(normalized: str | Column) -> Column:
    return F.array_distinct(F.filter(F.split(col(normalized), " "), lambda w: w != ""))


def token_jaccard(a: str | Column, b: str | Column) -> Column:
    return set_overlap(tokens(a), tokens(b))


def _ratio(a: str, b: str) -> float:
    if a is None or b is None:
        return 0.0
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio; the order of the arguments matters."""
    return pd.Series([_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _ratios_at_least(a: pd.Series, b: pd.Series, threshold: pd.Series) -> list[float]:
    """The ratios that reach their ``threshold``, else -1; equal letters in any order bound a ratio from above."""
    out, asked = [-1.0] * len(a), []
    for k, (x, y, t) in enumerate(zip(a, b, threshold)):
        if x is not None and y is not None and 2.0 * sum((Counter(x) & Counter(y)).values()) / max(len(x) + len(y), 1) >= t:
            asked.append(k)
    found = matched_of([a.iloc[k] for k in asked], [b.iloc[k] for k in asked])
    for k, matched in zip(asked, found):
        x, y = a.iloc[k], b.iloc[k]
        # a pair with too many equal characters for arrays
        ratio = _ratio(x, y) if matched is None else 2.0 * matched / (len(x) + len(y))
        out[k] = ratio if ratio >= threshold.iloc[k] else -1.0
    return out


@F.pandas_udf(DoubleType())
def _seq_ratio_at_least(a: pd.Series, b: pd.Series, threshold: pd.Series) -> pd.Series:
    return pd.Series(_ratios_at_least(a, b, threshold), dtype="float64")


# Declared non-deterministic so that the planner neither repeats it nor moves it into a join.
seq_ratio_at_least = _seq_ratio_at_least.asNondeterministic()


def ratio_bound(a: str | Column, b: str | Column) -> Column:
    """No character ratio of two texts exceeds 2 * shorter / (sum of lengths)."""
    la, lb = F.length(col(a)), F.length(col(b))
    return F.when(la + lb > 0, 2.0 * F.least(la, lb) / (la + lb)).otherwise(1.0)


def similarity_normalized(a: str | Column, b: str | Column, use_characters: bool = True) -> Column:
    """The larger of token overlap and character ratio of texts that are normalised already; null if one
    is null.  For many pairs use ``with_similarities``, which computes the ratio in Spark as well."""
    a, b = col(a), col(b)
    if use_characters:
        needs = (a != b) & (a != "") & (b != "")
        measure = F.greatest(token_jaccard(a, b), seq_ratio(F.when(needs, a), F.when(needs, b)))
        return _edge_cases(a, b, measure)
    return bind(F.struct(a.alias("x"), b.alias("y")), lambda p: _edge_cases(p["x"], p["y"], token_jaccard(p["x"], p["y"])))


def _edge_cases(a: Column, b: Column, otherwise: Column) -> Column:
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).when(a.isNotNull() & b.isNotNull(), otherwise)


def with_similarities(rows: DataFrame, use_characters: bool = True, stored: bool = False, **compared: tuple[str, str]) -> DataFrame:
    """Rows with a similarity column for each named pair of columns of normalised texts; ``stored`` as for ``with_ratios``."""
    if not use_characters:
        return rows.withColumns({n: similarity_normalized(a, b, False) for n, (a, b) in compared.items()})
    plain = {f"_plain_{n}": _edge_cases(F.col(a), F.col(b), token_jaccard(a, b)) for n, (a, b) in compared.items()}
    out = with_ratios(rows.withColumns(plain), {f"_ratio_{n}": ab for n, ab in compared.items()}, stored)
    return out.withColumns({n: F.greatest(f"_plain_{n}", f"_ratio_{n}") for n in compared}).drop(
        *[f"{x}_{n}" for n in compared for x in ("_plain", "_ratio")])


def similarity(a: str | Column, b: str | Column, use_characters: bool = True) -> Column:
    return similarity_normalized(normalize_text(a), normalize_text(b), use_characters)


def reaches(a: str | Column, b: str | Column, threshold: float, use_characters: bool = True) -> Column:
    """similarity_normalized(a, b) >= threshold, with the ratio computed only where it can
    reach the threshold (lambdas stay out of its inputs: the planner cannot extract those)."""
    a, b = col(a), col(b)
    overlap = token_jaccard(a, b) >= threshold
    plain = _edge_cases_bool(a, b, threshold, overlap)
    if not use_characters:
        return plain
    needs = (a != b) & (a != "") & (b != "") & (ratio_bound(a, b) >= threshold)
    ratio = seq_ratio_at_least(F.when(needs, a), F.when(needs, b), F.lit(threshold))
    return plain | (ratio >= threshold)


def _edge_cases_bool(a: Column, b: Column, threshold: float, otherwise: Column) -> Column:
    one, zero = F.lit(1.0 >= threshold), F.lit(0.0 >= threshold)
    return F.when(a == b, one).when((a == "") | (b == ""), zero).otherwise(otherwise)


def field_similarity(a: str | Column, b: str | Column, use_characters: bool = True) -> Column:
    """Salary and level: both unstated 1.0, one unstated 0.5, else the text similarity."""
    ua, ub = is_unstated(a), is_unstated(b)
    return F.when(ua & ub, 1.0).when(ua | ub, 0.5).otherwise(similarity(a, b, use_characters))


def duplicate_scores(pairs: DataFrame, threshold: float = 0.9, use_characters: bool = True,
                     suffix: str = "_2", keep: Sequence[str] | None = None) -> DataFrame:
    """Add is_dup and the company, title, salary and level scores of pairs of postings, to the columns ``keep`` or to all.

    The incoming posting is in columns company_name, job_title, salary and level, the
    candidate in the same names with ``suffix``.  Scores behind a failed gate are 0.0: later
    similarities are found only for pairs that passed.  Pairs are written once, and each step takes its own
    columns of them, so that titles cross a shuffle only where their ratio is asked for.
    """
    normalized = {f"_{c}{x}": normalize_text(c + x) for c in ("company_name", "job_title", "salary", "level") for x in ("", suffix)}
    for c in ("salary", "level"):
        ua, ub = is_unstated(c), is_unstated(c + suffix)
        normalized[f"_{c}_plain"] = F.when(ua & ub, 1.0).when(ua | ub, 0.5)
    kept = list(pairs.columns if keep is None else keep)
    every = pairs.withColumns(normalized).select(*kept, *normalized)
    row = "_row"
    if use_characters:
        every = saved(every.withColumn(row, F.monotonically_increasing_id()))

    def scored(rows: DataFrame, **compared: tuple[str, str]) -> DataFrame:
        out = with_similarities(rows, use_characters, stored=use_characters, **compared)
        return saved(out.select(row, *compared)) if use_characters else out

    sides = lambda c: (f"_{c}", f"_{c}{suffix}")
    if use_characters:
        companies = scored(every.select(row, *sides("company_name")), company_score=sides("company_name"))
        passed = companies.where(F.col("company_score") >= threshold).select(F.col(row).alias("row"))
        titles = picked(every.select(F.col(row).alias("row"), *sides("job_title")), passed).withColumnRenamed("row", row)
        titles = scored(titles, title_score=sides("job_title"))
        out = companies.join(titles, row, "left").fillna(0.0, ["title_score"])
    else:
        out = scored(every, company_score=sides("company_name"))
        gate = F.col("company_score") >= threshold
        out = out.withColumns({c: F.when(gate, F.col(c)) for c in sides("job_title")})
        out = scored(out, title_score=sides("job_title")).fillna(0.0, ["title_score"])
    gate = (F.col("company_score") >= threshold) & (F.col("title_score") >= threshold)
    either = {f"_{c}_text": sides(c) for c in ("salary", "level")}
    if use_characters:
        fields = every.select(row, *[x for c in ("salary", "level") for x in (*sides(c), f"_{c}_plain")])
        passed = out.where(gate).select(row)
        out = out.join(scored(fields.join(passed, row, "left_semi").where("_salary_plain IS NULL OR _level_plain IS NULL"), **either), row, "left")
        out = every.select(row, "_salary_plain", "_level_plain", *kept).join(out, row)
    else:
        out = out.withColumns({x: F.when(gate & F.col(f"_{c}_plain").isNull(), F.col(x)) for c in ("salary", "level") for x in sides(c)})
        out = scored(out, **either)
    for c in ("salary", "level"):
        value = F.coalesce(f"_{c}_plain", f"_{c}_text")
        out = out.withColumn(f"{c}_score", F.when(gate, value).otherwise(0.0))
    is_dup = gate & ((F.col("salary_score") >= threshold) | (F.col("level_score") >= threshold))
    return out.withColumn("is_dup", is_dup).select(*kept, "company_score", "title_score", "salary_score", "level_score", "is_dup")


__all__ = ["WORD", "trigrams", "trigram_similarity", "trigram_similarity_to", "token_jaccard",
           "seq_ratio", "similarity", "field_similarity", "duplicate_scores", "reaches", "with_ratios", "with_similarities"]
