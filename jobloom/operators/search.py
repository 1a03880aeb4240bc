"""Posting search: substring and trigram predicates, score, order, pages and facets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom import rules as R
from jobloom.functions.similarity import trigram_similarity_to
from jobloom.operators.rollups import facets

ALL = "all"


@dataclass(frozen=True)
class SearchParams:
    q: str = ""
    source: str = ""
    location: str = ""
    level: str = ""
    experience: str = ""
    work_type: str = ""
    sort_by: str | None = None
    page: int = 1
    limit: int = 12

    @property
    def query(self) -> str:
        return self.q.strip()

    @property
    def order(self) -> str:
        return self.sort_by or ("similarity" if self.query else "latest")

    @property
    def size(self) -> int:
        return min(100, max(1, self.limit))

    @property
    def offset(self) -> int:
        return (max(1, self.page) - 1) * self.size


def like_pattern(q: str) -> str:
    """The search text as a containment pattern.  A backslash takes the next character as it stands;
    the planner knows that only of wildcards and backslashes, so before others it is dropped."""
    return re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], f"%{q}%", flags=re.S)


def contains_like(c: str, q: str) -> Column:
    """Case-insensitive containment; ``%`` and ``_`` in the search text stay wildcards."""
    return F.coalesce(F.col(c).ilike(like_pattern(q)), F.lit(False))


def substring_match(q: str, columns=R.SUBSTRING_COLUMNS) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | contains_like(c, q)
    return out


def fuzzy_match(q: str, thresholds=R.FUZZY_THRESHOLDS) -> Column:
    """Substring hit, or a trigram similarity above the column's threshold.

    The substring test comes first, so trigrams are built only for rows it rejects.
    """
    out = substring_match(q)
    for c, limit in thresholds.items():
        out = out | (trigram_similarity_to(c, q) > limit)
    return out


def match_score(q: str) -> Column:
    if not q:
        return F.lit(0).cast("bigint")
    total = F.lit(0.0)
    for c, weight in R.SCORE_WEIGHTS.items():
        total = total + trigram_similarity_to(c, q) * weight
    for c, weight in R.SCORE_CONTAINS.items():
        total = total + F.when(contains_like(c, q), weight).otherwise(0.0)
    rounded = F.round(total, 0)
    return F.least(F.lit(R.SCORE_MAX), F.greatest(F.lit(R.SCORE_MIN), rounded)).cast("bigint")


def source_in(source: str) -> Column:
    if not source.strip() or source.strip() == ALL:
        return F.lit(True)
    return F.lower("source").isin([s.strip().lower() for s in source.split(",")])


def attribute_filter(params: SearchParams) -> Column:
    """Every given attribute must contain its text; a null attribute never does."""
    out = F.lit(True)
    for column, value in (("location_short", params.location), ("level", params.level),
                          ("experience", params.experience), ("work_type", params.work_type)):
        value = value.strip()
        if value and value != ALL:
            out = out & contains_like(column, value)
    return out


def matching(df: DataFrame, params: SearchParams) -> DataFrame:
    """Rows that pass all filters, cheap ones first so they reach the scan."""
    out = df.filter(source_in(params.source)).filter(attribute_filter(params))
    return out.filter(fuzzy_match(params.query)) if params.query else out


def ordering(params: SearchParams) -> list[Column]:
    newest = F.col("created_at").desc_nulls_first()
    key = F.col("job_url").asc()
    if params.order == "similarity" and params.query:
        return [F.desc("match_score"), newest, key]
    if params.order == "deadline":
        return [F.col("deadline").asc_nulls_last(), newest, key]
    if params.order == "title":
        return [F.col("job_title").asc_nulls_last(), key]
    return [newest, key]


def page_of(df: DataFrame, params: SearchParams) -> DataFrame:
    scored = df.withColumn("match_score", match_score(params.query))
    return scored.orderBy(*ordering(params)).offset(params.offset).limit(params.size)


def page_totals(df: DataFrame, params: SearchParams) -> DataFrame:
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"), F.lit(max(1, params.page)).cast("bigint").alias("page"),
        F.lit(params.size).cast("bigint").alias("page_size"),
        F.ceil(total / params.size).cast("bigint").alias("total_pages"))


def search(df: DataFrame, params: SearchParams, facet_values: DataFrame | None = None,
           facet_size: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(page, totals, facets); facets are of all postings and may be given precomputed."""
    hits = matching(df, params)
    return page_of(hits, params), page_totals(hits, params), (
        facet_values if facet_values is not None else facets(df, facet_size))


def lookup_by_key(df: DataFrame, key: str) -> DataFrame:
    """The posting whose URL equals the key or its URL-decoded form; no row if unknown."""
    return df.filter((F.col("job_url") == key) | (F.col("job_url") == F.try_url_decode(F.lit(key)))).limit(1)
