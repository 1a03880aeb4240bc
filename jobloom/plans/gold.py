"""The published summaries: what each holds, and the refresh of all of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom import rules as R
from jobloom.operators import rollups as A
from jobloom.schema import SUMMARY_COLUMNS
from jobloom.sources.writers import as_document, as_value, publish


def _one_document(sections: Sequence[DataFrame], name: str) -> DataFrame:
    """Documents (name, JSON) as one JSON object; there are a handful of bounded ones."""
    rows = reduce(DataFrame.unionByName, sections)
    member = F.concat(F.lit('"'), "name", F.lit('":'), "data")
    return rows.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(member)), ","), F.lit("}")).alias("data")) \
        .select(F.lit(name).alias("name"), "data")


def _most():
    return -F.col("postings")


def overview_sections(raw: DataFrame, master: DataFrame, sources: Sequence[str]) -> dict[str, DataFrame]:
    shown = [c for c in SUMMARY_COLUMNS if c in master.columns]
    return {
        "totalUnified": A.total_count(master),
        "totalRawJobs": A.total_count(raw),
        "totalDuplicatesDetected": A.merged_count(master),
        "totalCompanies": A.distinct_companies(master),
        "sources": A.source_coverage(raw, master, sources),
        "topLocations": A.top_locations(master),
        "provinces": A.province_rollup(master),
        "topHiringCompanies": A.top_companies(master),
        "latestJobs": A.latest(master, 8, shown),
        "lastCrawledAt": master.agg(F.max("created_at").alias("at")),
        "filtersAvailable": A.facets(master),
    }


def overview_document(raw: DataFrame, master: DataFrame, sources: Sequence[str] = R.SOURCES) -> DataFrame:
    parts = overview_sections(raw, master, sources)
    order = {"topLocations": [_most()], "provinces": [_most()], "topHiringCompanies": [_most()],
             "filtersAvailable": [F.col("facet"), _most()], "latestJobs": [-F.unix_micros("created_at")]}
    return _one_document([
        as_value(df, name) if len(df.columns) == 1 else as_document(df, name, *order.get(name, []))
        for name, df in parts.items()], "overview")


def skill_document(master: DataFrame) -> DataFrame:
    return _one_document([as_value(A.total_count(master), "totalJobs"),
                          as_document(A.skill_trends(master), "trends", _most())], "skill_trends")


def salary_document(master: DataFrame) -> DataFrame:
    spark = master.sparkSession
    return _one_document([
        as_value(A.total_count(master), "totalJobs"),
        as_document(A.benchmark_join(A.level_counts(master), A.level_benchmarks(spark), "level"), "levels"),
        as_document(A.benchmark_join(A.city_counts(master), A.city_benchmarks(spark), "city"), "cities"),
        as_document(A.companies_pay(master), "topCompanies", _most())], "salary_benchmarks")


def company_document(profiles: DataFrame, master: DataFrame) -> DataFrame:
    """Totals and sectors; the companies themselves are a published table, as their number
    has no bound."""
    return _one_document([
        as_value(profiles.agg(F.count(F.lit(1)).alias("totalCompanies")), "totalCompanies"),
        as_document(A.sector_rollup(profiles, master), "sectors", _most())], "company_stats")


def source_document(raw: DataFrame, master: DataFrame, sources: Sequence[str] = R.SOURCES) -> DataFrame:
    return _one_document([
        as_document(A.source_health(raw, master, sources), "sources"),
        as_document(A.overall_dedup(raw, master, A.merged_count(master)), "totals")], "source_metrics")


def refresh(spark: SparkSession, raw: DataFrame, master: DataFrame, path: str,
            sources: Sequence[str] = R.SOURCES) -> dict[str, str]:
    """Compute and publish every summary in turn; returns where each one lies."""
    base = path.rstrip("/")
    out = {}

    def put(name: str, df: DataFrame) -> str:
        publish(df, f"{base}/{name}")
        out[name] = f"{base}/{name}"
        return out[name]

    put("overview", overview_document(raw, master, sources))
    put("skill_trends", skill_document(master))
    put("salary_benchmarks", salary_document(master))
    companies = put("companies", A.company_profile(master))
    put("company_stats", company_document(spark.read.parquet(companies), master))
    put("source_metrics", source_document(raw, master, sources))
    return out


DOCUMENTS = ["overview", "skill_trends", "salary_benchmarks", "company_stats", "source_metrics"]


def documents(spark: SparkSession, places: dict[str, str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.parquet(places[n]).select("name", "data") for n in DOCUMENTS])
