"""Counts and summaries over the master postings.

Every roll-up groups by the finest key first, so partial aggregation runs before the
shuffle and a hot company, place or source is split by the rest of the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom import rules as R
from jobloom.functions.text import (
    decode_tags, display_default, infer_sector, matches_ignoring_case, normalize_province, parse_salary)
from jobloom.schema import SUMMARY_COLUMNS


def percent(part: Column, total: Column, digits: int = 0) -> Column:
    """Half-even percentage of a total that counts as at least one."""
    return F.bround(part / F.greatest(total, F.lit(1)) * 100, digits)


def top_rows(df: DataFrame, n: int, key: str, *by: Column) -> DataFrame:
    """First ``n`` rows by the given order, ties by key (a TakeOrdered plan, not a sort)."""
    return df.orderBy(*by, F.col(key).asc_nulls_last()).limit(n)


def smallest_values(df: DataFrame, key: str, value: str, k: int, name: str) -> DataFrame:
    """The ``k`` smallest distinct values per key as a sorted array.

    Distinct pairs are formed before ranking and the rank limit is pushed below the
    shuffle, so at most ``k`` values per key and task reach the final group.
    """
    pairs = df.select(key, value).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(value).asc_nulls_last()))
    return (
        pairs.withColumn("_rank", rank).filter(F.col("_rank") <= k)
        .groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))
    )


def _named(df: DataFrame) -> DataFrame:
    return df.filter(F.col("company_name").isNotNull() & (F.col("company_name") != ""))


# ---- counts -----------------------------------------------------------------------------

def total_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def distinct_companies(df: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return _named(df).agg(count("company_name").alias("total_companies"))


def count_by_source(df: DataFrame, lower: bool = True) -> DataFrame:
    source = F.lower("source") if lower else F.col("source")
    return (df.filter(F.col("source").isNotNull()).groupBy(source.alias("source"))
            .agg(F.count(F.lit(1)).alias("postings")))


def active_count(df: DataFrame, is_active: Column) -> DataFrame:
    return df.agg(F.count_if(is_active).alias("active"))


def merged_count(df: DataFrame) -> DataFrame:
    """Postings that carry at least one link to a merged copy."""
    return df.agg(F.count_if(F.size("extra_info.duplicate_sources") > 0).alias("merged"))


def spine(spark: SparkSession, names: Sequence[str], column: str = "source") -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{column} string, position int")


def source_coverage(raw: DataFrame, master: DataFrame, sources: Sequence[str] = R.SOURCES) -> DataFrame:
    """Raw and merged counts of every known source; a source without raw rows shows its
    merged count."""
    raw_n = count_by_source(raw).withColumnRenamed("postings", "raw_found")
    uni_n = count_by_source(master).withColumnRenamed("postings", "uni_found")
    zero = F.lit(0)
    return (
        spine(raw.sparkSession, sources)
        .join(raw_n, "source", "left").join(uni_n, "source", "left")
        .select("source",
                F.coalesce("raw_found", "uni_found", zero).cast("bigint").alias("raw_count"),
                F.coalesce("uni_found", zero).cast("bigint").alias("unified_count"))
    )


def source_health(raw: DataFrame, master: DataFrame, sources: Sequence[str] = R.SOURCES) -> DataFrame:
    raw_n = count_by_source(raw).withColumnRenamed("postings", "raw_found")
    uni_n = count_by_source(master).withColumnRenamed("postings", "uni_found")
    counts = (
        spine(raw.sparkSession, sources).join(raw_n, "source", "left").join(uni_n, "source", "left")
        .select("source", F.coalesce("raw_found", F.lit(0)).cast("bigint").alias("raw_count"),
                F.coalesce("uni_found", F.lit(0)).cast("bigint").alias("unified_count"))
    )
    return counts.withColumns({
        "dedup_percent": _removed_percent(F.col("raw_count"), F.col("unified_count")),
        "status": F.when(F.col("raw_count") > 0, "ACTIVE").otherwise("IDLE"),
    })


def _removed_percent(raw: Column, kept: Column) -> Column:
    share = F.bround((raw - kept) / F.nullif(raw, F.lit(0)) * 100, 0)
    return F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0)).cast("bigint")


def overall_dedup(raw: DataFrame, master: DataFrame, merged: DataFrame) -> DataFrame:
    """Totals of both layers; each input is reduced to one row before they meet."""
    def part(df, name, value):
        return df.agg(value.alias("v")).select(F.lit(name).alias("k"), F.col("v").cast("bigint").alias("v"))

    parts = (part(raw, "raw", F.count(F.lit(1))).unionByName(part(master, "unified", F.count(F.lit(1))))
             .unionByName(part(merged, "merged", F.coalesce(F.sum("merged"), F.lit(0)))))
    pick = lambda k: F.sum(F.when(F.col("k") == k, F.col("v")))
    totals = parts.agg(pick("raw").alias("total_raw"), pick("unified").alias("total_unified"),
                       pick("merged").alias("total_merged"))
    return totals.withColumn("dedup_percent", _removed_percent(F.col("total_raw"), F.col("total_unified")))


# ---- places -----------------------------------------------------------------------------

def top_locations(df: DataFrame, n: int = 8, label: str = R.UNKNOWN_LOCATION) -> DataFrame:
    counts = (df.groupBy(display_default("location_short", label).alias("location"))
              .agg(F.count(F.lit(1)).alias("postings")))
    return top_rows(counts, n, "location", F.desc("postings"))


def _by_place(df: DataFrame, place: Column, company: Column) -> DataFrame:
    """Postings and distinct companies per place, in two steps so that one huge place is
    spread over its companies."""
    fine = df.groupBy(place.alias("place"), company.alias("_company")).agg(F.count(F.lit(1)).alias("_n"))
    return fine.groupBy("place").agg(F.sum("_n").alias("postings"), F.count("_company").alias("companies"))


def province_rollup(df: DataFrame, rule_list=R.PROVINCE_RULES, hubs: Sequence[str] = R.HUB_PROVINCES,
                    default: str = R.UNKNOWN_LOCATION) -> DataFrame:
    company = F.nullif(F.trim("company_name"), F.lit(""))
    counts = _by_place(df, normalize_province("location_short", rule_list, default), company)
    hub_rows = spine(df.sparkSession, hubs, "place").select(
        "place", F.lit(0).cast("bigint").alias("postings"), F.lit(0).cast("bigint").alias("companies"))
    merged = counts.unionByName(hub_rows).groupBy("place").agg(
        F.sum("postings").alias("postings"), F.sum("companies").alias("companies"))
    total = F.sum("postings").over(Window.partitionBy())  # one row per province at this point
    return merged.select(F.col("place").alias("province"), "postings", "companies",
                         percent(F.col("postings"), total, 1).alias("percentage"))


def location_rollup_live(df: DataFrame, n: int = 40) -> DataFrame:
    """The same measures on the raw place names; the share is of all postings."""
    counts = _by_place(df, display_default("location_short", R.UNKNOWN_LOCATION), F.col("company_name"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    top = top_rows(counts, n, "place", F.desc("postings"))
    return (top.join(F.broadcast(total), F.lit(True))  # one-row side
            .select(F.col("place").alias("province"), "postings", "companies",
                    F.round(F.col("postings") / F.col("_total") * 100, 1).alias("percentage")))


def city_counts(df: DataFrame, cities=R.CITY_BENCHMARKS) -> DataFrame:
    """Postings whose place contains the city's search key; cities may overlap."""
    return _counted(df, [(c, F.col("location_short").ilike(f"%{key}%")) for c, key, *_ in cities], "city")


def level_counts(df: DataFrame, levels=R.LEVEL_BENCHMARKS) -> DataFrame:
    """Postings whose level or title contains the text before the first '/'."""
    def hit(level):
        key = f"%{level.split('/')[0].strip()}%"
        return F.col("level").ilike(key) | F.col("job_title").ilike(key)
    return _counted(df, [(row[0], hit(row[0])) for row in levels], "level")


def _counted(df: DataFrame, conditions: list[tuple[str, Column]], name: str) -> DataFrame:
    """One row per condition with the rows that satisfy it, all in a single pass."""
    one = df.agg(*[F.count_if(c).alias(f"_{i}") for i, (_, c) in enumerate(conditions)])
    cells = [F.struct(F.lit(label).alias(name), F.col(f"_{i}").alias("postings"))
             for i, (label, _) in enumerate(conditions)]
    return one.select(F.inline(F.array(*cells)))


def benchmark_join(counts: DataFrame, benchmarks: DataFrame, key: str) -> DataFrame:
    """Attach the caller's benchmark rows; every benchmark row is kept."""
    return benchmarks.join(counts, key, "left").withColumn("postings", F.coalesce("postings", F.lit(0)).cast("bigint"))


def level_benchmarks(spark: SparkSession, rows=R.LEVEL_BENCHMARKS) -> DataFrame:
    return spark.createDataFrame(list(rows), "level string, pay_range string, avg_vnd double, note string")


def city_benchmarks(spark: SparkSession, rows=R.CITY_BENCHMARKS) -> DataFrame:
    return spark.createDataFrame([(c, r, a) for c, _, r, a in rows], "city string, pay_range string, avg_vnd double")


# ---- companies --------------------------------------------------------------------------

def _company_base(df: DataFrame) -> DataFrame:
    return _named(df).groupBy(
        "company_name", display_default("location_short", R.UNKNOWN_SHORT).alias("location")
    ).agg(F.count(F.lit(1)).alias("n"), F.max("company_logo").alias("logo"),
          F.max("salary").alias("sample_salary"))


def _company_totals(base: DataFrame) -> DataFrame:
    return base.groupBy("company_name").agg(
        F.sum("n").alias("postings"), F.max("logo").alias("logo"), F.max("sample_salary").alias("sample_salary"))


def top_companies(df: DataFrame, n: int = 15, places: int = 2) -> DataFrame:
    base = _company_base(df)
    top = top_rows(_company_totals(base), n, "company_name", F.desc("postings"))
    # ``top`` holds n rows, so only their places are ranked
    kept = base.join(F.broadcast(top.select("company_name")), "company_name", "left_semi")
    return top.join(smallest_values(kept, "company_name", "location", places, "locations"), "company_name", "left")


def companies_pay(df: DataFrame, n: int = 8) -> DataFrame:
    return top_rows(_company_totals(_company_base(df)), n, "company_name", F.desc("postings"))


def company_profile(df: DataFrame, places: int = 3, titles: int = 3, rule_list=R.SECTOR_RULES) -> DataFrame:
    named = _named(df)
    totals = named.groupBy("company_name").agg(
        F.max("company_logo").alias("logo"), F.max("company_url").alias("url"),
        F.count(F.lit(1)).alias("postings"), F.max("salary").alias("sample_salary"),
        F.max(F.coalesce("job_requirements", F.lit(""))).alias("_req"))
    where = smallest_values(
        named.select("company_name", display_default("location_short", R.UNKNOWN_SHORT).alias("_loc")),
        "company_name", "_loc", places, "locations")
    what = smallest_values(named, "company_name", "job_title", titles, "sample_titles")
    return (
        totals.join(where, "company_name", "left").join(what, "company_name", "left")
        .withColumn("sector", infer_sector("company_name", F.array_join("sample_titles", " "), "_req", rule_list))
        .drop("_req")
    )


def sector_rollup(profiles: DataFrame, master: DataFrame, sample: int = 4) -> DataFrame:
    """Postings per sector; the share is of all postings, named company or not."""
    keyed = profiles.withColumn("_key", F.coalesce("sector", F.lit("")))
    sums = keyed.groupBy("_key").agg(F.first("sector").alias("sector"), F.sum("postings").alias("postings"))
    names = smallest_values(keyed, "_key", "company_name", sample, "top_companies")
    total = master.agg(F.count(F.lit(1)).alias("_total"))
    return (sums.join(names, "_key", "left").join(F.broadcast(total), F.lit(True))  # one-row side
            .select("sector", "postings",
                    percent(F.col("postings"), F.col("_total")).cast("bigint").alias("percentage"),
                    "top_companies"))


# ---- facets, skills, levels -------------------------------------------------------------

def facets(df: DataFrame, k: int = 15) -> DataFrame:
    """Value counts of source (all), place and level (first ``k`` each) from one scan."""
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("facet"), F.col(c).alias("value"))
        for name, c in (("source", "source"), ("location", "location_short"), ("level", "level"))])))
    counts = (pairs.filter(F.col("value").isNotNull() & (F.col("value") != ""))
              .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("postings")))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("postings"), F.asc("value")))
    limited = counts.filter(F.col("facet") != "source").withColumn("_rank", rank).filter(F.col("_rank") <= k)
    return counts.filter(F.col("facet") == "source").unionByName(limited.drop("_rank"))


SKILL_COLUMNS = ("job_title", "job_requirements", "job_description", "keyword")


def skill_trends(df: DataFrame, groups=R.TECH_GROUPS, columns: Sequence[str] = SKILL_COLUMNS,
                 half_even: bool = True) -> DataFrame:
    """Postings that mention each technology group, all groups counted in one pass."""
    present = [c for c in columns if c in df.columns]
    lowered = df.select(*[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in present])
    aggregates = [F.count(F.lit(1)).alias("_total")]
    for i, (_, _, pattern, *_rest) in enumerate(groups):
        hit = F.lit(False)
        for c in present:
            hit = hit | matches_ignoring_case(F.col(c), pattern)
        aggregates.append(F.count_if(hit).alias(f"_{i}"))
    cells = [
        F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"), F.col(f"_{i}").alias("postings"),
                 F.lit(note).alias("avg_salary_estimate"), F.lit(badge).alias("badge"), F.col("_total").alias("_total"))
        for i, (name, category, _, note, badge) in enumerate(groups)]
    rows = lowered.agg(*aggregates).select(F.inline(F.array(*cells)))
    share = F.col("postings") / F.greatest(F.col("_total"), F.lit(1)) * 100
    rounded = F.bround(share, 0) if half_even else F.floor(share + 0.5)
    return rows.withColumn("share_percent", F.least(F.lit(100), rounded.cast("bigint"))).drop("_total")


def live_tech_groups() -> list[tuple]:
    return [(n, c, R.TECH_PATTERNS_LIVE.get(n, p), s, b) for n, c, p, s, b in R.TECH_GROUPS]


def top_skills(df: DataFrame, n: int = 10) -> DataFrame:
    counts = (df.select(F.explode(decode_tags("keyword")).alias("skill")).filter(F.col("skill") != "")
              .groupBy("skill").agg(F.count(F.lit(1)).alias("job_count")))
    return top_rows(counts, n, "skill", F.desc("job_count"))


def salary_by_level(df: DataFrame) -> DataFrame:
    """Average, least and greatest stated pay per level; a single bound counts alone."""
    pay = df.select("level", parse_salary("salary").alias("pay"))
    low, high = F.coalesce("pay.min", "pay.max"), F.coalesce("pay.max", "pay.min")
    return (pay.filter(low.isNotNull() & F.col("level").isNotNull()).groupBy("level").agg(
        F.avg((low + high) / 2).alias("avg_salary"), F.min(low).alias("min_salary"),
        F.max(high).alias("max_salary"), F.count(F.lit(1)).alias("postings")))


def latest(df: DataFrame, n: int = 8, columns: Sequence[str] | None = SUMMARY_COLUMNS) -> DataFrame:
    kept = df.select(*columns) if columns else df
    return kept.orderBy(F.col("created_at").desc_nulls_first(), F.col("job_url")).limit(n)


# ---- run log ----------------------------------------------------------------------------

NO_POSTINGS = "0 jobs"


def run_summary(log: DataFrame) -> DataFrame:
    """Last result of every site: status by outcome, and why nothing came."""
    last = log.groupBy("site").agg(F.max_by(F.struct("status", "jobs", "duration", "message"),
                                            F.struct("ts", "seq")).alias("r"))
    jobs = F.coalesce("r.jobs", F.lit(0))
    failed = F.col("r.status") == "FAILED"
    return last.select(
        "site",
        F.when(failed, "FAILED").when(jobs > 0, "SUCCESS").otherwise("WARNING").alias("status"),
        jobs.alias("jobs"), F.col("r.duration").alias("duration"),
        F.when(jobs == 0, F.substring(F.coalesce(F.nullif(F.col("r.message"), F.lit("")), F.lit(NO_POSTINGS)), 1, 120))
         .alias("reason"))


def run_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("sites"), F.sum("jobs").alias("total_jobs"),
        F.count_if(F.col("status") == "SUCCESS").alias("succeeded"),
        F.count_if(F.col("status") == "WARNING").alias("warned"),
        F.count_if(F.col("status") == "FAILED").alias("failed"))
