"""Reading raw postings: tables per source, API payloads, embedded JSON and sitemaps."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom import rules as R
from jobloom.functions import text as X
from jobloom.schema import API_PAYLOAD, EMBEDDED_DOCUMENT, PLACE, POSTING, TEXT_COLUMNS
from jobloom.session import saved


# ---- tables -----------------------------------------------------------------------------

def read_source(spark: SparkSession, path: str, schema: T.StructType = POSTING) -> DataFrame:
    """A raw table with a fixed schema; a missing or unreadable path gives no rows."""
    try:
        df = spark.read.schema(schema).parquet(path)
        df.schema  # resolves the path now, so a missing one is noticed here
        return df
    except AnalysisException:
        return spark.createDataFrame([], schema)


def settle_sources(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(tables read to their end, message of each source that failed).

    A source that fails while it is read, say by a damaged file or a lost connection, gives no rows and does not stop the
    others.  What was read lies in the scratch folder, so a later step cannot fail on it again.
    """
    settled, failed = {}, {}
    for name, df in tables.items():
        try:
            settled[name] = saved(df)
        except (PySparkException, Py4JJavaError) as error:
            settled[name] = df.sparkSession.createDataFrame([], df.schema)
            failed[name] = str(error).split("\n")[0][:500]
    return settled, failed


SPREAD = "spark.jobloom.spread"


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over as many tasks as the session's ``spark.jobloom.spread`` names.

    For text tables that are one file of one row group, which a single task would read.  Unset, as
    on a cluster, tables stay as the scan splits them, without a shuffle.
    """
    tasks = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(tasks)) if tasks else df


def read_jdbc_source(spark: SparkSession, url: str, table: str, key: str, bounds: Sequence[str],
                     properties: dict[str, str] | None = None) -> DataFrame:
    """A raw database table read in parallel, one task per key range."""
    edges = list(bounds)
    quoted = ["'" + b.replace("'", "''") + "'" for b in edges]
    predicates = [f"{key} < {quoted[0]}"] if quoted else ["1 = 1"]
    predicates += [f"{key} >= {a} AND {key} < {b}" for a, b in zip(quoted, quoted[1:])]
    if quoted:
        predicates.append(f"{key} >= {quoted[-1]}")
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties or {})


def union_sources(tables: dict[str, DataFrame], order: Sequence[str] = R.SOURCES) -> DataFrame:
    """All raw tables as one, with ``source_rank``: the position that decides which copy of
    a posting wins.  Names outside ``order`` follow in the order given."""
    names = [n for n in order if n in tables] + [n for n in tables if n not in order]
    out = None
    for rank, name in enumerate(names):
        part = tables[name].withColumn("source_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables to unite")
    return out


def read_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """A published summary if there is one, else the roll-up itself (lazily)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return compute()


# ---- API payloads -----------------------------------------------------------------------

def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def explode_api_payload(df: DataFrame, column: str, source: str, base: str) -> DataFrame:
    """One posting per element of ``data`` in a JSON response; bad JSON gives no rows."""
    items = df.select(F.explode(F.from_json(column, API_PAYLOAD)["data"]).alias("i"))
    i = F.col("i")
    tags = F.filter(F.transform(i["skills"], lambda s: F.trim(s["skillName"])), lambda s: s != "")
    keyword = F.array_join(F.transform(tags, lambda s: F.concat(F.lit("{"), s, F.lit("}"))), " ")
    url = F.concat(F.lit(base + "/"), F.coalesce(X.blank_to_null(i["alias"]), F.lit("job")), F.lit("-"),
                   _text(i["jobId"]), F.lit("-jv"))
    attrs = F.map_filter(F.create_map(
        F.lit("jobId"), i["jobId"], F.lit("companyProfile"), X.html_to_text(i["companyProfile"]),
        F.lit("prettyApprovedOn"), i["prettyApprovedOn"],
        F.lit("companySize"), X.first_nonempty(i["companySizeVI"], i["companySize"])), lambda k, v: v.isNotNull())
    return items.select(
        F.coalesce(X.blank_to_null(i["jobUrl"]), url).alias("job_url"), F.lit(source).alias("source"),
        F.coalesce(X.blank_to_null(i["jobTitle"]), F.lit("Unknown Title")).alias("job_title"),
        _text(i["companyName"]).alias("company_name"), _text(i["companyUrl"]).alias("company_url"),
        _text(i["companyLogo"]).alias("company_logo"),
        X.salary_text(i["prettySalary"], i["salaryMin"], i["salaryMax"], i["salaryCurrency"]).alias("salary"),
        _text(i["yearsOfExperience"]).alias("experience"),
        _text(X.first_nonempty(i["jobLevelVI"], i["jobLevel"])).alias("level"),
        F.lit("IT - Phần mềm").alias("industry"),
        X.pick_location(i["workingLocations"], i["address"]).alias("location_short"),
        _text(i["address"]).alias("workplace_detail"),
        X.first_nonempty(i["approvedOn"], i["createdOn"]).alias("posted_date"),
        _text(i["expiredOn"]).alias("deadline"), _text(keyword).alias("keyword"),
        X.html_to_text(i["jobDescription"]).alias("job_description"),
        X.html_to_text(i["jobRequirement"]).alias("job_requirements"),
        X.join_nonempty(F.transform(i["benefits"], lambda b: b["benefitName"]), "\n").alias("benefits"),
        F.struct(F.lit(None).cast("array<struct<source:string,job_url:string>>").alias("duplicate_sources"),
                 attrs.alias("attrs")).alias("extra_info"))


# ---- JSON embedded in list pages --------------------------------------------------------

EMBEDDED_SCRIPT = r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>'


def extract_embedded_json(df: DataFrame, column: str, source: str, base: str) -> DataFrame:
    """One posting per item of the JSON a list page carries in a script; bad JSON gives no
    rows and an item without an id is skipped."""
    json = F.regexp_extract(column, EMBEDDED_SCRIPT, 1)
    items = df.select(F.explode(
        F.from_json(json, EMBEDDED_DOCUMENT)["props"]["initialState"]["api"]["getJobList"]["data"]["items"]).alias("i"))
    i = F.col("i")
    items = items.filter(i["id"].isNotNull() & ~i["id"].isin("", "0"))
    items = items.withColumn("places", F.from_json(i["places"], PLACE))
    short, detail = X.join_locations("places")
    requirement = X.first_nonempty(i["other_requirement"], i["other_requirement_html"])
    tags = F.filter(F.transform(i["smart_tags"], lambda t: t["name"]), lambda t: t != "")
    keyword = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("{"), t, F.lit("}"))), " ")
    attrs = F.map_filter(F.create_map(
        F.lit("id"), i["id"], F.lit("gender"), i["gender"], F.lit("vacancy_quantity"), i["vacancy_quantity"],
        F.lit("probation_duration"), i["probation_duration"]), lambda k, v: v.isNotNull())
    return items.select(
        F.concat(F.lit(base.rstrip("/") + "/"), F.coalesce(X.blank_to_null(i["title_slug"]), F.lit("viec-lam")),
                 F.lit("-id"), i["id"], F.lit(".html")).alias("job_url"),
        F.lit(source).alias("source"), _text(i["title"]).alias("job_title"),
        _text(i["employer_info"]["name"]).alias("company_name"),
        X.blank_to_null(i["employer_info"]["website"]).alias("company_url"),
        _text(i["employer_info"]["logo"]).alias("company_logo"),
        X.salary_text_millions(i["salary_min"], i["salary_max"]).alias("salary"),
        _text(i["experience_range"]).alias("experience"), _text(i["level_requirement"]).alias("level"),
        F.coalesce(X.work_type_code(i["working_method"], 1), F.lit(R.WORK_PART_TIME)).alias("work_type"),
        _text(i["degree_requirement"]).alias("education"), F.lit("Công nghệ thông tin").alias("industry"),
        short.alias("location_short"), detail.alias("workplace_detail"),
        X.epoch_to_date(i["created_at"]).alias("posted_date"),
        X.epoch_to_date(i["resume_apply_expired"]).alias("deadline"),
        F.coalesce(X.blank_to_null(keyword), F.lit("N/A")).alias("keyword"),
        _text(i["title"]).alias("job_description"), X.html_to_text(requirement).alias("job_requirements"),
        F.lit("").alias("benefits"),
        F.struct(F.lit(None).cast("array<struct<source:string,job_url:string>>").alias("duplicate_sources"),
                 attrs.alias("attrs")).alias("extra_info"))


# ---- sitemaps ---------------------------------------------------------------------------

def sitemap_urls(df: DataFrame, column: str, order: str, max_jobs: int | None = None,
                 url_pattern: str = r"<loc>([^<]+)</loc>", keywords: Sequence[str] = R.SITEMAP_KEYWORDS) -> DataFrame:
    """Distinct posting URLs of sitemaps in reading order, query cut off, kept when one of
    the keywords occurs.  ``max_jobs`` is the crawl's own limit."""
    urls = df.select(F.col(order), F.posexplode(F.regexp_extract_all(column, F.lit(url_pattern), F.lit(1))).alias("pos", "raw"))
    urls = urls.select(order, "pos", F.trim(F.regexp_replace("raw", r"\?.*$", "")).alias("url"))
    kept = urls.filter(X.contains_any(F.lower("url"), keywords))
    first = kept.groupBy("url").agg(F.min(F.struct(order, "pos")).alias("at"))
    first = first.select("url", F.col(f"at.{order}").alias(order), "at.pos")
    return first.orderBy(order, "pos").limit(max_jobs) if max_jobs is not None else first


# ---- cleaning ---------------------------------------------------------------------------

def standardize(df: DataFrame) -> DataFrame:
    """The fixed columns with their defaults; other non-empty columns go to ``extra_info``."""
    have = set(df.columns)
    fixed = ["job_url", "source", "job_title", *TEXT_COLUMNS]
    extra = [c for c in df.columns if c not in {*fixed, "extra_info", "created_at"}]
    attrs = F.lit(None).cast("map<string,string>")
    links = F.lit(None).cast("array<struct<source:string,job_url:string>>")
    if extra:
        pairs = [x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]
        attrs = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != ""))
    if "extra_info" in have:
        links = F.col("extra_info.duplicate_sources")
        old = F.coalesce(F.col("extra_info.attrs"), F.create_map().cast("map<string,string>"))
        fresh = F.coalesce(attrs, F.create_map().cast("map<string,string>"))
        attrs = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    default = {"job_url": "", "source": "unknown", "job_title": "Unknown Title"}
    columns = []
    for c in fixed:
        value = F.col(c).cast("string") if c in have else F.lit(None).cast("string")
        columns.append((F.coalesce(X.blank_to_null(value), F.lit(default[c])) if c in default else value).alias(c))
    columns.append(F.struct(links.alias("duplicate_sources"), attrs.alias("attrs")).alias("extra_info"))
    if "created_at" in have:
        columns.append(F.col("created_at"))
    return df.select(*columns)


def valid_rows(df: DataFrame) -> DataFrame:
    """Rows with a URL and a title."""
    return df.filter((F.col("job_url") != "") & (F.col("job_title") != ""))


def first_visit(df: DataFrame, key: str, *order: str) -> DataFrame:
    """First row per key in the given order.

    One aggregate per key instead of a window: copies of a hot key are reduced before the
    shuffle.
    """
    row = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(F.col(key).alias("_key")).agg(row.alias("r")).select("r.*")


def cap_per_page(df: DataFrame, keys: Sequence[str], order: Sequence[str], per_page: int,
                 page: str | None = None, max_pages: int | None = None) -> DataFrame:
    """At most ``per_page`` rows per page, and pages up to ``max_pages``."""
    if page is not None and max_pages is not None:
        df = df.filter(F.col(page) <= max_pages)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= per_page).drop("_rank")


def recent(df: DataFrame, date: Column, today: Column, days: int = 7) -> DataFrame:
    age = F.datediff(today, date)
    return df.filter((age >= 0) & (age <= days))


def source_path(base: str, source: str) -> str:
    return os.path.join(base, f"source={source}")
