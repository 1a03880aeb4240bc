"""The fixture tables seen as job postings, in DataFrame form and as the same SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.text import encode_tags, sanitize_name
from jobloom.schema import EXTRA_INFO, POSTING
from jobloom.sources.readers import spread


TEXT_TABLES = ("documents", "pages", "conversations")  # their rows cost most to process


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if name in TEXT_TABLES else df


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per order: the customer's nation is the place, the first part of its
    line items the title and the first supplier the company.  Orders without line items
    have no company."""
    t = lambda n: table(spark, sf_dir, n)
    first_line = t("lineitem").groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("p_partkey"), F.min("l_suppkey").alias("s_suppkey"))
    joined = (
        spread(t("orders"))
        .join(first_line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .join(t("part"), "p_partkey", "left")
        .join(t("supplier"), "s_suppkey", "left")
    )
    text = lambda c: F.col(c).cast("string")
    tags = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    out = joined.select(
        F.concat(F.lit("https://jobs.example/"), text("o_orderkey")).alias("job_url"),
        sanitize_name("o_orderpriority").alias("source"),
        F.coalesce(F.concat("p_name", F.lit(" "), "p_type"), F.lit("Unknown Title")).alias("job_title"),
        F.col("s_name").alias("company_name"),
        F.concat(F.lit("https://"), F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("-"))),
                 F.lit(".example")).alias("company_url"),
        F.concat(F.lit("logo-"), text("s_nationkey"), F.lit(".png")).alias("company_logo"),
        F.floor("o_totalprice").cast("bigint").cast("string").alias("salary"),
        F.concat(text("p_size"), F.lit(" years")).alias("experience"),
        F.col("c_mktsegment").alias("level"),
        F.col("o_orderstatus").alias("work_type"),
        F.lit(None).cast("string").alias("education"),
        F.col("p_brand").alias("industry"),
        F.when(F.col("n_nationkey") == 0, "").when(F.col("n_nationkey") == 1, F.concat(F.lit(" "), F.col("n_name")))
         .otherwise(F.col("n_name")).alias("location_short"),
        F.col("r_name").alias("workplace_detail"),
        F.lit(None).cast("string").alias("working_time"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("posted_date"),
        F.when(F.col("o_orderkey") % 7 != 0, F.date_format(F.date_add("o_orderdate", 30), "dd-MM-yyyy")).alias("deadline"),
        F.when(F.col("p_name").isNotNull(), encode_tags(tags)).alias("keyword"),
        F.concat(F.lit("Work with "), F.col("p_name"), F.lit(" at "), F.col("n_name")).alias("job_description"),
        F.concat_ws(" ", "r_name", "p_brand", "c_mktsegment").alias("job_requirements"),
        F.lit(None).cast("string").alias("benefits"),
        F.lit(None).cast(EXTRA_INFO).alias("extra_info"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )
    return out.select(*POSTING.fieldNames())


POSTINGS_SQL = """
first_line AS (
  SELECT l_orderkey, min(l_partkey) AS pk, min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey),
postings AS (
  SELECT 'https://jobs.example/' || o_orderkey AS job_url,
    regexp_replace(lower(trim(o_orderpriority)), '[^a-zA-Z0-9_]', '_', 'g') AS source,
    coalesce(p_name || ' ' || p_type, 'Unknown Title') AS job_title,
    s_name AS company_name,
    'https://' || lower(replace(s_name, '#', '-')) || '.example' AS company_url,
    'logo-' || s_nationkey || '.png' AS company_logo,
    CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS salary,
    p_size || ' years' AS experience,
    c_mktsegment AS level,
    o_orderstatus AS work_type,
    CAST(NULL AS VARCHAR) AS education,
    p_brand AS industry,
    CASE n_nationkey WHEN 0 THEN '' WHEN 1 THEN ' ' || n_name ELSE n_name END AS location_short,
    r_name AS workplace_detail,
    CAST(NULL AS VARCHAR) AS working_time,
    strftime(o_orderdate, '%d/%m/%Y') AS posted_date,
    CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%d-%m-%Y') END AS deadline,
    '{' || array_to_string(list_distinct_ordered, '} {') || '}' AS keyword,
    'Work with ' || p_name || ' at ' || n_name AS job_description,
    concat_ws(' ', r_name, p_brand, c_mktsegment) AS job_requirements,
    CAST(NULL AS VARCHAR) AS benefits,
    o_orderdate AS created_at
  FROM orders
  LEFT JOIN first_line ON o_orderkey = l_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT *, list_filter(string_split(p_name || ' ' || p_type, ' '),
               lambda x, i: list_position(string_split(p_name || ' ' || p_type, ' '), x) = i) AS list_distinct_ordered
             FROM part) ON p_partkey = pk
  LEFT JOIN supplier ON s_suppkey = sk)
"""


def document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per document: three words of company, all others are its title."""
    words = F.split(F.trim(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " ")), " ", 4)   # the fourth part is all the rest
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string")).alias("job_url"),
        "source",
        F.array_join(F.slice(words, 4, 1), " ").alias("job_title"),
        F.array_join(F.slice(words, 1, 3), " ").alias("company_name"),
        F.col("n_chars").cast("string").alias("salary"),
        F.col("lang").alias("level"),
        F.col("text").alias("job_description"),
        F.lit(None).cast(EXTRA_INFO).alias("extra_info"),
        F.timestamp_seconds(F.col("doc_id")).alias("created_at"),
    )


DOCUMENT_POSTINGS_SQL = r"""
doc_words AS (
  SELECT *, string_split(trim(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
doc_postings AS (
  SELECT 'https://docs.example/' || doc_id AS job_url, source,
    array_to_string(w[4:], ' ') AS job_title,
    array_to_string(w[1:3], ' ') AS company_name,
    CAST(n_chars AS VARCHAR) AS salary, lang AS level, text AS job_description, doc_id
  FROM doc_words)
"""
