"""Reading and writing queries, with SQL twins computed from the original tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from jobloom import rules as R
from jobloom.functions import text as X
from jobloom.plans.catalog import query
from jobloom.plans.rollup_queries import DOC_SOURCES, P
from jobloom.plans.views import postings, table
from jobloom.schema import TEXT_COLUMNS
from jobloom.session import scratch_folder
from jobloom.sources import readers as S
from jobloom.sources import writers as W


def scratch(spark) -> str:
    return f"{scratch_folder(spark).rstrip('/')}/jobloom-io-{uuid.uuid4().hex}"


@query("read_source", "SELECT lang, count(*) AS postings FROM documents GROUP BY 1")
def _(spark, sf):
    schema = table(spark, sf, "documents").schema
    there = S.read_source(spark, os.path.join(sf, "documents.parquet"), schema)
    missing = S.read_source(spark, os.path.join(sf, "no_such_table.parquet"), schema)
    return there.unionByName(missing).groupBy("lang").agg(F.count(F.lit(1)).alias("postings"))


@query("union_sources", f"""SELECT doc_id, source, CAST(CASE {' '.join(f"WHEN source = '{s}' THEN {i}" for i, s in enumerate(reversed(DOC_SOURCES[:20])))} END AS INTEGER) AS source_rank,
CASE WHEN source <> 'src0' THEN lang END AS lang FROM documents""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    parts = {s: docs.filter(F.col("source") == s) for s in DOC_SOURCES[:20]}
    parts["src0"] = parts["src0"].drop("lang")
    return S.union_sources(parts, list(reversed(DOC_SOURCES[:20])))


def api_responses(spark, sf):
    c = table(spark, sf, "conversations")
    html = F.concat(F.lit("<p>"), F.col("text"), F.lit("</p><ul><li> a </li></ul>"))
    sid = F.concat_ws("-", "conv_id", "turn")
    item = lambda title, alias: F.struct(
        sid.alias("jobId"), title.alias("jobTitle"), alias.alias("alias"), F.col("role").alias("companyName"),
        F.when(F.col("turn") > 0, F.col("turn") * 1000).alias("salaryMin"),
        F.when(F.col("turn") > 1, F.col("turn") * 2500).alias("salaryMax"), F.lit("USD").alias("salaryCurrency"),
        F.when(F.col("role") == "user", "0").otherwise("").alias("prettySalary"),
        html.alias("jobDescription"),
        F.array(F.struct(F.col("role").alias("skillName")), F.struct(F.lit(" ").alias("skillName")),
                F.struct(F.col("turn").cast("string").alias("skillName"))).alias("skills"),
        F.array(F.struct(F.lit(" Tet ").alias("benefitName")), F.struct(F.col("role").alias("benefitName"))).alias("benefits"),
        F.array(F.struct(F.when(F.col("turn") % 2 == 0, "").otherwise("Huế").alias("cityName"),
                         F.concat(F.lit("No. "), F.col("conv_id").cast("string")).alias("address"))).alias("workingLocations"),
        F.lit("HCM").alias("address"))
    good = F.to_json(F.struct(F.array(
        item(F.col("text"), F.lit(None).cast("string")), item(F.lit(None).cast("string"), F.col("role"))).alias("data")))
    # every tenth response is cut short in transit
    return c.select(F.when(F.col("conv_id") % 10 == 3, F.substring(good, 1, 40)).otherwise(good).alias("payload"))


@query("explode_api_payload", """WITH c AS (SELECT *, conv_id || '-' || turn AS sid FROM conversations WHERE conv_id % 10 <> 3),
i AS (SELECT c.*, text AS title, 'job' AS alias FROM c UNION ALL SELECT c.*, 'Unknown Title', role FROM c)
SELECT 'https://board.example/' || alias || '-' || sid || '-jv' AS job_url, title AS job_title, role AS company_name,
  CASE WHEN turn > 1 THEN format('{:,}', turn * 1000) || ' - ' || format('{:,}', turn * 2500) || ' USD'
    WHEN turn > 0 THEN 'Từ ' || format('{:,}', turn * 1000) || ' USD' ELSE 'Thỏa thuận' END AS salary,
  CASE WHEN turn % 2 = 0 THEN 'No. ' || conv_id ELSE 'Huế' END AS location_short,
  '{' || role || '} {' || turn || '}' AS keyword, 'Tet' || chr(10) || role AS benefits, 'HCM' AS workplace_detail,
  md5(trim(regexp_replace(text, '[ \t\r\f]+', ' ', 'g')) || chr(10) || 'a') AS job_description FROM i""")
def _(spark, sf):
    out = S.explode_api_payload(api_responses(spark, sf), "payload", "api", "https://board.example")
    return out.select("job_url", "job_title", "company_name", "salary", "location_short", "keyword", "benefits",
                      "workplace_detail", F.md5("job_description").alias("job_description"))


def list_pages(spark, sf):
    p = table(spark, sf, "pages")
    text = lambda c: F.col(c).cast("string")
    k = F.col("page_id")
    place = lambda a, b: F.struct(a.alias("address"), b.alias("province_name"))
    places = F.array(place(F.lit("1 Main"), F.lit("Huế")), place(F.lit(None).cast("string"), F.lit("Hà Nội")),
                     place(text("page_id"), F.lit("Huế")))
    fields = lambda id_, slug, pl: F.struct(
        id_.alias("id"), F.col("url").alias("title"), slug.alias("title_slug"),
        F.struct(F.lit("Emp").alias("name"), F.lit("l.png").alias("logo"), F.lit("").alias("website")).alias("employer_info"),
        F.when(k % 3 != 0, k * 500000).alias("salary_min"), F.when(k % 4 != 0, k * 1250000.0).alias("salary_max"),
        pl.alias("places"), (k * 86400).alias("created_at"), F.when(k % 2 == 0, k * 100000).alias("resume_apply_expired"),
        F.when(k % 5 != 0, F.array(F.struct(F.lit("x").alias("name")), F.struct(text("page_id").alias("name")))).alias("smart_tags"),
        (k % 3).alias("working_method"))
    one = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(F.struct(
        F.array(fields(k + 1, F.lit("lap-trinh"), places), fields(F.lit(None).cast("bigint"), F.lit("x"), places)).alias("items"))
        .alias("data")).alias("getJobList")).alias("api")).alias("initialState")).alias("props")))
    script = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), one, F.lit("</script>"))
    broken = F.concat(F.lit('<script id="__NEXT_DATA__">{"props": oops</script>'))
    return p.select(F.concat("html", F.when(k % 9 == 4, broken).when(k % 9 == 5, "").otherwise(script)).alias("html"))


@query("extract_embedded_json", """SELECT 'https://board.example/lap-trinh-id' || (page_id + 1) || '.html' AS job_url, url AS job_title,
  CASE WHEN page_id = 0 OR (page_id % 3 = 0 AND page_id % 4 = 0) THEN 'Thoả thuận'
    WHEN page_id % 3 <> 0 AND page_id % 4 <> 0 THEN printf('%g', page_id * 0.5::DOUBLE) || ' - ' || printf('%g', page_id * 1.25::DOUBLE) || ' triệu VND'
    WHEN page_id % 3 <> 0 THEN 'Từ ' || printf('%g', page_id * 0.5::DOUBLE) || ' triệu VND'
    ELSE 'Tới ' || printf('%g', page_id * 1.25::DOUBLE) || ' triệu VND' END AS salary,
  'Huế, Hà Nội' AS location_short, '1 Main' || chr(10) || page_id AS workplace_detail,
  strftime(to_timestamp(page_id * 86400) AT TIME ZONE 'UTC', '%d/%m/%Y') AS posted_date,
  CASE WHEN page_id % 2 = 0 THEN strftime(to_timestamp(page_id * 100000) AT TIME ZONE 'UTC', '%d/%m/%Y') ELSE '' END AS deadline,
  CASE WHEN page_id % 5 <> 0 THEN '{x} {' || page_id || '}' ELSE 'N/A' END AS keyword,
  CASE WHEN page_id % 3 = 1 THEN 'Toàn thời gian' ELSE 'Bán thời gian' END AS work_type
FROM pages WHERE page_id % 9 NOT IN (4, 5)""")
def _(spark, sf):
    out = S.extract_embedded_json(list_pages(spark, sf), "html", "embedded", "https://board.example/")
    return out.select("job_url", "job_title", "salary", "location_short", "workplace_detail", "posted_date",
                      "deadline", "keyword", "work_type")


SITEMAP_HIT = " OR ".join(f"contains(lower(url), '{k}')" for k in R.SITEMAP_KEYWORDS)
SITEMAP = r"""WITH raw AS (SELECT page_id, unnest(list_concat([url], regexp_extract_all(html, 'href="([^"]*)"', 1))) AS raw,
  unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) + 1)) AS pos FROM pages),
u AS (SELECT page_id, pos, trim(regexp_replace(raw, '\?.*$', '')) AS url FROM raw WHERE raw <> ''),
"""


def sitemap_pages(spark, sf):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    locs = F.transform(F.concat(F.array("url"), links), lambda u: F.concat(F.lit("<loc>"), u, F.lit("</loc>")))
    return table(spark, sf, "pages").select("page_id", F.array_join(locs, "\n").alias("xml"))


@query("sitemap_urls", SITEMAP + f"""f AS (SELECT url, min(page_id * 1000000 + pos) AS spot FROM u WHERE {SITEMAP_HIT} GROUP BY 1)
SELECT url, CAST(spot // 1000000 AS BIGINT) AS page_id FROM f""")
def _(spark, sf):
    return S.sitemap_urls(sitemap_pages(spark, sf), "xml", "page_id").select("url", "page_id")


@query("sitemap_urls_first", SITEMAP + f"""f AS (SELECT url, min(page_id * 1000000 + pos) AS spot FROM u WHERE {SITEMAP_HIT} GROUP BY 1)
SELECT url FROM f ORDER BY spot LIMIT 40""")
def _(spark, sf):
    return S.sitemap_urls(sitemap_pages(spark, sf), "xml", "page_id", max_jobs=40).select("url")


SHOWN = "job_url, source, job_title, company_name, salary, level, location_short, deadline, keyword, job_description"


@query("write_bronze_csv", P + f"SELECT {', '.join(f"nullif({c}, '') AS {c}" for c in SHOWN.split(', '))} FROM postings")
def _(spark, sf):
    path = scratch(spark)
    W.write_bronze(postings(spark, sf), path)
    return W.read_csv(spark, f"{path}/csv").select(*SHOWN.split(", "))


@query("write_bronze_json", P + f"SELECT {SHOWN} FROM postings")
def _(spark, sf):
    path = scratch(spark)
    df = postings(spark, sf)
    W.write_bronze(df, path, ("json",))
    return spark.read.schema(df.schema).json(f"{path}/json").select(*SHOWN.split(", "))


def export_sql():
    cells = []
    for header, column, default in R.EXPORT_COLUMNS:
        value = "upper(source)" if column == "source" else column
        cells.append(f"regexp_replace(coalesce(nullif({value}, ''), '{default}'), '\\r?\\n', ' ', 'g') AS \"{header}\"")
    return P + "SELECT " + ", ".join(cells) + " FROM postings"


@query("export_csv", export_sql())
def _(spark, sf):
    return W.export_frame(postings(spark, sf))


@query("export_csv_file", export_sql().replace("''), ''), '", "''), ''), '"))
def _(spark, sf):
    path = scratch(spark)
    W.export_csv(postings(spark, sf), path)
    back = W.read_csv(spark, path)
    return back.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in back.columns])


def order_rows(df, salary, level):
    return df.select(
        F.concat(F.lit("https://jobs.example/"), F.col("o_orderkey").cast("string")).alias("job_url"),
        F.lower("o_orderpriority").alias("source"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("job_title"),
        salary.alias("salary"), level.alias("level"), F.col("o_orderdate").alias("created_at"))


def stored_and_new(spark, sf):
    o = table(spark, sf, "orders")
    cents = F.floor(F.col("o_totalprice")).cast("bigint").cast("string")
    old = order_rows(o.filter(F.col("o_orderstatus").isin("F", "O")), cents, F.lit(None).cast("string"))
    new = order_rows(
        o.filter(F.col("o_orderstatus").isin("O", "P")).withColumn("o_custkey", F.col("o_custkey") + 1)
        .withColumn("o_orderdate", F.date_add("o_orderdate", 1).cast("timestamp")),
        F.when(F.col("o_orderpriority") == "1-URGENT", None).when(F.col("o_orderpriority") == "2-HIGH", "").otherwise("new"),
        F.col("o_orderpriority"))
    return old, new


@query("upsert_merge", """WITH old AS (SELECT 'https://jobs.example/' || o_orderkey AS job_url, lower(o_orderpriority) AS source, 't' || o_custkey AS job_title,
  CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS salary, CAST(NULL AS VARCHAR) AS level, o_orderdate AS at FROM orders WHERE o_orderstatus IN ('F', 'O')),
new AS (SELECT 'https://jobs.example/' || o_orderkey AS job_url, lower(o_orderpriority) AS source, 't' || (o_custkey + 1) AS job_title,
  CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN '' ELSE 'new' END AS salary, o_orderpriority AS level,
  o_orderdate + INTERVAL 1 DAY AS at FROM orders WHERE o_orderstatus IN ('O', 'P'))
SELECT coalesce(o.job_url, n.job_url) AS job_url, coalesce(n.source, o.source) AS source, coalesce(n.job_title, o.job_title) AS job_title,
  coalesce(n.salary, o.salary) AS salary, coalesce(n.level, o.level) AS level, strftime(coalesce(o.at, n.at), '%Y-%m-%d') AS created_at
FROM old o FULL JOIN new n ON o.job_url = n.job_url""")
def _(spark, sf):
    old, new = stored_and_new(spark, sf)
    return W.upsert_merge(old, new).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


@query("last_per_key", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("key", F.concat_ws("/", "l_orderkey", "l_linenumber"))
    last = W.last_per_key(lines, "key", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    return last.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("valid_rows", "SELECT doc_id FROM documents WHERE regexp_extract(text, '^([A-Z][a-z]+) ', 1) <> ''")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("job_url"),
                                             F.regexp_extract("text", r"^([A-Z][a-z]+) ", 1).alias("job_title"))
    return S.valid_rows(d).select("doc_id")


@query("standardize_record", """SELECT coalesce(CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderstatus = 'F' THEN '' ELSE 'u' || o_orderkey END, '') AS x,
 coalesce(nullif(CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderstatus = 'F' THEN '' ELSE 'u' || o_orderkey END, ''), '') AS job_url,
 coalesce(nullif(CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE lower(o_orderpriority) END, ''), 'unknown') AS source,
 'Unknown Title' AS job_title, CAST(o_custkey AS VARCHAR) AS salary, CAST(NULL AS VARCHAR) AS level,
 CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'prio=' || o_orderpriority || ' ' END || 'status=' || o_orderstatus AS attrs FROM orders""".replace(
     "coalesce(CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderstatus = 'F' THEN '' ELSE 'u' || o_orderkey END, '') AS x,\n", ""))
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "O", None).when(F.col("o_orderstatus") == "F", "")
         .otherwise(F.concat(F.lit("u"), F.col("o_orderkey").cast("string"))).alias("job_url"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.lower("o_orderpriority")).alias("source"),
        F.col("o_custkey").alias("salary"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).otherwise("").alias("prio"),
        F.col("o_orderstatus").alias("status"))
    out = S.standardize(o)
    pairs = F.transform(F.array_sort(F.map_entries("extra_info.attrs")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select("job_url", "source", "job_title", "salary", "level", F.array_join(pairs, " ").alias("attrs"))


@query("first_visit", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) = 1""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("url", F.concat_ws("/", "l_orderkey", "l_linenumber"))
    first = S.first_visit(lines, "url", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    return first.select("l_orderkey", "l_linenumber", "l_partkey")


@query("cap_per_page", """SELECT event_id, user_id FROM events WHERE user_id <= 60
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 3""")
def _(spark, sf):
    out = S.cap_per_page(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], 3, "user_id", 60)
    return out.select("event_id", "user_id")


@query("recency_filter", """SELECT o_orderkey FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) BETWEEN 0 AND 7""")
def _(spark, sf):
    """Postings of the last week, their dates as the boards write them."""
    o = table(spark, sf, "orders")
    shown = F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "dd/MM/yyyy")).when(
        F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    dated = o.withColumn("day", X.parse_date(shown))
    newest = dated.agg(F.max("day").alias("today"))
    return S.recent(dated.join(F.broadcast(newest), F.lit(True)), F.col("day"), F.col("today")).select("o_orderkey")


@query("read_or_compute", "SELECT source, count(*) AS postings FROM documents GROUP BY 1")
def _(spark, sf):
    """The live roll-up is published, read back, and used instead of a missing one."""
    path = scratch(spark)
    live = lambda: table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("postings"))
    W.publish(S.read_or_compute(spark, path, live), path)
    return S.read_or_compute(spark, path, live).select("source", "postings")


assert set(c for _, c, _ in R.EXPORT_COLUMNS) <= {"job_url", "source", "job_title", *TEXT_COLUMNS}
