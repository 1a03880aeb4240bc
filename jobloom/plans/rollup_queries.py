"""Counts and summaries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom import rules as R
from jobloom.operators import rollups as A
from jobloom.plans.catalog import query
from jobloom.plans.views import DOCUMENT_POSTINGS_SQL, POSTINGS_SQL, document_postings, postings, table

P = "WITH " + POSTINGS_SQL
D = "WITH " + DOCUMENT_POSTINGS_SQL

# Stand-in dimensions that fit the fixture tables.
NATION_RULES = [(["nation_1"], "Hà Nội"), (["nation_2", "nation_3"], "Đà Nẵng"),
                (["nation_4"], "Cần Thơ"), (["nation_5"], R.REMOTE_LOCATION)]
LEVEL_ROWS = [("BUILD / builders", "1 - 2", 1.5, "b"), ("auto / cars", "2 - 3", 2.5, "a"),
              ("machinery", "3 - 4", 3.5, "m"), ("small", "4 - 5", 4.5, "s")]
CITY_ROWS = [("First", "NATION_1", "1 - 2", 1.5), ("Second", "nation_2", "2 - 3", 2.5),
             ("Nowhere", "Remote", "3 - 4", 3.5)]
DOC_GROUPS = [("the", "Word", r"\bthe\b", "x", "a"), ("ion", "Tail", r"tion|sion", "y", "b"),
              ("accent", "Letter", r"é|ñ|ü", "z", "c"), ("digits", "Other", r"[0-9]{3}", "w", "d"),
              ("never", "Other", r"zzzzqqqq", "v", "e")]
SECTORS = [(["nation_1", "brand#1"], "One"), (["supplier#000000002", "large"], "Two"), (["ring"], "Three")]
DOC_SOURCES = [f"src{i}" for i in range(24)]


def values(rows) -> str:
    def one(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


def sql_first_rule(expr: str, rule_list, default: str = "NULL") -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains({expr}, '{n}')" for n in needles) + f" THEN '{v}'" for needles, v in rule_list)
    return f"CASE {cases} ELSE {default} END"


PROVINCE_SQL = sql_first_rule("lower(trim(location_short))", NATION_RULES, f"'{R.UNKNOWN_LOCATION}'")


@query("total_count", "SELECT count(*) AS total FROM orders")
def _(spark, sf):
    return A.total_count(table(spark, sf, "orders"))


@query("distinct_companies", P + """SELECT count(DISTINCT company_name) AS total_companies FROM postings
WHERE company_name IS NOT NULL AND company_name <> ''""")
def _(spark, sf):
    return A.distinct_companies(postings(spark, sf))


@query("count_by_source", "SELECT lower(source) AS source, count(*) AS postings FROM documents WHERE source IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return A.count_by_source(table(spark, sf, "documents"))


@query("active_count", "SELECT count(*) FILTER (o_orderstatus = 'O') AS active FROM orders")
def _(spark, sf):
    return A.active_count(table(spark, sf, "orders"), F.col("o_orderstatus") == "O")


COVERAGE = f"""WITH spine(source) AS (VALUES {values([(s,) for s in DOC_SOURCES])}),
raw AS (SELECT lower(source) AS source, count(*) AS n FROM documents GROUP BY 1),
"""


@query("source_coverage", COVERAGE + """uni AS (SELECT lower(source) AS source, count(*) AS n FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1)
SELECT s.source, coalesce(raw.n, uni.n, 0) AS raw_count, coalesce(uni.n, 0) AS unified_count
FROM spine s LEFT JOIN raw USING (source) LEFT JOIN uni USING (source)""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return A.source_coverage(docs, docs.join(good, "doc_id", "left_semi"), DOC_SOURCES)


FIRST_COPY = "(SELECT arg_min(source, doc_id) AS source, count(*) - 1 AS copies FROM documents GROUP BY text)"


def first_copies(spark, sf):
    """The first document of every distinct text and how many copies follow it."""
    return (table(spark, sf, "documents").groupBy("text")
            .agg(F.min_by("source", "doc_id").alias("source"), (F.count(F.lit(1)) - 1).alias("copies")))


@query("source_health", COVERAGE + f"""uni AS (SELECT lower(source) AS source, count(*) AS n FROM {FIRST_COPY} GROUP BY 1),
c AS (SELECT s.source, coalesce(raw.n, 0) AS raw_count, coalesce(uni.n, 0) AS unified_count
  FROM spine s LEFT JOIN raw USING (source) LEFT JOIN uni USING (source))
SELECT *, CAST(greatest(0, coalesce(round_even((raw_count - unified_count) / nullif(raw_count, 0) * 100, 0), 0)) AS BIGINT) AS dedup_percent,
  CASE WHEN raw_count > 0 THEN 'ACTIVE' ELSE 'IDLE' END AS status FROM c""")
def _(spark, sf):
    return A.source_health(table(spark, sf, "documents"), first_copies(spark, sf), DOC_SOURCES)


@query("overall_dedup", f"""WITH t AS (SELECT (SELECT count(*) FROM documents) AS total_raw, count(*) AS total_unified,
  count(*) FILTER (copies > 0) AS total_merged FROM {FIRST_COPY})
SELECT *, CAST(greatest(0, round_even((total_raw - total_unified) / total_raw * 100, 0)) AS BIGINT) AS dedup_percent FROM t""")
def _(spark, sf):
    firsts = first_copies(spark, sf)
    merged = firsts.agg(F.count_if(F.col("copies") > 0).alias("merged"))
    return A.overall_dedup(table(spark, sf, "documents"), firsts, merged)


@query("merged_count", """SELECT count(*) AS merged FROM (SELECT item_id FROM conversations JOIN benchmark ON conv_id = item_id
  WHERE role = 'user' GROUP BY item_id)""")
def _(spark, sf):
    """Benchmark items as postings, the user turns of the same number as their copies."""
    from jobloom.operators.resolve import attach_links
    items = table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("job_url"), F.col("text").alias("job_title"))
    links = table(spark, sf, "conversations").filter("role = 'user'").select(
        F.col("conv_id").cast("string").alias("kept_url"), F.col("role").alias("source"),
        F.concat_ws("/", "conv_id", "turn").alias("job_url"))
    return A.merged_count(attach_links(items, links))


@query("top_locations", P + f"""SELECT coalesce(nullif(trim(location_short), ''), '{R.UNKNOWN_LOCATION}') AS location,
count(*) AS postings FROM postings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
def _(spark, sf):
    return A.top_locations(postings(spark, sf))


COMPANIES = """SELECT company_name, count(*) AS postings, max(company_logo) AS logo, max(salary) AS sample_salary{}
FROM postings WHERE company_name <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {}"""
PLACES = f"coalesce(nullif(trim(location_short), ''), '{R.UNKNOWN_SHORT}')"


@query("top_companies", P + COMPANIES.format(
    f", array_to_string(list_sort(list(DISTINCT {PLACES}))[1:2], '|') AS locations", 15))
def top_companies_query(spark, sf):
    return A.top_companies(postings(spark, sf)).withColumn("locations", F.array_join("locations", "|"))


@query("companies_pay", P + COMPANIES.format("", 8))
def _(spark, sf):
    return A.companies_pay(postings(spark, sf))


@query("facets", P + """, pairs AS (SELECT 'source' AS facet, source AS value FROM postings UNION ALL
  SELECT 'location', location_short FROM postings UNION ALL SELECT 'level', level FROM postings),
c AS (SELECT facet, value, count(*) AS postings FROM pairs WHERE value <> '' GROUP BY 1, 2)
SELECT facet, value, postings FROM c
QUALIFY facet = 'source' OR row_number() OVER (PARTITION BY facet ORDER BY postings DESC, value) <= 15""")
def _(spark, sf):
    return A.facets(postings(spark, sf))


@query("province_rollup", P + f""", j AS (SELECT {PROVINCE_SQL} AS province, nullif(trim(company_name), '') AS c FROM postings),
n AS (SELECT province, count(*) AS postings, count(DISTINCT c) AS companies FROM j GROUP BY 1),
a AS (SELECT * FROM n UNION ALL SELECT * FROM (VALUES {', '.join(f"('{h}', 0, 0)" for h in R.HUB_PROVINCES)}) h(p, x, y)
  WHERE p NOT IN (SELECT province FROM n))
SELECT province, postings, companies, round_even(postings / (SELECT greatest(count(*), 1) FROM postings) * 100, 1) AS percentage FROM a""")
def _(spark, sf):
    return A.province_rollup(postings(spark, sf), NATION_RULES).withColumns(
        {"postings": F.col("postings").cast("bigint")})


@query("location_rollup_live", P + f"""SELECT coalesce(nullif(trim(location_short), ''), '{R.UNKNOWN_LOCATION}') AS province,
count(*) AS postings, count(DISTINCT company_name) AS companies,
round(count(*) / (SELECT count(*) FROM postings) * 100, 1) AS percentage
FROM postings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40""")
def _(spark, sf):
    return A.location_rollup_live(postings(spark, sf))


def trends_sql(groups, rounding):
    hits = ", ".join(
        f"count(*) FILTER (regexp_matches(job_title, '(?i){p}') OR regexp_matches(job_description, '(?i){p}')) AS n{i}"
        for i, (_, _, p, _, _) in enumerate(groups))
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS name, '{c}' AS category, n{i} AS postings, '{s}' AS avg_salary_estimate, '{b}' AS badge, total FROM t"
        for i, (n, c, _, s, b) in enumerate(groups))
    return (D + f", t AS (SELECT count(*) AS total, {hits} FROM doc_postings), r AS ({rows}) "
            f"SELECT name, category, postings, avg_salary_estimate, badge, "
            f"least(100, CAST({rounding.format('postings / greatest(total, 1) * 100')} AS BIGINT)) AS share_percent FROM r")


@query("skill_trends", trends_sql(R.TECH_GROUPS, "round_even({}, 0)"))
def _(spark, sf):
    return A.skill_trends(document_postings(spark, sf))


@query("skill_trends_live", trends_sql(A.live_tech_groups(), "floor({} + 0.5)"))
def _(spark, sf):
    return A.skill_trends(document_postings(spark, sf), A.live_tech_groups(), half_even=False)


@query("skill_trends_custom", trends_sql(DOC_GROUPS, "round_even({}, 0)"))
def _(spark, sf):
    return A.skill_trends(document_postings(spark, sf), DOC_GROUPS)


LEVEL_HITS = ", ".join(
    f"count(*) FILTER (coalesce(level ILIKE '%{r[0].split('/')[0].strip()}%', false) "
    f"OR coalesce(job_title ILIKE '%{r[0].split('/')[0].strip()}%', false)) AS n{i}" for i, r in enumerate(LEVEL_ROWS))
LEVELS = P + f", t AS (SELECT {LEVEL_HITS} FROM postings), lv AS (" + " UNION ALL ".join(
    f"SELECT '{r[0]}' AS level, n{i} AS postings FROM t" for i, r in enumerate(LEVEL_ROWS)) + ") "
CITY_HITS = ", ".join(f"count(*) FILTER (location_short ILIKE '%{r[1]}%') AS n{i}" for i, r in enumerate(CITY_ROWS))
CITIES = P + f", t AS (SELECT {CITY_HITS} FROM postings), ct AS (" + " UNION ALL ".join(
    f"SELECT '{r[0]}' AS city, n{i} AS postings FROM t" for i, r in enumerate(CITY_ROWS)) + ") "


@query("level_counts", LEVELS + "SELECT * FROM lv")
def _(spark, sf):
    return A.level_counts(postings(spark, sf), LEVEL_ROWS)


@query("city_counts", CITIES + "SELECT * FROM ct")
def _(spark, sf):
    return A.city_counts(postings(spark, sf), CITY_ROWS)


@query("benchmark_levels", LEVELS + f"""SELECT level, pay_range, avg_vnd, note, postings
FROM (VALUES {values(LEVEL_ROWS)}) b(level, pay_range, avg_vnd, note) JOIN lv USING (level)""")
def _(spark, sf):
    counts = A.level_counts(postings(spark, sf), LEVEL_ROWS)
    return A.benchmark_join(counts, A.level_benchmarks(spark, LEVEL_ROWS), "level")


@query("benchmark_cities", CITIES + f"""SELECT city, pay_range, avg_vnd, postings
FROM (VALUES {values(CITY_ROWS)}) b(city, k, pay_range, avg_vnd) JOIN ct USING (city)""")
def _(spark, sf):
    counts = A.city_counts(postings(spark, sf), CITY_ROWS)
    return A.benchmark_join(counts, A.city_benchmarks(spark, CITY_ROWS), "city")


PROFILE = P + f""", prof AS (SELECT company_name, max(company_logo) AS logo, max(company_url) AS url, count(*) AS postings,
  max(salary) AS sample_salary, list_sort(list(DISTINCT {PLACES}))[1:3] AS locations,
  list_sort(list(DISTINCT job_title))[1:3] AS sample_titles, max(coalesce(job_requirements, '')) AS req
  FROM postings WHERE company_name <> '' GROUP BY 1),
sect AS (SELECT *, lower(company_name || ' ' || array_to_string(sample_titles, ' ') || ' ' || req) AS txt FROM prof),
profiles AS (SELECT *, {sql_first_rule('txt', SECTORS)} AS sector FROM sect) """


@query("company_profile", PROFILE + """SELECT company_name, logo, url, postings, sample_salary,
array_to_string(locations, '|') AS locations, array_to_string(sample_titles, '|') AS sample_titles, sector FROM profiles""")
def _(spark, sf):
    out = A.company_profile(postings(spark, sf), rule_list=SECTORS)
    return out.withColumns({c: F.array_join(c, "|") for c in ("locations", "sample_titles")})


@query("sector_rollup", PROFILE + """SELECT sector, CAST(sum(postings) AS BIGINT) AS postings,
CAST(round_even(sum(postings) / (SELECT count(*) FROM postings) * 100, 0) AS BIGINT) AS percentage,
array_to_string(list_sort(list(company_name))[1:4], '|') AS top_companies FROM profiles GROUP BY sector""")
def _(spark, sf):
    master = postings(spark, sf)
    out = A.sector_rollup(A.company_profile(master, rule_list=SECTORS), master)
    return out.withColumn("top_companies", F.array_join("top_companies", "|"))


@query("top_skills", P + """SELECT skill, count(*) AS job_count FROM (
  SELECT unnest(regexp_extract_all(keyword, '\\{([^}]*)\\}', 1)) AS skill FROM postings) WHERE skill <> ''
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, sf):
    return A.top_skills(postings(spark, sf))


@query("salary_by_level", P + """SELECT level, round(avg(CAST(salary AS DOUBLE)), 4) AS avg_salary, min(CAST(salary AS DOUBLE)) AS min_salary,
max(CAST(salary AS DOUBLE)) AS max_salary, count(*) AS postings FROM postings
WHERE salary IS NOT NULL AND level IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return A.salary_by_level(postings(spark, sf)).withColumn("avg_salary", F.round("avg_salary", 4))


LATEST = "job_url, source, job_title, company_name, company_url, company_logo, salary, experience, level, work_type, location_short, posted_date, deadline, keyword"


@query("latest", P + f"""SELECT {LATEST}, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM postings ORDER BY postings.created_at DESC NULLS FIRST, job_url LIMIT 8""")
def _(spark, sf):
    out = A.latest(postings(spark, sf)).drop("extra_info")
    return out.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


def run_log(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("site"), F.col("user_id").cast("string")).alias("site"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"),
        F.when(F.col("event_type") == "error", 0).otherwise(F.floor(F.col("value") / 10)).cast("bigint").alias("jobs"),
        F.col("value").alias("duration"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("Lỗi: "), F.repeat(F.col("props"), 12))).alias("message"),
        "ts", F.col("event_id").alias("seq"))


RUNS = """WITH log AS (SELECT 'site' || user_id AS site, event_type = 'error' AS failed,
  CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value / 10) AS BIGINT) END AS jobs, value AS duration,
  CASE WHEN event_type = 'error' THEN 'Lỗi: ' || repeat(props, 12) END AS message, ts, event_id FROM events),
last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY site ORDER BY ts DESC, event_id DESC) = 1),
s AS (SELECT site, CASE WHEN failed THEN 'FAILED' WHEN jobs > 0 THEN 'SUCCESS' ELSE 'WARNING' END AS status, jobs, duration,
  CASE WHEN jobs = 0 THEN left(coalesce(message, '0 jobs'), 120) END AS reason FROM last) """


@query("run_summary", RUNS + "SELECT * FROM s")
def _(spark, sf):
    return A.run_summary(run_log(spark, sf))


@query("run_totals", RUNS + """SELECT count(*) AS sites, CAST(sum(jobs) AS BIGINT) AS total_jobs,
count(*) FILTER (status = 'SUCCESS') AS succeeded, count(*) FILTER (status = 'WARNING') AS warned,
count(*) FILTER (status = 'FAILED') AS failed FROM s""")
def _(spark, sf):
    return A.run_totals(A.run_summary(run_log(spark, sf)))
