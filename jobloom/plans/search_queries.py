"""Search queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions.similarity import trigram_similarity
from jobloom.operators import search as S
from jobloom.operators.rollups import latest
from jobloom.plans.catalog import query
from jobloom.plans.rollup_queries import P
from jobloom.plans.views import postings, table
from jobloom.operators.search import SearchParams

Q = "red ring"


def sql_trigrams(expr: str) -> str:
    words = rf"list_filter(regexp_split_to_array(lower(coalesce({expr}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return (f"list_distinct(flatten(list_transform({words}, lambda w: "
            "list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))")


def sql_similarity(a: str, b: str) -> str:
    x, y = sql_trigrams(a), sql_trigrams(b)
    return (f"(CASE WHEN len(list_distinct(list_concat({x}, {y}))) = 0 THEN 0.0::DOUBLE ELSE "
            f"len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END)")


def sql_score(q: str) -> str:
    sims = " + ".join(f"{sql_similarity(c, repr(q))} * {w}::DOUBLE" for c, w in S.R.SCORE_WEIGHTS.items())
    likes = " + ".join(f"CASE WHEN {c} ILIKE '%{q}%' THEN {w}::DOUBLE ELSE 0::DOUBLE END" for c, w in S.R.SCORE_CONTAINS.items())
    return f"CAST(least(100, greatest(10, round({sims} + {likes}, 0))) AS BIGINT)"


def sql_substring(q: str) -> str:
    return "(" + " OR ".join(f"coalesce({c} ILIKE '%{q}%', false)" for c in S.R.SUBSTRING_COLUMNS) + ")"


def sql_fuzzy(q: str) -> str:
    sims = " OR ".join(f"{sql_similarity(c, repr(q))} > {t}::DOUBLE" for c, t in S.R.FUZZY_THRESHOLDS.items())
    return f"({sql_substring(q)} OR {sims})"


SHOW = ["job_url", "source", "job_title", "company_name", "salary", "location_short", "deadline", "match_score"]


@query("substring_search", P + f"SELECT job_url, job_title FROM postings WHERE {sql_substring('e_ ring')}")
def _(spark, sf):
    return postings(spark, sf).filter(S.substring_match("e_ ring")).select("job_url", "job_title")


@query("source_in", P + "SELECT source, count(*) AS postings FROM postings WHERE lower(source) IN ('1_urgent', '5_low') GROUP BY 1")
def _(spark, sf):
    return (postings(spark, sf).filter(S.source_in(" 1_URGENT, 5_low"))
            .groupBy("source").agg(F.count(F.lit(1)).alias("postings")))


@query("attribute_filters", P + """SELECT job_url FROM postings WHERE location_short ILIKE '%nation_1%' AND level ILIKE '%auto%'
AND experience ILIKE '%1_ y%' AND work_type ILIKE '%o%'""")
def _(spark, sf):
    params = SearchParams(location="nation_1", level="auto", experience="1_ y", work_type="o")
    return postings(spark, sf).filter(S.attribute_filter(params)).select("job_url")


@query("trigram_similarity", f"""SELECT p_partkey, round({sql_similarity('p_name', "p_type || ' ' || p_brand")}, 6) AS to_type,
round({sql_similarity('p_name', "'hot gears'")}, 6) AS to_text FROM part""")
def _(spark, sf):
    part = table(spark, sf, "part")
    return part.select(
        "p_partkey", F.round(trigram_similarity("p_name", F.concat("p_type", F.lit(" "), "p_brand")), 6).alias("to_type"),
        F.round(S.trigram_similarity_to("p_name", "hot gears"), 6).alias("to_text"))


@query("trigram_documents", f"""SELECT d.doc_id, round({sql_similarity('d.text', 'l.text')}, 6) AS sim
FROM documents d JOIN documents l ON l.doc_id = d.doc_id - 20""")
def _(spark, sf):
    """Every document against the one its source delivered before it, on whole texts."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    before = d.select((F.col("doc_id") + 20).alias("doc_id"), F.col("text").alias("before"))
    return d.join(before, "doc_id").select("doc_id", F.round(trigram_similarity("text", "before"), 6).alias("sim"))


@query("match_score", P + f"SELECT job_url, {sql_score(Q)} AS match_score FROM postings")
def _(spark, sf):
    return postings(spark, sf).select("job_url", S.match_score(Q).alias("match_score"))


@query("fuzzy_match", P + f"SELECT job_url FROM postings WHERE {sql_fuzzy(Q)}")
def _(spark, sf):
    return postings(spark, sf).filter(S.fuzzy_match(Q)).select("job_url")


def sorted_sql(where: str, score: str, order: str, limit: int, offset: int) -> str:
    cols = ", ".join(SHOW[:-1])
    return P + (f", hits AS (SELECT *, {score} AS match_score FROM postings WHERE {where}) "
                f"SELECT {cols}, match_score FROM hits ORDER BY {order}, job_url LIMIT {limit} OFFSET {offset}")


def page_query(params: SearchParams):
    def run(spark, sf):
        return S.page_of(S.matching(postings(spark, sf), params), params).select(*SHOW)
    return run


LATEST = "created_at DESC NULLS FIRST"
BY_SCORE = SearchParams(q=Q, limit=30)
query("sort_similarity", sorted_sql(sql_fuzzy(Q), sql_score(Q), f"match_score DESC, {LATEST}", 30, 0))(page_query(BY_SCORE))
query("sort_deadline", sorted_sql("true", "CAST(0 AS BIGINT)", f"deadline ASC NULLS LAST, {LATEST}", 100, 0))(
    page_query(SearchParams(sort_by="deadline", limit=500)))
query("sort_title", sorted_sql("level ILIKE '%auto%'", "CAST(0 AS BIGINT)", "job_title ASC NULLS LAST", 40, 0))(
    page_query(SearchParams(sort_by="title", level="auto", limit=40)))
query("sort_latest", sorted_sql("true", "CAST(0 AS BIGINT)", LATEST, 12, 0))(page_query(SearchParams(sort_by="similarity")))
query("paginate", sorted_sql("true", "CAST(0 AS BIGINT)", LATEST, 25, 75))(page_query(SearchParams(page=4, limit=25)))

FULL = SearchParams(q=Q, source="1_urgent,2_high", location="nation", page=2, limit=10)
FULL_WHERE = f"lower(source) IN ('1_urgent', '2_high') AND coalesce(location_short ILIKE '%nation%', false) AND {sql_fuzzy(Q)}"


@query("search_page", sorted_sql(FULL_WHERE, sql_score(Q), f"match_score DESC, {LATEST}", 10, 10))
def _(spark, sf):
    return S.search(postings(spark, sf), FULL)[0].select(*SHOW)


@query("search_totals", P + f"""SELECT count(*) AS total, CAST(2 AS BIGINT) AS page, CAST(10 AS BIGINT) AS page_size,
CAST(ceil(count(*) / 10) AS BIGINT) AS total_pages FROM postings WHERE {FULL_WHERE}""")
def _(spark, sf):
    return S.search(postings(spark, sf), FULL)[1]


@query("search_facets", P + """, pairs AS (SELECT 'source' AS facet, source AS value FROM postings UNION ALL
  SELECT 'location', location_short FROM postings UNION ALL SELECT 'level', level FROM postings),
c AS (SELECT facet, value, count(*) AS postings FROM pairs WHERE value <> '' GROUP BY 1, 2)
SELECT facet, value, postings FROM c
QUALIFY facet = 'source' OR row_number() OVER (PARTITION BY facet ORDER BY postings DESC, value) <= 10""")
def _(spark, sf):
    return S.search(postings(spark, sf), FULL)[2]


@query("lookup_by_key", P + "SELECT job_url, source, job_title, company_name FROM postings WHERE job_url = 'https://jobs.example/77'")
def _(spark, sf):
    found = S.lookup_by_key(postings(spark, sf), "https%3A%2F%2Fjobs.example%2F77")
    return found.select("job_url", "source", "job_title", "company_name")


@query("raw_listing", P + f"SELECT job_url, source, job_title FROM postings ORDER BY {LATEST}, job_url LIMIT 50")
def _(spark, sf):
    return latest(postings(spark, sf), 50, None).select("job_url", "source", "job_title")
