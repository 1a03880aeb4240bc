"""Dashboard queries, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom import rules as R
from jobloom.operators import dashboard as C
from jobloom.operators import rollups as A
from jobloom.plans.catalog import query
from jobloom.plans.rollup_queries import COVERAGE, DOC_GROUPS, DOC_SOURCES, FIRST_COPY, first_copies, trends_sql
from jobloom.plans.views import document_postings, table


@query("filter_trends", f"SELECT name, category, postings FROM ({trends_sql(DOC_GROUPS, 'round_even({}, 0)')}) WHERE category = 'Other' AND contains(lower(name), 'git')")
def _(spark, sf):
    trends = A.skill_trends(document_postings(spark, sf), DOC_GROUPS)
    return C.filter_trends(trends, "Other", "GIT").select("name", "category", "postings")


SHARE = COVERAGE + f"""uni AS (SELECT lower(source) AS source, count(*) AS n FROM {FIRST_COPY} WHERE source <> 'src3' GROUP BY 1),
cov AS (SELECT s.source, coalesce(raw.n, uni.n, 0) AS r, coalesce(uni.n, 0) AS u FROM spine s LEFT JOIN raw USING (source) LEFT JOIN uni USING (source)),
sh AS (SELECT source, CASE WHEN u <> 0 THEN u ELSE r END AS postings FROM cov),
tot AS (SELECT sum(n) AS total FROM uni),
pc AS (SELECT source, postings, floor(postings / total * 1000 + 0.5) / 10 AS percentage FROM sh, tot) """


def shares(spark, sf):
    master = first_copies(spark, sf).filter("source <> 'src3'")
    return C.source_share(A.source_coverage(table(spark, sf, "documents"), master, DOC_SOURCES), A.total_count(master))


@query("source_share", SHARE + "SELECT * FROM pc")
def _(spark, sf):
    return shares(spark, sf)


@query("source_share_whole", SHARE + """SELECT source, u AS postings,
  CAST(CASE WHEN total > 0 THEN floor(u / total * 100 + 0.5) ELSE 0 END AS BIGINT) AS percentage FROM cov, tot""")
def _(spark, sf):
    master = first_copies(spark, sf).filter("source <> 'src3'")
    coverage = A.source_coverage(table(spark, sf, "documents"), master, DOC_SOURCES)
    return C.whole_source_share(coverage, A.total_count(master))


def tier_sql(expr, steps, floor):
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {expr} >= {a} THEN {quote(v)}" for a, v in steps) + f" ELSE {quote(floor)} END"


@query("heat_tier", SHARE + f"SELECT source, {tier_sql('percentage * 4', R.HEAT_TIERS, R.HEAT_FLOOR)} AS tag FROM pc")
def _(spark, sf):
    return shares(spark, sf).select("source", C.heat_tier(F.col("percentage") * 4).alias("tag"))


BY_NATION = """n AS (SELECT n_name AS province, n_regionkey, count(*) AS postings, count(DISTINCT c_mktsegment) AS companies,
  floor(count(*) / (SELECT count(*) FROM customer) * 1000 + 0.5) / 10 AS percentage
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) """


def nations(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    total = table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("total"))
    counts = c.groupBy(F.col("n_name").alias("province")).agg(
        F.count(F.lit(1)).alias("postings"), F.count_distinct("c_mktsegment").alias("companies"))
    return counts.join(F.broadcast(total), F.lit(True)).select(
        "province", "postings", "companies", (C.half_up(F.col("postings") / F.col("total") * 1000) / 10).alias("percentage"))


@query("top_provinces", "WITH " + BY_NATION + "SELECT province, postings, percentage FROM n WHERE province NOT IN ('NATION_0', 'NATION_7') ORDER BY postings DESC, province LIMIT 10")
def _(spark, sf):
    return C.top_provinces(nations(spark, sf), 10, ["NATION_0", "NATION_7"]).select("province", "postings", "percentage")


@query("top_provinces_few", "WITH " + BY_NATION + "SELECT province, postings FROM n WHERE province NOT IN ('NATION_1', 'NATION_2', 'NATION_3') ORDER BY postings DESC, province LIMIT 6")
def _(spark, sf):
    return C.top_provinces(nations(spark, sf), 6, ["NATION_1", "NATION_2", "NATION_3"]).select("province", "postings")


def nation_nodes(spark, sf):
    """Map nodes for the nations: some named as in the figures, some known by an alias."""
    t = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    name = F.when(k % 3 == 0, F.initcap("n_name")).otherwise(F.concat(F.lit("Node "), k.cast("string")))
    aliases = F.when(k % 3 == 1, F.array(F.lit("nowhere"), F.lower("n_name"), F.lit("nation_0"))).otherwise(F.array(F.lit("x")))
    return t.select(name.alias("name"), F.col("r_name").alias("region"), k.cast("double").alias("lat"),
                    (k * 2).cast("double").alias("lng"), aliases.alias("aliases"))


NODES = """, nodes AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'Nation_' || n_nationkey ELSE 'Node ' || n_nationkey END AS name, r_name AS region,
  CAST(n_nationkey AS DOUBLE) AS lat, CAST(n_nationkey * 2 AS DOUBLE) AS lng,
  CASE WHEN n_nationkey % 3 < 2 THEN n_name END AS known FROM nation JOIN region ON n_regionkey = r_regionkey),
geo AS (SELECT name, region, lat, lng, coalesce(postings, 0) AS postings, coalesce(companies, 0) AS companies, coalesce(percentage, 0)::DOUBLE AS percentage
  FROM nodes LEFT JOIN n ON n.province = nodes.known) """


@query("geo_enrich", "WITH " + BY_NATION + NODES + "SELECT * FROM geo")
def _(spark, sf):
    return C.geo_enrich(nation_nodes(spark, sf), nations(spark, sf))


@query("geo_enrich_provinces")
def _(spark, sf):
    """The built-in map nodes with the provinces found in the documents."""
    docs = document_postings(spark, sf).withColumn("location_short", F.col("job_description"))
    return C.geo_enrich(C.geo_nodes(spark), A.province_rollup(docs))


@query("region_filter", "WITH " + BY_NATION + NODES + "SELECT name, postings FROM geo WHERE region = 'ASIA'")
def _(spark, sf):
    return C.region_filter(C.geo_enrich(nation_nodes(spark, sf), nations(spark, sf)), "ASIA").select("name", "postings")


@query("region_rollup", "WITH " + BY_NATION + NODES + "SELECT region, count(*) AS nodes, CAST(sum(postings) AS BIGINT) AS postings, CAST(sum(companies) AS BIGINT) AS companies FROM geo GROUP BY 1")
def _(spark, sf):
    return C.region_rollup(C.geo_enrich(nation_nodes(spark, sf), nations(spark, sf)))


@query("size_tier", "WITH " + BY_NATION + NODES + f"SELECT name, CAST({tier_sql('postings', R.SIZE_TIERS, R.SIZE_FLOOR)} AS BIGINT) AS size FROM geo")
def _(spark, sf):
    return C.geo_enrich(nation_nodes(spark, sf), nations(spark, sf)).select("name", C.size_tier("postings").alias("size"))


# ---- roles: part types with prices in hundreds ------------------------------------------

ROLES = """roles AS (SELECT p_type AS role, min(p_retailprice / 100) AS mn, round(avg(p_retailprice / 100), 4) AS av, max(p_retailprice / 100) AS mx,
  count(*) AS n, list_sort(list(DISTINCT p_brand)) AS techs FROM part GROUP BY 1) """


def roles(spark, sf, tech=False):
    return C.role_table(table(spark, sf, "part"), F.col("p_type"), F.col("p_retailprice") / 100,
                        F.col("p_brand") if tech else None)


def up(e):
    return f"CAST(floor({e} + 0.5) AS BIGINT)"


BANDS = {"fresher_min": up("mn * 0.7"), "fresher_max": up("mn * 1.1"), "middle_min": up("av * 0.75"), "middle_max": up("av * 1.15"),
         "senior_min": up("av * 1.15"), "senior_max": up("mx * 0.95"), "lead_min": up("mx * 0.9"), "lead_max": up("mx * 1.35")}
MEANS = {b: f"round(({BANDS[b + '_min']} + {BANDS[b + '_max']}) / 2, 1)" for b in ("fresher", "senior", "lead")}
MEANS["middle"] = "round(av, 1)"


def cols(d):
    return ", ".join(f"{v} AS {k}" for k, v in d.items())


@query("role_bands", "WITH " + ROLES + f"SELECT role, mn AS min_pay, av AS avg_pay, mx AS max_pay, n AS postings, {cols(BANDS)}, {cols({k + '_avg': v for k, v in MEANS.items()})} FROM roles")
def _(spark, sf):
    return C.role_bands(roles(spark, sf))


@query("role_bands_overview", "WITH " + ROLES + "SELECT role, " + cols({
    "fresher_min": up("mn * 0.7"), "fresher_max": up("mn * 1.1"), "fresher_avg": up("mn * 0.9"),
    "middle_min": up("av * 0.75"), "middle_max": up("av * 1.15"), "middle_avg": up("av * 0.95"),
    "senior_min": up("av * 1.15"), "senior_max": up("mx * 0.95"), "senior_avg": up("mx * 0.7"),
    "lead_min": up("mx * 0.9"), "lead_max": up("mx * 1.3"), "lead_avg": up("mx * 1.1")}) + " FROM roles")
def _(spark, sf):
    return C.role_bands_overview(roles(spark, sf))


LEVELS = [r[0] for r in R.LEVEL_BENCHMARKS]
SPLIT = []
for i, (level, (share, least)) in enumerate(zip(LEVELS, R.LEVEL_SPLIT)):
    band = ["fresher", None, "middle", "senior", "lead"][i]
    lo, hi, mean = ((up("av * 0.6"), up("av * 0.85"), f"CAST({up('av * 0.72')} AS DOUBLE)") if band is None
                    else (BANDS[band + "_min"], BANDS[band + "_max"], MEANS[band]))
    SPLIT.append(f"SELECT role, '{level}' AS level, greatest({least}, {up(f'n * {share}')}) AS postings, {lo} AS band_min, {hi} AS band_max, {mean} AS band_avg FROM roles")


@query("role_level_split", "WITH " + ROLES + " UNION ALL ".join(SPLIT))
def _(spark, sf):
    return C.role_level_split(roles(spark, sf), LEVELS)


@query("city_scale", "WITH " + ROLES + " UNION ALL ".join(
    f"SELECT role, '{c}' AS city, floor(av * {f}::DOUBLE * 10 + 0.5) / 10 AS avg_pay, {up(f'mn * {f}')} AS min_pay, {up(f'mx * {f}')} AS max_pay, "
    f"greatest(1, {up(f'n * {s}')}) AS postings FROM roles" for c, f, s in R.CITY_SPLIT))
def _(spark, sf):
    return C.city_scale(roles(spark, sf))


@query("search_roles", "WITH " + ROLES + "SELECT role, n AS postings FROM roles WHERE contains(lower(role), 'mall') OR len(list_filter(techs, lambda t: contains(lower(t), 'brand#2'))) > 0")
def _(spark, sf):
    return C.search_roles(roles(spark, sf, tech=True), " Mall").unionByName(
        C.search_roles(roles(spark, sf, tech=True), "BRAND#2")).select("role", "postings").distinct()


@query("percent_of_max", """SELECT p_partkey, CAST(least(100, floor(p_retailprice / 20 / greatest(max(p_retailprice / 20) OVER (PARTITION BY p_type), 60) * 100 + 0.5)) AS BIGINT) AS bar,
CAST(least(100, floor(p_retailprice / 20 / 80 * 100 + 0.5)) AS BIGINT) AS fixed_bar FROM part""")
def _(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_type", (F.col("p_retailprice") / 20).alias("pay"))
    return C.percent_of_max(parts, "pay", ["p_type"]).select("p_partkey", "bar", C.percent_of_fixed("pay").alias("fixed_bar"))


# ---- tracked postings -------------------------------------------------------------------

STATUS_OF = [("click", "saved"), ("view", "applied"), ("purchase", "offered"), ("error", "removed")]
STATUS_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STATUS_OF) + " ELSE 'interviewing' END"


def tracker_columns(events):
    status = None
    for kind, value in STATUS_OF:
        hit = F.col("event_type") == kind
        status = F.when(hit, value) if status is None else status.when(hit, value)
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id", "user_id", F.concat(F.lit("job"), (k % 10).cast("string")).alias("job_url"),
        status.otherwise("interviewing").alias("status"), F.when(k % 3 == 0, F.col("props")).otherwise("").alias("notes"), "ts")


TRACK = f"""WITH e AS (SELECT event_id, ts, user_id, 'job' || (CAST(json_extract(props, '$.k') AS INT) % 10) AS job_url, {STATUS_CASE} AS status,
  CASE WHEN CAST(json_extract(props, '$.k') AS INT) % 3 = 0 THEN props ELSE '' END AS notes FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, job_url ORDER BY ts, event_id) AS pos FROM e),
r AS (SELECT user_id, job_url, coalesce(max(pos) FILTER (status = 'removed'), 0) AS gone, max(pos) AS last FROM o GROUP BY 1, 2),
st AS (SELECT o.user_id, o.job_url, arg_max(status, pos) AS status, min(ts) AS saved_at, coalesce(arg_max(notes, pos) FILTER (notes <> ''), '') AS notes
  FROM o JOIN r ON o.user_id = r.user_id AND o.job_url = r.job_url WHERE pos > gone GROUP BY 1, 2) """


def tracker(spark, sf):
    return C.tracker_state(tracker_columns(table(spark, sf, "events")))


SAVED_AT = "strftime(saved_at, '%Y-%m-%d %H:%M:%S')"


@query("tracker_state", TRACK + f"SELECT user_id, job_url, status, {SAVED_AT} AS saved_at, notes FROM st")
def _(spark, sf):
    return tracker(spark, sf).withColumn("saved_at", F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss"))


@query("tracker_newest", TRACK + "SELECT user_id, job_url, status FROM st ORDER BY saved_at DESC, user_id, job_url LIMIT 20")
def _(spark, sf):
    return C.newest_saved(tracker(spark, sf), 20).select("user_id", "job_url", "status")


@query("tracker_counts", TRACK + "SELECT 'all' AS status, count(*) AS postings FROM st" + "".join(
    f" UNION ALL SELECT '{s}', count(*) FILTER (status = '{s}') FROM st" for s in R.TRACKER_STATES))
def _(spark, sf):
    return C.tracker_counts(tracker(spark, sf))


@query("tracker_filter", TRACK + "SELECT user_id, job_url FROM st WHERE status = 'applied'")
def _(spark, sf):
    return C.tracker_filter(tracker(spark, sf), "applied").select("user_id", "job_url")
