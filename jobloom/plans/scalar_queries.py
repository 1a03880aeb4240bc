"""Normalisation expressions applied to whole tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom import rules as R
from jobloom.functions import text as X
from jobloom.plans.catalog import query
from jobloom.plans.rollup_queries import sql_first_rule
from jobloom.plans.views import table


@query("sanitize_name", "SELECT o_orderkey, regexp_replace(lower(trim(o_orderpriority)), '[^a-zA-Z0-9_]', '_', 'g') AS name FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.sanitize_name("o_orderpriority").alias("name"))


@query("salary_text", """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_brand
  WHEN p_size % 4 = 1 THEN format('{:,}', p_partkey * 1000 + 5) || ' - ' || format('{:,}', p_partkey * 1500 + 7) || ' USD'
  WHEN p_size % 4 = 2 THEN 'Từ ' || format('{:,}', p_partkey * 1000 + 5) || ' VND' ELSE 'Thỏa thuận' END AS salary FROM part""")
def _(spark, sf):
    m, k = F.col("p_size") % 4, F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", X.salary_text(
        F.when(m == 0, F.col("p_brand")).when(m == 1, "0").when(m == 2, "Thương lượng"),
        F.when(m != 3, k * 1000 + 5), F.when(m == 1, k * 1500 + 7), F.when(m == 1, "USD")).alias("salary"))


@query("salary_text_millions", """WITH o AS (SELECT o_orderkey, o_totalprice * 100 AS lo, o_totalprice * 12345 AS hi, o_orderkey % 4 AS m FROM orders)
SELECT o_orderkey, CASE m WHEN 0 THEN 'Thoả thuận'
  WHEN 1 THEN printf('%g', lo / 1000000) || ' - ' || printf('%g', hi / 1000000) || ' triệu VND'
  WHEN 2 THEN 'Từ ' || printf('%g', lo / 1000000) || ' triệu VND' ELSE 'Tới ' || printf('%g', hi / 1000000) || ' triệu VND' END AS salary FROM o""")
def _(spark, sf):
    m, price = F.col("o_orderkey") % 4, F.col("o_totalprice")
    low, high = F.when(m.isin(1, 2), price * 100), F.when(m.isin(1, 3), price * 12345)
    return table(spark, sf, "orders").select("o_orderkey", X.salary_text_millions(low, high).alias("salary"))


@query("epoch_to_date", """SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE strftime(ts, '%d/%m/%Y') END AS day FROM events""")
def _(spark, sf):
    seconds = F.when(F.col("event_type") == "view", "n/a").otherwise(F.unix_timestamp("ts").cast("string"))
    return table(spark, sf, "events").select("event_id", X.epoch_to_date(seconds).alias("day"))


@query("parse_date", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def _(spark, sf):
    s = F.col("o_orderstatus")
    shown = F.when(s == "O", F.date_format("o_orderdate", "dd/MM/yyyy")).when(
        s == "F", F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise("3 days left")
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(X.parse_date(shown), "yyyy-MM-dd").alias("day"))


def places(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    place = lambda a, p: F.struct(a.alias("address"), p.alias("province_name"))
    name, nation = F.col("c_name"), F.col("n_name")
    many = F.array(place(name, nation), place(F.lit(""), F.col("c_mktsegment")), place(F.lit(None).cast("string"), nation))
    return c.withColumn("places", F.when(F.col("c_custkey") % 5 != 0, many))


@query("join_locations", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Toàn quốc' WHEN n_name < c_mktsegment THEN n_name || ', ' || c_mktsegment ELSE c_mktsegment || ', ' || n_name END AS location_short,
CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS workplace FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, sf):
    short, detail = X.join_locations("places")
    return places(spark, sf).select("c_custkey", short.alias("location_short"), detail.alias("workplace"))


@query("pick_location", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN n_name WHEN c_custkey % 3 = 1 THEN c_name ELSE c_mktsegment END AS location
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, sf):
    k = F.col("c_custkey") % 3
    first = F.struct(F.when(k == 0, F.col("n_name")).otherwise("").alias("cityName"), F.when(k == 1, F.col("c_name")).alias("address"))
    return places(spark, sf).select("c_custkey", X.pick_location(F.array(first), "c_mktsegment").alias("location"))


@query("normalize_province", f"SELECT doc_id, {sql_first_rule('lower(trim(text))', R.PROVINCE_RULES, repr(R.UNKNOWN_LOCATION))} AS province FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalize_province("text").alias("province"))


@query("infer_sector", f"SELECT doc_id, {sql_first_rule('lower(source || chr(32) || text || chr(32))', R.SECTOR_RULES)} AS sector FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.infer_sector("source", "text", F.lit(None).cast("string")).alias("sector"))


@query("space_units", """SELECT o_orderkey, o_custkey || CASE WHEN o_orderstatus = 'O' THEN ' NĂM' WHEN o_orderstatus = 'F' THEN ' tháng' ELSE 'y' END || ' kinh nghiệm' AS experience FROM orders""")
def _(spark, sf):
    s = F.col("o_orderstatus")
    unit = F.when(s == "O", "NĂM").when(s == "F", "   tháng").otherwise("y")
    raw = F.concat(F.col("o_custkey").cast("string"), unit, F.lit(" kinh nghiệm"))
    return table(spark, sf, "orders").select("o_orderkey", X.space_units(raw).alias("experience"))


@query("work_type_code", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Toàn thời gian' ELSE 'Bán thời gian' END AS work_type FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.work_type_code("o_orderstatus", "F").alias("work_type"))


@query("display_default", "SELECT c_custkey, coalesce(nullif(trim(CASE c_nationkey WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE ' ' || c_mktsegment END), ''), 'Chưa rõ') AS shown FROM customer")
def _(spark, sf):
    n = F.col("c_nationkey")
    raw = F.when(n == 1, "  ").when(n == 2, None).otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", X.display_default(raw, R.UNKNOWN_SHORT).alias("shown"))


@query("parse_salary", """WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS m, CAST(o_custkey * 1000 + 500 AS DOUBLE) AS lo, CAST(o_custkey * 2000 + 999 AS DOUBLE) AS hi,
  CAST(o_custkey AS DOUBLE) AS c FROM orders)
SELECT o_orderkey, CASE m WHEN 0 THEN lo WHEN 1 THEN lo WHEN 2 THEN c * 1000000 WHEN 5 THEN c END AS low,
  CASE m WHEN 0 THEN hi WHEN 2 THEN (c + 0.5) * 1000000 WHEN 3 THEN c * 1000000 WHEN 5 THEN c END AS high,
  CASE m WHEN 4 THEN NULL WHEN 0 THEN 'USD' ELSE 'VND' END AS currency,
  CASE m WHEN 4 THEN NULL WHEN 5 THEN 'year' ELSE 'month' END AS period FROM o""")
def _(spark, sf):
    m, c = F.col("o_orderkey") % 6, F.col("o_custkey")
    low, high = c * 1000 + 500, c * 2000 + 999
    plain = c.cast("string")
    shown = (F.when(m == 0, X.salary_text(F.lit(None).cast("string"), low, high, F.lit("USD")))
             .when(m == 1, X.salary_text(F.lit("0"), low, F.lit(None).cast("bigint"), F.lit("VND")))
             .when(m == 2, F.concat(plain, F.lit(" - "), plain, F.lit(".5 triệu VND")))
             .when(m == 3, F.concat(F.lit("Tới "), plain, F.lit(" triệu VND")))
             .when(m == 4, "Thoả thuận").otherwise(F.concat(plain, F.lit(" /năm"))))
    o = table(spark, sf, "orders").withColumn("p", X.parse_salary(shown))
    return o.select("o_orderkey", F.col("p.min").alias("low"), F.col("p.max").alias("high"), "p.currency", "p.period")


@query("text_after_label", """SELECT doc_id, CASE WHEN lang = 'de' AND length(text) + 4 >= 250 THEN NULL
  WHEN lang = 'de' THEN regexp_replace('- ' || text || ' -', '^[- ]+|[- ]+$', '', 'g') ELSE lang || ' / ' || n_chars END AS working_time FROM documents""")
def _(spark, sf):
    value = F.when(F.col("lang") == "de", F.col("text")).otherwise(
        F.concat("lang", F.lit(" / "), F.col("n_chars").cast("string")))
    raw = F.concat("text", F.lit("\nTHỜI GIAN làm việc : - "), value, F.lit(" -"))
    return table(spark, sf, "documents").select("doc_id", X.text_after_label(raw).alias("working_time"))


SQL_WHITE_SPACE = " || ".join(f"chr({ord(c)})" for c in X.WHITE_SPACE)


@query("join_nonempty", f"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, '.'),
  lambda x: trim(x, {SQL_WHITE_SPACE})), lambda x: x <> ''), ' • ') AS joined FROM conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", X.join_nonempty(F.split("text", r"\."), " • ").alias("joined"))
