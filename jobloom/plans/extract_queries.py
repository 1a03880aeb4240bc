"""Page extraction queries, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom import rules as R
from jobloom.functions import text as X
from jobloom.operators import extract as E
from jobloom.plans.catalog import query
from jobloom.plans.rollup_queries import sql_first_rule
from jobloom.plans.views import table
from jobloom.sources.readers import first_visit


def sql_html(expr: str, sep: str = "chr(10)") -> str:
    """html_to_text in SQL, pattern by pattern."""
    t = f"coalesce({expr}, '')"
    t = f"regexp_replace({t}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?s)<[^>]*>', chr(10), 'g')"
    for entity, char in X.ENTITIES:
        t = f"replace({t}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    t = rf"regexp_replace({t}, '[ \t\r\f\x{{A0}}]+', ' ', 'g')"
    t = rf"regexp_replace({t}, ' ?\n[ \n]*', chr(10), 'g')"
    t = rf"regexp_replace({t}, '^[ \n]+|[ \n]+$', '', 'g')"
    return t if sep == "chr(10)" else f"replace({t}, chr(10), {sep})"


def sql_contains(expr: str, needles) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{n}')" for n in needles) + ")"


def pages(spark, sf):
    return table(spark, sf, "pages")


@query("html_to_text", f"SELECT page_id, md5({sql_html('html')}) AS text_md5, length({sql_html('html')}) AS chars FROM pages")
def _(spark, sf):
    text = X.html_to_text("html")
    return pages(spark, sf).select("page_id", F.md5(text).alias("text_md5"), F.length(text).cast("bigint").alias("chars"))


@query("html_to_text_exact")
def _(spark, sf):
    return pages(spark, sf).select("page_id", F.md5(E.html_to_text_exact("html")).alias("text_md5"))


LINK = "^/[a-z].*"
AREA = r'<li><a href="(/[^"]*[.])"'


@query("extract_links", r"""WITH p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root,
  list_filter(regexp_extract_all(html, '<li><a href="(/[^"]*[.])"', 1), lambda h: regexp_matches(h, '^/[a-z]')) AS area,
  list_filter(regexp_extract_all(html, '<a[^>]*\shref="([^"]*)"', 1), lambda h: regexp_matches(h, '^/[a-z]')) AS whole FROM pages),
l AS (SELECT page_id, root, CASE WHEN len(area) > 0 THEN area ELSE whole END AS links FROM p),
d AS (SELECT page_id, root, list_filter(links, lambda x, i: list_position(links, x) = i) AS links FROM l)
SELECT page_id, CAST(unnest(range(len(links))) AS INTEGER) AS pos, root || regexp_replace(unnest(links), '[?#].*$', '') AS link FROM d""")
def _(spark, sf):
    return E.extract_links(pages(spark, sf), LINK, AREA, keep=["page_id"])


@query("canonical_url", r"""SELECT page_id, regexp_replace(trim(url), '[?#].*$', '') AS clean,
  regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || '/a/b' AS rooted,
  regexp_extract(url, '^([A-Za-z]+:)//', 1) || '//cdn.example/x' AS schemed FROM pages""")
def _(spark, sf):
    return pages(spark, sf).select(
        "page_id", X.canonical_url("url").alias("clean"),
        X.canonical_url(F.lit("/a/b?c=d"), "url").alias("rooted"),
        X.canonical_url(F.lit("//cdn.example/x#y"), "url").alias("schemed"))


@query("unwrap_image_url", "SELECT page_id, url AS inner_url, 'http://p.example/plain.png' AS plain FROM pages")
def _(spark, sf):
    wrapped = F.concat(F.lit("https://cdn.example/unsafe/80x/"), "url")
    return pages(spark, sf).select("page_id", X.unwrap_image_url(wrapped).alias("inner_url"),
                                   X.unwrap_image_url(F.lit("http://p.example/plain.png")).alias("plain"))


LABELS = ["Mức lương:", "Địa điểm làm việc", "KINH NGHIỆM", "Hạn nộp hồ sơ", "Cấp bậc", "Ngày đăng", "Khác"]
LABEL_CASE = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(LABELS))
FIELD_RULES = [(needles, field) for field, needles in R.LABEL_SYNONYMS]


@query("label_value_fields", f"""WITH p AS (SELECT conv_id, turn, text, role, CASE turn % 7 {LABEL_CASE} END AS label FROM conversations),
f AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE role END AS v, {sql_first_rule('lower(label)', FIELD_RULES)} AS field FROM p)
SELECT conv_id, {', '.join(f"arg_max(v, turn) FILTER (field = '{f}') AS {f}" for f, _ in R.LABEL_SYNONYMS)} FROM f WHERE field IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    labels = F.array(*[F.lit(v) for v in LABELS])
    pairs = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.get(labels, (F.col("turn") % 7).cast("int")).alias("label"), F.col("text").alias("value"),
        F.when(F.col("role") != "user", F.col("role")).otherwise("").alias("title"))
    return E.label_value_fields(pairs, "conv_id", order="turn", title="title")


SECTIONS = [("job_description", [" the ", " and "]), ("job_requirements", ["en", "er"]), ("benefits", ["a"])]
SECTION_RULES = [(needles, field) for field, needles in SECTIONS]
ITEM = "list_filter(list_transform(regexp_extract_all(content, '(?is)<{0}[^>]*>(.*?)</{0}>', 1), lambda x: {1}), lambda x: x <> '')"
LI, PARA = (ITEM.format(t, sql_html("x", "' '")) for t in ("li", "p"))


@query("section_text", f"""WITH c AS (SELECT page_id, regexp_split_to_array(html, '(?i)<h[1-6][^>]*>') AS chunks FROM pages),
s AS (SELECT page_id, unnest(range(1, len(chunks))) AS pos, unnest(chunks[2:]) AS chunk FROM c),
h AS (SELECT page_id, pos, {sql_html("regexp_extract(chunk, '(?is)^(.*?)</h[1-6]>', 1)", "' '")} AS heading,
  regexp_replace(chunk, '(?is)^(.*?)</h[1-6]>', '') AS content FROM s),
t AS (SELECT page_id, pos, {sql_first_rule('lower(heading)', SECTION_RULES)} AS field,
  CASE WHEN len({LI}) > 0 THEN array_to_string({LI}, chr(10)) WHEN len({PARA}) > 0 THEN array_to_string({PARA}, chr(10))
    ELSE {sql_html('content')} END AS txt FROM h)
SELECT p.page_id, {', '.join(f"md5(coalesce(arg_min(txt, pos) FILTER (field = '{f}' AND txt <> ''), '')) AS {f}" for f, _ in SECTIONS)}
FROM pages p LEFT JOIN t USING (page_id) GROUP BY 1""")
def _(spark, sf):
    out = E.section_text(pages(spark, sf), synonyms=SECTIONS)
    return out.select("page_id", *[F.md5(f).alias(f) for f, _ in SECTIONS])


TAGS = "list_filter(list_transform(regexp_extract_all(html, '(?is)<a[^>]*>([^<]*)</a>', 1), lambda x: trim(replace(x, ',', ''))), lambda x: x <> '')"


@query("keyword_tags", f"""WITH t AS (SELECT page_id, {TAGS} AS t FROM pages),
d AS (SELECT page_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS t FROM t)
SELECT page_id, coalesce(array_to_string(list_transform(t, lambda x: '{{' || x || '}}'), ' '), '') AS keyword, len(t) AS tags FROM d""")
def _(spark, sf):
    encoded = E.keyword_tags("html")
    return pages(spark, sf).select("page_id", encoded.alias("keyword"),
                                   F.size(X.decode_tags(encoded)).cast("bigint").alias("tags"))


@query("title_fallback", rf"""SELECT page_id, CASE page_id % 4
  WHEN 0 THEN regexp_extract(html, '(?is)<h1[^>]*>([^<]*)</h1>', 1)
  WHEN 1 THEN trim(regexp_extract('Recruiting ' || regexp_extract(html, '(?is)<title>([^<]*)</title>', 1) || ' at Acme | x', '{R.RECRUITING_TITLE}', 1))
  WHEN 2 THEN trim(replace(url, '{R.RECRUITING_WORDS}', '')) ELSE 'card ' || page_id END AS title FROM pages""")
def _(spark, sf):
    inner = F.regexp_extract("html", r"(?is)<title>([^<]*)</title>", 1)
    k = F.col("page_id") % 4
    heading = F.when(k == 0, F.regexp_extract("html", r"(?is)<h1[^>]*>([^<]*)</h1>", 1)).otherwise("")
    meta = (F.when(k == 1, F.concat(F.lit("Recruiting "), inner, F.lit(" at Acme | x")))
            .when(k == 2, F.concat(F.lit(R.RECRUITING_WORDS + " "), "url", F.lit(" | Acme"))).otherwise(""))
    return pages(spark, sf).select("page_id", E.title_fallback(heading, meta, F.concat(
        F.lit("card "), F.col("page_id").cast("string"))).alias("title"))


SPANS = [("location_short", ["the", "de "]), ("level", ["in", "en"]), ("experience", ["a"])]
SPAN_SQL = sql_first_rule("lower(s)", [(n, f) for f, n in SPANS])


@query("classify_spans", f"""WITH s AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, trim(unnest(string_split(text, chr(10)))) AS s FROM documents),
t AS (SELECT doc_id, pos, s, {SPAN_SQL} AS cls FROM s WHERE s <> '' AND length(s) <= 60)
SELECT d.doc_id, {', '.join(f"coalesce(arg_min(s, pos) FILTER (cls = '{f}'), '') AS {f}" for f, _ in SPANS)}
FROM documents d LEFT JOIN t USING (doc_id) GROUP BY 1""")
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumn("spans", F.transform(F.split("text", "\n"), lambda x: F.trim(x)))
    return docs.select("doc_id", *[v.alias(k) for k, v in E.classify_spans("spans", SPANS).items()])


@query("drop_closed_postings", f"""SELECT doc_id FROM (SELECT doc_id, CASE WHEN lang = 'de' AND n_chars % 5 = 0 THEN '' WHEN n_chars % 7 = 0 THEN 'Tin KHÔNG tồn tại' ELSE text || n_chars END AS t FROM documents)
WHERE t <> '' AND NOT {sql_contains('lower(t)', R.CLOSED_MARKERS)}""")
def _(spark, sf):
    n = F.col("n_chars")
    title = (F.when((F.col("lang") == "de") & (n % 5 == 0), "").when(n % 7 == 0, "Tin KHÔNG tồn tại")
             .otherwise(F.concat("text", n.cast("string"))))
    return E.drop_closed(table(spark, sf, "documents").withColumn("title", title), "title").select("doc_id")


QUALITY = ["ntent", "ouque", "verlich", "hentes"]


@query("page_quality_flag", f"""SELECT page_id, {sql_contains('left(lower(html), 3000)', QUALITY)} OR page_id % 50 = 3 AS in_window,
{sql_contains('lower(html)', QUALITY)} AS anywhere, length(html) <= 1000 AS too_short FROM pages""")
def _(spark, sf):
    status = F.when(F.col("page_id") % 50 == 3, 403).otherwise(200)
    return pages(spark, sf).select(
        "page_id", E.page_blocked("html", QUALITY, status=status).alias("in_window"),
        E.page_blocked("html", QUALITY, window=None).alias("anywhere"), E.too_short("html").alias("too_short"))


@query("page_quality_documents", f"""SELECT doc_id, {sql_contains('left(lower(text), 3000)', R.CHALLENGE_MARKERS)}
OR (length(text) < 500 AND {sql_contains('lower(text)', R.SHORT_PAGE_MARKERS)}) AS blocked FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", E.page_blocked("text").alias("blocked"))


PATTERNS = [r"/(\d+)\.html", r"/(\d+)/?$", r"/(\d+)[?#]"]


@query("regex_field", r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '/(\d+)\.html', 1), ''), nullif(regexp_extract(url, '/(\d+)/?$', 1), ''),
  nullif(regexp_extract(url, '/(\d+)[?#]', 1), '')) AS number, nullif(regexp_extract(url, '\d{2}-\d{2}-\d{4}', 0), '') AS day,
  trim(split_part(url, '?', 1)) AS before FROM pages""")
def _(spark, sf):
    return pages(spark, sf).select("page_id", E.regex_field("url", PATTERNS).alias("number"),
                                   E.regex_field("url", [r"\d{2}-\d{2}-\d{4}"], 0).alias("day"),
                                   E.text_before("url", "?").alias("before"))


DEADLINES = [r"(?i)(\d+\s+(?:days?|ngày)\s+left)", r"(\d{1,2}[/-]\d{1,2}[/-]\d{4})"]


@query("regex_dates", r"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_custkey || ' days left'
  WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%d-%m-%Y') END AS deadline FROM orders""")
def _(spark, sf):
    s = F.col("o_orderstatus")
    shown = (F.when(s == "O", F.concat(F.lit("Open, "), F.col("o_custkey").cast("string"), F.lit(" days left!")))
             .when(s == "F", F.concat(F.lit("Hạn "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" (x)")))
             .otherwise(F.concat(F.lit("till "), F.date_format("o_orderdate", "dd-MM-yyyy"))))
    return table(spark, sf, "orders").select("o_orderkey", E.regex_field(shown, DEADLINES).alias("deadline"))


@query("location_fields", """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'at ' || n_name || ', ' || r_name
  WHEN n_nationkey % 3 = 1 THEN n_name || ' - street' ELSE n_name END AS workplace,
  CASE WHEN n_nationkey % 2 = 0 THEN r_name || ', ' || n_name ELSE n_name END AS by_city FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(spark, sf):
    t = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    address = (F.when(k % 3 == 0, F.concat(F.lit("at "), "n_name", F.lit(", "), "r_name")).when(k % 3 == 1, "street"))
    return t.select("n_nationkey", E.place_and_address("n_name", address).alias("workplace"),
                    E.address_and_city(F.when(k % 2 == 0, F.col("r_name")).otherwise(""), "n_name").alias("by_city"))


@query("company_fields", """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'alt ' || s_suppkey WHEN s_suppkey % 4 = 1 THEN 'alt ' || s_suppkey ELSE s_name END AS company_name,
CASE WHEN s_nationkey = 3 THEN '' ELSE 'https://board.example/img/' || s_nationkey || '.png' END AS company_logo FROM supplier""")
def _(spark, sf):
    k = F.col("s_suppkey")
    text = (F.when(k % 4 == 0, "ab").when(k % 4 == 1, "3 Ngày trước")
            .when(k % 4 == 2, F.concat("s_name", F.lit(" QUY MÔ: 100"))).otherwise(F.concat("s_name", F.lit(" Trụ sở: x"))))
    src = F.when(F.col("s_nationkey") == 3, "/img/no_company.png").otherwise(
        F.concat(F.lit("/img/"), F.col("s_nationkey").cast("string"), F.lit(".png")))
    return table(spark, sf, "supplier").select(
        "s_suppkey", E.company_name(text, F.concat(F.lit("alt "), k.cast("string"))).alias("company_name"),
        E.company_logo(src, F.lit("https://board.example/list")).alias("company_logo"))


LINES = """(SELECT l_orderkey, l_partkey, l_returnflag, l_linestatus FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1) l"""


def cards_and_details(spark, sf):
    cards = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_url"), F.col("o_orderpriority").alias("job_title"),
        F.col("o_orderstatus").alias("salary"), F.lit("card").alias("level"))
    lines = first_visit(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    details = lines.select(
        F.col("l_orderkey").alias("job_url"), F.col("l_partkey").cast("string").alias("job_title"),
        F.when(F.col("l_returnflag") == "A", "").when(F.col("l_returnflag") == "R", None)
         .otherwise(F.col("l_linestatus")).alias("salary"))
    return cards, details


@query("enrich_override", f"""SELECT o_orderkey AS job_url, coalesce(CAST(l_partkey AS VARCHAR), o_orderpriority) AS job_title,
  CASE WHEN l_returnflag = 'N' THEN l_linestatus ELSE o_orderstatus END AS salary, 'card' AS level FROM orders LEFT JOIN {LINES} ON l_orderkey = o_orderkey""")
def _(spark, sf):
    return E.enrich_override(*cards_and_details(spark, sf), "job_url")


@query("enrich_fallback", f"""SELECT o_orderkey AS job_url, coalesce(CAST(l_partkey AS VARCHAR), o_orderpriority) AS job_title,
  CASE WHEN l_returnflag = 'N' THEN l_linestatus WHEN l_orderkey IS NULL THEN 'Thoả thuận' END AS salary,
  CASE WHEN l_orderkey IS NULL THEN 'Toàn thời gian' END AS work_type,
  CASE WHEN l_orderkey IS NULL THEN 'list_card' ELSE 'detail' END AS extracted_from FROM orders LEFT JOIN {LINES} ON l_orderkey = o_orderkey""")
def _(spark, sf):
    cards, details = cards_and_details(spark, sf)
    return E.enrich_fallback(cards.drop("salary"), details, "job_url", {"job_title": "job_title"},
                             {"salary": R.SALARY_AGREED_MILLIONS, "work_type": R.WORK_FULL_TIME})


@query("enrich_documents", """SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), lang) AS level FROM documents d LEFT JOIN labels USING (doc_id)""")
def _(spark, sf):
    cards = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("level"))
    details = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("level"))
    return E.enrich_override(cards, details, "doc_id", ["level"])
