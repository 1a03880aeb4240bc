"""Duplicate resolution over the documents seen as postings, with SQL twins.

SQL has no character ratio: the twins find it by recursion (``ratio_sql``).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from jobloom import rules as R
from jobloom.functions import similarity as S
from jobloom.functions import text as X
from jobloom.operators import resolve as D
from jobloom.plans.catalog import query
from jobloom.plans.views import DOCUMENT_POSTINGS_SQL, document_postings, table

SOURCES = [f"src{i}" for i in range(20)]
STORED = SOURCES[:7]  # sources already merged into the master in the incremental runs
TOKENS = D.MatchRule(0.9, use_characters=False)


def sql_normalize(expr: str) -> str:
    """normalize_text in RE2, which has no look-around: every non-word character is doubled
    first, so that neighbouring terms do not compete for the blank between them."""
    terms = "|".join(t.replace(r"co\.,\s*ltd", r"co\.\.,,\s*ltd").replace(" ", "  ") for t in R.COMPANY_TERMS)
    doubled = rf"regexp_replace(trim(lower(coalesce({expr}, ''))), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"
    cut = rf"regexp_replace(' ' || {doubled} || ' ', '([^\p{{L}}\p{{N}}_])({terms})([^\p{{L}}\p{{N}}_])', '\1 \3', 'g')"
    return rf"trim(regexp_replace({cut}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def sql_tokens(expr: str) -> str:
    return f"list_distinct(list_filter(string_split({expr}, ' '), lambda w: w <> ''))"


def sql_jaccard(a: str, b: str) -> str:
    x, y = sql_tokens(a), sql_tokens(b)
    return (f"(CASE WHEN len(list_distinct(list_concat({x}, {y}))) = 0 THEN 0::DOUBLE ELSE len(list_intersect({x}, {y}))::DOUBLE "
            f"/ len(list_distinct(list_concat({x}, {y}))) END)")


def sql_similar(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 1::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0::DOUBLE ELSE {sql_jaccard(a, b)} END)"


def ratio_sql(pairs: str, mark: str = "") -> str:
    """Tables that end in ``ratios`` (a, b, ratio) of the different, non-empty texts a and b of the table ``pairs``;
    ``mark`` ends the names of these tables.

    A recursion over rectangles, each a range of the two texts with the list of islands (stretches of equal characters) in
    it: the best island grows to the longest block, what lies left and right of it goes on.
    """
    grow = lambda first, room, x, y: (
        f"CASE WHEN NOT long OR {room} = 0 OR {x.format(0)} <> {y.format(0)} THEN 0 ELSE coalesce(list_position(list_transform("
        f"range({room}), lambda t: {x.format('t')} <> {y.format('t')}), true), {room} + 1) - 1 END")
    before = grow("i", "least(best.i - a0, best.j - b0)", "x[best.i - {}]", "y[best.j - {}]")
    after = grow("i", "least(a1 - best.i - best.n, b1 - best.j - best.n)", "x[best.i + best.n + 1 + {}]", "y[best.j + best.n + 1 + {}]")
    cut = """list_filter(list_transform(islands, lambda o: {{'i': o.i + greatest(0, {a0} - o.i, {b0} - o.j), 'j': o.j + greatest(0, {a0} - o.i, {b0} - o.j),
      'n': least(o.n, {a1} - o.i, {b1} - o.j) - greatest(0, {a0} - o.i, {b0} - o.j)}}), lambda o: o.n > 0)"""
    return f"""hard{mark} AS MATERIALIZED (SELECT *, row_number() OVER () AS pair, string_split(a, '') AS x, string_split(b, '') AS y, length(b) >= 200 AS long
  FROM (SELECT DISTINCT a, b FROM {pairs} WHERE a <> b AND a <> '' AND b <> '')),
xs{mark} AS (SELECT pair, unnest(x) AS ch, unnest(range(len(x))) AS i FROM hard{mark}),
ys{mark} AS (SELECT pair, unnest(y) AS ch, unnest(range(len(y))) AS j, len(y) AS size FROM hard{mark}),
common{mark} AS (SELECT pair, ch FROM ys{mark} GROUP BY pair, ch, size HAVING size >= 200 AND count(*) > size // 100 + 1),
met{mark} AS (SELECT xs{mark}.pair, i, j FROM xs{mark} JOIN (SELECT * FROM ys{mark} ANTI JOIN common{mark} USING (pair, ch)) y USING (pair, ch)),
stretches{mark} AS (SELECT pair, min(i) AS i, min(j) AS j, count(*) AS n
  FROM (SELECT *, i - row_number() OVER (PARTITION BY pair, j - i ORDER BY i) AS island FROM met{mark}) GROUP BY pair, j - i, island),
cover{mark}(pair, a0, a1, b0, b1, islands, got) AS (
  SELECT hard{mark}.pair, 0::BIGINT, len(x)::BIGINT, 0::BIGINT, len(y)::BIGINT, coalesce(found, []), 0::BIGINT FROM hard{mark}
    LEFT JOIN (SELECT pair, list({{'i': i::BIGINT, 'j': j::BIGINT, 'n': n::BIGINT}}) AS found FROM stretches{mark} GROUP BY 1) f ON f.pair = hard{mark}.pair
  UNION ALL
  SELECT pair, CASE side WHEN 0 THEN a0 ELSE end_a END, CASE side WHEN 0 THEN from_a ELSE a1 END,
    CASE side WHEN 0 THEN b0 ELSE end_b END, CASE side WHEN 0 THEN from_b ELSE b1 END,
    CASE side WHEN 0 THEN {cut.format(a0="a0", a1="from_a", b0="b0", b1="from_b")} ELSE {cut.format(a0="end_a", a1="a1", b0="end_b", b1="b1")} END,
    CASE side WHEN 0 THEN end_a - from_a ELSE 0 END
  FROM (SELECT *, best.i - before AS from_a, best.j - before AS from_b, best.i + best.n + after AS end_a, best.j + best.n + after AS end_b FROM (
    SELECT *, {before} AS before, {after} AS after FROM (
      SELECT g.*, x, y, long, CASE WHEN len(islands) = 0 THEN {{'i': 0::BIGINT, 'j': 0::BIGINT, 'n': 0::BIGINT}} ELSE
        list_transform([list_min(list_transform(islands, lambda o: {{'less': -o.n, 'i': o.i, 'j': o.j}}))], lambda o: {{'i': o.i, 'j': o.j, 'n': -o.less}})[1] END AS best
      FROM cover{mark} g JOIN hard{mark} ON hard{mark}.pair = g.pair
      WHERE a1 > a0 AND b1 > b0 AND (len(islands) > 0 OR a0 + b0 = 0 AND long AND x[1] = y[1])))), (VALUES (0), (1)) AS sides(side)),
ratios{mark} AS (SELECT a, b, 2.0::DOUBLE * sum(got) / (length(a) + length(b)) AS ratio FROM cover{mark} JOIN hard{mark} ON hard{mark}.pair = cover{mark}.pair GROUP BY a, b)"""


def sql_mixed(a: str, b: str, ratio: str) -> str:
    """The similarity of two texts, given their ratio."""
    return (f"(CASE WHEN {a} = {b} THEN 1::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0::DOUBLE "
            f"ELSE greatest({sql_jaccard(a, b)}, coalesce({ratio}, 0::DOUBLE)) END)")


UNSTATED_LIST = ", ".join(f"'{w}'" for w in R.UNSTATED)


def sql_unstated(c: str) -> str:
    return f"({c} IS NULL OR lower(trim({c})) IN ({UNSTATED_LIST}))"


# ---- building blocks --------------------------------------------------------------------

DRESSED = "'Công Ty TNHH ' || source || ' Group JSC, ' || text || ' Co., Ltd Corp'"


@query("normalize_text", f"SELECT doc_id, md5({sql_normalize(DRESSED)}) AS normalized, length({sql_normalize(DRESSED)}) AS chars FROM documents")
def _(spark, sf):
    dressed = F.concat(F.lit("Công Ty TNHH "), "source", F.lit(" Group JSC, "), "text", F.lit(" Co., Ltd Corp"))
    n = X.normalize_text(dressed)
    return table(spark, sf, "documents").select("doc_id", F.md5(n).alias("normalized"), F.length(n).cast("bigint").alias("chars"))


@query("normalize_supplier", f"SELECT s_suppkey, {sql_normalize('s_name')} AS normalized, left({sql_normalize('s_name')}, 3) AS block FROM supplier")
def _(spark, sf):
    n = X.normalize_text("s_name")
    return table(spark, sf, "supplier").select("s_suppkey", n.alias("normalized"), X.block_key(n).alias("block"))


@query("block_report", "WITH " + DOCUMENT_POSTINGS_SQL + f"""SELECT left({sql_normalize('company_name')}, 3) AS block,
count(*) AS postings, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS pairs FROM doc_postings GROUP BY 1""")
def _(spark, sf):
    return D.block_report(document_postings(spark, sf))


def neighbours(spark, sf):
    """Every document posting beside the one its source delivered before it.

    Postings go to blocks of ids, those of a block's end to the next one as well, so that texts cross one shuffle and not two.
    """
    d = document_postings(spark, sf).select(F.unix_timestamp("created_at").alias("doc_id"), *D.COMPARED).where("doc_id IS NOT NULL")
    blocks = d.withColumn("block", F.explode(F.expr("array_distinct(array(doc_id div 500, (doc_id + 20) div 500))")))
    before = Window.partitionBy("block").orderBy("doc_id").rangeBetween(-20, -20)
    listed = F.collect_list(F.struct(*[F.col(c).alias(f"{c}_2") for c in D.COMPARED])).over(before)
    return blocks.withColumn("before", listed).where("block = doc_id div 500").select("doc_id", *D.COMPARED, F.inline("before"))


NEIGHBOURS = "WITH " + DOCUMENT_POSTINGS_SQL + f""", nb AS (SELECT a.doc_id,
  {sql_normalize('a.company_name')} AS c1, {sql_normalize('b.company_name')} AS c2,
  {sql_normalize('a.job_title')} AS t1, {sql_normalize('b.job_title')} AS t2,
  a.salary AS s1, b.salary AS s2, a.level AS l1, b.level AS l2
  FROM doc_postings a JOIN doc_postings b ON b.doc_id = a.doc_id - 20) """


@query("token_jaccard", NEIGHBOURS + f"SELECT doc_id, round({sql_jaccard('t1', 't2')}, 9) AS jaccard FROM nb")
def _(spark, sf):
    return neighbours(spark, sf).select("doc_id", F.round(S.token_jaccard(
        X.normalize_text("job_title"), X.normalize_text("job_title_2")), 9).alias("jaccard"))


@query("similarity_tokens", NEIGHBOURS + f"SELECT doc_id, round({sql_similar('t1', 't2')}, 9) AS title, round({sql_similar('c1', 'c2')}, 9) AS company FROM nb")
def _(spark, sf):
    return neighbours(spark, sf).select(
        "doc_id", F.round(S.similarity("job_title", "job_title_2", False), 9).alias("title"),
        F.round(S.similarity("company_name", "company_name_2", False), 9).alias("company"))


def with_ratio_of(*columns: str) -> str:
    """The neighbours with the ratios of pairs of columns, as tables up to ``rated``."""
    asked = " UNION ALL ".join(f"SELECT {x}1 AS a, {x}2 AS b FROM nb" for x in columns)
    joins = " ".join(f"LEFT JOIN ratios r{x} ON r{x}.a = {x}1 AND r{x}.b = {x}2" for x in columns)
    ratios = ", ".join(f"r{x}.ratio AS r{x}" for x in columns)
    return NEIGHBOURS.replace("WITH ", "WITH RECURSIVE ", 1) + f", asked AS ({asked}), {ratio_sql('asked')}, rated AS (SELECT nb.*, {ratios} FROM nb {joins}) "


@query("similarity", with_ratio_of("t", "c") + f"""SELECT doc_id, round({sql_mixed('t1', 't2', 'rt')}, 9) AS title,
  round({sql_mixed('c1', 'c2', 'rc')}, 9) AS company FROM rated""")
def _(spark, sf):
    sides = {f"{x}{n}": X.normalize_text(c + suffix) for x, c in (("t", "job_title"), ("c", "company_name"))
             for n, suffix in ((1, ""), (2, "_2"))}
    rows = neighbours(spark, sf).select("doc_id", *[c.alias(n) for n, c in sides.items()])
    out = S.with_similarities(rows, title=("t1", "t2"), company=("c1", "c2"))
    return out.select("doc_id", F.round("title", 9).alias("title"), F.round("company", 9).alias("company"))


@query("seq_ratio", "WITH RECURSIVE " + DOCUMENT_POSTINGS_SQL + """, asked AS (SELECT a.doc_id, a.job_title AS a, b.job_title AS b
  FROM doc_postings a JOIN doc_postings b ON b.doc_id = a.doc_id - 20), """ + ratio_sql("asked") + """
SELECT doc_id, round(CASE WHEN asked.a = asked.b THEN 1 ELSE coalesce(ratio, 0) END::DOUBLE, 9) AS ratio
FROM asked LEFT JOIN ratios ON ratios.a = asked.a AND ratios.b = asked.b""")
def _(spark, sf):
    out = S.with_ratios(neighbours(spark, sf), {"ratio": ("job_title", "job_title_2")})
    return out.select("doc_id", F.round("ratio", 9).alias("ratio"))


# A salary column with all the ways of saying nothing, from the order status.
SALARY_SQL = """CASE WHEN o_orderpriority LIKE '1%' THEN NULL WHEN o_orderpriority LIKE '2%' THEN ' Thương Lượng '
WHEN o_orderpriority LIKE '3%' THEN 'Thoả thuận' WHEN o_orderstatus = 'O' THEN 'Negotiable' ELSE o_orderpriority END"""


def salary_like():
    p = F.col("o_orderpriority")
    return (F.when(p.like("1%"), None).when(p.like("2%"), " Thương Lượng ").when(p.like("3%"), "Thoả thuận")
            .when(F.col("o_orderstatus") == "O", "Negotiable").otherwise(p))


@query("is_unstated", f"""SELECT o_orderkey, {sql_unstated('v')} AS unstated, {sql_unstated('v')} OR v = 'Thoả thuận' AS folded
FROM (SELECT o_orderkey, {SALARY_SQL} AS v FROM orders)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", salary_like().alias("v"))
    return o.select("o_orderkey", X.is_unstated("v").alias("unstated"), X.is_unstated("v", fold=True).alias("folded"))


@query("field_similarity_tokens", f"""WITH o AS (SELECT o_orderkey, {SALARY_SQL} AS a, o_orderpriority || ' ' || o_orderstatus AS b FROM orders)
SELECT o_orderkey, CASE WHEN {sql_unstated('a')} THEN 0.5::DOUBLE ELSE round({sql_similar(sql_normalize('a'), sql_normalize('b'))}, 9) END AS score FROM o""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", salary_like().alias("a"), F.concat("o_orderpriority", F.lit(" "), "o_orderstatus").alias("b"))
    return o.select("o_orderkey", F.round(S.field_similarity("a", "b", False), 9).alias("score"))


def scores(df, use_characters):
    s = S.duplicate_scores(df, 0.3, use_characters, keep=["doc_id"])
    return s.select("doc_id", "is_dup", *[F.round(f"{c}_score", 9).alias(c) for c in ("company", "title", "salary", "level")])


@query("duplicate_scores_tokens", NEIGHBOURS + f""", g AS (SELECT *, {sql_similar('c1', 'c2')} AS company FROM nb),
h AS (SELECT *, CASE WHEN company >= 0.3::DOUBLE THEN {sql_similar('t1', 't2')} ELSE 0::DOUBLE END AS title FROM g),
i AS (SELECT *, CASE WHEN company >= 0.3::DOUBLE AND title >= 0.3::DOUBLE THEN {sql_similar('s1', 's2')} ELSE 0::DOUBLE END AS salary,
  CASE WHEN company >= 0.3::DOUBLE AND title >= 0.3::DOUBLE THEN {sql_similar('l1', 'l2')} ELSE 0::DOUBLE END AS level FROM h)
SELECT doc_id, company >= 0.3::DOUBLE AND title >= 0.3::DOUBLE AND (salary >= 0.3::DOUBLE OR level >= 0.3::DOUBLE) AS is_dup,
  round(company, 9) AS company, round(title, 9) AS title, round(salary, 9) AS salary, round(level, 9) AS level FROM i""")
def _(spark, sf):
    return scores(neighbours(spark, sf), False)


@query("duplicate_scores", with_ratio_of("c", "t", "s", "l") + f""", g AS (SELECT *, {sql_mixed('c1', 'c2', 'rc')} AS company FROM rated),
h AS (SELECT *, CASE WHEN company >= 0.3::DOUBLE THEN {sql_mixed('t1', 't2', 'rt')} ELSE 0::DOUBLE END AS title FROM g),
i AS (SELECT *, CASE WHEN company >= 0.3::DOUBLE AND title >= 0.3::DOUBLE THEN {sql_mixed('s1', 's2', 'rs')} ELSE 0::DOUBLE END AS salary,
  CASE WHEN company >= 0.3::DOUBLE AND title >= 0.3::DOUBLE THEN {sql_mixed('l1', 'l2', 'rl')} ELSE 0::DOUBLE END AS level FROM h)
SELECT doc_id, company >= 0.3::DOUBLE AND title >= 0.3::DOUBLE AND (salary >= 0.3::DOUBLE OR level >= 0.3::DOUBLE) AS is_dup,
  round(company, 9) AS company, round(title, 9) AS title, round(salary, 9) AS salary, round(level, 9) AS level FROM i""")
def _(spark, sf):
    return scores(neighbours(spark, sf), True)


# ---- the merge --------------------------------------------------------------------------

def matching_sql(characters: bool) -> str:
    """Tables that end in ``edges``: each posting with the earlier ones of its block that it matches."""
    if not characters:
        match = " AND ".join(f"{sql_similar('a.' + x, 'b.' + x)} >= 0.9::DOUBLE" for x in ("c", "t"))
        either = " OR ".join(f"{sql_similar('a.' + x, 'b.' + x)} >= 0.9::DOUBLE" for x in ("s", "l"))
        return f"""edges AS MATERIALIZED (SELECT a.rank, list(b.rank) AS candidates FROM r a JOIN r b
  ON a.block = b.block AND b.rank < a.rank AND NOT a.existing AND {match} AND ({either}) GROUP BY 1)"""
    # no ratio exceeds twice the shorter length over both lengths
    ask = lambda x, t: (f"SELECT {x}1 AS a, {x}2 AS b FROM {t} WHERE 2 * least(length({x}1), length({x}2)) "  # noqa: E731
                        f">= 0.9::DOUBLE * (length({x}1) + length({x}2)) - 1e-9")
    reach = lambda x: f"{sql_mixed(x + '1', x + '2', f'r{x}.ratio')} >= 0.9::DOUBLE"
    on = lambda x, mark: f"LEFT JOIN ratios{mark} r{x} ON r{x}.a = {x}1 AND r{x}.b = {x}2"
    both = ", ".join(f"a.{x} AS {x}1, b.{x} AS {x}2" for x in "ctsl")
    return f"""met_all AS MATERIALIZED (SELECT a.rank, b.rank AS earlier, {both} FROM r a JOIN r b ON a.block = b.block AND b.rank < a.rank AND NOT a.existing),
ask_c AS ({ask('c', 'met_all')}), {ratio_sql('ask_c', '_c')},
alike AS MATERIALIZED (SELECT m.* FROM met_all m {on('c', '_c')} WHERE {reach('c')}),
ask_t AS ({ask('t', 'alike')} UNION ALL {ask('s', 'alike')} UNION ALL {ask('l', 'alike')}), {ratio_sql('ask_t', '_t')},
edges AS MATERIALIZED (SELECT rank, list(earlier) AS candidates FROM alike m {on('t', '_t')} {on('s', '_t')} {on('l', '_t')}
  WHERE {reach('t')} AND ({reach('s')} OR {reach('l')}) GROUP BY 1)"""


def merge_sql(stored: bool, characters: bool = False) -> str:
    """The sequential scan as a recursion over the position inside each block."""
    is_stored = f"source IN ({', '.join(repr(s) for s in STORED)})" if stored else "false"
    order = f"CASE WHEN {is_stored} THEN 0 ELSE CAST(replace(source, 'src', '') AS INT) + 1 END, doc_id"
    return "WITH RECURSIVE " + DOCUMENT_POSTINGS_SQL + f""", n AS (SELECT doc_id, job_url, source, {is_stored} AS existing,
  {sql_normalize('company_name')} AS c, {sql_normalize('job_title')} AS t, {sql_normalize('salary')} AS s, {sql_normalize('level')} AS l
  FROM doc_postings),
r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {order}) AS rank, left(c, 3) AS block,
  row_number() OVER (PARTITION BY left(c, 3) ORDER BY {order}) AS pos FROM n),
{matching_sql(characters)},
steps AS MATERIALIZED (SELECT block, pos, rank, existing, coalesce(candidates, []) AS candidates FROM r LEFT JOIN edges USING (rank)),
g(block, pos, rank, link, kept) AS (
  SELECT DISTINCT block, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] FROM r
  UNION ALL
  SELECT s.block, s.pos, s.rank, list_min(list_intersect(s.candidates, g.kept)),
    CASE WHEN list_min(list_intersect(s.candidates, g.kept)) IS NULL THEN list_append(g.kept, s.rank) ELSE g.kept END
  FROM g JOIN steps s ON s.block = g.block AND s.pos = g.pos + 1),
decisions AS (SELECT r.job_url, r.source, CASE WHEN r.existing THEN 'existing' WHEN g.link IS NULL THEN 'kept' ELSE 'duplicate' END AS status,
  k.job_url AS kept_url, k.source AS kept_source
  FROM g JOIN r ON r.rank = g.rank LEFT JOIN r k ON k.rank = g.link) """


def merged(spark, sf, rule=TOKENS, stored=False):
    docs = document_postings(spark, sf)
    if not stored:
        return D.resolve(docs, None, SOURCES, rule)
    old = F.col("source").isin(STORED)
    return D.resolve(docs.filter(~old), docs.filter(old), SOURCES, rule)


@query("resolve_tokens", merge_sql(False) + "SELECT * FROM decisions")
def _(spark, sf):
    return merged(spark, sf).drop("rank")


@query("resolve_duplicates", merge_sql(False, True) + "SELECT * FROM decisions")
def _(spark, sf):
    return merged(spark, sf, D.MatchRule()).drop("rank")


@query("resolve_incremental_tokens", merge_sql(True) + "SELECT * FROM decisions")
def _(spark, sf):
    return merged(spark, sf, stored=True).drop("rank")


@query("resolve_incremental", merge_sql(True, True) + "SELECT * FROM decisions")
def _(spark, sf):
    return merged(spark, sf, D.MatchRule(), stored=True).drop("rank")


@query("candidate_edges_tokens", merge_sql(False) + """SELECT a.job_url, b.job_url AS candidate_url FROM edges e JOIN r a ON a.rank = e.rank
JOIN r b ON list_contains(e.candidates, b.rank) AND b.block = a.block
WHERE a.rank IN (SELECT min(rank) FROM r GROUP BY c, t, s, l) AND b.rank IN (SELECT min(rank) FROM r GROUP BY c, t, s, l)""")
def _(spark, sf):
    """Matching pairs of first postings of two profiles, each with the earlier one."""
    ranked, texts = D._ranked(document_postings(spark, sf), None, SOURCES, TOKENS)
    nodes = D.saved(D._nodes(D._with_shared_url(D.saved(ranked))))
    edges = D.all_edges(nodes, texts, TOKENS)
    a = nodes.select("profile", F.col("url").alias("job_url"))
    b = nodes.select(F.col("profile").alias("candidate"), F.col("url").alias("candidate_url"))
    return edges.join(a, "profile").join(b, "candidate").select("job_url", "candidate_url")


@query("link_duplicates", merge_sql(False) + "SELECT DISTINCT kept_url, source, job_url FROM decisions WHERE status = 'duplicate'")
def _(spark, sf):
    return D.link_duplicates(merged(spark, sf))


@query("attach_links", merge_sql(False) + """SELECT d.job_url, coalesce(l.n, 0) AS links, coalesce(l.urls, '') AS urls FROM decisions d LEFT JOIN
  (SELECT kept_url, count(*) AS n, string_agg(source || '=' || job_url, ' ' ORDER BY source, job_url) AS urls
   FROM decisions WHERE status = 'duplicate' GROUP BY 1) l ON l.kept_url = d.job_url WHERE d.status = 'kept'""")
def _(spark, sf):
    decisions = D.saved(merged(spark, sf))
    kept = D.new_postings(document_postings(spark, sf), decisions)
    out = D.attach_links(kept, D.link_duplicates(decisions))
    entries = F.coalesce(F.col("extra_info.duplicate_sources"), F.array())
    return out.select("job_url", F.size(entries).cast("bigint").alias("links"), F.array_join(F.transform(
        "extra_info.duplicate_sources", lambda x: F.concat_ws("=", x["source"], x["job_url"])), " ").alias("urls")).fillna("", ["urls"])


@query("sync_master", merge_sql(True) + """SELECT d.job_url, d.status = 'existing' AS stored, coalesce(l.urls, '') AS urls FROM decisions d LEFT JOIN
  (SELECT kept_url, string_agg(source || '=' || job_url, ' ' ORDER BY source, job_url) AS urls
   FROM decisions WHERE status = 'duplicate' GROUP BY 1) l ON l.kept_url = d.job_url WHERE d.status <> 'duplicate'""")
def _(spark, sf):
    docs = document_postings(spark, sf)
    old = F.col("source").isin(STORED)
    after, _ = D.sync(docs.filter(~old), docs.filter(old), SOURCES, TOKENS)
    urls = F.array_join(F.transform("extra_info.duplicate_sources", lambda x: F.concat_ws("=", x["source"], x["job_url"])), " ")
    return after.select("job_url", old.alias("stored"), F.coalesce(urls, F.lit("")).alias("urls"))


REPORT_SQL = """SELECT source, count(*) AS total, count(*) FILTER (status = 'kept') AS new,
count(*) FILTER (status = 'duplicate') AS duplicate FROM decisions WHERE status <> 'existing' GROUP BY ROLLUP (source)"""


@query("sync_report", merge_sql(True) + REPORT_SQL)
def _(spark, sf):
    return D.sync_report(merged(spark, sf, stored=True))


@query("sync_report_full", merge_sql(False, True) + REPORT_SQL)
def sync_report_full(spark, sf):
    return D.sync_report(merged(spark, sf, D.MatchRule()))
