"""Golden rows: values worked out by hand from the described semantics."""

import pytest
from pyspark.sql import functions as F

from jobloom import rules as R
from jobloom.functions import similarity as S
from jobloom.functions import text as X
from jobloom.functions.registry import register_functions
from jobloom.operators import blocking as B
from jobloom.operators import dashboard as C
from jobloom.operators import extract as E
from jobloom.operators import rollups as A
from jobloom.sources import readers as rd
from jobloom.sources import writers as W


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize("text,expected", [
    ("Công Ty TNHH MTV Đà Nẵng, Việt-Nam", "đà nẵng việt nam"), ("FPT Software Co., Ltd", "fpt software"),
    ("Ngân hàng TMCP Á Châu", "á châu"), ("Acme Group JSC", "acme"), ("Corporation", ""), ("", ""), (None, "")])
def test_normalize(spark, text, expected):
    assert one(spark, X.normalize_text(lit(text))) == expected


@pytest.mark.parametrize("a,b,expected", [
    ("Senior Java Developer", "Java Developer Senior", 1.0), ("Senior Java Developer", "Senior Java Developers", 0.976744),
    ("Backend Engineer", "Frontend Engineer", 0.727273), ("Công ty TNHH Acme", "Acme", 1.0), ("Ltd", "Group", 1.0),
    ("Ltd", "Acme", 0.0)])
def test_similarity(spark, a, b, expected):
    assert round(one(spark, S.similarity(lit(a), lit(b))), 6) == expected


def test_ratio_is_not_symmetric(spark):
    assert one(spark, S.seq_ratio(lit("aaab"), lit("baca"))) == 0.5
    assert one(spark, S.seq_ratio(lit("baca"), lit("aaab"))) == 0.25


@pytest.mark.parametrize("a,b,expected", [("java", "java developer", 0.333333), ("word", "two words", 0.363636), ("", "java", 0.0)])
def test_trigrams(spark, a, b, expected):
    assert round(one(spark, S.trigram_similarity(lit(a), lit(b))), 6) == expected
    assert round(one(spark, S.trigram_similarity_to(lit(a), b)), 6) == expected
    assert round(one(spark, S.trigram_similarity_to(lit(b), a)), 6) == expected


@pytest.mark.parametrize("v,plain,folded", [
    (None, True, True), ("", True, True), ("Thương lượng", True, True), ("thỏa thuận", True, True),
    ("Negotiable", True, True), ("Thoả thuận", False, True), ("10 triệu", False, False)])
def test_unstated(spark, v, plain, folded):
    assert one(spark, X.is_unstated(lit(v))) is plain
    assert one(spark, X.is_unstated(lit(v), fold=True)) is folded


def test_rounding(spark):
    for part, total, even, up in ((1, 200, 0, 1), (1, 8, 12, 13), (3, 8, 38, 38)):
        assert one(spark, A.percent(F.lit(part), F.lit(total))) == even
        assert one(spark, C.half_up(F.lit(part) / total * 100)) == up


@pytest.mark.parametrize("v,expected", [
    (None, R.UNKNOWN_LOCATION), ("TP. HCM", "Hồ Chí Minh"), ("Hà Nội, Đà Nẵng", "Hà Nội"), ("Trà Vinh", "Nghệ An")])
def test_province(spark, v, expected):
    assert one(spark, X.normalize_province(lit(v))) == expected


def test_sector_without_keyword_is_null(spark):
    assert one(spark, X.infer_sector(lit("Acme"), lit("Clerk"), lit(None))) is None
    assert one(spark, X.infer_sector(lit("VNPT"), lit("Clerk"), lit(None))) == "Tập đoàn Công nghệ & Viễn thông"


def test_salary_texts(spark):
    n = F.lit(None).cast("bigint")
    assert one(spark, X.salary_text(lit(""), F.lit(1000), F.lit(2000), lit("USD"))) == "1,000 - 2,000 USD"
    assert one(spark, X.salary_text(lit("0"), n, n, lit(None))) == "Thỏa thuận"
    assert one(spark, X.salary_text(lit("Up to 5"), n, n, lit(None))) == "Up to 5"
    assert one(spark, X.salary_text_millions(F.lit(10e6), F.lit(15.5e6))) == "10 - 15.5 triệu VND"
    assert one(spark, X.salary_text_millions(F.lit(0.0), F.lit(None).cast("double"))) == "Thoả thuận"


@pytest.mark.parametrize("v", [0.5, 10, 15.5, 42.51925, 0.0001234567, 123456.5, 999999.7, 1234567.0, 100.0, 2.5e-7, 1e15, 0.1 + 0.2])
def test_six_digits(spark, v):
    assert one(spark, X.six_digits(F.lit(float(v)))) == f"{float(v):g}"


def test_parse_salary(spark):
    p = one(spark, X.parse_salary(lit("10 - 15.5 triệu VND")))
    assert (p.min, p.max, p.currency, p.period) == (10e6, 15.5e6, "VND", "month")
    p = one(spark, X.parse_salary(lit("Từ 1,500 USD")))
    assert (p.min, p.max, p.currency) == (1500.0, None, "USD")
    p = one(spark, X.parse_salary(lit("Thỏa thuận")))
    assert (p.min, p.max, p.currency, p.period) == (None, None, None, None)


def test_small_texts(spark):
    assert one(spark, X.space_units(lit("25Năm, 3 THÁNG"))) == "25 Năm, 3 THÁNG"
    assert one(spark, X.encode_tags(F.array(lit("a,"), lit(" "), lit("b"), lit("a")))) == "{a} {b}"
    assert one(spark, X.decode_tags(lit("{a} {b c}"))) == ["a", "b c"]
    assert one(spark, X.unwrap_image_url(lit("https://c/unsafe/http://a/x/https://b/y"))) == "https://b/y"
    assert one(spark, X.canonical_url(lit("x?y"), lit("http://h.e/a/b#c"))) == "http://h.e/a/x"
    assert one(spark, X.text_after_label(lit("Thời gian làm việc: 8h - 17h -"))) == "8h - 17h"


def test_html(spark):
    page = "<p>a &amp; b<!-- c --></p><script>x<y</script><ul><li> d</li></ul>"
    assert one(spark, X.html_to_text(lit(page))) == "a & b\nd"
    assert one(spark, E.html_to_text_exact(lit(page))) == "a & b\nd"
    assert one(spark, X.html_to_text(lit(None))) == ""
    html = "<h2>Mô tả công việc</h2><p>x</p><ul><li>1</li><li>2</li></ul><h3>Quyền lợi</h3>only text<h2>Khác</h2><p>z</p>"
    row = E.section_text(spark.createDataFrame([(html,)], "html string")).first()
    assert (row.job_description, row.job_requirements, row.benefits) == ("1\n2", "", "only text")


def test_company_fields(spark):
    assert one(spark, E.company_name(lit("Acme Quy mô: 10"), lit("alt"))) == "Acme"
    assert one(spark, E.company_name(lit("3 ngày trước"), lit("alt"))) == "alt"
    assert one(spark, E.company_logo(lit("/no_company.png"), lit("https://h/x"))) == ""


def test_upsert_keeps_old_where_new_is_null(spark):
    schema = "job_url string, source string, job_title string, salary string, level string, created_at timestamp"
    ts = lambda d: f"timestamp'2024-01-0{d}'"
    old = spark.sql(f"select 'u' job_url, 'a' source, 't' job_title, '10' salary, string(null) level, {ts(1)} created_at")
    new = spark.sql(f"select 'u' job_url, 'b' source, 'T' job_title, string(null) salary, 'Junior' level, {ts(2)} created_at")
    row = W.upsert_merge(old, new).first()
    assert (row.source, row.job_title, row.salary, row.level, row.created_at.day) == ("b", "T", "10", "Junior", 1)
    blank = spark.sql(f"select 'u' job_url, 'b' source, 'T' job_title, '' salary, 'x' level, {ts(2)} created_at")
    assert W.upsert_merge(old, blank).first().salary == ""
    assert W.upsert_merge(spark.createDataFrame([], schema), new).count() == 1


def test_merge_twice_changes_nothing(spark, tmp_path):
    df = spark.sql("select concat('u', id) job_url, 'a' source, 't' job_title, string(id) salary, current_timestamp() created_at from range(20)")
    snap = W.Snapshot(spark, str(tmp_path / "master"))
    snap.merge(df)
    first = sorted(map(tuple, snap.read(df.schema).collect()))
    snap.merge(df)
    assert sorted(map(tuple, snap.read(df.schema).collect())) == first


def test_export_file(spark, tmp_path):
    row = {c: None for c in ("job_title", "company_name", "salary", "location_short", "experience", "level",
                             "work_type", "source", "deadline", "posted_date", "workplace_detail", "job_url")}
    row.update(job_title='Dev "senior"\nweb', source="abc", job_url="u")
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))
    W.export_csv(df, str(tmp_path / "out"))
    data = next((tmp_path / "out").glob("part-*.csv")).read_bytes().decode("utf-8")
    head, line, end = data.split("\r\n")
    assert head.startswith("﻿") or head.startswith('"﻿')
    assert line.startswith('"Dev ""senior"" web","","Thương lượng","Chưa rõ"') and '"ABC"' in line and end == ""


def test_missing_table_gives_no_rows(spark, tmp_path):
    assert rd.read_source(spark, str(tmp_path / "nothing")).count() == 0


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("select posting_normalize('Acme Group JSC') a, trigram_similarity('word', 'two words') b, "
                    "province_of('TP. HCM') c, posting_similarity('Acme Ltd', 'acme') d").first()
    assert (row.a, round(row.b, 6), row.c, row.d) == ("acme", 0.363636, "Hồ Chí Minh", 1.0)


def test_piece_rule_bounds():
    rule = B.PieceRule(0.9)
    assert rule.q == 3 and rule.short_zone == 0 and rule.spoilt(4) == 0
    assert B.PieceRule(0.5).short_zone >= 0
    with pytest.raises(ValueError):
        B.PieceRule(0.0)


def test_backslash_in_a_search(spark):
    from jobloom.operators.search import contains_like

    df = spark.createDataFrame([("C:x",), ("50% off",), ("a_b",), ("acb",), ("back\\slash",)], "t string")
    hits = lambda q: {r.t for r in df.filter(contains_like("t", q)).collect()}
    assert hits("C:\\x") == {"C:x"}
    assert hits("50\\%") == {"50% off"}
    assert hits("a\\_b") == {"a_b"} and hits("a_b") == {"a_b", "acb"}
    assert hits("k\\\\s") == {"back\\slash"}


def test_white_space_of_any_kind(spark):
    from pyspark.sql import functions as F
    from jobloom.functions.text import is_unstated, join_nonempty, sanitize_name

    df = spark.createDataFrame([("\nThương lượng\t", "a\n", ["\t", " x\u00a0"])], "s string, n string, l array<string>")
    r = df.select(is_unstated("s").alias("u"), sanitize_name("n").alias("n"), join_nonempty("l", ",").alias("j")).first()
    assert (r.u, r.n, r.j) == (True, "a", "x")
    assert F is not None


def test_details_do_not_multiply_cards(spark):
    from jobloom.operators.extract import enrich_fallback, enrich_override

    cards = spark.createDataFrame([("u", "t")], "job_url string, job_title string")
    details = spark.createDataFrame([("u", "b"), ("u", "a")], "job_url string, job_title string")
    assert [r.job_title for r in enrich_override(cards, details, "job_url", ["job_title"]).collect()] == ["a"]
    assert enrich_fallback(cards, details, "job_url", {}, {}).count() == 1


def test_sql_functions_agree(spark):
    from jobloom.functions.registry import register_functions

    register_functions(spark)
    r = spark.sql("SELECT posting_jaccard('', '') AS a, posting_jaccard('x y', 'y z') AS b, trigram_similarity('', '') AS c, "
                  "trigram_similarity('java', 'java') AS d").first()
    assert (r.a, round(r.b, 6), r.c, r.d) == (0.0, 0.333333, 0.0, 1.0)


def test_tracker_fold_takes_late_events(spark):
    from jobloom.operators.dashboard import tracker_fold, tracker_state

    rows = [(1, 1, "a", "saved", "", 10), (2, 1, "a", "applied", "n", 30), (3, 1, "a", "interviewing", "", 20),
            (4, 2, "b", "saved", "", 10), (5, 2, "b", "removed", "", 30), (6, 2, "b", "interviewing", "", 20),
            (7, 3, "c", "saved", "m", 5), (8, 3, "c", "removed", "", 6), (9, 3, "c", "saved", "", 9), (10, 3, "c", "applied", "", 12)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, job_url string, status string, notes string, s long") \
        .selectExpr("event_id", "user_id", "job_url", "status", "notes", "timestamp_seconds(s) AS ts")
    want = {tuple(r) for r in tracker_state(df).collect()}
    got = {tuple(r) for r in tracker_fold(df).filter("status <> 'removed'").select(*tracker_state(df).columns).collect()}
    assert got == want and {(r[0], r[2]) for r in got} == {(1, "applied"), (3, "applied")}
