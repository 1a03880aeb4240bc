"""Pairs of postings are built with one shuffle of their texts, and scores move titles once."""

from pyspark.sql import functions as F

from jobloom.functions import similarity as S
from jobloom.plans.resolve_queries import neighbours


def test_neighbours_are_those_of_a_plain_join(spark, tmp_path):
    ids = [*range(1, 1100), 5, 25, 25, 3000, 3020, 499, 519, None, None]
    rows = [(i, f"one two three text {k}", "en", "src1", k) for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    got = neighbours(spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = [(i, f"text {k}", f"text {j}") for k, i in enumerate(ids) for j, h in enumerate(ids) if i is not None and h == i - 20]
    assert sorted(tuple(r) for r in got.select("doc_id", "job_title", "job_title_2").collect()) == sorted(want)


def test_texts_are_left_behind_by_the_joins_of_ratios(spark):
    rows = spark.createDataFrame([(i, f"some text {i}", f"some text {i + 1}" * 2) for i in range(20)], "id long, a string, b string")
    out = S.with_similarities(rows, score=("a", "b")).select("id", "score")
    scans = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Relation" in x]
    joined = out._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert scans and "md5" not in joined and " a#" not in joined.split("Relation")[0]


def test_scores_are_those_of_the_parts(spark):
    row = ("Acme", "Senior engineer", "10", "Lead")
    other = [("Acme", "Senior engineers", None, "Lead"), ("Acmes", "Junior engineer", "11", None), ("Zeta", "Senior engineer", "10", "Lead"),
             (None, None, None, None), ("Acme", "Senior engineer", "10", "Leads")]
    names = ["company_name", "job_title", "salary", "level"]
    pairs = spark.createDataFrame([(i, *row, *o) for i, o in enumerate(other)],
                                  ", ".join(["id long", *[f"{c} string" for c in names], *[f"{c}_2 string" for c in names]]))
    got = {r.id: r for r in S.duplicate_scores(pairs, 0.5).collect()}
    one = pairs.select("id", *[F.round(S.similarity(c, f"{c}_2"), 9).alias(c) for c in names[:2]],
                       *[F.round(S.field_similarity(c, f"{c}_2"), 9).alias(c) for c in names[2:]])
    for r in one.collect():
        company = r.company_name
        title = r.job_title if (company or 0) >= 0.5 else 0.0
        rest = [r.salary, r.level] if (title or 0) >= 0.5 else [0.0, 0.0]
        g = got[r.id]
        assert [None if x is None else round(x, 9) for x in (g.company_score, g.title_score, g.salary_score, g.level_score)] == [company, title, *rest]
        assert bool(g.is_dup) == (max(rest) >= 0.5)
    assert S.duplicate_scores(pairs, 0.5, keep=["id"]).columns == ["id", "company_score", "title_score", "salary_score", "level_score", "is_dup"]
