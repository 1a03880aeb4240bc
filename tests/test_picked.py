"""Texts are found by row without crossing a shuffle, and the merge moves little beside them."""

from pyspark.sql import functions as F

from jobloom.operators import resolve as D
from jobloom.operators.resolve import MatchRule
from jobloom.session import picked, saved


def test_the_rows_asked_for_and_no_others(spark):
    texts = saved(spark.range(100_000).repartition(3).select(
        F.concat(F.lit("t"), "id").alias("t"), F.monotonically_increasing_id().alias("row")))
    some = texts.where("pmod(xxhash64(t), 7) = 0")
    got = picked(texts, some.select("row"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.collect()) == sorted(some.collect())
    assert picked(texts, some.where("t = 'none'").select("row")).count() == 0


def test_texts_stay_where_they_lie_until_pairs_are_known(spark):
    rows = [(f"u{i}", "a", f"a title {i} " + "of many words " * 9, f"company {i % 5}", None, None) for i in range(30)]
    df = spark.createDataFrame(rows, "job_url string, source string, job_title string, company_name string, salary string, level string")
    ranked, texts = D._ranked(df.withColumn("created_at", F.lit(None).cast("timestamp")), None, ["a"], MatchRule())
    profiles = D._profiles(D._nodes(D._with_shared_url(saved(ranked))), texts)
    assert "t" not in profiles.columns
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
