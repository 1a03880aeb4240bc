"""Arrivals of new keys are appended; only repeated keys cost joins or aggregates of whole rows."""

from jobloom.sources.writers import Snapshot, last_per_key, one_per_key, upsert_merge

SCHEMA = "job_url string, source string, job_title string, created_at int"


def test_new_keys_are_appended_without_a_join(spark):
    target = spark.createDataFrame([("a", "s", "x", 1), (None, "s", "y", 2)], SCHEMA)
    batch = spark.createDataFrame([("b", "s", "z", 3), (None, "t", "w", 4)], SCHEMA)
    out = upsert_merge(target, batch)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(out.collect(), key=str) == sorted([*target.collect(), *batch.collect()], key=str)
    hit = upsert_merge(target, spark.createDataFrame([("a", "t", None, 5), ("c", "t", "v", 6)], SCHEMA))
    assert sorted(map(tuple, hit.collect()), key=str) == sorted([("a", "t", None, 1), (None, "s", "y", 2), ("c", "t", "v", 6)], key=str)


def test_a_batch_of_different_keys_stays_where_it_is(spark):
    batch = spark.createDataFrame([("a", "s", "x", 1), ("b", "s", "y", 2)], SCHEMA)
    assert one_per_key(batch, "job_url", "created_at") is batch
    twice = batch.unionByName(spark.createDataFrame([("a", "t", "z", 3), (None, "t", "u", 1), (None, "t", "w", 2)], SCHEMA))
    got, want = one_per_key(twice, "job_url", "created_at"), last_per_key(twice, "job_url", "created_at")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.count() == 3


def test_a_first_run_joins_nothing(spark, tmp_path):
    empty = Snapshot(spark, str(tmp_path / "none")).read(SCHEMA)
    rows = spark.createDataFrame([("a", "s", "x", 1)], SCHEMA)
    out = rows.join(empty, "job_url", "left_anti")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 1
