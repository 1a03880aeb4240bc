"""Sources that fail while they are read."""

import pytest
from pyspark.sql import functions as F

from jobloom.sources import readers as rd
from jobloom.sources import writers as wr

SCHEMA = "job_url string, source string"


def test_a_failing_source_does_not_stop_the_others(spark, tmp_path):
    good = spark.createDataFrame([("u1", "a"), ("u2", "a")], SCHEMA)
    damaged = tmp_path / "damaged"
    good.coalesce(1).write.parquet(str(damaged))
    part = next(damaged.glob("part-*.parquet"))
    part.write_bytes(b"PAR1" + b"\0" * 40 + part.read_bytes()[60:])
    for crc in damaged.glob(".*.crc"):
        crc.unlink()
    late = good.withColumn("source", F.raise_error(F.lit("connection lost")).cast("string"))
    tables = {"a": good, "b": spark.read.schema(SCHEMA).parquet(str(damaged)), "c": late}
    with pytest.raises(Exception):
        rd.union_sources(tables, ["a", "b", "c"]).collect()
    settled, failed = rd.settle_sources(tables)
    assert set(failed) == {"b", "c"} and "connection lost" in failed["c"]
    rows = rd.union_sources(settled, ["a", "b", "c"]).collect()
    assert sorted((r.job_url, r.source_rank) for r in rows) == [("u1", 0), ("u2", 0)]
    assert settled["b"].schema == tables["b"].schema


def test_settled_tables_do_not_change_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    settled, failed = rd.settle_sources({"documents": docs})
    assert not failed and settled["documents"].exceptAll(docs).isEmpty() and settled["documents"].count() == docs.count()


def test_both_raw_formats_work_the_rows_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def mark(text):
        seen.add(1)
        return text

    rows = [(f"u{i}", "a\nb" if i % 3 else 'say "x", é') for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("source", F.udf(mark)("source"))
    wr.write_bronze(df.where("job_url <> 'u7'"), str(tmp_path / "out"))
    assert seen.value <= len(rows)
    want = sorted(r for r in rows if r[0] != "u7")
    assert sorted(tuple(r) for r in wr.read_csv(spark, str(tmp_path / "out/csv")).collect()) == want
    assert sorted((r.job_url, r.source) for r in spark.read.json(str(tmp_path / "out/json")).collect()) == want
    for part in (tmp_path / "out/csv").glob("part-*"):
        assert part.read_bytes().startswith("\ufeffjob_url".encode()) and part.read_bytes().count(b"\n") > 1
