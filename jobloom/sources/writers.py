"""Writing postings and summaries: raw files, exports, merged snapshots, published tables."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom import rules as R
from jobloom.schema import TEXT_COLUMNS
from jobloom.session import saved

BOM = "﻿"


# ---- raw files and exports --------------------------------------------------------------

def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that a row fits a CSV line."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c)
                       for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, quote_all: bool = False, even: bool = True) -> None:
    """Complete CSV files, each with header and byte order mark.

    With ``even``, rows are rebalanced first, so there are no files without rows beside others, and a small table is
    one file.
    """
    first, *_ = df.columns
    rows = flat(df).withColumnRenamed(first, BOM + first)
    ((rows.hint("rebalance") if even else rows).write.mode("overwrite")
     .csv(path, header=True, quote='"', escape='"', quoteAll=quote_all, emptyValue='""' if quote_all else "",
          nullValue=None if quote_all else "", lineSep="\r\n" if quote_all else "\n",
          ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read what ``write_csv`` wrote, line breaks inside fields included."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return df.toDF(*[c.lstrip(BOM) for c in df.columns])


def write_bronze(df: DataFrame, path: str, formats: tuple[str, ...] = ("csv", "json")) -> None:
    """A board's raw rows as CSV, JSON lines, or neither, under ``path``.  For both they are worked out
    once, and the stored rows, whose largest file comes first, go to the CSV files without a shuffle."""
    once = len(formats) > 1
    if once:
        df = saved(df)
    if "csv" in formats:
        write_csv(df, f"{path}/csv", even=not once)
    if "json" in formats:
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/json")


def export_frame(df: DataFrame, columns=R.EXPORT_COLUMNS) -> DataFrame:
    """The export's columns in order, empty values shown as their default text."""
    out = []
    for header, column, default in columns:
        value = F.upper(column) if column == "source" else F.col(column)
        value = F.coalesce(F.nullif(value, F.lit("")), F.lit(default))
        out.append(F.regexp_replace(value, r"\r?\n", " ").alias(header))
    return df.select(*out)


def export_csv(df: DataFrame, path: str) -> None:
    write_csv(export_frame(df), path, quote_all=True)


# ---- merge by key -----------------------------------------------------------------------

def last_per_key(batch: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row per key, so that a batch cannot hit a key twice."""
    row = F.max_by(F.struct(*batch.columns), F.struct(*order))
    return batch.groupBy(F.col(key).alias("_key")).agg(row.alias("r")).select("r.*")


def one_per_key(batch: DataFrame, key: str, *order: str) -> DataFrame:
    """``last_per_key``, for a batch that lies in files; one without repeated keys is left where it is."""
    if batch.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return batch
    return saved(last_per_key(batch, key, *order))


def upsert_merge(target: DataFrame, batch: DataFrame, key: str = "job_url",
                 replaced: tuple[str, ...] = ("source", "job_title", "extra_info"),
                 first_seen: str = "created_at") -> DataFrame:
    """``target`` after inserting or updating the batch's rows by key.

    ``replaced`` columns take the batch's value, the others keep the old one where the
    batch has null; an empty text is a value.  ``first_seen`` stays that of the first
    insert.  Two joins instead of one full outer join: when the batch is small both
    broadcast it, and the target is not shuffled.  A batch of new keys only is appended.
    """
    if target.select(key).join(batch.select(F.col(key).alias("_b")), F.col(key) == F.col("_b"), "left_semi").isEmpty():
        return target.unionByName(batch.select(*[c for c in target.columns if c in batch.columns]), allowMissingColumns=True)
    new = batch.select(F.col(key).alias("_key"), F.struct(*batch.columns).alias("n"))
    joined = target.join(new, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    columns = []
    for c in target.columns:
        if c == key or c == first_seen or c not in batch.columns:
            value = F.col(c)
        elif c in replaced:
            value = F.when(hit, F.col(f"n.{c}")).otherwise(F.col(c))
        else:
            value = F.coalesce(F.col(f"n.{c}"), F.col(c))
        columns.append(value.alias(c))
    known = target.select(F.col(key).alias("_known")).join(
        batch.select(F.col(key).alias("_b")), F.col("_known") == F.col("_b")).select("_known")
    fresh = batch.join(known, F.col(key) == F.col("_known"), "left_anti")
    return joined.select(*columns).unionByName(fresh.select(
        *[c for c in target.columns if c in batch.columns]), allowMissingColumns=True)


VERSION = re.compile(r"version=(\d+)/?$")


class Snapshot:
    """A table kept as numbered versions under one folder; the newest complete one counts.

    A merge reads the newest version and writes the next, so readers never see a half
    written table, and a merge that fails leaves the old version in place.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(root):
            return []
        found = [VERSION.search(str(s.getPath())) for s in fs.listStatus(root)]
        return sorted(int(m.group(1)) for m in found if m and fs.exists(
            jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={m.group(1)}/_SUCCESS")))

    def read(self, schema) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], schema).where("false")     # known to be empty when joins are planned
        return self.spark.read.schema(schema).parquet(f"{self.path}/version={versions[-1]:06d}")

    def write(self, df: DataFrame) -> str:
        versions = self._versions()
        path = f"{self.path}/version={(versions[-1] if versions else 0) + 1:06d}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return path

    def merge(self, batch: DataFrame) -> str:
        return self.write(upsert_merge(self.read(batch.schema), batch))


# ---- published summaries ----------------------------------------------------------------

def publish(df: DataFrame, path: str) -> None:
    """Replace a published summary; every row carries the time of publication."""
    df.withColumn("updated_at", F.current_timestamp()).write.mode("overwrite").parquet(path)


def as_document(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """A bounded summary as one row (name, JSON array of its rows), ordered ascending by
    the given columns and then by the rows' text."""
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    keys = [o.alias(f"k{i}") for i, o in enumerate(order)]
    listed = F.array_sort(F.collect_list(F.struct(*keys, row.alias("row"))))
    data = F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["row"]), ","), F.lit("]"))
    return df.agg(data.alias("data")).select(F.lit(name).alias("name"), "data")


def as_value(df: DataFrame, name: str) -> DataFrame:
    """A summary of one row and one column as (name, JSON value)."""
    value = F.regexp_extract(F.to_json(F.struct(F.col(df.columns[0]).alias("v")), {"ignoreNullFields": "false"}),
                             r'^\{"v":(.*)\}$', 1)
    return df.select(F.lit(name).alias("name"), value.alias("data"))


__all__ = ["as_value", "write_bronze", "write_csv", "read_csv", "export_frame", "export_csv", "last_per_key", "upsert_merge",
           "Snapshot", "publish", "as_document", "published", "TEXT_COLUMNS"]


def published(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False
