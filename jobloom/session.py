"""Spark session defaults.  Cluster settings win: nothing here overrides a set value."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, app: str = "jobloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {**DEFAULTS, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.jobloom.spread": str(cpus),
                # little data, but costly rows: keep all cores busy after a shuffle
                "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the shared one the cluster names in
    ``spark.checkpoint.dir``.  Only a local session without that setting gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    global _local_scratch
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="jobloom-scratch-")
    return _local_scratch


_local_scratch: str | None = None


def saved(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the scratch folder and read it back.

    This cuts the lineage, survives lost executors, and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark).rstrip('/')}/jobloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BITS = 15     # a bitmap of Spark has 2 ** 15 bits


def picked(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """``texts``, which are ``saved`` with a column ``row`` of unique ids, of the given rows.  One bit a posting goes to the tasks, so that texts cross no shuffle to be found."""
    low = (1 << BITS) - 1
    found = rows.groupBy(F.shiftright("row", BITS).alias("at")).agg(F.bitmap_construct_agg(F.col("row").bitwiseAND(low)).alias("bits"))
    found = sorted(found.collect())
    at = np.array([r["at"] for r in found], np.int64)
    bits = np.frombuffer(b"".join(r["bits"] for r in found), np.uint8).reshape(-1, 1 << BITS - 3)
    shared = rows.sparkSession.sparkContext.broadcast((at, bits))

    @F.pandas_udf(BooleanType())
    def wanted(row: pd.Series) -> pd.Series:
        at, bits = shared.value
        row = row.to_numpy(np.int64)
        if not len(at):
            return pd.Series(np.zeros(len(row), bool))
        k, place = np.minimum(np.searchsorted(at, row >> BITS), len(at) - 1), row & low
        return pd.Series((at[k] == row >> BITS) & ((bits[k, place >> 3] >> (place & 7)) & 1 == 1))

    return texts.where(wanted("row"))
