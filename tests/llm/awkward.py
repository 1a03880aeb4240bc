"""Small tables with the cases every operator has to stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names of result columns, which the input may have too
CLASHES = ("n_tokens long, kept boolean, score double, labels string, size long, shards string, n_bytes long, _key long, "
           "_text string, id long, print long, host string, keep_id long, component_id long, stretches string")


def rows() -> list[tuple]:
    long = " ".join(f"w{i % 977} of the" for i in range(20_000))
    texts = [(1, "The cat sat on the mat and the dog lay down by the door of the house"), (2, None), (3, ""), (4, " \n\t "),
             (5, long), (6, "one"), (7, "The cat sat on the mat\nand the dog lay down by the door of the house"),
             (8, "Licensed under the MIT License, see cc by and CC-BY 4.0"), (None, "The cat sat on the mat"),
             (None, None), (9, "ÀÉ漢字 😀 naïve <|endoftext|> don't"), (9, "ÀÉ漢字 😀 naïve <|endoftext|> don't"),
             (10, long), (11, "a" * 3000), (12, "a\0b" * 90), (13, "a\0b" * 90)]
    return [(i, t, "en" if n % 3 else None, f"src{n % 3}" if n % 4 else None, None if n % 5 else 7) for n, (i, t) in enumerate(texts)]


def docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), DOCS).repartition(3)


def clashing(df: DataFrame) -> DataFrame:
    """The table with more columns that are named like results."""
    return df.selectExpr("*", *(f"CAST(NULL AS {kind}) AS {name}" for name, kind in
                                (c.strip().split(" ") for c in CLASHES.split(","))))


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)
