"""The queries of this package and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import ann
from jobloom.llm.common import table
from jobloom.llm.decontaminate import find_contamination
from jobloom.llm.exact import exact_dedup
from jobloom.llm.licenses import scan_licenses
from jobloom.llm.lm import fit, score_documents
from jobloom.llm.mixing import plan_mix
from jobloom.llm.near import near_classes
from jobloom.llm.negatives import mine_negatives
from jobloom.llm.pages import extract_main_text
from jobloom.llm.passages import remove_repeats
from jobloom.llm.runs import find_runs, repeated, words_in
from jobloom.llm.tokens import token_counts
from jobloom.llm.toxicity import held_out, score_toxicity, train

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_classes(docs, n=4).select(F.col("_key").alias("doc_id"), "n_shingles", "component_id", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return hits.withColumnsRenamed({"_key": "doc_id", "_item": "item_id"})


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH prints AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
groups AS (
  SELECT text_sha256, count(*) AS group_size, max(size) AS longest FROM prints GROUP BY 1),
winners AS (
  SELECT p.text_sha256, min(p.doc_id) AS keep_id FROM prints p JOIN groups g
  ON p.text_sha256 = g.text_sha256 AND p.size = g.longest GROUP BY 1)
SELECT p.doc_id, w.keep_id, g.group_size, p.doc_id = w.keep_id AS kept, p.text_sha256
FROM prints p JOIN groups g USING (text_sha256) JOIN winners w USING (text_sha256)
"""


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    models = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, models).select("doc_id", "n_tokens", "target_loss", "background_loss", "score")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, texts=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows, F.col("_key") % 100 == 0, label=moved)


OP11_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbered AS (SELECT vec_id, label, list_transform(v, lambda x: floor(256 * x)) AS v,
  row_number() OVER (PARTITION BY vec_id ORDER BY label, v) AS copy FROM usable),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM numbered a JOIN numbered b ON a.vec_id <> b.vec_id
  WHERE a.copy = 1 AND b.copy = 1 AND a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
ranked AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10
"""


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.neighbours(ann.build(rows), rows.where("vec_id % 100 = 0"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    n, g = words_in(F.col("text")), F.floor(h / 10)
    first = g % n
    planted = repeated(F.col("text"), first, 1 + F.floor((n - first) / (3 + g % 8)))
    found = find_runs(docs, F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col("text")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        F.col("_key").alias("doc_id"), "n_runs", "start", "length", "period",
        F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_token_counts, op2_near_dedup, op3_decontamination, op4_toxicity, op5_main_text, op6_license_scan, op7_exact_dedup,
                              op8_lm_scores, op9_repeated_passages, op10_source_mix, op11_hard_negatives, op12_nearest_neighbours, op13_periodic_runs)
}
SQL: dict[str, str] = {"op7_exact_dedup": OP7_SQL, "op11_hard_negatives": OP11_SQL}
