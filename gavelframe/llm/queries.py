"""Queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelframe.llm import bpe, embedding_dedup, line_templates, mixing, ngram_join, permutation_index, pii, token_files, toxicity, warc
from gavelframe.llm.storage import Scratch

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: F.Column) -> F.Column:
    """The keys that training never sees."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4 == 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out=held_out)
    scored = toxicity.score(docs.select("doc_id", "text"), lexicon)
    out = scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.3).cast("int").alias("predicted"), F.col("toxicity_terms").alias("terms"))
    return Scratch(spark).save_bounded(out, "toxicity-scores", 1000)


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), is_query=lambda key: key % 50 == 0)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(spark, table(spark, sf_dir, "documents"), VOCABULARY)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved_digests(bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY))


def bpe_digests(rows: DataFrame) -> DataFrame:
    """The digest columns of a round trip."""
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def saved_digests(rows: DataFrame) -> DataFrame:
    """bpe_digests, written with small batches."""
    return Scratch(rows.sparkSession).save_bounded(bpe_digests(rows), "bpe-digests")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_permutation_index, op3_token_files, op4_bpe, op5_warc, op6_mixing, op7_pii, op8_line_templates, op9_embedding_dedup, op10_ngram_join)}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.ORACLE_SQL, "op8_line_templates": line_templates.ORACLE_SQL}
