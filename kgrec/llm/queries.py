"""Registered queries of the training-data operators; each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgrec.llm import (
    ann,
    conversations,
    html_text,
    language,
    lm_score,
    mixing,
    packing,
    quality,
    sharding,
    simhash,
    substring,
    token_files,
    whitening,
)
from kgrec.llm.common import load
from kgrec.llm.oracles import ORACLE  # noqa: F401 - read by __spark_entry__
from kgrec.sources.files import scratch_path


def op1_lm_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(load(spark, sf_dir, "documents"))


def digested_pieces(docs: DataFrame) -> DataFrame:
    """The packing operator's pieces with the checksum of their ids in the ids' place (``packing.pack`` carries the ids themselves)."""
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.place(digested_pieces(load(spark, sf_dir, "documents")))


def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shuffled(load(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = rows.select(
        "record.doc_id", (sharding.text_bytes(F.col("record.text")) + 8).alias("size"),
        F.crc32(F.coalesce(F.col("record.text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "bucket", "place")
    return sharding.cut(digest).select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write(load(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(load(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op7_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language.learn(docs.withColumn("held_out", held_out).filter("not held_out and doc_id is not null"))
    return language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model, ["doc_id", "held_out"]).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.judge(docs.select("doc_id", "text"), load(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, rows.filter("vec_id % 20 = 0"))


def op11_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    return whitening.whiten(rows, whitening.fit(whitening.fit_list(rows)))


def op12_count_min_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.deduplicated(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(rows), rows)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_lm_pseudo_likelihood, op2_best_fit_packing, op3_external_shuffle, op4_token_files, op5_entropy_mix, op6_page_difference,
    op7_subword_language, op8_simhash_tiles, op9_decision_list, op10_projection_forest,
    op11_qdwh_whitening, op12_count_min_substring, op13_hirschberg_repair, pipeline)}
