"""A training corpus from raw documents: quality rules, language, near-duplicates, source mix, packed sequences.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and reread as the next one's ``docs``.  All but
the last return the columns of ``documents``.  Defined results for nulls, empty texts, repeated rows and empty tables are
those of the operators.  Stage by stage: a null text has no words, so the quality rules reject it; documents whose
language is rejected or undetermined go; one row of each near-duplicate component stays; the mix may repeat a row or leave
it out; the last stage returns the placed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgrec.llm import language, mixing, packing, quality, simhash
from kgrec.llm.common import load, written
from kgrec.llm.queries import digested_pieces


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, load(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.kept(docs, language.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.place(digested_pieces(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("simhash near-dedup", near_duplicates),
    ("source mix", source_mix),
    ("best-fit packing", packed_sequences),
]

# The rules, the language model and the packing are learned or searched: SQL cannot express them (tests check by brute force).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
