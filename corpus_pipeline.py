"""Corpus preparation: five stages over `documents`, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from screenflow.llm.decontamination import drop_contaminated
from screenflow.llm.language import keep_known
from screenflow.llm.pii import redact_pii
from screenflow.llm.queries import piece_model
from screenflow.llm.sentencepiece_codec import encode_checked
from screenflow.llm.simhash import keep_one
from screenflow.session import materialize

LEAST_SCORE = 0.2  # no text below it is taken, whatever the learned texts score


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in one of the languages that the labels name; those without letters go."""
    return keep_known(docs, LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of test items, whether these have an id or not."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the names of its kinds."""
    return redact_pii(docs, length="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, checked by decoding: `exact` tells whether the text comes back."""
    return encode_checked(docs, piece_model())


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", pii),
    ("encode", encode),
]

ORACLE_SQL = None  # no stage but the third can be put in SQL; tests hold run() against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each one keeps is written to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


CASES = {"pipeline": (run, ORACLE_SQL)}
