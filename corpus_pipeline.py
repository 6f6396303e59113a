"""A training corpus from `documents`: five stages, each over all rows its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import decontamination, language_id, mixing, ngram_join, secrets
from statloom.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = "piece_bpe_32k.model"
#: Posterior below which the language of a document is not settled.
SURE = 0.5


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is settled: those without letters or with a posterior under SURE go."""
    docs = docs.select(*COLUMNS)
    found = language_id.predict(docs, language_id.learn(docs, public_tokenizers.path(VOCABULARY)))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*COLUMNS)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near-duplicates: that of the smallest doc_id."""
    return ngram_join.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontamination.clean(decontamination.search(docs.select(*COLUMNS), benchmark)).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every document stays, n_chars follows its text."""
    found = secrets.scan_with_own_findings(docs.select(*COLUMNS), public_tokenizers.path(VOCABULARY))
    chars = F.when(F.size("secrets") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint")
    return found.withColumn("n_chars", chars).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the documents it takes, with n_words, and the words taken of each (repeats counted)."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


STAGES = [
    ("language ID", identify_languages),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: Language models and forests have no SQL; tests/llm holds a brute-force version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(*COLUMNS)
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
