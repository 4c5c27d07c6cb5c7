"""The corpus pipeline: five stages over `documents`, each a function of (spark, docs, sf_dir) that returns what it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import decontamination, language_id, near_dup, packing, pii
from verdance.llm.common import table, written
from verdance.llm.queries import DEMO_KEY, tokenizer_path

#: Least share of the words that a document's language must have.
LEAST_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a language of at least LEAST_SHARE. Where no document names its language
    nothing can be judged, and all stay."""
    model = language_id.train(docs.where(~language_id.held_out(3, 1)))
    if not model[0]:
        return docs
    extra = ["lang_pred", "score", "lang_set"]
    kept = language_id.identify(docs.select(*(c for c in docs.columns if c not in extra)), model)
    return kept.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).drop(*extra)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one of the smallest id."""
    return near_dup.representatives(docs, 0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a 10-word window of a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), 10)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal values in the texts; n_chars follows. The key is the setting spark.verdance.pii.key; without it a
    demonstration key, whose pseudonyms anyone can undo, stands in."""
    out = pii.protect(docs, spark.conf.get("spark.verdance.pii.key", DEMO_KEY), count=False)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048."""
    return packing.pack_documents(docs, tokenizer_path(), 2048)


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("decontamination", decontaminate), ("pii", pseudonymise), ("packing", pack)]

#: SQL has neither the tokenizer nor the language model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
