"""A training corpus from raw documents: each stage reads what its predecessor kept, written as Parquet in between."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bytebpe, decontaminate, jaccard, language, secrets
from tidemark.plans.settle import settle


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those between two languages, go; the model learns from the documents' labels."""
    usable = ~language.held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    model = language.fit(docs.filter(usable), "doc_id", "text", "lang")
    whole = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    found = language.identified(whole, model)
    return found.filter(~F.col("ambiguous") & (F.col("lang_pred") != language.UNKNOWN)).select("__row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by 5-word shingles at 0.75 the document with the least id stays."""
    return jaccard.one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return decontaminate.with_matches(whole, items).filter(F.size("matches") == 0).select("__row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out of the texts; the documents stay, with their new length."""
    whole = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    clean = secrets.redacted(whole)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("text").eqNullSafe(F.col("__row.text")), F.col("__row.n_chars"))
           .otherwise(F.length("text").cast("long"))}
    return clean.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, by the byte-level vocabulary."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bytebpe.encoded_digests(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("byte_bpe", encoded),
]
ORACLE_SQL = None  # models and tokenizers are beyond SQL; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
