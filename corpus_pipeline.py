"""Documents made ready for training, one stage after the other: each stage's rows are written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, ngram_join, pieces, pii, quality_rules
from barloom.llm.queries import piece_model
from barloom.llm.text import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule and no host verdict rejects."""
    return quality_rules.keep_documents(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose personal data and disclosing terms are labelled or cut out."""
    return pii.sanitised(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the piece ids of every document; exact tells that they decode to its text."""
    found = pieces.encoded(docs, piece_model())
    return found.select("row.doc_id", "row.lang", "row.source", "n_tokens", "ids", "exact").withColumn("n_tokens", F.col("n_tokens").cast("long"))


STAGES = [
    ("quality rules", quality),
    ("n-gram join", distinct),
    ("decontamination", clean_of_benchmark),
    ("pii", private),
    ("sentencepiece", tokenised),
]
#: SQL states no latent space and no Viterbi path; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
