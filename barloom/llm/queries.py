"""The registered queries of this folder, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    centroids, decontaminate, lattice, licenses, mixing, ngram_join, pieces, pii, prefix_trie, quality_pu, quality_rules, secret_scan, warc,
)
from barloom.llm.text import listed

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every document."""
    spans = pii.private_spans(_read(spark, sf_dir, "documents"), carry=("doc_id",))
    return spans.select(
        "row.doc_id", *[f"n_{k}" for k in pii.KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the archives give it back."""
    found = warc.archived(_read(spark, sf_dir, "pages"), least_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice likelihood and word baseline of every document."""
    return lattice.scored(_read(spark, sf_dir, "documents"), piece_model())


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = secret_scan.find_secrets(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "row.doc_id",
        *[count(k).cast("long").alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and near-copy component of every document."""
    return ngram_join.near_copies(_read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts, base failure and final verdict of every document."""
    rows = quality_rules.judged(_read(spark, sf_dir, "documents"), carry=("doc_id",))
    return rows.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_pu.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return licenses.find_licenses(_read(spark, sf_dir, "documents")).select("row.doc_id", "sentence_ids", "licenses")


def piece_model() -> str:
    """The public vocabulary that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to it."""
    found = pieces.encoded(_read(spark, sf_dir, "documents"), piece_model())
    return found.select("row.doc_id", "n_tokens", "ids", "exact")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every vector after ten rounds."""
    return centroids.clustered(_read(spark, sf_dir, "embeddings")).drop("compared")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations."""
    return prefix_trie.trie(_read(spark, sf_dir, "conversations"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mixed(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_warc": op2_warc,
    "op3_lattice": op3_lattice,
    "op4_secrets": op4_secrets,
    "op5_ngram_join": op5_ngram_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_license_scans": op8_license_scans,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_decontamination": op10_decontamination,
    "op11_centroids": op11_centroids,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_mixing": op13_mixing,
}
