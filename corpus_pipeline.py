"""Stages that turn ``documents`` into an encoded training corpus; each works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from repeatwise.llm.exact import drop_exact_copies
from repeatwise.llm.mixing import mixed_documents
from repeatwise.llm.ngram_join import drop_similar
from repeatwise.llm.pieces import encode_documents
from repeatwise.llm.quality import kept_documents
from repeatwise.llm.queries import tokenizer
from repeatwise.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return kept_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar word shingles."""
    return drop_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document with the source bytes of each piece."""
    return encode_documents(docs, tokenizer("piece_bpe_32k.model")).drop("decoded").withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
