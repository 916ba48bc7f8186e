"""A training-data pipeline over ``documents``: STAGES run in order, each written as Parquet and read again.

1. language identification: texts without a letter and unknown languages go; ``lang`` becomes the prediction.
2. near-duplicates: one document of each class stays.
3. personal data: spans are replaced by their kind in brackets.
4. mixing: documents appear as often as the balanced rates of their source say.
5. SentencePiece: token ids of every document of the mix, with an exact round-trip test.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import langid, neardup, pieces, pii
from marginalia.llm.balancing import mix_documents
from marginalia.session import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents whose id is not held out; documents predicted ``und`` are rejected."""
    return langid.keep_known(docs, langid.training_rows(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word runs, similarity 0.8 or more; the document with the smallest id of a class stays."""
    return neardup.keep_one(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts every base span and every span that the classifier adds; no document goes."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entropy balancing: every document as often as its tilted rate says; documents of rate 0 leave the mix."""
    return mix_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed documents; copies of a document stay separate rows."""
    return pieces.encode(docs, keep=["doc_id", "lang", "source"]).select("doc_id", "lang", "source", F.col("n_tokens"), F.col("ids"), F.col("round_trip"))


STAGES = [
    ("language", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("personal-data", remove_personal_data),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

# Learned filters, signatures and tokenizers have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
