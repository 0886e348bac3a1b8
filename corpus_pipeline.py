"""A corpus pipeline over ``documents``: classify quality, remove near
duplicates, redact secrets, mix sources, pack into windows. Every stage is
written as Parquet and read again."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import fm
from faultlens.llm.minhash import near_duplicates
from faultlens.llm.mixing import mix_documents
from faultlens.llm.packing import pack_documents
from faultlens.llm.queries import byte_bpe
from faultlens.llm.secrets import redact_secrets
from faultlens.session import shared_path
from faultlens.sources.tables import table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return fm.keep_good(docs, fm.train(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"])))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    gone = near_duplicates(docs, shingle=5, similarity=(80, 100)).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; ``n_chars`` follows."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to their weights and laid out in mixed blocks; every
    document stays once or more."""
    return mix_documents(docs, whole=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 tokens, a row per piece."""
    return pack_documents(docs, byte_bpe())


STAGES = [("quality classifier", classify), ("minhash near-dedup", deduplicate), ("secret scan", scan),
          ("source mixing", mix), ("packing", pack)]

#: SQL expresses neither the learnt classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table lies in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = os.path.join(shared_path(spark, "pipeline"), uuid.uuid4().hex)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
