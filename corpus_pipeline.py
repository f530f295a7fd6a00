"""A corpus pipeline: five of the training-data operators in a row, each on all that the one before has kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm import bpe, exact_dedup, minhash, mixing, toxicity
from streamloom.llm.common import checkpoint_folder, fold, fresh, release, table

#: Documents from this score on go.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the Kneser-Ney models score as toxic; null and empty texts have no evidence and repeated rows go or stay together."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    score, = fresh(docs, "toxic_score")
    return toxicity.score(docs, model, name=score).where(F.col(score) < TOXIC).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """One document of each group of equal texts, that of the largest doc_id; null counts as empty, and of rows that repeat it one stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """One document of each class of near-duplicates, that of the smallest doc_id; empty texts and rows without doc_id stay."""
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """The documents, and parts of documents, that the mix takes, as often as it takes them; those without words are never taken."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) of every row, and the SHA-256 of what they decode to; null counts as empty."""
    got = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: SQL cannot express the stages' models; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for sf_dir's documents; each stage is written as Parquet to the shared folder and read again.

    A stage's files are deleted when the next one's are complete. Null texts count as empty and rows that
    repeat a doc_id are documents of their own, but for near-duplicates, where they share its class; with
    an empty table every stage is empty.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    done = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        release(spark)
        if done:
            path(done).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(done), True)
        done = f"{folder}/{name}"
    return docs
