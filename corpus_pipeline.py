"""A training corpus from ``documents``: toxic documents, exact copies, near copies and documents that hold benchmark
passages go; what is left is encoded, and decoded again.

Each stage takes all that its predecessor kept, as Parquet in the shared folder.

Defined cases, for every stage: a null text is the empty text; all empty texts are exact copies of each other, of which
one stays; rows repeated whole are copies; null ids are kept as they are; extra columns, whatever their names, are carried
along to the last stage; without labels of both kinds no document is toxic; without benchmark items none holds one; an
empty table gives an empty result. The result has one row for each document that is left: doc_id, n_tokens, ids_sha256,
decoded_sha256 and the ids themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.llm import bpe, dart_minhash, decontaminate, exact_dedup, toxicity
from examlake.llm.common import documents, held_out, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of those not held out, doesn't predict to be toxic."""
    return toxicity.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", held_out(F.col("doc_id"), 5, 0))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with the same normalised text."""
    return exact_dedup.keep_owners(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return dart_minhash.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and digests of them and of what they decode to."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("byte_level_bpe", encode_and_decode),
]

#: trained models and near-duplicate classes are beyond SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
