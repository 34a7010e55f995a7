"""From documents to packed training sequences: five stages, each one operator of ``fleetlens.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again
as the next one's docs; all but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import decision_list, exact, mixing, packing, trie_join
from fleetlens.session import checkpointed, remove_folder, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the rules learnt from the labels keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return decision_list.keep_good(docs, decision_list.learn(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact.drop_exact_duplicates(docs)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets, the one with the least doc_id."""
    return trie_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated as their source's target asks, three times at most.

    Documents stay whole: the last one of a source is taken if its middle is still asked for.
    """
    return mixing.mixture(docs, whole=True).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 4096 tokens.

    Pieces are stored in between, so that a task has one Python worker at a time.
    """
    return packing.pack(checkpointed(packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("jaccard_dedup", jaccard_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: Learnt rules, components, tokens and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; tables between them go to the shared folder and leave it again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *inner, (_, final) = STAGES
    for name, stage in inner:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    packed = checkpointed(final(spark, docs, sf_dir))
    remove_folder(spark, folder)
    return packed
