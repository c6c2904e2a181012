"""The corpus pipeline: from raw documents to shards of a mixed training corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ferrule.llm import decontaminate, jaccard_join, langid, mixing, sharding
from ferrule.llm.common import checkpoint_dir, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language, or hardly in one, go."""
    model = langid.fit(docs.select("doc_id", "text", "lang").where(langid.fold("doc_id", 4) != 2))
    return langid.keep(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of 5-word shingles join, the smallest doc_id stays."""
    return jaccard_join.keep_first(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix takes it; the next stage deals the rows anew, so they are not sorted here."""
    return mixing.mixed(docs, ordered=False)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, with the shard and slot of each."""
    return sharding.shard_whole(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: SQL cannot express the language model, the shingle components or the alignments; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each on what the one before wrote to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
