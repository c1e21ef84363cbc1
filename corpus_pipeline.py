"""Corpus pipeline: quality, near-duplicates, benchmark leaks, mixture, shards.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns the documents its successor works on.  All but the last return the
columns of ``documents``; the last adds ``shard`` and ``slot``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, kneser_ney, mixing, sharding, simhash
from tessera.llm.common import ensure_checkpoint_dir
from tessera.llm.queries import table, trusted_ids

SHARDS = 8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier accepts; it is fitted on the trusted ones among ``docs``.

    Empty, null and very short texts are kept: they hold too little to judge.
    """
    found = kneser_ney.marked(docs, kneser_ney.judge(docs, trusted_ids(spark, sf_dir)))
    return found.where("accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of texts whose five-word shingles are similar at about 0.8 or more.

    All empty texts are one group.
    """
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item; null and empty texts hold none."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every source to its target, documents as often as that needs, in the order of the curriculum."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add ``shard`` and ``slot``; shards are nearly equal in bytes."""
    return sharding.histogram_shard(docs, SHARDS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: The stages rest on fitted models and 64-bit hashes that DuckDB lacks; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again.

    A stage's folder goes when its successor is written.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:
            past = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
            past.getFileSystem(spark._jsc.hadoopConfiguration()).delete(past, True)
    return docs
