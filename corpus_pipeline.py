"""Corpus pipeline: five training-data operators, each on all that its predecessor kept.

run() writes the rows of every stage as Parquet to the shared checkpoint folder
and reads them again for the next one, so a lost executor costs one stage at most.
A stage's files go once the next one is written; the last stage's are the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, jaccard_join, line_dedup, packing, quality_cnn
from plumbline.llm.common import crc_mod, table
from plumbline.llm.queries import TOKENIZERS
from plumbline.shared import remove, shared_folder
from plumbline.shipping import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    ship(spark)
    net = quality_cnn.fit(docs, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 3) != 1))
    return quality_cnn.accepted(docs, net)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    ship(spark)
    return jaccard_join.one_per_class(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier ranked document holds; a document of which nothing is left goes."""
    ship(spark)
    cut = line_dedup.without_repeats(docs)
    kept = cut.filter(F.col("removed").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("removed")
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    ship(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    ship(spark)
    return packing.pack_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", with_ids=False)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The first stage is a learned classifier, which SQL cannot express; tests hold all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)                                # its successor is written in full
        before = f"{folder}/{name}"
    return docs
