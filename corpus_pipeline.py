"""The corpus pipeline: toxicity, exact and near duplicates, source mixing, packing.

Each stage takes all that its predecessor kept, is written as Parquet and read again; all but
the last return the columns of documents. The third stage keeps one document of each group of
near duplicates. The fourth repeats rows of sources that the target weights raise, and drops none.
The last has one row for each piece of a document in a training window, and one for each without words.

Defined cases: documents with null identifiers go through all stages and are near copies of none; null
and empty texts count as copies of one another (of each kind one stays) and never as toxic; repeated rows
leave one; columns other than doc_id, text and source come through the first four stages as they were, under any
name; empty tables give no rows. A stage's folder is deleted once its successor's is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import exact, mixing, neardup, packing, toxicity
from docquarry.runtime import remove, shared_dir, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def reject_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def reject_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", reject_copies),
    ("near_dedup", reject_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_windows),
]

#: Classifier training, MinHash and packing have no counterpart in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents of ``sf_dir``; each stage's rows lie in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder, last = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if last:
            remove(spark, last)
        last = at
    return docs
