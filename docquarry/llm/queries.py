"""Registered queries of the subpackage, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from docquarry.llm import exact, knn, langid, mixing, neardup, packing, passages, secrets, tokens, toxicity
from docquarry.runtime import table


def _knn(spark, sf_dir):
    found = knn.neighbors(table(spark, sf_dir, "embeddings"), queries=knn.ASKED)
    return found.withColumn("distance", F.round("distance", 5))


QUERIES = {
    "op1_toxicity": lambda s, d: toxicity.classify(table(s, d, "documents"), table(s, d, "labels")),
    "op2_packing": lambda s, d: packing.pack(table(s, d, "documents")),
    "op3_exact_dedup": lambda s, d: exact.exact_dedup(table(s, d, "documents")),
    "op4_language_id": lambda s, d: langid.identify(table(s, d, "documents")),
    "op5_source_mixing": lambda s, d: mixing.mix(table(s, d, "documents")),
    "op6_exact_top_k": _knn,
    "op7_minhash_pairs": lambda s, d: neardup.near_classes(table(s, d, "documents")),
    "op8_passage_dedup": lambda s, d: passages.repeated_passages(table(s, d, "documents")),
    "op9_token_counts": lambda s, d: tokens.count_tokens(table(s, d, "documents")),
    "op10_secret_scan": lambda s, d: secrets.scan(table(s, d, "documents")),
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op3_exact_dedup": "SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY text",
    "op5_source_mixing": mixing.ORACLE,
    "op6_exact_top_k": knn.ORACLE,
}
