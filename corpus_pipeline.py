"""The corpus pipeline: documents through five stages, each written and read again.

1. toxicity: documents with a toxic share of at least 0.3 go;
2. exact dedup: of equal texts the row with the smallest id stays;
3. near dedup: of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more,
   the one with the smallest id stays;
4. mixing: sources to their target weights, a document appears as often as the mix takes it;
5. byte-level BPE: encoded, decoded and digested; one row per row of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberstream.llm import byte_bpe, content_sort, mixing, shingle_join, toxicity
from emberstream.llm.queries import table, tokenizer
from emberstream.llm.workspace import bounded_batches, materialize

#: What near copies are in the pipeline: five words, a similarity of 0.8 or more.
NEAR = shingle_join.Rule(words=5, num=80, den=100)

#: Bytes of an Arrow batch, unless the session says otherwise: workers of three stages in a row keep the most that any needs.
BATCH = "1m"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark, BATCH)
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return content_sort.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark, BATCH)
    return shingle_join.drop_near_copies(docs, NEAR)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark, BATCH)
    path, pattern = tokenizer("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(docs, path, pattern)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage_{i + 1}")
    return docs


#: SQL can express neither a trained classifier nor the merges; tests compare with brute force.
ORACLE_SQL = None
