"""The corpus pipeline: five stages, each an operator over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tsumugi.llm import decontaminate, jaccard, lexicon, quality, suffixes
from tsumugi.llm.common import drop_path, public_tokenizer, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    return quality.kept(docs, quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.one_of_each(docs)


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeats of 400 bytes cover."""
    return suffixes.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents with passages of two items or more go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids and the decoded text."""
    vocabulary = public_tokenizer("byte_bpe_50k.json")
    return lexicon.encoded(docs, vocabulary, lexicon.build_lexicon(docs, vocabulary), keys=["doc_id"], raw_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeated_text_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", token_stage),
]

#: Compressed sizes, suffix arrays and merges are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage but the last is written and read again."""
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = scratch(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if last and i:
            drop_path(spark, last)
        last = path
    return docs
