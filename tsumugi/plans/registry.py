"""All registered queries outside the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tsumugi.plans import engine, japanese, relational, windows

QUERIES = relational.QUERIES | japanese.QUERIES | windows.QUERIES | engine.QUERIES
ORACLES = relational.ORACLES | japanese.ORACLES | windows.ORACLES | engine.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents against a small lexicon: the core substring join."""
    return QUERIES["substring_lexicon_join"](spark, sf_dir)
