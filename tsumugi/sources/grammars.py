"""Grammar definitions: one JSON file each, in a folder a level."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.operators.patterns import empty

SCHEMA = "id string, level string, description string, formation string, priority int, explanation string, pattern string, examples array<struct<jp: string, en: string>>, negativeExamples array<struct<jp: string, en: string>>, startGate string"


def grammars(spark: SparkSession, folder: str, level: str | None = None) -> DataFrame:
    """The definitions of all levels below ``folder``, or of one; ``pattern`` is JSON text."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.filter(F.col("id").isNotNull() & (F.lit(True) if level is None else F.col("level") == level))


def rules(found: DataFrame) -> list[dict]:
    """The definitions with a pattern as rules for ``patterns.find_patterns``, the highest priority first; a catalogue is small by nature."""
    out = []
    for r in found.select("id", "level", "priority", "pattern", "startGate").collect():
        pattern = json.loads(r["pattern"]) if r["pattern"] else {}
        if not empty(pattern):
            out.append({"id": r["id"], "level": r["level"], "priority": r["priority"] or 0, "pattern": pattern, "startGate": json.loads(r["startGate"]) if r["startGate"] else None})
    return sorted(out, key=lambda r: -r["priority"])
