"""Table functions: one text, many rows, for use in SQL."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tsumugi.functions.chars import NUMERAL
from tsumugi.functions.kana import kana_number, number_of


@udtf(returnType="start int, number string, value long, kana string")
class Numbers:
    """The numerals of a text: numbers_of(text) gives a row for each run of them whose value fits 64 bits."""

    def eval(self, text: str | None):
        for m in re.finditer(f"[{NUMERAL}]+", text or ""):
            value = number_of(m[0])
            if value is not None and value < 1 << 63:
                yield m.start(), m[0], value, kana_number(value)


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL."""
    spark.udtf.register("numbers_of", Numbers)
