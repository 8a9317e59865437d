"""A structured lookup whose answer is the key of a lookup in text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_lines(table: DataFrame, lines: DataFrame, status: str, value: str = "value") -> DataFrame:
    """Rows of a table, each with the line of text whose first word is its status; null where there is none."""
    word = F.substring_index(F.col(value), " ", 1)
    return table.join(lines.select(word.alias(status), F.col(value)), status, "left")


def first_lines(chosen: DataFrame, documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line): the first line of the text of each chosen row."""
    return chosen.select(key).join(documents.select(key, text), key).select(key, F.substring_index(text, "\n", 1).alias("line"))
