"""Plain text, CSV and JSON contents to lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import newlines
from inkspan.sources.csv_rows import csv_rows
from inkspan.sources.json_trees import json_values


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, page, line, text): pages end at form feeds, lines at any other line separator, both counted from 1. A
    final line end opens no further line, and blank pages at the end are none; null texts have no lines."""
    even = F.col("__even")
    docs = docs.select(id_col, F.col(text_col), newlines(F.col(text_col)).alias("__even"))
    text = F.when(F.contains(even, F.lit("\f")), F.regexp_replace(even, r"(\f\s*)+\z", "")).otherwise(even)
    pages = docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text, "\f")).alias("p", "t"))
    whole = F.when(F.endswith("t", F.lit("\n")), F.left("t", F.length("t") - 1)).otherwise(F.col("t"))
    lines = pages.select(id_col, (F.col("p") + 1).alias("page"), F.posexplode(F.split(whole, "\n")).alias("l", "text"))
    return lines.select(id_col, "page", (F.col("l") + 1).alias("line"), "text")


def csv_lines(files: DataFrame, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """(id_col, line, text): csv_rows with each content's own delimiter. A content that is no CSV (an open quote) has the
    lines it has up to there; csv_rows refuses it. Null contents have none."""
    return csv_rows(files, id_col, text_col, broken=True)


def json_lines(files: DataFrame, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """(id_col, line, text): every string value of a JSON content in document order, a line each, keys left out.

    Contents that are no JSON, and null ones, have no lines.
    """
    return json_values(files, id_col, text_col).select(id_col, (F.col("at") + 1).alias("line"), "text")


def jsonl_pages(files: DataFrame, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """(id_col, page, line, text): each record of a JSON Lines content is a page, named by its line; bad records and
    records without a string are skipped."""
    records = text_lines(files, id_col, text_col).where("trim(text) <> ''").select(id_col, F.col("line").alias("page"), "text")
    keyed = records.select(F.struct(id_col, "page").alias("key"), "text")
    return json_lines(keyed, "key", "text").select("key.*", "line", F.trim("text").alias("text"))
