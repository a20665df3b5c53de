"""Line categories and their scores, a letter-share stand-in for an external line model, and kinds of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspan.functions.text import WHITE, stripped

#: The categories, and those of them that a quality model judged.
CATEGORIES = ("Clear", "Noisy", "Trash", "Non-text", "Empty")
JUDGED = ("Clear", "Noisy", "Trash")
#: Characters of prose at least, share of letters at least, a table-of-contents line.
PROSE_CHARS, PROSE_LETTERS = 20, 0.5
LEADERS = r"(\.\s?){4,}|…{2,}|_{4,}"


def letter_share(text: Column) -> Column:
    """Letters per non-space character; null for a blank line."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.try_divide(letters, F.length(F.regexp_replace(text, r"\s", "")))


def category(text: Column) -> Column:
    """By the share of letters, which is taken once per line."""
    of = lambda share: F.when(share.isNull(), "Empty").when(share >= 0.7, "Clear").when(share >= 0.4, "Noisy").when(share > 0, "Trash").otherwise("Non-text")
    return F.get(F.transform(F.array(letter_share(text)), of), F.lit(0))


def category_score(categ: Column) -> Column:
    return F.when(categ == "Clear", 0.9).when(categ == "Noisy", 0.6).when(categ == "Trash", 0.2).otherwise(0.0)


def line_kind(text: Column, in_table: Column | None = None) -> Column:
    """table, short, few letters, dot leaders or prose: the first that fits."""
    def of(t):
        solid = F.length(F.regexp_replace(t, WHITE, ""))
        few = F.length(F.regexp_replace(t, r"[^\p{L}]", "")) < PROSE_LETTERS * solid
        return F.when(F.length(t) < PROSE_CHARS, "short").when(few, "few letters").when(t.rlike(LEADERS), "dot leaders").otherwise("prose")

    kind = F.get(F.transform(F.array(stripped(text)), of), F.lit(0))
    return kind if in_table is None else F.when(in_table, "table").otherwise(kind)
