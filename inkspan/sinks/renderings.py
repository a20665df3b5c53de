"""Lines as parts of plain text, Markdown or JSON files: a row per line, whose parts joined in order are the file.

A part hangs on the rows before and after it only, so a file is never held as a whole. Lines of a file are in one window,
in the order in which the sink writes them; pages and lines are put in order by their own values, nulls first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.text import stripped


def _one_line(text: Column) -> Column:
    """Markup of comments and line breaks made harmless."""
    return _harmless(F.regexp_replace(text.cast("string"), r"[\n\r\x0B\f\x1c-\x1e\x{85}\x{2028}\x{2029}]+", " "))


def _harmless(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<!--"), F.lit("&lt;!--")), F.lit("-->"), F.lit("--&gt;"))


def _shown(text: Column) -> Column:
    """A stripped line of text that no reader takes for a heading."""
    return F.regexp_replace(_harmless(text), "^#", r"\\#")


def _quoted(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(text.cast("string"))), r"^\[|\]$", "")


def _placed(lines: DataFrame, file: str, page: str, line: str, text: str, title: str | None = None) -> tuple[DataFrame, dict]:
    """Lines with whether they begin or end their page or file and whether they say something."""
    d = lines.select(F.col(file).alias("file"), F.col(page).alias("page"), F.col(line).alias("line"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([] if title is None else [F.col(title).alias("title")]))
    order = Window.partitionBy("file").orderBy("page", "line", "text")
    d = d.withColumns({"before": F.lag(F.struct("page")).over(order), "after": F.lead(F.struct("page")).over(order)})
    # told behind the windows, so that a text moves once
    d = d.withColumn("said", stripped(F.col("text")))
    new = F.col("before").isNull() | ~F.col("before.page").eqNullSafe(F.col("page"))
    end = F.col("after").isNull() | ~F.col("after.page").eqNullSafe(F.col("page"))
    d = d.withColumns({"new": new, "end": end, "first": F.col("before").isNull(), "last": F.col("after").isNull(), "full": F.col("said") != ""})
    return d, {"order": order, "so_far": order.rowsBetween(Window.unboundedPreceding, 0)}


def _parts(d: DataFrame, part: Column) -> DataFrame:
    return d.select("file", "page", "line", "text", part.alias("part")).select("file", "page", "line", F.col("text").alias("tie"), "part")


def plain_parts(lines: DataFrame, file: str, page: str = "page", line: str = "line", text: str = "text") -> DataFrame:
    """(file, page, line, tie, part) of plain text: a row per line that says something, stripped, and an empty row where a
    page begins; empty rows at the ends are left out, a line feed ends the file. A file without text is a line feed."""
    d, w = _placed(lines, file, page, line, text)
    # pages begun so far, and how many had begun at the last line that said something
    d = d.withColumn("pages", F.count_if("new").over(w["so_far"]))
    d = d.withColumn("at", F.max(F.when(F.col("full"), F.col("pages"))).over(w["order"].rowsBetween(Window.unboundedPreceding, -1)))
    feeds = F.when(F.col("at").isNotNull(), F.repeat(F.lit("\n"), (F.col("pages") - F.col("at") + 1).cast("int"))).otherwise("")
    return _parts(d, F.concat(F.when(F.col("full"), F.concat(feeds, "said")).otherwise(""), F.when(F.col("last"), "\n").otherwise("")))


def markdown_parts(lines: DataFrame, file: str, page: str = "page", line: str = "line", text: str = "text", title: str | None = None) -> DataFrame:
    """(file, page, line, tie, part) of Markdown: a heading per page, blank pages too, and below it a row per line that
    says something, stripped and so that it reads as neither heading nor comment; title, a column, heads the file by the
    value of its first line."""
    d, _ = _placed(lines, file, page, line, text, title)
    # lines that say something are counted per page by a window of the same order
    on_page = Window.partitionBy("file", "page").orderBy("line", "text").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("filled", F.max("full").over(on_page))
    head = F.concat(F.when(~F.col("first"), F.lit("\n\n")).otherwise(""), F.lit("## Page "), _one_line(F.coalesce(F.col("page").cast("string"), F.lit("None"))), F.lit("\n"))
    named = F.lit("") if title is None else F.when(F.col("first") & F.col("title").isNotNull(), F.concat(F.lit("# "), _one_line(F.col("title")), F.lit("\n\n"))).otherwise("")
    return _parts(d, F.concat(named, F.when(F.col("new"), head).otherwise(""), F.when(F.col("full"), F.concat(F.lit("\n"), _shown(F.col("said")))).otherwise(""), F.when(F.col("last") & F.col("filled"), "\n").otherwise("")))


def json_parts(lines: DataFrame, file: str, page: str = "page", line: str = "line", text: str = "text") -> DataFrame:
    """(file, page, line, tie, part) of JSON: the file's name and its pages, each with its number and its lines as they
    are; null texts are empty ones, a line feed ends the file."""
    d, _ = _placed(lines, file, page, line, text)
    front = F.when(F.col("first"), F.concat(F.lit('{"file": '), _quoted(F.col("file")), F.lit(', "pages": ['))).otherwise("")
    number = F.coalesce(F.to_json(F.array("page")), F.lit("[null]"))
    opened = F.when(F.col("new"), F.concat(F.when(F.col("first"), "").otherwise(", "), F.lit('{"page": '), F.regexp_replace(number, r"^\[|\]$", ""), F.lit(', "lines": ['))).otherwise(", ")
    closed = F.concat(F.when(F.col("end"), "]}").otherwise(""), F.when(F.col("last"), "]}\n").otherwise(""))
    return _parts(d, F.concat(front, opened, _quoted(F.col("text")), closed))
