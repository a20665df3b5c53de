"""CSV and TSV contents to rows, each content by its own delimiter, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import collapsed

#: Delimiters, in the order that decides between equally frequent ones.
DELIMITERS = (",", ";", "\t", "|")
_ROW, _CELL = "\x1e", "\x1f"


def delimiter(text: Column) -> Column:
    """The most frequent delimiter outside of quotes in the first line that is not blank; a comma if there is none."""
    head = F.regexp_replace(F.regexp_extract(F.regexp_replace(text, '"(?:[^"]|"")*+"', "q"), r"(?:^|[\r\n])([^\r\n]*\S[^\r\n]*)", 1), '"', "")
    counts = [F.struct((F.length(head) - F.length(F.replace(head, F.lit(d)))).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["d"]).otherwise(",")


def _cells(text: Column, mark: Column) -> Column:
    """Cells with what ends them, as cut out by the content's delimiter; together they are the content if it is sound."""
    inside = F.concat(F.lit("[^\\r\\n\\Q"), mark, F.lit("\\E]"))
    plain = F.concat(F.lit('(?!")'), inside, F.lit("*+"))
    return F.regexp_extract_all(text, F.concat(F.lit('\\G(?:"(?:[^"]|"")*+"|'), plain, F.lit(")(?:\\r\\n|[\\r\\n]|\\Q"), mark, F.lit("\\E|\\z)")), F.lit(0))


def csv_table(files: DataFrame, id_col: str = "path", text_col: str = "content", kind: str = "csv", broken: bool = False) -> DataFrame:
    """(id_col, status, rows) per content: ok with the rows as arrays of cells, or corrupt with none; null for null.

    Cells have their white space collapsed; in quotes a doubled quote is one, and delimiters and line ends are text. A
    quote that never ends, or is followed by more than a delimiter or line end, makes a content corrupt. NULs are
    dropped. With broken, a corrupt content keeps the rows that end before its fault. kind "tsv" takes tabs, "csv" each content's own delimiter. Nothing moves between tasks.
    """
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\0"))
    t = files.select(id_col, F.col(text_col).isNull().alias("__null"), text.alias("__text")).withColumn("__mark", F.lit("\t") if kind == "tsv" else delimiter(F.col("__text")))
    t = t.withColumn("__cells", _cells(F.col("__text"), F.col("__mark")))
    sound = F.aggregate("__cells", F.lit(0), lambda acc, c: acc + F.length(c)) == F.length("__text")

    def cell(c: Column) -> Column:
        ends = c.endswith("\n") | c.endswith("\r")
        bare = F.when(ends, F.rtrim(c, F.lit("\r\n"))).when(c.endswith(F.col("__mark")), F.substr(c, F.lit(1), F.length(c) - 1)).otherwise(c)
        value = F.when(F.left(c, F.lit(1)) == '"', F.replace(F.regexp_replace(c, '^"|"[^"]*$', ""), F.lit('""'), F.lit('"'))).otherwise(bare)
        return F.concat(collapsed(value), F.when(ends, _ROW).otherwise(_CELL))

    flat = F.array_join(F.transform("__cells", cell), "")
    rows = F.transform(F.split(flat, _ROW), lambda r: F.split(F.regexp_replace(r, f"{_CELL}$", ""), _CELL))
    status = F.when(F.col("__null"), None).when(sound, "ok").otherwise("corrupt")
    sane = F.when(status == "ok", rows)
    if broken:
        sane = F.when(status == "corrupt", F.slice(rows, F.lit(1), F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(sane)
    return t.select(id_col, status.alias("status"), sane.alias("rows"))


def csv_rows(files: DataFrame, id_col: str = "path", text_col: str = "content", kind: str = "csv", broken: bool = False) -> DataFrame:
    """(id_col, line, text): the non-empty cells of each row joined by a tab; rows without one are left out and not
    counted. Contents that are null or corrupt have none, but with broken; csv_table tells them."""
    lines = F.transform("rows", lambda r: F.array_join(F.filter(r, lambda c: c != ""), "\t"))
    table = csv_table(files, id_col, text_col, kind, broken)
    out = table.select(id_col, F.posexplode(F.filter(lines, lambda x: x != "")).alias("l", "text"))
    return out.select(id_col, (F.col("l") + 1).alias("line"), "text")
