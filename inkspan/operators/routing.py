"""Decode verdicts of lines and pages, routes of pages and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.decode import decode_report, is_mojibake, is_undecodable, line_quality, with_report

#: Kinds of pages by what they hold.
FACETS = {
    "graphical": ("DRAW", "DRAW_L", "PHOTO", "PHOTO_L", "TEXT"),
    "tabular": ("DRAW_L", "LINE_HW", "LINE_P", "LINE_T", "PHOTO_L"),
    "handwritten": ("LINE_HW", "TEXT", "TEXT_HW"),
    "printed": ("LINE_P", "TEXT", "TEXT_P"),
    "typed": ("LINE_T", "TEXT", "TEXT_T"),
}
ROUTES = ("nlp", "ocr", "htr", "none")


def decoded_lines(lines: DataFrame, page: Sequence[str], text_col: str = "text") -> DataFrame:
    """lines with decode_score and decode: garbled, or null for a line that decodes.

    Once a line of a page is a misreading, its other lines with a misread letter are too, unless they hold what the
    misreading cannot produce. That verdict is one flag per page, joined back.
    """
    r = with_report(lines, text_col, "__r")
    r = r.withColumns({"__m": is_mojibake(F.col("__r")), "__u": is_undecodable(F.col("__r"))})
    condemned = F.max("__m").over(Window.partitionBy(*page))
    weak = condemned & (F.col("__r.suspicious") >= 1) & F.col("__r.encodable") & ~F.col("__r.foreign")
    return r.withColumns({"decode_score": line_quality(F.col("__r")), "decode": F.when(F.col("__m") | F.col("__u") | weak, "garbled")}).drop("__r", "__m", "__u")


def page_decode(decoded: DataFrame, page: Sequence[str], digits: int = 4) -> DataFrame:
    """(page, decode_score, lines, garbled, needs_ocr): the mean score of a page's lines, and whether any is garbled."""
    garbled = F.count_if(F.col("decode") == "garbled")
    return decoded.groupBy(*page).agg(F.round(F.avg("decode_score"), digits).alias("decode_score"), F.count("*").alias("lines"), garbled.alias("garbled"), (garbled > 0).alias("needs_ocr"))


def atr_reasons(decoded: DataFrame, pages: DataFrame, page: Sequence[str], text_col: str = "text") -> DataFrame:
    """(page, reasons, needs_atr, mojibake, undecodable, lines) per page of pages (page, text_layer, textual).

    decoded are the lines with their verdict. A page needs text recognition if a line is a misreading (`mojibake`), if
    one is mostly lost characters (`undecodable`), if nothing but running lines, or nothing at all, has a text layer
    (`furniture_only`, `no_text`), or if its layer is an earlier recognition (`prior_ocr`); reasons lists these in that
    order, comma-joined. A textual page has nothing to render and never needs it. Pages without lines count none.
    """
    lost = is_undecodable(decode_report(F.col(text_col)))
    counts = decoded.groupBy(*page).agg(F.count("*").alias("lines"), F.count_if((F.col("decode") == "garbled") & lost).alias("undecodable"), F.count_if(F.col("decode") == "garbled").alias("garbled"))
    p = pages.join(counts, list(page), "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("lines", "undecodable", "garbled")}).withColumn("mojibake", F.col("garbled") - F.col("undecodable"))
    bare = F.coalesce(F.col("text_layer") == "none", F.lit(False))
    said = [F.when(F.col("mojibake") > 0, "mojibake"), F.when(F.col("undecodable") > 0, "undecodable"), F.when(bare & (F.col("lines") > 0), "furniture_only"), F.when(bare & (F.col("lines") == 0), "no_text"), F.when(F.col("text_layer") == "ocr", "prior_ocr")]
    reasons = F.when(F.coalesce("textual", F.lit(False)), "").otherwise(F.array_join(F.filter(F.array(*said), lambda x: x.isNotNull()), ","))
    return p.select(*page, reasons.alias("reasons"), (reasons != "").alias("needs_atr"), "mojibake", "undecodable", "lines")


def category_route(category: Column) -> Column:
    """htr for handwriting only, ocr for other text, none for pictures; null for a kind that is not known."""
    known = sorted({c for members in FACETS.values() for c in members})
    of = {c: {f for f, members in FACETS.items() if c in members} for c in known}

    def route(c):
        return "none" if not of[c] - {"graphical"} else "htr" if "handwritten" in of[c] and not of[c] & {"printed", "typed"} else "ocr"

    return F.element_at(F.create_map(*(F.lit(x) for c in known for x in (c, route(c)))), category)


def page_route(trash_share: float = 0.5, least_prose: int = 5) -> Column:
    """The route of a page (text_layer, category, lines_scored, trash, prose_scored, prose_trash, drew, furniture_only).

    Pages that were never scored have null counts; null prose counts let all lines decide.
    """
    by_kind = category_route(F.col("category"))
    share = F.when(F.col("prose_scored").isNull(), F.try_divide("trash", "lines_scored")).when(F.col("prose_scored") >= least_prose, F.try_divide("prose_trash", "prose_scored"))
    digital = F.when(F.col("furniture_only") & by_kind.isin("ocr", "htr"), by_kind).when(share > trash_share, "ocr").otherwise("nlp")
    bare = (F.col("text_layer") == "none") & ~F.col("drew") & F.col("category").isNull()
    return F.when(F.col("text_layer") == "blank", "none").when(F.col("text_layer") == "digital", digital).when(bare, "none").otherwise(F.coalesce(by_kind, F.lit("ocr")))


def document_summary(routed: DataFrame, doc: Sequence[str], page: str) -> DataFrame:
    """(doc, pages, a count per route, needs_atr_pages, reacquire_pages, document_route) of pages with route and
    needs_atr. document_route is the one route besides none, mixed if there are several, none if there is none."""
    counts = [F.count_if(F.col("route") == r).alias(r) for r in ROUTES]
    pages = [F.sort_array(F.collect_list(F.when(c, F.col(page)))).alias(n) for n, c in (("needs_atr_pages", F.col("needs_atr")), ("reacquire_pages", F.col("route").isin("ocr", "htr")))]
    out = routed.groupBy(*doc).agg(F.count("*").alias("pages"), *counts, *pages, F.collect_set(F.when(F.col("route") != "none", F.col("route"))).alias("some"))
    one = F.when(F.size("some") == 0, "none").when(F.size("some") == 1, F.get("some", F.lit(0))).otherwise("mixed")
    return out.withColumn("document_route", one).drop("some")


def lane(probability: Column, accept_at: float, review_below: float) -> Column:
    """accept from accept_at on, review below review_below, escalate between; null stays null."""
    if review_below > accept_at:
        raise ValueError("review_below must not exceed accept_at")
    return F.when(probability >= accept_at, "accept").when(probability < review_below, "review").when(probability.isNotNull(), "escalate")
