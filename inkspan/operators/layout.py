"""Page layout: running headers and footers, paragraphs, boxes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkspan.functions.text import collapsed, stripped
from inkspan.operators.page_geometry import together, whole_pages

#: Share of the height that is a margin, share of the pages that a running line stands on, a page number.
MARGIN, PAGES_SHARE = 0.1, 0.5
PAGE_NUMBER = r"(?i)^[\s\-–—]*(?:(?:page|strana|str\.|s\.)\s*)?(?:\d{1,4}|[ivxlcdm]{1,7})(?:\s*(?:/|z|of|ze)\s*\d{1,4})?[\s\-–—]*$"
#: Fixed value: a gap is a break if it is this many times the usual one.
GAP_RATIO = 1.8


def band(top: Column, bottom: Column, height: Column) -> Column:
    """header or footer for what lies wholly in a margin, else null."""
    return F.when(bottom <= MARGIN * height, "header").when(top >= (1 - MARGIN) * height, "footer")


def furniture_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(text)), r"\s+", " "), r"\d+", "#")


def furniture(units: DataFrame, doc: Sequence[str], page: str) -> DataFrame:
    """units (doc, page, top, bottom, height, text, in_table) with region: header or footer if a margin line repeats on
    two pages and half of the document's at least (digits made equal), or is a page number. Pages without a height do
    not count."""
    u = units.withColumn("band", F.when((F.col("height") > 0) & ~F.col("in_table"), band(F.col("top"), F.col("bottom"), F.col("height")))).withColumn("norm", furniture_key(F.col("text")))
    pages = units.where("height > 0").groupBy(*doc).agg(F.count_distinct(page).alias("pages"))
    seen = u.where("band is not null").groupBy(*doc, "band", "norm").agg(F.count_distinct(page).alias("repeats"))
    often = seen.join(pages, list(doc)).where((F.col("repeats") >= 2) & (F.col("repeats") >= PAGES_SHARE * F.col("pages"))).select(*doc, "band", "norm", F.lit(True).alias("often"))
    marked = u.join(often, [*doc, "band", "norm"], "left")
    region = F.when(F.coalesce("often", F.lit(False)) | (F.col("band").isNotNull() & F.col("text").rlike(PAGE_NUMBER)), F.col("band"))
    return marked.withColumn("region", region).select(*units.columns, "region")


def paragraphs(lines: DataFrame, page: Sequence[str], order: str) -> DataFrame:
    """lines (page, order, top, bottom, col, region, heading) with paragraph, counted from 0 in each page.

    A line opens one if the gap above it exceeds GAP_RATIO times the lower quartile of the page's positive gaps, if
    column, region or heading level change, or if it stands above the line before. A page is one window group.
    """
    w, whole = Window.partitionBy(*page).orderBy(order), Window.partitionBy(*page)
    was = {c: F.lag(c).over(w) for c in ("top", "bottom", "col", "region", "heading")}
    gap = F.greatest(F.lit(0.0), F.col("top") - was["bottom"])
    changed = ~F.col("col").eqNullSafe(was["col"]) | ~F.col("region").eqNullSafe(was["region"]) | ~F.col("heading").eqNullSafe(was["heading"]) | (F.col("top") < was["top"] - 1)
    g = lines.withColumns({"gap": gap, "first": F.row_number().over(w) == 1, "changed": changed})
    sizes = F.sort_array(F.collect_list(F.when(F.col("gap") > 0, F.col("gap"))).over(whole))
    usual = F.get(sizes, F.floor(F.size(sizes) / 4).cast("int"))
    g = g.withColumn("opens", ~F.col("first") & (F.coalesce(F.col("gap") > usual * GAP_RATIO, F.lit(False)) | F.coalesce("changed", F.lit(False))))
    return g.withColumn("paragraph", F.sum(F.col("opens").cast("int")).over(w).cast("int")).select(*lines.columns, "paragraph")


def box_union(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, x0, y0, x1, y1): the least box around all of a key; null sides do not count."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


#: Boxes of a key beyond which they are first made distinct spans of cells; rows of cells that are filled at a time. Any
#: values give the same result.
MANY, SPANS = 10_000, 1 << 20


def _filled(spans: pa.Table, key: np.ndarray, grid: int) -> np.ndarray:
    """Cells under the boxes (c0, c1, r0, r1) of each key; keys are whole numbers from 0, ascending."""
    c0, c1, r0, r1 = (spans.column(c).to_numpy().astype(np.int64) for c in ("c0", "c1", "r0", "r1"))
    out, tall, lo = np.zeros(int(key[-1]) + 1, np.int64), r1 - r0, 0
    ends = np.cumsum(tall)
    while lo < len(key):
        # whole keys, SPANS rows of cells or one key
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SPANS, "right"))
        hi = int(np.searchsorted(key, key[hi])) if hi < len(key) else len(key)
        hi = hi if hi > lo else int(np.searchsorted(key, key[lo], "right"))
        n = tall[lo:hi]
        at = np.repeat(np.arange(lo, hi), n)
        row = r0[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        line = (key[at] - key[lo]) * grid + row
        order = np.argsort(line * (grid + 1) + c0[at], kind="stable")
        line, at = line[order], at[order]
        # lines lie one after another, so a running maximum over all does not reach into the next
        start, end = line * (grid + 1) + c0[at], line * (grid + 1) + c1[at]
        ahead = np.r_[0, np.maximum.accumulate(end)[:-1]]
        new = np.maximum(0, end - np.maximum(start, ahead))
        out += np.bincount(key[at], new, len(out)).astype(np.int64)
        lo = hi
    return out


def union_share(boxes: DataFrame, keys: Sequence[str], grid: int = 100) -> DataFrame:
    """(keys, share): the share of the frame (fx0, fy0, fx1, fy1) under the union of its boxes, on grid x grid cells.

    A cell counts if its centre is inside a box. A box moves once, as the cells of its corners; boxes of a key meet
    there, row of cells by row of cells. Of a key with more than MANY boxes first the longest span by row and first cell
    is found, by an aggregate that merges before it moves, so never more than grid * grid spans of a key meet.
    """
    def cell(side, origin, size):
        return F.ceil(F.try_divide(F.col(side) - F.col(origin), F.col(size) - F.col(origin)) * grid - 0.5)

    def spans(low, high, origin, size):
        return F.greatest(F.lit(0), F.least(cell(low, origin, size), cell(high, origin, size))), F.least(F.lit(grid), F.greatest(cell(low, origin, size), cell(high, origin, size)))

    (c0, c1), (r0, r1) = spans("x0", "x1", "fx0", "fx1"), spans("y0", "y1", "fy0", "fy1")
    sound = F.coalesce((F.col("fx1") > F.col("fx0")) & (F.col("fy1") > F.col("fy0")) & (c0 < c1) & (r0 < r1), F.lit(False))
    # a box without cells stays, as its key has a share
    corner = lambda c: F.when(sound, c).otherwise(0).cast("int")
    cut = boxes.select(*keys, corner(c0).alias("c0"), corner(c1).alias("c1"), corner(r0).alias("r0"), corner(r1).alias("r1"))
    many = F.broadcast(boxes.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > MANY).select(*(F.col(k).alias(f"__m_{k}") for k in keys), F.lit(True).alias("__many")))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__m_{k}")) for k in keys), F.lit(True))
    told = cut.join(many, same, "left").drop(*(f"__m_{k}" for k in keys))
    rows = told.where("__many").select(*keys, "c0", "c1", F.explode(F.when(F.col("r0") < F.col("r1"), F.sequence("r0", F.col("r1") - 1)).otherwise(F.array(F.lit(0)))).alias("r0"))
    longest = rows.groupBy(*keys, "r0", "c0").agg(F.max("c1").alias("c1")).select(*keys, "c0", "c1", "r0", (F.col("r0") + 1).alias("r1"))
    met = together(told.where("__many is null").drop("__many").unionByName(longest), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, key in whole_pages(batches, keys):
            head = t.select(list(keys)).take(pa.array(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])))
            yield from head.append_column("__filled", pa.array(_filled(t, key, grid))).to_batches()

    filled = met.mapInArrow(run, StructType([*met.select(*keys).schema.fields]).add("__filled", "long"))
    return filled.select(*keys, (F.col("__filled") / (grid * grid)).alias("share"))
