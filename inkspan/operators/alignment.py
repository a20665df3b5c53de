"""Alignment of two readings of a text: longest common subsequences of their words, and what follows from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.text import collapsed

#: Bits of a table of one alignment that a task holds; larger ones are halved first.
TABLE_BITS = 1 << 30


def _rows(a: Sequence, b: Sequence) -> Iterator[int]:
    """Per item of b a number whose zero bits are the places of a at which the common length with b so far grows."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for y in b:
        hit = v & at.get(y, 0)
        v = ((v + hit) | (v - hit)) & full
        yield v


def _lengths(a: Sequence, b: Sequence) -> list[int]:
    """The common length of b with each beginning of a."""
    last, out = (1 << len(a)) - 1, [0]
    for last in _rows(a, b):
        pass
    for i in range(len(a)):
        out.append(out[-1] + (~last >> i & 1))
    return out


def common(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, in order; the table is kept as one bit per cell, and inputs whose
    table is too large are cut where the lengths of both halves of b add up best."""
    if len(a) * len(b) > TABLE_BITS and len(b) > 1:
        half = len(b) // 2
        one, two = _lengths(a, b[:half]), _lengths(a[::-1], b[half:][::-1])
        cut = max(range(len(a) + 1), key=lambda i: one[i] + two[len(a) - i])
        return common(a[:cut], b[:half]) + [(i + cut, j + half) for i, j in common(a[cut:], b[half:])]
    table, out, i = list(_rows(a, b)), [], len(a) - 1
    for j in range(len(b) - 1, -1, -1):
        # the last place whose length grows, at or before i; if it grew without b[j] too, b[j] is not needed
        grows = ~table[j] & (1 << i + 1) - 1
        before = ~table[j - 1] & (1 << i + 1) - 1 if j else 0
        if grows.bit_count() > before.bit_count():
            i = grows.bit_length() - 1
            while a[i] != b[j]:
                i = (grows & (1 << i) - 1).bit_length() - 1
            out.append((i, j))
            i -= 1
    return out[::-1]


def aligned(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, word: str) -> DataFrame:
    """(keys, left, right): the places (values of `order`) of a longest common subsequence of the words of each key.

    Words compare exactly, and null or empty ones are left out. A key that one side lacks has no pairs, a null key meets
    none. Places must be unique in a key. Keys are dealt over the tasks; a key's words, those of one document, meet in one.
    """
    def gathered(side: DataFrame, name: str) -> DataFrame:
        return side.where(F.col(word) != "").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("at"), F.col(word).alias("w")))).alias(name))

    both = gathered(left, "__one").join(gathered(right, "__two"), list(keys)).select(*keys, "__one", "__two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for one, two in zip(batch.column("__one").to_pylist(), batch.column("__two").to_pylist()):
                found.append([{"left": one[i]["at"], "right": two[j]["at"]} for i, j in common([x["w"] for x in one], [x["w"] for x in two])])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found, pa.list_(pa.struct([("left", pa.int64()), ("right", pa.int64())])))], names=[*keys, "__pairs"])

    kinds = dict(both.dtypes)
    pairs = both.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "`__pairs` array<struct<left:bigint,right:bigint>>"]))
    return pairs.select(*keys, F.explode("__pairs").alias("__p")).select(*keys, "__p.left", "__p.right")


def line_segments(words: DataFrame, pairs: DataFrame, rendered: DataFrame, doc: Sequence[str], line: str, order: str, word: str) -> DataFrame:
    """(doc, line, segment, page, row, text): native lines cut where their matched words change the rendered line.

    words has doc, line, order and word; rendered has doc, order, page, row and a box is not needed; pairs are those of
    aligned. A word without a match stays with the one before it in its line, or with the first match after it. A line
    without any takes the page of the line before it, else of the one after, and no row.
    """
    there = pairs.withColumnRenamed("right", order).join(rendered.select(*doc, order, "page", "row"), [*doc, order]).select(*doc, F.col("left").alias(order), F.struct("page", "row").alias("at"))
    w = words.join(there, [*doc, order], "left")
    inside = Window.partitionBy(*doc, line).orderBy(order)
    first = F.first("at", True).over(Window.partitionBy(*doc, line).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    w = w.withColumn("at", F.coalesce(F.last("at", True).over(inside), first))
    w = w.withColumn("cut", F.coalesce(~F.lag("at").over(inside).eqNullSafe(F.col("at")) & (F.row_number().over(inside) > 1), F.lit(False)).cast("int")).withColumn("segment", F.sum("cut").over(inside).cast("int"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, word))), lambda x: x[word]), " ")
    parts = w.groupBy(*doc, line, "segment").agg(text.alias("text"), F.first("at").alias("at"))
    ahead, behind = Window.partitionBy(*doc).orderBy(line, "segment"), Window.partitionBy(*doc).orderBy(F.desc(line), F.desc("segment"))
    page = F.coalesce(F.col("at.page"), F.last("at.page", True).over(ahead), F.last("at.page", True).over(behind))
    return parts.select(*doc, line, "segment", page.alias("page"), F.col("at.row").alias("row"), "text")


def compared(left: DataFrame, right: DataFrame, page: str, text: str, edges: Sequence[str], order: str) -> DataFrame:
    """(page, key, side, delta): the lines of two extractions by page and collapsed text, on both sides, left or right
    only, with the largest difference of an edge where both have it. Of equal keys on a side the last by order counts."""
    def read(rows: DataFrame, right: bool) -> DataFrame:
        return rows.select(F.col(page).alias("page"), collapsed(F.col(text)).alias("key"), F.lit(right).alias("right"), F.col(order).alias("at"), *(F.col(e).alias(f"e{i}") for i, e in enumerate(edges)))

    # both sides in one shuffle; a null page meets none, so there each side stays by itself
    rows = read(left, False).unionByName(read(right, True)).repartition("page", "key").withColumn("apart", F.when(F.col("page").isNull(), F.col("right")))
    of = lambda c, right: F.when(F.col("right") == right, F.col(c))
    # the last of a side by columns of fixed width, which hash in place where structs would be sorted
    lasts = [F.max_by(of(f"e{i}", side), of("at", side)).alias(f"{name}{i}") for side, name in ((False, "one"), (True, "two")) for i in range(len(edges))]
    both = rows.groupBy("page", "key", "apart").agg(F.max(of("at", False)).isNotNull().alias("left"), F.max(of("at", True)).isNotNull().alias("there"), *lasts)
    delta = F.greatest(*(F.abs(F.col(f"one{i}") - F.col(f"two{i}")) for i in range(len(edges))), F.lit(0.0)) if len(edges) else F.lit(0.0)
    side = F.when(~F.col("left"), "right").when(~F.col("there"), "left").otherwise("both")
    return both.select("page", "key", side.alias("side"), F.when(side == "both", delta).alias("delta"))
