"""Positions of regular-expression matches, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

#: Matches that are placed by one fold. An array that grows is copied at each step, so folds are kept short.
BLOCK = 64
KIND = "array<struct<start:bigint,end:bigint,s:string>>"


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, s>> of the leftmost non-overlapping matches, in code points, end exclusive.

    The gaps that splitting leaves and the matches themselves alternate, so their lengths give all positions. Matches
    are placed within blocks first, then the blocks, so the work grows in proportion to the matches.
    """
    def within(block):
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(KIND).alias("out"))

        def step(acc, x):
            return let(F.struct((acc["at"] + x["gap"]).alias("a"), (acc["at"] + x["gap"] + F.length(x["s"])).alias("b")), lambda p: F.struct(
                p["b"].alias("at"), F.concat(acc["out"], F.array(F.struct(p["a"].alias("start"), p["b"].alias("end"), x["s"].alias("s")))).alias("out")))

        return F.aggregate(block, start, step)

    def offsets(blocks):
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(blocks, start, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def moved(blocks):
        return F.flatten(F.zip_with(blocks, offsets(blocks), lambda b, o: F.transform(b["out"], lambda x: F.struct((x["start"] + o).alias("start"), (x["end"] + o).alias("end"), x["s"].alias("s")))))

    def pieces(p):
        each = F.transform(p["m"], lambda s, i: F.struct(F.length(F.get(p["gaps"], i)).alias("gap"), s.alias("s")))
        return let(each, lambda e: F.transform(F.sequence(F.lit(0), F.floor((F.size(e) - 1) / BLOCK).cast("int")), lambda b: within(F.slice(e, b * BLOCK + 1, F.lit(BLOCK)))))

    def placed(m):
        return F.when(F.size(m) == 0, F.array().cast(KIND)).otherwise(let(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("gaps")), lambda p: let(pieces(p), moved)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
