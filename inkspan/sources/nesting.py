"""Nesting of tokens that open and close, by running counts: no recursion and no stack, whatever the depth."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.operators.page_geometry import whole_pages

_NEW = "level int, end int, box int, box_name string, key_box int, key_name string, bad boolean"
#: Tokens of whole contents that are looked at together; one content may have more.
TOKENS = 1 << 17


@dataclass
class Tokens:
    """Tokens of whole contents: their bytes, where each begins (and the last ends), and the number of its content."""

    data: np.ndarray
    at: np.ndarray
    content: np.ndarray

    def byte(self, k: int) -> np.ndarray:
        """The k-th byte of each token, from its end for a negative k; 0 where a token is shorter."""
        place = self.at[:-1] + k if k >= 0 else self.at[1:] + k
        inside = (place >= self.at[:-1]) & (place < self.at[1:])
        return np.where(inside, self.data[np.where(inside, place, 0)], 0) if len(self.data) else np.zeros(len(place), np.uint8)

    def texts(self, which: np.ndarray, skip: int = 0, less: int = 0) -> pa.StringArray:
        """The texts of some tokens, without their first `skip` and last `less` bytes."""
        return cut_out(self.data, self.at[which] + skip, self.at[which + 1] - less)


def cut_out(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.StringArray:
    """The texts from a to b."""
    size = b - a
    ends = np.r_[0, np.cumsum(size)]
    place = np.repeat(a - ends[:-1], size) + np.arange(ends[-1])
    return pa.StringArray.from_buffers(len(a), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[place])))


def token_slices(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[pa.RecordBatch, list[Tokens]]]:
    """Batches in slices of whole contents, each with the tokens of its columns of lists of texts, of which none is null."""
    for batch in batches:
        lists = [batch.column(c) for c in columns]
        ends = [np.asarray(x.offsets).astype(np.int64) for x in lists]
        total, a = sum(ends), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(total, total[a] + TOKENS, "right")) - 1)
            out = []
            for x, e in zip(lists, ends):
                texts = x.values.slice(e[a], e[b] - e[a]).cast(pa.string())
                _, offsets, data = texts.buffers()
                at = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
                bytes_ = np.frombuffer(data, np.uint8) if data is not None and len(texts) else np.zeros(0, np.uint8)
                out.append(Tokens(bytes_[at[0]:at[-1]], at - at[0], np.repeat(np.arange(b - a), np.diff(e[a:b + 1]))))
            yield batch.slice(a, b - a), out
            a = b


def nest(opens: np.ndarray, closes: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """level, end, box and bad of the tokens of whole contents: how many brackets are open around each, where its bracket
    closes and which one is the innermost around it (by number, -1 for none), and whether it closes nothing.

    A count of open brackets gives the level. Brackets of one depth open and close in turn, so an opening one ends at the
    next of its depth; the innermost around a token is the last before it that opens one level up.
    """
    n = len(opens)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool)
    part = np.cumsum(np.r_[False, content[1:] != content[:-1]])
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    step = opens.astype(np.int64) - closes
    count = np.cumsum(step)
    count -= (count - step)[starts][part]
    bad = np.zeros(n, bool)
    if count.min() < 0:
        # what falls to a new low below zero closes nothing; contents are set far apart so that each has a low of its own
        low = np.minimum(np.minimum.accumulate(count - part * (2 * n + 2)) + part * (2 * n + 2), 0)
        was = np.r_[0, low[:-1]]
        was[starts] = 0
        bad, count = low < was, count - low
    level = count - opens + (closes & ~bad)
    end, box = np.full(n, -1), np.full(n, -1)
    marks = np.flatnonzero(opens | closes & ~bad)
    depth = level[marks] - closes[marks]
    deep = int(depth.max(initial=0))
    order = np.argsort(depth.astype(np.int16) if deep < 1 << 15 else depth, kind="stable")
    marks, depth = marks[order], depth[order]
    pair = np.flatnonzero(opens[marks[:-1]] & closes[marks[1:]])
    end[marks[pair]] = marks[pair + 1]
    # the box changes behind brackets and at the begin of a content only
    turn = np.r_[True, (opens | closes)[:-1]]
    turn[starts] = True
    heads = np.flatnonzero(turn)
    inner = heads[level[heads] > 0]
    first = opens[marks]
    boxes = marks[first]
    place = np.searchsorted(depth[first] * n + boxes, (level[inner] - 1) * n + inner) - 1
    box[inner] = boxes[place]
    return level, end, box[heads][np.cumsum(turn) - 1], bad


def holder(box: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Per token the innermost box around it that has something, -1 for none: boxes without pass on to their own, in as
    many steps as the depth has binary digits."""
    up = np.where(has, np.arange(len(box)), box)
    while True:
        ahead = np.where(up >= 0, up[up], -1)
        if (ahead == up).all():
            return np.where(box >= 0, up[box], -1)
        up = ahead


def nested(tokens: DataFrame, content: str) -> DataFrame:
    """tokens (content, pos, opens, closes, name, ...) with level, end, box, box_name, key_box, key_name and bad.

    The tokens of a content must stand together and in order, as they do where it was taken apart; content is its number.
    level is how many brackets are open around a token; box and box_name are the place and the name of the innermost of
    them (null outside of all), key_box and key_name those of the innermost with a name; end is the place where an opening
    token's bracket closes, null if it never does. Closing tokens stay, with their own bracket as box; bad are those that
    close nothing. A stream of which one content is held: nothing moves between tasks.
    """
    names = tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_pages(batches, [content]):
            opens, closes = (np.asarray(t.column(c)).astype(bool) for c in ("opens", "closes"))
            pos, name = np.asarray(t.column("pos")), t.column("name").combine_chunks()
            level, end, box, bad = nest(opens, closes, at)
            key = holder(box, np.asarray(name.is_valid()))
            number = lambda x: pa.array(pos[x], pa.int32(), mask=x < 0)
            text = lambda x: name.take(pa.array(x, mask=x < 0))
            for (n, k), v in zip((x.split() for x in _NEW.split(", ")), (pa.array(level, pa.int32()), number(end), number(box), text(box), number(key), text(key), pa.array(bad))):
                t = t.append_column(n, v)
            yield from t.to_batches()

    schema = tokens.limit(0).select("*", *(F.lit(None).cast(k).alias(n) for n, k in (x.split() for x in _NEW.split(", ")))).schema
    return tokens.select(names).mapInArrow(run, schema)


def enclosing(inner: DataFrame, outer: DataFrame, step: Column) -> DataFrame:
    """(id, node, path): per row of inner the steps of the outer elements around or at it, outermost first.

    The elements around one are found by halving: spans of places are split at powers of two, so that a row meets only
    the spans it lies in, never all elements of its file.
    """
    all_sizes = [1 << 2 * k for k in range(16)]
    wide = outer.select("id", F.col("node").alias("a"), "end", step.alias("step")).withColumn("size", F.element_at(F.array(*map(F.lit, all_sizes)), F.least(F.lit(16), F.ceil(F.log2(F.col("end") - F.col("a") + 2) / 2).cast("int") + 1)))
    cells = wide.select("*", F.explode(F.sequence(F.floor(F.col("a") / F.col("size")), F.floor(F.col("end") / F.col("size")))).alias("cell"))
    # the sizes in use, sixteen at most
    sizes = sorted(r["size"] for r in wide.select("size").distinct().collect()) or all_sizes[:1]
    points = inner.select("id", "node", F.explode(F.array(*(F.struct(F.lit(s).alias("size"), F.floor(F.col("node") / s).alias("cell")) for s in sizes))).alias("c")).select("id", "node", "c.*")
    met = points.join(cells.hint("merge"), ["id", "size", "cell"]).where("a <= node and node <= end")
    return met.groupBy("id", "node").agg(F.transform(F.sort_array(F.collect_list(F.struct("a", "step"))), lambda x: x["step"]).alias("path"))
