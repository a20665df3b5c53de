"""Benchmark decontamination by pigeonhole edit matching.

A test item of length m with an error budget of k edits is cut into k + 1 pieces. Wherever the item stands in a text
with at most k edits, one piece stands there unchanged. An automaton of all pieces finds those hits in one pass over a
text. The same holds for any run of j neighbouring pieces and j - 1 edits, so a hit is verified by Myers' bit-parallel
distance over ever longer runs of pieces around it, halves of halves of the item, and at last over the whole item; most
chance hits end at the first run of two pieces.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import table

#: An item may differ by this share of its characters, rounded down.
ERROR_RATE = 0.1
#: Characters of test items that one pass takes; a larger benchmark takes further passes over the texts.
BLOCK_CHARS = 4_000_000
_GAP = re.compile(r"\s+")


def normal(text: str | None) -> str:
    """Lower case, white space runs as one space, trimmed. Distances and positions are of this form."""
    return _GAP.sub(" ", text.lower()).strip() if text else ""


def budget(length: int) -> int:
    return int(length * ERROR_RATE)


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces, nearly equal in length."""
    n = budget(len(item)) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def runs(n: int) -> list[list[tuple[int, int]]]:
    """For each of n pieces, the runs (first, past the last) that halving the item leads through, shortest first,
    without the piece itself and the whole item."""
    out = []
    for k in range(n):
        lo, hi, path = 0, n, []
        while hi - lo > 1:
            path.append((lo, hi))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if k < mid else (mid, hi)
        out.append(path[:0:-1])
    return out


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def best_end(peq: dict[str, int], m: int, text: str, start: int, stop: int) -> tuple[int, int]:
    """(distance, end) of the best match of an item, given by its masks, that ends in text[start:stop]; first of equals."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, start
    get = peq.get
    for j in range(start, stop):
        eq = get(text[j], 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, at = score, j + 1
        ph = ph << 1
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv & full
    return best, at


class Matcher:
    """Finds (item, distance, start bound, end) in texts."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.masks = [masks(t) for _, t in self.items]
        self.parts: dict[tuple[int, int, int], tuple[str, dict]] = {}
        self.cuts, self.paths = [], []
        where: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        for k, (_, t) in enumerate(self.items):
            own = pieces(t)
            self.cuts.append([*(a for a, _ in own), len(t)])
            self.paths.append(runs(len(own)))
            for j, (offset, p) in enumerate(own):
                where[p].append((k, j, offset + len(p)))
        self.automaton = ahocorasick.Automaton()
        for p, places in where.items():
            self.automaton.add_word(p, places)
        if where:
            self.automaton.make_automaton()

    def _holds(self, text: str, k: int, j: int, start: int) -> bool:
        """Whether the runs around piece j of item k, which would begin at start, are all near enough."""
        cuts = self.cuts[k]
        for lo, hi in self.paths[k][j]:
            part = self.parts.get((k, lo, hi))
            if part is None:
                run = self.items[k][1][cuts[lo] : cuts[hi]]
                part = self.parts[k, lo, hi] = (run, masks(run))
            run, peq = part
            at, b = start + cuts[lo], hi - lo - 1
            if not (at >= 0 and text.startswith(run, at)) and best_end(peq, len(run), text, max(0, at - b), min(len(text), at + len(run) + b))[0] > b:
                return False
        return True

    def find(self, raw: str | None) -> dict[int, tuple[int, int, int]]:
        """{item_id: (distance, end, windows that match)}, the best window of each item."""
        text, starts = normal(raw), defaultdict(set)
        if not text or not self.items:
            return {}
        seen = set()
        for end, places in self.automaton.iter(text):
            for k, j, offset in places:
                start = end + 1 - offset
                if start not in starts[k] and (k, j, start) not in seen:
                    seen.add((k, j, start))
                    if self._holds(text, k, j, start):
                        starts[k].add(start)
        out: dict[int, tuple[int, int, int]] = {}
        for k, found in starts.items():
            item_id, item = self.items[k]
            m, b = len(item), budget(len(item))
            lo = hi = None
            windows = []
            for s in sorted(found):
                if lo is None or s > hi + 2 * b:
                    windows += [(lo, hi)] if lo is not None else []
                    lo = s
                hi = s
            windows += [(lo, hi)] if lo is not None else []
            for lo, hi in windows:
                if text.startswith(item, lo) if lo >= 0 else False:
                    d, end = 0, lo + m
                    if not b and any(0 <= x < len(text) and text[x].isalnum() and item[y].isalnum() for x, y in ((lo - 1, 0), (end, -1))):
                        continue  # a short item stands there as words, not inside one
                else:
                    d, end = best_end(self.masks[k], m, text, max(0, lo - b), min(len(text), hi + m + b))
                if d <= b:
                    old = out.get(item_id)
                    out[item_id] = (d, end, 1) if old is None else (*min(old[:2], (d, end)), old[2] + 1)
        return out


def _blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str) -> list:
    """Broadcasts of (id, text) lists, each of about BLOCK_CHARS characters or less; items of one id are in one list."""
    items = benchmark.where(F.length(F.trim(item_text)) > 0).select(F.col(item_col).alias("i"), F.col(item_text).alias("t"))
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = 1 if chars <= BLOCK_CHARS else -(-2 * chars // BLOCK_CHARS)
    parts = (items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k) for k in range(blocks))
    return [docs.sparkSession.sparkContext.broadcast([(r["i"], r["t"]) for r in p.toLocalIterator()]) for p in parts]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_col, distance, end, windows): each pair of a text and an item found in it within its budget.

    Null and blank texts and items match nothing; repeated rows give repeated results; items that share an id count as
    one. Items under ten characters have no budget and must not begin or end inside a word. The benchmark is cut into
    blocks by a hash of the id; each goes to all tasks as the only broadcast data, and texts are scanned once per
    block. Texts never move. Other columns, whatever they are called, are left alone.
    """
    schema = docs.select(id_col).schema.add(benchmark.select(item_col).schema[0]).add("distance", "integer").add("end", "integer").add("windows", "integer")
    item_type, found = to_arrow_type(benchmark.schema[item_col].dataType), None
    for sent in _blocks(docs, benchmark, item_col, item_text):

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for b in batches:
                rows = [(n, item, *got) for n, t in enumerate(b.column(1).to_pylist()) for item, got in matcher.find(t).items()]
                of, item, *rest = zip(*rows) if rows else ((),) * 5
                arrays = [b.column(0).take(pa.array(of, pa.int64())), pa.array(item, item_type), *(pa.array(x, pa.int32()) for x in rest)]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, item_col, "distance", "end", "windows"])

        some = docs.select(id_col, text_col).mapInArrow(scan, schema)
        found = some if found is None else found.unionByName(some)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that hold a test item, by the scan itself: no row moves, whatever its id or columns."""
    at = docs.columns.index(text_col)
    for sent in _blocks(docs, benchmark, item_col, item_text):

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for b in batches:
                yield b.filter(pa.array([not matcher.find(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
