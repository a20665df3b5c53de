"""Tree-edit-distance similarity (TEDS) of tables.

Tables are cut into elements by the XML source; counts over their places give each node its number in postorder and that
of its leftmost leaf. A pair's contents are in one row, so nothing moves between tasks. Pairs of the same two shapes take the
same steps, so they take them together, as do the edits of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.sources.nesting import token_slices
from inkspan.sources.xml_trees import TOKEN, Elements

#: Pairs of the same shapes from which on they go together, and pairs of texts that do.
TOGETHER, TEXTS = 8, 1 << 16


def edits(a: str, b: str) -> int:
    """Levenshtein distance, a column of its table at a time as bits of whole numbers."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top, up, down, n = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << len(a)) - 1, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (full & ~(diagonal | up)), up & diagonal
        n += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | (full & ~(diagonal | rise)), rise & diagonal
    return n


def many_edits(texts: Sequence[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The edits of many pairs of texts, by their numbers: the same table, its columns as one whole number of 64 bits per pair."""
    size = np.array([len(x) for x in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.r_[0, np.cumsum(size)[:-1]]
    a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    out = np.empty(len(a), np.int64)
    long = size[a] > 64
    for i in np.flatnonzero(long).tolist():
        out[i] = edits(texts[a[i]], texts[b[i]])
    out[size[a] == 0] = size[b][size[a] == 0]
    rest = np.flatnonzero(~long & (size[a] > 0))
    rest = rest[np.argsort(-size[b[rest]], kind="stable")]
    for start in range(0, len(rest), TEXTS):
        some = rest[start:start + TEXTS]
        x, y, n = a[some], b[some], size[b[some]]
        wide = int(size[x].max())
        place = first[x][:, None] + np.arange(wide)
        letters = np.where(np.arange(wide) < size[x][:, None], points[np.minimum(place, len(points) - 1)], np.uint32(0xFFFFFFFF))
        one, full = np.uint64(1), ~np.uint64(0) >> (64 - size[x]).astype(np.uint64)
        top, up, down, d = one << (size[x] - 1).astype(np.uint64), full.copy(), np.zeros(len(some), np.uint64), size[x].copy()
        for j in range(int(n[0])):
            # longer ones come first, so those that are not at their end are the first k
            k = int(np.searchsorted(-n, -j, "left"))
            hit = np.packbits(letters[:k] == points[first[y[:k]] + j][:, None], axis=1, bitorder="little")
            eq = np.zeros((k, 8), np.uint8)
            eq[:, :hit.shape[1]] = hit
            eq, u, w, f = eq.view("<u8")[:, 0], up[:k], down[:k], full[:k]
            diagonal = (((eq & u) + u) ^ u) | eq | w
            rise, fall = w | (f & ~(diagonal | u)), u & diagonal
            d[:k] += (rise & top[:k]) != 0
            d[:k] -= (fall & top[:k]) != 0
            rise, fall = (rise << one | one) & f, fall << one & f
            up[:k], down[:k] = fall | (f & ~(diagonal | rise)), rise & diagonal
        out[some] = d
    return out


def _distance(left: tuple[Sequence[int], Sequence[int]], change: Callable, least: Callable):
    """Edit distance of ordered trees by the leftmost leaves of their nodes in postorder; change tells what it costs to make
    one node the other, for one pair or as arrays for many."""
    # a root of a subproblem is the last node with its leftmost leaf
    starts = [sorted({k: i for i, k in enumerate(t)}.values()) for t in left]
    tree: list[list] = [[0.0] * len(left[1]) for _ in left[0]]
    for i in starts[0]:
        for j in starts[1]:
            a, b = left[0][i], left[1][j]
            above: list = [float(k) for k in range(j - b + 2)]
            rows = [above]
            for x in range(a, i + 1):
                row = [above[0] + 1]
                for y in range(b, j + 1):
                    whole = left[0][x] == a and left[1][y] == b
                    kept = above[y - b] + change(x, y) if whole else rows[left[0][x] - a][left[1][y] - b] + tree[x][y]
                    row.append(least(least(above[y - b + 1] + 1, row[-1] + 1), kept))
                    if whole:
                        tree[x][y] = row[-1]
                rows.append(row)
                above = row
    return tree[-1][-1]


def tree_distance(one: list[tuple[str, str, int]], two: list[tuple[str, str, int]], texts: bool = True) -> float:
    """Edit distance of ordered trees, given in postorder as (label, text, number of the leftmost leaf). A node costs 1
    to insert, delete or relabel; equal labels cost the share of their texts' characters that differ."""
    def change(x: int, y: int) -> float:
        (a, s, _), (b, t, _) = one[x], two[y]
        return 1.0 if a != b else 0.0 if not texts or s == t else edits(s, t) / max(len(s), len(t))

    return _distance(([n[2] for n in one], [n[2] for n in two]), change, min) if one and two else float(len(one) + len(two))


def _trees(e: Elements, contents: int) -> tuple[np.ndarray, pa.StringArray, list[str], np.ndarray]:
    """Of the first table of each content the nodes in postorder: how many there are, their labels, texts and the numbers of
    their leftmost leaves. Cells end the tree; tables in them are their text."""
    table, cell = e.named(test=lambda x: x.lower() == "table"), e.named(test=lambda x: x.lower() in ("td", "th"))
    first = e.around(table & (e.nth(table) == 1), e.i)
    within = first >= 0
    inside = within & (np.r_[-1, np.maximum.accumulate(np.where(within & cell, e.last, -1))[:-1]] >= e.i) if e.n else within
    node = within & (e.name >= 0) & ~inside
    nodes = np.flatnonzero(node)
    number = np.cumsum(node)
    size = number[e.last[nodes]] - number[nodes] + 1
    top = first[nodes]
    post = number[nodes] - number[top] + size - 1 - (e.level[nodes] - e.level[top])
    said = np.flatnonzero(inside & (e.name < 0))
    cells: dict[int, list[str]] = {}
    for i, text in zip(np.maximum.accumulate(np.where(node, e.i, -1))[said].tolist(), e.texts(said).to_pylist()):
        cells.setdefault(i, []).append(text)
    lower = pa.array([x.lower() for x in e.names], pa.string())
    spans = [pc.coalesce(e.attribute(nodes, k), pa.scalar("1")) for k in ("colspan", "rowspan")]
    order = np.lexsort((post, e.content[nodes]))
    labels = pc.binary_join_element_wise(lower.take(pa.array(e.name[nodes])), *spans, "|").take(pa.array(order))
    return np.bincount(e.content[nodes], minlength=contents), labels, [" ".join("".join(cells.get(i, ())).split()) for i in nodes[order].tolist()], (post - size + 1)[order]


def _scores(sides: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], texts: list[str]) -> list[np.ndarray]:
    """teds and teds_structure of pairs of trees; a side has the sizes of its trees and their labels, texts and leftmost leaves."""
    many = len(sides[0][0])
    starts = [np.r_[0, np.cumsum(s[0])] for s in sides]
    groups: dict[tuple[bytes, ...], list[int]] = {}
    for k in range(many):
        shape = []
        for (_, label, _, left), start in zip(sides, starts):
            at = slice(start[k], start[k + 1])
            shape += [label[at].tobytes(), left[at].tobytes()]
        groups.setdefault(tuple(shape), []).append(k)
    out = [np.zeros(many), np.zeros(many)]
    work, wanted = [], []
    for rows in groups.values():
        n = [int(s[0][rows[0]]) for s in sides]
        if not all(n):
            for x in out:
                x[rows] = 0.0 if any(n) else 1.0
            continue
        label, said, left = zip(*((s[1][b:b + m].tolist(), s[2][start[rows][:, None] + np.arange(m)], s[3][b:b + m].tolist()) for s, start, m in zip(sides, starts, n) for b in [int(start[rows[0]])]))
        out[1][rows] = 1 - _distance(left, lambda x, y, la=label: float(la[0][x] != la[1][y]), min) / max(n)
        pairs = {(x, y): said[0][:, x] * len(texts) + said[1][:, y] for x in range(n[0]) for y in range(n[1]) if label[0][x] == label[1][y]}
        work.append((np.array(rows), n, label, left, pairs))
        wanted += pairs.values()
    if not work:
        return out
    known = np.unique(np.concatenate(wanted)) if wanted else np.zeros(0, np.int64)
    a, b = known // len(texts), known % len(texts)
    size = np.array([len(x) for x in texts], np.int64)
    apart = a != b
    share = np.zeros(len(known))
    share[apart] = many_edits(texts, a[apart], b[apart]) / np.maximum(size[a[apart]], size[b[apart]])
    for rows, n, label, left, pairs in work:
        costs = {k: share[np.searchsorted(known, v)] for k, v in pairs.items()}
        if len(rows) >= TOGETHER:
            found = _distance(left, lambda x, y: costs.get((x, y), 1.0), np.minimum)
        else:
            found = np.array([_distance(left, lambda x, y, k=k: float(costs[x, y][k]) if (x, y) in costs else 1.0, min) for k in range(len(rows))])
        out[0][rows] = 1 - found / max(n)
    return out


def teds(pairs: DataFrame, keys: Sequence[str], ref: str, hyp: str) -> DataFrame:
    """(keys, teds, teds_structure) of pairs of HTML tables: 1 less the tree edit distance over the larger tree's nodes,
    with the texts of cells and without. Of a content its first table counts; where one has none, or is no well-formed
    XML or null, both are 0, and 1 where neither has one."""
    cut = lambda c: F.coalesce(F.regexp_extract_all(F.col(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))
    size = lambda c: F.coalesce(F.octet_length(F.col(c)), F.lit(-1))
    both = pairs.select(*keys, size(ref).alias("__size1"), size(hyp).alias("__size2"), cut(ref).alias("__cut1"), cut(hyp).alias("__cut2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found: list[list] = [[], []]
            for rows, tokens in token_slices(iter([batch]), "__cut1", "__cut2"):
                for side, t, k in zip(found, tokens, (1, 2)):
                    side.append(_trees(Elements(t, np.asarray(rows.column(f"__size{k}"))), rows.num_rows))
            labels = pa.concat_arrays([x[1] for side in found for x in side]).dictionary_encode().indices
            texts: dict[str, int] = {}
            sides, at = [], 0
            for side in found:
                n = sum(len(x[3]) for x in side)
                said = np.array([texts.setdefault(t, len(texts)) for x in side for t in x[2]], np.int64)
                sides.append((np.concatenate([x[0] for x in side]), np.asarray(labels.slice(at, n)), said, np.concatenate([x[3] for x in side])))
                at += n
            scores = _scores(sides, list(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *(pa.array(s) for s in scores)], names=[*keys, "teds", "teds_structure"])

    kinds = dict(pairs.dtypes)
    return both.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "teds double", "teds_structure double"]))
