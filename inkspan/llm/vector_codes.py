"""Product quantization of vectors in whole numbers, with vantage-point trees over each part position's entries.

Vectors are cut into equal parts; each part position has its own codebook of a few entries, fitted by rounds of
assignment and floored means. A part's nearest entry is found by branch and bound in a vantage-point tree over the
entries: distances to vantage points are rounded outwards to whole numbers, a subtree is visited unless its bound is
strictly worse than the best distance known, and every entry visited is compared by its exact squared distance, ties to
the lower index. So the tree decides what is looked at, never what is right.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, release, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components below this size are computed with in 64 bits, larger ones with numbers of any size.
SAFE = 1 << 24
#: Sums of components leave a task in limbs of so many bits, which can be added up over 2^23 tasks.
LIMB = 40
LONG = (1 << 63) - 1


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as int64, or as Python numbers where a component is large; exact for any finite double."""
    small = np.abs(x) < SAFE / SCALE
    if small.all():
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([math.floor(v * SCALE) if s else math.floor(v) * SCALE + math.floor((v - math.floor(v)) * SCALE) for v, s in zip(x.ravel().tolist(), small.ravel())], dtype=object).reshape(x.shape)


def roots(d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers not above and not below the square roots."""
    if d2.dtype == object:
        low = np.array([math.isqrt(v) for v in d2], dtype=object)
        return low, low + 1
    r = np.sqrt(d2.astype(np.float64)).astype(np.int64)
    return np.maximum(r - 1, 0), r + 2


class Tree:
    """A vantage-point tree over some entries of a codebook: the first is the vantage point, the rest lies inside or
    outside of its median distance, each side with the least and greatest distance, rounded outwards."""

    def __init__(self, entries: np.ndarray, members: list[int]):
        self.index, self.entry, self.sides = members[0], entries[members[0]], []
        rest = sorted((int(((entries[m] - self.entry).astype(object) ** 2).sum()), m) for m in members[1:])
        for side in (rest[: (len(rest) + 1) // 2], rest[(len(rest) + 1) // 2 :]):
            if side:
                self.sides.append((math.isqrt(side[0][0]), math.isqrt(side[-1][0]) + 1, Tree(entries, [m for _, m in side])))

    def search(self, parts: np.ndarray, rows: np.ndarray, best: np.ndarray, code: np.ndarray) -> None:
        """Improves best and code (squared distance and index so far, -1 for none) of the rows of parts."""
        gap = parts[rows] - self.entry
        d2 = (gap * gap).sum(axis=1)
        better = (code[rows] < 0) | (d2 < best[rows]) | ((d2 == best[rows]) & (self.index < code[rows]))
        best[rows[better]], code[rows[better]] = d2[better], self.index
        if not self.sides:
            return
        low, high = roots(d2)
        bounds = [np.maximum(np.maximum(low - far, near - high), 0) for near, far, _ in self.sides]
        first = bounds[0] <= bounds[-1]
        for some, order in ((first, range(len(self.sides))), (~first, range(len(self.sides) - 1, -1, -1))):
            for k in order:
                seen = some & (bounds[k] * bounds[k] <= best[rows])
                if seen.any():
                    self.sides[k][2].search(parts, rows[seen], best, code)


def assign(books: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), rows by parts, of vectors given as rows by parts by components."""
    if x.dtype != object and any(b.dtype == object for b in books):
        x = x.astype(object)
    n = len(x)
    codes, best = np.full((n, len(books)), -1), np.zeros((n, len(books)), dtype=x.dtype)
    for p, book in enumerate(books):
        d, c = np.zeros(n, dtype=x.dtype), np.full(n, -1)
        Tree(book, list(range(len(book)))).search(x[:, p], np.arange(n), d, c)
        best[:, p], codes[:, p] = d, c
    return codes, best


def _book(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(v) < SAFE for r in rows for v in r)
    return np.array(rows, dtype=np.int64 if small else object)


def _vectors(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return whole(flat).reshape(batch.num_rows, parts, -1)


def _sums(kept: DataFrame, books: list[list[list[int]]]) -> DataFrame:
    """(part, entry, place, limb, v): sums of the components of what is assigned to each entry, in limbs; place -1 has
    the counts. Each task adds up its own rows first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, total, counts = [_book(b) for b in books], {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch, len(arrays))
            codes, _ = assign(arrays, x)
            for p in range(len(arrays)):
                for e in np.unique(codes[:, p]).tolist():
                    mine = codes[:, p] == e
                    total[p, e] = total.get((p, e), 0) + x[mine, p].astype(x.dtype).sum(axis=0).astype(object)
                    counts[p, e] = counts.get((p, e), 0) + int(mine.sum())
        out = [(p, e, -1, 0, n) for (p, e), n in counts.items()]
        for (p, e), s in total.items():
            for j, v in enumerate(s):
                sign, v, limb = (-1 if v < 0 else 1), abs(int(v)), 0
                while v:
                    out.append((p, e, j, limb, sign * (v & (1 << LIMB) - 1)))
                    v, limb = v >> LIMB, limb + 1
        names = ["part", "entry", "place", "limb", "v"]
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "v" else pa.int32()) for c, n in zip(columns, names)], names=names)

    each = kept.select("x").mapInArrow(run, "part int, entry int, place int, limb int, v long")
    return each.groupBy("part", "entry", "place", "limb").agg(F.sum("v").alias("v"))


def refined(books: list[list[list[int]]], sums: list) -> list[list[list[int]]]:
    """The codebooks with each used entry replaced by its floored mean."""
    at: dict[tuple[int, int, int], int] = {}
    for r in sums:
        at[r["part"], r["entry"], r["place"]] = at.get((r["part"], r["entry"], r["place"]), 0) + (r["v"] << LIMB * r["limb"])
    return [[[at.get((p, e, j), 0) // n for j in range(len(entry))] if (n := at.get((p, e, -1))) else entry for e, entry in enumerate(book)] for p, book in enumerate(books)]


def digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()


def quantize(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id_col, label_col, code, error, label_error, codebooks_sha256) of each kept row.

    Rows whose vector is null, empty, holds null or non-finite components or cannot be cut into equal parts are dropped,
    as are those of another length than the first kept one's. Codebooks start from the rows with the smallest ids (null
    ids last; among equal ids the smaller vector first); with fewer rows they have fewer entries. Repeated rows count
    each; an empty table gives no rows. An error beyond 64 bits, and a sum with one, is null. Columns other than the three
    named are not read. What the driver holds is one codebook and its sums: entries x components, whatever the rows.
    """
    x = F.col(vec_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x")).where((F.size("x") > 0) & (F.size("x") % parts == 0) & finite)
    first = [F.asc_nulls_last("id"), F.asc("x")]
    lead = rows.orderBy(*first).limit(1).select(F.size("x")).collect()
    kept = cut(rows.where(F.size("x") == (lead[0][0] if lead else 0)))
    start = kept.orderBy(*first).limit(entries).select("x").collect()
    cuts = [whole(np.array(r["x"], dtype=np.float64)).reshape(parts, -1).tolist() for r in start]
    books = [[c[p] for c in cuts] for p in range(parts)]
    for _ in range(rounds if books[0] else 0):
        books = refined(books, _sums(kept, books).collect())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [_book(b) for b in books]
        for batch in batches:
            if batch.num_rows:
                codes, best = assign(arrays, _vectors(batch, parts))
                error = best.astype(object).sum(axis=1) if best.dtype == object else best.sum(axis=1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(batch.schema.get_field_index("id")), batch.column(batch.schema.get_field_index("label")),
                    pa.array([r.tobytes().hex() for r in codes.astype(np.uint8)], pa.string()), pa.array([v if v <= LONG else None for v in error.tolist()], pa.int64())], names=["id", "label", "code", "error"])

    kinds = dict(kept.dtypes)
    done = cut(kept.mapInArrow(coded, f"id {kinds['id']}, label {kinds['label']}, code string, error long"))
    release(kept)
    # written first: its size is then known to the join, which can also split a label with many rows
    sums = cut(done.groupBy("label").agg(F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error")))
    out = done.alias("a").join(sums.alias("b"), F.col("a.label").eqNullSafe(F.col("b.label")))
    return out.select(F.col("a.id").alias(id_col), F.col("a.label").alias(label_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize(table(spark, sf_dir, "embeddings")).drop("label")


def _oracle() -> str:
    """The same in SQL: parts as rows of components, each round an assignment by distance and index, then floored means."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""d{r} as materialized (select x.id, x.p, c.e, sum((x.v - c.v) * (x.v - c.v)) as d from x join c{r} c using (p, j) group by all),
a{r} as materialized (select id, p, arg_min(e, (d, e)) as e, min(d) as d from d{r} group by all)""")
        if r < ROUNDS:
            steps.append(f"""s{r} as (select x.p, a.e, j, sum(v)::bigint as s, count(*) as n from x join a{r} a using (id, p) group by all),
c{r + 1} as materialized (select p, e, j, case when n is null then v else (s - ((s % n) + n) % n) // n end as v from c{r} left join s{r} using (p, e, j))""")
    return f"""with k as (select vec_id as id, label, list_transform(embedding, lambda v: floor({SCALE} * v::double)::bigint) as xs from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
x as materialized (select id, i // (len // {PARTS}) as p, i % (len // {PARTS}) as j, v from (select id, len(xs) as len, generate_subscripts(xs, 1) - 1 as i, unnest(xs) as v from k)),
o as (select id, row_number() over (order by id) - 1 as e from k qualify e < {ENTRIES}), c0 as materialized (select p, e, j, v from x join o using (id)),
{', '.join(steps)},
g as (select sha256(string_agg(v::varchar, ',' order by p, e, j)) as codebooks_sha256 from c{ROUNDS}),
f as (select id, string_agg(printf('%02x', e::integer), '' order by p) as code, sum(d)::bigint as error from a{ROUNDS} group by id)
select k.id as vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from k join f using (id), g"""


ORACLE = _oracle()
