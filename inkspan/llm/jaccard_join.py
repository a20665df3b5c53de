"""N-gram Jaccard join over documents: prefix filtering under one global order, verified by traversal of prefix trees.

Two documents link when their sets of distinct k-word shingles have a Jaccard similarity of at least `percent` / 100.
The join is exact up to equal 64-bit shingle hashes:

1. Documents with equal sets form a class (one aggregate over narrow keys); only classes go on. Under the order of
   the hashes, sets of sizes m <= n that similar share at least l of their first n - ceil(t * n) + l elements, where l
   grows with m. A class with fewer shingles in any other's leading part has no partner and goes; the whole sets are
   kept for the others alone. Passages that fill a small part of their documents leave the join here.
2. Under any global order, sets that similar share one of their first n - ceil(t * n) + 1 elements. The order is the
   hash's, with shingles that many classes hold moved last, the most frequent at the end, so a passage that many
   documents share makes no large bucket.
3. If the first shingle that two sets share is the i-th of one and the j-th of the other, at most the shorter of the
   two remainders is shared. Pairs of a bucket whose remainders are too short end there: copies with many edits of
   their own, or documents that share no more than a passage.
4. Each bucket first compares its pivot, the member whose shared part begins first, with the others; what those links
   join is then one component. Next, only members of different components in a bucket are compared: those outside the
   pivot's component with all, those inside it with the ones outside. A link inside a component changes nothing. Large
   buckets are split by size, as a partner's size is bounded by what remains of a set.
5. Verification puts the partners of one member into a prefix tree of their ordered sets. A walk shares the overlap
   counted so far among all sets below a node, and leaves a whole subtree once what remains of its longest set, or of
   the member, cannot reach the overlap that its shortest set needs.

Every side of a join grows with the documents, so joins that move sets or texts ask for a merge join at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, release, table
from .components import connected_components

#: A shingle of more classes than this goes last in the global order. Any value gives the same result.
HEAVY = 10
#: Buckets of more members than this are split by size. Any value gives the same result.
SPLIT = 64
#: Partners of one member that one tree holds; more are dealt to further trees.
TREE_ROWS = 400


def hash_shingles(k: int, percent: int | None = None):
    """For mapInArrow over (id, text as bytes, own): (id, n, h1, shingles, own), or (id, n, h1, h2, prefix) if percent is given.

    Bytes are split and lower-cased by their ASCII rules. h1 and h2 are a digest of the set, prefix its leading part in
    the order of the hashes.
    """

    def shingles(text: bytes | None) -> np.ndarray:
        w = text.lower().split() if text else []
        h = np.full(max(1, len(w) - k + 1) if w else 0, min(len(w), k), np.uint64)
        v = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
        for j in range(min(k, len(w))):
            h = (h ^ v[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        return np.unique(h.view(np.int64))

    def lists(arrays: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, arrays)])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(arrays)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64)
                out = {"id": part.column(0), "n": pa.array([len(s) for s in sets], pa.int32()), "h1": pa.array(digest[::2])}
                if percent is None:
                    out |= {"shingles": lists(sets), "own": part.column(2)}
                else:
                    lead = [len(s) + len(s) // 20 + 1 - -(-percent * len(s) // 100) for s in sets]
                    out |= {"h2": pa.array(digest[1::2]), "prefix": lists([s[:m] for s, m in zip(sets, lead)])}
                yield pa.RecordBatch.from_pydict(out)

    return run


def leading_parts(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(id, n, h1, h2, prefix): what classes and the first prefix need of the distinct k-word shingles, or of all words
    as one shingle if they are fewer."""
    s = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return s.mapInArrow(hash_shingles(k, percent), f"id {s.schema['id'].dataType.simpleString()}, n int, h1 bigint, h2 bigint, prefix array<bigint>")


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, shingles) of rows (id, text, own) whose set has the digest own; shingles are sorted 64-bit hashes."""
    kind = docs.schema["id"].dataType.simpleString()
    out = docs.mapInArrow(hash_shingles(k), f"id {kind}, n int, h1 bigint, shingles array<bigint>, own bigint")
    return out.where("h1 = own").select("id", "n", "shingles")


def _prefix(n, percent: int):
    """n - ceil(percent * n / 100) + 1 in integers."""
    return n - F.expr(f"({percent} * n + 99) div 100").cast("int") + 1


def _more(n):
    """Elements by which the first, longer prefix exceeds _prefix: similar sets a and b share more than _more(min(a, b))."""
    return F.floor(n / 20).cast("int")


def overlaps(query: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Which of the sets are similar enough to the query; all are in one order. sets must be sorted as lists.

    The sorted sets are a prefix tree: a node is a range of sets that agree on their first elements.
    """
    size = np.array([len(s) for s in sets])
    agree = np.zeros(len(sets), np.int64)  # leading elements that a set shares with the one before it
    for k in range(1, len(sets)):
        m = min(size[k - 1], size[k])
        differs = np.flatnonzero(sets[k - 1][:m] != sets[k][:m])
        agree[k] = differs[0] if len(differs) else m
    n, found, nodes = len(query), [], [(0, len(sets), 0, 0)] if sets else []
    while nodes:
        lo, hi, depth, seen = nodes.pop()
        last = int(agree[lo + 1 : hi].min()) if hi - lo > 1 else int(size[lo])
        need, longest = -(-percent * (n + int(size[lo:hi].min())) // (100 + percent)), int(size[lo:hi].max())
        while depth < last:
            part = sets[lo][depth : min(last, depth + 256)]
            at = np.searchsorted(query, part)
            seen += int((query[np.minimum(at, n - 1)] == part).sum())
            depth += len(part)
            if seen + min(longest - depth, n - int(np.searchsorted(query, part[-1], "right"))) < need:
                break
        else:
            ends = lo
            while ends < hi and size[ends] == last:  # sets that end at this node come first
                if seen >= -(-percent * (n + last) // (100 + percent)):
                    found.append(ends)
                ends += 1
            if ends < hi:
                starts = [ends, *(ends + 1 + np.flatnonzero(agree[ends + 1 : hi] <= last)).tolist(), hi]
                nodes += [(a, b, depth, seen) for a, b in zip(starts, starts[1:])]
    return found


def verify_groups(percent: int):
    """For applyInArrow: rows (a, salt, id, shingles) of one member a (its own row included) and its partners."""

    def walk(group: pa.Table) -> pa.Table:
        a, ids = group.column("a")[0].as_py(), group.column("id").to_numpy()
        lists = group.column("shingles").combine_chunks()
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        sets = [flat[x:y] for x, y in zip(ends[:-1], ends[1:])]
        order = sorted(np.flatnonzero(ids != a).tolist(), key=lambda k: sets[k].tolist())
        found = overlaps(sets[int(np.flatnonzero(ids == a)[0])], [sets[k] for k in order], percent)
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(ids[[order[k] for k in found]], pa.int64())})

    return walk


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    count = cut(pairs.groupBy("a").agg(F.count("*").alias("c")))
    dealt = pairs.join(count, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / TREE_ROWS)).cast("int").alias("salt"))
    own = count.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("c") / TREE_ROWS) - 1).cast("int"))).alias("salt"))
    rows = dealt.unionByName(own).hint("merge").join(sets.select(F.col("id").alias("b"), "shingles"), "b").select("a", "salt", F.col("b").alias("id"), "shingles")
    links = cut(rows.groupBy("a", "salt").applyInArrow(verify_groups(percent), "a long, b long"))
    release(count)
    return links


def _reach(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether sets of sizes n and m whose first common elements are the i-th and j-th (from 0) can be similar enough."""
    return (F.least(n - i, m - j) * (100 + percent) >= percent * (n + m)) & (F.least(n, m) * 100 >= percent * F.greatest(n, m))


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(1.05)).cast("int")


def _across(named: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (s, id, n, i, comp, main, size) of a bucket s that are in different components and in reach.

    main is the component of the bucket's pivot; size is the number of members. The larger set of a pair probes for the
    smaller one. Only members outside main look at all; those inside it look at the ones outside.
    """
    inside = F.col("comp") == F.col("main")
    n, i = F.col("n"), F.col("i")
    large = F.col("size") > SPLIT
    least, most = F.ceil(percent * n / 100), F.least(n, F.floor((100 + percent) * (n - i) / percent) - n)
    classes = F.when(~large, F.array(F.lit(-1))).when(most < least, F.array().cast("array<int>")).otherwise(F.sequence(_size_class(least), _size_class(most)))
    probe = named.select("s", F.col("id").alias("a"), "n", "i", "comp", F.explode(classes).alias("c"), inside.alias("z"))
    index = named.where((n - i) * (100 + percent) >= 2 * percent * n)
    index = index.select("s", F.col("id").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("comp").alias("comp_b"),
                         F.when(large, _size_class(n)).otherwise(-1).alias("c"), F.explode(F.when(inside, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("z"))
    near = (F.col("m") <= n) & (F.col("a") != F.col("b")) & (F.col("comp") != F.col("comp_b")) & _reach(n, i, F.col("m"), F.col("j"), percent)
    both = probe.join(index, ["s", "c", "z"]).where(near)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id) per row of docs; extra columns are left alone.

    Null, empty and blank texts have no shingles and link with nothing. Rows with a null id keep a null component.
    Ids are keys: of rows that repeat an id with different texts, the one with the most shingles (among equals, the
    greatest digest) stands for all of them. An empty table gives an empty result.
    """
    narrow = cut(leading_parts(docs, id_col, text_col, k, percent))
    keyed = narrow.where("n > 0 and id is not null")
    base = cut(narrow.select("id", "n"))
    chosen = cut(keyed.groupBy("id").agg(F.max(F.struct("n", "h1", "h2")).alias("x")).select("id", "x.*"))
    classes = cut(chosen.groupBy("n", "h1", "h2").agg(F.min("id").alias("class"), F.count("*").alias("c")).where("c > 1").drop("c"))
    member = cut(chosen.join(classes, ["n", "h1", "h2"], "left").select("id", "n", "h1", F.coalesce("class", "id").alias("class")))

    # classes with too few shared shingles to have a partner end here; copies of a set do not count for it
    longer = keyed.select("id", "h1", F.explode("prefix").alias("s"))
    common = cut(longer.groupBy("s").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x < y").select("s"))
    hits = longer.select("id", "s").join(common, "s", "left_semi").groupBy("id").agg(F.count("*").alias("c"))
    least = _more(F.expr(f"({percent} * n + 99) div 100")) + 1  # of the smallest partner
    alive = cut(member.where("id = class").join(hits, "id").where(F.col("c") >= least).select("id", "h1"))
    release(narrow, chosen, classes, common)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(alive.withColumnRenamed("h1", "own").hint("merge"), "id").distinct()
    sets = cut(whole_sets(texts, k))

    # frequent shingles go last: all sets are counted, as with many documents nearly each of them holds such a shingle
    single = sets.select("id", F.explode("shingles").alias("s"))
    late = cut(single.groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") > HEAVY))
    moved = single.join(late, "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "s")))["s"].alias("moved"))
    ordered = F.when(F.col("moved").isNull(), F.col("shingles")).otherwise(F.concat(F.array_except("shingles", "moved"), "moved"))
    again = sets.join(moved.hint("merge"), "id", "left").select("id", "n", ordered.alias("shingles"))
    rows = cut(again.select("id", "n", F.posexplode(F.slice("shingles", 1, _prefix(F.col("n"), percent))).alias("i", "s")))
    # a bucket of one class has nothing to compare
    shared = rows.groupBy("s").agg(F.min(F.struct("i", "id", "n")).alias("p"), F.min("id").alias("x"), F.max("id").alias("y"), F.count("*").alias("size")).where("x < y")
    shared = cut(shared.select("s", F.col("p.id").alias("pivot"), F.col("p.i").alias("j"), F.col("p.n").alias("m"), "size"))
    release(alive, late)
    bucket = cut(rows.join(shared, "s"))

    star = bucket.where((F.col("id") != F.col("pivot")) & _reach(F.col("n"), F.col("i"), F.col("m"), F.col("j"), percent))
    star = cut(star.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    links = _links(star, sets, percent)
    joined = cut(connected_components(links))
    named = bucket.join(joined.select(F.col("node").alias("id"), "component"), "id", "left").join(
        joined.select(F.col("node").alias("pivot"), F.col("component").alias("main")), "pivot", "left")
    named = cut(named.select("s", "id", "n", "i", "size", F.coalesce("component", "id").alias("comp"), F.coalesce("main", "pivot").alias("main")))
    mixed = cut(named.where("comp <> main").select("s").distinct())
    rest = _across(named.join(mixed, "s", "left_semi"), percent)
    rest = cut(rest.join(star, ["a", "b"], "left_anti").join(star.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"))
    more = _links(rest, sets, percent)
    comp = cut(connected_components(links.unionByName(more)))
    release(rows, shared, bucket, star, sets, links, joined, named, mixed, rest, more)

    placed = member.join(comp.withColumnRenamed("node", "class"), "class", "left").select("id", F.col("n").alias("own"), F.coalesce("component", "class").alias("component_id"))
    out = base.join(placed, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("own", "n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that belong to a smaller document's component; rows without id stay."""
    comp = jaccard_components(docs, id_col, text_col, k, percent)
    gone = comp.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    return docs.join(gone.hint("merge"), id_col, "left_anti")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def brute_force(rows: Iterator[tuple], k: int = 5, percent: int = 80) -> dict:
    """{id: (n, component)} by comparing all pairs; for tests only."""
    import re

    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and min(len(sets[x]), len(sets[y])) * 100 >= percent * max(len(sets[x]), len(sets[y])):
                inter = len(sets[x] & sets[y])
                if 100 * inter >= percent * (len(sets[x]) + len(sets[y]) - inter):
                    p, q = sorted((find(x), find(y)))
                    root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}
