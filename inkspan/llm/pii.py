"""Personal data by rules and by boosted trees over candidate spans, in DataFrame functions only.

Four base rules always hold. Wide generators propose further spans, which may overlap: anything around an @, long runs
of digits, and all parts of such a run that begin and end with a group of digits and could be a card or phone. Ten yes/no features of a candidate's format and context make its cell. One aggregate over all
texts counts candidates and those that are base spans of their kind per cell, at most 2^10 rows; gradient boosting fits
depth-two trees to half of the documents' cells, and on the other half the lowest of a few fixed cutoffs holds at
which at least `precision` of the accepted are right by a lower bound. Trees and threshold go back as a SQL expression.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table
from .spans import BLOCK, found

#: The base kinds in their order, their patterns, and the sizes that hold after a match. The look-behinds
#: and possessive groups only spare the engine retries inside a run that it has already passed and deep recursion.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    r"[0-9]++(?:[\x20-]?[0-9]++)*+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Generators of candidates: around an @, and runs of seven digits or more with usual separators.
WIDE = (r"(?<![^\s@<>])[^\s@<>]+@[^\s@<>]+", r"(?<![0-9(+])[(+]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+")
#: Digits that a part of a run has, and characters it has at most with two separators in each gap.
PART, PART_CHARS = (8, 19), 19 + 2 * 18
CONTEXT = r"(?i)(?:mail|contact|phone|tel|call|mobile|fax|card|visa|account|ip|address)\W{0,4}$"
FEATURES = 10
ROUNDS, RATE = 20, 0.3
#: Cutoffs of the score that are tried, as log odds of these shares.
CUTOFFS = tuple(math.log(q / (1 - q)) for q in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(acc, i):
        x = F.substr(d, F.length(d) - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0


def _holds(kind: int, s: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return s.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == 2:
        return F.length(digits(s)).between(16, 19) & luhn(digits(s))
    return F.length(digits(s)).between(8, 15)


def base_spans(text: Column) -> Column:
    """array<struct<k, start, end>> by kind and start."""
    def of(k: int) -> Column:
        kept = F.filter(found(text, PATTERNS[k]), lambda x: _holds(k, x["s"]))
        return F.transform(kept, lambda x: F.struct(F.lit(k).alias("k"), x["start"].alias("start"), x["end"].alias("end")))

    return F.concat(*map(of, range(len(PATTERNS))))


def _around(text: Column, x: Column) -> tuple[Column, Column]:
    """The 16 characters before and the one after x."""
    before = F.substr(text, F.greatest(x["start"] - 15, F.lit(1)).cast("int"), F.least(x["start"], F.lit(16)).cast("int"))
    return before, F.substr(text, (x["end"] + 1).cast("int"), F.lit(1))


def _cell(x: Column, wide: int) -> Column:
    s, d, before, after = x["s"], digits(x["s"]), x["before"], x["after"]
    bits = [F.lit(wide == 0), F.length(d) >= 13, F.length(d).between(8, 12),
            F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)), s.startswith("+"),
            s.contains("."), s.rlike(r"[\x20()-]"), before.rlike(CONTEXT), ~after.rlike("^[A-Za-z0-9]"), s.rlike(r"\.[A-Za-z]{2,}[^A-Za-z]*$")]
    return sum((F.when(b, F.lit(1 << i)).otherwise(F.lit(0)) for i, b in enumerate(bits)), F.lit(0))


def _whole(text: Column, x: Column) -> Column:
    before, after = _around(text, x)
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), before.alias("before"), after.alias("after"))


def parts(run: Column) -> Column:
    """array<struct<start, end, s, before, after>>: a run of digits itself, and its parts from the start of a group of
    digits to the end of one that have as many digits as PART says. A + or, before what is too short for a card, a (
    goes with the group. The run's characters are split once, so that a part costs the same wherever it stands.
    """
    def placed(chars):
        margin = F.length(run["before"])

        def digit(i):
            return F.coalesce(F.get(chars, i).between("0", "9"), F.lit(False))

        at = F.sequence(margin, F.size(chars) - F.length(run["after"]) - 1)
        starts = F.filter(at, lambda i: digit(i) & ((i == margin) | ~digit(i - 1)))
        ends = F.filter(at, lambda i: digit(i) & ((i == F.size(chars) - F.length(run["after"]) - 1) | ~digit(i + 1)))

        def spans(g):
            def from_group(i):
                a = F.get(g["a"], i)
                return F.transform(F.filter(F.slice(g["b"], i + 1, PART[1]), lambda e: e - a < PART_CHARS), lambda e: F.struct(a.alias("a"), (e + 1).alias("b"), F.array_join(F.slice(chars, a + 1, e + 1 - a), "").alias("s")))

            sized = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.size(g["a"]) - 1), from_group)), lambda x: F.length(digits(x["s"])).between(*PART))

            def part(x):
                n, mark = F.length(digits(x["s"])), F.when(x["a"] > margin, F.get(chars, x["a"] - 1))
                marked = F.when((mark == "+") & (n <= 15) | (mark == "(") & (n <= 12), 1).otherwise(0)
                return F.transform(F.array(F.struct((x["a"] - marked).alias("a"), x["b"].alias("b"))), cut_out)[0]

            def cut_out(x):
                first = F.greatest(x["a"] - 16, F.lit(0))
                return F.struct((run["start"] + x["a"] - margin).alias("start"), (run["start"] + x["b"] - margin).alias("end"), F.array_join(F.slice(chars, x["a"] + 1, x["b"] - x["a"]), "").alias("s"),
                                F.array_join(F.slice(chars, first + 1, x["a"] - first), "").alias("before"), F.coalesce(F.get(chars, x["b"]), F.lit("")).alias("after"))

            return F.filter(F.transform(sized, part), lambda x: (x["start"] != run["start"]) | (x["end"] != run["end"]))

        return let(F.struct(starts.alias("a"), ends.alias("b")), spans)

    return F.concat(F.array(run), let(F.split(F.concat(run["before"], run["s"], run["after"]), ""), placed))


def candidates(text: Column) -> Column:
    """array<struct<k, start, end, cell>>; k is the kind a candidate would have."""
    def of(w: int) -> Column:
        def candidate(x):
            n = F.length(digits(x["s"]))
            kind = F.lit(0) if w == 0 else F.when((n >= 13) & ~(x["s"].startswith("+") & (n <= 15)), 2).otherwise(3)
            return F.struct(kind.alias("k"), x["start"].alias("start"), x["end"].alias("end"), _cell(x, w).alias("cell"))

        proposed = F.transform(found(text, WIDE[w]), lambda x: _whole(text, x))
        return F.transform(F.flatten(F.transform(proposed, parts)) if w else proposed, candidate)

    return F.concat(of(0), of(1))


def _spans(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__base", F.when(text.rlike("[0-9@]"), base_spans(text)).otherwise(F.array().cast("array<struct<k:int,start:bigint,end:bigint>>")))
    return out.withColumn("__cand", F.when(text.rlike("[0-9@]"), candidates(text)).otherwise(F.array().cast("array<struct<k:int,start:bigint,end:bigint,cell:int>>")))


def _overlaps(c: Column, base: Column) -> Column:
    """Whether a candidate overlaps a base span of its own kind."""
    return F.exists(base, lambda b: (b["k"] == c["k"]) & (b["start"] < c["end"]) & (c["start"] < b["end"]))


def _is_base(c: Column, base: Column) -> Column:
    """Whether a candidate is a base span of its own kind; around an @, where a candidate may be wider, overlaps one."""
    return F.when(c["k"] == 0, _overlaps(c, base)).otherwise(F.exists(base, lambda b: (b["k"] == c["k"]) & (b["start"] == c["start"]) & (b["end"] == c["end"])))


def _clipped(c: Column, base: Column) -> Column:
    """array<struct<k, start, end>>: what base spans of other kinds leave of a candidate."""
    def span(a, b):
        return F.struct(c["k"].alias("k"), a.alias("start"), b.alias("end"))

    def without(left, b):
        both = F.flatten(F.transform(left, lambda p: F.array(span(p["start"], F.least(p["end"], b["start"])), span(F.greatest(p["start"], b["end"]), p["end"]))))
        return F.filter(both, lambda p: p["start"] < p["end"])

    return F.aggregate(base, F.array(span(c["start"], c["end"])), without)


def boosted(cells: list[tuple[int, int, int]]) -> list[tuple[int, int, tuple[float, ...]]]:
    """Trees (feature, feature, values of the four leaves) from (cell, candidates, positives), by gradient boosting on the log loss."""
    total, pos = sum(n for _, n, _ in cells), sum(p for *_, p in cells)
    if not total:
        return []
    prior = math.log((pos + 1) / (total - pos + 1))
    score, trees = {c: prior for c, *_ in cells}, [(0, 0, (prior, 0.0, 0.0, prior))]
    for _ in range(ROUNDS):
        best = None
        for i, j in combinations(range(FEATURES), 2):
            g, h = [0.0] * 4, [1.0] * 4
            for c, n, p in cells:
                q = 1 / (1 + math.exp(-score[c]))
                leaf = (c >> i & 1) * 2 + (c >> j & 1)
                g[leaf] += p - n * q
                h[leaf] += n * q * (1 - q)
            gain = sum(a * a / b for a, b in zip(g, h))
            if best is None or gain > best[0] + 1e-12:
                best = (gain, i, j, tuple(RATE * a / b for a, b in zip(g, h)))
        _, i, j, leaves = best
        trees.append((i, j, leaves))
        for c in score:
            score[c] += leaves[(c >> i & 1) * 2 + (c >> j & 1)]
    return trees


def scored(trees, cell: Column) -> Column:
    def bit(i):
        return F.getbit(cell, F.lit(i))

    out = F.lit(0.0)
    for i, j, v in trees:
        leaf = bit(i) * 2 + bit(j)
        out = out + F.when(leaf == 0, v[0]).when(leaf == 1, v[1]).when(leaf == 2, v[2]).otherwise(v[3])
    return out


def of_cell(trees, cell: int) -> float:
    return sum((v[(cell >> i & 1) * 2 + (cell >> j & 1)] for i, j, v in trees), 0.0)


def lower_bound(right: int, n: int, delta: float) -> float:
    """Exact (Clopper-Pearson) lower bound of a share, by bisection on the binomial tail of `right` or more of n.

    The tail has n - right + 1 terms, each from the one before, so it stays exact and cheap however large n is.
    """
    if not right:
        return 0.0
    first = math.lgamma(n + 1) - math.lgamma(right + 1) - math.lgamma(n - right + 1)
    lo, hi = 0.0, right / n
    for _ in range(60):
        p = (lo + hi) / 2
        if p in (0.0, 1.0):
            break
        term, tail = first + right * math.log(p) + (n - right) * math.log1p(-p), 0.0
        for k in range(right, n + 1):
            tail += math.exp(term)
            if tail > delta:
                break
            term += math.log((n - k) / (k + 1) * p / (1 - p)) if k < n else 0.0
        lo, hi = (p, hi) if tail <= delta else (lo, p)
    return lo


def fit(docs: DataFrame, id_col: str, text_col: str, precision: float = 0.98, delta: float = 0.05):
    """(trees, threshold) from all texts; the threshold is infinite if no score is precise enough."""
    # judged within the row, so that base spans are not copied to each candidate
    judged = F.transform("__cand", lambda c: F.struct(c["cell"].alias("cell"), _is_base(c, F.col("__base")).alias("right")))
    c = _spans(docs.select(id_col, text_col), text_col).select(F.pmod(F.xxhash64(id_col), F.lit(2)).alias("half"), F.explode(judged).alias("c"))
    rows = c.groupBy("half", F.col("c.cell").alias("cell")).agg(F.count("*").alias("n"), F.count_if("c.right").alias("p")).collect()
    cells = sorted((r["half"], r["cell"], r["n"], r["p"]) for r in rows)
    trees = boosted([x[1:] for x in cells if x[0] == 0])
    trained, held = ([(of_cell(trees, cell), n, p) for h, cell, n, p in cells if h == half] for half in (0, 1))
    return trees, certified(trained, held, precision, delta)


def certified(trained: list[tuple[float, int, int]], held: list[tuple[float, int, int]], precision: float, delta: float) -> float:
    """The lowest cutoff of CUTOFFS at or above which the held-out (score, candidates, right ones) are precise enough.

    The cutoffs are fixed before any count is seen and tested downwards, to the first that fails. The first to be tested
    is chosen by the training half: there it accepts as many candidates as could be certified if all were right.
    """
    def at(rows, cutoff):
        return (sum(x[k] for x in rows if x[0] >= cutoff - 1e-9) for k in (1, 2))

    best, enough = math.inf, math.ceil(math.log(delta) / math.log(precision))
    for cutoff in sorted(CUTOFFS, reverse=True):
        if next(at(trained, cutoff)) < enough:
            continue
        n, p = at(held, cutoff)
        if p < precision * n or lower_bound(p, n, delta) < precision:
            break
        best = cutoff
    return best


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with base and spans: arrays of (k, start, end) by kind and start; spans holds all of base, and accepted
    candidates that overlap none of their own kind there, less what base spans of other kinds cover. Null texts have
    none; no row is dropped."""
    trees, threshold = fit(docs, id_col, text_col)
    out = _spans(docs, text_col)
    if math.isinf(threshold):
        more = F.filter("__cand", lambda c: F.lit(False))
    else:
        more = F.filter("__cand", lambda c: (scored(trees, c["cell"]) >= threshold - 1e-9) & ~_overlaps(c, F.col("__base")))
    more = F.flatten(F.transform(more, lambda c: _clipped(c, F.col("__base"))))
    spans = let(F.sort_array(F.concat("__base", more)), lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))
    return out.withColumns({"base": F.col("__base"), "spans": spans}).drop("__base", "__cand")


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of text_col replaced by its kind in brackets; overlapping spans become one, named by the
    first. n_chars, where there is such a column, follows the text."""
    found_in = with_spans(docs.withColumnsRenamed({c: f"__x_{c}" for c in ("base", "spans") if c in docs.columns}), id_col, text_col)
    text, names = F.col(text_col), F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ordered = F.sort_array(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["k"].alias("k"))))
    kind = "array<struct<before:bigint,start:bigint,end:bigint,k:int>>"

    def merged(block, at):
        """Spans of a block that begin after all before them have ended, with the end before each."""
        def step(acc, x):
            fresh = F.struct(acc["at"].alias("before"), x["start"].alias("start"), x["end"].alias("end"), x["k"].alias("k"))
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(fresh))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step)

    def said(block):
        """The text from the end before a block's first span to the start of its last one; a block is cut out of the text once."""
        origin = block[0]["before"]

        def lines(piece):
            return F.array_join(F.transform(block, lambda x: F.concat(F.substr(piece, (x["before"] - origin + 1).cast("int"), (x["start"] - x["before"]).cast("int")), F.get(names, x["k"]))), "")

        return let(F.substr(text, (origin + 1).cast("int"), (F.element_at(block, -1)["end"] - origin).cast("int")), lines)

    def joined(acc):
        return F.concat(F.array_join(F.transform(F.filter(acc["out"], lambda b: F.size(b) > 0), said), ""), F.substr(text, (acc["at"] + 1).cast("int"), F.length(text)))

    def folded(spans):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), lambda b: F.slice(spans, b * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        step = lambda acc, b: let(merged(b, acc["at"]), lambda m: F.struct(m["at"].alias("at"), F.concat(acc["out"], F.array(m["out"])).alias("out")))
        return F.aggregate(blocks, start, step)

    clean = let(let(ordered, folded), joined)
    out = found_in.withColumn(text_col, F.when(F.size("spans") > 0, clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length(text_col).cast("long")).otherwise(F.col("n_chars")))
    return out.drop("base", "spans").withColumnsRenamed({f"__x_{c}": c for c in ("base", "spans")}).select(docs.columns)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return out.select("doc_id", *map(count, range(4)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
