import random

from inkspan.operators import alignment as A


def plain_length(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        was = list(d)
        for j, y in enumerate(b, 1):
            d[j] = was[j - 1] + 1 if x == y else max(was[j], d[j - 1])
    return d[-1]


def sound(a, b, pairs):
    return all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:])) and len(pairs) == plain_length(a, b)


def test_common_subsequences_are_longest(monkeypatch):
    r = random.Random(3)
    for bits in (A.TABLE_BITS, 20):
        monkeypatch.setattr(A, "TABLE_BITS", bits)
        for _ in range(600):
            a, b = (r.choices("abcdefgh"[: r.choice([2, 4, 8])], k=r.randint(0, 14)) for _ in range(2))
            assert sound(a, b, A.common(a, b)), (a, b)


def test_aligned_words_of_documents(spark):
    r = random.Random(5)
    sides = [{d: r.choices(["a", "b", "c", "dd", ""], k=r.randint(0, 30)) for d in range(20) if d % 7 != s} for s in (1, 2)]
    left, right = (spark.createDataFrame([(d, 10 * k, w) for d, ws in s.items() for k, w in enumerate(ws)], "d int, k int, w string") for s in sides)
    got = {}
    for x in A.aligned(left, right, ["d"], "k", "w").collect():
        got.setdefault(x.d, []).append((x.left // 10, x.right // 10))
    for d in set(sides[0]) & set(sides[1]):
        a, b = sides[0][d], sides[1][d]
        pairs = sorted(got.get(d, []))
        assert all(a[i] == b[j] != "" for i, j in pairs) and len(pairs) == plain_length([w for w in a if w], [w for w in b if w])
    assert set(got) <= set(sides[0]) & set(sides[1])


def test_compared_sides_meet_in_one_shuffle(spark):
    from inkspan.operators import alignment

    one = spark.createDataFrame([(1, "a  b", 0, 1.0), (1, "a b", 1, None), (None, "x", 0, 2.0), (2, "t", 0, 5.0)], "page int, text string, k int, e double")
    two = spark.createDataFrame([(1, "a b", 4, 3.0), (None, "x", 0, 9.0), (2, "t", 0, 1.5), (3, "u", 0, 1.0)], "page int, text string, k int, e double")
    out = alignment.compared(one, two, "page", "text", ["e"], "k")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a b", "both", 0.0), (None, "x", "left", None), (None, "x", "right", None), (2, "t", "both", 3.5), (3, "u", "right", None)], key=str)
    plan = alignment.compared(one, two, "page", "text", ["e"], "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "SortAggregate" not in plan


def test_both_sides_read_units_that_are_made_once(spark):
    """The units of pages cost more than the comparison: its plan reads them back and makes none."""
    from inkspan.plans import alignment_queries as Q

    out = Q.QUERIES["extractions_compared"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString() and out.count() > 0


def test_collapsed_by_every_white_space(spark):
    from inkspan.functions.text import WHITES, collapsed

    texts = [f"{a}x{b}{c}y éᚁ῿、​{a}" for a in ["", *WHITES, "᠎", "\U0001f600"] for b in ["", " ", "\t"] for c in ["", " ", "\xa0"]] + ["", " ", "a b c", "  "]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: x.k for x in d.select("i", collapsed(d.t).alias("k")).collect()}
    assert [got[i] for i in range(len(texts))] == [" ".join(t.split()) for t in texts]
