import random
from functools import lru_cache

import numpy as np

from inkspan.operators import table_distance as T


def plain(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, was = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(was[j] + 1, d[-1] + 1, was[j - 1] + (x != y)))
    return d[-1]


def brute(one, two, texts):
    """Distance of forests from the definition; a tree is (label, text, children)."""
    @lru_cache(None)
    def size(f):
        return sum(1 + size(t[2]) for t in f)

    @lru_cache(None)
    def forest(f, g):
        if not f or not g:
            return float(size(f) + size(g))
        x, y = f[-1], g[-1]
        change = 1.0 if x[0] != y[0] else 0.0 if not texts or x[1] == y[1] else plain(x[1], y[1]) / max(len(x[1]), len(y[1]))
        return min(forest(f[:-1] + x[2], g) + 1, forest(f, g[:-1] + y[2]) + 1, forest(f[:-1], g[:-1]) + forest(x[2], y[2]) + change)

    return forest((one,), (two,)), max(size((one,)), size((two,)))


def made(r):
    cell = lambda: (r.choice(["td|1|1", "td|1|1", "th|1|1", "td|2|1"]), r.choice(["", "a", "abc", "a b", "xyz é"]), ())
    row = lambda: ("tr|1|1", "", tuple(cell() for _ in range(r.randint(0, 3))))
    part = lambda: (r.choice(["tbody|1|1", "thead|1|1"]), "", tuple(row() for _ in range(r.randint(0, 3))))
    return ("table|1|1", "", tuple(part() if r.random() < 0.6 else row() for _ in range(r.randint(0, 3))))


def html(t):
    name, col, _ = t[0].split("|")
    return f"<{name}{' colspan=' + chr(34) + '2' + chr(34) if col == '2' else ''}>{t[1][:1] + '<i>' + t[1][1:] + '</i>' if t[1] else ''}{''.join(map(html, t[2]))}</{name}>"


def test_edits():
    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choices("abé", k=r.randint(0, 9))) for _ in range(2))
        assert T.edits(a, b) == plain(a, b)


def test_teds_against_forests(spark):
    r = random.Random(2)
    pairs = [(made(r), made(r)) for _ in range(60)]
    rows = [(i, f"<div>x {html(a)}<table/></div>", html(b)) for i, (a, b) in enumerate(pairs)]
    rows += [(100, "<p/>", "<table/>"), (101, None, None), (102, "<table>", "<table/>"), (103, "<TABLE><TR><TD> a\n b </TD></TR></TABLE>", "<table><tr><td>a b</td></tr></table>"), (104, "<table><tr><td>x<table><tr><td>y</td></tr></table></td></tr></table>", "<table><tr><td>xy</td></tr></table>")]
    d = spark.createDataFrame(rows, "k int, ref string, hyp string")
    got = {x.k: (x.teds, x.teds_structure) for x in T.teds(d, ["k"], "ref", "hyp").collect()}
    for i, (a, b) in enumerate(pairs):
        for texts, score in zip((True, False), got[i]):
            distance, most = brute(a, b, texts)
            assert abs(score - (1 - distance / most)) < 1e-9
    assert got[100] == (0, 0) and got[101] == (1, 1) and got[102] == (0, 0) and got[103] == (1, 1) and got[104] == (1, 1)
    assert T.teds(d.limit(0), ["k"], "ref", "hyp").count() == 0


def test_trees_are_never_broadcast(spark):
    from inkspan.operators import table_distance

    pairs = spark.createDataFrame([(1, "<table><tr><td>a</td></tr></table>", "<table><tr><td>b</td></tr></table>")], "k int, ref string, hyp string")
    out = table_distance.teds(pairs, ["k"], "ref", "hyp")
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_many_pairs_of_one_shape(spark):
    """Pairs of equal shapes go together and give what each gives alone; a pair's contents are in one row and stay there."""
    r = random.Random(3)
    texts = ["", "a", "kitten", "sitting", "é日x", "y" * 64, "z" * 70 + "y", "q" * 130, "kit" * 21]
    a = ["".join(r.choices("abcé", k=r.randint(0, 80))) for _ in range(80)] + texts
    pairs = [(i, j) for i in range(len(a)) for j in r.sample(range(len(a)), 12)]
    one, two = (np.array(x) for x in zip(*pairs))
    assert T.many_edits(a, one, two).tolist() == [plain(a[i], a[j]) for i, j in pairs]
    rows, want = [], {}
    for k in range(40):
        tree = [("table|1|1", "", (("tr|1|1", "", (("td|1|1", r.choice(texts), ()), ("td|1|1", r.choice(texts), ()), (r.choice(["td|1|1", "th|1|1"]), "s", ()))),)) for _ in range(2)]
        rows.append((k, html(tree[0]), html(tree[1])))
        want[k] = [1 - d / most for d, most in (brute(*tree, t) for t in (True, False))]
    out = T.teds(spark.createDataFrame(rows, "k int, ref string, hyp string").coalesce(1), ["k"], "ref", "hyp")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for x in out.collect():
        assert abs(x.teds - want[x.k][0]) < 1e-9 and abs(x.teds_structure - want[x.k][1]) < 1e-9
