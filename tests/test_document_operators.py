from pyspark.sql import functions as F

from inkspan.functions import decode, lines
from inkspan.functions.text import natural_key
from inkspan.operators import evaluation, layout, quality, records, routing
from inkspan.sources import text as sources
from inkspan.sources.text import text_lines


def test_lines_pages_and_nulls(spark):
    d = spark.createDataFrame([(1, "a\nb\fc\n"), (2, ""), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, text_lines(d).collect()))
    assert got == [(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "c"), (2, 1, 1, "")]
    d = spark.createDataFrame([(1, "a\r\nb\rc\u2028d\x0be\x85f\f \n\f")], "doc_id long, text string")
    assert [tuple(r)[2:] for r in text_lines(d).orderBy("line").collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e"), (6, "f")]


def test_tiers(spark):
    rows = [("a1", 0.9, 8, 1, 10), ("a2", 0.7, 5, 2, 10), ("b1", 0.4, 1, 1, 5), ("c1", None, 0, 0, 1), ("d1", 0.95, 1, 0, 10), ("e1", float("nan"), 1, 0, 1)]
    d = spark.createDataFrame(rows, "k string, avg_quality_score double, clear int, noisy int, num_lines int")
    got = {r["k"]: r["tier"] for r in d.withColumn("tier", quality.tier()).collect()}
    assert got == {"a1": "clean", "a2": "degraded", "b1": "hard", "c1": "text_poor", "d1": "degraded", "e1": "text_poor"}


def test_error_rates(spark):
    d = spark.createDataFrame([("abcd", "abxd"), ("", ""), ("", "x"), (None, None), ("kitten", "sitting")], "r string, h string")
    got = [tuple(r) for r in evaluation.score_texts(d, "r", "h").select("cer", "ned").collect()]
    assert got == [(0.25, 0.25), (0.0, 0.0), (1.0, 1.0), (0.0, 0.0), (0.5, 3 / 7)]
    d = spark.createDataFrame([("cafe\u0301\u00a0 au  lait", "caf\u00e9 au lait"), ("a b c d", "a x c"), ("", "x y"), ("a a b", "a b a")], "r string, h string")
    got = [tuple(r) for r in evaluation.score_texts(d, "r", "h").select("cer", "wer").collect()]
    assert got[0] == (0.0, 0.0) and got[1][1] == 0.5 and got[2] == (1.0, 1.0) and got[3][1] == 2 / 3


def test_error_rates_of_the_whole_benchmark(spark, tmp_path):
    from inkspan.plans import registry

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    texts = ["théâtre: the été", "你好 the 世界 the", "žluťoučký kůň", "😀the😀", "plain the text", ""]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["item_id"]: (r["cer"], r["ned"]) for r in registry.QUERIES["cer_ned_all"](spark, str(tmp_path)).collect()}
    want = {i: distance(t, t.replace("the", "teh")) / max(1, len(t)) for i, t in enumerate(texts)}
    assert got == {i: (x, x) for i, x in want.items()}
    real = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert registry.QUERIES["cer_ned_all"](spark, "/root/testdata/sf0.001").count() == real.count() > real.where(~F.col("text").rlike(r"[^\x00-\x7F]")).count()


def test_multiset_prf(spark):
    ref = spark.createDataFrame([(1, "PER", "Jan  Hus"), (1, "GEO", "Praha"), (1, "PER", "Jan Hus")], "k int, t string, w string")
    hyp = spark.createDataFrame([(1, "PER", "jan hus"), (1, "GEO", "Brno"), (1, "PER", "praha")], "k int, t string, w string")
    r = evaluation.multiset_prf(ref, hyp, "k", "t", "w").first()
    assert (r["tp"], r["precision"], r["recall"]) == (1, 1 / 3, 1 / 3)


def test_summary_takes_valid_lines_only(spark):
    rows = [("a", "Clear", 0.9), ("a", "Noisy", 0.6), ("a", "Trash", 0.1), ("a", "Empty", 0.0), ("b", "Trash", 0.2), ("b", "Non-text", 0.0)]
    d = spark.createDataFrame(rows, "doc_id string, categ string, quality_score double").withColumn("text", F.lit("x"))
    got = {r["doc_id"]: (r["avg_quality_score"], r["num_lines"]) for r in quality.line_summary(d, ["doc_id"]).collect()}
    assert abs(got["a"][0] - 0.75) < 1e-12 and got["b"] == (None, 2)
    judged = {r["doc_id"]: (r["score"], r["band"], r["lines_scored"], r["prose_scored"]) for r in quality.page_quality(d, ["doc_id"], F.col("categ") == "Trash").collect()}
    assert judged == {"a": (0.5333, "Clear", 3, 1), "b": (0.2, "Trash", 1, 1)}


def test_ranges_and_upsert(spark):
    d = spark.createDataFrame([(1,), (2,), (2,), (5,)], "v long")
    assert sorted(map(tuple, records.consecutive_ranges(d, "v").collect())) == [(1, 2, 2), (5, 5, 1)]
    d = spark.range(3, 10000).withColumnRenamed("id", "v").where("v <> 4096 and v <> 9000")
    assert sorted(map(tuple, records.consecutive_ranges(d, "v").collect())) == [(3, 4095, 4093), (4097, 8999, 4903), (9001, 9999, 999)]
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "k int, n string, v int")
    b = spark.createDataFrame([(2, "z", 7, 1), (2, "z", None, 2), (3, "w", 9, 1)], "k int, n string, v int, seq int")
    got = sorted(map(tuple, records.keyed_upsert(a, b, "k", ["v"], "seq").collect()))
    assert got == [(1, "x", 1), (2, "y", None), (3, None, 9)]


def test_fold_and_diff(spark):
    p = spark.createDataFrame([(1, 1, None, "a"), (1, 2, "x", "b"), (1, 3, "x", None)], "k int, o int, f string, g string")
    assert tuple(records.fold_records(p, "k", "o", ["f", "g"]).first()) == (1, "x", "a", "g")
    o, n = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, f string"), spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, f string")
    assert sorted(map(tuple, records.record_diff(o, n, "k", ["f"]).collect())) == [(1, "removed", ""), (2, "changed", "f"), (4, "added", "")]


def test_decode_checks(spark):
    rows = [(1, 1, "sondì èíslo"), (1, 2, "dobrý dìn"), (1, 3, "čistý text"), (2, 1, "crème brûlée è è"), (3, 1, "\ufffd\ufffd ab"), (4, 1, ""), (4, 2, "plain")]
    d = spark.createDataFrame(rows, "doc_id int, line int, text string")
    got = {(r["doc_id"], r["line"]): r["decode"] for r in routing.decoded_lines(d, ["doc_id"]).collect()}
    assert got == {(1, 1): "garbled", (1, 2): "garbled", (1, 3): None, (2, 1): None, (3, 1): "garbled", (4, 1): None, (4, 2): None}
    assert d.where("doc_id = 1 and line = 1").select(decode.recovered(F.col("text"))).first()[0] == "sondě číslo"


def test_line_kinds_and_routes(spark):
    rows = ["short", "1234 5678 9012 3456 7890 ab", "Contents of the book ........ 12", "This is a long line of ordinary prose.", "  " + "x" * 19 + "  "]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "text string").select(lines.line_kind(F.col("text"))).collect()]
    assert got == ["short", "few letters", "dot leaders", "prose", "short"]
    cols = "text_layer string, category string, lines_scored int, trash int, prose_scored int, prose_trash int, drew boolean, furniture_only boolean"
    rows = [("blank", None, None, None, None, None, False, False), ("digital", "TEXT", 10, 9, 4, 4, True, False), ("digital", "TEXT", 10, 6, None, None, True, False), ("digital", None, 10, 9, 6, 4, True, False), ("digital", "TEXT_HW", None, None, None, None, True, True),
            ("none", None, None, None, None, None, False, False), ("none", "PHOTO", None, None, None, None, True, False), ("garbled", "LINE_HW", None, None, None, None, True, False), ("ocr", "UNKNOWN", None, None, None, None, True, False), ("none", "DRAW_L", None, None, None, None, True, False)]
    got = [r[0] for r in spark.createDataFrame(rows, cols).select(routing.page_route()).collect()]
    assert got == ["none", "nlp", "ocr", "ocr", "htr", "none", "none", "htr", "ocr", "ocr"]
    pages = spark.createDataFrame([("a", 1, "nlp", False), ("a", 2, "ocr", True), ("b", 1, "none", True), ("b", 2, "htr", False)], "d string, p int, route string, needs_atr boolean")
    got = {r["d"]: (r["pages"], r["ocr"], r["needs_atr_pages"], r["reacquire_pages"], r["document_route"]) for r in routing.document_summary(pages, ["d"], "p").collect()}
    assert got == {"a": (2, 1, [2], [2], "mixed"), "b": (2, 0, [1], [2], "htr")}


def test_furniture_and_paragraphs(spark):
    rows = [("d", p, 0.0, 5.0, 100.0, f"Report  page {p}", False) for p in range(1, 5)] + [("d", 1, 50.0, 55.0, 100.0, "Report page 1", False), ("d", 2, 95.0, 99.0, 100.0, "- 12 / 30 -", False), ("d", 3, 95.0, 99.0, 100.0, "Only here", False), ("d", 4, 0.0, 5.0, 100.0, "cell", True)]
    d = spark.createDataFrame(rows, "doc string, page int, top double, bottom double, height double, text string, in_table boolean")
    got = {(r["page"], r["text"]): r["region"] for r in layout.furniture(d, ["doc"], "page").where("region is not null").collect()}
    assert got == {(p, f"Report  page {p}"): "header" for p in range(1, 5)} | {(2, "- 12 / 30 -"): "footer"}
    rows = [(1, 1, 0.0, 10.0), (1, 2, 12.0, 22.0), (1, 3, 56.0, 66.0), (1, 4, 68.0, 78.0), (1, 5, 80.0, 90.0), (1, 6, 5.0, 15.0), (2, 1, 0.0, 10.0)]
    d = spark.createDataFrame(rows, "page int, n int, top double, bottom double").withColumns({"col": F.lit(0), "region": F.lit(None).cast("string"), "heading": F.lit(None).cast("int")})
    assert [r["paragraph"] for r in layout.paragraphs(d, ["page"], "n").orderBy("page", "n").collect()] == [0, 0, 1, 1, 1, 2, 0]


def test_calibration_bins_brier_and_mcnemar(spark):
    d = spark.createDataFrame([(0.0, True), (0.1, True), (0.11, False), (1.0, True), (None, True)], "c double, ok boolean")
    assert {r["bin"]: r["n"] for r in evaluation.reliability_bins(d, "c", "ok").collect()} == {0: 2, 1: 1, 9: 1}
    d = spark.createDataFrame([({"a": 0.7, "b": 0.3}, "a"), ({"a": 0.5, "b": 0.5}, "b"), ({"a": 1.0}, None)], "p map<string,double>, g string")
    r = evaluation.brier_score(d, "p", "g").first()
    assert r["n"] == 2 and abs(r["brier"] - (0.18 + 0.5) / 2) < 1e-12
    d = spark.createDataFrame([(True, False)] * 6 + [(False, True)] + [(True, True)] * 9, "a boolean, b boolean")
    r = evaluation.mcnemar_exact(d, "a", "b").first()
    assert (r["b"], r["c"]) == (6, 1) and abs(r["p"] - 2 * (1 + 7) / 128) < 1e-12
    assert evaluation.mcnemar_exact(d.limit(0), "a", "b").first()["p"] == 1.0


def test_csv_and_json_contents(spark):
    d = spark.createDataFrame([("a", 'x,"y\nz",\n,,\n1,2,3\n'), ("b", 'k;v\n1;"open'), ("c", None), ("d", "")], "path string, content string")
    assert sorted(map(tuple, sources.csv_lines(d).collect())) == [("a", 1, "x\ty z"), ("a", 2, "1\t2\t3"), ("b", 1, "k\tv")]
    d = spark.createDataFrame([("a", '{"k": ["x", {"q": "y"}, 1], "z": "w"}'), ("b", "{bad"), ("c", None)], "path string, content string")
    assert sorted(map(tuple, sources.json_lines(d).collect())) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "w")]
    d = spark.createDataFrame([("a", '"one"\n\n{bad\r\n["two", "three"]\n5')], "path string, content string")
    assert sorted(map(tuple, sources.jsonl_pages(d).collect())) == [("a", 1, 1, "one"), ("a", 4, 1, "two"), ("a", 4, 2, "three")]


def test_natural_order(spark):
    d = spark.createDataFrame([(x,) for x in ("p10", "p2", "P1", "p2b", "p02", "q")], "t string")
    assert [r[0] for r in d.orderBy(natural_key(F.col("t"))).collect()] == ["P1", "p02", "p2", "p2b", "p10", "q"]


def test_queries_match_sql(spark):
    import duckdb

    from inkspan.plans import registry

    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "labels", "benchmark", "customer", "events", "lineitem", "orders", "supplier"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, f in registry.QUERIES.items():
        if name not in registry.ORACLES:
            continue
        got, want = f(spark, sf), db.sql(registry.ORACLES[name])
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        a = sorted(map(repr, (tuple(r) for r in got.select(cols).collect())))
        b = sorted(map(repr, want.select(*(f'"{c}"' for c in cols)).fetchall()))
        assert a == b, (name, a[:2], b[:2])


def test_coverage_curve_and_threshold(spark):
    d = spark.createDataFrame([(0.9, True), (0.9, False), (0.8, True), (0.3, None), (None, True), (1.0, True)], "c double, ok boolean")
    curve = evaluation.coverage_curve(d, "c", "ok")
    assert sorted(map(tuple, curve.collect())) == [(0.3, 1.0, 0.4), (0.8, 0.8, 0.25), (0.9, 0.6, 1 / 3), (1.0, 0.2, 0.0)]
    assert tuple(evaluation.pick_threshold(curve, 0.3).first()) == (0.8, 0.8, 0.25)
    assert evaluation.pick_threshold(curve, -1.0).count() == 0
    assert evaluation.coverage_curve(d.limit(0), "c", "ok").count() == 0


def test_expected_calibration_error(spark):
    d = spark.createDataFrame([(0.25, True), (0.25, False), (1.0, True)], "c double, ok boolean")
    assert abs(evaluation.expected_calibration_error(d, "c", "ok").first()["ece"] - 0.5 / 3) < 1e-12
    assert tuple(evaluation.expected_calibration_error(d.limit(0), "c", "ok").first()) == (0, None)


def test_counts_of_decode_reports_match_one_by_one(spark):
    """Runs taken out in one match, and ASCII told apart, leave the counts as they are by character; the columns that
    make up a report are counted once, whatever reads it."""
    import re
    import unicodedata

    from inkspan.functions import decode
    from inkspan.functions.text import newlines
    from inkspan.operators import routing

    texts = ["", None, "plain words 12", "tab\tand\x01\x02 \x7f\x1c", "Pøíli¹ ¾lu»ouèký àê", "a b　c​�", "ÁÍú žš", "\x85x\x0b"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    white = set(" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85")
    for row in d.select("text", decode.decode_report(d.text).alias("r")).collect():
        t, r = row.text or "", row.r
        assert r.letters == sum(unicodedata.category(c)[0] == "L" for c in t)
        assert r.chars == sum(c not in white and unicodedata.category(c)[0] != "Z" for c in t)
        assert r.bad == sum(c not in white and (c == "�" or unicodedata.category(c) in ("Cc", "Cf", "Co", "Cn")) for c in t)
        assert r.suspicious == (sum(c in decode.MISREADS for c in t) if r.letters else 0)
        assert (r.foreign, r.shared) == (any(c in decode.FOREIGN for c in t), any(c in decode.SHARED for c in t))
    assert [x.t for x in d.select(newlines(d.text).alias("t")).collect() if x.t] == [re.sub("\r\n|[\r\x0b\x1c\x1d\x1e\x85  ]", "\n", t) for t in texts if t]
    plan = routing.decoded_lines(d, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("p{Cn}") == 1


def test_union_share_moves_boxes_once_and_counts_cells(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    r = random.Random(5)
    spot = lambda *more: r.choice([*more, -3.0, r.uniform(-2, 12), float(r.randrange(12))])
    rows = [(r.choice(["a", "b", None]), r.randrange(6), spot(None), spot(None), spot(), spot(), 0.0, 0.0, 10.0, r.choice([10.0, 10.0, 0.0, None])) for _ in range(150)]
    rows += [("c", 1, 1.0, 1.0, 4.0, 4.0, 0.0, 0.0, 10.0, 10.0)] * 20 + [("d", 1, 1.0, 1.0, 1.0, 4.0, 0.0, 0.0, 10.0, 10.0)]
    boxes = spark.createDataFrame(rows, "k string, n int, x0 double, y0 double, x1 double, y1 double, fx0 double, fy0 double, fx1 double, fy1 double")
    want = {}
    for k, n, x0, y0, x1, y1, _, _, _, fy1 in rows:
        cells = want.setdefault((k, n), set())
        if None not in (x0, y0, x1, y1, fy1) and fy1 > 0:
            (x0, x1), (y0, y1) = sorted((x0, x1)), sorted((y0, y1))
            cells |= {(c, q) for c in range(20) for q in range(20) if x0 <= (c + 0.5) / 2 < x1 and y0 <= (q + 0.5) / 2 < y1}
    want = {k: len(v) / 400 for k, v in want.items()}
    assert {(x.k, x.n): x.share for x in layout.union_share(boxes, ["k", "n"], 20).collect()} == want and len(set(want.values())) > 8
    monkeypatch.setattr(layout, "MANY", 3)
    assert {(x.k, x.n): x.share for x in layout.union_share(boxes, ["k", "n"], 20).collect()} == want
    # what moves are boxes, not their rows of cells: these are made in the shuffle's reader
    tall = spark.range(50).select(F.col("id").alias("k"), *(F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 9.0), ("y1", 10.0), ("fx0", 0.0), ("fy0", 0.0), ("fx1", 10.0), ("fy1", 10.0))))
    plan = layout.union_share(tall, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 1


def test_cells_are_filled_by_parts_of_keys(monkeypatch):
    import numpy as np
    import pyarrow as pa

    t = pa.table({"c0": [0, 1, 0, 5, 0], "c1": [3, 4, 2, 6, 0], "r0": [0, 1, 0, 2, 0], "r1": [2, 3, 3, 4, 0]})
    for n in (1, 3, 4, 100):
        monkeypatch.setattr(layout, "SPANS", n)
        assert layout._filled(t, np.array([0, 0, 1, 2, 3]), 10).tolist() == [10, 6, 2, 0]
