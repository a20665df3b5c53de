import json
import random

import pytest
from pyspark.sql import functions as F

from inkspan.operators import evaluation, records, routing, validation

SCHEMA = {
    "$defs": {"name": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^[a-z]+$"}},
    "type": "object", "required": ["id", "a.b"], "additionalProperties": False,
    "properties": {"id": {"type": "integer", "minimum": 0, "maximum": 9}, "a.b": {"$ref": "#/$defs/name"}, "list": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": ["object", "null"], "required": ["x"], "properties": {"x": {"const": True}, "y": {"enum": ["p", 2, None]}, "z": {"type": "number"}}}}, "n": {"type": "null"}},
}
GOOD = {"id": 3, "a.b": "abc", "list": [{"x": True, "y": 2, "z": 1.5}, None], "n": None}
CASES = [
    (GOOD, []), ({**GOOD, "id": "3"}, [("$.id", "type")]), ({**GOOD, "id": 3.5}, [("$.id", "type")]), ({**GOOD, "id": 3.0}, []), ({**GOOD, "id": -1}, [("$.id", "minimum")]), ({**GOOD, "id": 10}, [("$.id", "maximum")]),
    ({**GOOD, "a.b": "a"}, [("$.a\\.b", "minLength")]), ({**GOOD, "a.b": "ABCDE"}, [("$.a\\.b", "maxLength"), ("$.a\\.b", "pattern")]), ({"id": 1}, [("$", "required")]), ({**GOOD, "more": 1}, [("$", "additionalProperties")]),
    ({**GOOD, "list": []}, [("$.list", "minItems")]), ({**GOOD, "list": [None] * 4}, [("$.list", "maxItems")]), ({**GOOD, "list": [{}, {"x": False}, {"x": True, "y": "q"}]}, [("$.list[0]", "required"), ("$.list[1].x", "const"), ("$.list[2].y", "enum")]),
    ({**GOOD, "list": [1, {"x": True, "z": "1"}]}, [("$.list[0]", "type"), ("$.list[1].z", "type")]), ({**GOOD, "n": 0}, [("$.n", "type")]), ([GOOD], [("$", "type")]), ("text", [("$", "type")]), ({**GOOD, "list": {"x": 1}}, [("$.list", "type")]),
]


def test_every_rule_has_records_that_break_and_keep_it(spark):
    rows = [(i, json.dumps(c)) for i, (c, _) in enumerate(CASES)] + [(100, "{broken"), (101, None)]
    d = spark.createDataFrame(rows, "path int, content string").withColumn("id", F.lit(1))
    got = {}
    for x in validation.violations(d, SCHEMA).collect():
        got.setdefault(x.path, []).append((x.at, x.keyword))
    for i, (_, want) in enumerate(CASES):
        assert sorted(got.get(i, [])) == sorted(want), i
    assert got[100] == [("$", "json")] and got[101] == [("$", "null")]
    assert validation.violations(d.limit(0), SCHEMA).count() == 0


def test_rules_that_are_not_known_are_refused():
    for bad in ({"oneOf": []}, {"properties": {"a": {"format": "date"}}}, {"$ref": "other.json"}, {"$defs": {"t": {"items": {"$ref": "#/$defs/t"}}}, "$ref": "#/$defs/t"}, {"additionalProperties": {"type": "string"}}):
        with pytest.raises(ValueError):
            list(validation.rules(bad))


def test_line_numbers_start_at_one(spark):
    d = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", 5), ("c", None), ("c", 0)], "page string, line int")
    assert sorted((x.page, x.line or 0) for x in validation.line_numbers_from_one(d, ["page"]).collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 5), ("c", 0), ("c", 1)]


def test_records_merge_by_their_precedence(spark):
    rows = [(1, 1, "s", None, "b1"), (1, 2, None, "d", "b2"), (1, 3, "s", "e", None), (2, 1, "s", "d", "b"), (2, 2, "t", "d", "c"), (3, 1, None, None, None)]
    got = {x.k: tuple(x)[1:] for x in records.merge_records(spark.createDataFrame(rows, "k int, n int, src string, note string, block string"), "k", "n", ["src"], ["note"], ["block"]).collect()}
    assert got == {1: ("s", "d", "b2", "", "ok"), 2: (None, None, None, "src", "conflict"), 3: (None, None, None, "", "ok")}


def test_grid_and_curve_against_each_cell(spark):
    r = random.Random(6)
    rows = [(r.choice([None, 1.0, 2.0, 2.5, 3.0]), r.choice([0.1, 0.5, 0.5000001, 0.9, None]), r.choice([True, False, None])) for _ in range(400)]
    d = spark.createDataFrame(rows, "a double, b double, ok boolean")
    got = {(x.first_cut, x.second_cut): (x.n, x.good) for x in evaluation.threshold_grid(d, "a", "b", [2.5, 0, 2], [0.5, 0.95], "ok").collect()}
    for s in (0.0, 2.0, 2.5):
        for t in (0.5, 0.95):
            cell = [x for x in rows if x[0] is not None and x[1] is not None and x[0] >= s and x[1] >= t]
            assert got[s, t] == (len(cell), sum(bool(x[2]) for x in cell))
    curve = {x.threshold: (x.coverage, x.error) for x in evaluation.coverage_curve(d, "b", "ok").collect()}
    known = [x for x in rows if x[1] is not None]
    for t in {x[1] for x in known}:
        above = [x for x in known if x[1] >= t]
        assert curve[t] == (len(above) / len(known), sum(not x[2] for x in above) / len(above))


def test_reasons_for_recognition(spark):
    lines = routing.decoded_lines(spark.createDataFrame([(1, 1, "sondì èíslo pøi"), (1, 2, "dobrý"), (2, 1, "�" * 9), (3, 1, "12"), (5, 1, "fine line"), (6, 1, "sondì èíslo pøi")], "p int, line int, text string"), ["p"])
    pages = spark.createDataFrame([(1, "digital", False), (2, "ocr", None), (3, "none", False), (4, "none", False), (5, "digital", False), (6, "digital", True), (7, None, None)], "p int, text_layer string, textual boolean")
    assert {x.p: (x.reasons, x.needs_atr) for x in routing.atr_reasons(lines, pages, ["p"]).collect()} == {1: ("mojibake", True), 2: ("undecodable,prior_ocr", True), 3: ("furniture_only", True), 4: ("no_text", True), 5: ("", False), 6: ("", False), 7: ("", False)}


def test_values_are_never_broadcast(spark):
    """What grows with the values goes to no driver, however small it is said to be."""
    from inkspan.operators import validation

    files = spark.createDataFrame([(1, '{"a": [1, {"b": "x"}]}')], "path int, content string")
    out = validation.violations(files, {"type": "object", "properties": {"a": {"type": "array", "maxItems": 1}}})
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.at, r.keyword) for r in out.collect()] == [("$.a", "maxItems")]


def test_values_move_nowhere(spark):
    """Values are followed down from the top of each record, in batches of any size, without a shuffle or a table between."""
    schema = {"type": "object", "properties": {"a.b": {"items": {"type": "array", "items": {"type": ["integer", "string"], "maximum": 5}}}, "[*]": {"type": "object", "additionalProperties": False, "properties": {"": {"const": "é\n"}}}, "\\": {"enum": [1.5, None, False]}}}
    good = {"a.b": [[1, "x"], []], "[*]": {"": "é\n"}, "\\": False, "other": {"a.b": 7}}
    cases = [(good, []), ({**good, "a.b": [[1, 6], [2.5], "s", [None, 7.0]]}, [("$.a\\.b[0][1]", "maximum"), ("$.a\\.b[1][0]", "type"), ("$.a\\.b[2]", "type"), ("$.a\\.b[3][0]", "type"), ("$.a\\.b[3][1]", "maximum")]),
             ({"[*]": {"": "e", "x": [1]}}, [("$.\\[*]", "additionalProperties"), ("$.\\[*].", "const")]), ({"\\": 1e400}, [("$.\\\\", "enum")]), ({"\\": 1.5, "a.b": []}, []), ([[good]], [("$", "type")])]
    texts = [json.dumps(c).replace("Infinity", "1e400") for c, _ in cases]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, '{} {}'), (101, '{}, {}'), (102, '{}], [{}'), (103, ""), (104, None), (None, '{"a.b": [1]}'), (None, "{")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        out = validation.violations(spark.createDataFrame(rows, "path int, content string").coalesce(1), schema)
        got = {}
        for x in out.collect():
            got.setdefault(x.path, []).append((x.at, x.keyword))
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: sorted(v) for k, v in got.items() if k is not None and k < 100} == {i: sorted(w) for i, (_, w) in enumerate(cases) if w}
    assert {k: got[k] for k in (100, 101, 102, 103, 104, None)} == {100: [("$", "json")], 101: [("$", "json")], 102: [("$", "json")], 103: [("$", "json")], 104: [("$", "null")], None: [("$", "json")]}
