import json

from inkspan.operators import provenance as P

STAGES = "run string, ord int, program string, repository string, tool_version string, action_status string, start_time string, end_time string, duration_seconds double, input_files_total long, successfully_processed long, skipped_files long, outputs map<string,long>, components array<struct<name:string,version:string>>, file string"


def test_runs_and_files(spark):
    rows = [("a", 2, "two", "r", "", P.COMPLETED, "", "2", 0.2, 9, None, None, {"txt": 2, "md": None}, [("x", "1"), ("z", None)], "d/f.txt"), ("a", 1, "one", "", None, None, "1", "", 0.1, 5, 4, 1, {"txt": 1}, [("y", "1"), ("x", "1"), None], "f.txt"),
            ("b", 1, None, None, None, P.FAILED, None, None, None, None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, STAGES)
    got = {r.run: r for r in P.folded_runs(d, "run", "ord").collect()}
    a, b = got["a"], got["b"]
    assert tuple(a)[1:] == (2, "one", "r", "", P.COMPLETED, "1", "2", 0.3, 5, 0, 1)
    assert tuple(b)[1:] == (1, None, "", "", P.FAILED, "", "", 0.0, 0, 0, 0)
    assert {tuple(r) for r in P.output_formats(d, "run").collect()} == {("a", "txt", 3), ("a", "md", 0)}
    union = sorted(P.components_used(d, "run", "ord").collect(), key=lambda r: (r.first_stage, r.first_place))
    assert [r.component.name for r in union] == ["y", "x", "z"]
    assert {tuple(r) for r in P.folded_files(d, "file").collect()} == {("f.txt", 2, 0.3), (None, 1, 0.0)}
    assert P.folded_runs(d.limit(0), "run", "ord").count() == 0


def plain(rows):
    """Descriptions in order: the first counts whole, later ones where they say something."""
    out = {}
    for g, n, _, attrs in sorted(rows, key=lambda r: r[2]):
        attrs = {k: json.loads(v or "null") for k, v in (attrs or {}).items()}
        known = out.setdefault((g, n), {} if (g, n) in out else dict(attrs))
        known.update({k: v for k, v in attrs.items() if v not in (None, "", [], {})})
    return out


def test_nodes(spark):
    import random

    r = random.Random(4)
    values = ['"a"', '""', "[]", " {} ", "null", None, "[1]", '{"@id": "x"}', "0", "false"]
    rows = [("g", r.choice("pqrs"), i, r.choice([None, {}, {k: r.choice(values) for k in r.sample('abc"', r.randint(1, 4))}])) for i in range(40)]
    rows += [("h", "lone", 0, None), ("h", P.ROOT, 1, {"name": '"x"', "@id": '"other"'}), ("h", P.DESCRIPTOR, 2, {"a": "1"}), ("h", None, 3, {"a": "1"})]
    d = spark.createDataFrame(rows, "graph string, node string, ord int, attributes map<string,string>")
    want = {k: {"@id": k[1], **{n: v for n, v in x.items() if n != "@id"}} for k, x in plain([x for x in rows if x[1] is not None]).items()}
    for parts in (1, 7):
        got = P.merged_nodes(d.repartition(parts), "graph", "node", "ord").collect()
        assert {(x.graph, x.node): json.loads(x.entity) for x in got} == want and len(got) == len(want)
    full = sorted(P.merged_nodes(d, "graph", "node", "ord", conforms='s"1').where("graph = 'h'").collect(), key=lambda x: (x.rank, x.node))
    assert [x.node for x in full] == [P.DESCRIPTOR, P.ROOT, "lone"] and json.loads(full[0].entity)["conformsTo"] == {"@id": 's"1'} and "a" not in json.loads(full[0].entity)
    assert P.merged_nodes(d.limit(0), "graph", "node", "ord", conforms="s").count() == 0
