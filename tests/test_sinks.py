import json
import os

import pytest
from pyspark.sql import functions as F

from inkspan.sinks import renderings as R
from inkspan.sinks import text_files as T

ROWS = [("a/b c+d", 1, 1, " one "), ("a/b c+d", 1, 2, ""), ("a/b c+d", 2, 1, None), ("a/b c+d", 4, 1, "# two"), ("a/b c+d", 4, 2, "<!-- x -->"), ("a/b c+d", 4, 3, "dup"), ("a/b c+d", 4, 3, "dup"), ("_hidden", 1, 1, ""), ("_hidden", 2, 1, " "),
        (".dot", 3, 1, 'č "q" \\ 日'), (".dot", 9, 1, ""), ("x" * 60, None, 1, "null page"), ("x" * 60, 1, 1, "##  y")]


def plain(rows, markdown, title=None):
    """Rows of one file by the rule, all at once."""
    out, page, begun = [f"# {title}"] if title else [], None, False
    for _, p, _, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] or "")):
        if not begun or p != page:
            out += [f"\n## Page {p}\n"] if markdown else [""] if begun else []
        page, begun, text = p, True, (text or "").strip()
        if text and markdown:
            text = text.replace("<!--", "&lt;!--").replace("-->", "--&gt;")
            text = "\\" + text if text.startswith("#") else text
        out += [text] if text else []
    return "\n".join(out).strip() + "\n"


def files(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture
def lines(spark):
    return spark.createDataFrame([(*r, "k") for r in ROWS], "file string, page int, line int, text string, part string").repartition(5)


def test_files_by_the_rules(spark, lines, tmp_path):
    for name, parts, want in (("p", R.plain_parts(lines, "file"), lambda f, r: plain(r, False)), ("m", R.markdown_parts(lines, "file"), lambda f, r: plain(r, True)), ("t", R.markdown_parts(lines, "file", title="file"), lambda f, r: plain(r, True, f))):
        path = str(tmp_path / name)
        T.write_texts(parts, path)
        got = {x.file: x.content for x in T.read_texts(spark, path).collect()}
        assert got == {f: want(f, r) for f, r in files(ROWS).items()}, name
        assert not [n for n in os.listdir(path) if n.startswith("_temp")] and parts.limit(0).count() == 0
    path = "file:" + str(tmp_path / "j")
    T.write_texts(R.json_parts(lines, "file"), path, suffix=".json")
    for x in T.read_texts(spark, path, ".json").collect():
        d = json.loads(x.content)
        assert d["file"] == x.file and x.content.endswith("\n")
        key = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] or "")
        assert [(p["page"], t) for p in d["pages"] for t in p["lines"]] == [(r[1], r[3] or "") for r in sorted(files(ROWS)[x.file], key=key)]


def test_failed_and_repeated_jobs(spark, lines, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame(r, "file string, n int, part string")
    T.write_texts(rows(("a", 2, "2"), ("a", 1, "1"), ("b", 1, None)), path, order=("n",))
    read = lambda: {x.file: x.content for x in T.read_texts(spark, path).collect()}
    assert read() == {"a": "12"} and os.path.getsize(os.path.join(path, "b.txt")) == 0
    before = sorted(os.listdir(path))
    broken = rows(("a", 1, "new"), ("c", 1, "x"), ("d", 1, "y")).withColumn("part", F.when(F.col("file") == "d", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("part")))
    for bad in (broken, rows(("a", 1, "new"), (None, 1, "x"))):
        with pytest.raises(Exception):
            T.write_texts(bad, path, order=("n",))
        assert sorted(os.listdir(path)) == before and read() == {"a": "12"}
    T.write_texts(rows(("a", 1, "new"), ("c", 1, "x")), path, order=("n",))
    assert read() == {"a": "new", "c": "x"}
    T.write_texts(rows(("z", 1, "z")), path, order=("n",), mode="overwrite")
    assert read() == {"z": "z"}
    T.write_texts(rows(("q", 1, "q")).limit(0), path, order=("n",), mode="overwrite")
    assert T.read_texts(spark, path).count() == 0
    with pytest.raises(Exception):
        T.write_texts(rows(("z", 1, "z")), "s3a://bucket/x", order=("n",))


def test_the_driver_lists_no_files(spark, tmp_path):
    """Neither the commit nor the reader holds what grows with the number of files."""
    import tracemalloc

    n, path = 3000, str(tmp_path / "many")
    rows = spark.range(n).select(F.concat(F.lit("n" * 100), "id").alias("file"), F.lit(1).alias("n"), F.lit("x").alias("part"))
    T.write_texts(rows, path, order=("n",))
    back = T.read_texts(spark, path)
    assert back.count() == n and "FileScan" not in back._jdf.queryExecution().executedPlan().toString()
    os.makedirs(tmp_path / "attempt")
    for i in range(n):
        (tmp_path / "attempt" / f"{'m' * 100}{i}.txt").write_text("y")
    writer = T._Writer(path, ".txt", True)
    os.makedirs(writer.job)
    tracemalloc.start()
    writer.commit([T.Written(str(tmp_path / "attempt")), None])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000 and len(os.listdir(path)) == n + 1 and not os.listdir(tmp_path / "attempt")
    for k in "ab":
        os.makedirs(tmp_path / k)
        (tmp_path / k / "same.txt").write_text(k)
    with pytest.raises(ValueError):
        T._Writer(path, ".txt", False).commit([T.Written(str(tmp_path / k)) for k in "ab"])


def test_rendered_lines_are_shuffled_once(spark, lines, tmp_path, monkeypatch):
    """Lines that a rendering has put together by file are written from there."""
    from pyspark.sql import DataFrameWriter

    plans, save = [], DataFrameWriter.save

    def seen(self, *args, **kinds):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return save(self, *args, **kinds)

    monkeypatch.setattr(DataFrameWriter, "save", seen)
    T.write_texts(R.plain_parts(lines, "file"), str(tmp_path / "o"))
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1
    assert {x.file: x.content for x in T.read_texts(spark, str(tmp_path / "o")).collect()} == {f: plain(r, False) for f, r in files(ROWS).items()}
