"""XML, ALTO and PAGE contents against the standard parser and small files with a known order."""

import random
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from inkspan.sources import xml_trees as X


def made(r, depth=0):
    name = r.choice(["a", "ns:b", "TextLine", "String"])
    attrs = "".join(f" {k}={quoteattr(r.choice(['1', 'x < y', 'é & ü', '']))}" for k in r.sample(["p", "q", "CONTENT"], r.randint(0, 3)))
    if depth > 5 or r.random() < 0.2:
        return f"<{name}{attrs}/>"
    inner = "".join(r.choice([lambda: made(r, depth + 1), lambda: escape(r.choice(["text", " ", "1 < 2 & 3", "é"])), lambda: "<!-- <x> -->", lambda: "<![CDATA[<raw> & ]]>", lambda: "&#233;&#x41;&amp;lt;", lambda: "<?pi <?>"])() for _ in range(r.randint(0, 5)))
    return f"<{name}{attrs}>{inner}</{name}>"


def test_nodes_against_the_parser(spark):
    r = random.Random(2)
    files = ['<?xml version="1.0"?>\n<r xmlns:ns="u">' + made(r) + "</r>\n" for _ in range(150)]
    bad = ["", "text", "<a>", "<a></b>", "</a>", "<a/><b/>", "<a></a>x", "<!DOCTYPE a [<!ENTITY e 'x'>]><a/>", "<a><b></a></b>", "<a b=c/>", "<a></a></a>", "x<a/>", "<a", None]
    d = spark.createDataFrame(list(enumerate(files + bad)), "path int, content string")
    got = {}
    for x in X.xml_nodes(d).collect():
        got.setdefault(x.path, []).append(x)
    for i, f in enumerate(files):
        root, want = ET.fromstring(f), []

        def walk(e, level):
            want.append((level, e.tag.split("}")[-1], dict(e.attrib), None))
            if e.text:
                want.append((level + 1, None, None, e.text))
            for c in e:
                walk(c, level + 1)
                if c.tail:
                    want.append((level + 1, None, None, c.tail))

        walk(root, 0)
        seen = []
        for x in sorted(got[i], key=lambda x: x.node):
            item = (x.level, x.name, x.attrs, x.text if x.name is None else None)
            if item[1] is None and seen and seen[-1][1] is None and seen[-1][0] == item[0] and last_end + 1 >= 0:  # the parser joins neighbouring texts
                seen[-1] = (*item[:3], seen[-1][3] + item[3])
            elif not (item[1] is None and item[0] == 0):
                seen.append(item)
            last_end = x.end
        assert seen == want, f
    assert not [i for i in got if i >= len(files)]
    assert X.xml_nodes(d.limit(0)).count() == 0


def test_deep_nesting_and_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(1, "<a>" * 5000 + "x" + "</a>" * 5000)], "path int, content string").withColumns({c: F.lit(1) for c in ("id", "node", "pos", "level")})
    assert X.xml_nodes(d).count() == 5001


def test_alto_lines(spark):
    a = """<alto><Layout><Page ID="x1"><TextLine HPOS="1" VPOS="2" WIDTH="3.5" HEIGHT="4"><String CONTENT="a"/><SP/><String CONTENT=""/><HYP/><String CONTENT="b"/><HYP/><HYP/></TextLine><TextLine/></Page>
    <Page><ComposedBlock><TextLine HPOS="n"><String CONTENT="c &lt; d"/></TextLine></ComposedBlock></Page></Layout></alto>"""
    d = spark.createDataFrame([(1, a), (2, "<alto><TextLine><HYP/><String CONTENT='solo'/></TextLine></alto>"), (3, "<alto>")], "path int, content string")
    got = sorted((x.path, x.page, x.line, x.label, x.text, x.x0, x.y1) for x in X.alto_lines(d).collect())
    assert got == [(1, 1, 1, "x1", "a - b--", 1.0, 6.0), (1, 1, 2, "x1", "", None, None), (1, 2, 1, "2", "c < d", None, None), (2, 1, 1, "1", "solo", None, None)]


def test_page_reading_order(spark):
    line = lambda t: f"<TextLine><TextEquiv index='1'><Unicode>no</Unicode></TextEquiv><TextEquiv><Unicode>{t}</Unicode></TextEquiv></TextLine>"
    region = lambda i, inner: f"<TextRegion id='{i}'>{inner}</TextRegion>"
    p = f"""<PcGts><Page><ReadingOrder><UnorderedGroup><RegionRefIndexed index="5" regionRef="a"/><OrderedGroupIndexed index="2" regionRef="g"><RegionRef regionRef="d"/><RegionRef regionRef="c"/><RegionRef regionRef="missing"/></OrderedGroupIndexed>
    <RegionRefIndexed index="9" regionRef="a"/></UnorderedGroup></ReadingOrder>
    {region('a', line('A1') + region('inner', line('I1')) + region('c', line('C')) + line('A2'))}{region('b', line('B'))}{region('d', line('D'))}{region('g', '<TextEquiv><Unicode>G one&#10;G two</Unicode></TextEquiv>')}
    <TableRegion id="t"><TableCell row="1" col="0">{line('c10')}</TableCell><TableCell row="0" col="1">{line('c01')}</TableCell><TextRegion><Roles><TableCellRole rowIndex="0" columnIndex="0"/></Roles><TextLine><Word><TextEquiv><Unicode>c</Unicode></TextEquiv></Word><Word><TextEquiv><Unicode>00</Unicode></TextEquiv></Word></TextLine></TextRegion></TableRegion>
    <TableRegion id="u"><TableCell row="1" col="0">{line('z1')}</TableCell><TableCell>{line('z2')}</TableCell></TableRegion></Page><Page>{region('b', line('second page'))}</Page></PcGts>"""
    got = sorted((x.page, x.line, x.text) for x in X.page_lines(spark.createDataFrame([(1, p)], "path int, content string")).collect())
    assert [t for n, _, t in got if n == 1] == ["G one", "G two", "D", "C", "A1", "I1", "A2", "B", "c 00", "c01", "c10", "z1", "z2"]
    assert [t for n, _, t in got if n == 2] == ["second page"]


def test_nodes_move_nowhere(spark):
    from inkspan.sources import json_trees, xml_trees

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        xml = [(1, "<a x='1'><b>t<c/>u</b><!-- n --></a>"), (2, "<a><b></a></b>"), (3, "<a/><b/>"), (4, "</a>"), (5, "<a>"), (6, "x<a/>"), (7, " <a>1</a> ")]
        n = xml_trees.xml_nodes(spark.createDataFrame(xml, "path int, content string").coalesce(1))
        assert [(r.path, r.node, r.end, r.parent, r.level, r.name, r.text) for r in n.orderBy("path", "node").collect() if r.path != 7] == [(1, 0, 7, None, 0, "a", None), (1, 1, 5, 0, 1, "b", None), (1, 2, 2, 1, 2, None, "t"), (1, 3, 3, 1, 2, "c", None), (1, 4, 4, 1, 2, None, "u")]
        assert {r.path for r in n.collect()} == {1, 7}
        j = json_trees.json_nodes(spark.createDataFrame([(1, '{"a": [{"b": 1}, "x"], "c": {}}')], "path int, content string").coalesce(1))
        assert [(r.parent, r.level, r.kind, r.key, r.under) for r in j.orderBy("node").collect()] == [(None, 0, "object", None, None), (0, 1, "array", "a", "a"), (2, 2, "object", None, "a"), (3, 3, "other", "b", "b"), (2, 2, "string", None, "a"), (0, 1, "object", "c", "c")]
        for df in (n, j):
            assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _plain_alto(root):
    """Lines of an ALTO tree by the rule, top-down."""
    out, pages = [], []

    def walk(e, page):
        name = e.tag.split("}")[-1]
        if name == "Page":
            pages.append(e)
            page = (len(pages), e.get("PHYSICAL_IMG_NR") or e.get("ID") or str(len(pages)))
        if name == "TextLine":
            words = []
            for c in e:
                if c.tag.split("}")[-1] == "String":
                    words.append(c.get("CONTENT") or "")
                elif c.tag.split("}")[-1] == "HYP" and words:
                    words[-1] += "-"
            out.append((page, " ".join(w for w in words if w), e.get("HPOS")))
        for c in e:
            walk(c, page)

    walk(root, (1, "1"))
    return out


def test_alto_streams_against_the_parser(spark):
    """Tags in any spelling, from a content's own tokens: nothing is shuffled or staged."""
    r = random.Random(8)

    def tag(name, **attrs):
        items = [(k, v) for k, v in attrs.items() if v is not None]
        r.shuffle(items)
        space = lambda: r.choice(["", "", " ", "\n"])
        return f"<{name}" + "".join(f"{r.choice([' ', '  ', chr(10)])}{k}{space()}={space()}{quoteattr(v) if r.random() < 0.7 else chr(39) + escape(v, {chr(39): '&apos;'}) + chr(39)}" for k, v in items)

    def line(depth=0):
        inner = [tag(r.choice(["String", "a:String"]), CONTENT=r.choice(["w", "", "é &", "a'b", 'q"', "CONTENT=", None]), WC="0.9", XCONTENT="no", SUBS_CONTENT="x CONTENT='no'") + "/>" for _ in range(r.randint(0, 4))] + ["<HYP/>"] * r.randint(0, 2) + ([line(1)] if depth == 0 and r.random() < 0.1 else [])
        r.shuffle(inner)
        return tag("TextLine", HPOS=r.choice(["1", "2.5", "x", None]), ID="l") + ">" + "<SP/>".join(inner) + "</TextLine >"

    files = []
    for _ in range(80):
        pages = [tag("Page", ID=r.choice(["", "p", None]), PHYSICAL_IMG_NR=r.choice(["", "7", None])) + "><!-- <Page> -->" + "".join(line() for _ in range(r.randint(0, 3))) + "</Page>" for _ in range(r.randint(0, 3))]
        files.append("<alto xmlns:a='u'>" + r.choice(["", line()]) + "\n".join(pages) + "</alto>\n")
    d = spark.createDataFrame(list(enumerate(files)) + [(900, "<alto><Page></alto></Page>"), (901, "")], "path int, content string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        lines = X.alto_lines(d)
        got = {}
        for x in sorted(lines.collect(), key=lambda x: (x.path, x.page, x.line)):
            got.setdefault(x.path, []).append((x.page, x.label, x.line, x.text, x.x0))
        assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, f in enumerate(files):
        want, root = {}, ET.fromstring(f)
        for (page, label), text, x in _plain_alto(root):
            want.setdefault(page, []).append((page, label, text, float(x) if x not in (None, "x") else None))
        assert got.get(i, []) == [(p, label, n, t, x) for p in sorted(want) for n, (p, label, t, x) in enumerate(want[p], 1)], f
    assert not {900, 901} & set(got)


def test_page_lines_move_nowhere(spark):
    p = "<PcGts><Page><ReadingOrder><OrderedGroup><RegionRef regionRef='b'/><RegionRef regionRef='a'/></OrderedGroup></ReadingOrder>" + "".join(f"<TextRegion id='{i}'><TextLine><TextEquiv index='1'><Unicode>x</Unicode></TextEquiv><TextEquiv index=' 0 '><Unicode>{i} &amp;<!-- c --> <![CDATA[<t>]]></Unicode></TextEquiv></TextLine></TextRegion>" for i in "abc") + "</Page></PcGts>"
    lines = X.page_lines(spark.createDataFrame([(1, p), (2, p + "x"), (3, p.replace("Unicode", "pc:Unicode"))], "path int, content string").coalesce(1))
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, lines.collect())) == [(i, 1, n, f"{c} & <t>") for i in (1, 3) for n, c in enumerate("bac", 1)]
