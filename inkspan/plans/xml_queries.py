"""Queries over ALTO and PAGE files that are made from the texts of the documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.sources import xml_trees as trees


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _alto(spark, d):
    """A file per document: two pages of its lines, words as strings, a hyphen after every third line, every fifth file
    with a document type, every seventh with a tag too many."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    string = lambda w: F.concat(F.lit('<String CONTENT="'), _escaped(w), F.lit('" WC="0.9"/><SP/>'))

    def line(x, i):
        box = F.concat(F.lit('<TextLine ID="l" HPOS="'), i * 10, F.lit('" VPOS="'), i * 20, F.lit('.5" WIDTH="'), F.length(x), F.lit('" HEIGHT=\'10\'>\n'))
        return F.concat(box, F.array_join(F.transform(F.split(x, " "), string), ""), F.when(i % 3 == 0, "<HYP CONTENT='-'/>").otherwise(""), F.lit("</TextLine>"))

    lines = F.transform(F.split("text", "\n"), line)
    half = F.ceil(F.size(lines) / 2).cast("int")
    page = lambda some, head: F.concat(F.lit(f"<Page {head}><!-- <TextLine> --><PrintSpace><TextBlock>"), F.array_join(some, "\n"), F.lit("</TextBlock></PrintSpace></Page>"))
    head = F.when(F.col("doc_id") % 5 == 0, "<!DOCTYPE alto [<!ENTITY a 'b'>]>").otherwise("<?xml version='1.0'?>")
    content = F.concat(head, F.lit('<alto xmlns="x:y"><Description/><Layout>'), page(F.slice(lines, F.lit(1), half), 'PHYSICAL_IMG_NR="7"'), page(F.slice(lines, half + 1, F.size(lines)), 'ID="p&#50;" PHYSICAL_IMG_NR=""'),
                       F.when(F.col("doc_id") % 7 == 0, "</x>").otherwise(""), F.lit("</Layout></alto>\n"))
    return docs.select(F.col("doc_id").alias("path"), content.alias("content"))


def _page(spark, d):
    """A file per document: a region per line, by id in a reversed reading order with a nested group (even ids), in no
    reading order, or as cells of a table whose places are shuffled (every fifth id)."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").withColumn("ls", F.split("text", "\n"))
    n = F.size("ls")
    equiv = lambda x, i: F.concat(F.lit(f'<TextEquiv index="{i}"><Unicode>'), _escaped(x), F.lit("</Unicode></TextEquiv>"))
    words = lambda x: F.array_join(F.transform(F.split(x, " "), lambda w: F.concat(F.lit("<Word>"), equiv(w, 0), F.lit("</Word>"))), "")
    line = lambda x, i: F.concat(F.lit("<TextLine><Coords points='1,1'/>"), F.when(i % 4 == 3, words(x)).otherwise(F.concat(equiv(F.lit("second"), 2), equiv(x, 1))), F.lit("</TextLine>"))
    region = lambda x, i: F.concat(F.lit('<TextRegion id="r'), i, F.lit('">'), line(x, i), F.lit("</TextRegion>"))
    cell = lambda x, i: F.concat(F.lit('<TableCell row="'), (i * 7) % 5, F.lit('" col="'), i, F.lit('">'), line(x, i), F.lit("</TableCell>"))
    ref = lambda x, i: F.concat(F.lit('<RegionRefIndexed index="'), n - i, F.lit('" regionRef="r'), i, F.lit('"/>'))
    refs = F.transform("ls", ref)
    order = F.concat(F.lit('<ReadingOrder><OrderedGroup id="g">'), F.array_join(F.slice(refs, F.lit(1), F.lit(2)), ""), F.lit('<OrderedGroupIndexed index="1">'), F.array_join(F.slice(refs, F.lit(3), F.greatest(n - 3, F.lit(0))), ""), F.lit("</OrderedGroupIndexed></OrderedGroup></ReadingOrder>"))
    body = F.when(F.col("doc_id") % 5 == 4, F.concat(F.lit("<TableRegion id='t'>"), F.array_join(F.transform("ls", cell), ""), F.lit("</TableRegion>"))).otherwise(F.concat(F.when(F.col("doc_id") % 2 == 0, order).otherwise(""), F.array_join(F.transform("ls", region), "")))
    return docs.select(F.col("doc_id").alias("path"), F.concat(F.lit('<pc:PcGts xmlns:pc="u"><Page imageFilename="a/b.png">'), body, F.lit("</Page></pc:PcGts>")).alias("content"))


QUERIES = {"alto_lines": lambda s, d: trees.alto_lines(_alto(s, d)), "page_xml_lines": lambda s, d: trees.page_lines(_page(s, d))}

_LINED = "lined as (select doc_id as path, text, string_split(text, chr(10)) as ls from documents where text is not null), l as (select path, len(ls) as n, unnest(ls) as t, generate_subscripts(ls, 1) - 1 as i from lined)"
ORACLES = {
    "alto_lines": f"""with {_LINED}, w as (select *, string_split(t, ' ') as ws, ceil(n / 2)::int as half from l where path % 5 <> 0 and path % 7 <> 0),
h as (select *, case when i % 3 = 0 then list_concat(ws[:-2], [ws[-1] || '-']) else ws end as parts from w)
select path, case when i < half then 1 else 2 end as page, case when i < half then '7' else 'p2' end as label, cast(case when i < half then i + 1 else i + 1 - half end as integer) as line, array_to_string(list_filter(parts, lambda x: x <> ''), ' ') as text,
  (i * 10)::double as x0, i * 20 + 0.5::double as y0, (i * 10 + length(t))::double as x1, i * 20 + 10.5::double as y1 from h""",
    "page_xml_lines": f"""with {_LINED}, w as (select *, case when i % 4 = 3 or t = '' then array_to_string(list_filter(string_split(t, ' '), lambda x: x <> ''), ' ') else t end as said from l),
-- the first two are named by number behind the group, which has number 1, and the last one is not named at all
o as (select *, case when path % 5 = 4 then (i * 7) % 5 when path % 2 = 1 then 0 when i < 2 and n - i <= 1 then case when n - i = 1 then 1 else 0 end when i < 2 then n - i when i < n - 1 then 1 else 1000000 end as a,
  case when path % 5 = 4 or path % 2 = 1 then i when i < 2 then 0 when i < n - 1 then n - i else i end as b from w)
select path, 1 as page, cast(row_number() over (partition by path order by a, b, i) as integer) as line, said as text from o""",
}
