"""Queries that write the documents' lines as files, one per document, and read them back, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.functions.staging import shared_folder
from inkspan.sinks import renderings, text_files
from inkspan.sources.text import text_lines


def _through_files(render, suffix):
    def query(spark, d):
        lines = text_lines(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
        path = shared_folder(spark)
        text_files.write_texts(render(lines.withColumn("name", F.concat(F.lit("documents/"), "doc_id"))), path, suffix=suffix)
        back = text_files.read_texts(spark, path, suffix)
        return back.select(F.regexp_extract("file", "/(.*)$", 1).cast("long").alias("doc_id"), F.length("content").alias("chars"), F.md5("content").alias("digest"))

    return query


QUERIES = {
    "plain_text_files": _through_files(lambda x: renderings.plain_parts(x, "name"), ".txt"),
    "markdown_files": _through_files(lambda x: renderings.markdown_parts(x, "name", title="name"), ".md"),
    "json_files": _through_files(lambda x: renderings.json_parts(x, "name"), ".json"),
}

_W = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_END = f"select doc_id, length(c) as chars, md5(c) as digest from (select doc_id, regexp_replace(body, '^[{_W}]+|[{_W}]+$', '', 'g') || chr(10) as c from f)"


def _oracles():
    from inkspan.plans.registry import _LINES

    said = f"said as (select doc_id, page, line, regexp_replace(text, '^[{_W}]+|[{_W}]+$', '', 'g') as t, text from lines)"
    shown = "replace(replace(t, '<!--', '&lt;!--'), '-->', '--&gt;')"
    return {
        "plain_text_files": f"with {_LINES}, {said}, p as (select doc_id, page, coalesce(string_agg(t, chr(10) order by line) filter (t <> ''), '') as t, count(*) filter (t <> '') as n from said group by all), f as (select doc_id, string_agg(case when page > 1 then chr(10) || case when n > 0 then chr(10) else '' end else '' end || t, '' order by page) as body from p group by doc_id) {_END}",
        "markdown_files": f"with {_LINES}, {said}, p as (select doc_id, page, string_agg(case when starts_with(t, '#') then chr(92) else '' end || {shown}, chr(10) order by line) filter (t <> '') as t from said group by all), f as (select doc_id, '# documents/' || doc_id || chr(10) || string_agg(chr(10) || '## Page ' || page || chr(10) || coalesce(chr(10) || t, ''), chr(10) order by page) as body from p group by doc_id) {_END}",
        "json_files": f"with {_LINES}, p as (select doc_id, page, '{{\"page\": ' || page || ', \"lines\": [' || string_agg(to_json(text), ', ' order by line) || ']}}' as t from lines group by doc_id, page), f as (select doc_id, '{{\"file\": \"documents/' || doc_id || '\", \"pages\": [' || string_agg(t, ', ' order by page) || ']}}' as body from p group by doc_id) select doc_id, length(body) + 1 as chars, md5(body || chr(10)) as digest from f",
    }
