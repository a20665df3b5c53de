"""Queries over the documents' texts as files of many kinds and names, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.sources import sniff

_NAMES = (".txt", ".md", "", ".json", ".png", ".html")
_MAIL, _CUE = "From: a@b.cz\r\nTo: c\r\n d\r\n", "1\n00:00:01,000 --> 00:00:02,000\n"


def _files(spark, d):
    """A file per document: prose, JSON, JSON Lines, broken JSON, ALTO, HTML and hOCR, mail, subtitles, a word table, TEI in
    UTF-16, PDF and an image, under six extensions each."""
    t, k = F.col("text"), F.col("doc_id") % 12
    quoted = F.regexp_replace(F.to_json(F.array(t)), r"^\[|\]$", "")
    text = (F.when(k == 0, t).when(k == 1, F.concat(F.lit('{"a": '), quoted, F.lit("}"))).when(k == 2, F.concat(F.lit('{"a": '), quoted, F.lit('}\n["x"]\n"y"'))).when(k == 3, F.concat(F.lit("{"), t)).when(k == 4, F.concat(F.lit("<?xml version='1.0'?>\n<!-- "), F.md5(t), F.lit(" --><x:alto "), t))
            .when(k == 5, F.concat(F.lit("<html class='"), F.when(F.col("lang") == "en", "ocr_page").otherwise("x"), F.lit("'>"), t)).when(k == 6, F.concat(F.lit(_MAIL), F.when(F.col("doc_id") % 5 == 0, "Subject: x\r\n\r\n").otherwise("Message-ID: x\r\n\r\n"), t)).when(k == 7, F.concat(F.lit(_CUE), t))
            .when(k == 8, F.concat(F.lit(sniff.WORD_TABLE.upper() + "\r\n"), t)).when(k == 9, F.concat(F.lit("<TEI>"), t)).when(k == 10, F.concat(F.lit("A %PDF-1.4"), t)).otherwise(t))
    data = F.when(k == 9, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).when(k == 11, F.concat(F.unhex(F.lit("89504E470D0A1A0A")), text.cast("binary"))).otherwise(text.cast("binary"))
    name = F.concat(F.lit("f"), F.element_at(F.array(*map(F.lit, _NAMES)), F.floor(F.col("doc_id") / 12 % 6).cast("int") + 1))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", name.alias("name"), data.alias("content"))


QUERIES = {"sniffed_kinds": lambda s, d: sniff.sniffed(_files(s, d), "doc_id")}


def _in(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


ORACLES = {
    "sniffed_kinds": rf"""with d as (select doc_id, doc_id % 12 as k, text, lang, ['.txt', '.md', '', '.json', '.png', '.html'][(doc_id // 12) % 6 + 1] as e from documents),
f as (select doc_id, k, e, case k when 1 then '{{"a": ' || to_json(text) || '}}' when 2 then '{{"a": ' || to_json(text) || '}}' || chr(10) || '["x"]' || chr(10) || '"y"' when 3 then '{{' || text when 4 then '<?xml version=''1.0''?>' || chr(10) || '<!-- ' || md5(text) || ' --><x:alto ' || text
  when 5 then '<html class=''' || case when lang = 'en' then 'ocr_page' else 'x' end || '''>' || text when 6 then replace('From: a@b.cz~To: c~ d~', '~', chr(13) || chr(10)) || case when doc_id % 5 = 0 then 'Subject: x' else 'Message-ID: x' end || chr(13) || chr(10) || chr(13) || chr(10) || text
  when 7 then '1' || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || text when 8 then upper('{sniff.WORD_TABLE}') || chr(13) || chr(10) || text when 9 then '<TEI>' || text when 10 then 'A %PDF-1.4' || text when 11 then chr(137) || 'PNG' || text else text end as s from d),
h as (select *, ltrim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as p, lower(split_part(replace(s, chr(13), ''), chr(10), 1)) as first, split_part(replace(s, chr(13), ''), chr(10) || chr(10), 1) as header,
  length(regexp_replace(s, '[^\x01-\x08\x0e-\x1a\x1c-\x1f]', '', 'g')) > 0.1 * strlen(s) as bin, lower(regexp_extract(regexp_replace(s, '^(<\?[^>]*\?>|\s|<!--.*?-->)*', ''), '^<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)[\s/>]', 1)) as root from f),
r as (select *, case when s is null then 'unreadable' when s = '' then 'empty_file' when contains(left(s, 1024), '%PDF-') and (e not in {_in(('.txt', '.md', '.json', '.html'))} or bin) then '=pdf' when starts_with(s, chr(137) || 'PNG') then 'image_needs_ocr' when starts_with(p, '{{\rtf') then '=rtf' when bin then 'binary_content'
  when starts_with(p, '<') then '=' || case root when 'alto' then 'alto' when 'tei' then 'tei' when 'html' then case when regexp_matches(s, '(?i)ocr_page|ocrx?_line|ocrx_word') then 'hocr' else 'html' end else case when e = '.html' then 'html' when e = '.md' then 'md' when root = '' then 'txt' else 'xml' end end
  when first = '{sniff.WORD_TABLE}' then '=tesseract-tsv' when e = '.json' then '=json' when e = '.md' then '=md' when regexp_matches(header, '^From: ') and contains(s, chr(13) || chr(10) || chr(13) || chr(10)) and contains(lower(header), chr(10) || 'message-id:') then '=eml'
  when regexp_matches(p, '^\s*[0-9]+ *\n\s*[0-9]+:[0-9]{{2}}:[0-9]{{2}}[,.][0-9]{{1,3}}\s*-->') then '=srt' when starts_with(p, '{{') or starts_with(p, '[') then case when json_valid(s) then '=json' when list_bool_and(list_transform(list_filter(string_split(s, chr(10)), lambda x: trim(x) <> ''), lambda x: json_valid(x) and regexp_matches(x, '^\s*[\[{{"]'))) then '=jsonl' else '=txt' end
  else '=txt' end as got from h),
w as (select doc_id, e, case when got = '=txt' and e = '.png' then null when starts_with(got, '=') then got[2:] end as kind, case when got = '=txt' and e = '.png' then 'image_needs_ocr' when not starts_with(got, '=') then got end as reason from r),
x(k, xs) as (values {', '.join(f"('{k}', [{', '.join(repr(x) for x in v)}])" for k, v in sniff.EXTENSIONS.items())})
select doc_id, kind, reason, null::varchar as wrapper, case when kind is not null and e <> '' and not list_contains(xs, e) then 'extension ' || e || ' but content is ' || kind end as note from w left join x on k = kind""",
}
