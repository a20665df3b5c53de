"""Queries over the documents' texts as bytes of several encodings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.functions import bytes as raw

#: Letters of the texts that the first code page has, and what stands for all others beyond ASCII there.
_LATIN, _OWN, _ = raw._page_letters("cp1250")


def _files(spark, d):
    """Bytes per document: UTF-8 with and without a mark, UTF-16 of both orders with and without one, the first code page,
    zeros (ahead of the text, as only the head of a file is looked at), and a byte that no code page but the second has."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    t, k = F.col("text"), F.col("doc_id") % 9
    mark = lambda h: F.unhex(F.lit(h))
    paged = F.encode(F.translate(F.regexp_replace(t, f"[^\\x00-\\x7F{_OWN}]", "?"), _OWN, _LATIN), "ISO-8859-1")
    data = (F.when(k == 0, F.concat(mark("EFBBBF"), t.cast("binary"))).when(k == 1, F.concat(mark("FFFE"), F.encode(t, "UTF-16LE"))).when(k == 2, F.concat(mark("FEFF"), F.encode(t, "UTF-16BE")))
            .when(k == 3, F.encode(t, "UTF-16LE")).when(k == 4, F.encode(t, "UTF-16BE")).when(k == 5, F.concat(paged, mark("E8"))).when(k == 6, F.concat(mark("0000"), F.unhex(F.repeat(F.lit("00"), F.length(t).cast("int"))), t.cast("binary"))).when(k == 7, F.concat(mark("81E8"), paged)).otherwise(t.cast("binary")))
    return docs.select("doc_id", data.alias("data"))


QUERIES = {"decoded_bytes": lambda s, d: _files(s, d).select("doc_id", raw.decode_bytes(F.col("data")).alias("r")).select("doc_id", "r.encoding", "r.flags", "r.status", F.when(F.col("doc_id") % 9 != 7, F.md5(F.col("r.text"))).alias("digest"))}

_PAGED = f"regexp_replace(text, '[^\\x00-\\x7F{_OWN}]', '?', 'g')"
ORACLES = {
    "decoded_bytes": f"""with t as (select *, doc_id % 9 as k from documents), e as (select *, case when text is null then null when k in (1, 3) and not (k = 3 and text = '') then 'utf-16-le' when k in (2, 4) and not (k = 4 and text = '') then 'utf-16-be' when k = 5 then 'cp1250' when k = 7 then 'iso8859_2' when k <> 6 then 'utf-8' end as encoding from t)
select doc_id, encoding, case when text is null or k = 6 then case when text is not null then '' end when k in (3, 4) then 'utf16_without_bom' when k in (5, 7) then 'encoding_fallback' else '' end as flags,
  case when text is null then null when k = 6 then 'binary_content' else 'ok' end as status, case when k in (6, 7) then null when k = 5 then md5({_PAGED} || 'č') else md5(text) end as digest from e""",
}
