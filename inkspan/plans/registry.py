"""Query functions over the test tables and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.functions import decode, lines as kinds
from inkspan.operators import evaluation, layout, quality, records, routing
from inkspan.plans import alignment_queries, bytes_queries, content_queries, geometry_queries, provenance_queries, record_queries, sink_queries, sniff_queries, spatial_queries, table_queries, validation_queries, xml_queries
from inkspan.sources import text as sources
from inkspan.sources.text import text_lines


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark, d, *cols):
    return text_lines(_t(spark, d, "documents").select("doc_id", "text"))


def _tiered(spark, d):
    summary = quality.line_summary(quality.scored_lines(_lines(spark, d)), ["doc_id"])
    return summary.withColumn("tier", quality.tier())


def tier_grouping_sets(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang").join(_tiered(spark, d).select("doc_id", "tier"), "doc_id", "left")
    labelled = docs.join(_t(spark, d, "labels"), "doc_id", "left")
    out = labelled.groupingSets([["lang", "tier"], ["lang"]], "lang", "tier").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))
    return out.select("lang", "tier", "n", "good")


def _patched(spark, d):
    """Customers and changes to them: some twice, some of unknown customers, some without a balance."""
    c = _t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 2 == 0, 1000000).otherwise(0)).alias("c_custkey"), "c_name",
                                              F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(1).alias("seq"))
    again = new.where("c_custkey % 7 = 0").select("c_custkey", "c_name", (F.col("c_acctbal") + 5).alias("c_acctbal"), F.lit(2).alias("seq"))
    return c, new.unionByName(again)


def _upsert(spark, d):
    c, new = _patched(spark, d)
    return records.keyed_upsert(c, new, "c_custkey", ["c_acctbal"], "seq")


def _diff(spark, d):
    c, new = _patched(spark, d)
    return records.record_diff(c, new.where("seq = 1").drop("seq"), "c_custkey", ["c_name", "c_acctbal"])


def _block(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "event_type")
    return records.replace_block(e, e.where("user_id % 4 = 1 and event_type = 'click'").withColumn("event_type", F.lit("kept")), "user_id")


def _fold(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return records.fold_records(o, "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def _distinct(spark, d):
    return records.ordered_distinct(_t(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", "event_id")


def _prf(spark, d):
    kind = F.when(F.length("w") > 5, "long").otherwise("short")
    b = _t(spark, d, "benchmark")
    ref = b.select("item_id", F.explode(F.split("text", " ")).alias("w")).withColumn("kind", kind)
    hyp = b.select("item_id", F.explode(F.split(F.replace("text", F.lit("the"), F.lit("THE ")), " ")).alias("w")).withColumn("kind", kind)
    return evaluation.multiset_prf(ref, hyp, "item_id", "kind", "w")


def _pairs(spark, d):
    return _t(spark, d, "benchmark").select("item_id", F.col("text").alias("ref"), F.replace("text", F.lit("the"), F.lit("teh ")).alias("hyp"))


def _cer(spark, d):
    return evaluation.score_texts(_pairs(spark, d), "ref", "hyp").select("item_id", "cer", "ned")


def _cer_all(spark, d):
    b = _t(spark, d, "benchmark").select("item_id", F.col("text").alias("ref"), F.replace("text", F.lit("the"), F.lit("teh")).alias("hyp"))
    return evaluation.score_texts(b, "ref", "hyp").select("item_id", "cer", "ned")


def _models(spark, d):
    gold = _pairs(spark, d).select("item_id", "ref", F.concat(F.lit("t"), F.col("item_id") % 3).alias("tier"))
    said = [_pairs(spark, d).select(F.lit("a").alias("model"), "item_id", "hyp"), _pairs(spark, d).where("item_id % 3 <> 1").select(F.lit("b").alias("model"), "item_id", F.translate("ref", "et", "ET").alias("hyp"))]
    out = evaluation.score_models(gold, said[0].unionByName(said[1]), ["a", "b", "c"], ["item_id"])
    return _rounded(out, "cer", "wer", "ned")


def _confident(spark, d):
    return _t(spark, d, "events").select((F.abs("event_id") * 7919 % 1000 / 1000.0).cast("double").alias("c"), (F.col("value") > 10).alias("ok"), "event_type")


def _brier(spark, d):
    p = _confident(spark, d).select(F.create_map(F.lit("click"), F.col("c"), F.lit("view"), 1 - F.col("c")).alias("p"), "event_type")
    return _rounded(evaluation.brier_score(p, "p", "event_type"), "brier")


def _mcnemar(spark, d):
    e = _t(spark, d, "labels").select((F.col("quality") == 1).alias("a"), (F.col("doc_id") % 3 == 0).alias("b"))
    return _rounded(evaluation.mcnemar_exact(e, "a", "b"), "p")


def _curve(spark, d):
    return evaluation.coverage_curve(_confident(spark, d), "c", "ok")


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


def _split_counts(spark, d):
    return quality.splits(quality.equal_tier_sample(_tiered(spark, d), "doc_id", 300)).select("doc_id", "tier", "pick", "split")


def _judged_pages(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang")
    scored = quality.scored_lines(_lines(spark, d)).join(docs, "doc_id")
    return quality.page_quality(scored, ["doc_id", "page"], kinds.line_kind(F.col("text")) == "prose", "lang", 9)


def _decoded(spark, d):
    return routing.decoded_lines(_lines(spark, d), ["doc_id", "page"])


def _routed(spark, d):
    """Documents as pages of their source, with kinds of pages and text layers that go round by id."""
    docs = _t(spark, d, "documents").select("source", "doc_id", F.col("text").isNull().alias("bare"))
    pages = docs.join(_judged_pages(spark, d).where("page = 1"), "doc_id", "left").join(routing.page_decode(_decoded(spark, d), ["doc_id"]).select("doc_id", "needs_ocr"), "doc_id", "left")
    kind = F.element_at(F.array(*map(F.lit, ["TEXT", "LINE_HW", "PHOTO", "TEXT_HW", "OTHER", "DRAW_L", "TEXT_T"])), (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))
    layer = F.when(F.col("bare"), "blank").when(F.col("needs_ocr"), "garbled").when(F.col("doc_id") % 11 == 0, "none").when(F.col("doc_id") % 13 == 0, "ocr").otherwise("digital")
    pages = pages.withColumns({"text_layer": layer, "category": F.when(F.col("doc_id") % 5 != 0, kind), "drew": F.col("doc_id") % 2 == 0, "furniture_only": F.col("doc_id") % 17 == 0, "needs_atr": layer.isin("garbled", "ocr", "none")})
    return pages.withColumn("route", routing.page_route())


def _units(spark, d):
    from pyspark.sql import Window

    src = _t(spark, d, "documents").select("doc_id", "source")
    page = (F.col("doc_id") * 1000 + F.col("page")).alias("page")
    u = _lines(spark, d).join(src, "doc_id").select("source", page, (F.col("line") - 1.0).alias("top"), F.col("line").cast("double").alias("bottom"), F.when(F.col("line") == 1, F.concat(F.lit("Head  of "), "doc_id")).otherwise(F.col("text")).alias("text"), F.lit(False).alias("in_table"))
    return u.withColumn("height", F.greatest(F.lit(10), F.count("*").over(Window.partitionBy("page"))).cast("double"))


def _furniture(spark, d):
    u = layout.furniture(_units(spark, d), ["source"], "page").where("region is not null")
    return u.groupBy("source", "region").agg(F.count("*").alias("n"), F.count_distinct("page").alias("pages"))


def _paragraphs(spark, d):
    top = 12.0 * F.col("line") + F.when(F.col("line") % 7 == 0, 3).otherwise(0) + 30 * F.floor(F.col("line") / 5)
    geometry = _lines(spark, d).select("doc_id", "page", "line", top.alias("top"), (top + 10).alias("bottom"), F.floor(F.col("line") / 40).alias("col"), F.lit(None).cast("string").alias("region"), F.when(F.col("line") == 1, 1).alias("heading"))
    return layout.paragraphs(geometry, ["doc_id", "page"], "line").select("doc_id", "page", "line", "paragraph")


def _boxes(spark, d):
    k = F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17
    x0, y0 = F.pmod(k, F.lit(80)).cast("double"), F.pmod(k * 7, F.lit(70)).cast("double")
    frame = {"fx0": F.lit(0.0), "fy0": F.lit(0.0), "fx1": F.lit(100.0), "fy1": F.lit(100.0)}
    return _t(spark, d, "lineitem").select("l_orderkey", x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity").cast("double")).alias("x1"), (y0 + 10 + F.col("l_linenumber")).alias("y1")).withColumns(frame)


def _customers(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("path"), "c_name", "c_mktsegment", "c_nationkey")


def _csv(spark, d):
    rows = F.concat_ws("\n", F.lit("name;segment;key"), F.concat(F.lit('"'), F.col("c_name"), F.lit(';x";  ;'), F.col("c_nationkey")), F.concat(F.lit(";"), F.col("c_mktsegment"), F.lit(";")), F.lit(";;"))
    return sources.csv_lines(_customers(spark, d).select("path", rows.alias("content")))


def _json(spark, d):
    value = F.to_json(F.struct(F.col("c_name").alias("b"), F.array(F.struct(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"))).alias("a"), F.lit("end").alias("z")))
    return sources.json_lines(_customers(spark, d).select("path", value.alias("content")))


def _jsonl(spark, d):
    content = F.concat_ws("\n", F.to_json(F.struct(F.col("c_name").alias("b"))), F.lit("{bad"), F.lit("[1, 2]"), F.to_json(F.struct(F.col("c_mktsegment").alias("s"), F.lit(" x ").alias("t"))))
    return sources.jsonl_pages(_customers(spark, d).select("path", content.alias("content")))


QUERIES = {
    "doc_lines": _lines,
    "line_kind_counts": lambda s, d: quality.scored_lines(_lines(s, d)).groupBy("categ").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")),
    "line_kinds": lambda s, d: _lines(s, d).select("doc_id", "page", "line", kinds.line_kind(F.col("text"), F.col("line") % 9 == 0).alias("kind")),
    "doc_quality_summary": lambda s, d: quality.line_summary(quality.scored_lines(_lines(s, d)), ["doc_id"]).withColumn("avg_quality_score", F.round("avg_quality_score", 9)),
    "page_quality": _judged_pages,
    "document_tier": lambda s, d: _tiered(s, d).select("doc_id", "tier"),
    "tier_grouping_sets": tier_grouping_sets,
    "split_assignment": _split_counts,
    "decoded_lines": lambda s, d: _decoded(s, d).select("doc_id", "page", "line", "decode_score", "decode"),
    "page_decode": lambda s, d: routing.page_decode(_decoded(s, d), ["doc_id", "page"], 9),
    "page_route": lambda s, d: _routed(s, d).select("doc_id", "text_layer", "category", "route"),
    "document_route": lambda s, d: routing.document_summary(_routed(s, d), ["source"], "doc_id").withColumns({c: F.array_join(c, ",") for c in ("needs_atr_pages", "reacquire_pages")}),
    "furniture_lines": _furniture,
    "paragraph_groups": _paragraphs,
    "box_union": lambda s, d: layout.box_union(_boxes(s, d), ["l_orderkey"]),
    "union_share": lambda s, d: layout.union_share(_boxes(s, d), ["l_orderkey"]),
    "cer_ned": _cer,
    "cer_ned_all": _cer_all,
    "model_tier_scores": _models,
    "multiset_prf": _prf,
    "brier_score": _brier,
    "mcnemar_exact": _mcnemar,
    "confidence_lanes": lambda s, d: _confident(s, d).groupBy(routing.lane(F.col("c"), 0.8, 0.3).alias("lane")).agg(F.count("*").alias("n")),
    "reliability_bins": lambda s, d: evaluation.reliability_bins(_confident(s, d), "c", "ok").select("bin", "n", "hits"),
    "ece": lambda s, d: _rounded(evaluation.expected_calibration_error(_confident(s, d), "c", "ok"), "ece"),
    "coverage_curve": lambda s, d: _rounded(_curve(s, d), "coverage", "error"),
    "pick_threshold": lambda s, d: _rounded(evaluation.pick_threshold(_curve(s, d), 0.5), "coverage", "error"),
    "keyed_upsert": _upsert,
    "record_diff": _diff,
    "replace_block": _block,
    "fold_records": _fold,
    "ordered_distinct": _distinct,
    "anti_referential": lambda s, d: records.unreferenced(_t(s, d, "documents").select("doc_id", "lang"), _t(s, d, "labels"), "doc_id"),
    "consecutive_ranges": lambda s, d: records.consecutive_ranges(_t(s, d, "labels"), "doc_id", ["quality"]),
    "topk_per_group": lambda s, d: records.top_k(_t(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 3),
    "csv_lines": _csv,
    "json_lines": _json,
    "jsonl_pages": _jsonl,
}

_WHITE = kinds.WHITE
_LINES = r"""clean as (select doc_id, regexp_replace(regexp_replace(text, '\r\n|[\r\x{0b}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '(\f\s*)+\z', '') as text from documents where text is not null),
pages as (select doc_id, generate_subscripts(string_split(text, chr(12)), 1) as page, unnest(string_split(text, chr(12))) as t from clean),
trimmed as (select doc_id, page, case when ends_with(t, chr(10)) then left(t, length(t) - 1) else t end as t from pages),
lines as (select doc_id, page, generate_subscripts(string_split(t, chr(10)), 1) as line, unnest(string_split(t, chr(10))) as text from trimmed)"""
_SCORED = _LINES + r""",
shares as (select *, length(regexp_replace(text, '[^\p{L}]', '', 'g')) as letters, length(regexp_replace(text, '\s', '', 'g')) as solid from lines),
scored as (select *, case when solid = 0 then 'Empty' when letters / solid >= 0.7 then 'Clear' when letters / solid >= 0.4 then 'Noisy' when letters > 0 then 'Trash' else 'Non-text' end as categ from shares),
graded as (select *, case categ when 'Clear' then 0.9 when 'Noisy' then 0.6 when 'Trash' then 0.2 else 0.0 end::double as quality_score from scored)"""
_SUMMARY = _SCORED + """,
summary as (select doc_id, count(*) as num_lines, count(*) filter (categ = 'Clear') as clear, count(*) filter (categ = 'Noisy') as noisy, count(*) filter (categ = 'Trash') as trash,
  count(*) filter (categ = 'Non-text') as non_text, count(*) filter (categ = 'Empty') as empty, avg(quality_score) filter (categ in ('Clear', 'Noisy')) as avg_quality_score from graded group by doc_id)"""
_TIERED = _SUMMARY + """,
tiered as (select *, case when avg_quality_score is null then 'text_poor' when avg_quality_score >= 0.85 and (clear + noisy) / num_lines >= 0.5 then 'clean' when avg_quality_score >= 0.6 then 'degraded' else 'hard' end as tier from summary)"""

_CURVE = """e as (select (abs(event_id) * 7919 % 1000 / 1000.0)::double as c, coalesce(value > 10, false) as ok from events),
runs as (select distinct c as threshold, count(*) over (order by c desc) as k, count(*) filter (not ok) over (order by c desc) as bad, count(*) over () as n from e),
curve as (select threshold, round(k / n, 9)::double as coverage, round(bad / k, 9)::double as error, bad / k as e from runs)"""

_KINDS = rf"""shape as (select *, regexp_replace(text, '^{_WHITE}+|{_WHITE}+$', '', 'g') as s, length(regexp_replace(text, '{_WHITE}', '', 'g')) as dense, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) as alpha from lines),
kinds as (select *, case when length(s) < 20 then 'short' when alpha < 0.5 * dense then 'few letters' when regexp_matches(s, '(\.\s?){{4,}}|…{{2,}}|_{{4,}}') then 'dot leaders' else 'prose' end as kind from shape)"""
_QUALITY = _SCORED + ",\n" + _KINDS + """,
k as (select g.*, kind from graded g join kinds using (doc_id, page, line)),
pq as (select doc_id, page, round(avg(quality_score) filter (categ in ('Clear', 'Noisy', 'Trash')), 9) as score, count(*) filter (categ = 'Clear') as c, count(*) filter (categ = 'Noisy') as n, count(*) filter (categ = 'Trash') as trash,
  count(*) filter (categ in ('Clear', 'Noisy', 'Trash')) as lines_scored, count(*) filter (categ in ('Clear', 'Noisy', 'Trash') and kind = 'prose') as prose_scored, count(*) filter (categ = 'Trash' and kind = 'prose') as prose_trash from k group by all),
quality as (select pq.doc_id, page, score, case when c + n + trash = 0 then null when c >= n and c >= trash then 'Clear' when n >= trash then 'Noisy' else 'Trash' end as band, lines_scored, trash, prose_scored, prose_trash,
  case when lines_scored > 0 and lang <> 'N/A' then lang end as lang from pq join documents using (doc_id))"""


def _chars(chars):
    return "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


_DECODED = rf"""r0 as (select *, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) as letters, length(regexp_replace(text, '{_chars("".join(decode.MISREADS))}', '', 'g')) as hits, length(regexp_replace(text, '{_WHITE}', '', 'g')) as chars,
  length(regexp_replace(regexp_replace(text, '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}]', '', 'g'), '[^\x{{fffd}}\p{{Cc}}\p{{Cf}}\p{{Co}}]', '', 'g')) as bad, regexp_matches(text, '{_chars(decode.WESTERN)[:-1]}\x{{00}}-\x{{7f}}]') as outside,
  length(regexp_replace(text, '{_chars(decode.FOREIGN)}', '', 'g')) > 0 as foreign_, length(regexp_replace(text, '{_chars(decode.SHARED)}', '', 'g')) > 0 as shared_ from lines),
r1 as (select *, case when letters = 0 then 1.0::double else 1 - hits / letters end as s from r0),
r2 as (select *, (hits >= 2 or s < 0.9) and not outside and shared_ and not foreign_ as m, chars > 0 and bad > 0.15 * chars as u from r1),
decoded as (select doc_id, page, line, round(least(s, case when chars > 0 then 1 - bad / chars else 1 end), 4)::double as decode_score,
  case when m or u or (bool_or(m) over (partition by doc_id, page) and hits >= 1 and not outside and not foreign_) then 'garbled' end as decode from r2)"""
_ROUTED = _QUALITY + ",\n" + _DECODED + """,
garbled as (select doc_id, bool_or(decode = 'garbled') as g from decoded group by doc_id),
facts as (select source, d.doc_id, q.* exclude (doc_id, lang), case when text is null then 'blank' when g then 'garbled' when d.doc_id % 11 = 0 then 'none' when d.doc_id % 13 = 0 then 'ocr' else 'digital' end as text_layer,
  case when d.doc_id % 5 <> 0 then ['TEXT', 'LINE_HW', 'PHOTO', 'TEXT_HW', 'OTHER', 'DRAW_L', 'TEXT_T'][d.doc_id % 7 + 1] end as category, d.doc_id % 2 = 0 as drew, d.doc_id % 17 = 0 as alone
  from documents d left join (select * from quality where page = 1) q on q.doc_id = d.doc_id left join garbled on garbled.doc_id = d.doc_id),
kind as (select *, case category when 'TEXT' then 'ocr' when 'LINE_HW' then 'htr' when 'PHOTO' then 'none' when 'TEXT_HW' then 'htr' when 'DRAW_L' then 'ocr' when 'TEXT_T' then 'ocr' end as by_kind from facts),
routed as (select *, case when text_layer = 'blank' then 'none'
  when text_layer = 'digital' then case when alone and by_kind in ('ocr', 'htr') then by_kind when case when prose_scored is null then trash / nullif(lines_scored, 0) when prose_scored >= 5 then prose_trash / prose_scored end > 0.5 then 'ocr' else 'nlp' end
  when text_layer = 'none' and not drew and category is null then 'none' else coalesce(by_kind, 'ocr') end as route from kind)"""
_PATCH = """n0 as (select c_custkey + case when c_custkey % 2 = 0 then 1000000 else 0 end as c_custkey, c_name, case when c_custkey % 5 <> 0 then c_acctbal + 1 end as c_acctbal, 1 as seq from customer where c_custkey % 3 = 0),
n as (select * from n0 union all select c_custkey, c_name, c_acctbal + 5, 2 from n0 where c_custkey % 7 = 0)"""
_BYTES = "array_to_string(list_transform({}, lambda c: chr(list_position(a, c)::integer)), '')"
_BOXES = "b as (select l_orderkey, ((l_orderkey * 31 + l_linenumber * 17) % 80)::double as x0, ((l_orderkey * 31 + l_linenumber * 17) * 7 % 70)::double as y0, l_quantity::double as w, l_linenumber from lineitem), boxes as (select l_orderkey, x0, y0, x0 + w as x1, y0 + 10 + l_linenumber as y1 from b)"

def _normal(column):
    return rf"trim(regexp_replace(nfc_normalize(coalesce({column}, '')), '{_WHITE}+', ' ', 'g'))"


_PAIRS = "select item_id, text as ref, replace(text, 'the', 'teh ') as hyp from benchmark"


def _errors(rows):
    """Characters and words of an item get a byte of their own, as levenshtein counts bytes: up to 127 distinct ones."""
    r, h = _normal("ref"), _normal("hyp")
    return f"""e0 as (select * exclude (ref, hyp), {r} as r, {h} as h from ({rows})), e1 as (select *, list_distinct(string_split(r || h, '')) as a, string_split(r, ' ') as rw, string_split(h, ' ') as hw from e0),
e2 as (select *, levenshtein({_BYTES.format("string_split(r, '')")}, {_BYTES.format("string_split(h, '')")}) as d from e1), e3 as (select * replace (list_distinct(rw || hw) as a) from e2), e4 as (select *, levenshtein({_BYTES.format('rw')}, {_BYTES.format('hw')}) as wd from e3),
errors as (select *, case when r = '' then case when h = '' then 0.0 else 1.0 end else d / length(r) end::double as cer, case when r = '' then case when h = '' then 0.0 else 1.0 end else wd / len(rw) end::double as wer, coalesce(d / nullif(greatest(length(r), length(h)), 0), 0)::double as ned from e4)"""


ORACLES = {
    "doc_lines": f"with {_LINES} select doc_id, page, line, text from lines",
    "line_kind_counts": f"with {_SCORED} select categ, count(*) as n, count(distinct doc_id) as docs from scored group by categ",
    "doc_quality_summary": f"with {_SUMMARY} select * replace (round(avg_quality_score, 9) as avg_quality_score) from summary",
    "document_tier": f"with {_TIERED} select doc_id, tier from tiered",
    "tier_grouping_sets": f"with {_TIERED}, l as (select d.lang, t.tier, b.quality from documents d left join tiered t using (doc_id) left join labels b using (doc_id)) select lang, tier, count(*) as n, cast(sum(quality) as bigint) as good from l group by grouping sets ((lang, tier), (lang))",
    "split_assignment": f"with {_TIERED}, k as (select count(distinct tier) as k from tiered), r as (select doc_id, tier, row_number() over (partition by tier order by md5('42:' || doc_id), doc_id) as pick from tiered), p as (select r.* from r, k where pick <= greatest(1, 300 // k)), c as (select *, count(*) over (partition by tier) as n from p) select doc_id, tier, pick, case when pick <= round_even(n * 0.8, 0) then 'train' when pick <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) then 'dev' else 'test' end as split from c",
    "furniture_lines": rf"with {_LINES}, u as (select source, doc_id * 1000 + page as page, line - 1 as top, line as bottom, case when line = 1 then 'Head  of ' || doc_id else lines.text end as text, greatest(10, count(*) over (partition by doc_id, page)) as height from lines join documents using (doc_id)), b as (select *, case when bottom <= 0.1 * height then 'header' when top >= 0.9 * height then 'footer' end as band, regexp_replace(regexp_replace(lower(regexp_replace(text, '^{_WHITE}+|{_WHITE}+$', '', 'g')), '\s+', ' ', 'g'), '\d+', '#', 'g') as norm from u), p as (select source, count(distinct page) as pages from u group by source), o as (select source, band, norm from b join p using (source) where band is not null group by source, band, norm, pages having count(distinct page) >= 2 and count(distinct page) >= 0.5 * pages), m as (select b.* from b left join o on b.source is not distinct from o.source and b.band = o.band and b.norm = o.norm where b.band is not null and (o.norm is not null or regexp_matches(text, '{layout.PAGE_NUMBER}'))) select source, band as region, count(*) as n, count(distinct page) as pages from m group by source, band",
    "cer_ned": f"with {_errors(_PAIRS)} select item_id, cer, ned from errors",
    "cer_ned_all": f"""with {_errors("select item_id, text as ref, replace(text, 'the', 'teh') as hyp from benchmark")} select item_id, cer, ned from errors""",
    "multiset_prf": f"with a as (select item_id, unnest(string_split(text, ' ')) as w from benchmark), x as (select item_id, case when length(w) > 5 then 'long' else 'short' end as k, lower({_normal('w')}) as w, count(*) as a from a group by all), c as (select item_id, unnest(string_split(replace(text, 'the', 'THE '), ' ')) as w from benchmark), y as (select item_id, case when length(w) > 5 then 'long' else 'short' end as k, lower({_normal('w')}) as w, count(*) as b from c group by all), j as (select item_id, cast(sum(least(coalesce(a, 0), coalesce(b, 0))) as bigint) as tp, cast(coalesce(sum(a), 0) as bigint) as n_ref, cast(coalesce(sum(b), 0) as bigint) as n_hyp from x full join y using (item_id, k, w) group by item_id), s as (select *, coalesce(tp / nullif(n_hyp, 0), 0)::double as precision, coalesce(tp / nullif(n_ref, 0), 0)::double as recall from j) select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)::double as f1 from s",
    "reliability_bins": f"with {_CURVE} select cast(greatest(0, least(ceil(c * 10) - 1, 9)) as integer) as bin, count(*) as n, count(*) filter (ok) as hits from e group by 1",
    "ece": f"with {_CURVE}, b as (select greatest(0, least(ceil(c * 10) - 1, 9)) as bin, count(*) as n, count(*) filter (ok) as hits, avg(c) as m from e group by 1) select cast(sum(n) as bigint) as n, round(sum(abs(hits / n - m) * n) / sum(n), 9)::double as ece from b",
    "coverage_curve": f"with {_CURVE} select threshold, coverage, error from curve",
    "pick_threshold": f"with {_CURVE} select threshold, coverage, error from curve where e <= 0.5 order by threshold limit 1",
    "keyed_upsert": f"with {_PATCH}, p as (select c_custkey, arg_max({{'v': c_acctbal}}, seq) as x from n group by 1) select coalesce(b.c_custkey, p.c_custkey) as c_custkey, b.c_name, case when p.c_custkey is not null then p.x.v else b.c_acctbal end as c_acctbal from customer b full join p on b.c_custkey = p.c_custkey",
    "anti_referential": "select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
    "consecutive_ranges": "with d as (select distinct quality, doc_id from labels), g as (select *, doc_id - row_number() over (partition by quality order by doc_id) as g from d) select quality, min(doc_id) as first, max(doc_id) as last, count(*) as n from g group by quality, g",
    "topk_per_group": "select l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rank from lineitem) where rank <= 3",
    "line_kinds": f"with {_LINES}, {_KINDS} select doc_id, page, line, case when line % 9 = 0 then 'table' else kind end as kind from kinds",
    "page_quality": f"with {_QUALITY} select * from quality",
    "decoded_lines": f"with {_LINES}, {_DECODED} select * from decoded",
    "page_decode": f"with {_LINES}, {_DECODED} select doc_id, page, round(avg(decode_score), 9) as decode_score, count(*) as lines, count(*) filter (decode = 'garbled') as garbled, count(*) filter (decode = 'garbled') > 0 as needs_ocr from decoded group by all",
    "page_route": f"with {_ROUTED} select doc_id, text_layer, category, route from routed",
    "document_route": f"with {_ROUTED} select source, count(*) as pages, count(*) filter (route = 'nlp') as nlp, count(*) filter (route = 'ocr') as ocr, count(*) filter (route = 'htr') as htr, count(*) filter (route = 'none') as none, coalesce(string_agg(doc_id::varchar, ',' order by doc_id) filter (text_layer in ('garbled', 'ocr', 'none')), '') as needs_atr_pages, coalesce(string_agg(doc_id::varchar, ',' order by doc_id) filter (route in ('ocr', 'htr')), '') as reacquire_pages, case count(distinct route) filter (route <> 'none') when 0 then 'none' when 1 then max(route) filter (route <> 'none') else 'mixed' end as document_route from routed group by source",
    "paragraph_groups": f"with {_LINES}, g0 as (select doc_id, page, line, 12.0 * line + case when line % 7 = 0 then 3 else 0 end + 30 * (line // 5) as top, line // 40 as col, line = 1 as heading from lines), g1 as (select *, top + 10 as bottom, greatest(0, top - lag(top + 10) over w) as gap, row_number() over w = 1 as first, lag(col) over w as c0, lag(heading) over w as h0, lag(top) over w as t0 from g0 window w as (partition by doc_id, page order by line)), u as (select doc_id, page, list_sort(list(gap) filter (gap > 0)) as gs from g1 group by all), g2 as (select g1.*, not first and (coalesce(gap > 1.8 * gs[len(gs) // 4 + 1], false) or col <> c0 or heading <> h0 or top < t0 - 1) as opens from g1 join u using (doc_id, page)) select doc_id, page, line, cast(sum(opens::int) over (partition by doc_id, page order by line) as integer) as paragraph from g2",
    "box_union": f"with {_BOXES} select l_orderkey, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from boxes group by 1",
    "union_share": f"with {_BOXES}, c as (select l_orderkey, greatest(0, ceil(x0 - 0.5))::int as c0, least(100, ceil(x1 - 0.5))::int as c1, greatest(0, ceil(y0 - 0.5))::int as r0, least(100, ceil(y1 - 0.5))::int as r1 from boxes), r as (select l_orderkey, unnest(range(r0, r1)) as r, c0, c1 from c), x as (select distinct l_orderkey, r, unnest(range(c0, c1)) as x from r) select l_orderkey, count(*) / 10000 as share from x group by 1",
    "model_tier_scores": f"""with {_errors("select m as model, item_id, 't' || (item_id % 3) as tier, m = 'a' or (m = 'b' and item_id % 3 <> 1) as hit, text as ref, case m when 'a' then replace(text, 'the', 'teh ') when 'b' then translate(text, 'et', 'ET') end as hyp from benchmark, (values ('a'), ('b'), ('c')) v(m)")}, t as (select *, unnest([tier, 'overall']) as t from errors), g as (select model, t as tier, count(*) filter (hit) as n_pages, count(*) filter (not hit) as n_missing, round(avg(cer) filter (hit), 9) as cer, round(avg(wer) filter (hit), 9) as wer, round(avg(ned) filter (hit), 9) as ned from t group by all) select * replace (case when tier = 'overall' then n_missing end as n_missing) from g where tier = 'overall' or n_pages > 0""",
    "brier_score": "with e as (select (abs(event_id) * 7919 % 1000 / 1000.0)::double as c, event_type as g from events where event_type is not null) select count(*) as n, round(avg((c - (g = 'click')::int) ** 2 + (1 - c - (g = 'view')::int) ** 2), 9) as brier from e",
    "mcnemar_exact": "with d as (select count(*) filter (quality = 1 and doc_id % 3 <> 0) as b, count(*) filter (quality is distinct from 1 and doc_id % 3 = 0) as c from labels), t as (select *, unnest(range(0, least(b, c) + 1)) as k from d) select b, c, case when b + c = 0 then 1.0 else round(least(1, 2 * sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) + (b + c) * ln(0.5)))), 9) end::double as p from t group by b, c",
    "confidence_lanes": f"with {_CURVE} select case when c >= 0.8 then 'accept' when c < 0.3 then 'review' else 'escalate' end as lane, count(*) as n from e group by 1",
    "record_diff": f"with {_PATCH}, v as (select * from n where seq = 1) select coalesce(o.c_custkey, v.c_custkey) as c_custkey, case when o.c_custkey is null then 'added' when v.c_custkey is null then 'removed' else 'changed' end as change, case when o.c_custkey is null or v.c_custkey is null then '' else concat_ws(',', case when o.c_acctbal is distinct from v.c_acctbal then 'c_acctbal' end, case when o.c_name is distinct from v.c_name then 'c_name' end) end as fields from customer o full join v on o.c_custkey = v.c_custkey where o.c_custkey is null or v.c_custkey is null or o.c_acctbal is distinct from v.c_acctbal or o.c_name is distinct from v.c_name",
    "replace_block": "with n as (select user_id, event_id, 'kept' as event_type from events where user_id % 4 = 1 and event_type = 'click') select user_id, event_id, event_type from events where user_id is null or user_id not in (select user_id from n) union all select * from n",
    "fold_records": "with o as (select o_custkey, o_orderkey, case when o_orderkey % 3 = 0 then o_orderstatus end as s, case when o_orderkey % 2 = 0 then o_orderpriority end as p from orders) select o_custkey, arg_min(s, o_orderkey) as o_orderstatus, arg_min(p, o_orderkey) as o_orderpriority, concat_ws(',', case when min(p) <> max(p) then 'o_orderpriority' end, case when min(s) <> max(s) then 'o_orderstatus' end) as conflicts from o group by 1",
    "ordered_distinct": "with f as (select user_id, event_type, min(event_id) as f from events where event_type is not null group by all) select user_id, event_type, cast(row_number() over (partition by user_id order by f, event_type) as integer) as place from f",
    "csv_lines": "select c_custkey as path, unnest([1, 2, 3]) as line, unnest(['name' || chr(9) || 'segment' || chr(9) || 'key', c_name || ';x' || chr(9) || c_nationkey, c_mktsegment]) as text from customer",
    "json_lines": "select c_custkey as path, unnest([1, 2, 3]) as line, unnest([c_name, c_mktsegment, 'end']) as text from customer",
    "jsonl_pages": "select c_custkey as path, unnest([1, 4, 4]) as page, unnest([1, 1, 2]) as line, unnest([c_name, c_mktsegment, 'x']) as text from customer",
}

for more in (content_queries, xml_queries, geometry_queries, spatial_queries, table_queries, alignment_queries, bytes_queries, sniff_queries, provenance_queries, validation_queries, record_queries, sink_queries):
    QUERIES |= more.QUERIES
    ORACLES |= more._oracles() if more in (record_queries, sink_queries) else more.ORACLES
