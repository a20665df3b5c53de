"""Queries over merged records, reasons for text recognition and threshold grids, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.operators import evaluation, records, routing


def _merged(spark, d):
    """Orders of a customer as partial records: the status is a source field that seldom differs, the clerk-like priority
    describes, the price and the date are blocks; all are absent now and then."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    p = o.select("o_custkey", "o_orderkey", F.when(k % 3 == 0, F.when(k % 101 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit("x"))).otherwise(F.col("o_custkey").cast("string"))).alias("origin"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("note"), F.when(k % 5 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 7 != 0, F.col("o_orderstatus")).alias("state"))
    return records.merge_records(p, "o_custkey", "o_orderkey", ["origin"], ["note"], ["price", "state"])


def _reasons(spark, d):
    from inkspan.plans.registry import _decoded

    lines = _decoded(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    layer = F.element_at(F.array(*map(F.lit, ["digital", "none", "ocr", "blank", "digital"])), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    pages = docs.select("doc_id", F.lit(1).alias("page"), layer.alias("text_layer"), (F.col("doc_id") % 7 == 0).alias("textual"))
    return routing.atr_reasons(lines, pages, ["doc_id", "page"])


CUTS, OTHERS = (0, 10, 50, 100, 1000), (0.1, 0.25, 0.5, 0.9)


def _grid(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("value", (F.abs("event_id") * 7919 % 1000 / 1000.0).cast("double").alias("c"), (F.col("event_type") == "click").alias("ok"))
    return evaluation.threshold_grid(e, "value", "c", CUTS, OTHERS, "ok")


QUERIES = {"merge_records": _merged, "atr_reasons": _reasons, "threshold_grid": _grid}


def _oracles():
    from inkspan.plans.registry import _DECODED, _LINES

    return {
        "merge_records": """with p as (select o_custkey, o_orderkey as k, case when k % 3 = 0 then o_custkey || case when k % 101 = 0 then 'x' else '' end end as origin, case when k % 2 = 0 then o_orderpriority end as note, case when k % 5 <> 0 then o_totalprice end as price, case when k % 7 <> 0 then o_orderstatus end as state from orders),
g as (select o_custkey, arg_min(origin, k) filter (origin is not null) as origin, arg_min(note, k) filter (note is not null) as note, arg_max(price, k) filter (price is not null) as price, arg_max(state, k) filter (state is not null) as state, count(distinct origin) > 1 as bad from p group by 1)
select o_custkey, case when not bad then origin end as origin, case when not bad then note end as note, case when not bad then price end as price, case when not bad then state end as state, case when bad then 'origin' else '' end as conflicts, case when bad then 'conflict' else 'ok' end as status from g""",
        "atr_reasons": f"""with {_LINES}, {_DECODED}, u as (select doc_id, page, line, u from r2), c as (select d.doc_id, d.page, count(*) as lines, count(*) filter (decode = 'garbled' and u) as lost, count(*) filter (decode = 'garbled') as g from decoded d join u using (doc_id, page, line) group by all),
p as (select doc_id, 1 as page, ['digital', 'none', 'ocr', 'blank', 'digital'][doc_id % 5 + 1] as layer, doc_id % 7 = 0 as textual from documents),
j as (select p.*, coalesce(lines, 0) as lines, coalesce(lost, 0) as undecodable, coalesce(g - lost, 0) as mojibake from p left join c on c.doc_id = p.doc_id and c.page = p.page),
r as (select *, case when textual then '' else concat_ws(',', case when mojibake > 0 then 'mojibake' end, case when undecodable > 0 then 'undecodable' end, case when layer = 'none' then case when lines > 0 then 'furniture_only' else 'no_text' end end, case when layer = 'ocr' then 'prior_ocr' end) end as reasons from j)
select doc_id, page, reasons, reasons <> '' as needs_atr, mojibake, undecodable, lines from r""",
        "threshold_grid": f"""select a::double as first_cut, b::double as second_cut, count(*) filter (value >= a and (abs(event_id) * 7919 % 1000 / 1000.0) >= b) as n, count(*) filter (value >= a and (abs(event_id) * 7919 % 1000 / 1000.0) >= b and event_type = 'click') as good
from events, unnest({list(CUTS)}) x(a), unnest({list(OTHERS)}) y(b) group by all""",
    }
