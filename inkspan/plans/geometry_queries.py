"""Queries over words of the documents that are set in one to three columns, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.operators import page_geometry as geometry

KEYS = ["doc_id", "page"]


def _words(spark, d):
    """Words six to a row, 40 rows to a column; tops a little apart; a wider gap after every 37th word; in every other document one row in 20 spans all
    columns, in larger type; sizes and bold type change by place. A text's words come in order, so that pages stand together."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    w = docs.select("doc_id", (F.col("doc_id") % 3 + 1).alias("cols"), F.posexplode(F.split("text", r"\s+")).alias("k", "text")).where("text <> ''")
    row = F.floor(F.col("k") / 6)
    w = w.withColumns({"slot": F.col("k") % 6, "page": F.floor(row / (40 * F.col("cols"))), "q": row % (40 * F.col("cols"))})
    w = w.withColumns({"c": F.floor(F.col("q") / 40), "y": F.col("q") % 40, "wide": (F.col("doc_id") % 2 == 0) & (F.col("q") % 20 == 10) & (F.col("q") < 40)})
    x0 = F.when(F.col("wide"), F.lit(40.0) + F.col("slot") * 55 * F.col("cols")).otherwise(F.lit(40.0) + F.col("c") * 330 + F.col("slot") * 50)
    x1 = x0 + F.when(F.col("wide"), 54.5 * F.col("cols")).otherwise(F.when(F.col("k") % 37 == 0, 25.0).otherwise(43.25 + F.length("text") % 3))
    top = F.lit(50.0) + F.col("y") * 14 + ((F.col("k") * 7) % 4) * 0.5 + F.when(F.col("wide"), 7).otherwise(0)
    size = F.when(F.col("wide"), 14.0).when(F.col("k") % 50 == 0, 9.5).when(F.col("k") % 31 != 0, 10.0)
    return w.select("doc_id", F.col("page").cast("int").alias("page"), "k", "text", x0.alias("x0"), top.alias("top"), x1.alias("x1"), (top + 10).alias("bottom"), size.alias("size"), F.concat(F.lit("F"), F.col("k") % 3).alias("font"), (F.col("k") % 3 == 0).alias("bold"))


def _units(spark, d):
    return geometry.page_units(_words(spark, d), KEYS, "k")


def _ordered(spark, d):
    return geometry.page_reading_order(_units(spark, d), KEYS, "unit")


QUERIES = {
    "word_rows": lambda s, d: geometry.page_segments(_words(s, d).select(*KEYS, "k", "x0", "top", "x1", "size"), KEYS, "k").select(*KEYS, "k", "row", "unit"),
    "line_units": lambda s, d: _units(s, d),
    "page_gutters": lambda s, d: geometry.gutters(_units(s, d), KEYS),
    "reading_order": lambda s, d: _ordered(s, d).select(*KEYS, "unit", "spanning", "column", "place"),
    "heading_levels": lambda s, d: geometry.doc_heading_levels(_units(s, d), ["doc_id"], ["page", "unit"]).select(*KEYS, "unit", "size", "heading"),
    "body_size": lambda s, d: geometry.body_size(_units(s, d), ["doc_id"], ["page", "unit"]),
}

_ROWS = r"""recursive w0 as (select doc_id, doc_id % 3 + 1 as cols, generate_subscripts(string_split_regex(text, '\s+'), 1) - 1 as k, unnest(string_split_regex(text, '\s+')) as text from documents),
w1 as (select *, k % 6 as slot, (k // 6) // (40 * cols) as page, (k // 6) % (40 * cols) as q from w0 where text <> ''), w2 as (select *, q // 40 as c, q % 40 as y, doc_id % 2 = 0 and q % 20 = 10 and q < 40 as wide from w1),
w3 as (select *, case when wide then 40.0 + slot * 55 * cols else 40.0 + c * 330 + slot * 50 end::double as x0, (50.0 + y * 14 + ((k * 7) % 4) * 0.5 + case when wide then 7 else 0 end)::double as top from w2),
words as materialized (select doc_id, page::integer as page, k, text, x0, top, x0 + case when wide then 54.5 * cols else case when k % 37 = 0 then 25.0 else 43.25 + length(text) % 3 end end as x1, top + 10 as bottom, case when wide then 14.0 when k % 50 = 0 then 9.5 when k % 31 <> 0 then 10.0 end::double as size, 'F' || (k % 3) as font, k % 3 = 0 as bold,
  row_number() over (partition by doc_id, page order by round_even(top, 1), x0, k) as i from w3),
fold as (select doc_id, page, i, k, top as first, 0 as row from words where i = 1
  union all select f.doc_id, f.page, w.i, w.k, case when abs(f.first - w.top) > greatest(2, 0.5 * coalesce(w.size, 10)) then w.top else f.first end, f.row + (abs(f.first - w.top) > greatest(2, 0.5 * coalesce(w.size, 10)))::int from fold f join words w on w.doc_id = f.doc_id and w.page = f.page and w.i = f.i + 1),
gaps as (select w.*, f.row, coalesce(x0 - max(x1) over (partition by w.doc_id, w.page, f.row order by x0, w.k rows between unbounded preceding and 1 preceding) > 1.5 * coalesce(w.size, 10), true) as opens from words w join fold f using (doc_id, page, k)),
rows_ as materialized (select *, cast(sum(opens::int) over (partition by doc_id, page order by row, x0, k) - 1 as integer) as unit from gaps)"""
_UNITS = _ROWS + """,
sizes as (select doc_id, page, unit, round_even(coalesce(size, 0), 1)::double as size, count(*) as c, arg_min(x0, (x0, k)) as fx, min((x0, k)) as f from rows_ group by all),
modes as (select doc_id, page, unit, arg_min(size, (-c, f)) as size from sizes group by all),
units as materialized (select r.doc_id, r.page, r.unit, string_agg(text, ' ' order by x0, k) as text, min(x0) as x0, min(top) as top, max(x1) as x1, max(bottom) as bottom, any_value(m.size) as size, arg_min(font, (x0, k)) as font, round(coalesce(sum(case when bold then length(text) else 0 end) / nullif(sum(length(text)), 0), 0), 3)::double as bold_share from rows_ r join modes m using (doc_id, page, unit) group by all)"""
_UNITS = _UNITS.replace("arg_min(x0, (x0, k)) as fx, ", "")
_GUTTERS = _UNITS + """,
pages as (select doc_id, page, count(*) as n, min(trunc(x0))::bigint as lo, max(trunc(x1))::bigint + 1 as hi from units group by all having count(*) >= 4),
places as (select doc_id, page, n, unnest(range(lo, hi + 1)) as x from pages), hit as (select doc_id, page, unnest(range(trunc(x0)::bigint, trunc(x1)::bigint + 1)) as x from units),
covered as (select p.*, coalesce(c, 0) as c from places p left join (select doc_id, page, x, count(*) as c from hit group by all) using (doc_id, page, x)),
lows as (select *, x - row_number() over (partition by doc_id, page order by x) as g from covered where c <= greatest(1, n // 10)),
strips as (select doc_id, page, min(x) as g0, max(x) as g1 from lows group by doc_id, page, g having max(x) - min(x) >= 8),
gutters as materialized (select s.doc_id, s.page, g0::double as g0, g1::double as g1 from strips s join units u using (doc_id, page) group by all having count(*) filter (x0 < g0 and x1 <= g1) >= 2 and count(*) filter (x1 > g1 and x0 >= g0) >= 2)"""
_HEADINGS = _UNITS + """,
weights as (select doc_id, size, sum(length(text)) as c, min((page, unit)) as f from units group by all), body as (select doc_id, arg_min(size, (-c, f)) as body from weights group by all)"""
ORACLES = {
    "word_rows": f"with {_ROWS} select doc_id, page, k, row, unit from rows_",
    "line_units": f"with {_UNITS} select doc_id, page, unit, text, x0, top, x1, bottom, size, font, bold_share from units",
    "page_gutters": f"with {_GUTTERS} select * from gutters",
    "reading_order": f"""with {_GUTTERS}, u as (select *, exists (select 1 from gutters g where g.doc_id = u.doc_id and g.page = u.page and u.x0 < g0 + 1 and u.x1 > g1 - 1) as spanning, (select count(*) from gutters g where g.doc_id = u.doc_id and g.page = u.page and (u.x0 + u.x1) / 2 > (g0 + g1) / 2) as col from units u),
b as (select *, 2 * sum(spanning::int) over (partition by doc_id, page order by top, x0, unit) + (not spanning)::int as band, case when spanning then 0 else col end::integer as column from u) select doc_id, page, unit, spanning, "column", cast(row_number() over (partition by doc_id, page order by band, "column", top, x0, unit) - 1 as integer) as place from b""".replace("as column from u", 'as "column" from u'),
    "heading_levels": f"""with {_HEADINGS}, f as (select u.*, length(text) <= 160 and size >= 1.15 * body as fits from units u join body using (doc_id)), l as (select doc_id, size, least(row_number() over (partition by doc_id order by size desc), 3) as level from (select distinct doc_id, size from f where fits)) select f.doc_id, page, unit, f.size, cast(case when fits then level end as integer) as heading from f left join l on l.doc_id = f.doc_id and l.size = f.size""",
    "body_size": f"with {_HEADINGS} select * from body",
}
