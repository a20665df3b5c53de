"""Queries over JSON and CSV contents that are made, in varying shapes, from the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.sources import csv_rows as csv
from inkspan.sources import json_trees as trees


def _json_contents(spark, d):
    """A JSON content per document: lines with words, typed items, two pages, a list of lines, strings under no text key,
    and the bare text, which is no JSON; documents without text have none."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    lines = F.split("text", "\n")
    worded = F.to_json(F.transform(lines, lambda x: F.struct(x.alias("text"), F.split(x, " ").alias("words"))))
    bare = F.to_json(F.transform(lines, lambda x: F.struct(F.split(x, " ").alias("words"))))
    typed = F.to_json(F.flatten(F.transform(lines, lambda x: F.concat(F.array(F.struct(F.lit("LINE").alias("BlockType"), x.alias("Text"))), F.transform(F.split(x, " "), lambda w: F.struct(F.lit("WORD").alias("BlockType"), w.alias("Text")))))))
    shape = F.col("doc_id") % 6
    content = (F.when(shape == 0, F.concat(F.lit('{"id": '), "doc_id", F.lit(', "text": '), quoted(F.col("text")), F.lit(', "data": "'), F.md5("text"), F.lit('", "lines": '), worded, F.lit("}")))
               .when(shape == 1, F.concat(F.lit('{"Blocks": '), typed, F.lit(', "note": "x"}')))
               .when(shape == 2, F.concat(F.lit('{"front": {"lines": '), bare, F.lit('}, "back": {"content": '), quoted(F.col("text")), F.lit("}}")))
               .when(shape == 3, F.to_json(lines))
               .when(shape == 4, F.concat(F.lit('{"title": '), quoted(lines[0]), F.lit(', "nested": [[["x1", '), quoted(F.col("lang")), F.lit(']], "77"], "n": '), "doc_id", F.lit("}")))
               .otherwise(F.col("text")))
    return docs.select(F.col("doc_id").alias("path"), content.alias("content"))


_JSON_CONTENTS = r"""lined as (select doc_id as path, text, lang, string_split(text, chr(10)) as ls from documents),
files as (select path, case path % 6 when 0 then '{"id": ' || path || ', "text": ' || to_json(text) || ', "data": "' || md5(text) || '", "lines": ' || to_json(list_transform(ls, lambda x: {'text': x, 'words': string_split(x, ' ')})) || '}'
  when 1 then '{"Blocks": ' || to_json(flatten(list_transform(ls, lambda x: list_concat([{'BlockType': 'LINE', 'Text': x}], list_transform(string_split(x, ' '), lambda w: {'BlockType': 'WORD', 'Text': w}))))) || ', "note": "x"}'
  when 2 then '{"front": {"lines": ' || to_json(list_transform(ls, lambda x: {'words': string_split(x, ' ')})) || '}, "back": {"content": ' || to_json(text) || '}}'
  when 3 then to_json(ls)::varchar when 4 then '{"title": ' || to_json(ls[1]) || ', "nested": [[["x1", ' || to_json(lang) || ']], "77"], "n": ' || path || '}' else text end as content from lined)"""

_JSON_NODES = _JSON_CONTENTS + r""",
tree as materialized (select f.path, t.id::bigint as id, t.parent::bigint as parent, t.key, t.type as kind, t.atom->>'$' as val from (select * from files where json_valid(content)) f, json_tree(f.content::json) t)"""


def _names(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_STRIP = r"regexp_replace({}, '^[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}]+|[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}]+$', '', 'g')"
#: The walk from the top: what is dropped is not followed, what makes up a line is followed with that line's number.
_WALK = _JSON_NODES.replace("lined as", "recursive lined as", 1) + rf""",
nodes as materialized (select c.path, c.id, c.parent, c.kind, case when p.kind = 'OBJECT' then c.key end as key, lower(case when p.kind = 'OBJECT' then c.key end) as lk, case when c.kind = 'VARCHAR' then {_STRIP.format('c.val')} end as said, c.val,
  exists (select 1 from tree x where x.path = c.path and x.parent = c.id) as filled from tree c left join tree p on p.path = c.path and p.id = c.parent),
facts as materialized (select path, parent as id, bool_or(coalesce(lk in {_names(trees.OWN_KEYS)} and said <> '', false)) as own, bool_or(coalesce(lk in {_names(trees.LINE_KEYS)} and (kind in ('OBJECT', 'ARRAY') and filled or kind = 'VARCHAR' and val <> ''), false)) as has,
  coalesce(arg_min(lower(said), id) filter (lk in {_names(trees.TYPE_FIELDS)} and kind = 'VARCHAR'), '') as t from nodes where parent is not null group by all),
rich as materialized (select n.*, coalesce(n.kind = 'OBJECT' and own, false) as own, coalesce(n.kind = 'OBJECT' and has, false) as has, case when n.kind = 'OBJECT' then coalesce(t, '') end as t from nodes n left join facts f using (path, id)),
mixed as (select path, parent as id, bool_or(t in {_names(trees.LINE_TYPES)}) and bool_or(t in {_names(trees.WORD_TYPES)}) as mix from rich where t is not null group by all),
up as (select path, id as leaf, id, parent from rich where has union select u.path, u.leaf, n.id, n.parent from up u join nodes n on n.path = u.path and n.id = u.parent),
bearing as (select distinct path, id from up),
keyed as (select path, id, lk as ek from nodes where parent is null union all select n.path, n.id, coalesce(n.lk, k.ek) from nodes n join keyed k on n.path = k.path and n.parent = k.id),
solid as materialized (select n.path, n.id, n.said, k.ek, coalesce(k.ek in {_names(trees.TEXT_KEYS)}, false) as by_key, regexp_matches(said, '\p{{L}}') as lettered from nodes n join keyed k using (path, id) where n.kind = 'VARCHAR' and said <> ''
  and not (starts_with(said, 'data:') and contains(left(said, 200), ';base64,')) and not (length(said) >= 256 and not regexp_matches(said, '\s')) and not (length(said) >= 32 and regexp_matches(said, '^[0-9a-fA-F]+$'))
  and not (length(said) >= 64 and length(said) % 4 = 0 and regexp_matches(said, '^[A-Za-z0-9+/]+={{0,2}}$') and regexp_matches(said, '[0-9]') and regexp_matches(said, '[A-Z]') and regexp_matches(said, '[a-z]'))),
above as (select path, id as leaf, id, by_key, lettered from solid union all select a.path, a.leaf, n.parent, a.by_key, a.lettered from above a join nodes n on n.path = a.path and n.id = a.id where n.parent is not null),
below as (select path, id, bool_or(by_key) as by_key, bool_or(lettered) as lettered from above group by all),
roots as (select path, id, kind from rich where parent is null), kids as (select n.path, n.id, n.kind, n.key, r.kind as root, count(*) over (partition by n.path) as n, row_number() over (partition by n.path order by n.id) as i, bool_and(n.kind = 'VARCHAR') over (partition by n.path) as strings from nodes n join roots r on r.path = n.path and n.parent = r.id),
plain as (select path, kind = 'VARCHAR' or (kind = 'ARRAY' and exists (select 1 from kids k where k.path = r.path and strings)) as is_plain from roots r),
scopes as (select path, -1 as top, id, '1' as page from roots join plain using (path) where not is_plain union all select path, id, id, case root when 'ARRAY' then i::varchar else key end from kids join plain using (path) where not is_plain and (root = 'ARRAY' and n >= 2 or root = 'OBJECT' and kind in ('OBJECT', 'ARRAY'))),
walk as (select path, top, page, m, id, null::varchar as ek, false as via, false as sup, null::bigint as flat from scopes, (values (false), (true)) v(m)
  union all select path, top, page, m, id, ek, via, sup, coalesce(flat, case when kind = 'OBJECT' and via and not own and not has and case when m then lettered else by_key end then id end) from (
    select w.path, w.top, w.page, w.m, c.id, c.kind, c.own, c.has, s.by_key, s.lettered, w.flat, coalesce(c.lk, w.ek) as ek, case when p.kind = 'OBJECT' then coalesce(c.lk in {_names(trees.LINE_KEYS)}, false) else w.via end as via, w.sup or (w.via and p.own) as sup
    from walk w join rich p on p.path = w.path and p.id = w.id join rich c on c.path = p.path and c.parent = p.id left join mixed x on x.path = p.path and x.id = p.id left join bearing b on b.path = p.path and b.id = p.id left join below s on s.path = c.path and s.id = c.id
    where w.flat is not null or case p.kind when 'OBJECT' then not ((w.sup or (w.via and p.own) or p.has or p.own) and coalesce(c.lk in {_names(trees.WORD_KEYS)}, false) and (p.has or c.kind in ('OBJECT', 'ARRAY')))
      and not (b.id is not null and coalesce(c.lk in {_names(trees.COARSE_KEYS)}, false) and c.kind = 'VARCHAR' and c.said <> '') else not (coalesce(x.mix, false) and coalesce(c.t in {_names(trees.WORD_TYPES)}, false)) end)),
said as (select w.path, top, page, m, coalesce(flat, w.id) as line, w.id, flat is not null as flat, said from walk w join solid s on s.path = w.path and s.id = w.id where case when m then lettered else coalesce(w.ek in {_names(trees.TEXT_KEYS)}, false) end),
texts as (select path, top, page, m, line, case when flat then string_agg(trim(regexp_replace(said, '\s+', ' ', 'g')), ' ' order by id) else min(said) end as said from said group by path, top, page, m, line, flat),
pages as (select path, m, count(distinct top) filter (top >= 0) >= 2 as paged from texts group by path, m), chosen as (select t.* from texts t join pages using (path, m) where paged = (top >= 0)),
fit as (select * from (select *, bool_or(not m) over (partition by path) as by_key from chosen) where m <> by_key),
found as (select path, page, top, line, said from fit union all select n.path, '1', -1, n.id, n.val from nodes n join plain p using (path) where is_plain and n.kind = 'VARCHAR'),
split as (select path, page, top, line, unnest(string_split(said, chr(10))) as text, generate_subscripts(string_split(said, chr(10)), 1) as i from found)
select path, page, cast(row_number() over (partition by path, top order by line, i) as integer) as line, text from split"""


def _csv_contents(spark, d):
    """A CSV content per customer, by its own delimiter, with quoted cells that hold delimiters, quotes or line ends, empty
    cells and rows, and now and then a quote that never ends."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    mark = F.element_at(F.array(*map(F.lit, csv.DELIMITERS)), (F.col("c_custkey") % 4 + 1).cast("int"))
    end = F.when(F.col("c_custkey") % 3 == 0, "\r\n").otherwise("\n")
    first = F.concat(F.lit("name"), mark, F.lit("segment"), mark, F.lit("key"), end)
    second = F.concat(F.lit('"'), "c_name", mark, F.lit(' ""x""\n y"'), mark, F.lit("  "), mark, F.col("c_nationkey").cast("string"), end)
    third = F.concat(mark, F.lit(" a  b "), F.col("c_mktsegment"), F.lit('"q'), mark, end, mark, mark, end)
    last = F.when(F.col("c_custkey") % 11 == 0, '"open').when(F.col("c_custkey") % 13 == 0, '"x"y').otherwise(F.concat(F.lit('""'), mark, F.col("c_acctbal").cast("string")))
    return c.select(F.col("c_custkey").alias("path"), F.when(F.col("c_custkey") % 17 != 0, F.concat(first, second, third, last)).alias("content"))


def _records(spark, d):
    """JSON Lines contents per order customer: an order a line, some lines broken, blank or with two values."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, '{"k": 1} {"k": 2}').when(F.col("o_orderkey") % 5 == 0, "{broken").when(F.col("o_orderkey") % 11 == 0, "").otherwise(
        F.to_json(F.struct("o_orderkey", F.col("o_orderstatus").alias("text"), F.struct(F.array("o_orderpriority", "o_orderstatus").alias("more")).alias("in")))).alias("record"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "record"))), lambda x: x["record"]), "\n")
    return o.groupBy(F.col("o_custkey").alias("path")).agg(lines.alias("content"))


QUERIES = {
    "json_strings": lambda s, d: trees.json_strings(_json_contents(s, d)).select("path", "group", "line", "text"),
    "json_text_lines": lambda s, d: trees.json_text_lines(_json_contents(s, d)),
    "json_status": lambda s, d: _json_contents(s, d).select("path", trees.json_status(F.col("content")).alias("status")),
    "json_records": lambda s, d: trees.json_records(_records(s, d)).select("path", "line", "status"),
    "csv_rows": lambda s, d: csv.csv_rows(_csv_contents(s, d)),
    "csv_status": lambda s, d: csv.csv_table(_csv_contents(s, d)).select("path", "status", F.size("rows").alias("n")).withColumn("n", F.when(F.col("status") == "ok", F.col("n"))),
}

ORACLES = {
    "json_strings": f"with {_JSON_NODES}, s as (select path, val, row_number() over (partition by path order by id) - 1 as g from tree where kind = 'VARCHAR'), l as (select path, g, unnest(string_split(val, chr(10))) as text, generate_subscripts(string_split(val, chr(10)), 1) as i from s) select path, cast(g as integer) as group, cast(row_number() over (partition by path order by g, i) as integer) as line, text from l",
    "json_text_lines": f"with {_WALK}",
    "json_status": f"with {_JSON_CONTENTS} select path, case when content is null then null when json_valid(content) then 'ok' else 'corrupt' end as status from files",
    "json_records": """with o as (select o_custkey as path, o_orderkey, case when o_orderkey % 7 = 0 then 'corrupt' when o_orderkey % 5 = 0 then 'corrupt' when o_orderkey % 11 = 0 then null else 'ok' end as status from orders), n as (select *, cast(row_number() over (partition by path order by o_orderkey) as integer) as line from o) select path, line, status from n where status is not null""",
    "csv_rows": r"""with c as (select *, [',', ';', chr(9), '|'][c_custkey % 4 + 1] as m from customer where c_custkey % 17 <> 0 and c_custkey % 11 <> 0 and c_custkey % 13 <> 0)
select c_custkey as path, unnest([1, 2, 3, 4]) as line, unnest([concat_ws(chr(9), 'name', 'segment', 'key'), concat_ws(chr(9), c_name || case when m = chr(9) then ' ' else m || ' ' end || '"x" y', c_nationkey::varchar), 'a b ' || c_mktsegment || '"q', c_acctbal::varchar]) as text from c""",
    "csv_status": "select c_custkey as path, case when c_custkey % 17 = 0 then null when c_custkey % 11 = 0 or c_custkey % 13 = 0 then 'corrupt' else 'ok' end as status, case when c_custkey % 17 <> 0 and c_custkey % 11 <> 0 and c_custkey % 13 <> 0 then 5 end as n from customer",
}
