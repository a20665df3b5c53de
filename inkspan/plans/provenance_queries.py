"""Queries over orders as stages of their customers' runs, and over graphs of them, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.operators import provenance as prov


def _stages(spark, d):
    """An order is a stage of its customer's run: its parts are files, shipped ones are processed; some things are not told."""
    o, item = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/lineitem.parquet")
    flags = item.groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    per = flags.groupBy("o_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("outputs"), F.sum("n").alias("files"), F.sum("done").alias("done"))
    k, start = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    part = lambda kind, c: F.struct(F.lit(kind).alias("name"), c.alias("version"))
    return o.join(per, "o_orderkey", "left").select(
        "o_custkey", "o_orderkey", F.concat(F.lit("step"), k % 5).alias("program"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("r"), k % 7)).alias("repository"), F.when(k % 4 > 1, (k % 9).cast("string")).alias("tool_version"),
        F.when(F.col("o_totalprice") > 480000, prov.FAILED).when(k % 2 == 0, prov.COMPLETED).alias("action_status"), F.when(k % 6 > 0, start).otherwise("").alias("start_time"), F.when(k % 6 > 1, start).alias("end_time"), F.col("o_totalprice").alias("duration_seconds"),
        F.when(k % 8 > 0, F.col("files")).alias("input_files_total"), F.when(k % 10 > 0, F.col("done")).alias("successfully_processed"), (F.col("files") - F.col("done")).alias("skipped_files"), "outputs",
        F.when(k % 11 > 0, F.array(part("priority", F.col("o_orderpriority")), part("state", F.col("o_orderstatus")), part("state", F.col("o_orderstatus")))).alias("components"), F.concat(F.lit("in/"), start, F.lit(".txt")).alias("file"))


def _graph(spark, d):
    """A node per customer and per state of its orders, described by each order, some texts empty; one graph per nation."""
    o, c = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("o_orderkey")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    row = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    pair = lambda name, v: F.struct(F.lit(name).alias("k"), v.alias("v"))
    parts = F.when(k % 4 == 0, "[]").otherwise(F.concat(F.lit("["), k, F.lit("]")))
    level = F.when(k % 3 == 0, '""').when(k % 3 == 1, quoted(F.col("o_orderpriority")))
    attrs = F.map_from_entries(F.array_compact(F.array(pair("@type", F.lit('"Thing"')), pair("level", level), F.when(k % 4 < 2, pair("parts", parts)), F.when(k % 50 == 0, pair("seen", F.lit("{}"))))))
    node = F.when(k % 20 == 0, prov.ROOT).when(k % 2 == 0, F.col("c_name")).otherwise(F.concat(F.lit("#"), "o_orderstatus", F.lit("-"), "c_mktsegment"))
    return row.select(F.col("c_nationkey").alias("graph"), node.alias("node"), k.alias("at"), F.when(k % 13 > 0, attrs).alias("attributes"))


def _components(s, d):
    return prov.components_used(_stages(s, d), "o_custkey", "o_orderkey").select("o_custkey", "first_stage", "first_place", "component.name", "component.version")


QUERIES = {
    "folded_runs": lambda s, d: prov.folded_runs(_stages(s, d), "o_custkey", "o_orderkey"),
    "output_formats": lambda s, d: prov.output_formats(_stages(s, d), "o_custkey"),
    "components_used": _components,
    "folded_files": lambda s, d: prov.folded_files(_stages(s, d), "file"),
    "merged_nodes": lambda s, d: prov.merged_nodes(_graph(s, d), "graph", "node", "at", conforms="https://w3id.org/ro/crate/1.2"),
}

_STAGES = f"""with per as (select l_orderkey as k, count(*) as files, count(*) filter (l_linestatus = 'F') as done from lineitem group by all),
s as (select o_custkey, o_orderkey as k, 'step' || o_orderkey % 5 as program, case when o_orderkey % 3 = 1 then 'r' || o_orderkey % 7 end as repository, case when o_orderkey % 4 > 1 then (o_orderkey % 9)::varchar end as tool_version, o_totalprice > 480000 as failed,
  strftime(o_orderdate, '%Y-%m-%d') as day, o_totalprice as secs, case when o_orderkey % 8 > 0 then coalesce(files, 0) else 0 end as inputs, case when o_orderkey % 10 > 0 then coalesce(done, 0) else 0 end as done, coalesce(files - done, 0) as skipped, o_orderpriority as pr, o_orderstatus as st from orders left join per on o_orderkey = per.k)"""
ORACLES = {
    "folded_runs": f"""{_STAGES} select o_custkey, count(*) as stage_count, arg_min(program, k) as program, coalesce(arg_min(repository, k) filter (repository is not null), '') as repository, coalesce(arg_min(tool_version, k) filter (tool_version is not null), '') as tool_version,
  case when bool_or(failed) then '{prov.FAILED}' else '{prov.COMPLETED}' end as action_status, coalesce(min(day) filter (k % 6 > 0), '') as start_time, coalesce(max(day) filter (k % 6 > 1), '') as end_time, round(sum(secs::decimal(28, 9)), 3)::double as total_duration_seconds, arg_min(inputs, k) as input_files_total, arg_max(done, k) as successfully_processed, sum(skipped)::bigint as skipped_files from s group by o_custkey""",
    "output_formats": "select o_custkey, l_returnflag as format, count(*) as files from orders join lineitem on o_orderkey = l_orderkey group by all",
    "components_used": f"""{_STAGES}, c as (select o_custkey, k, 0 as place, 'priority' as name, pr as version from s where k % 11 > 0 union all select o_custkey, k, 1, 'state', st from s where k % 11 > 0)
select o_custkey, min(k) as first_stage, arg_min(place, k) as first_place, name, version from c group by o_custkey, name, version""",
    "folded_files": f"{_STAGES} select day || '.txt' as input_file, count(*) as step_count, round(sum(secs::decimal(28, 9)), 3)::double as total_duration_seconds from s group by day",
    "merged_nodes": f"""with n as (select c_nationkey as graph, o_orderkey as k, case when o_orderkey % 20 = 0 then './' when o_orderkey % 2 = 0 then c_name else '#' || o_orderstatus || '-' || c_mktsegment end as node, o_orderpriority as pr from orders join customer on o_custkey = c_custkey),
a as (select graph, node, k, '@type' as name, '"Thing"' as v from n where k % 13 > 0 union all select graph, node, k, 'level', case k % 3 when 0 then '""' when 1 then '"' || pr || '"' else 'null' end from n where k % 13 > 0
  union all select graph, node, k, 'parts', case k % 4 when 0 then '[]' else '[' || k || ']' end from n where k % 13 > 0 and k % 4 < 2 union all select graph, node, k, 'seen', '{{}}' from n where k % 13 > 0 and k % 50 = 0),
f as (select graph, node, min(k) as first from n group by all), r as (select a.graph, a.node, name, v from a join f using (graph, node) where v not in ('null', '""', '[]', '{{}}') or k = first
  qualify row_number() over (partition by a.graph, a.node, name order by v in ('null', '""', '[]', '{{}}'), k desc) = 1),
t as (select f.graph, f.node, '{{' || concat_ws(', ', '"@id": "' || f.node || '"', string_agg('"' || name || '": ' || v, ', ' order by name)) || '}}' as entity from f left join r using (graph, node) group by f.graph, f.node
  union all select distinct graph, '{prov.DESCRIPTOR}', '{{"@id": "{prov.DESCRIPTOR}", "@type": "CreativeWork", "about": {{"@id": "./"}}, "conformsTo": {{"@id": "https://w3id.org/ro/crate/1.2"}}}}' from n)
select graph, case node when '{prov.DESCRIPTOR}' then 0 when './' then 1 else 2 end as rank, node, entity from t""",
}
