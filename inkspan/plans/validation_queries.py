"""Records of orders as JSON, valid and not, against a schema, and the same rules as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.operators import validation

SCHEMA = {
    "$defs": {"line": {"type": "object", "required": ["n", "qty"], "properties": {"n": {"type": "integer", "minimum": 1}, "qty": {"type": "number", "maximum": 45}, "flag": {"enum": ["A", "N", "R"]}}}},
    "type": "object", "required": ["key", "status", "lines"], "additionalProperties": False,
    "properties": {"key": {"type": "integer"}, "status": {"type": "string", "pattern": "^[OFP]$"}, "note": {"type": ["string", "null"], "minLength": 3}, "lines": {"type": "array", "minItems": 2, "items": {"$ref": "#/$defs/line"}}},
}


def _records(spark, d):
    o, l = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    item = F.concat(F.lit('{"n": '), F.when(F.col("l_orderkey") % 13 == 0, F.col("l_linenumber") - 1).otherwise(F.col("l_linenumber")).cast("string"), F.when(F.col("l_orderkey") % 11 != 0, F.concat(F.lit(', "qty": '), F.col("l_quantity").cast("string"))).otherwise(""), F.lit(', "flag": "'), F.when(F.col("l_orderkey") % 17 == 0, "x").otherwise(F.col("l_returnflag")), F.lit('"}'))
    lines = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice", item.alias("j")))), lambda x: x["j"]), ", ").alias("ls"))
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"key": '), F.when(k % 7 == 0, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k.cast("string")), F.lit(', "status": "'), F.when(k % 9 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")), F.lit('"'), F.when(k % 5 == 0, ', "note": "ab"').when(k % 5 == 1, ', "note": null').when(k % 5 == 2, ', "extra": 1').otherwise(""), F.lit(', "lines": ['), F.coalesce("ls", F.lit("")), F.lit("]"), F.when(k % 19 == 0, "").otherwise("}"))
    return o.join(lines, "o_orderkey", "left").select(k.alias("path"), F.when(k % 23 != 0, body).alias("content"))


QUERIES = {"record_violations": lambda s, d: validation.violations(_records(s, d), SCHEMA)}
ORACLES = {
    "record_violations": """with o as (select o_orderkey as k, o_orderstatus as s from orders), good as (select * from o where k % 23 <> 0 and k % 19 <> 0), l as (select l.*, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_extendedprice) - 1 as i from lineitem l join good on k = l_orderkey), n as (select k, count(l_orderkey) as n from good left join l on l_orderkey = k group by k)
select k as path, '$' as at, case when k % 23 = 0 then 'null' else 'json' end as keyword, 'true' as rule from o where k % 23 = 0 or k % 19 = 0
union all select k, '$.key', 'type', '"integer"' from good where k % 7 = 0
union all select k, '$.status', 'pattern', '"^[OFP]$"' from good where not regexp_matches(case when k % 9 = 0 then lower(s) else s end, '^[OFP]$')
union all select k, '$.note', 'minLength', '3' from good where k % 5 = 0
union all select k, '$', 'additionalProperties', '["key", "lines", "note", "status"]' from good where k % 5 = 2
union all select k, '$.lines', 'minItems', '2' from n where n < 2
union all select l_orderkey, '$.lines[' || i || '].n', 'minimum', '1' from l where l_orderkey % 13 = 0 and l_linenumber < 2
union all select l_orderkey, '$.lines[' || i || ']', 'required', '"qty"' from l where l_orderkey % 11 = 0
union all select l_orderkey, '$.lines[' || i || '].qty', 'maximum', '45' from l where l_orderkey % 11 <> 0 and l_quantity > 45
union all select l_orderkey, '$.lines[' || i || '].flag', 'enum', '["A", "N", "R"]' from l where l_orderkey % 17 = 0 or l_returnflag not in ('A', 'N', 'R')""",
}
