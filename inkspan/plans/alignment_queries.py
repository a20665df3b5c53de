"""Queries that align two readings of the benchmark's texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.functions.staging import staged
from inkspan.operators import alignment
from inkspan.plans.geometry_queries import KEYS, _UNITS, _units


def _words(spark, d):
    """Words of each item in lines of seven, and of a reading of it that lost, changed and repeated some."""
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    w = b.select("item_id", F.posexplode(F.split("text", r"\s+")).alias("k", "w")).withColumn("line", F.floor(F.col("k") / 7))
    n = F.col("k") + F.col("item_id")
    read = w.where(n % 11 != 0).withColumn("w", F.when(n % 13 == 0, F.concat("w", F.lit("x"))).otherwise(F.col("w"))).withColumn("again", F.explode(F.when(n % 17 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    read = read.select("item_id", (F.col("k") * 2 + F.col("again")).alias("k"), "w", F.floor(F.col("k") / 40).alias("page"), F.floor(F.col("k") / 5).alias("row"))
    return w, read


def _pairs(spark, d):
    return alignment.aligned(*_words(spark, d), ["item_id"], "k", "w")


def _segments(spark, d):
    """Lines placed by their words of the same number, so that SQL can say the same."""
    w, read = _words(spark, d)
    same = w.join(read.where("k % 2 = 0").select("item_id", (F.col("k") / 2).cast("int").alias("k"), F.col("k").alias("right"), F.col("w").alias("said")), ["item_id", "k"]).where("w = said").select("item_id", F.col("k").alias("left"), "right")
    return alignment.line_segments(w, same, read, ["item_id"], "line", "k", "w")


def _compared(spark, d):
    # both sides come from the units, which cost more to make than to keep
    units = staged(_units(spark, d).select((F.col("doc_id") * 1000 + F.col("page")).alias("page"), "unit", "text", "x0", "x1"))
    other = units.where("unit % 9 <> 4").withColumns({"x1": F.col("x1") + F.col("unit") % 3, "text": F.when(F.col("unit") % 10 == 7, F.concat(F.lit("  "), "text", F.lit("!"))).otherwise(F.concat(F.lit(" "), "text"))})
    return alignment.compared(units, other, "page", "text", ["x0", "x1"], "unit")


QUERIES = {
    "aligned_words": lambda s, d: _pairs(s, d).groupBy("item_id").agg(F.count("*").alias("n")),
    "aligned_segments": _segments,
    "extractions_compared": _compared,
}

_READ = r"""w0 as (select item_id, generate_subscripts(string_split_regex(text, '\s+'), 1) - 1 as k, unnest(string_split_regex(text, '\s+')) as w from benchmark), w1 as (select *, k // 7 as line, k + item_id as n from w0),
r0 as (select item_id, k as pos, case when n % 13 = 0 then w || 'x' else w end as w, unnest(range(case when n % 17 = 0 then 2 else 1 end)) as again, k // 40 as page, k // 5 as row from w1 where n % 11 <> 0), r as (select *, pos * 2 + again as k from r0)"""
ORACLES = {
    "aligned_words": f"""with recursive {_READ}, a as (select item_id, list(w order by k) as a from w1 where w <> '' group by 1), b as (select item_id, list(w order by k) as b from r where w <> '' group by 1), s as (select * from a join b using (item_id)),
dp as (select item_id, a, b, 0 as i, list_transform(range(len(b) + 1), lambda j: 0::bigint) as line from s
  union all select item_id, a, b, i + 1, list_reduce(list_prepend([0::bigint], list_transform(range(1, len(b) + 1), lambda j: [j])), lambda acc, j: list_append(acc, case when a[i + 1] = b[j[1]] then line[j[1]] + 1 else greatest(line[j[1] + 1], acc[j[1]]) end)) from dp where i < len(a))
select item_id, line[-1] as n from dp where i = len(a) and line[-1] > 0""",
    "aligned_segments": f"""with {_READ}, m as (select w1.*, case when r.w = w1.w then page end as page, case when r.w = w1.w then row end as row from w1 left join r on r.item_id = w1.item_id and r.k = w1.k * 2),
f as (select *, coalesce(last_value(page ignore nulls) over o, first_value(page ignore nulls) over l) as p, coalesce(last_value(row ignore nulls) over o, first_value(row ignore nulls) over l) as q from m window o as (partition by item_id, line order by k), l as (partition by item_id, line order by k rows between unbounded preceding and unbounded following)),
c as (select *, (row_number() over o > 1 and ((lag(p) over o) is distinct from p or (lag(q) over o) is distinct from q))::int as cut from f window o as (partition by item_id, line order by k)),
g as (select item_id, line, k, w, p, q, cast(sum(cut) over (partition by item_id, line order by k) as integer) as segment from c), t as (select item_id, line, segment, string_agg(w, ' ' order by k) as text, any_value(p) as p, any_value(q) as q from g group by all)
select item_id, line, segment, coalesce(p, last_value(p ignore nulls) over (partition by item_id order by line, segment), last_value(p ignore nulls) over (partition by item_id order by line desc, segment desc)) as page, q as row, text from t""",
    "extractions_compared": rf"""with {_UNITS}, a0 as (select doc_id * 1000 + page as page, unit, text, x0, x1 from units), b0 as (select page, unit, case when unit % 10 = 7 then text || '!' else text end as text, x0, x1 + unit % 3 as x1 from a0 where unit % 9 <> 4),
a as (select page, trim(regexp_replace(text, '\s+', ' ', 'g')) as key, arg_max(x0, unit) as x0, arg_max(x1, unit) as x1 from a0 group by all), b as (select page, trim(regexp_replace(text, '\s+', ' ', 'g')) as key, arg_max(x0, unit) as x0, arg_max(x1, unit) as x1 from b0 group by all)
select page, key, case when a.x0 is null then 'right' when b.x0 is null then 'left' else 'both' end as side, case when a.x0 is not null and b.x0 is not null then greatest(abs(a.x0 - b.x0), abs(a.x1 - b.x1)) end as delta from a full join b using (page, key)""",
}
