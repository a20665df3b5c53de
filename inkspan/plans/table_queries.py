"""Similarity of tables that are made from customers. The distance of trees is no SQL; tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.functions.staging import dealt
from inkspan.operators import table_distance


def _tables(spark, d):
    """A table of four rows per customer, and a reading of it with slips by key: a lost row, a head for a cell, a merged
    cell, misread letters; now and then no table at all."""
    c = dealt(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal"), "c_custkey")
    k = F.col("c_custkey")
    cell = lambda v, tag="td": F.concat(F.lit(f"<{tag}>"), v, F.lit(f"</{tag.split()[0]}>"))
    row = lambda *cells: F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))
    fields = [(F.lit(n), F.col(n).cast("string")) for n in ("c_name", "c_mktsegment", "c_nationkey", "c_acctbal")]
    wrap = lambda *rows: F.concat(F.lit("<html><table><tbody>"), *rows, F.lit("</tbody></table></html>"))
    ref = wrap(*(row(cell(a), cell(b)) for a, b in fields))
    (a0, b0), (a1, b1), (a2, b2), (a3, b3) = fields
    hyp = wrap(row(F.when(k % 3 == 0, cell(a0, "th")).otherwise(cell(a0)), cell(F.translate(b0, "0r", "Oi"))), F.when(k % 4 == 0, "").otherwise(row(cell(a1), cell(b1))),
               F.when(k % 5 == 0, row(F.concat(F.lit('<td colspan="2">'), a2, b2, F.lit("</td>")))).otherwise(row(cell(a2), cell(b2))), row(cell(a3), F.when(k % 2 == 0, cell(b3)).otherwise(cell(F.concat(F.lit("<b>"), b3, F.lit("</b> x"))))))
    return c.select("c_custkey", ref.alias("ref"), F.when(k % 17 != 0, hyp).otherwise("<p>no table</p>").alias("hyp"))


QUERIES = {"teds": lambda s, d: table_distance.teds(_tables(s, d), ["c_custkey"], "ref", "hyp").withColumns({c: F.round(c, 9) for c in ("teds", "teds_structure")})}
ORACLES: dict[str, str] = {}
