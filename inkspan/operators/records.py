"""Keyed record operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keyed_upsert(base: DataFrame, new: DataFrame, key: str, owned: Sequence[str], order: str) -> DataFrame:
    """base with new's rows merged in by key. Of new rows with equal keys the last by `order` holds. A matched row takes
    all owned columns from it, nulls too, and keeps the others; a row that is new has its key and owned columns only."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*owned), order).alias("patch")).alias("n")
    b, there = base.withColumn("__there", F.lit(True)).alias("b"), F.col("n.patch").isNotNull()
    cols = [F.coalesce(f"b.{c}", f"n.{c}").alias(c) if c == key else F.when(there, F.col(f"n.patch.{c}")).otherwise(F.col(f"b.{c}")).alias(c) if c in owned else F.col(f"b.{c}") for c in base.columns]
    return b.join(last, F.col(f"b.{key}") == F.col(f"n.{key}"), "full").select(*cols)


def replace_block(base: DataFrame, new: DataFrame, record: str) -> DataFrame:
    """base, whose rows of each record that new has are replaced by new's."""
    return base.join(new.select(record).distinct(), record, "left_anti").unionByName(new)


def fold_records(parts: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """(key, fields, conflicts): per field the first value by order that is there; conflicts lists, by name, fields for
    which later parts have another value."""
    aggs = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    apart = [(F.min(f) != F.max(f)).alias(f"__{f}") for f in fields]
    out = parts.groupBy(key).agg(*aggs, *apart)
    found = F.filter(F.array(*(F.when(F.col(f"__{f}"), F.lit(f)) for f in sorted(fields))), lambda x: x.isNotNull())
    return out.withColumn("conflicts", F.array_join(found, ",")).select(key, *fields, "conflicts")


def merge_records(parts: DataFrame, key: str, order: str, source: Sequence[str], descriptive: Sequence[str], blocks: Sequence[str]) -> DataFrame:
    """(key, source, descriptive, blocks, conflicts, status) of the partial records of a key, taken in order.

    A field of the source keeps the first value that is there, a block takes the last one; null stands for absent.
    Source fields with different values, but for descriptive ones, are listed in conflicts, by name, and make the record
    an error: its status is conflict and it has no values. Minima and maxima by order are merged on the way, so a key
    with very many parts costs one row per task.
    """
    first = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in (*source, *descriptive)]
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in blocks]
    apart = [(F.min(f) != F.max(f)).alias(f"__{f}") for f in source]
    out = parts.groupBy(key).agg(*first, *last, *apart)
    found = F.filter(F.array(*(F.when(F.col(f"__{f}"), F.lit(f)) for f in sorted(source))), lambda x: x.isNotNull())
    out = out.withColumn("conflicts", F.array_join(found, ",")).withColumn("status", F.when(F.col("conflicts") == "", "ok").otherwise("conflict"))
    return out.select(key, *(F.when(F.col("status") == "ok", F.col(f)).alias(f) for f in (*source, *descriptive, *blocks)), "conflicts", "status")


def record_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, change, fields): added, removed or changed rows of two versions, with the names of the changed fields."""
    o, n = old.withColumn("__o", F.lit(True)).alias("o"), new.withColumn("__n", F.lit(True)).alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    names = F.filter(F.array(*(F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in sorted(fields))), lambda x: x.isNotNull())
    change = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(F.size(names) > 0, "changed")
    return j.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), change.alias("change"), F.when(change == "changed", F.array_join(names, ",")).otherwise("").alias("fields")).where("change is not null")


def ordered_distinct(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """(keys, value, place): the distinct values of a key by their first occurrence, counted from 1."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("__first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("__first", value))).drop("__first")


def unreferenced(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose key no row of parent has; null keys among them."""
    return child.join(parent.select(key), key, "left_anti")


def consecutive_ranges(rows: DataFrame, value: str, keys: Sequence[str] = (), block: int = 4096) -> DataFrame:
    """(keys, first, last, n): runs of consecutive whole numbers.

    Runs are found in blocks of the values first; what is left of a block's runs, one per gap in it, is then joined in
    order, so no task ranks all values of a key.
    """
    cells = rows.select(*keys, value).where(F.col(value).isNotNull()).distinct().withColumn("b", F.floor(F.col(value) / block))
    w = Window.partitionBy(*keys, "b").orderBy(value)
    inner = cells.withColumn("g", F.col(value) - F.row_number().over(w)).groupBy(*keys, "b", "g").agg(F.min(value).alias("first"), F.max(value).alias("last"))
    order = Window.partitionBy(*keys).orderBy("first")
    opens = F.coalesce(F.lag("last").over(order) + 1 != F.col("first"), F.lit(True)).cast("int")
    run = inner.withColumn("o", opens).withColumn("run", F.sum("o").over(order))
    return run.groupBy(*keys, "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).withColumn("n", F.col("last") - F.col("first") + 1).drop("run")


def top_k(rows: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
