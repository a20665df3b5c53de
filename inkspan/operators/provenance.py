"""Records of what was run, folded per file and per run, and nodes of graphs merged by id.

All results are tables whose rows are merged on the way to their key by sums, minima, maxima and values by order, so they do
not hang on the partitioning, and no run, file or node is held as a list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of an action, ids of a graph's descriptor and root, what a text of JSON is when empty.
COMPLETED, FAILED = "CompletedActionStatus", "FailedActionStatus"
DESCRIPTOR, ROOT = "ro-crate-metadata.json", "./"
EMPTY = ("null", '""', "[]", "{}")


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _said(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _seconds(column: str) -> Column:
    """Their sum to three places: in decimals, as a sum of floating numbers hangs on its order."""
    return F.round(F.coalesce(F.sum(F.col(column).cast("decimal(28,9)")), F.lit(0)), 3).cast("double")


def folded_runs(stages: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """One row per run: stage_count, program, repository, tool_version, action_status, start_time, end_time,
    total_duration_seconds, input_files_total, successfully_processed, skipped_files.

    stages has key, order and those names but for stage_count and total_duration_seconds, with duration_seconds. program is
    the first stage's; repository and tool_version are the first that say something; inputs are the first stage's,
    what was processed the last one's, both 0 if not told; skipped files and durations are summed; the run failed if any
    stage did; times are texts that sort, empty if no stage tells. order must be whole and part a run's stages.
    """
    keys = _keys(key)
    first = lambda c: F.coalesce(F.min_by(F.col(c), F.when(_said(F.col(c)).isNotNull(), F.col(order))), F.lit(""))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return stages.groupBy(*keys).agg(
        F.count("*").alias("stage_count"), F.min_by("program", order).alias("program"), first("repository").alias("repository"), first("tool_version").alias("tool_version"),
        F.when(F.max(F.coalesce(F.col("action_status") == FAILED, F.lit(False))), FAILED).otherwise(COMPLETED).alias("action_status"),
        F.coalesce(F.min(_said(F.col("start_time"))), F.lit("")).alias("start_time"), F.coalesce(F.max(_said(F.col("end_time"))), F.lit("")).alias("end_time"), _seconds("duration_seconds").alias("total_duration_seconds"),
        F.min_by(number("input_files_total"), order).alias("input_files_total"), F.max_by(number("successfully_processed"), order).alias("successfully_processed"), F.sum(number("skipped_files")).alias("skipped_files"),
    )


def output_formats(stages: DataFrame, key: str | Sequence[str], counts: str = "outputs") -> DataFrame:
    """(key, format, files): outputs of a run by type, from a map of counts per stage; null counts are 0."""
    t = stages.select(*_keys(key), F.explode(counts).alias("format", "n"))
    return t.groupBy(*_keys(key), "format").agg(F.sum(F.coalesce("n", F.lit(0)).cast("long")).alias("files"))


def components_used(stages: DataFrame, key: str | Sequence[str], order: str, components: str = "components") -> DataFrame:
    """(key, first_stage, first_place, component): the distinct components of a file or run, where each is listed first; by
    stage and place they have the order of their union. Null components and null lists have none."""
    t = stages.select(*_keys(key), F.col(order).alias("stage"), F.posexplode(components).alias("place", "component")).where("component is not null")
    at = F.min(F.struct("stage", "place"))
    return t.groupBy(*_keys(key), "component").agg(at.alias("at")).select(*_keys(key), F.col("at.stage").alias("first_stage"), F.col("at.place").alias("first_place"), "component")


def folded_files(steps: DataFrame, file: str) -> DataFrame:
    """(input_file, step_count, total_duration_seconds) per file, by its name without folders. A file's steps are the rows
    of `steps` themselves, in their order; components_used has its components."""
    name = F.regexp_extract(F.col(file), "([^/]*)$", 1)
    return steps.groupBy(name.alias("input_file")).agg(F.count("*").alias("step_count"), _seconds("duration_seconds").alias("total_duration_seconds"))


def merged_attributes(nodes: DataFrame, key: str | Sequence[str], order: str, attributes: str = "attributes") -> DataFrame:
    """(key, name, value): attributes of the nodes that share a key, value being a text of JSON.

    nodes has a map of names to such texts per description. The first description of a node counts whole; later ones,
    by order, override it where they say something, and what they leave empty (null or an empty text, list or object)
    changes nothing. A node without attributes has one row, with null name. Orders must part a node's descriptions.
    """
    keys = _keys(key)
    t = nodes.select(*keys, F.col(order).alias("at"), F.explode_outer(attributes).alias("name", "value"))
    value = F.coalesce(F.regexp_replace("value", r"^\s+|\s+$", ""), F.lit("null"))
    t = t.withColumn("value", F.when(F.col("name").isNotNull(), value))
    said = F.when(~F.col("value").isin(*EMPTY), F.col("at"))
    merged = t.groupBy(*keys, "name").agg(F.max_by("value", said).alias("said"), F.min("at").alias("since"), F.min_by("value", "at").alias("bare"))
    own = Window.partitionBy(*keys)
    # a row per name is left of a node's descriptions
    m = merged.withColumn("first", F.min("since").over(own))
    kept = F.col("said").isNotNull() | F.col("name").isNotNull() & (F.col("since") == F.col("first"))
    m = m.withColumn("kept", kept).withColumn("any", F.max("kept").over(own)).where(F.col("kept") | F.col("name").isNull() & ~F.col("any"))
    bare = F.col("name").isNull() & F.col("any")
    return m.where(~bare).select(*keys, "name", F.coalesce("said", "bare").alias("value"))


def merged_nodes(nodes: DataFrame, graph: str, node: str, order: str, attributes: str = "attributes", conforms: str | None = None) -> DataFrame:
    """(graph, rank, node, entity): each graph's nodes, merged as merged_attributes does, as texts of JSON with names in
    order behind the id; by rank and node they have the order of the finished graph: descriptor, root, then the rest.

    With conforms, each graph gets its descriptor, which takes the place of any node of that id. Node ids must not be
    null; names are kept as they are but for @id, which is the node's own.
    """
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    a = merged_attributes(nodes.where(F.col(node).isNotNull()), [graph, node], order, attributes)
    pair = F.when(F.col("name").isNotNull() & (F.col("name") != "@id"), F.struct("name", F.concat(quoted(F.col("name")), F.lit(": "), "value").alias("text")))
    body = F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["text"])
    out = a.groupBy(graph, node).agg(F.concat(F.lit("{"), F.array_join(F.concat(F.array(F.concat(F.lit('"@id": '), quoted(F.first(node)))), body), ", "), F.lit("}")).alias("entity"))
    if conforms is not None:
        text = F.concat(F.lit(f'{{"@id": "{DESCRIPTOR}", "@type": "CreativeWork", "about": {{"@id": "{ROOT}"}}, "conformsTo": {{"@id": '), quoted(F.lit(conforms)), F.lit("}}"))
        out = out.where(F.col(node) != DESCRIPTOR).unionByName(nodes.select(graph).distinct().select(graph, F.lit(DESCRIPTOR).alias(node), text.alias("entity")))
    rank = F.when(F.col(node) == DESCRIPTOR, 0).when(F.col(node) == ROOT, 1).otherwise(2)
    return out.select(graph, rank.alias("rank"), node, "entity")
