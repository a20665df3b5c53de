"""Quality rules whose cutoffs are risk controlled, in DataFrame functions only.

A rule rejects texts whose measure exceeds its cutoff. Labelled documents, whose good ones must not be rejected, fix the
cutoffs: within a stratum (lang) and a rule, cutoffs are tried from the laxest down. Each test asks by the exact
binomial tail whether the share of good documents rejected is below `risk`; the first that can't show it ends the
sequence, so a sequence needs no correction, and the levels of all sequences together are corrected by Bonferroni. As a
document is rejected if any rule rejects it, each rule gets an equal part of the stratum's risk, so that all rules of a
stratum together reject less than `risk` of its good documents. A stratum with too few good labels for any certified
cutoff rejects nothing by that rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, let, table, words

#: Cutoffs tried per rule, laxest first. A measure is in [0, 1].
GRID = tuple(x / 20 for x in range(19, 0, -1))
RULES = ("symbol_share", "duplicate_line_share", "repeat_word_share")
RISK, DELTA = 0.05, 0.1


def repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, from an array of words."""
    def of(windows):
        # windows sorted by text, so equal ones are neighbours; the places of the repeated ones in order
        n = F.size(windows)
        twice = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (
            F.coalesce(F.get(windows, j)["t"] == F.get(windows, j - 1)["t"], F.lit(False)) | F.coalesce(F.get(windows, j)["t"] == F.get(windows, j + 1)["t"], F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda j: F.get(windows, j)["i"]))
        return let(places, lambda p: F.when(F.size(p) == 0, 0).otherwise(
            F.aggregate(p, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
                        lambda acc, i: F.struct((acc["sum"] + i + 3 - F.greatest(acc["end"], i)).alias("sum"), (i + 3).alias("end")), lambda acc: acc["sum"])))

    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
        F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))))
    return F.when(F.size(w) < 3, 0).otherwise(let(windows, of)).cast("long")


def measures(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """(id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of whole texts; null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"), counted.alias("c"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
    ).select("id", "stratum", F.col("c.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("c.r").alias("n_repeat_words"), "n_lines")


def rule_measures() -> dict[str, Column]:
    def share(a, b):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    return {"symbol_share": F.least(share("n_symbols", "n_words"), F.lit(1.0)), "duplicate_line_share": share("n_dup_lines", "n_lines"), "repeat_word_share": share("n_repeat_words", "n_words")}


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """P(at most x of n at rate p), summed from logarithms so that large n does not vanish."""
    def step(acc, k):
        log = acc["log"] + F.log((n - k + 1).cast("double") / k) + F.log(F.lit(p / (1 - p)))
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))
    return F.when(x == 0, F.exp(first)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(x, F.lit(1))), start, step, lambda acc: acc["sum"]))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) of the certified cutoffs. measured has id, stratum and the base counts; labels id and good.
    risk is that of a stratum, shared by its rules; delta is the chance that any certificate of any stratum is wrong."""
    risk = risk / len(RULES)
    good = measured.join(labels.where("good").select("id").distinct(), "id")
    m = rule_measures()
    long = good.select("stratum", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), m[r].alias("x")) for r in RULES))).alias("e")).select("stratum", "e.*")
    # a document is rejected at all cutoffs below its measure: count by the laxest one, then add up
    level = F.size(F.filter(F.array(*map(F.lit, GRID)), lambda g: g >= F.col("x")))
    cells = long.groupBy("stratum", "rule", level.alias("level")).agg(F.count("*").alias("c"))
    total = cells.groupBy("stratum", "rule").agg(F.sum("c").alias("n"), F.collect_list(F.struct("level", "c")).alias("cells"))
    sequences = total.agg(F.count("*").alias("sequences")).scalar()
    tried = total.withColumn("sequences", sequences).select("stratum", "rule", "n", "sequences", "cells", F.posexplode(F.array(*map(F.lit, GRID))).alias("k", "cutoff"))
    hits = F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(c["level"] <= F.col("k"), c["c"]).otherwise(0))
    tested = tried.withColumn("x", hits).withColumn("p", F.when(F.col("x") >= F.col("n") * risk, 1.0).otherwise(binomial_tail(F.col("x"), F.col("n"), risk)))
    failed = F.min(F.when(F.col("p") > F.lit(delta) / F.col("sequences"), F.col("k"))).alias("failed")
    ends = tested.groupBy("stratum", "rule").agg(failed, F.collect_list(F.struct("k", "cutoff")).alias("g"))
    passed = F.filter("g", lambda g: F.col("failed").isNull() | (g["k"] < F.col("failed")))
    return ends.select("stratum", "rule", F.array_min(F.transform(passed, lambda g: g["cutoff"])).alias("cutoff")).where("cutoff is not null")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          label_col: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by) per row.

    rejected_by names the rules above their cutoffs. Null texts count as empty and fail the base; null strata form one
    of their own; without labels, or with null ids in them, nothing beyond the base is rejected. Repeated rows are
    judged alike; no row is dropped; columns other than the four named are left alone, whatever they are called. The cutoffs are at most strata x rules rows and reach the rows as one broadcast map.
    """
    measured = cut(measures(docs, id_col, text_col, stratum_col))
    found = cutoffs(measured, labels.select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("good")), risk, delta)
    by_rule = found.groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff"))
    m = rule_measures()
    over = F.filter(F.array(*(F.when(m[r] > F.col(f"cut_{r}"), r) for r in RULES)), lambda x: x.isNotNull())
    joined = measured.join(by_rule.withColumnsRenamed({r: f"cut_{r}" for r in RULES}), "stratum", "left")
    out = joined.withColumn("rejected_by", over).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), F.array_join("rejected_by", ",").alias("rejected_by"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
