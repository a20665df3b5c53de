"""Transcription and calibration metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.staging import staged
from inkspan.functions.text import normalized, words


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate of normalized texts; an empty reference gives 0 against nothing, else 1."""
    return F.when(ref == "", F.when(hyp == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(ref, hyp) / F.length(ref))


def ned(ref: Column, hyp: Column) -> Column:
    return F.coalesce(F.try_divide(F.levenshtein(ref, hyp), F.greatest(F.length(ref), F.length(hyp))), F.lit(0.0))


def wer(ref: Column, hyp: Column) -> Column:
    """Word error rate of normalized texts. Each distinct word of the two becomes one character, so that the built-in
    edit distance serves for words."""
    def letters(w, all_words):
        place = lambda x: F.lpad(F.hex(F.array_position(all_words, x) + 65535), 8, "0")
        return F.array_join(F.transform(w, lambda x: F.decode(F.unhex(place(x)), "UTF-32")), "")

    def distance(pair):
        both = F.array_distinct(F.concat(pair["r"], pair["h"]))
        return F.get(F.transform(F.array(both), lambda a: F.levenshtein(letters(pair["r"], a), letters(pair["h"], a)) / F.size(pair["r"])), F.lit(0))

    pair = F.struct(words(ref).alias("r"), words(hyp).alias("h"))
    return F.when(ref == "", F.when(hyp == "", 0.0).otherwise(1.0)).otherwise(F.get(F.transform(F.array(pair), distance), F.lit(0)))


def score_texts(pairs: DataFrame, ref: str, hyp: str) -> DataFrame:
    """pairs with cer, wer, ned, ref_chars and hyp_chars of the normalized texts in place of the texts."""
    n = pairs.withColumns({"__r": normalized(F.col(ref)), "__h": normalized(F.col(hyp))})
    r, h = F.col("__r"), F.col("__h")
    return n.withColumns({"cer": cer(r, h), "wer": wer(r, h), "ned": ned(r, h), "ref_chars": F.length(r), "hyp_chars": F.length(h)}).drop("__r", "__h", ref, hyp)


def score_models(gold: DataFrame, predictions: DataFrame, models: Sequence[str], keys: Sequence[str], tier: str = "tier") -> DataFrame:
    """(model, tier, n_pages, n_missing, cer, wer, ned): macro averages per model and tier, and under `overall` for all.

    gold has keys, tier and ref; predictions model, keys and hyp; models lists the models. n_missing, given for overall
    only, counts gold pages without a prediction; a prediction without gold is left out. A model with no page has an
    overall row of nulls.
    """
    wanted = gold.select("*", F.explode(F.array(*(F.lit(m) for m in models)))).withColumnRenamed("col", "model")
    both = wanted.join(predictions.withColumn("__there", F.lit(True)), ["model", *keys], "left")
    scored = score_texts(both, "ref", "hyp")
    hit = F.col("__there").isNotNull()
    rows = scored.select("model", F.explode(F.array(F.col(tier), F.lit("overall"))).alias(tier), hit.alias("hit"), "cer", "wer", "ned")
    means = [F.avg(F.when(F.col("hit"), F.col(c))).alias(c) for c in ("cer", "wer", "ned")]
    out = rows.groupBy("model", tier).agg(F.count_if("hit").alias("n_pages"), F.count_if(~F.col("hit")).alias("n_missing"), *means)
    return out.where((F.col(tier) == "overall") | (F.col("n_pages") > 0)).withColumn("n_missing", F.when(F.col(tier) == "overall", F.col("n_missing")))


def multiset_prf(ref: DataFrame, hyp: DataFrame, key: str, kind: str, item: str) -> DataFrame:
    """tp, n_ref, n_hyp, precision, recall and f1 over multisets of (kind, normalized lower-case item) per key; shares of
    nothing are 0."""
    def counted(rows, name):
        return rows.select(key, F.col(kind).alias("__kind"), normalized(F.col(item), True).alias("__item")).groupBy(key, "__kind", "__item").agg(F.count("*").alias(name))

    both = counted(ref, "a").join(counted(hyp, "b"), [key, "__kind", "__item"], "full").groupBy(key).agg(
        F.sum(F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))).alias("tp"), F.coalesce(F.sum("a"), F.lit(0)).alias("n_ref"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_hyp"))
    p, r = F.coalesce(F.try_divide("tp", "n_hyp"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "n_ref"), F.lit(0.0))
    return both.withColumns({"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))})


def brier_score(rows: DataFrame, probabilities: str, gold: str) -> DataFrame:
    """(n, brier): the mean over rows of the squared gaps between each option's probability (a map) and its truth."""
    gaps = F.aggregate(F.transform(F.map_entries(probabilities), lambda e: F.pow(e["value"] - F.when(e["key"] == F.col(gold), 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda x, y: x + y)
    return rows.where(F.col(gold).isNotNull()).agg(F.count("*").alias("n"), F.avg(gaps).alias("brier"))


def mcnemar_exact(rows: DataFrame, first: str, second: str) -> DataFrame:
    """(b, c, p): pairs that only the first, or only the second, has right, and the two-sided exact probability."""
    f, s = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    n = F.col("b") + F.col("c")
    step = lambda acc, k: F.struct((acc["log"] + F.log((n - k + 1).cast("double") / k)).alias("log"), (acc["sum"] + F.exp(acc["log"] + F.log((n - k + 1).cast("double") / k))).alias("sum"))
    zero = n.cast("double") * F.lit(math.log(0.5))
    least = F.least("b", "c")
    ks = F.when(least > 0, F.sequence(F.lit(1).cast("long"), least)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(ks, F.struct(zero.alias("log"), F.exp(zero).alias("sum")), step, lambda acc: acc["sum"])
    return rows.agg(F.count_if(f & ~s).alias("b"), F.count_if(~f & s).alias("c")).withColumn("p", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))


def reliability_bins(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(bin, n, hits, mean_confidence): equal-width bins (0, 1/bins], ..., of which the first takes 0 too."""
    b = F.greatest(F.lit(0), F.least(F.ceil(F.col(confidence) * bins) - 1, F.lit(bins - 1))).cast("int")
    return rows.where(F.col(confidence).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(correct, F.lit(False))).alias("hits"), F.avg(confidence).alias("mean_confidence"))


def expected_calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(n, ece): the mean gap between share of hits and mean confidence over the bins, weighted by size; null for no rows."""
    b = reliability_bins(rows, confidence, correct, bins)
    gap = F.abs(F.col("hits") / F.col("n") - F.col("mean_confidence")) * F.col("n")
    return b.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.try_divide(F.sum(gap), F.sum("n")).alias("ece"))


def coverage_curve(rows: DataFrame, confidence: str, correct: str) -> DataFrame:
    """(threshold, coverage, error) per distinct confidence: the share of rows at or above it, and of wrong ones among them.

    Null confidences are left out, a null verdict counts as wrong. Distinct confidences are dealt out by ranges of equal
    numbers; running sums go within a range and over the ranges' totals, so that neither depends on how values crowd.
    """
    from pyspark.sql import Window

    at = rows.where(F.col(confidence).isNotNull()).groupBy(F.col(confidence).alias("threshold")).agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce(F.col(correct), F.lit(False))).alias("wrong"))
    at = staged(at.repartitionByRange(F.desc("threshold")).withColumn("slice", F.spark_partition_id()))
    total = at.groupBy("slice").agg(F.sum("n").alias("n"), F.sum("wrong").alias("wrong"))
    above = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    start = total.select("slice", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "wrong")],
                         F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_n"))
    down = Window.partitionBy("slice").orderBy(F.desc("threshold"))
    run = at.join(start, "slice").select("threshold", "all_n", (F.sum("n").over(down) + F.col("n_above")).alias("k"), (F.sum("wrong").over(down) + F.col("wrong_above")).alias("bad"))
    return run.select("threshold", (F.col("k") / F.col("all_n")).alias("coverage"), (F.col("bad") / F.col("k")).alias("error"))


def threshold_grid(rows: DataFrame, first: str, second: str, cuts: Sequence[float], others: Sequence[float], good: str) -> DataFrame:
    """(first_cut, second_cut, n, good): for each pair of cuts how many rows have first and second at or above them, and
    how many of these are good.

    One pass counts rows by the last cut they reach on either axis, a table as small as the grid; its sums from above
    along both axes are the grid's cells. Null measures reach no cut, a null verdict is not good; cuts must not repeat.
    """
    def reached(c: str, at: Sequence[float]) -> Column:
        return F.aggregate(F.array(*(F.lit(float(x)) for x in sorted(at))), F.lit(0), lambda acc, x: acc + F.when(F.col(c) >= x, 1).otherwise(0))

    from pyspark.sql import Window

    cells = rows.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(reached(first, cuts).alias("i"), reached(second, others).alias("j")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(good), F.lit(False))).alias("good"))
    spark = rows.sparkSession
    axes = [spark.createDataFrame(list(enumerate(sorted(map(float, c)), 1)), f"{k} int, {name} double") for k, name, c in (("i", "first_cut", cuts), ("j", "second_cut", others))]
    grid = axes[0].crossJoin(axes[1]).join(cells, ["i", "j"], "left").select("i", "j", "first_cut", "second_cut", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "good")))
    for fixed, along in (("i", "j"), ("j", "i")):
        grid = grid.withColumns({c: F.sum(c).over(Window.partitionBy(fixed).orderBy(F.desc(along))) for c in ("n", "good")})
    return grid.select("first_cut", "second_cut", "n", "good")


def pick_threshold(curve: DataFrame, target_error: float) -> DataFrame:
    """The row of the curve with the lowest threshold whose error is at most the target; no row if none is."""
    best = curve.where(F.col("error") <= target_error).agg(F.min(F.struct("threshold", "coverage", "error")).alias("best"))
    return best.where("best is not null").select("best.*")
