"""Quality summaries and tiers of documents or pages from their scored lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.lines import CATEGORIES, JUDGED, category, category_score

#: Groups that a tier is dealt to before its first rows are taken.
SALT = 256


def scored_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("categ", category(F.col("text"))).withColumn("quality_score", category_score(F.col("categ")))


def line_summary(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """num_lines, a count per category and the mean score of Clear and Noisy lines (null if there are none), per key."""
    counts = [F.count_if(F.col("categ") == c).alias(c.lower().replace("-", "_")) for c in CATEGORIES]
    valid = F.col("categ").isin("Clear", "Noisy")
    return scored.groupBy(*keys).agg(F.count("*").alias("num_lines"), *counts, F.avg(F.when(valid, F.col("quality_score"))).alias("avg_quality_score"))


def quality_band(clear: Column, noisy: Column, trash: Column) -> Column:
    """The most frequent of the judged categories, the better one among equals; null if none was judged."""
    return F.when(clear + noisy + trash == 0, None).when((clear >= noisy) & (clear >= trash), "Clear").when(noisy >= trash, "Noisy").otherwise("Trash")


def page_quality(scored: DataFrame, keys: Sequence[str], prose: Column, lang: str | None = None, digits: int = 4) -> DataFrame:
    """(keys, score, band, lines_scored, trash, prose_scored, prose_trash, lang) of what a quality model judged.

    score is the mean over Clear, Noisy and Trash lines, rounded; the prose counts take prose lines only; lang is
    the most frequent language of judged lines but N/A (the first by name among equals). Pages without a line are absent.
    """
    judged, trash = F.col("categ").isin(*JUDGED), F.col("categ") == "Trash"
    n = {c: F.count_if(F.col("categ") == c) for c in JUDGED}
    out = scored.groupBy(*keys).agg(
        F.round(F.avg(F.when(judged, F.col("quality_score"))), digits).alias("score"), quality_band(*n.values()).alias("band"), F.count_if(judged).alias("lines_scored"),
        F.count_if(trash).alias("trash"), F.count_if(judged & prose).alias("prose_scored"), F.count_if(trash & prose).alias("prose_trash"))
    if lang is None:
        return out
    votes = scored.where(judged & F.col(lang).isNotNull() & (F.col(lang) != "N/A")).groupBy(*keys, lang).agg(F.count("*").alias("votes"))
    best = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col(lang).alias("lang")))["lang"].alias("lang"))
    return out.join(best, list(keys), "left")


def tier(clean_min: float = 0.85, degraded_min: float = 0.6, valid_ratio_min: float = 0.5) -> Column:
    """clean, degraded, hard or text_poor (no score). NaN counts as no score."""
    score = F.nanvl("avg_quality_score", F.lit(None).cast("double"))
    valid = F.try_divide(F.col("clear") + F.col("noisy"), F.col("num_lines"))
    return F.when(score.isNull(), "text_poor").when((score >= clean_min) & (valid >= valid_ratio_min), "clean").when(score >= degraded_min, "degraded").otherwise("hard")


def equal_tier_sample(tiered: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """About n rows with the same number per tier that occurs, in the order of a seeded hash; a small tier gives all it has.

    A tier is ranked in SALT groups first; what each keeps holds the first of the whole, which are then ranked again.
    """
    tiers = tiered.agg(F.count_distinct("tier").alias("k")).scalar()
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]
    per = tiered.withColumn("k", tiers).withColumn("per", F.greatest(F.lit(1), F.floor(F.lit(n) / F.greatest("k", F.lit(1))))).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALT)))
    first = per.withColumn("pick", F.row_number().over(Window.partitionBy("tier", "salt").orderBy(*order))).where("pick <= per")
    return first.withColumn("pick", F.row_number().over(Window.partitionBy("tier").orderBy(*order))).where("pick <= per").drop("k", "per", "salt")


def splits(sampled: DataFrame, train: float = 0.8, dev: float = 0.1) -> DataFrame:
    """split of each sampled row: by its place in its tier, so that every tier is in every split it is large enough for."""
    n = F.count("*").over(Window.partitionBy("tier"))
    a, b = F.rint(n * train), F.rint(n * dev)
    return sampled.withColumn("split", F.when(F.col("pick") <= a, "train").when(F.col("pick") <= a + b, "dev").otherwise("test"))
