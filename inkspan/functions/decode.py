"""Whether a text decoded correctly: Central European bytes read as Western ones, lost glyphs, control characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of the language; those of them that survive the misreading; letters that it cannot produce.
CZECH = "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ"
SHARED, FOREIGN = "áíúýšžÁÍÚÝŠŽ", "àêûœÀÊÛŒ"
#: Hits that make a misreading systematic, or the score below which it is; share of lost characters.
LEAST_HITS, CLEAN_SHARE, LOST_SHARE = 2, 0.9, 0.15


def _both(byte: int) -> tuple[str, str] | None:
    try:
        return bytes([byte]).decode("cp1252"), bytes([byte]).decode("cp1250")
    except UnicodeDecodeError:
        return None


_PAIRS = [p for p in map(_both, range(0x80, 0x100)) if p]
#: What a byte gives when read as Western text where a Czech letter was meant.
MISREADS = {w: e for w, e in _PAIRS if w != e and e in CZECH}
WESTERN = "".join(w for w, _ in _PAIRS)
BEYOND = r"[^\x{00}-\x{7f}]"


def _class(chars: str) -> str:
    return "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def _counts(t: Column, wide: Column) -> dict[str, Column]:
    """What a report is made of; wide tells whether the text has anything beyond ASCII, without which only letters, white
    space and controls are left to tell."""
    def count(pattern: str) -> Column:
        # a run goes in one match, as what is taken out is most of a text
        return F.length(F.regexp_replace(t, pattern + "++", ""))

    outside = r"[^\x{00}-\x{7f}" + "".join(f"\\x{{{ord(c):x}}}" for c in WESTERN) + "]"
    lost = F.length(F.regexp_replace(F.regexp_replace(t, r"[^\x{fffd}\p{Cc}\p{Cf}\p{Co}\p{Cn}]++", ""), r"[\s\x{1c}-\x{1f}\x{85}]++", ""))
    return {"letters": F.when(wide, count(r"[^\p{L}]")).otherwise(count("[^A-Za-z]")), "hits": F.when(wide, count(_class("".join(MISREADS)))).otherwise(0),
            "chars": F.when(wide, count(r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]")).otherwise(count(r"[\s\x{1c}-\x{1f}]")), "bad": F.when(wide, lost).otherwise(count(r"[^\x{00}-\x{08}\x{0e}-\x{1b}\x{7f}]")),
            "encodable": ~(wide & t.rlike(outside)), "foreign": wide & t.rlike(f"[{FOREIGN}]"), "shared": wide & t.rlike(f"[{SHARED}]")}


def _report(n: dict[str, Column]) -> Column:
    none = n["letters"] == 0
    return F.struct(n["letters"].alias("letters"), F.when(none, 0).otherwise(n["hits"]).alias("suspicious"), n["chars"].alias("chars"), n["bad"].alias("bad"),
                    F.when(none, 1.0).otherwise(1.0 - n["hits"] / n["letters"]).alias("score"), *(n[k].alias(k) for k in ("encodable", "foreign", "shared")))


def decode_report(text: Column) -> Column:
    """struct(letters, suspicious, chars, bad, score, encodable, foreign, shared); null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return _report(_counts(t, t.rlike(BEYOND)))


def with_report(lines: DataFrame, text_col: str, name: str) -> DataFrame:
    """lines with the report of a text; the counts are columns of their own first, so that what reads the report makes none anew."""
    own = lines.withColumn("__text", F.coalesce(text_col, F.lit(""))).withColumn("__wide", F.col("__text").rlike(BEYOND))
    counts = _counts(F.col("__text"), F.col("__wide"))
    counted = own.withColumns({f"__{k}": c for k, c in counts.items()})
    return counted.withColumn(name, _report({k: F.col(f"__{k}") for k in counts})).drop("__text", "__wide", *(f"__{k}" for k in counts))


def is_mojibake(r: Column) -> Column:
    """The misreading, on positive evidence: systematic, encodable, with a surviving Czech letter and no foreign one."""
    return ((r["suspicious"] >= LEAST_HITS) | (r["score"] < CLEAN_SHARE)) & r["encodable"] & r["shared"] & ~r["foreign"]


def is_undecodable(r: Column) -> Column:
    return (r["chars"] > 0) & (r["bad"] > LOST_SHARE * r["chars"])


def line_quality(r: Column) -> Column:
    """The lower of the score and the share of characters that are not lost, to four digits."""
    kept = F.when(r["chars"] > 0, 1.0 - r["bad"] / r["chars"]).otherwise(1.0)
    return F.round(F.least(r["score"], kept), 4)


def recovered(text: Column) -> Column:
    """The text with misread letters put right; null unless the report calls it a misreading."""
    western = "".join(w for w, e in _PAIRS if w != e)
    eastern = "".join(e for w, e in _PAIRS if w != e)
    return F.when(is_mojibake(decode_report(text)), F.translate(text, western, eastern))
