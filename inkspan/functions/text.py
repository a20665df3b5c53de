"""Text normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Fixed value: white space as Unicode text splitting takes it (both Java and RE2 read it).
WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters, for texts in a task.
WHITES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: line separators besides CRLF that become a line feed; the form feed stays, as it ends a page.
LINE_ENDS = "\r\x0b\x1c\x1d\x1e\x85\u2028\u2029"

#: Two spaces, or a character that may be white space but is no space.
_NOT_PLAIN = r"[^ -~\x{a1}-\x{167f}\x{1681}-\x{1fff}\x{3001}-\x{10ffff}]|  "
_ANY_END = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in LINE_ENDS) + "]"


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, which Spark has no function for; one Arrow batch at a time."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def collapsed(text: Column) -> Column:
    """White space runs as one space, trimmed; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # most texts have single spaces only, which one look at plain ranges tells
    return F.trim(F.when(text.rlike(_NOT_PLAIN), F.regexp_replace(text, f"{WHITE}+", " ")).otherwise(text))


def normalized(text: Column, lowercase: bool = False) -> Column:
    """NFC, if wanted in lower case, white space collapsed."""
    out = nfc(F.coalesce(text, F.lit("")))
    return collapsed(F.lower(out) if lowercase else out)


def newlines(text: Column) -> Column:
    # translation takes characters one by one, so it is for texts that have one of them
    even = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), LINE_ENDS, "\n" * len(LINE_ENDS))
    return F.when(text.rlike(_ANY_END), even).otherwise(text)


def words(text: Column) -> Column:
    """Words of collapsed text; none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WHITE}+|{WHITE}+$", "")


def natural_key(text: Column) -> Column:
    """A string that sorts texts with numbers by value: runs of digits become their length (as a letter) and digits."""
    low = F.lower(F.coalesce(text, F.lit("")))
    parts = F.regexp_extract_all(low, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.concat(F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(p)).cast("string"), 4, "0"), number(p))).otherwise(p)), "\x02"), F.lit("\x01"), F.coalesce(text, F.lit("")))
