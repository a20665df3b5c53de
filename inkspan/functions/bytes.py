"""Bytes to text: marks of byte order, UTF-16 told by its zeros, UTF-8, and legacy code pages, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Byte order marks, the first that fits counts; legacy code pages in the order they are tried.
MARKS = (("0000FEFF", "utf-32-be"), ("FFFE0000", "utf-32-le"), ("EFBBBF", "utf-8"), ("FFFE", "utf-16-le"), ("FEFF", "utf-16-be"))
PAGES = ("cp1250", "iso8859_2", "cp1252")
#: Bytes looked at for zeros by parity, and for control bytes; shares that tell UTF-16 and binary.
PARITY_HEAD, BINARY_HEAD = 4096, 65536
MANY_ZEROS, FEW_ZEROS, CONTROLS = 0.4, 0.1, 0.1


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _page_letters(page: str) -> tuple[str, str, str]:
    """What the upper half of a code page's bytes is as Latin-1 and as its own letters, and the bytes without a letter."""
    latin, own, free = "", "", ""
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(page)
            latin, own = latin + chr(b), own + c
        except UnicodeDecodeError:
            free += chr(b)
    return latin, own, free


def _units(hexed: Column, little: bool, wide: bool) -> Column:
    """Code units as hex in big-endian order; of UTF-16 a pair of surrogates is one unit."""
    if wide:
        units = F.regexp_extract_all(hexed, F.lit(".{8}"), F.lit(0))
        return F.transform(units, lambda u: F.concat(*(F.substr(u, F.lit(k), F.lit(2)) for k in (7, 5, 3, 1)))) if little else units
    pair = "..D[89AB]..D[C-F]" if little else "D[89AB]..D[C-F].."
    units = F.regexp_extract_all(hexed, F.lit(f"{pair}|.{{4}}"), F.lit(0))
    turn = lambda u: F.concat(F.substr(u, F.lit(3), F.lit(2)), F.substr(u, F.lit(1), F.lit(2)), F.substr(u, F.lit(7), F.lit(2)), F.substr(u, F.lit(5), F.lit(2)))
    return F.transform(units, turn) if little else units


def _wide_text(data: Column, little: bool, wide: bool) -> Column:
    """struct(text, sound): UTF-16 or UTF-32, what does not decode as the replacement character."""
    size = 4 if wide else 2

    def decoded(units):
        lone = (lambda u: ~u.rlike("^00(?:0[0-9A-F]|10)") | u.rlike("^0000D[89A-F]")) if wide else (lambda u: (F.length(u) == 4) & u.rlike("^D[89A-F]"))
        good = F.transform(units, lambda u: F.when(lone(u), F.lit("0000FFFD" if wide else "FFFD")).otherwise(u))
        rest = F.length(data) % size != 0
        text = F.concat(F.decode(F.unhex(F.array_join(good, "")), "UTF-32" if wide else "UTF-16BE"), F.when(rest, "�").otherwise(""))
        return F.struct(text.alias("text"), (~F.exists(units, lone) & ~rest).alias("sound"))

    return _let(_units(F.hex(data), little, wide), decoded)


def utf16_guess(data: Column) -> Column:
    """utf-16-le or utf-16-be for bytes whose zeros stand at one parity, as those of Latin text do; else null."""
    def told(head):
        def share(group: int) -> Column:
            all_ = F.filter(F.regexp_extract_all(head, F.lit("(..)(..)?"), F.lit(group)), lambda b: b != "")
            return F.size(F.filter(all_, lambda b: b == "00")) / F.size(all_)

        even, odd = share(1), share(2)
        return F.when(F.length(head) < 8, None).when((odd > MANY_ZEROS) & (even < FEW_ZEROS), "utf-16-le").when((even > MANY_ZEROS) & (odd < FEW_ZEROS), "utf-16-be")

    return _let(F.hex(F.substr(data, F.lit(1), F.lit(PARITY_HEAD))), told)


def looks_binary(data: Column) -> Column:
    """Whether the head of bytes has zeros beyond one in a hundred, or control bytes beyond a tenth."""
    def told(head):
        n = F.length(head)
        zeros = n - F.length(F.replace(head, F.lit("\0"), F.lit("")))
        controls = n - F.length(F.regexp_replace(head, r"[\x00-\x08\x0E-\x1A\x1C-\x1F]", ""))
        return (n > 0) & ((zeros > F.greatest(F.lit(1), F.floor(n / 100))) | (controls > CONTROLS * n))

    return _let(F.decode(F.substr(data, F.lit(1), F.lit(BINARY_HEAD)), "ISO-8859-1"), told)


def decode_bytes(data: Column, pages: Sequence[str] = PAGES) -> Column:
    """struct(text, encoding, flags, status) of bytes: by their mark, by zeros at one parity, as strict UTF-8, else by
    the first code page that has a letter for each byte.

    status is ok, binary_content (no text: zeros or control bytes without a mark), or decode_failed (no page to try).
    flags, comma-joined: utf16_without_bom, encoding_fallback, decode_replacement (bytes that fit nowhere became the
    replacement character). Null bytes give null; no bytes are empty UTF-8. Charset detection, which the fallback
    would try first where a detector is installed, has no counterpart here.
    """
    def result(text, encoding, flags="", status="ok"):
        return F.struct(*(x.alias(n) for x, n in zip((text, *(F.lit(v) if isinstance(v, str) else v for v in (encoding, flags, status))), ("text", "encoding", "flags", "status"))))

    def of_wide(rest, encoding, flags=""):
        kind = (encoding.endswith("le"), "32" in encoding)
        return _let(_wide_text(rest, *kind), lambda x: result(x["text"], encoding, F.when(x["sound"], flags).otherwise("decode_replacement")))

    none = F.lit(None).cast("string")
    utf8 = data.cast("string")
    # what no page takes wholly goes by the first one, with replacement characters
    fallback = result(none, none, "", "decode_failed")
    if pages:
        latin, own, free = _page_letters(pages[0])
        one = F.decode(data, "ISO-8859-1")
        fallback = result(F.translate(one, latin + free, own + "�" * len(free)), pages[0], "decode_replacement")
        for page in reversed(pages):
            latin, own, free = _page_letters(page)
            fits = ~one.rlike(f"[{free}]") if free else F.lit(True)
            fallback = F.when(fits, result(F.translate(one, latin, own), page, "encoding_fallback")).otherwise(fallback)
    failed = result(none, none, "", "binary_content")
    strict = F.when(F.is_valid_utf8(utf8), result(utf8, "utf-8")).when(looks_binary(data), failed).otherwise(fallback)
    even = F.substr(data, F.lit(1), (F.length(data) - F.length(data) % 2).cast("int"))

    def by_zeros(guess):
        told = F.when(guess == "utf-16-le", _wide_text(even, True, False)).when(guess == "utf-16-be", _wide_text(even, False, False))
        return _let(told, lambda x: F.when(F.coalesce(x["sound"], F.lit(False)), result(x["text"], guess, "utf16_without_bom")).when(looks_binary(data), failed).otherwise(strict))

    has_zero = F.contains(F.decode(F.substr(data, F.lit(1), F.lit(BINARY_HEAD)), "ISO-8859-1"), F.lit("\0"))
    out = F.when(has_zero, _let(utf16_guess(data), by_zeros)).otherwise(strict)
    for mark, encoding in reversed(MARKS):
        rest = F.substr(data, F.lit(len(mark) // 2 + 1), F.length(data))
        marked = F.when(F.is_valid_utf8(rest.cast("string")), result(rest.cast("string"), "utf-8")).otherwise(result(F.make_valid_utf8(rest.cast("string")), "utf-8", "decode_replacement")) if encoding == "utf-8" else of_wide(rest, encoding)
        out = F.when(F.startswith(data, F.unhex(F.lit(mark))), marked).otherwise(out)
    return F.when(data.isNotNull(), out)
