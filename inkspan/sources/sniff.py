"""Kinds of files by their bytes: ordered rules over a head, the name's extension only where bytes cannot tell.

The rules are DataFrame functions. Bytes of compressed files and ZIP containers alone go through an Arrow function, which
hands on what is inside one file at a time, so that no batch of contents is held.
"""

from __future__ import annotations

import bz2
import io
import lzma
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.bytes import MARKS, _let, decode_bytes, looks_binary
from inkspan.functions.text import newlines, stripped
from inkspan.sources.json_trees import json_status

HEAD, MB = 65536, 1024 * 1024
#: First bytes of wrappers, images, archives and old office files.
WRAPPERS = {"gzip": "^\x1f\x8b", "xz": "^\xfd7zXZ\0", "bz2": "^BZh[0-9]1AY&SY"}
IMAGES = ("\x89PNG\r\n\x1a\n", "\xff\xd8\xff", "GIF87a", "GIF89a", "II*\0", "MM\0*", "\0\0\0\x0cjP  ", "\xff\x4f\xff\x51")
ARCHIVES = ("7z\xbc\xaf\x27\x1c", "Rar!\x1a\x07", "\x28\xb5\x2f\xfd")
OLE2, ZIP = "\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", ("PK\x03\x04", "PK\x05\x06")
#: Extensions of each kind, of images, and those that decide a kind of plain text.
EXTENSIONS = {
    "txt": (".txt", ".text", ".log"), "md": (".md", ".markdown", ".mdown"), "csv": (".csv",), "tsv": (".tsv", ".tab"), "json": (".json",), "jsonl": (".jsonl", ".ndjson"), "alto": (".xml",), "page-xml": (".xml",),
    "hocr": (".hocr", ".html", ".htm", ".xhtml"), "html": (".html", ".htm", ".xhtml"), "tei": (".xml", ".tei"), "xml": (".xml",), "pdf": (".pdf",), "docx": (".docx", ".docm", ".dotx"), "xlsx": (".xlsx", ".xlsm"),
    "pptx": (".pptx", ".pptm"), "odt": (".odt",), "ods": (".ods",), "odp": (".odp",), "epub": (".epub",), "rtf": (".rtf",), "tesseract-tsv": (".tsv",), "abbyy-xml": (".xml",), "djvu-xml": (".xml",), "zip-bundle": (".zip",),
    "srt": (".srt",), "vtt": (".vtt",), "eml": (".eml",), "mbox": (".mbox", ".mbx"),
}
DIALECTS = {x: k for k in ("md", "csv", "tsv", "srt", "vtt", "eml", "mbox") for x in EXTENSIONS[k]}
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".gif", ".bmp", ".webp", ".jp2", ".j2k")
HTML_EXTENSIONS = (".html", ".htm", ".xhtml", ".hocr")
TEXT_EXTENSIONS = (*EXTENSIONS["txt"], *DIALECTS, *HTML_EXTENSIONS, ".json", ".jsonl", ".ndjson", ".xml", ".tei", ".rtf")
#: Header of a word table, fields of mail, mimetypes and markers of packages, names and extensions in bundles.
WORD_TABLE = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
ORIGIN = ("from", "received", "return-path")
TECHNICAL = ("mime-version", "message-id", "received", "return-path", "content-type", "dkim-signature", "x-mailer", "delivered-to")
TIMING = r"^\s*(?:\d+:)?\d{1,2}:\d{2}[,.]\d{1,3}\s*-->\s*(?:\d+:)?\d{1,2}:\d{2}[,.]\d{1,3}"
OPEN_DOCUMENT = {f"application/vnd.oasis.opendocument.{name}{t}": kind for name, kind in (("text", "odt"), ("spreadsheet", "ods"), ("presentation", "odp")) for t in ("", "-template")} | {"application/epub+zip": "epub"}
MARKERS = ("META-INF/container.xml", "word/document.xml", "xl/workbook.xml", "ppt/presentation.xml")
BUNDLED = (".xml", ".txt", ".text", ".hocr", ".html", ".htm", ".xhtml", ".json", ".jsonl", ".ndjson", ".md", ".csv", ".tsv", ".tab", ".srt", ".vtt", ".eml", ".rtf", ".tei", "")
NOT_BUNDLED = (".pdf", ".zip", ".docx", ".docm", ".dotx", ".xlsx", ".xlsm", ".pptx", ".pptm", ".odt", ".ods", ".odp", ".epub", ".gz", ".gzip", ".bz2", ".xz", ".tgz", ".tar", ".7z", ".rar")
BESIDES = r"(?i)^(?:mets\.xml|doc\.xml|metadata\.xml|manifest\.xml|mimetype|thumbs\.db|desktop\.ini|\.ds_store)$|^(?:readme|licen[cs]e|copying|changelog|notice)(?:\.[^\n]*)?$|^~\$"


def extension(name: Column) -> Column:
    """The lower-case extension of a name with its dot, empty without one; dots that begin a name are none."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^./][^/]*(\.[^./]*)$", 1))


def inner_name(name: Column) -> Column:
    """The name of what a compressed file holds."""
    return F.regexp_replace(F.regexp_replace(name, r"(?i)(?<=[^./])\.(?:tgz|tbz2?|txz)$", ".tar"), r"(?i)(?<=[^./])\.(?:gz|gzip|bz2?|xz)$", "")


def wrapper(data: Column) -> Column:
    """gzip, xz or bz2 for bytes wrapped so, else null."""
    start = F.decode(F.substr(data, F.lit(1), F.lit(10)), "ISO-8859-1")
    return _let(start, lambda s: F.coalesce(*(F.when(s.rlike(p), k) for k, p in WRAPPERS.items())))


def _unwrapped(data: bytes, kind: str, max_mb: float, ratio: float) -> dict:
    """What is inside, up to the least of max_mb and ratio times the size (a megabyte at least), and which of both it passes."""
    by_size, by_ratio = int(max_mb * MB), int(max(MB, len(data) * ratio))
    cap = min(by_size, by_ratio)
    opened = {"gzip": lambda: zlib.decompressobj(31), "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[kind]
    out, rest = b"", data
    try:
        while rest and len(out) <= cap:  # members follow one another
            one = opened()
            more = one.decompress(rest, cap + 1 - len(out))
            out += more
            if not one.eof:
                if len(out) <= cap:
                    raise EOFError
                break
            rest = one.unused_data.lstrip(b"\0")
    except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError):
        if not out or len(out) < HEAD:
            return {"reason": "corrupt"}
    over = "" if len(out) <= cap else "zip_limits_exceeded" if by_ratio < by_size else "too_large"
    return {"data": out[:cap], "over": over}


def _listed(data: bytes, max_mb: float, ratio: float, members: int, total_mb: float) -> dict:
    """Names in a container and what its mimetype and relations say, or why it is refused."""
    def read(name):
        return box.read(name) if name in names else b""

    try:
        with zipfile.ZipFile(io.BytesIO(data)) as box:
            infos = box.infolist()
            names = [i.filename for i in infos]
            big = [i for i in infos if i.file_size > max_mb * MB or i.file_size > MB and i.compress_size and i.file_size / i.compress_size > ratio]
            if len(infos) > members or sum(i.file_size for i in infos) > total_mb * MB:
                return {"reason": "zip_limits_exceeded"}
            if any(i.flag_bits & 1 for i in infos):
                return {"reason": "encrypted"}
            if big:
                return {"reason": "zip_limits_exceeded"}
            return {"names": names, "mimetype": read("mimetype").decode("ascii", "replace").strip(), "relations": read("_rels/.rels").decode("utf-8", "replace")}
    except (zipfile.BadZipFile, OSError, EOFError, ValueError, NotImplementedError, zlib.error):
        return {"reason": "corrupt"}


_INSIDE = "data binary, over string, reason string, names array<string>, mimetype string, relations string"
_ARROW = pa.struct([("data", pa.binary()), ("over", pa.string()), ("reason", pa.string()), ("names", pa.list_(pa.string())), ("mimetype", pa.string()), ("relations", pa.string())])


def _package(c) -> Column:
    """struct(kind, reason) of a container by its names."""
    has = lambda *n: F.arrays_overlap(c["names"], F.array(*map(F.lit, n)))
    named = _first([F.when(c["mimetype"] == m, _is(k)) for m, k in OPEN_DOCUMENT.items()], _no("archive_unsupported"))
    relation = F.get(F.filter(F.regexp_extract_all(c["relations"], F.lit(r"<(?:\w+:)?Relationship\b[^>]*>"), F.lit(0)), lambda r: r.rlike(r"""\bType\s*=\s*["'][^"']*/officeDocument["']""")), F.lit(0))
    top = F.regexp_extract(relation, r"""\bTarget\s*=\s*["'](?:\./|/)*([^/"'#]*)/""", 1)
    office = _first([F.when(top == t, _is(k)) for t, k in (("word", "docx"), ("xl", "xlsx"), ("ppt", "pptx"))], _no("archive_unsupported"))
    damaged = has(*MARKERS) | has("content.xml") & has("META-INF/manifest.xml")

    def member(name):
        parts = F.filter(F.split(name, "/"), lambda p: p != "")
        base = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
        besides = (base == "") | F.get(parts, F.lit(0)).isin("__MACOSX", "META-INF") | F.exists(parts, lambda p: p.startswith(".")) | base.rlike(BESIDES)
        x = extension(base)
        return F.when(name.endswith("/"), "folder").when(besides, "besides").when(x.isin(*IMAGE_EXTENSIONS), "image").when(x.isin(*NOT_BUNDLED), "refused").when(x.isin(*BUNDLED), "page").otherwise("unknown")

    kinds = F.array_distinct(F.transform(c["names"], member))
    bundle = _let(kinds, lambda k: F.when(F.array_contains(k, "page"), _is("zip-bundle")).when(F.array_contains(k, "image") & ~F.arrays_overlap(k, F.array(F.lit("unknown"), F.lit("refused"))), _no("image_needs_ocr")).otherwise(_no("archive_unsupported")))
    return F.when(has("mimetype"), named).when(has("[Content_Types].xml"), office).when(damaged, _no("archive_unsupported")).otherwise(bundle)


def _is(kind) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(None).cast("string").alias("reason"))


def _no(reason) -> Column:
    return F.struct(F.lit(None).cast("string").alias("kind"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def _first(whens, other) -> Column:
    return F.coalesce(*whens, other)


def _any(s: Column, starts) -> Column:
    out = F.lit(False)
    for x in starts:
        out = out | s.startswith(x)
    return out


def _lead(s: Column) -> Column:
    return F.regexp_replace(s, r"^[ \t\n\x0B\f\r]++", "")


def xml_kind(text: Column) -> Column:
    """The kind of an XML text by its root element behind declarations, comments and document types; empty without one."""
    def of(start):
        root = F.lower(F.regexp_extract(start, r"^<\s*(?:[A-Za-z_][\w.\-]*:)?([A-Za-z_][\w.\-]*)[\s/>]", 1))
        html = F.when(text.rlike("(?i)ocr_page|ocrx?_line|ocrx_word|ocr-system|ocr-capabilities"), "hocr").otherwise("html")
        abbyy = (root == "document") & F.contains(F.lower(F.left(start, F.lit(2048))), F.lit("abbyy"))
        return (F.when(root == "alto", "alto").when(root == "pcgts", "page-xml").when(root.isin("tei", "teicorpus", "tei.2", "teicorpus.2"), "tei").when(root == "html", html)
                .when(abbyy, "abbyy-xml").when(root == "djvuxml", "djvu-xml").when(root != "", "xml").otherwise(""))

    # each match begins where the last one ended, so that no run of comments makes the expression recur
    return _let(F.regexp_replace(text, r"(?is)\G(?:\s++|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^\[>]*+(?:\[.*?\][^\[>]*+)*+>)", ""), of)


def is_mail(text: Column) -> Column:
    """Whether a text begins with a header of mail: three fields or more up to a blank line, one of origin, one technical."""
    lines = F.slice(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", 401), 1, 400)

    def of(all_):
        blank = F.array_position(F.transform(all_, lambda x: x.rlike(r"^[ \t\x0B\f\r]*+$")), True)
        head = F.slice(all_, F.lit(1), F.greatest(blank.cast("int") - 1, F.lit(0)))
        folded = lambda x: x.rlike("^[ \t]")
        names = F.transform(F.filter(head, lambda x: ~folded(x)), lambda x: F.lower(F.regexp_extract(x, "^([!-9;-~]+):", 1)))
        sound = (blank > 0) & ~F.coalesce(folded(F.get(head, F.lit(0))), F.lit(False))
        return sound & _let(names, lambda n: (F.size(n) >= 3) & ~F.array_contains(n, "") & F.arrays_overlap(n, F.array(*map(F.lit, ORIGIN))) & F.arrays_overlap(n, F.array(*map(F.lit, TECHNICAL))))

    return _let(lines, of)


def json_or_text(data: Column, over: Column, max_mb: float) -> Column:
    """struct(kind, reason): json for bytes that are one JSON value, jsonl where the first 50 records are objects, lists or
    strings, else txt; of more than max_mb, txt."""
    def of(text):
        records = F.slice(F.filter(F.split(newlines(text), "\n"), lambda r: stripped(r) != ""), 1, 50)
        record = lambda r: stripped(r).rlike(r'^[{\["]') & (json_status(r) == "ok")
        return F.when(json_status(text) == "ok", "json").when(_let(records, lambda rs: (F.size(rs) > 0) & F.forall(rs, record)), "jsonl").otherwise("txt")

    decoded = _let(decode_bytes(data)["text"], lambda t: F.coalesce(F.when(t.isNotNull(), of(t)), F.lit("txt")))
    return F.when(over != "", _no(over)).when(F.length(data) > int(max_mb * MB), _is("txt")).otherwise(_is(decoded))


def _rules(s: Column, head: Column, data: Column, over: Column, ext: Column, inside: Column, package: Column, max_mb: float) -> Column:
    """struct(kind, reason) by the first rule that fits; s is the head, a letter per byte."""
    body = _lead(F.regexp_replace(s, "^ï»¿", ""))
    starts_zip = _any(s, ZIP)
    lenient = F.contains(F.left(s, F.lit(1024)), F.lit("%PDF-")) & ~(ext.isin(*TEXT_EXTENSIONS) & ~looks_binary(head)) & ~_any(s, (OLE2, *ZIP))
    within = lambda kind: F.when(inside, _no("archive_unsupported")).otherwise(kind)
    marked = F.contains(F.left(s, F.lit(4096)), F.lit("\0"))
    for mark, _ in MARKS:
        marked = marked | s.startswith(bytes.fromhex(mark).decode("latin-1"))
    whole = F.substr(head, F.lit(1), F.when(F.length(head) < 4, F.length(head)).otherwise(F.length(head) - F.length(head) % 4))

    def of_text(p):
        by_name = F.coalesce(*(F.when(ext == x, k) for x, k in DIALECTS.items()))
        markup = _let(xml_kind(p), lambda k: F.when(~k.isin("xml", ""), k).when(ext.isin(*HTML_EXTENSIONS), "html").otherwise(F.coalesce(by_name, F.when(k == "", "txt").otherwise(k))))
        table = F.lower(F.regexp_extract(p, r"^([^\n]*)", 1))
        subtitle = F.slice(F.split(_lead(F.replace(p, F.lit("\r\n"), F.lit("\n"))), "\n", 4), 1, 3)
        subtitled = F.trim(F.get(subtitle, F.lit(0))).rlike(r"^\d+$") & F.coalesce(F.get(subtitle, F.lit(1)).rlike(TIMING), F.lit(False))
        mbox = p.rlike(r"^From [^\n]*+\n[!-9;-~]+:")
        return (F.when(p.startswith("<"), _is(markup)).when(p.rlike(r"^WEBVTT(?:[ \t\r\n]|$)"), _is("vtt")).when(F.regexp_replace(table, r"\r+$", "") == WORD_TABLE, _is("tesseract-tsv")).when(ext.isin(".jsonl", ".ndjson"), _is("jsonl")).when(ext == ".json", _is("json"))
                .when(by_name.isNotNull(), _is(by_name)).when(mbox, _is("mbox")).when(is_mail(p), _is("eml")).when(subtitled, _is("srt")).when(p.rlike(r"^[{\[]"), json_or_text(data, over, max_mb)).otherwise(_is("txt")))

    # one text to go on with: the head's letters, or what its mark or zeros tell
    probe = F.when(marked, _let(decode_bytes(whole), lambda x: F.struct(x["text"].alias("text"), F.when(x["status"] != "ok", x["status"]).alias("reason")))).otherwise(_let(looks_binary(head), lambda b: F.struct(F.when(~b, s).alias("text"), F.when(b, "binary_content").alias("reason"))))
    text = _let(probe, lambda x: F.when(x["reason"].isNotNull(), _no(x["reason"])).otherwise(_let(_lead(x["text"]), of_text)))
    found = (F.when(inside & F.exists(F.array(*(F.lit(p) for p in WRAPPERS.values())), lambda p: F.regexp_like(s, p)), _no("archive_unsupported")).when(body.startswith("%PDF-") | lenient, within(_is("pdf"))).when(s.startswith(OLE2), _no("legacy_office_unsupported")).when(starts_zip, within(package))
             .when(_any(s, IMAGES) | s.startswith("RIFF") & (F.substr(s, F.lit(9), F.lit(4)) == "WEBP"), _no("image_needs_ocr")).when((F.substr(s, F.lit(258), F.lit(5)) == "ustar") | (ext == ".tar") | _any(s, ARCHIVES), _no("archive_unsupported")).when(body.startswith("{\\rtf"), _is("rtf")).otherwise(text))
    return _let(found, lambda r: F.when(ext.isin(*IMAGE_EXTENSIONS) & F.coalesce(r["kind"] == "txt", F.lit(False)), _no("image_needs_ocr")).otherwise(r))


def sniffed(files: DataFrame, id_col: str = "path", name_col: str = "name", data_col: str = "content", max_mb: float = 256, ratio: float = 200, members: int = 10000, total_mb: float = 1024) -> DataFrame:
    """(id_col, kind, reason, wrapper, note): how each file is to be read, or the reason why it is not.

    The order of rules: wrapper, PDF, old office, ZIP, image, archive, RTF, binary, XML by its root, subtitles, word table,
    extension, mailbox, mail, JSON, plain text. Within a wrapper the inner file's kind counts, nested containers are
    refused, and a name loses the wrapper's extension. note tells an extension that is not the kind's. Null contents are
    `unreadable`, empty ones `empty_file`; a null name is one without extension. JSON is what try_parse_json takes.
    Ids may repeat; other columns are left out. A file is one value, and its wrapper or container one task's work.
    """
    f = files.select(F.col(id_col).alias("id"), F.coalesce(F.col(name_col), F.lit("")).alias("name"), F.col(data_col).alias("content")).withColumn("wrapper", wrapper(F.col("content")))
    start = F.decode(F.substr("content", F.lit(1), F.lit(4)), "ISO-8859-1")
    closed = F.coalesce(F.col("wrapper").isNotNull() | _any(start, ZIP), F.lit(False))
    ids = f.schema["id"].dataType

    def open_(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in ("content", "wrapper")}
                x = _unwrapped(row["content"], row["wrapper"], max_mb, ratio) if row["wrapper"] else _listed(row["content"], max_mb, ratio, members, total_mb)
                content = pa.array([None if row["wrapper"] else row["content"][:HEAD]], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id").slice(k, 1), b.column("name").slice(k, 1), content, b.column("wrapper").slice(k, 1), pa.array([x], _ARROW)], names=["id", "name", "content", "wrapper", "box"])

    opened = f.where(closed).mapInArrow(open_, f"id {ids.simpleString()}, name string, content binary, wrapper string, box struct<{_INSIDE.replace(' ', ':').replace(',:', ',')}>")
    shut = f.where(~closed).withColumn("box", F.lit(None).cast(f"struct<{_INSIDE.replace(' ', ':').replace(',:', ',')}>"))
    both = opened.unionByName(shut)
    inside = F.col("wrapper").isNotNull()
    t = both.select("id", "wrapper", "box", extension(F.when(inside, inner_name(F.col("name"))).otherwise(F.col("name"))).alias("ext"), F.when(inside, F.col("box.data")).otherwise(F.col("content")).alias("data"))
    head = F.substr("data", F.lit(1), F.lit(HEAD))
    rules = _let(F.decode(head, "ISO-8859-1"), lambda s: _rules(s, head, F.col("data"), F.coalesce("box.over", F.lit("")), F.col("ext"), inside, F.when(F.col("box.reason").isNotNull(), _no(F.col("box.reason"))).otherwise(_package(F.col("box"))), max_mb))
    told = F.when(inside & F.col("box.reason").isNotNull(), _no(F.col("box.reason"))).when(F.col("data").isNull(), _no("unreadable")).when(F.length("data") == 0, _no("empty_file")).otherwise(rules)
    r = t.select("id", "wrapper", "ext", told.alias("r")).select("id", "wrapper", "ext", "r.kind", "r.reason")
    own = _first([F.when(F.col("kind") == k, F.col("ext").isin(*x)) for k, x in EXTENSIONS.items()], F.lit(True))
    return r.select(F.col("id").alias(id_col), "kind", "reason", "wrapper", F.when(F.col("kind").isNotNull() & (F.col("ext") != "") & ~own, F.concat(F.lit("extension "), "ext", F.lit(" but content is "), "kind")).alias("note"))
