import bz2
import gzip
import io
import lzma
import zipfile

from inkspan.sources import sniff as S


def box(members, **kw):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, x in members.items():
            z.writestr(n, x)
    return out.getvalue()


RELS = '<Relationships><Relationship Id="r1" Type="http://x/officeDocument" Target="%s/document.xml"/></Relationships>'
MAIL = b"From: a@b.cz\r\nTo: c\r\n d\r\nMessage-ID: <1>\r\n\r\nbody"
TABLE = S.WORD_TABLE.encode() + b"\r\n1\t1"
ALTO = b"<?xml version='1.0'?>\n<!-- a -->\n<!DOCTYPE alto [ <!ENTITY x 'y'> ]>\n<a:alto xmlns:a='x'>"
CASES = [
    ("a.txt", b"hello", "txt"), ("a", None, "unreadable"), ("a.txt", b"", "empty_file"), (None, b"x", "txt"), ("a.pdf", b" \n%PDF-1.4", "pdf"), ("a.bin", b"junk %PDF-1", "pdf"), ("note.txt", b"see %PDF-1", "txt"),
    ("a.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1..", "legacy_office_unsupported"), ("a", b"\x89PNG\r\n\x1a\n1", "image_needs_ocr"), ("a", b"RIFF1234WEBP", "image_needs_ocr"), ("scan.tif", b"words", "image_needs_ocr"), ("a.tar", b"x", "archive_unsupported"),
    ("a", b"Rar!\x1a\x07", "archive_unsupported"), ("a", b"\xef\xbb\xbf {\\rtf1", "rtf"), ("a", b"\x01\x02\x03abc", "binary_content"), ("a", b"a\x00\x00\x00b" * 30, "binary_content"), ("a.xml", ALTO, "alto"), ("a.xml", ALTO.decode().encode("utf-16"), "alto"),
    ("a.xml", b"<PcGts>", "page-xml"), ("a.tei", b"<TEI.2 >", "tei"), ("a.html", b"<html><p class='ocr_page'>", "hocr"), ("a.html", b"<HTML>", "html"), ("README.md", b"<p align=x>", "md"), ("a.htm", b"<p >", "html"), ("a", b"<p >", "xml"), ("a", b"<3 you", "txt"),
    ("a.xml", b"<document xmlns='http://www.ABBYY.com/x'>", "abbyy-xml"), ("a", b"<DjVuXML>", "djvu-xml"), ("a.xml", b"<!-- -->" * 8000 + b"<alto>", "alto"), ("a.vtt", b"WEBVTT", "vtt"), ("a", b"WEBVTTX", "txt"), ("a.tsv", TABLE, "tesseract-tsv"), ("a.tsv", b"a\tb", "tsv"),
    ("a.ndjson", b"x", "jsonl"), ("a.json", b"x", "json"), ("a.csv", b"[1]", "csv"), ("a", b"From x\r\nTo: y", "mbox"), ("a", MAIL, "eml"), ("a", b"From: x\nTo: y\nSubject: z\n\n", "txt"), ("a", b"1\n00:00:01,000 --> 00:00:02,000\nhi", "srt"),
    ("a", b'{"a": 1}', "json"), ("a", b'{"a": 1}\n\n["b"]\n"c"', "jsonl"), ("a", b'{"a": 1}\n5', "txt"), ("a", b"[oops", "txt"), ("a.txt.gz", gzip.compress(b"hello"), "txt"), ("a.md.bz2", bz2.compress(b"hello"), "md"), ("a.gz", gzip.compress(b""), "empty_file"), ("a.json.xz", lzma.compress(b"[1]"), "json"),
    ("a.gz", gzip.compress(gzip.compress(b"x")), "archive_unsupported"), ("a.gz", gzip.compress(b"%PDF-"), "archive_unsupported"), ("a.gz", gzip.compress(box({"a.txt": "x"})), "archive_unsupported"), ("a.gz", b"\x1f\x8bjunk", "corrupt"), ("a.gz", gzip.compress(b"[" + b" " * 3000000), "zip_limits_exceeded"),
    ("a.tgz", gzip.compress(b"x"), "archive_unsupported"), ("a.zip", b"PK\x03\x04junk", "corrupt"), ("a.docx", box({"[Content_Types].xml": "", "_rels/.rels": RELS % "word"}), "docx"), ("a.xlsx", box({"[Content_Types].xml": "", "_rels/.rels": RELS % "/xl"}), "xlsx"),
    ("a", box({"[Content_Types].xml": ""}), "archive_unsupported"), ("a.epub", box({"mimetype": "application/epub+zip"}), "epub"), ("a.zip", box({"word/document.xml": "x", "a.txt": ""}), "archive_unsupported"), ("a.zip", box({"p/1.xml": "x", "__MACOSX/x": ""}), "zip-bundle"),
    ("a.zip", box({"1.png": "x", "README.txt": "y"}), "image_needs_ocr"), ("a.zip", box({"1.png": "x", "b.bin": "y"}), "archive_unsupported"), ("a.zip", box({"b.pdf": "y"}), "archive_unsupported"), ("a.zip", box({"b.txt": b"0" * 3000000}), "zip_limits_exceeded"),
]


def test_each_rule(spark):
    d = spark.createDataFrame([(i, n, None if b is None else bytearray(b), "k") for i, (n, b, _) in enumerate(CASES)], "path int, name string, content binary, kind string")
    got = {x.path: x for x in S.sniffed(d).collect()}
    assert {i: (x.kind or x.reason) for i, x in got.items()} == {i: w for i, (_, _, w) in enumerate(CASES)}
    assert all((x.kind is None) != (x.reason is None) for x in got.values())
    assert S.sniffed(d.limit(0)).count() == 0 and S.sniffed(d.unionByName(d)).count() == 2 * len(CASES)
    notes = {CASES[i][0]: x.note for i, x in got.items() if x.note}
    assert notes["a.bin"] == "extension .bin but content is pdf" and "a.txt" not in notes and "a.docx" not in notes
    assert got[[n for n, _, _ in CASES].index("a.md.bz2")].wrapper == "bz2"
