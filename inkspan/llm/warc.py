"""Legacy archives to WARC.

An ARC record is a header line of space-separated fields, whose number depends on the version, and a body of the
length it declares. The converter reads both and makes the WARC fields that ARC lacks: an identifier derived from the
content, an ISO time from the 14-digit one, a record type and digests. Archives are written through Spark's own text
writer (a record's end is the line separator), so any store that Spark can write to will do.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

#: The fields of a header line by version of the ARC format.
ARC_FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}
LEAST = 100  # shorter payloads are never revisits
END = "\r\n\r\n"
RECORD = "key long, record_id string, warc_date string, url string, ip string, content_type string, digest string, payload binary, error string"
#: Fixed value: the profile of a revisit whose payload is that of an earlier record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def arc_records(pages: DataFrame, id_col: str, url_col: str, body_col: str, version: int = 1) -> DataFrame:
    """(key, version, archive): an ARC record per row, as bytes; spaces and line ends of a url are percent-coded."""
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    url = F.coalesce(F.col(url_col), F.lit("-"))
    for c, code in ((" ", "%20"), ("\n", "%0A"), ("\r", "%0D")):
        url = F.replace(url, F.lit(c), F.lit(code))
    middle = ["0.0.0.0", "19700101000000", "text/html"] + (["200", "-", "-", "0", "-"] if version == 2 else [])
    head = F.concat_ws(" ", F.when(url == "", "-").otherwise(url), *map(F.lit, middle), F.octet_length(body).cast("string"))
    return pages.select(F.col(id_col).cast("long").alias("key"), F.lit(version).alias("version"),
                        F.concat(F.encode(F.concat(head, F.lit("\n")), "UTF-8"), body, F.encode(F.lit("\n"), "UTF-8")).alias("archive"))


def parse_arc(data: bytes, version: int) -> Iterator[tuple[dict, bytes, str | None]]:
    """(fields, body, error) of each record. A version block sets the version of what follows it. A header that can't
    be read ends the archive with one record that says so; a body cut short keeps what there is."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        line = data.find(b"\n", at)
        line = len(data) if line < 0 else line
        parts = data[at:line].rstrip(b"\r").split(b" ")
        names = ARC_FIELDS[version]
        if parts[0].startswith(b"filedesc://"):
            names = ARC_FIELDS[2] if len(parts) == len(ARC_FIELDS[2]) else ARC_FIELDS[1]
        if len(parts) != len(names) or not parts[-1].isdigit():
            yield {}, b"", "bad header line"
            return
        fields = dict(zip(names, (p.decode("utf-8", "replace") for p in parts)))
        body = data[line + 1 : line + 1 + int(fields["length"])]
        at = line + 1 + int(fields["length"])
        if fields["url"].startswith("filedesc://"):
            said = re.match(rb"(\d)", body)
            version = int(said[1]) if said and int(said[1]) in ARC_FIELDS else version
            continue
        yield fields, body, None if len(body) == int(fields["length"]) else "body cut short"


def warc_date(stamp: str) -> str:
    s = (re.sub(r"\D", "", stamp) + "19700101000000"[len(re.sub(r"\D", "", stamp)) :])[:14]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:]}Z"


def arc_to_warc(archives: DataFrame) -> DataFrame:
    """Rows (key, version, archive), each a whole archive or a record, to one row per record. Null archives give none."""

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            rows = []
            for key, version, data in zip(b["key"], b["version"], b["archive"]):
                for n, (f, body, error) in enumerate(parse_arc(bytes(data), version) if data is not None else ()):
                    digest = hashlib.sha256(body).hexdigest()
                    made = uuid.uuid5(uuid.NAMESPACE_URL, f"{key} {n} {f.get('url')} {f.get('date')} {digest}")
                    rows.append((key, f"<urn:uuid:{made}>", warc_date(f.get("date", "")), f.get("url"), f.get("ip"), f.get("content_type"), digest, body, error))
            out = pd.DataFrame(rows, columns=names)
            out["key"] = out["key"].astype("Int64")
            yield out

    return archives.mapInPandas(convert, RECORD)


def with_types(records: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds record_type, refers_to and refers_to_id: of equal payloads of at least `least` bytes the smallest key is the
    response, to whose key and record the others refer.

    Only digests that occur more than once are joined back, from a table of their own, so that Spark can split the
    copies of a frequent payload; null keys are responses.
    """
    size = F.octet_length("payload")
    first = records.where((size >= least) & F.col("key").isNotNull()).groupBy("digest").agg(F.min(F.struct("key", "record_id")).alias("first"), F.count("*").alias("c")).where("c > 1")
    first = cut(first.select("digest", F.col("first.key").alias("first"), F.col("first.record_id").alias("first_id")))
    out = records.join(first, "digest", "left")
    again = (size >= least) & F.col("first").isNotNull() & F.col("key").isNotNull() & (F.col("key") != F.col("first"))
    again = F.coalesce(again, F.lit(False))
    return out.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first")), "refers_to_id": F.when(again, F.col("first_id"))}).drop("first", "first_id")


def write_warc(records: DataFrame, path: str) -> None:
    """Compressed WARC files below path. A revisit's block is empty; its headers keep the size and digest of the payload
    and name the record it refers to. Keys are kept in headers of our own (X-)."""
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, "").otherwise(F.decode("payload", "UTF-8"))

    def header(name: str, value) -> object:
        return F.concat(F.lit(f"{name}: "), value)  # null values leave the line out

    line = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), header("WARC-Type", F.col("record_type")), header("WARC-Record-ID", F.col("record_id")),
                       header("WARC-Date", F.col("warc_date")), header("WARC-Target-URI", F.coalesce("url", F.lit("-"))), header("WARC-IP-Address", F.nullif("ip", F.lit("0.0.0.0"))),
                       header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), header("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))),
                       header("WARC-Refers-To", F.col("refers_to_id")), header("WARC-Profile", F.when(revisit, PROFILE)), header("WARC-Identified-Payload-Type", line(F.col("content_type"))),
                       header("X-Payload-Length", F.octet_length("payload")), header("X-Key", F.col("key")), header("X-Refers-To-Key", F.col("refers_to")),
                       F.lit("Content-Type: application/octet-stream"), header("Content-Length", F.when(revisit, 0).otherwise(F.octet_length("payload"))))
    records.select(F.concat(head, F.lit(END), block).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 5000).text(path)


def unpacked(data: bytes) -> bytes:
    """All gzip members of a file one after the other; a damaged end is left out. Other files are taken as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data.lstrip(b"\0\r\n")
    return b"".join(out)


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record, by the declared lengths; a last record that is cut short has what there is. A
    record without a readable length ends at the next record's first line."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            return
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        if headers.get("content-length", "").isdigit():
            n = int(headers["content-length"])
        else:
            n = max(0, (data + b"\r\n\r\nWARC/").find(b"\r\n\r\nWARC/", stop + 4) - stop - 4)
        yield headers, data[stop + 4 : stop + 4 + n]
        at = stop + 4 + n


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to, record_id, intact) of files with one or more gzip
    members, or none, by us or others: what a header does not say is taken from the block or is null. intact is false
    where a block is shorter than declared or, for responses of ours, does not have the digest its header declares."""
    schema = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, intact boolean"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda x: int(x) if x is not None and x.lstrip("-").isdigit() else None
        for b in batches:
            for content in b["content"]:
                rows = []
                for h, block in parse_warc(unpacked(bytes(content))):
                    kind, own = h.get("warc-type"), hashlib.sha256(block).hexdigest()
                    said = h.get("warc-payload-digest", "").partition(":")
                    digest = said[2] if said[0] == "sha256" else None if kind == "revisit" else own
                    whole = number(h.get("content-length")) in (None, len(block))
                    rows.append((number(h.get("x-key")), len(block) if number(h.get("x-payload-length")) is None else number(h.get("x-payload-length")), digest, kind,
                                 number(h.get("x-refers-to-key")), h.get("warc-record-id"), whole and (kind != "response" or "x-key" not in h or own == digest)))
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
                yield out.astype({"key": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    return spark.read.format("binaryFile").load(path).where(~F.col("path").rlike("/[_.][^/]*$")).select("content").mapInPandas(read, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = shared_dir(spark)
    # converted once: the digests are grouped, then joined back
    write_warc(with_types(cut(arc_to_warc(arc_records(pages, "page_id", "url", "html")))), path)
    return read_warc(spark, path).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
with p as (select page_id, coalesce(html, '') as h from pages), d as (select page_id, octet_length(encode(h)) as payload_bytes, sha256(h) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= {LEAST} and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {LEAST} and page_id <> first then first end as refers_to from f
"""
