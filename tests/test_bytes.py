import random

from pyspark.sql import functions as F

from inkspan.functions import bytes as B


def plain(data):
    """The cascade with Python's codecs; (text, encoding, flags) or binary_content."""
    for bom, enc in ((b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(bom):
            try:
                return data[len(bom):].decode(enc), enc, ""
            except UnicodeDecodeError:
                return data[len(bom):].decode(enc, "replace"), enc, "decode_replacement"
    head = data[:65536]
    binary = bool(head) and (head.count(0) > max(1, len(head) // 100) or sum(b < 32 and b not in (9, 10, 11, 12, 13, 27) for b in head) > 0.1 * len(head))
    if 0 in head:
        even, odd = data[:4096][0::2], data[:4096][1::2]
        if len(data) >= 4:
            for one, two, enc in ((odd, even, "utf-16-le"), (even, odd, "utf-16-be")):
                if one.count(0) > 0.4 * len(one) and two.count(0) < 0.1 * len(two):
                    try:
                        return data[: len(data) // 2 * 2].decode(enc), enc, "utf16_without_bom"
                    except UnicodeDecodeError:
                        pass
        if binary:
            return "binary_content"
    try:
        return data.decode(), "utf-8", ""
    except UnicodeDecodeError:
        pass
    if binary:
        return "binary_content"
    for enc in ("cp1250", "iso8859_2", "cp1252"):
        try:
            return data.decode(enc), enc, "encoding_fallback"
        except UnicodeDecodeError:
            continue


def test_cascade_against_the_codecs(spark):
    r = random.Random(9)
    texts = ["", "a", "plain text", "čeština ďáblů", "日本 😀 mix", "x\n\ty" * 50]
    data = [b"", b"\xff\xfe", b"\xff\xfea", b"\xff\xfe\x00\xd8a\x00", b"\xfe\xff\xdc\x00\x00a", b"\xff\xfe\x00\x00a\x00\x00\x00\x00\xd8\x00\x00", b"\x00\x00\xfe\xff\x00\x00\x00a\x00", b"\xef\xbb\xbfok", b"\x00\x00\x00", b"ab\x00cd" * 40, b"\x81\xe8 text", b"\xe8esk\xfd", b"\x01\x02\x03\xff", b"a\x00b\x00\x00\xd8c\x00" * 3, b"a\x00b\x00c\x00d"]
    data += [t.encode(e) for t in texts for e in ("utf-8", "utf-16-le", "utf-16-be", "utf-16", "utf-32", "utf-8-sig")] + [t.encode("cp1250", "replace") for t in texts]
    data += [bytes(r.choices(range(1, 256), k=r.randint(1, 40))) for _ in range(150)] + [bytes(r.choices([0, 65, 66, 67, 200], k=r.randint(4, 30))) for _ in range(80)]
    d = spark.createDataFrame(list(enumerate(map(bytearray, data))), "i int, data binary")
    got = {x.i: x.r for x in d.select("i", B.decode_bytes(F.col("data")).alias("r")).collect()}
    for i, raw in enumerate(data):
        want = plain(raw)
        have = got[i].status if got[i].status != "ok" else (got[i].text, got[i].encoding, got[i].flags)
        assert have == want, raw
    assert spark.range(1).select(B.decode_bytes(F.lit(None).cast("binary")).alias("r")).first().r is None
    assert d.limit(1).select(B.decode_bytes(F.unhex(F.lit("81FF")), ()).alias("r")).first().r.status == "decode_failed"


def test_zeros_of_long_texts_stand_in_the_head(spark, tmp_path):
    from inkspan.plans import bytes_queries

    spark.createDataFrame([(6, "ab " * 40000), (15, "ab")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.status for r in bytes_queries.QUERIES["decoded_bytes"](spark, str(tmp_path)).collect()} == {"binary_content"}
