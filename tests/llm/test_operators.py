import hashlib
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkspan.llm import components, decontaminate, jaccard_join, language_id, main_text, pii, quality_rules, queries, sentencepiece_codec, transducer_counts, url_filter, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"w{i}" for i in range(40))
ODD = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (4, WORDS, "en", "a", 1), (5, WORDS, "en", "a", 1), (6, WORDS + " x", "fr", "b", 2), (7, "one two", "en", "a", 1),
       (8, "one TWO", "en", "a", 1), (9, "12 34", "en", "a", 1), (10, "word " * 30000, "en", "a", 1), (None, "no id here", "en", "a", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 5), (7, 7), (None, 1), (9, 8), (3, 8)], "a long, b long")
    assert sorted(map(tuple, components.connected_components(e).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (8, 1), (9, 1)]


def test_jaccard_join_against_all_pairs(spark, docs, odd, empty):
    for d in (docs, odd):
        want = jaccard_join.brute_force([(r.doc_id, r.text) for r in d.where("doc_id is not null").collect()])
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(d).collect() if r.doc_id is not None}
        assert got == want
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_join_frequent_passages_and_near_copies(spark):
    import random

    r = random.Random(3)
    vocab = [f"t{i}" for i in range(3000)]
    shared = r.choices(vocab, k=60)
    base = r.choices(vocab, k=90)
    rows = [(i, " ".join(r.choices(vocab, k=30) + shared)) for i in range(40)]
    for i in range(40, 110):
        w = list(base)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(90)] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_join.brute_force(rows)


def test_jaccard_join_of_a_large_bucket_in_several_components(spark):
    import random

    r = random.Random(4)
    vocab = [f"t{i}" for i in range(5000)]
    base = r.choices(vocab, k=120)
    rows = []
    for i in range(260):  # copies with up to eight edits: many share a bucket, few of the edited ones link
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 5, 6, 8])):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w[: r.choice([120, 118, 105])])))
    rows += [(400 + i, " ".join(r.choices(vocab, k=4) + base[:40] + r.choices(vocab, k=i % 9))) for i in range(120)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_join.brute_force(rows)
    assert len({c for _, c in got.values()}) > 20


def test_jaccard_join_repeated_ids_and_clashing_columns(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, 1), (1, b + " more", 2), (1, a, 3), (2, a, 4), (3, b + " more", 5), (4, c, 6), (5, c, 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, class long").withColumns({x: F.lit(1) for x in ("id", "n", "own", "s", "h1")})
    got = jaccard_join.jaccard_components(d).collect()
    # the longer text stands for id 1
    assert sorted(map(tuple, got)) == [(1, 37, 1)] * 3 + [(2, 36, 2), (3, 37, 1), (4, 36, 4), (5, 36, 4)]
    kept = jaccard_join.keep_one(d)
    assert kept.columns == d.columns and sorted(x.doc_id for x in kept.collect()) == [1, 1, 1, 2, 4]


def test_prefix_tree_against_all_overlaps():
    import random

    import numpy as np

    r = random.Random(6)
    for _ in range(200):
        sets = sorted((sorted(r.sample(range(30), r.randint(1, 14))) for _ in range(r.randint(0, 12))))
        q = set(r.sample(range(30), r.randint(1, 14)))
        want = [k for k, s in enumerate(sets) if 100 * len(q & set(s)) >= 50 * len(q | set(s))]
        assert sorted(jaccard_join.overlaps(np.array(sorted(q)), [np.array(s) for s in sets], 50)) == want


def test_sentencepiece_is_the_library(docs, odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    extra = ["  Hello  wörld\n\tfoo 你好 <s>  ", "a\u0000😀", "▁x"]
    texts = [r.text or "" for r in docs.select("text").collect()] + extra + [r[1] or "" for r in ODD]
    got = sentencepiece_codec.codec(sentencepiece_codec.model_path()).encode_batch(texts)
    assert [g.tolist() for g in got] == sp.encode(texts)
    assert [sentencepiece_codec.codec(sentencepiece_codec.model_path()).decode(g) for g in got] == [sp.decode(g.tolist()) for g in got]
    out = {r.doc_id: (r.n_tokens, r.round_trip) for r in sentencepiece_codec.encode_documents(odd).collect()}
    assert out[1] == (0, None) and out[2] == (0, True) and all(out[i][1] for i in (3, 4, 9, 10))
    assert sentencepiece_codec.encode_documents(empty).count() == 0


def unigram_model(path, pieces, fold):
    """A model file of pieces (text, score, kind): 1 text, 2 unknown, 3 control, 6 byte."""
    import struct

    def field(n, value):
        def number(x):
            return bytes([x]) if x < 128 else bytes([x & 127 | 128]) + number(x >> 7)

        return number(n << 3) + number(value) if isinstance(value, int) else number(n << 3 | 5) + struct.pack("<f", value) if isinstance(value, float) else number(n << 3 | 2) + number(len(value)) + value

    data = b"".join(field(1, field(1, t.encode()) + field(2, float(x)) + field(3, k)) for t, x, k in pieces)
    data += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, fold) + field(5, 1))
    path.write_bytes(data)


def test_sentencepiece_unigram_scores_decide(spark, tmp_path):
    import random

    import sentencepiece

    r = random.Random(7)
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256)]
    texts = {"▁", *"abcd", *("".join(r.choices("▁" + "abcd", k=1) + r.choices("abcd", k=r.randint(1, 5))) for _ in range(120))}
    pieces += [(t, -r.randint(8, 72) / 8 - 1.5 * len(t), 1) for t in sorted(texts)]  # eighths add up without rounding
    for fold in (0, 1):
        unigram_model(tmp_path / f"u{fold}.model", pieces, fold)
        path = str(tmp_path / f"u{fold}.model")
        sp, c = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
        assert not c.bpe and c.fold == bool(fold)
        rows = ["".join(r.choices("abcd  é", k=r.randint(0, 60))) for _ in range(300)]
        assert [g.tolist() for g in c.encode_batch(rows)] == sp.encode(rows)
        d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        ids = {x.doc_id: x.token_ids for x in sentencepiece_codec.encode_documents(d, path=path).collect()}
        assert [ids[k] for k in range(300)] == sp.encode(rows)
        back = d.sparkSession.createDataFrame(list(ids.items()), "k long, ids array<int>").select("k", sentencepiece_codec.decoded(F.col("ids"), path).alias("t"))
        assert {x.k: x.t for x in back.collect()} == {k: sp.decode(v) for k, v in ids.items()}


def test_sentencepiece_repeated_rows_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", 9, "x"), (1, "a b", 9, "x"), (2, None, 9, "x")], "doc_id long, text string, n_tokens int, own string").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    got = sentencepiece_codec.encode_documents(d).orderBy("doc_id").collect()
    assert [(x.n_tokens, x.own, x.m) for x in got] == [(2, "x", {"k": 1})] * 2 + [(0, "x", {"k": 1})] and got[0] == got[1] and got[2].token_ids is None


def test_sentencepiece_one_huge_word():
    import random

    import sentencepiece

    r = random.Random(2)
    texts = ["".join(r.choices("acgt", k=210_000)), "".join(r.choices("你好世界é", k=200_000))]
    got = sentencepiece_codec.codec(sentencepiece_codec.model_path()).encode_batch(texts)
    assert [g.tolist() for g in got] == sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path()).encode(texts)


def test_token_counts_are_the_library(docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(transducer_counts.tokenizer_path())
    extra = ["a <|endoftext|> b<|endoftext|>", "  \n\n x  y\t", "日本語😀" * 50, "I'LL we'll 123abc" + "ab" * 200, " " * 300, "word " * 40000]
    texts = [r.text for r in docs.select("text").collect()] + extra
    tr = transducer_counts.transducer(transducer_counts.tokenizer_path())
    assert [tr.count(x) for x in texts] == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    out = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in transducer_counts.count_documents(odd).collect()}
    assert out[1] == out[2] == (0, 0, False) and out[10][2]


def test_chunk_maps_compose_from_every_state():
    import random

    r = random.Random(11)
    tr = transducer_counts.transducer(transducer_counts.tokenizer_path())
    texts = ["".join(r.choices(["ab", " ", "  ", "\n", "x's", "12", "é", "!", " the"], k=r.randint(1, 40))) for _ in range(150)] + ["a" * 50, " " * 30, " a b c"]
    for t in texts:
        want = tr.tokens(t)
        for _ in range(4):
            cuts = sorted({0, len(t), *(r.randrange(len(t) + 1) for _ in range(5))})
            maps = [tr.chunk_map(t[a:b]) for a, b in zip(cuts, cuts[1:])]
            for k, (head, n, back) in enumerate(tr.scan(maps), 1):  # the state after each chunk: what it holds back
                assert tr.tokens(head) + n + tr.tokens(back or "") == tr.tokens(t[: cuts[k]])
            # associative, and right after any chunk before it: started from any state
            left, right = tr.compose(maps[0], maps[0]), tr.compose(maps[0], maps[-1])
            assert tr.compose(left, maps[-1]) == tr.compose(maps[0], right)
        assert tr.stretch(t) == want


def test_language_id_against_brute_force(spark):
    import random

    import numpy as np

    r = random.Random(12)
    rows = [(i, " ".join("".join(r.choices("abcdeéß" if i % 2 else "xyzčě12", k=5)) for _ in range(12)), "p" if i % 2 else "q") for i in range(80)] + [(90, "abc", "zz"), (91, "abc", "aa"), (91, "abc", "aa"), (92, "--", "p"), (None, "abc", "p")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    vectors = language_id.letter_vectors()

    def profile(text):
        codes = [0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (language_id.CLASSES - 27) for c in " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "]
        return sum(np.roll(vectors[a].astype(int), 2) * np.roll(vectors[b].astype(int), 1) * vectors[c] for a, b, c in zip(codes, codes[1:], codes[2:]))

    sums = {}
    for i, t, lang in rows:
        if i is not None and not language_id.is_held_out(i) and re.search(r"[^\W\d_]", t):
            v = profile(t)
            sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
    for x in language_id.predict_languages(d).collect():
        if x.doc_id == 92:
            assert x.lang_pred == "und" and x.score == 0
            continue
        v = profile(x.text)
        cos = {k: float(v @ s / np.linalg.norm(v) / np.linalg.norm(s)) for k, s in sums.items()}
        assert abs(cos[x.lang_pred] - max(cos.values())) < 1e-4 and abs(x.score - max(0, min(1, cos[x.lang_pred]))) < 1e-3


def test_language_id(docs, odd, empty):
    rows = language_id.predict_languages(docs).where("held_out").select("lang", "lang_pred").collect()
    assert sum(a == b for a, b in rows) >= 0.97 * len(rows)
    out = {r.doc_id: r.lang_pred for r in language_id.predict_languages(odd).collect()}
    assert out[1] == out[2] == out[3] == out[9] == "und" and out[4] != "und"
    assert language_id.predict_languages(empty).count() == 0


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark, odd):
    import random

    r = random.Random(5)
    items = [(i, "".join(r.choices("abcde fgh", k=120)).strip()) for i in range(4)]
    rows = []
    for n in range(40):
        i, t = items[n % 4]
        t = list(t)
        for _ in range(r.randint(0, 17)):
            k = r.randrange(len(t))
            t[k : k + 1] = r.choice([[], ["z"], ["y", t[k]]])
        rows.append((n, "".join(r.choices("abcdefgh ", k=50)) + "".join(t) + "".join(r.choices("abcdefgh ", k=50))))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, (9, None), (10, " ")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.contaminated(d, b).collect()}
    want = {}
    for n, t in rows:
        for i, item in items:
            x = distance(decontaminate.normal(item), decontaminate.normal(t))
            if x <= len(decontaminate.normal(item)) // 10:
                want[n, i] = x
    assert got == want and len(want) > 10
    assert decontaminate.keep_clean(odd, b).count() == len(ODD)
    assert decontaminate.contaminated(odd, b.limit(0)).count() == 0


def test_decontamination_blocks_short_items_and_repeats(spark):
    import random

    r = random.Random(9)
    items = [(i, " ".join(r.choices(["ab", "cde", "fg", "hijk"], k=12))) for i in range(30)] + [(3, "an other text of item three"), (50, "yes"), (51, "c++"), (52, "ten chars!")]
    rows = [(i, f"x {items[i % 34][1]} y {items[(i * 7) % 34][1]} and {items[i % 34][1]}") for i in range(80)] + [(90, "yesterday"), (91, "so yes."), (92, "c+++ c++"), (93, "ten shars!"), (93, "ten shars!"), (94, None)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string").withColumn("distance", F.lit("x")), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(d, b).collect()))
    short = {(x[0], x[1]) for x in whole if x[0] >= 90}
    assert short == {(91, 50), (92, 51), (93, 52)} and sum(x[0] == 93 for x in whole) == 2
    decontaminate.BLOCK_CHARS, was = 200, decontaminate.BLOCK_CHARS
    try:
        assert sorted(map(tuple, decontaminate.contaminated(d, b).collect())) == whole
        kept = decontaminate.keep_clean(d, b)
        assert sorted(x.doc_id for x in kept.collect()) == [90, 94] and kept.columns == d.columns
    finally:
        decontaminate.BLOCK_CHARS = was
    assert decontaminate.contaminated(d.limit(0), b).count() == decontaminate.keep_clean(d.limit(0), b).count() == 0


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_of(text):
    text, out = text or "", []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) < 256 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_and_redaction(spark, docs, odd, empty):
    texts = ["é😀 a.b@c.de x@y.z_q@r.st 1.2.3.4.5.6.7.8 999.1.1.1 007.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 +1 (743) 555-3824.", "+1+2(3)45678901 1" + "1" * 3000, "a" * 20000 + "@b.cc", "1 " * 5000, None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    source = {r.doc_id: r.text for r in d.collect()}
    for r in pii.with_spans(d).withColumns({"b": pii.listed(F.col("base")), "s": pii.listed(F.col("spans")), "h": F.sha2(pii.listed(F.col("base")), 256)}).collect():
        want = base_of(source[r.doc_id])
        assert r.b == ",".join(want) and set(want) <= set(r.s.split(",")) | {""}
        assert r.h == hashlib.sha256(",".join(want).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact(d).collect()}
    assert clean[0].startswith("é😀 [EMAIL] [EMAIL]") and clean[5] is None and not any(base_of(t) for t in clean.values())
    assert pii.redact(odd).count() == len(ODD) and pii.redact(empty).count() == 0 and pii.redact(odd).columns == odd.columns


def test_pii_side_by_side(spark):
    rows = [(i, f"4111111111111111 and +1 (743) 555-{i:04d} now 4111111111111112") for i in range(900)]
    rows += [(1000, "é 4111111111111111 4012888888881881"), (1001, "+1 (826) 555-4081 190.137.223.204"), (1002, "so, +1 (826) 555-4081 +1 (826) 555-4082 4111111111111111")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s.split(",") for r in pii.with_spans(d).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert set(got[1000]) >= {"card:2:18", "card:19:35"}
    assert set(got[1001]) >= {"ip:18:33", "phone:0:17"} and not any(int(x.split(":")[1]) > 17 for x in got[1001] if x.startswith("phone"))
    assert set(got[1002]) >= {"phone:4:21", "phone:22:39", "card:40:56"}


def test_exact_lower_bound_at_any_size():
    from math import comb

    for right, n in ((3, 5), (149, 149), (256, 260), (4990, 5000), (9850, 10000), (19990, 20000)):
        p = pii.lower_bound(right, n, 0.05)
        tail = sum(comb(n, k) * pow(p, k) * pow(1 - p, n - k) for k in range(right, n + 1)) if n < 300 else None
        assert tail is None or abs(tail - 0.05) < 1e-6
        assert p < right / n and (n < 5000 or right / n - p < 4 * (0.02 * 1.1 / n) ** 0.5)
    assert abs(pii.lower_bound(149, 149, 0.05) - 0.05 ** (1 / 149)) < 1e-9


def test_pii_threshold_passes_rare_cells():
    cells = [(3.5, 1, 1), (2.5, 2, 2), (1.5, 600, 600), (0.1, 500, 300), (-2.0, 900, 0)]
    assert 0.1 < pii.certified(cells, cells, 0.98, 0.05) <= 1.5
    assert pii.certified(cells[:2], cells[:2], 0.98, 0.05) == pii.certified([], [], 0.98, 0.05) == float("inf")


def test_quality_counts_and_verdicts(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    source = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality_rules.judge(docs, labels).collect():
        t = source[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = pd.Series(wins, dtype=object).value_counts() if wins else {}
        rep = {i + k for i, x in enumerate(wins) if seen[x] > 1 for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality_rules.judge(odd, labels.limit(0)).count() == len(ODD) and quality_rules.judge(empty, labels).count() == 0


def test_quality_cutoffs_against_brute_force(spark):
    import random
    from math import comb

    r = random.Random(13)
    rows, labels = [], []
    for i in range(3000):
        good = i % 10 != 0
        w = [f"w{r.randrange(10**6)}" for _ in range(60)]
        symbols = r.choice([0, 0, 1]) if good else r.randint(5, 50)
        lines = " ".join(w[:30] + ["#"] * symbols + w[30:]) + "\nsame line" * (1 if good else r.randint(1, 12))
        rows.append((i, lines, "a" if i < 2000 else "b" if i < 2980 else None))
        labels.append((i, int(good)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"id": F.lit(1), "stratum": F.lit("s"), "kept": F.lit("k")}), spark.createDataFrame(labels, "doc_id long, quality int")
    out = {x.doc_id: x for x in quality_rules.judge(d.unionByName(d.limit(5)), lab).collect()}
    m, measures = {}, {}
    for i, t, lang in rows:
        x, ls = out[i], [y for y in t.split("\n") if y.strip()]
        measures[i] = {"symbol_share": min(1, x.n_symbols / x.n_words), "duplicate_line_share": x.n_dup_lines / len(ls), "repeat_word_share": x.n_repeat_words / x.n_words}
    risk, sequences, cut = quality_rules.RISK / 3, 9, {}
    for lang in ("a", "b", None):
        good = [i for i, _, s in rows if s == lang and labels[i][1]]
        for rule in quality_rules.RULES:
            for g in quality_rules.GRID:
                x = sum(measures[i][rule] > g for i in good)
                tail = sum(comb(len(good), k) * risk**k * (1 - risk) ** (len(good) - k) for k in range(x + 1))
                if x >= len(good) * risk or tail > quality_rules.DELTA / sequences:
                    break
                cut[lang, rule] = g
    by = {i: ",".join(q for q in quality_rules.RULES if (lang, q) in cut and measures[i][q] > cut[lang, q]) for i, _, lang in rows}
    assert {i: (x.rejected_by, x.kept) for i, x in out.items()} == {i: (by[i], not by[i] and not out[i].base_failed) for i in by}
    assert len(cut) >= 4 and sum(map(bool, by.values())) > 100 and not any(k[0] is None for k in cut)


def test_binomial_tail(spark):
    from math import comb

    d = spark.createDataFrame([(x, n) for n in (1, 30, 200) for x in (0, 1, 7) if x <= n], "x long, n long")
    for r in d.withColumn("p", quality_rules.binomial_tail(F.col("x"), F.col("n"), 0.05)).collect():
        assert abs(r.p - sum(comb(r.n, k) * 0.05**k * 0.95 ** (r.n - k) for k in range(r.x + 1))) < 1e-9


def test_url_rules_and_aliases(spark):
    link = '<head><link rel="canonical" href="{}"></head><body>x'
    rows = [(1, "http://a.example.org/es/1", None), (2, "https://other.net/p", link.format("http://a.example.org/es/1")), (3, "http://x.com/fr/1", link.format("https://other.net/p")), (4, None, None), (5, "nonsense", ""),
            (6, "http://q.net/1", link.format("https://a.com/de/9")), (7, "http://q.net/2", '<meta http-equiv="refresh" content="0; url=/1">'), (8, "HTTP://Foo.ORG", None)]
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.example.org", "example.org/es/", "block") and got[3][2] == "allow" and got[2][2] == "allow"
    assert got[4] == got[5] == ("", None, "allow") and got[6][2] == got[7][2] == "block" and got[8] == ("foo.org", None, "allow")
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_links_of_all_kinds(spark):
    def page(tag, body="<BODY>"):
        return f"<html><HEAD>{tag}</HEAD>{body}<link rel=canonical href='http://not.net/'>"

    blocked = "http://a.example.org/es/1?x=1&y=2"
    rows = [(1, blocked, None), (2, "http://a.example.org/es/sub/2", page("<link rel='x canonical' href='../1?x=1&amp;y=2'>")), (3, "http://o.net/p/q", page("<link rel=canonical href=../r><link rel='canonical' href='http://a.example.org/es/1?x=1&y=2'>")), (4, "http://o.net/r", None),
            (5, "http://b.net/d/e", page("<base href='http://a.example.org/es/sub/'><meta http-equiv=refresh content='0;url=./../1?x=1&amp;y=2'>")), (6, "http://c.net/", page("<link rel='canonicals' href='http://a.example.org/es/1?x=1&y=2'>")), (7, "http://a.example.org/es/1", page("<link rel=canonical href='?x=1&y=2'>")),
            (8, "http://s.net/x", page("<link rel=canonical href='#top'>" + "y" * 300000)), (8, "http://s.net/x", None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("h"), "component": F.lit("c")})
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(d).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "block", 8: "allow"} and url_filter.filter_urls(d).count() == 9


def test_url_aliases_against_a_walk(spark):
    import random

    r = random.Random(14)
    urls = [r.choice(["http://a.com/de/{}", "http://b.org/{}", "http://c.net/{}", "http://d.net/{}", "http://e.net/{}"]).format(i) for i in range(120)]
    links = [(i, r.randrange(120)) for i in range(120) if r.random() < 0.6]
    target = dict(links)
    rows = [(i, u, f"<head><link rel=canonical href={urls[target[i]]}></head>" if i in target else None) for i, u in enumerate(urls)]
    near = {i: {i} for i in range(120)}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)

    def walk(i):
        seen, todo = {i}, [i]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
        return seen

    own = lambda u: "allow" if ".org/" in u else "block" if "com/de/" in u else None
    want = {i: own(u) or ("allow" if "allow" in (v := [own(urls[k]) for k in walk(i)]) else "block" if "block" in v else "allow") for i, u in enumerate(urls)}
    got = {x.page_id: x.verdict for x in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and {"allow", "block"} == set(want[i] for i, u in enumerate(urls) if own(u) is None)


def test_main_text(spark):
    ad = "<div class='note'>we use small files here to know you better please agree</div>"
    rows = [(1, "http://h.net/1", f"<nav>menu</nav>{ad}<article><h1>T &amp; x</h1><p>a  b\n c<p>d</article><footer>f</footer>"), (2, "http://h.net/2", f"{ad}<p>only words of this page</p><script>var t='</p>';</script>"), (3, "http://h.net/3", f"{ad}<div>other</div>"), (4, None, None), (5, "x", "")]
    got = {r.page_id: r.text for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "T & x\na b c\nd", 2: "only words of this page", 3: "other", 4: "", 5: ""}
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_mirrors_headlines_clashes_and_long_pages(spark):
    body = "<p>one two three four five six seven eight</p>"
    rows = [(1, "http://m.net/a", body), (2, "http://m.net/b", body), (3, "http://m.net/c", "<article><div class='post-header'><h1>Head</h1></div><div class='ad'>buy</div><p>text</p></article>"),
            (4, "http://m.net/d", "<p>" + "long " * 60000 + "</p>"), (4, "http://m.net/d", "<p>" + "long " * 60000 + "</p>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("old"), "runs": F.lit(1), "host": F.lit(2), "own": F.create_map(F.lit(1), F.lit(2))})
    out = main_text.extract(d)
    assert out.columns == ["page_id", "url", "runs", "host", "own", "text", "n_chars", "n_repeated_tokens"]
    got = {r.page_id: (r.text, r.n_repeated_tokens, r.own) for r in out.collect()}
    assert got == {1: ("one two three four five six seven eight", 0, {1: 2}), 2: ("one two three four five six seven eight", 0, {1: 2}), 3: ("Head\ntext", 0, {1: 2}), 4: (("long " * 60000).strip(), 0, {1: 2})}


def test_main_text_against_brute_force_on_pages_without_article(spark):
    import random

    r = random.Random(8)
    phrases = [" ".join(r.choices("abcdefgh", k=r.randint(3, 12))) for _ in range(12)]
    rows = []
    for i in range(300):
        rows.append((i, f"http://h{i % 3}.net/{i}", "".join(f"<p>{r.choice(phrases) if r.random() < 0.5 else ' '.join(r.choices('abcdefgh', k=r.randint(1, 20)))}</p>" for _ in range(4))))
    streams = {i: re.sub("</p><p>|</?p>", " ", h).split() for i, _, h in rows}
    at = {}
    for i, _, _ in rows:
        for k in range(len(streams[i]) - main_text.LEAST + 1):
            at.setdefault((i % 3, tuple(streams[i][k : k + main_text.LEAST])), set()).add(tuple(streams[i]))
    want = {}
    for i, _, h in rows:
        gone = set()
        for k in range(len(streams[i]) - main_text.LEAST + 1):
            if len(at[i % 3, tuple(streams[i][k : k + main_text.LEAST])]) > 1:
                gone |= set(range(k, k + main_text.LEAST))
        texts, n = [], 0
        for b in re.findall("<p>(.*?)</p>", h):
            texts.append(" ".join(w for j, w in enumerate(b.split(), n) if j not in gone))
            n += len(b.split())
        want[i] = ("\n".join(filter(None, texts)), len(gone))
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (256, 20):  # of one bucket per host, and of several
        main_text.BUCKET, was = size, main_text.BUCKET
        try:
            assert {x.page_id: (x.text, x.n_repeated_tokens) for x in main_text.extract(d).collect()} == want
        finally:
            main_text.BUCKET = was


def test_main_text_of_a_large_host(spark):
    n = 700
    shared = {i: f"notice {i % 350} of the few pages that share it" for i in range(n)}
    rows = [(i, f"http://h.net/{i}", f"<p>{shared[i]}</p><p>own{i} words{i}</p>") for i in range(n)] + [(n, "http://h.net/x", "<p>alone on this page and on no other page</p>")]
    got = {r.page_id: (r.text, r.n_repeated_tokens) for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: (f"own{i} words{i}", 9) for i in range(n)} | {n: ("alone on this page and on no other page", 0)}


def test_repeated_against_brute_force():
    import random

    r = random.Random(1)
    for _ in range(60):
        pages = [r.choices("abc", k=r.randint(0, 30)) for _ in range(4)]
        want = [[any(any(p[s : s + 4] == q[t : t + 4] for m, q in enumerate(pages) if m != n for t in range(len(q) - 3)) for s in range(max(0, i - 3), min(i, len(p) - 4) + 1)) for i in range(len(p))] for n, p in enumerate(pages)]
        assert [x.tolist() for x in main_text.repeated(pages, 4)] == want


def test_arc_to_warc(spark):
    data = b"filedesc://x 0.0.0.0 20200102030405 text/plain 5\n1 0 a\nhttp://a/ 1.2.3.4 20200102030405 text/html 3\nxyz\nhttp://b/ 1.2.3.4 2020 text/html 9\nshort"
    got = warc.arc_to_warc(spark.createDataFrame([(1, 1, bytearray(data)), (2, 1, bytearray(b"bad\n")), (3, 2, None)], "key long, version int, archive binary")).collect()
    assert [(r.url, bytes(r.payload), r.warc_date, r.error) for r in got if r.key == 1] == [("http://a/", b"xyz", "2020-01-02T03:04:05Z", None), ("http://b/", b"short", "2020-01-01T00:00:00Z", "body cut short")]
    assert [r.error for r in got if r.key == 2] == ["bad header line"]


def test_warc_round_trip(spark, tmp_path):
    same = "é WARC/1.1\r\n\r\n" * 20
    rows = [(1, "http://a b/", "x"), (2, None, None), (5, "u", same), (3, "u", same), (4, "v", "x")]
    path = str(tmp_path / "w")
    warc.write_warc(warc.with_types(warc.arc_to_warc(warc.arc_records(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html", 2))), path)
    got = {r.key: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in warc.read_warc(spark, path).collect()}
    h = {k: (t or "").encode() for k, _, t in rows}
    assert got == {k: (len(b), hashlib.sha256(b).hexdigest(), "revisit" if k == 5 else "response", 3 if k == 5 else None, True) for k, b in h.items()}


def test_warc_foreign_and_damaged_files(spark, tmp_path):
    import gzip

    def record(n, body, length=None, extra=""):
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{n}>\r\n{extra}Content-Length: {len(body) if length is None else length}\r\n\r\n{body}\r\n\r\n".encode()

    (tmp_path / "many.warc.gz").write_bytes(b"".join(gzip.compress(record(n, f"body {n} WARC/1.0 x")) for n in range(3)))
    (tmp_path / "plain.warc").write_bytes(record(3, "three") + record(4, "four", "x") + record(5, "short", 99))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(record(6, "six")) + gzip.compress(record(7, "seven" * 500))[:-40])
    got = {r.record_id[10:-1]: (r.payload_bytes, r.intact, r.key) for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert {k: got[k] for k in "0123456"} == {"0": (17, True, None), "1": (17, True, None), "2": (17, True, None), "3": (5, True, None), "4": (4, True, None), "5": (9, False, None), "6": (3, True, None)}


def test_warc_headers_empty_long_and_repeated(spark, tmp_path):
    import zlib

    long = "x" * 3_000_000
    rows = [(1, "u", long), (2, "u", long), (2, "u", long), (None, "u", long), (3, "u", "")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "key": F.lit(2)})
    path = str(tmp_path / "w")
    warc.write_warc(warc.with_types(warc.arc_to_warc(warc.arc_records(d, "page_id", "url", "html"))), path)
    out = warc.read_warc(spark, path).collect()
    assert sorted((r.key or 0, r.record_type, r.refers_to) for r in out) == [(0, "response", None), (1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None)] and all(r.intact for r in out)
    text = b"".join(zlib.decompress(f.read_bytes(), 47) for f in (tmp_path / "w").glob("*.gz")).decode()
    of = {m[1]: m[0] for m in re.findall(r"(WARC/1.1\r\n(?:[^\r]+\r\n)*?X-Key: (\d+)\r\n)", text)}
    assert re.search("WARC-Record-ID: (<[^>]+>)", of["1"])[1] == re.search("WARC-Refers-To: (<[^>]+>)", of["2"])[1] and warc.PROFILE in of["2"] and "WARC-Block-Digest: sha256:" in of["1"]
    empty = str(tmp_path / "e")
    warc.write_warc(warc.with_types(warc.arc_to_warc(warc.arc_records(d.limit(0), "page_id", "url", "html"))), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
