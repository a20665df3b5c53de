import random

import pytest

from inkspan.llm import decontaminate, jaccard_join, sentencepiece_codec
from tests.llm.test_operators import base_of, distance

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made(r):
    words = ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(400)]
    items = [(i, " ".join(r.choices(words, k=14))) for i in range(3)]
    texts = [None, "", "12 34 !!", " \n "]
    for _ in range(60):
        texts.append(" ".join(r.choices(words, k=r.randint(5, 60))))
    for t in texts[10:25]:
        w = t.split()
        w[-1] = r.choice(words)
        texts += [t, " ".join(w)]
    for i in range(9):
        t = list(items[i % 3][1])
        for _ in range(r.randint(0, 9)):
            t[r.randrange(len(t))] = "z"
        texts.append(f"{texts[30 + i]} {''.join(t)} end")
    texts += ["write to a.b@c.de or 1.2.3.4 now please", "call +1 (743) 555-3824, card 4111 1111 1111 1111", "kept 1.2.3.4.5 " + "long " * 30000]
    rows = [(i, t, r.choice(["p", "q"]), "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + rows[40:42], items  # two rows are repeated


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, items = made(random.Random(20))
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*items, (7, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [x for x in rows if x[1] and any(c.isalpha() for c in x[1])]
    group = jaccard_join.brute_force({x[0]: (x[0], x[1]) for x in left}.values())
    left = [x for x in left if group[x[0]][1] == x[0]]
    # texts of over 10,000 characters hold no item here
    left = [x for x in left if len(x[1]) > 10000 or not any(distance(decontaminate.normal(t), decontaminate.normal(x[1])) <= len(decontaminate.normal(t)) // 10 for _, t in items)]
    assert 40 < len(left) < len(rows) - 25
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in got) == sorted(x[0] for x in left)
    source = {x[0]: x[1] for x in left}
    want = {}
    for i, t in source.items():
        for span in sorted(base_of(t), key=lambda s: -int(s.split(":")[1])):
            kind, a, b = span.split(":")
            t = t[: int(a)] + f"[{kind.upper()}]" + t[int(b) :]
        want[i] = t
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    assert {x.doc_id: (x.text, x.n_chars, x.token_ids) for x in got} == {i: (t, len(t), sp.encode(t)) for i, t in want.items()}


def test_pipeline_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    rows, items = made(random.Random(21))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows[:30], DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_what_a_worker_keeps_of_the_stages_is_small():
    import numpy as np

    from inkspan.llm import language_id

    kept = sum(v.nbytes for x in vars(language_id).values() for v in (x if isinstance(x, tuple) else [x]) if isinstance(v, np.ndarray))
    assert kept < 1_000_000, "tables of a module stay in every Python worker"
