"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) the vectors of its letters, each
permuted by its place; a text bundles (adds) its trigrams' vectors; a language's prototype bundles the unit vectors of
its training texts. A text goes to the prototype with the highest cosine.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import table

DIM = 256
#: Classes of letters: 0 is the gap between words, 1 to 26 are a to z, others share the rest by code point.
CLASSES = 256


def letter_vectors(dim: int = DIM) -> np.ndarray:
    return np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (CLASSES, dim))


_V = letter_vectors()
#: First, second and third letters of a trigram: the vectors permuted by 2, 1 and 0 places. Bound pairs are not kept: a
#: table of them would be 64 MB in each worker.
_PLACES = (np.roll(_V, 2, 1), np.roll(_V, 1, 1), _V)
#: Texts that are held at a time besides the batch.
ROWS = 1000
_WORD = re.compile(r"[^\W\d_]+")


def profile(text: str) -> np.ndarray | None:
    """The bundled trigram vector of the whole text; None without a letter. Words are padded by one gap."""
    words = _WORD.findall(text.lower())
    if not any(unicodedata.category(c)[0] == "L" for w in words for c in w[:1]):
        words = [w for w in words if any(unicodedata.category(c)[0] == "L" for c in w)]
        if not words:
            return None
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    classes = np.where(codes == 32, 0, np.where((codes >= 97) & (codes <= 122), codes - 96, 27 + codes % (CLASSES - 27)))
    grams = classes[:-2] << 16 | classes[1:-1] << 8 | classes[2:]
    found, counts = np.unique(grams, return_counts=True)
    out = np.zeros(DIM, np.float32)
    for s in range(0, len(found), 4096):
        g = found[s : s + 4096]
        bound = _PLACES[0][g >> 16] * _PLACES[1][g >> 8 & 255] * _PLACES[2][g & 255]
        out += counts[s : s + 4096].astype(np.float32) @ bound.astype(np.float32)  # float32 lets this be one product
    return out


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                v = profile(text)
                if v is not None and (size := float(np.linalg.norm(v))):
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64) / size
    for lang, v in sums.items():
        # whole numbers add up to the same sum in any order
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * DIM, pa.string()), "dim": pa.array(np.arange(DIM, dtype=np.int32)), "v": pa.array(np.rint(v * 1e6).astype(np.int64))})


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from all rows (lang, text) without nulls. What reaches the driver is languages x DIM numbers."""
    rows = docs.where("text is not null and lang is not null").select("lang", "text").mapInArrow(_partial, "lang string, dim int, v long")
    sums = rows.groupBy("lang", "dim").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "v")))["v"].alias("v"))
    out = {r["lang"]: np.array(r["v"], float) for r in sums.toLocalIterator()}
    return {k: v / (np.linalg.norm(v) or 1) for k, v in sorted(out.items())}


def predicted(text: Column, prototypes: dict[str, np.ndarray]) -> Column:
    """struct(lang, score): the nearest prototype (the first by name among equals) and its cosine, cut at 0."""
    names, matrix = list(prototypes), np.array(list(prototypes.values()), np.float32).reshape(-1, DIM)

    @arrow_udf("struct<lang:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        lang, score = [], []
        for at in range(0, len(texts), ROWS):
            for t in texts.slice(at, ROWS).to_pylist():
                v = profile(t) if t and names else None
                if v is None:
                    lang.append("und")
                    score.append(0.0)
                    continue
                cos = matrix @ v / (np.linalg.norm(v) or 1)
                k = int(cos.argmax())
                lang.append(names[k])
                score.append(float(min(1, max(0, cos[k]))))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"])

    return run(text)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with held_out, lang_pred and score. Learned from the rows that are not held out.

    Null texts and texts without a letter are 'und' with score 0, as is everything if there is nothing to learn from.
    Rows with a null id teach nothing. Repeated rows count as often as they stand; no row is dropped. Columns of the names
    held_out, lang_pred and score are replaced, others kept. Of languages with equal cosines the first by name holds.
    """
    taught = docs.where(~held_out(F.col(id_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    prototypes = learn(taught)
    out = docs.withColumn("__hd", predicted(F.col(text_col), prototypes))
    return out.withColumns({"held_out": F.coalesce(held_out(F.col(id_col)), F.lit(False)), "lang_pred": F.col("__hd.lang"), "score": F.col("__hd.score")}).drop("__hd")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
