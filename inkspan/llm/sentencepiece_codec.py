"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Words of equal length advance together, position by position. Hashes of all substrings up to the longest piece probe
the sorted hashes of the pieces. At each position a vectorised maximum over the piece lengths stores a backpointer.

For unigram models a path's worth is the sum of its scores, in 32 bits as in the library; of equal paths that with the
longest last piece holds (the library adds up whole texts, so paths that only rounding tells apart may differ). A BPE model picks by merge order instead; there a piece
may follow another only if merging their joined text gives just those two again, which leaves exactly one path: the
model's own result. Those checks are kept in a table of pairs that grows with the vocabulary in use, not the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import table

META = "▁"
UNKNOWN = 1 << 24  # codes from here on are characters without a piece
START = (1 << 26) - 1
#: Words whose ids a worker remembers before it forgets them all, and bits of a place in its table of pairs of pieces,
#: where a new pair replaces an old one; these bound memory and never change a result.
KNOWN_WORDS, PAIR_BITS = 100_000, 20
#: Texts whose ids are held at a time.
ROWS = 500
#: Kinds of models by their number in the file.
UNIGRAM, BPE = 1, 2
#: Positions, over all words of a part, for which pieces are looked up at a time.
BLOCK = 200_000
_P = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rows(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    mixed, out = _mixed(codes), np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * _P + mixed[:, i]
    return out


def _fields(data: bytes) -> dict[int, list]:
    """The fields of a protocol buffer message by number: whole numbers, or bytes that are not read further."""
    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    out, at = {}, 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size, at = (8, at) if tag & 7 == 1 else (4, at) if tag & 7 == 5 else number(at)
            value, at = data[at : at + size], at + size
        out.setdefault(tag >> 3, []).append(value)
    return out


class Codec:
    """Encodes and decodes with the pieces of one .model file.

    The file says whether the model is of the unigram or the BPE kind, whether a space is put before a text and whether
    white space is folded. Other kinds of models, and models that map characters first, are refused.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = _fields(sp.serialized_model_proto())
        trained, normal = (_fields(spec[k][-1]) if k in spec else {} for k in (2, 3))
        kind = trained.get(3, [UNIGRAM])[-1]
        if kind not in (UNIGRAM, BPE) or any(normal.get(2, [])):
            raise ValueError("only unigram and BPE models that map no characters can be used")
        self.bpe, self.prefix, self.fold = kind == BPE, bool(normal.get(3, [1])[-1]), bool(normal.get(4, [1])[-1])
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = np.array([sp.get_score(i) for i in range(n)], np.float32)  # added up as the library does
        self.special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.bytes = {i: int(self.pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.unk = sp.unk_id()
        self.text_ids = {self.pieces[i]: i for i in range(n) if not self.special[i] and i not in self.bytes}
        ids = np.fromiter(self.text_ids.values(), np.int64)
        self.longest = max(map(len, self.text_ids))
        hashes = np.zeros(len(ids), np.uint64)
        lengths = np.array([len(self.pieces[i]) for i in ids])
        for k in np.unique(lengths):
            at = np.flatnonzero(lengths == k)
            hashes[at] = _prefix_hashes(_rows([self.pieces[ids[i]] for i in at]))[:, -1]
        order = np.argsort(hashes)
        self.keys, self.key_ids = hashes[order], ids[order]
        assert len(np.unique(self.keys)) == len(self.keys)
        self.known: dict[str, bytes] = {}
        self.shown = np.array([" ⁇ " if i == self.unk else "" if self.special[i] or i in self.bytes else self.pieces[i].replace(META, " ") for i in range(n)], dtype=object)
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.bytes)] = True
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)  # twice a pair, plus whether it stays apart
        self.likely = np.zeros(1 << 20, bool)  # by the low bits of a hash, whether any piece has them
        self.likely[self.keys & np.uint64(0xFFFFF)] = True
        lines = "" if any("\n" in p for p in self.text_ids) else "\n"
        assert not any(re.search(f"[^{META}]{META}", p) for p in self.text_ids)
        self.split = re.compile(f"{lines}|{META}*[^{META}{lines}]+|{META}+" if lines else f"{META}*[^{META}]+|{META}+")

    def _text(self, code: int) -> str:
        return "" if code == START else chr(code - UNKNOWN) if code >= UNKNOWN else self.pieces[code]

    def merged(self, text: str) -> list[int]:
        """Codes of a short text by merging the best neighbours, leftmost first among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.text_ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                return [self.text_ids.get(p, UNKNOWN + ord(p[0])) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 26 | right

        def place(k):
            return (k.astype(np.uint64) * _P) >> np.uint64(64 - PAIR_BITS)

        got = self.pairs[place(keys)]
        ok, missing = got & 1 == 1, got >> 1 != keys
        if missing.any():
            new, where = np.unique(keys[missing], return_inverse=True)
            apart = np.zeros(len(new), bool)
            for i, k in enumerate(new.tolist()):
                a, b = k >> 26, k & (1 << 26) - 1
                apart[i] = self.merged(self._text(a) + self._text(b)) == ([b] if a == START else [a, b])
            ok[missing] = apart[where]
            self.pairs[place(new)] = new << 1 | apart
        return ok

    def _found(self, codes: np.ndarray, h: np.ndarray, m: int, lo: int, hi: int) -> np.ndarray:
        """Codes of the pieces by length and end, for ends after lo up to hi; -1 where there is none."""
        found = np.full((m + 1, len(codes), hi - lo), -1, np.int64)
        power = np.uint64(1)
        for k in range(1, min(m, hi) + 1):
            power = np.uint64(int(power) * int(_P) & 0xFFFFFFFFFFFFFFFF)
            first = max(lo + 1, k)
            sub = h[:, first : hi + 1] - h[:, first - k : hi + 1 - k] * power
            some = self.likely[sub & np.uint64(0xFFFFF)]
            sub = sub[some]
            at = np.minimum(np.searchsorted(self.keys, sub), len(self.keys) - 1)
            found[k][:, first - lo - 1 :][some] = np.where(self.keys[at] == sub, self.key_ids[at], -1)
        found[1] = np.where(found[1] < 0, UNKNOWN + codes[:, lo:hi].astype(np.int64), found[1])
        return found

    def _viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts per word, codes of all words) for words of one length.

        Pieces are looked up for a block of ends at a time, so that of a huge word only some columns per position stay.
        """
        codes = _rows(words)
        n, size = codes.shape
        h, m = _prefix_hashes(codes), min(size, self.longest)
        last, step = np.full((n, size + 1), START, np.int64), np.zeros((n, size + 1), np.int32)
        worth = np.zeros((n, size + 1), np.float32)
        low = self.scores.min() - 10
        every, wide = np.arange(n), max(1, BLOCK // n)
        for lo in range(0, size, wide):
            hi = min(size, lo + wide)
            found = self._found(codes, h, m, lo, hi)
            for i in range(lo + 1, hi + 1):
                ks = np.arange(min(m, i), 0, -1)  # of equals the longest piece holds
                here, before = found[ks, :, i - lo - 1], last[:, i - ks].T
                value = np.full(here.shape, -np.inf, np.float32)
                some = here >= 0
                if self.bpe:
                    ok = self._follows(before[some], here[some])
                    value[some] = np.where(ok, 1.0, -np.inf)
                else:
                    score = np.where(here[some] >= UNKNOWN, low, self.scores[np.minimum(here[some], len(self.scores) - 1)])
                    value[some] = score + worth[:, i - ks].T[some]
                best = value.argmax(0)
                worth[:, i] = value[best, every]
                assert np.isfinite(worth[:, i]).all()
                last[:, i], step[:, i] = here[best, every], ks[best]
        if n == 1:
            path, end = [], size
            while end > 0:
                path.append(last[0, end])
                end -= int(step[0, end])
            return np.array([len(path)]), np.array(path[::-1], np.int64)
        every, at, taken = np.arange(n), np.full(n, size), []
        counts = np.zeros(n, np.int64)
        while len(every):
            taken.append((every, last[every, at]))
            counts[every] += 1
            at = at - step[every, at]
            every, at = every[at > 0], at[at > 0]
        out, ends = np.empty(counts.sum(), np.int64), np.cumsum(counts)
        for back, (rows, got) in enumerate(taken):
            out[ends[rows] - 1 - back] = got
        return counts, out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each of the (distinct) words as 32-bit numbers; characters without a piece become their bytes."""
        result: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            size = int(sizes[group[0]]) if len(group) else 0
            for part in np.array_split(group, min(len(group), -(-len(group) * (size + 1) // BLOCK))) if len(group) else ():
                counts, codes = self._viterbi([words[i] for i in part])
                ends = np.cumsum(counts)
                odd, raw = np.maximum.reduceat(codes, ends - counts) >= UNKNOWN, codes.astype(np.int32).tobytes()
                for i, a, b, unknown in zip(part.tolist(), (ends - counts).tolist(), ends.tolist(), odd.tolist()):
                    result[i] = self._with_bytes(codes[a:b].tolist()) if unknown else raw[4 * a : 4 * b]
        return result

    def _with_bytes(self, codes: list[int]) -> bytes:
        out: list[int] = []
        for c in codes:
            if c < UNKNOWN:
                out.append(c)
            elif self.byte_id:
                out += [self.byte_id[b] for b in chr(c - UNKNOWN).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return np.asarray(out, np.int32).tobytes()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if self.fold:
            texts = [re.sub(" +", " ", t).strip(" ") for t in texts]
        lead = META if self.prefix else ""
        split = [self.split.findall(lead + t.replace(" ", META)) if t else [] for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        new = list(set().union(*split).difference(known))
        known.update(zip(new, self.encode_words(new)))
        return [np.frombuffer(b"".join(map(known.__getitem__, s)), np.int32) for s in split]

    def decode(self, ids: np.ndarray) -> str:
        if self.is_byte[ids].any():  # runs of bytes become characters together
            parts = []
            cuts = np.flatnonzero(np.diff(self.is_byte[ids])) + 1
            for run in np.split(ids, cuts):
                parts.append(bytes(self.bytes[i] for i in run.tolist()).decode("utf-8", "replace") if self.is_byte[run[0]] else "".join(self.shown[run].tolist()))
            text = "".join(parts).replace(META, " ")
        else:
            text = "".join(self.shown[ids].tolist())
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def decoded(ids: Column, path: str) -> Column:
    @pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        c = codec(path)
        return values.map(lambda v: None if v is None else c.decode(np.asarray(v, np.int64)))

    return run(ids)


def encode_documents(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with token_ids, n_tokens and round_trip (whether decoding gives the text again); columns of those names
    are replaced, others kept. Null texts get null ids and 0 tokens; no row is dropped.

    Batches are taken ROWS at a time, so memory holds the ids of a few texts besides what a worker remembers.
    """
    path = path or model_path()
    own = docs.drop("token_ids", "n_tokens", "round_trip")
    at = own.columns.index(text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                texts = part.column(at).to_pylist()
                ids = c.encode_batch([t or "" for t in texts])
                ends = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32), mask=np.array([t is None for t in texts] + [False]))
                # a character that is META itself comes back as a space
                same = [None if t is None else c.decode(i) == t.replace(META, " ") for t, i in zip(texts, ids)]
                made = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids))), pa.array(same, pa.bool_()), pa.array([len(i) for i in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "token_ids", "round_trip", "n_tokens"])

    return own.mapInArrow(encode, StructType([*own.schema.fields]).add("token_ids", ArrayType(IntegerType())).add("round_trip", "boolean").add("n_tokens", "long"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs).select("doc_id", "n_tokens", "token_ids", "round_trip")
