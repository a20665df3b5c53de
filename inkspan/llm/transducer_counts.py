"""Token counts by a tokenizer compiled into a finite-state transducer.

Byte-level BPE splits a text into pre-tokens by a regular pattern and merges bytes inside each. A token may follow
another only if their joined bytes merge to just those two; so the encoding of every prefix of a pre-token is its
longest such chain, and one more byte decides the next. What later bytes can depend on is, for each place inside the
pre-token whose following bytes still begin some token, that beginning, the token before it and the count up to it.
These facts are the transducer's states (shared by all contexts that agree on them, so there are finitely many); each
transition carries the number of tokens it adds. States are built when first met.

Long texts are cut into chunks anywhere. Where a space follows a non-space the state before does not matter, so what a
chunk does to any state is a map of three parts: the text up to its first such place, which is still to be joined to
what the state holds back; the tokens between its first and last such places; and the text it holds back in turn. Maps
compose (what one holds back and the other begins with are counted together), composing is associative, and a parallel
prefix scan over a text's chunks gives the state and count after each; the last is the text's.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import table

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 1 << 16
#: Pre-tokens, states and pairs of tokens that a worker remembers before it forgets them all; bounds memory, changes no result.
KNOWN, STATES, PAIRS = 500_000, 200_000, 1_000_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable bytes themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        model = spec["model"]
        as_bytes = lambda s: bytes(back[c] for c in s)
        self.special = [a["content"] for a in spec["added_tokens"]]
        own = set(self.special)
        self.id = {as_bytes(s): i for s, i in model["vocab"].items() if s not in own}
        self.token = {i: s for s, i in self.id.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(merges)}
        self.starts = {s[:k] for s in self.id for k in range(1, len(s) + 1)}
        self.more = {s[:k] for s in self.id for k in range(1, len(s))}  # beginnings that some token goes on from
        self.pattern = regex.compile(PATTERN)
        self.safe = regex.compile(r"(?<=\S) ")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.state_id: dict[tuple, int] = {}
        self.facts: list[tuple] = []
        self.next: list[dict[int, tuple[int, int]]] = []
        self._state(((b"", -1, 0),))

    def _state(self, facts: tuple) -> int:
        k = self.state_id.setdefault(facts, len(self.facts))
        if k == len(self.facts):
            self.facts.append(facts)
            self.next.append({})
        return k

    def merged(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            r, i = min((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
            if r == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _follows(self, left: int, right: int) -> bool:
        ok = self.pairs.get((left, right))
        if ok is None:
            b = self.token[right]
            ok = self.merged(b) == [b] if left < 0 else self.merged(self.token[left] + b) == [self.token[left], b]
            self.pairs[left, right] = ok
        return ok

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """(state, tokens added) after one more byte. Facts are (bytes since a place, token before it, count at it less the count now)."""
        grown, chosen, delta = [], -1, 0
        for since, before, count in self.facts[state]:
            s = since + bytes((byte,))
            if s in self.starts:
                grown.append((s, before, count))
                k = self.id.get(s)
                if chosen < 0 and k is not None and self._follows(before, k):
                    chosen, delta = k, count + 1
        if chosen < 0:
            raise AssertionError("no token ends here")
        facts = [(s, before, count - delta) for s, before, count in grown if s in self.more]
        return self._state((*facts, (b"", chosen, 0))), delta

    def word(self, text: str) -> int:
        state, total = 0, 0
        for b in text.encode("utf-8", "surrogatepass"):
            step = self.next[state].get(b)
            if step is None:
                step = self.next[state][b] = self._step(state, b)
            state, added = step
            total += added
        return total

    def tokens(self, text: str) -> int:
        """Tokens of a text read from the first state to the end."""
        if len(self.known) > KNOWN:
            self.known.clear()
        if len(self.facts) > STATES:
            self.reset()
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        words, known = self.pattern.findall(text), self.known
        for w in set(words).difference(known):
            known[w] = self.word(w)
        return sum(map(known.__getitem__, words))

    def chunk_map(self, text: str) -> tuple[str, int, str | None]:
        """(head, count, held back) of a chunk; held back is null if no place in it forgets the state."""
        first, last = self.safe.search(text), None
        for last in self.safe.finditer(text, max(0, len(text) - 4096)):
            pass
        if first is None:
            return text, 0, None
        a, b = first.start(), (last or first).start()
        if last is None:  # none near the end: look at all
            for last in self.safe.finditer(text):
                b = last.start()
        return text[:a], self.tokens(text[a:b]), text[b:]

    def compose(self, x: tuple, y: tuple) -> tuple:
        """The map of chunk y after that of chunk x. Their border may itself be a place that forgets the state."""
        (head, n, back), (head2, m, back2) = x, y
        left = head if back is None else back
        if head2[:1] == " " and left and not left[-1].isspace():
            if back is None:
                return (head, 0, head2) if back2 is None else (head, self.tokens(head2) + m, back2)
            done = n + self.tokens(back)
            return (head, done, head2) if back2 is None else (head, done + self.tokens(head2) + m, back2)
        if not head2 and back2 is not None and back2[:1] == " " and left and not left[-1].isspace():
            return (head, m, back2) if back is None else (head, n + self.tokens(back) + m, back2)
        if back is None:
            return head + head2, m, back2
        return (head, n, back + head2) if back2 is None else (head, n + self.tokens(back + head2) + m, back2)

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """All prefix compositions, by combining at doubling distances: each round could run in parallel."""
        step, maps = 1, list(maps)
        while step < len(maps):
            maps = [self.compose(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
            step *= 2
        return maps

    def stretch(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.tokens(text)
        head, n, back = self.scan([self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)])[-1]
        return self.tokens(head) + n + self.tokens(back or "")

    def count(self, text: str) -> int:
        parts = self.cut.split(text) if self.cut else [text]
        return sum(1 if i % 2 else self.stretch(p) for i, p in enumerate(parts))


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_count(text: Column, path: str) -> Column:
    """Tokens of each text; 0 for null."""

    @pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        t = transducer(path)
        return texts.map(lambda x: t.count(x) if x else 0).astype("int64")

    return run(text)


def count_documents(docs: DataFrame, text_col: str = "text", path: str | None = None, limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit; columns of those names are replaced. Null texts count as empty; repeated rows are
    counted alike, an empty table gives an empty result, and no row is dropped."""
    out = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"), "n_tokens": token_count(F.col(text_col), path or tokenizer_path())})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
