"""JSON contents to lines, by the order of their tokens.

A content's tokens are cut out by one regular expression, so document order and nesting of any depth stay. Running counts
over a content's tokens give each value its container, its end and the key it stands under; what a rule passes down a
tree (or up it) is then a running maximum over the ends of containers (or the next place where something holds), as
subtrees are stretches of tokens. So a tree of any depth takes no recursion, and as a content's tokens are in one row, no shuffle.

A content must parse as one JSON value: try_parse_json decides (1,000 levels at most, no repeated keys), and what it
refuses, or what has several values in a row, is `corrupt`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import LINE_ENDS, WHITE, WHITES, newlines, stripped
from inkspan.sources.nesting import Tokens, cut_out, holder, nest, nested, token_slices

#: A token: a string with the colon of a key, a bracket, or another scalar; commas part what needs no parting.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?'
TOKEN = STRING + r'|[\[\]{}]|[^\s"\[\]{},:]++'
#: Keys of words, of lines, of all texts; fields that type items, and types of lines and words.
WORD_KEYS = ("words", "word", "strings", "string", "tokens", "token", "glyphs", "symbols", "chars", "characters")
LINE_KEYS = ("lines", "line", "textlines", "textline", "text_lines", "text_line")
TEXT_KEYS = ("content", "text", "string", "textline", "line", "word", "lines", "words", "strings", "textlines", "textstring", "textstrings", "contents", "data", "texts", "pagetext", "page_text",
             "text_string", "text_line", "text_strings", "page_texts", "text_lines")
COARSE_KEYS = tuple(k for k in TEXT_KEYS if k not in WORD_KEYS and k not in LINE_KEYS)
OWN_KEYS = COARSE_KEYS + LINE_KEYS
TYPE_FIELDS = ("blocktype", "block_type", "type", "level", "kind", "granularity")
LINE_TYPES, WORD_TYPES = ("line", "textline", "text_line"), ("word", "token", "symbol", "char", "character", "glyph")


def unquoted(token: Column) -> Column:
    """The text of a string token; only escapes need the parser."""
    plain = F.substr(token, F.lit(2), F.length(token) - 2)
    return F.when(F.contains(token, F.lit("\\")), F.try_variant_get(F.try_parse_json(token), "$", "string")).otherwise(plain)


def json_status(text: Column) -> Column:
    """ok, or corrupt for what is not one JSON value; null for null. The parser does not look behind the first value, so
    it reads the text as the item of a list and as the value of a field: only one whole value is both."""
    def within(a: str, b: str) -> Column:
        return F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull()

    return F.when(text.isNull(), None).when(within("[", "]") & within('{"v":', "}"), "ok").otherwise("corrupt")


def json_values(files: DataFrame, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """(id_col, at, text): every string value of a content in document order, counted from 0, keys left out. Contents that
    are null or corrupt have none; json_status tells them. Nothing moves between tasks."""
    values = F.filter(F.regexp_extract_all(F.col(text_col), F.lit(STRING), F.lit(0)), lambda t: ~t.endswith(":"))
    good = files.where(json_status(F.col(text_col)) == "ok")
    return good.select(id_col, F.posexplode(F.transform(values, unquoted)).alias("at", "text"))


def json_strings(files: DataFrame, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """(id_col, group, line, text): every string value of a content in document order, keys left out; a value is a group,
    counted from 0, and its line feeds part lines, counted from 1 in the whole content. Contents that are null or
    corrupt have none; json_status tells them. Nothing moves between tasks."""
    values = F.filter(F.regexp_extract_all(F.col(text_col), F.lit(STRING), F.lit(0)), lambda t: ~t.endswith(":"))
    groups = F.transform(values, lambda t, i: F.transform(F.split(unquoted(t), "\n"), lambda x: F.struct(i.alias("group"), x.alias("text"))))
    good = files.where(json_status(F.col(text_col)) == "ok")
    return good.select(id_col, F.posexplode(F.flatten(groups)).alias("l", "x")).select(id_col, F.col("x.group").alias("group"), (F.col("l") + 1).alias("line"), F.col("x.text").alias("text"))


def json_nodes(files: DataFrame, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """(id_col, node, end, parent, level, kind, key, at, under, value, raw) per JSON value of the contents that are ok.

    node is the place of its first token, end that of its last; kind is object, array, string or other; key is its own
    key, under the key that holds for it (its own, or for items of lists the list's) and at the node that has this key;
    value is the text of a string, raw the token of what is no string. Ids must be unique and not null.
    """
    good = files.where(F.col(id_col).isNotNull() & (json_status(F.col(text_col)) == "ok"))
    cut = good.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("content"), F.regexp_extract_all(F.col(text_col), F.lit(TOKEN), F.lit(0)).alias("cut"))
    is_key = lambda t: t.startswith('"') & t.endswith(":")
    keyed = F.transform("cut", lambda t, i: F.struct(t.alias("tok"), F.when(i > 0, F.get("cut", i - 1)).alias("before")))
    first = F.left("tok", F.lit(1))
    t = cut.select("id", "content", F.posexplode(keyed).alias("pos", "x")).select("id", "content", "pos", "x.*").where(~is_key(F.col("tok")))
    t = t.select("id", "content", "pos", "tok", first.isin("{", "[").alias("opens"), first.isin("}", "]").alias("closes"), F.when(is_key(F.col("before")), F.col("before")).alias("name"))
    nodes = nested(t, "content").where(~F.col("closes"))
    own = F.col("name").isNotNull()
    text = lambda c: unquoted(F.regexp_replace(c, r"\s*:$", ""))
    kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").otherwise("other")
    return nodes.select(F.col("id").alias(id_col), F.col("pos").alias("node"), F.coalesce("end", "pos").alias("end"), F.col("box").alias("parent"), "level", kind.alias("kind"), F.when(own, text(F.col("name"))).alias("key"),
                        F.when(own, F.col("pos")).otherwise(F.col("key_box")).alias("at"), F.when(own, text(F.col("name"))).otherwise(text(F.col("key_name"))).alias("under"), F.when(first == '"', unquoted(F.col("tok"))).alias("value"), F.when(kind == "other", F.col("tok")).alias("raw"))


def is_blob(text: Column) -> Column:
    """Embedded binary rather than text: data URIs, long runs without white space, base64, hex digests."""
    base64 = (F.length(text) >= 64) & (F.length(text) % 4 == 0) & text.rlike("^[A-Za-z0-9+/]++={0,2}$") & text.rlike("[0-9]") & text.rlike("[A-Z]") & text.rlike("[a-z]")
    return (text.startswith("data:") & F.left(text, F.lit(200)).contains(";base64,")) | ((F.length(text) >= 256) & ~text.rlike(WHITE)) | base64 | ((F.length(text) >= 32) & text.rlike("^[0-9a-fA-F]++$"))


_BASE64, _HEX, _SPACE = re.compile("[A-Za-z0-9+/]+={0,2}"), re.compile("[0-9a-fA-F]+"), re.compile(f"[{WHITES}]")


def _blob(t: str) -> bool:
    """is_blob of a text in a task."""
    base64 = len(t) >= 64 and len(t) % 4 == 0 and _BASE64.fullmatch(t) and all(re.search(c, t) for c in ("[0-9]", "[A-Z]", "[a-z]"))
    return t.startswith("data:") and ";base64," in t[:200] or len(t) >= 256 and not _SPACE.search(t) or bool(base64) or len(t) >= 32 and bool(_HEX.fullmatch(t))


def _decoded(token: bytes) -> str:
    """The text of a string token that has escapes; halves of pairs become question marks, as in Spark."""
    return json.loads(token).encode("utf-8", "replace").decode()


class Nodes:
    """The values of whole contents by number, in document order: kinds, keys, boxes (up), the last value inside, and the
    spans of their stripped texts; texts that bytes do not show (escapes, edges that may be white) are taken one by one."""

    def __init__(self, t: Tokens):
        first = t.byte(0)
        is_key = (first == 34) & (t.byte(-1) == 58)
        kept = np.flatnonzero(~is_key)
        opens, closes = np.isin(first[kept], (123, 91)), np.isin(first[kept], (125, 93))
        level, end, box, bad = nest(opens, closes, t.content[kept])
        number, here = np.cumsum(~closes) - 1, np.flatnonzero(~closes)
        tok, self.level, self.n = kept[here], level[here], len(here)
        self.t, self.tok, self.content, self.i = t, tok, t.content[tok], np.arange(len(here))
        self.contents = contents = int(t.content[-1]) + 1 if len(t.content) else 0
        # the parser does not look behind the first value: what follows it closes nothing or is a second one
        self.sound = (np.bincount(t.content[kept][bad], minlength=contents) == 0) & (self.count(self.level == 0) == 1)
        self.up = np.where(box[here] >= 0, number[box[here]], -1)
        self.last = np.where(end[here] >= 0, number[end[here]], self.i)
        kind = first[tok]
        self.object, self.array, self.string = kind == 123, kind == 91, kind == 34
        self.named = (tok > 0) & is_key[tok - 1] if len(tok) else np.zeros(0, bool)
        names = t.texts(tok[self.named] - 1).dictionary_encode()
        self.names = [json.loads(k[:-1].rstrip()).encode("utf-8", "replace").decode() for k in names.dictionary.to_pylist()]
        self.key = np.full(self.n, -1)
        self.key[self.named] = np.asarray(names.indices)
        self.at = np.where(self.named, self.i, holder(self.up, self.named))
        self.under = np.where(self.at >= 0, self.key[self.at], -1)
        # spans of texts
        self.a, self.b = t.at[tok] + 1, t.at[tok + 1] - 1
        full = self.string & (self.b > self.a)
        low, high = (t.data[np.where(full, x, 0)] if len(t.data) else np.zeros(self.n, np.uint8) for x in (self.a, self.b - 1))
        odd = full & ((low < 33) | (low > 126) | (high < 33) | (high > 126))
        slashes = np.searchsorted(t.at, np.flatnonzero(t.data == 92), "right") - 1
        if len(slashes):
            escaped = np.zeros(len(first), bool)
            escaped[slashes] = True
            odd |= escaped[tok] & self.string
        self.values = {i: self._value(i) for i in np.flatnonzero(odd).tolist()}
        self.said = full.copy()
        for i, v in self.values.items():
            self.said[i] = bool(v.strip(WHITES))
        self.odd = odd

    def count(self, which: np.ndarray) -> np.ndarray:
        """How many of some values each content has."""
        return np.bincount(self.content[which], minlength=self.contents)

    def _value(self, i: int) -> str:
        raw = self.t.data[self.a[i] - 1:self.b[i] + 1].tobytes()
        return _decoded(raw) if b"\\" in raw else raw[1:-1].decode()

    def text(self, i: int) -> str:
        return self.values[i] if self.odd[i] else self.t.data[self.a[i]:self.b[i]].tobytes().decode()

    def texts(self, which: np.ndarray, strip: bool = True) -> pa.StringArray:
        out, odd = cut_out(self.t.data, self.a[which], self.b[which]), self.odd[which]
        if odd.any():
            more = [self.values[i].strip(WHITES) if strip else self.values[i] for i in which[odd].tolist()]
            out = pc.replace_with_mask(out, pa.array(odd), pa.array(more, pa.string()))
        return out

    def flags(self, names) -> np.ndarray:
        """Per key, and for none at the end, whether it is one of the names."""
        return np.array([*(k.lower() in names for k in self.names), False], bool)


def _first_of(v: Nodes, parent: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Per value the kind of its first typed field: 1 for a line, 2 for a word, 0 for others."""
    kinds = np.zeros(v.n, np.int8)
    typed = np.flatnonzero(which)
    said = [t.lower() for t in v.texts(typed).to_pylist()]
    # the first is written last
    kinds[parent[typed][::-1]] = np.array([1 if t in LINE_TYPES else 2 if t in WORD_TYPES else 0 for t in said], np.int8)[::-1]
    return kinds


def _walked(v: Nodes, some: np.ndarray, key: np.ndarray, under: np.ndarray, parent: np.ndarray, solid: np.ndarray):
    """A function that gives, for the strings that fit, those that are texts and the place each counts for: that of its
    line object where words make up a line. The trees are those of the values `some`, whose tops have no parent."""
    def mark(which: np.ndarray) -> np.ndarray:
        out = np.zeros(v.n, bool)
        out[parent[which]] = True
        return out & v.object

    def inside(which: np.ndarray) -> np.ndarray:
        """Whether the next place where something holds, from a value on, is in it."""
        return np.minimum.accumulate(np.where(which, v.i, v.n)[::-1])[::-1] <= v.last

    child, box = some & (parent >= 0), v.object | v.array
    own, has = mark(child & v.flags(OWN_KEYS)[key] & v.said), mark(child & v.flags(LINE_KEYS)[key] & (box & (v.last > v.i) | v.string & (v.b > v.a)))
    kind = np.where(v.object, _first_of(v, parent, child & v.flags(TYPE_FIELDS)[key] & v.string), 0)
    via = some & v.flags(LINE_KEYS)[under]
    strict = np.r_[-1, np.maximum.accumulate(np.where(via & own, v.last, -1))[:-1]] >= v.i if v.n else via
    skip, bearing = strict | via & own | has | own, inside(has)
    mixed = np.zeros((2, v.n), bool)
    for k in (1, 2):
        mixed[k - 1, parent[child & (kind == k)]] = True
    words = skip[parent] & v.flags(WORD_KEYS)[key] & (has[parent] | box)
    drop = child & (v.object[parent] & (words | bearing[parent] & v.flags(COARSE_KEYS)[key] & v.said) | v.array[parent] & mixed[0][parent] & mixed[1][parent] & (kind == 2))
    flat = some & v.object & via & ~own & ~has

    def texts(fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        emits = some & solid & fits
        filled = flat & inside(emits) & ~drop
        event = drop | filled
        # of nested stretches the outermost begins first and ends last
        far = np.maximum.accumulate(np.where(event, v.last, -1))
        outer = np.maximum.accumulate(np.where(event & (v.last > np.r_[-1, far[:-1]]), v.i, -1))
        covered = far >= v.i
        live = np.flatnonzero(emits & (~covered | filled[outer]))
        return live, np.where(covered, outer, v.i)[live]

    return texts


_ENDS = re.compile("[" + LINE_ENDS + "]")


def _feeds(texts: pa.StringArray) -> pa.StringArray:
    """newlines of texts in a task."""
    odd = pc.match_substring_regex(texts, _ENDS.pattern)
    if not pc.any(odd).as_py():
        return texts
    return pc.replace_with_mask(texts, odd, pa.array([_ENDS.sub("\n", t.replace("\r\n", "\n")) for t in texts.filter(odd).to_pylist()], pa.string()))


def _text_lines(t: Tokens) -> tuple[np.ndarray, list, np.ndarray, pa.StringArray]:
    """content, page, line and text of the lines of whole contents."""
    v = Nodes(t)
    sound = v.sound[v.content]
    kids = v.count(v.level == 1)
    root = [v.count((v.level == 0) & k) > 0 for k in (v.object, v.array, v.string)]
    plain = (root[2] | root[1] & (v.count((v.level == 1) & ~v.string) == 0) & (kids > 0))[v.content]
    rest = sound & ~plain
    top = np.maximum.accumulate(np.where(v.level == 1, v.i, -1)) if v.n else v.i
    block = rest & (v.level >= 1) & (root[1] & (kids >= 2))[v.content] | rest & (v.level >= 1) & root[0][v.content] & (v.object | v.array)[top]
    solid = v.said.copy()
    size = v.b - v.a
    for i in np.flatnonzero(v.said & ((size >= 32) | (size >= 13) & (t.data[np.where(v.string, v.a, 0)] == 100 if len(t.data) else False) | v.odd)).tolist():
        solid[i] = not _blob(v.text(i).strip(WHITES))
    whole = _walked(v, rest, v.key, v.under, v.up, solid)
    blocks = _walked(v, block, np.where(v.level > 1, v.key, -1), np.where(v.at > top, v.under, -1), np.where(v.level > 1, v.up, -1), solid)

    found, open_ = [], rest
    for lettered in (False, True):
        if lettered:
            fits = np.zeros(v.n, bool)
            some = np.flatnonzero(open_ & solid)
            if not len(some):
                break
            fits[some] = np.asarray(pc.match_substring_regex(v.texts(some), r"\p{L}"))
        else:
            fits = v.flags(TEXT_KEYS)
        one, line = whole(fits if lettered else fits[v.under])
        many, place = blocks(fits if lettered else fits[np.where(v.at > top, v.under, -1)])
        pages = np.zeros(v.n, bool)
        pages[top[many]] = True
        paged = v.count(pages) >= 2
        for at, to, of, keep in ((one, line, np.full(len(one), -1), ~paged), (many, place, top[many], paged)):
            use = keep[v.content[at]] & open_[at]
            found.append((at[use], to[use], of[use]))
        open_ = open_ & (v.count(np.r_[found[-2][0], found[-1][0]]) == 0)[v.content]
    at, to, of = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((at, to, of, v.content[at]))
    at, to, of = at[order], to[order], of[order]
    texts = v.texts(at)
    joined = at != to
    starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(at) else at
    flat = joined[starts]
    if flat.any():
        # the words of a line object, put together; white space within a word counts as one space
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(at)], pa.int32()), texts)
        lines = pc.binary_join(lists, " ")
        odd = pc.and_(pa.array(flat), pc.match_substring_regex(lines, f"[{WHITES.replace(' ', '')}]|  "))
        texts = pc.replace_with_mask(lines, odd, pa.array([" ".join(x.split()) for x in lines.filter(odd).to_pylist()], pa.string())) if pc.any(odd).as_py() else lines
        at, of = at[starts], of[starts]
        texts = pc.if_else(pa.array(flat), texts, _feeds(texts))
    else:
        texts = _feeds(texts)
    nth = np.cumsum(v.level == 1)
    before = np.r_[0, np.cumsum(kids)]
    label = ["1" if p < 0 else v.names[v.key[p]] if v.named[p] else str(nth[p] - before[c]) for p, c in zip(of.tolist(), v.content[at].tolist())]
    bare = np.flatnonzero(sound & plain & v.string)
    if len(bare):
        texts = pa.concat_arrays([texts, _feeds(v.texts(bare, strip=False))])
        at, of, label = np.r_[at, bare], np.r_[of, np.full(len(bare), -1)], [*label, *["1"] * len(bare)]
    lines = pc.split_pattern(texts, "\n")
    row = np.repeat(np.arange(len(at)), np.diff(np.asarray(lines.offsets)))
    new = np.r_[True, (of[row][1:] != of[row][:-1]) | (v.content[at[row]][1:] != v.content[at[row]][:-1])] if len(row) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    number = np.arange(len(row)) - heads[np.cumsum(new) - 1] + 1 if len(row) else row
    return v.content[at[row]], [label[k] for k in row.tolist()], number, lines.flatten()


def json_text_lines(files: DataFrame, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """(id_col, page, line, text) of JSON contents at the granularity of lines, in document order.

    Only strings under text keys count, or all strings with a letter where a content has none under a key. Objects that
    hold lines leave out their words and their own coarse text; text of an object leaves out its words; a line object
    without text is one line of its words; of lists typed line and word the words go; blobs go. The children of a list of
    two or more, or the objects and lists in an object, are pages if two or more of them have a line, named by their
    number or key; else all is page 1, as are lists of strings only and a single string. Null and corrupt contents have
    no lines. A page's lines count from 1.
    """
    content = F.col(text_col)
    # one value or several, told apart by the tokens
    good = files.where(F.col(id_col).isNotNull() & F.try_parse_json(F.concat(F.lit("["), content, F.lit("]"))).isNotNull())
    cut = good.select(F.col(id_col).alias("id"), F.regexp_extract_all(content, F.lit(TOKEN), F.lit(0)).alias("cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, (tokens,) in token_slices(batches, "cut"):
            row, page, line, text = _text_lines(tokens)
            yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(row)), pa.array(page, pa.string()), pa.array(line, pa.int32()), text], names=["id", "page", "line", "text"])

    lines = cut.mapInArrow(run, f"id {dict(files.dtypes)[id_col]}, page string, line int, text string")
    return lines.select(F.col("id").alias(id_col), "page", "line", "text")


def json_records(files: DataFrame, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """(id_col, line, status, content): the non-blank lines of JSON Lines contents, ok or corrupt, each a content of its
    own for the readers above under the key (id_col, line)."""
    lines = files.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(newlines(F.col(text_col)), "\n")).alias("l", "content"))
    return lines.where(stripped(F.col("content")) != "").select(id_col, (F.col("l") + 1).alias("line"), json_status(F.col("content")).alias("status"), "content")
