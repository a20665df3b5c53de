"""Main text of web pages, with boilerplate found by a suffix array per host.

Each page is split into blocks. Blocks of the article are its text. What stands outside the article and outside
elements that are never text (menus, forms, adverts ...) is uncertain: there, the token streams of a host's pages are
concatenated, a suffix array finds long substrings that occur on distinct pages, tokens covered by one go, and the
unique runs stay. A page with an article keeps only that; a page without one keeps its unique runs. Pages with equal
streams are mirrors of one another, not distinct pages, so they lose nothing by it.

A host is dealt to buckets of about BUCKET pages by a hash of its rows, so no host, however hot, meets in one task. What
pages of different buckets share is found by the hashes of their windows of LEAST tokens: those that distinct streams of
the host hold go back to the buckets that hold them. So the result is that of one suffix array per host, however pages
are dealt (windows are told apart by 64-bit hashes). Texts move once, together with their page.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StructType

from .common import cut, table
from .url_filter import host_of

BUCKET = 256
#: Tokens a repeated substring has at least.
LEAST = 6

#: Elements by their role in a page.
SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "select", "textarea", "button", "canvas"}
OUTSIDE = {"nav", "header", "footer", "aside", "form", "dialog", "menu"}
ARTICLE = {"article", "main"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
          "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section",
          "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of class, id and role names that mark what is not text.
_WORDS = ("ads?|advert\\w*|sponsor\\w*|promo\\w*|cookies?|consent|newsletter|subscribe|nav\\w*|menu|breadcrumbs?|sidebar|comments?|comment-list|disqus|related|share|social|popup|modal|"
          "complementary|contentinfo")
MARKS = re.compile(rf"(?:^|[\s_-])(?:{_WORDS}|banner|notice|footer|header|masthead|search)(?:$|[\s_-])", re.I)
#: The same inside an article, whose parts may have a heading or a notice of their own.
INNER_MARKS = re.compile(rf"(?:^|[\s_-])(?:{_WORDS})(?:$|[\s_-])", re.I)
_GAP = re.compile(r"\s+")


class _Blocks(HTMLParser):
    """Collects (text, where) per block; where is 0 in the article, 1 in an element that is never text, 2 elsewhere."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int]] = []
        self.held: list[str] = []
        self.open: list[tuple[str, int, int, int]] = []  # element, open silent, outside and article elements with it
        self.silent = self.outside = self.article = 0

    def flush(self) -> None:
        text = _GAP.sub(" ", "".join(self.held)).strip()
        self.held.clear()
        if text:
            self.out.append((text, 1 if self.outside else 0 if self.article else 2))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        marked = bool(named) and bool((INNER_MARKS if self.article else MARKS).search(named))
        # a header inside an article is the article's own heading
        out = tag in OUTSIDE and not (tag == "header" and self.article) or (tag not in ("html", "body", "article", "main") and marked)
        step = (tag, int(tag in SILENT), int(out), int(tag in ARTICLE))
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self.handle_endtag("p")
        self.open.append(step)
        self.silent += step[1]
        self.outside += step[2]
        self.article += step[3]

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                break
            if self.open[k][0] in ARTICLE | OUTSIDE and tag not in ARTICLE | OUTSIDE | {"body", "html"}:
                return  # a stray end tag does not close the section around it
        else:
            return
        for _, s, o, a in self.open[k:]:
            self.silent, self.outside, self.article = self.silent - s, self.outside - o, self.article - a
        del self.open[k:]

    def handle_data(self, data):
        if not self.silent:
            self.held.append(data)


def blocks(html: str | None) -> list[tuple[str, int]]:
    if not html:
        return []
    p = _Blocks()
    p.feed(html)
    p.close()
    p.flush()
    return p.out


def parsed(html: Column) -> Column:
    """struct(main, rest, sure): the article's text (null if none), the other blocks, and which of them are never text."""

    @pandas_udf("struct<main:string,rest:array<string>,sure:array<boolean>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        main, rest, sure = [], [], []
        for h in texts:
            got = blocks(h)
            inside = [t for t, w in got if w == 0]
            main.append("\n".join(inside) if inside else None)
            rest.append([t for t, w in got if w])
            sure.append([w == 1 for _, w in got if w])
        return pd.DataFrame({"main": main, "rest": rest, "sure": sure})

    return run(html)


def suffix_array(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes of a stream in order, and how many tokens each shares with the one before it.

    Prefix doubling sorts; the ranks kept of each width then give the common lengths from the widest down.
    """
    total = len(stream)
    rank, width = np.unique(stream, return_inverse=True)[1].astype(np.int64), 1
    ranks, order = [rank], np.argsort(rank, kind="stable")
    while width < total and len(np.unique(rank)) < total:
        after = np.full(total, -1, np.int64)
        after[: total - width] = rank[width:]
        order = np.lexsort((after, rank))
        new = np.zeros(total, np.int64)
        new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]]))
        rank, width = new, 2 * width
        ranks.append(rank)
    common = np.zeros(total, np.int64)
    x, y = order[:-1], order[1:]
    for k in range(len(ranks) - 1, -1, -1):
        i, j = x + common[1:], y + common[1:]
        inside = np.maximum(i, j) < total
        same = inside & (ranks[k][np.minimum(i, total - 1)] == ranks[k][np.minimum(j, total - 1)])
        common[1:] += same << k
    return order, common


def repeated(pages: list[list[str]], least: int = LEAST) -> list[np.ndarray]:
    """Per page, which of its tokens lie in a substring of at least `least` tokens that distinct other pages have too.

    Streams are concatenated, each ended by a separator of its own, so no common beginning runs past a page. Neighbours
    in the suffix array that share `least` tokens form groups; a group of suffixes of several pages is a repeat.
    """
    sizes = np.array([len(p) for p in pages])
    total = int(sizes.sum()) + len(pages)
    names: dict[str, int] = {}
    stream, owner = np.empty(total, np.int64), np.repeat(np.arange(len(pages)), sizes + 1)
    starts = np.cumsum(sizes + 1) - sizes - 1
    for k, (p, at) in enumerate(zip(pages, starts.tolist())):
        stream[at : at + len(p)] = [names.setdefault(t, len(names) + len(pages)) for t in p]
        stream[at + len(p)] = k
    covered = np.zeros(total + 1, np.int64)
    if total:
        order, common = suffix_array(stream)
        firsts = np.flatnonzero(common < least)
        low, high = np.minimum.reduceat(owner[order], firsts), np.maximum.reduceat(owner[order], firsts)
        hit = order[np.repeat(low != high, np.diff(np.r_[firsts, total]))]
        np.add.at(covered, hit, 1)
        np.add.at(covered, np.minimum(hit + least, total), -1)
    inside = np.cumsum(covered)[:total] > 0
    return [inside[s : s + n] for s, n in zip(starts, sizes)]


def _hashes(tokens: list[str], least: int = LEAST) -> np.ndarray:
    """Of each window of `least` tokens, by its first token."""
    n = len(tokens) - least + 1
    if n <= 0:
        return np.empty(0, np.int64)
    codes, out = pd.util.hash_array(np.array(tokens, dtype=object)), np.zeros(n, np.uint64)
    for k in range(least):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    return out.view(np.int64)


def _streams(group: pa.Table) -> list[list[str]]:
    return [[t for b in rest for t in b.split(" ")] for rest in group.column("rest").to_pylist()]


def _stream_key(tokens: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(tokens).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _windows(group: pa.Table) -> pa.Table:
    """Each window of a bucket once: (host, bucket, h, x, y) with the least and the greatest stream that have it."""
    streams = _streams(group)
    seen = [np.unique(_hashes(t)) for t in streams]
    stream = np.repeat(np.array([_stream_key(t) for t in streams], np.int64), [len(x) for x in seen])
    h, at = np.unique(np.concatenate(seen), return_inverse=True)
    x, y = np.full(len(h), np.iinfo(np.int64).max), np.full(len(h), np.iinfo(np.int64).min)
    np.minimum.at(x, at, stream)
    np.maximum.at(y, at, stream)
    return pa.table({"host": pa.array([group.column("host")[0].as_py()] * len(h), pa.string()), "bucket": pa.array([group.column("bucket")[0].as_py()] * len(h), pa.int64()), "h": h, "x": x, "y": y})


def _unique_runs(group: pa.Table, elsewhere: pa.Table) -> pa.Table:
    """(own, text, n_repeated_tokens) of a bucket's pages; elsewhere has the windows h that its host repeats."""
    if not group.num_rows:
        return pa.table({"own": group.column("own"), "text": pa.array([], pa.string()), "n_repeated_tokens": pa.array([], pa.int64())})
    streams, more = _streams(group), elsewhere.column("h").to_numpy()
    distinct = {" ".join(s): s for s in streams}
    found = dict(zip(distinct, repeated(list(distinct.values()))))
    texts, counts = [], []
    for main, rest, sure, own in zip(*(group.column(c).to_pylist() for c in ("main", "rest", "sure")), streams):
        gone = found[" ".join(own)].copy()
        if len(more):
            for k in np.flatnonzero(np.isin(_hashes(own), more)):
                gone[k : k + LEAST] = True
        kept, at = [], 0
        for b, certain in zip(rest, sure):
            words = b.split(" ")
            left = [w for w, g in zip(words, gone[at : at + len(words)]) if not g]
            at += len(words)
            if left and not certain:
                kept.append(" ".join(left))
        texts.append("\n".join(kept) if main is None else main)
        counts.append(int(gone.sum()))
    return pa.table({"own": group.column("own"), "text": pa.array(texts, pa.string()), "n_repeated_tokens": pa.array(counts, pa.int64())})


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages' columns but the html, with text, n_chars and n_repeated_tokens (tokens outside the article that the host
    repeats); columns of these names are replaced, others kept whatever they are called.

    Null and empty pages have an empty text; broken markup is read as far as it goes. Pages without a host form one
    group. Repeated rows and mirrors count as one page; an article's text is never removed.
    """
    own = [c for c in pages.columns if c not in (html_col, "text", "n_chars", "n_repeated_tokens")]
    hashed = [F.col(c) for c in pages.columns if not re.search("map<|variant", pages.schema[c].dataType.simpleString())]
    rows = pages.select(F.struct(*own).alias("own"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"), F.xxhash64(*hashed).alias("row"))
    large = cut(rows.groupBy("host").agg(F.count("*").alias("c")).where(F.col("c") > BUCKET))
    rows = rows.join(large, "host", "left").withColumn("bucket", F.pmod("row", F.coalesce(F.ceil(F.col("c") / BUCKET), F.lit(1))))
    dealt = rows.select("own", "host", "c", "bucket", parsed(F.col("html")).alias("p")).select("own", "host", "c", "bucket", "p.*")
    # else the join's partitioning by host would serve, and a hot host would meet in one task
    hot = dealt.where("c is not null").select("host", "bucket", "rest").repartition("host", "bucket")
    named = cut(hot.groupBy("host", "bucket").applyInArrow(_windows, "host string, bucket long, h long, x long, y long"))
    shared = cut(named.groupBy("host", "h").agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x < y").select("host", "h"))
    elsewhere = named.select("host", "bucket", "h").join(shared, ["host", "h"], "left_semi")
    both = dealt.drop("c").repartition("host", "bucket").groupBy("host", "bucket").cogroup(elsewhere.repartition("host", "bucket").groupBy("host", "bucket"))
    out = both.applyInArrow(_unique_runs, StructType().add("own", rows.schema["own"].dataType).add("text", "string").add("n_repeated_tokens", "long"))
    return out.select("own.*", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated_tokens")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars", "n_repeated_tokens")
