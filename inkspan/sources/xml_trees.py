"""XML contents to nodes, and ALTO and PAGE files to lines, by the order of their tags.

As with JSON, one regular expression cuts a content into tags and texts, and running counts give each element the one
around it and its end, so nesting has no limit and document order stays. Contents with a document type are refused (no
entity is ever expanded), as are those whose tags do not pair up. A content's tokens are in one row, so files become lines
in one stream: what belongs together is found by the numbers of boxes and ends, and nothing moves between tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import LINE_ENDS
from inkspan.operators.page_geometry import whole_pages
from inkspan.sources.nesting import Tokens, cut_out, nest, nested, token_slices

_ATTRIBUTE = r"""\s+([^<>"'=\s/]+)\s*=\s*("[^"<]*"|'[^'<]*')"""
TOKEN = r"""<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>|</?[^\s<>/!?]++(?:\s++[^<>"'=\s/]++\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'))*+\s*+/?>|[^<]++"""


def unescaped(text: Column) -> Column:
    """Character references resolved: numbers first, then the five names, the ampersand last."""
    refs = F.array_distinct(F.regexp_extract_all(text, F.lit("&#(?:[0-9]{1,7}|x[0-9A-Fa-f]{1,6});"), F.lit(0)))

    def char(r: Column) -> Column:
        code = F.when(r.startswith("&#x"), F.conv(F.regexp_extract(r, "x([0-9A-Fa-f]+)", 1), 16, 10)).otherwise(F.regexp_extract(r, "([0-9]+)", 1)).cast("long")
        return F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")

    out = F.when(F.contains(text, F.lit("&#")), F.aggregate(refs, text, lambda acc, r: F.replace(acc, r, char(r)))).otherwise(text)
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(c))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def _sound(tokens: DataFrame) -> DataFrame:
    """The tokens of contents with one root whose tags pair up, and no text outside of it. They stand together still, so
    this too is a stream."""
    unpaired = F.when(F.col("closes"), ~F.col("name").eqNullSafe(F.col("box_name"))).otherwise(F.col("opens") & F.col("end").isNull())
    top = (F.col("level") == 0) & ~F.col("closes")
    said = F.when(F.col("tok").startswith("<!["), F.regexp_replace("tok", r"^<!\[CDATA\[|\]\]>$", "")).otherwise(unescaped(F.col("tok")))
    told = tokens.withColumns({"bad": F.col("bad") | unpaired | (top & F.col("name").isNull() & said.rlike(r"\S")), "root": top & F.col("name").isNotNull()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_pages(batches, ["content"]):
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            bad, root = (np.asarray(t.column(c)).astype(np.int64) for c in ("bad", "root"))
            fits = (np.add.reduceat(bad, starts) == 0) & (np.add.reduceat(root, starts) == 1)
            yield from t.filter(pa.array(fits[np.cumsum(np.r_[False, at[1:] != at[:-1]])])).to_batches()

    return told.mapInArrow(run, told.schema)


def xml_nodes(files: DataFrame, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """(id_col, node, end, parent, level, name, attrs, text) per element and text of the contents that are well formed.

    node is the place of an element's first tag, end that of its last; name has no prefix and is null for texts; attrs
    is a map without the declarations of prefixes. Well formed is what the tokens cover wholly, without a document type, with one root whose tags pair up.
    Null contents and ids have no nodes. Ids must be unique.
    """
    cut = F.regexp_extract_all(F.col(text_col), F.lit(TOKEN), F.lit(0))
    whole = files.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.length(text_col).alias("n"), cut.alias("cut"))
    whole = whole.where(F.aggregate("cut", F.lit(0), lambda acc, x: acc + F.length(x)) == F.col("n")).select("id", F.monotonically_increasing_id().alias("content"), "cut")
    t = whole.select("id", "content", F.posexplode("cut").alias("pos", "tok")).where(~F.col("tok").rlike(r"^<(?:!--|\?)"))
    tag = F.col("tok").startswith("<") & ~F.col("tok").startswith("<![")
    t = t.withColumns({"opens": tag & ~F.col("tok").startswith("</") & ~F.col("tok").endswith("/>"), "closes": F.col("tok").startswith("</"), "name": F.when(tag, F.regexp_extract("tok", r"^</?([^\s<>/]+)", 1))})
    r = _sound(nested(t, "content")).withColumnRenamed("name", "qname")
    cdata = F.col("tok").startswith("<![")
    r = r.withColumn("text", F.when(cdata, F.regexp_replace("tok", r"^<!\[CDATA\[|\]\]>$", "")).when(F.col("qname").isNull(), unescaped(F.col("tok"))))
    names, values = (F.regexp_extract_all("tok", F.lit(_ATTRIBUTE), F.lit(g)) for g in (1, 2))
    attrs = F.map_from_arrays(F.array_distinct(names), F.transform(F.slice(values, F.lit(1), F.size(F.array_distinct(names))), lambda v: unescaped(F.substr(v, F.lit(2), F.length(v) - 2))))
    local = F.regexp_replace("qname", "^.*:", "")
    nodes = r.where(~F.col("closes")).select(F.col("id").alias(id_col), F.col("pos").alias("node"), F.coalesce("end", "pos").alias("end"), F.col("box").alias("parent"), "level", local.alias("name"), F.when(F.col("qname").isNotNull(), F.map_filter(attrs, lambda k, _: ~k.startswith("xmlns"))).alias("attrs"), "text")
    return nodes.where("name is not null or text <> ''")


_REFERENCE = re.compile("&#(?:[0-9]{1,7}|x[0-9A-Fa-f]{1,6});")
_SPACES = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_NAME_ENDS = _SPACES | np.isin(np.arange(256), (47, 62))


def _resolved(text: str) -> str:
    """unescaped of a text in a task."""
    if "&#" in text:
        for r in dict.fromkeys(_REFERENCE.findall(text)):
            code = int(r[3:-1], 16) if r[2] == "x" else int(r[2:-1])
            text = text.replace(r, chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "�")
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = text.replace(f"&{name};", c)
    return text


def _all_resolved(texts: pa.StringArray) -> pa.StringArray:
    odd = pc.match_substring(texts, "&").fill_null(False)
    return pc.replace_with_mask(texts, odd, pa.array([_resolved(x) for x in texts.filter(odd).to_pylist()], pa.string())) if pc.any(odd).as_py() else texts


class Elements:
    """Elements and texts of whole contents by number, in document order, as xml_nodes has them: contents, levels, the
    element around each (up), the last number inside it, and whether its content is well formed (sound)."""

    def __init__(self, t: Tokens, size: np.ndarray):
        b0, b1 = t.byte(0), t.byte(1)
        special = (b0 == 60) & (b1 == 33)
        cdata = special & (t.byte(2) == 91)
        kept = np.flatnonzero(~((b0 == 60) & (b1 == 63) | special & ~cdata))
        tag = ((b0 == 60) & ~cdata)[kept]
        closes = tag & (b1[kept] == 47)
        opens = tag & ~closes & (t.byte(-2)[kept] != 47)
        level, end, box, bad = nest(opens, closes, t.content[kept])
        ends = np.flatnonzero(_NAME_ENDS[t.data])
        a = t.at[kept[tag]] + 1 + closes[tag]
        names = cut_out(t.data, a, ends[np.searchsorted(ends, a)]).dictionary_encode() if len(a) else pa.array([], pa.string()).dictionary_encode()
        name = np.full(len(kept), -1)
        name[tag] = np.asarray(names.indices)
        bad = bad | closes & (name != name[box]) | opens & (end < 0) if len(kept) else bad
        for i in np.flatnonzero((level == 0) & ~tag).tolist():
            said = t.data[t.at[kept[i]]:t.at[kept[i] + 1]].tobytes().decode()
            bad[i] |= bool(re.search(r"[^ \t-\r]", said[9:-3] if cdata[kept[i]] else _resolved(said)))
        here, of = np.flatnonzero(~closes), t.content[kept]
        root = np.bincount(of[(level == 0) & tag & ~closes], minlength=len(size)) == 1
        covered = np.bincount(t.content, t.at[1:] - t.at[:-1], minlength=len(size)) == size
        sound = covered & root & (np.bincount(of[bad], minlength=len(size)) == 0)
        number = np.cumsum(~closes) - 1
        self.t, self.tok, self.content, self.level, self.n, self.i = t, kept[here], of[here], level[here], len(here), np.arange(len(here))
        self.up = np.where(box[here] >= 0, number[box[here]], -1)
        self.last = np.where(end[here] >= 0, number[end[here]], self.i)
        self.sound, self.cdata = sound[self.content], cdata[self.tok]
        self.name, self.names = name[here], [x.rsplit(":", 1)[-1] for x in names.dictionary.to_pylist()]
        self.quotes = None

    def named(self, *names: str, test: Callable[[str], bool] | None = None) -> np.ndarray:
        """The elements of well-formed contents with one of the names, or whose name passes the test."""
        fits = np.array([*(test(x) if test else x in names for x in self.names), False], bool)
        return fits[self.name] & self.sound

    def texts(self, which: np.ndarray) -> pa.StringArray:
        """The texts of nodes without a name."""
        out = self.t.texts(self.tok[which])
        raw = self.cdata[which]
        out = _all_resolved(out) if not raw.any() else pa.array([x[9:-3] if c else _resolved(x) for x, c in zip(out.to_pylist(), raw.tolist())], pa.string())
        return out

    def attribute(self, which: np.ndarray, key: str) -> pa.StringArray:
        """An attribute of some elements, null where there is none. Where a tag has no single quotes, its double quotes open
        and close in turn, and a value's name and sign stand before the first; other spellings are left to an expression."""
        t = self.t
        if self.quotes is None:
            self.quotes = np.flatnonzero(t.data == 34)
            # single quotes, and spaces around the sign between name and value
            sign = np.flatnonzero(t.data == 61)
            odd = [np.flatnonzero(t.data == 39), sign[_SPACES[t.data[sign - 1]] | _SPACES[t.data[np.minimum(sign + 1, len(t.data) - 1)]]]]
            self.single = np.zeros(len(t.content), bool)
            self.single[np.searchsorted(t.at, np.concatenate(odd), "right") - 1] = True
        a, b = t.at[self.tok[which]], t.at[self.tok[which] + 1]
        q0, q1 = np.searchsorted(self.quotes, a), np.searchsorted(self.quotes, b)
        n = np.where(self.single[self.tok[which]], 0, (q1 - q0) // 2)
        of = np.repeat(np.arange(len(which)), n)
        q = np.repeat(q0 - 2 * np.r_[0, np.cumsum(n)[:-1]], n) + 2 * np.arange(len(of)) if len(of) else of
        at = self.quotes[q] if len(of) else of
        word = key.encode() + b"="
        fits = at - len(word) - 1 > a[of]
        for k, c in enumerate(word):
            fits &= t.data[at - len(word) + k] == c
        fits &= _SPACES[t.data[at - len(word) - 1]]
        hit = np.flatnonzero(fits)[::-1]
        start, stop = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        # the first counts
        start[of[hit]], stop[of[hit]] = at[hit] + 1, self.quotes[q[hit] + 1] if len(hit) else at[hit]
        out, none, missed = cut_out(t.data, start, stop), start == 0, self.single[self.tok[which]]
        if none.any():
            out = pc.if_else(pa.array(none), pa.scalar(None, pa.string()), out)
        if missed.any():
            s = r"[\t-\r ]"
            value = "\"[^\"<]*\"|'[^'<]*'"
            found = pc.extract_regex(t.texts(self.tok[which[missed]]), rf"""^<[^\t-\r <>/!?]+(?:{s}+[^<>"'=\t-\r /]+{s}*={s}*(?:{value}))*?{s}+{re.escape(key)}{s}*={s}*(?P<v>{value})""").field("v")
            none = np.asarray(found.is_null()) | (np.asarray(pc.binary_length(found).fill_null(0)) == 0)
            out = pc.replace_with_mask(out, pa.array(missed), pc.if_else(pa.array(none), pa.scalar(None, pa.string()), pc.utf8_slice_codeunits(found, 1, -1)))
        return _all_resolved(out)

    def around(self, which: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Per number in inner the last of some elements that begins at or before it, if it ends behind; else -1."""
        last = np.maximum.accumulate(np.where(which, self.i, -1))[inner]
        return np.where((last >= 0) & (self.last[last] >= inner), last, -1)

    def nth(self, which: np.ndarray) -> np.ndarray:
        """Per number how many of some elements its content has up to there."""
        seen = np.cumsum(which)
        first = np.searchsorted(self.content, self.content)
        return seen - np.where(first > 0, seen[first - 1], 0)


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Places from 1 among the rows of equal keys, in the order of the rows."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    starts = np.flatnonzero(np.r_[True, new[1:]]) if len(order) else order
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - starts[np.cumsum(new)] + 1 if len(order) else order
    return out


def _joined(texts: pa.StringArray, of: np.ndarray, by: str, n: int) -> pa.StringArray:
    """The texts of each of n, which stand one after another, with `by` between them."""
    ends = np.r_[0, np.cumsum(np.bincount(of, minlength=n))]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts), by)


def streamed(files: DataFrame, id_col: str, text_col: str, read: Callable[[Elements], pa.RecordBatch], schema: str) -> DataFrame:
    """What `read` makes of the elements of whole contents; its first column is the number of a content, here its id."""
    content = F.col(text_col)
    cut = files.where(F.col(id_col).isNotNull() & content.isNotNull()).select(F.col(id_col).alias("id"), F.octet_length(content).alias("size"), F.regexp_extract_all(content, F.lit(TOKEN), F.lit(0)).alias("cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, (tokens,) in token_slices(batches, "cut"):
            out = read(Elements(tokens, np.asarray(rows.column("size"))))
            yield pa.RecordBatch.from_arrays([rows.column("id").take(out.column(0)), *out.columns[1:]], names=["id", *out.schema.names[1:]])

    return cut.mapInArrow(run, f"id {dict(files.dtypes)[id_col]}, {schema}")


def _alto_lines(e: Elements) -> pa.RecordBatch:
    line, string, page = e.named("TextLine"), e.named("String"), e.named("Page")
    lines, pages = np.flatnonzero(line), np.flatnonzero(page)
    parts = np.flatnonzero((string | e.named("HYP")) & (e.up >= 0) & line[e.up])
    parts = parts[np.argsort(e.up[parts], kind="stable")]
    begins = string[parts]
    words = parts[begins]
    before = np.cumsum(begins) - 1
    # a hyphen belongs to the string before it in its line
    hyphens = before[~begins]
    hyphens = hyphens[(hyphens >= 0) & (e.up[words[hyphens]] == e.up[parts[~begins]])] if len(words) else hyphens[:0]
    texts = e.attribute(words, "CONTENT").fill_null("")
    if len(hyphens):
        n = np.bincount(hyphens, minlength=len(words))
        some = n > 0
        texts = pc.replace_with_mask(texts, pa.array(some), pa.array([x + "-" * k for x, k in zip(texts.filter(pa.array(some)).to_pylist(), n[some].tolist())], pa.string()))
    full = np.asarray(pc.binary_length(texts)) > 0
    said = _joined(texts.filter(pa.array(full)), np.searchsorted(lines, e.up[words[full]]), " ", len(lines))
    nth = e.nth(page)
    of = e.around(page, lines)
    number = np.where(of >= 0, nth[of], 1)
    labels = {p: a or b or str(k) for p, a, b, k in zip(pages.tolist(), e.attribute(pages, "PHYSICAL_IMG_NR").to_pylist(), e.attribute(pages, "ID").to_pylist(), nth[pages].tolist())}
    content = e.content[lines]
    return pa.RecordBatch.from_arrays([pa.array(content), pa.array(number, pa.int32()), pa.array([labels.get(p, "1") for p in of.tolist()], pa.string()), pa.array(_ranks(content, number), pa.int32()), said,
                                       *(e.attribute(lines, k) for k in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))], names=["id", "page", "label", "line", "text", "x", "y", "w", "h"])


def alto_lines(files: DataFrame, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """(id_col, page, label, line, text, x0, y0, x1, y1) of ALTO files: a line per TextLine in document order, its strings
    joined by a space, a hyphen element at the end of the string before it. Pages count from 1, as do their lines; the
    label is the image number, else the id, else the number. Lines outside of any page are on page 1 of the file. Boxes
    are null without numbers. Contents that are not well formed have none."""
    lines = streamed(files, id_col, text_col, _alto_lines, "page int, label string, line int, text string, x string, y string, w string, h string")
    x, y, w, h = (F.col(k).try_cast("double") for k in "xywh")
    return lines.select(F.col("id").alias(id_col), "page", "label", "line", "text", x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))


def _whole(text: str | None) -> int | None:
    """try_cast of a text to int."""
    return n if text is not None and re.fullmatch(r"[+-]?[0-9]+", t := text.strip(" \t\n\x0b\x0c\r")) and -(1 << 31) <= (n := int(t)) < 1 << 31 else None


def _equivalents(e: Elements, index_of: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, pa.StringArray]:
    """Per number the place of its equivalent's text, -1 without a TextEquiv child, and these texts: of the one with the
    lowest index, the first Unicode child's."""
    equiv = np.flatnonzero(e.named("TextEquiv") & (e.up >= 0))
    equiv = equiv[np.lexsort((equiv, index_of(equiv), e.up[equiv]))]
    best = equiv[np.r_[True, e.up[equiv][1:] != e.up[equiv][:-1]]] if len(equiv) else equiv
    unicode_ = np.flatnonzero(e.named("Unicode") & (e.up >= 0))[::-1]
    inside = np.full(e.n, -1)
    inside[e.up[unicode_]] = unicode_
    place = np.full(e.n, -1)
    chosen = inside[best]
    place[chosen[chosen >= 0]] = np.flatnonzero(chosen >= 0)
    bare = np.flatnonzero((e.name < 0) & e.sound & (e.up >= 0))
    bare = bare[place[e.up[bare]] >= 0]
    of = place[e.up[bare]]
    order = np.argsort(of, kind="stable")
    said = _joined(e.texts(bare[order]), of[order], "", len(best))
    out = np.full(e.n, -1)
    out[e.up[best]] = np.arange(len(best))
    return out, said


_REFS = ("RegionRefIndexed", "OrderedGroupIndexed", "UnorderedGroupIndexed", "RegionRef", "OrderedGroup", "UnorderedGroup")
_ENDS = re.compile("[" + LINE_ENDS + "]")


def _named_regions(e: Elements, page_of: Callable[[int], int]) -> dict[tuple[int, str], tuple]:
    """Per page and region that a reading order names the least way to it: the places of the groups around its reference
    and its own."""
    refs = np.flatnonzero(e.named(*_REFS))
    index = np.array([_whole(x) or 0 for x in e.attribute(refs, "index").to_pylist()], np.int64)
    indexed = np.isin(e.name[refs], [k for k, x in enumerate(e.names) if x.endswith("Indexed")])
    beside = _ranks(e.up[refs]) - 1
    head = e.named("ReadingOrder")[e.up[refs]] & (e.up[refs] >= 0)
    steps = np.where(head, refs, np.where(indexed, index, beside))
    out: dict[tuple[int, str], tuple] = {}
    around: list[tuple[int, tuple]] = []
    for i, last, step, top, region in zip(refs.tolist(), e.last[refs].tolist(), steps.tolist(), head.tolist(), e.attribute(refs, "regionRef").to_pylist()):
        while around and around[-1][0] < i:
            around.pop()
        way = (*(around[-1][1] if around else ()), (step, i))
        around.append((last, way))
        page = page_of(i)
        if not top and region and page >= 0 and way < out.get((page, region), (*way, (0, 0))):
            out[page, region] = way
    return out


def _page_lines(e: Elements) -> pa.RecordBatch:
    page = e.named("Page")
    region = e.named(test=lambda x: x.endswith("Region") or x == "TableCell")
    line = e.named("TextLine")
    on = e.around(page, e.i)
    number = e.nth(page)
    named = _named_regions(e, lambda i: int(on[i]))

    place, said = _equivalents(e, lambda which: np.array([_whole(x) or 0 for x in e.attribute(which, "index").to_pylist()], np.int64))
    full = np.r_[np.asarray(pc.binary_length(said)) > 0, False]
    words = np.flatnonzero(e.named("Word") & (e.up >= 0) & full[place])
    words = words[line[e.up[words]]]
    words = words[np.argsort(e.up[words], kind="stable")]
    lines = np.flatnonzero(line)
    of_words = _joined(said.take(pa.array(place[words])), np.searchsorted(lines, e.up[words]), " ", len(lines))
    own = said.take(pa.array(place[lines], mask=~full[place[lines]]))
    texts = dict(zip(lines.tolist(), pc.coalesce(own, of_words).to_pylist()))

    # cells by their own place, or that of the first role inside
    regions = np.flatnonzero(region & (on >= 0))
    roles = np.flatnonzero(e.named("TableCellRole"))
    role = roles[np.minimum(np.searchsorted(roles, regions), len(roles) - 1)] if len(roles) else np.full(len(regions), -1)
    role = np.where((role >= regions) & (role <= e.last[regions]), role, -1)
    has = np.flatnonzero(role >= 0)
    given = [e.attribute(regions, k).to_pylist() for k in ("row", "col")]
    other = [dict(zip(has.tolist(), e.attribute(role[has], k).to_pylist())) for k in ("rowIndex", "columnIndex")]
    cells = {}
    for k, i in enumerate(regions.tolist()):
        both = given[0][k] is not None and given[1][k] is not None
        cells[i] = tuple(_whole(g[k] if both else o.get(k)) for g, o in zip(given, other))
    ids = dict(zip(regions.tolist(), e.attribute(regions, "id").to_pylist()))
    ways = {i: named.get((int(on[i]), r)) if r is not None else None for i, r in ids.items()}
    kept = [i for i in lines.tolist() if int(e.up[i]) in cells]

    # a table's parts go by cell only if each of them is a cell with a place
    up = dict(zip(regions.tolist(), e.up[regions].tolist()))
    by_cell: dict[int, bool] = {}
    for i in ids:
        if ways[i] is None:
            by_cell[up[i]] = by_cell.get(up[i], True) and None not in cells[i]
    for i in kept:
        by_cell[int(e.up[i])] = False
    table = {i for i in ids if e.names[e.name[i]] == "TableRegion"}

    # from the innermost region that the order names, or that is in none, the way down
    orders: dict[int, tuple] = {}
    around: list[tuple[int, int]] = []
    for i, last in zip(regions.tolist(), e.last[regions].tolist()):
        while around and around[-1][0] < i:
            around.pop()
        row, col = cells[i] if up[i] in table and by_cell.get(up[i], False) else (0, 0)
        if ways[i] is not None or up[i] not in cells:
            orders[i] = (ways[i] is None, ways[i] or (), ((row, col, i),))
        else:
            late, way, down = orders[around[-1][1]]
            orders[i] = (late, way, (*down, (row, col, i)))
        around.append((last, i))

    filled = {*e.up[lines].tolist(), *e.up[region].tolist()}
    bare = np.array([i for i in ids if i not in filled and full[place[i]]], np.int64)
    found = [(int(e.content[i]), int(number[on[i]]), (late, way, (*down, (0, 0, i))), [texts[i]]) for i in kept if on[i] >= 0 for late, way, down in (orders[int(e.up[i])],)]
    for i, text in zip(bare.tolist(), said.take(pa.array(place[bare])).to_pylist()):
        late, way, down = orders[i]
        found.append((int(e.content[i]), int(number[on[i]]), (late, way, (*down, (0, 0, i))), _ENDS.sub("\n", text.replace("\r\n", "\n")).split("\n")))
    found.sort(key=lambda x: x[:3])
    rows = [(c, p, t) for c, p, _, some in found for t in some]
    content, pages, said_ = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(content, pa.int64()), pa.array(pages, pa.int32()), pa.array(_ranks(np.array(content, np.int64), np.array(pages, np.int64)), pa.int32()), pa.array(said_, pa.string())], names=["id", "page", "line", "text"])


def page_lines(files: DataFrame, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """(id_col, page, line, text) of PAGE files in their reading order.

    Regions come as the ReadingOrder names them, group by group and by index within a group, then those it does not name,
    in document order. A region's lines and the regions in it that are not named come in document order, but the cells
    of a table by row and column if all have a place. A line's text is its equivalent with the lowest index, else its
    words'; a region without lines and regions gives its own text. Pages and lines count from 1.
    """
    lines = streamed(files, id_col, text_col, _page_lines, "page int, line int, text string")
    return lines.select(F.col("id").alias(id_col), "page", "line", "text")
