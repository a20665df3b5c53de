"""JSON records against rules that are data: a schema becomes one expression over the records' values."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.sources.json_trees import TOKEN, Nodes
from inkspan.sources.nesting import token_slices

#: Keywords of a schema that check nothing.
NOTES = {"$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples", "$comment"}
CHECKS = {"type", "required", "properties", "items", "additionalProperties", "enum", "const", "minimum", "maximum", "minLength", "maxLength", "pattern", "minItems", "maxItems"}


def step_of(key: str) -> str:
    return "." + key.replace("\\", "\\\\").replace(".", "\\.").replace("[", "\\[")


def rules(schema: dict, at: str = "$", root: dict | None = None, seen: tuple = ()) -> Iterator[tuple[str, str, object]]:
    """(place, keyword, argument) of a schema, references within it followed; a place has [*] for any item of a list.
    Keywords that are not known, and references that lead back to themselves, are refused rather than passed over."""
    root = schema if root is None else root
    if "$ref" in schema:
        ref = schema["$ref"]
        if ref in seen or not ref.startswith("#/"):
            raise ValueError(f"reference {ref} is recursive or not in the schema")
        target = root
        for part in ref[2:].split("/"):
            target = target[part.replace("~1", "/").replace("~0", "~")]
        yield from rules(target, at, root, (*seen, ref))
    for keyword, value in schema.items():
        if keyword in NOTES or keyword == "$ref":
            continue
        if keyword not in CHECKS or keyword == "additionalProperties" and value not in (True, False):
            raise ValueError(f"{keyword} at {at} is not supported")
        if keyword == "properties":
            for name, inner in value.items():
                yield from rules(inner, at + step_of(name), root, seen)
        elif keyword == "items":
            yield from rules(value, at + "[*]", root, seen)
        elif keyword == "additionalProperties":
            if value is False:
                yield at, keyword, sorted(schema.get("properties", {}))
        elif keyword == "required":
            yield from ((at, keyword, name) for name in value)
        else:
            yield at, keyword, value


def _steps(place: str) -> list[str | None]:
    """The keys of a place from the top, None for any item of a list."""
    return [None if x == "[*]" else re.sub(r"\\(.)", r"\1", x[1:], flags=re.S) for x in re.findall(r"\[\*\]|\.(?:\\.|[^.\\\[])*", place[1:], re.S)]


def _placed(v: Nodes, places: Sequence[str]) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """The values at the places, in document order, their paths (items by number) and the places' numbers. Values are
    followed down from the top, level by level, as far as the places lead."""
    tree: dict[tuple, int] = {(): 0}
    for place in places:
        way = _steps(place)
        for k in range(len(way)):
            tree.setdefault(tuple(way[:k + 1]), len(tree))
    number = {tree[tuple(_steps(place))]: k for k, place in enumerate(places)}
    key_at = {None: 0} | {name: k + 1 for k, name in enumerate(v.names)}
    next_ = np.full((len(tree) + 1, len(v.names) + 1), -1)
    for way, k in tree.items():
        if way and way[-1] in key_at:
            next_[tree[way[:-1]], key_at[way[-1]]] = k
    steps = pa.array(["", *(step_of(x) for x in v.names)], pa.string())
    # an item's number is how many values its list has before it
    order = np.argsort(v.up, kind="stable")
    first = np.searchsorted(v.up[order], v.up[order])
    nth = np.empty(v.n, np.int64)
    nth[order] = np.arange(v.n) - first
    found, paths, states = [], [], []
    here = np.flatnonzero(v.sound[v.content] & (v.level == 0))
    state, path = np.zeros(len(here), np.int64), pa.array(["$"] * len(here), pa.string())
    at = np.full(v.n, -1)
    while len(here):
        found.append(here)
        paths.append(path)
        states.append(state)
        at[here] = np.arange(len(here))
        row = np.where(v.up >= 0, at[v.up], -1)
        below = np.flatnonzero(row >= 0)
        to = next_[state[row[below]], np.where(v.named[below], v.key[below] + 1, 0)]
        item = ~v.named[below[to >= 0]]
        at[here] = -1
        below, row, state = below[to >= 0], row[below[to >= 0]], to[to >= 0]
        step = steps.take(pa.array(np.where(item, 0, v.key[below] + 1)))
        if item.any():
            step = pc.if_else(pa.array(item), pc.binary_join_element_wise("[", pa.array(nth[below]).cast(pa.string()), "]", ""), step)
        here, path = below, pc.binary_join_element_wise(path.take(pa.array(row)), step, "")
    if not found:
        return v.i[:0], pa.array([], pa.string()), v.i[:0]
    every, state = np.concatenate(found), np.concatenate(states)
    ruled = np.array([number.get(k, -1) for k in range(len(tree))])[state]
    keep = np.flatnonzero(ruled >= 0)
    keep = keep[np.argsort(every[keep], kind="stable")]
    return every[keep], pa.concat_arrays(paths).take(pa.array(keep)), ruled[keep]


def _values(files: DataFrame, places: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """The values of the records at the places, with the place's number, the path (items by number), type, text, token,
    number, keys and number of parts; and a row of type `missing` or `corrupt`, at no place, per record that is not read.
    A record's tokens are in one row, so nothing moves between tasks."""
    content = F.col(text_col)
    sound = F.try_parse_json(F.concat(F.lit("["), content, F.lit("]"))).isNotNull()
    cut = files.select(F.col(id_col).alias("id"), content.isNull().alias("missing"), sound.alias("sound"), F.when(sound, F.regexp_extract_all(content, F.lit(TOKEN), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, (tokens,) in token_slices(batches, "cut"):
            v = Nodes(tokens)
            ids, missing = rows.column("id"), np.asarray(rows.column("missing"))
            good = np.asarray(rows.column("sound"))
            good[:len(v.sound)] &= v.sound
            good[len(v.sound):] = False
            # several values in a row are sound as items of a list only
            v.sound = good[:len(v.sound)] & np.asarray(ids.is_valid())[:len(v.sound)]
            which, path, place = _placed(v, places)
            other = ~(v.object | v.array | v.string)[which]
            raw = v.t.texts(v.tok[which[other]])
            is_number = ~np.asarray(pc.is_in(raw, pa.array(["null", "true", "false"])))
            # all digits at once; what is too large for that is taken alone
            digits = raw.filter(pa.array(is_number))
            try:
                some = np.asarray(digits.cast(pa.float64()))
            except pa.ArrowInvalid:
                some = np.array([float(x) for x in digits.to_pylist()])
            number = np.full(len(which), np.nan)
            number[np.flatnonzero(other)[is_number]] = some
            kind = np.where(v.object[which], "object", np.where(v.array[which], "array", np.where(v.string[which], "string", "number"))).astype(object)
            whole = np.flatnonzero((number == np.floor(number)) & (np.abs(number) <= 2.0**63))
            kind[whole] = "integer"
            kind[np.flatnonzero(other)[~is_number]] = ["null" if x == "null" else "boolean" for x in raw.filter(pa.array(~is_number)).to_pylist()]
            token = np.full(len(which), -1)
            token[other] = np.arange(len(raw))
            text = np.full(len(which), -1)
            strings = np.flatnonzero(v.string[which])
            text[strings] = np.arange(len(strings))
            # the keys and parts of the objects and lists among them
            row = np.full(v.n, -1)
            row[which] = np.arange(len(which))
            inner = np.flatnonzero((v.up >= 0) & (row[v.up] >= 0))
            parts = np.bincount(row[v.up[inner]], minlength=len(which))
            keyed = inner[v.named[inner]]
            keyed = keyed[np.argsort(row[v.up[keyed]], kind="stable")]
            ends = np.r_[0, np.cumsum(np.bincount(row[v.up[keyed]], minlength=len(which)))]
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v.names, pa.string()).take(pa.array(v.key[keyed])))
            where = lambda x, at: x.take(pa.array(at, mask=at < 0))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(v.content[which])), pa.array(place, pa.int32()), path, pa.array(kind, pa.string()), where(v.texts(which[strings], strip=False), text), where(raw, token), pa.array(number, from_pandas=True), keys, pa.array(parts, pa.int32())], names=names)
            unread = np.flatnonzero(~good)
            if len(unread):
                n = len(unread)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(unread)), pa.array([-1] * n, pa.int32()), pa.array(["$"] * n, pa.string()), pa.array(["missing" if missing[k] else "corrupt" for k in unread.tolist()], pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), pa.array([[]] * n, pa.list_(pa.string())), pa.array([0] * n, pa.int32())], names=names)

    names = ["id", "place", "path", "type", "value", "raw", "number", "keys", "parts"]
    return cut.mapInArrow(run, f"id {dict(files.dtypes)[id_col]}, place int, path string, type string, value string, raw string, number double, keys array<string>, parts int")


def _broken(keyword: str, argument) -> Column:
    """Whether a value at the rule's place breaks it; a keyword looks at the types it is meant for only."""
    kind, number = F.col("type"), F.col("type").isin("integer", "number")
    if keyword == "type":
        names = [argument] if isinstance(argument, str) else list(argument)
        return ~kind.isin(*names, *(["integer"] if "number" in names else []))
    if keyword in ("enum", "const"):
        some = argument if keyword == "enum" else [argument]
        if any(isinstance(v, (list, dict)) for v in some):
            raise ValueError("enum and const take strings, numbers, truth values and null")
        same = [F.col("value") == v if isinstance(v, str) else F.col("raw") == json.dumps(v) if v is None or isinstance(v, bool) else F.col("number") == float(v) for v in some]
        hit = F.lit(False)
        for s in same:
            hit = hit | F.coalesce(s, F.lit(False))
        return ~hit
    if keyword == "required":
        return (kind == "object") & ~F.array_contains("keys", argument)
    if keyword == "additionalProperties":
        return (kind == "object") & (F.size(F.array_except("keys", F.array(*map(F.lit, argument)).cast("array<string>"))) > 0)
    if keyword == "pattern":
        return (kind == "string") & ~F.col("value").rlike(argument)
    measure = {"Length": F.length("value"), "Items": F.col("parts"), "imum": F.col("number")}[keyword[3:]]
    meant = {"Length": kind == "string", "Items": kind == "array", "imum": number}[keyword[3:]]
    return meant & (measure < argument if keyword.startswith("min") else measure > argument)


def violations(files: DataFrame, schema: dict, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """(id_col, at, keyword, rule): a row per value of a record that breaks a rule of the schema, at its path.

    rule is the argument as JSON. A content that is corrupt breaks `json` at $; a null one breaks `null`. Records that
    break nothing have no row. Ids must be unique. The schema takes type, required, properties, items,
    additionalProperties false, enum and const of plain values, bounds of numbers, lengths and lists, patterns and
    references into itself; whatever else it says is refused when the rules are read.
    """
    found = [(place, k, a) for place, k, a in rules(schema)]
    places = list(dict.fromkeys(place for place, _, _ in found))
    broken = [(F.lit(k), F.lit(json.dumps(a)), F.coalesce((F.col("place") == places.index(place)) & _broken(k, a), F.lit(False))) for place, k, a in found]
    # a record that is not read breaks what no rule says
    broken += [(F.lit(k), F.lit("true"), F.col("type") == kind) for k, kind in (("null", "missing"), ("json", "corrupt"))]
    some = broken[0][2]
    for _, _, fails in broken[1:]:
        some = some | fails
    # few values break a rule: only those are looked at rule by rule
    breaks = F.filter(F.array(*(F.when(fails, F.struct(k.alias("keyword"), rule.alias("rule"))) for k, rule, fails in broken)), lambda x: x.isNotNull())
    out = _values(files, places, id_col, text_col).where(some)
    return out.select("id", "path", F.explode(breaks).alias("x")).select(F.col("id").alias(id_col), F.col("path").alias("at"), "x.*")


def line_numbers_from_one(lines: DataFrame, keys, line: str = "line") -> DataFrame:
    """lines with the numbers of each page (keys) moved up by one where its least is 0; null numbers stay."""
    least = F.min(line).over(Window.partitionBy(*keys))
    return lines.withColumn(line, F.when(least == 0, F.col(line) + 1).otherwise(F.col(line)))
