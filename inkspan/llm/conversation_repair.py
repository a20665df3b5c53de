"""Least-cost repair of conversations whose roles must read (s?(ua)+)?, by cost layers of bitsets.

Rows are put in order by one range-partitioned sort, which splits a long conversation over tasks, and cut into chunks of
at most CHUNK rows. For a chunk, layer c has per place a bitset of the grammar states from which its end can be reached
at cost c or less; a layer follows from those below it by a few bit operations per row, and the first layer that holds
the entry state gives the cost. Four ends are followed at once, one nibble each, so a chunk yields a 4 x 4 table of
costs. Tables of a conversation are added up from its last chunk to its first, which gives each chunk the cost that is
left at its end; then every chunk traces its bits for each state it may be entered in, always taking the least edit that
still reaches the end at least cost. As an edit and a state fix the next state, that is the least audit.

One row's audit is one value, and SHA-256 reads a conversation's repaired rows in order, so these two meet in one task
per conversation: the audit as a letter per row, the rows as a sorted stream of which one batch is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .common import cut, release, table

#: Rows of a conversation that one chunk has at most: 2 ** CHUNK_BITS.
CHUNK_BITS = 7
#: Costs of edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = ("user", "assistant")
#: Classes of rows by the initial of their role, and their faults.
USER, ASSISTANT, SYSTEM, OTHER = range(4)
NO_FAULT, BLANK, DUPLICATE, CUT_OFF = range(4)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: States: nothing yet (accepts), after the system row, after a user row, after an assistant row (accepts).
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {(START, USER): AFTER_U, (AFTER_S, USER): AFTER_U, (AFTER_A, USER): AFTER_U, (AFTER_U, ASSISTANT): AFTER_A, (START, SYSTEM): AFTER_S}
#: Cost of inserting what is missing at the end of a conversation, by state.
AT_END = (0, 2 * INSERT, INSERT, 0)
NONE = -1


def turn_of(state: int) -> int:
    """The class, user or assistant, that may follow a state; there is just one."""
    return ASSISTANT if state == AFTER_U else USER


def before_class(bits: int, cls: int) -> int:
    """The states from which a row of a class leads into one of bits, in each nibble."""
    if cls == USER:
        return (bits >> AFTER_U & 0x1111) * 0b1011
    if cls == ASSISTANT:
        return (bits >> AFTER_A & 0x1111) << AFTER_U
    return bits >> AFTER_S & 0x1111 if cls == SYSTEM else 0


def before_any(bits: int) -> int:
    return (bits >> AFTER_U & 0x1111) * 0b1011 | (bits >> AFTER_A & 0x1111) << AFTER_U


def layers(codes: list[tuple[int, int]], end: Callable[[int], int], low: int) -> Iterator[list[int]]:
    """Layer by layer from cost low on: per place 0..n the states from which the end can be reached. codes has the class
    of each row and what keeping it costs; end(c) is the bitset at the last place."""
    n, nothing = len(codes), [0] * (len(codes) + 1)
    done: list[list[int]] = []
    below = lambda c: done[c - low] if c >= low else nothing
    c = low
    while True:
        now = [0] * n + [end(c)]
        one, two, five, six = below(c - REROLE), below(c - DELETE), below(c - INSERT), below(c - TRUNCATED - REROLE)
        for i in range(n - 1, -1, -1):
            cls, late = codes[i]
            kept, roled = (five, six) if late else (now, one)
            now[i] = one[i] | two[i + 1] | before_class(kept[i + 1], cls) | before_any(roled[i + 1]) | before_any(five[i])
        done.append(now)
        yield now
        c += 1


def costs(codes: list[tuple[int, int]]) -> list[int]:
    """Least costs from each of the four entry states to each of the four exits, row by row; NONE where there is no way.
    Missing rows are inserted before rows of the chunk, not behind its last one."""
    out = [NONE] * 16
    if not codes:
        return [0 if k % 5 == 0 else NONE for k in range(16)]
    for c, layer in zip(range(2 * len(codes) + 2 * INSERT + 1), layers(codes, lambda c: 0x8421, 0)):
        for k in range(16):
            if out[k] == NONE and layer[0] >> ((k & 3) * 4 + (k >> 2)) & 1:
                out[k] = c
    return out


def left(table_: list[int], after: list[int]) -> list[int]:
    """Costs left at a chunk's entry, from its table and the costs left at its end."""
    return [min((table_[4 * q + e] + after[e] for e in range(4) if table_[4 * q + e] != NONE and after[e] != NONE), default=NONE) for q in range(4)]


def traces(facts: list[tuple[int, int]], table_: list[int], after: list[int], entries: list[int], last: bool) -> dict[int, tuple[int, str, list]]:
    """Per entry state (exit state, audit, edits) of a chunk with (class, fault) per row and its table of costs. An edit is (row, class to
    become or NONE to stay, classes of the rows inserted before it); row is the number of rows for those at the end."""
    free = [i for i, (_, fault) in enumerate(facts) if fault not in (BLANK, DUPLICATE)]
    codes = [(facts[i][0], TRUNCATED if facts[i][1] == CUT_OFF else 0) for i in free]
    low = min(a for a in after if a != NONE)
    need = {q: c for q, c in enumerate(left(table_, after)) if q in entries and c != NONE}
    end = lambda c: sum(1 << q for q in range(4) if after[q] != NONE and after[q] <= c)
    known = [layer for _, layer in zip(range(low, max(need.values(), default=low) + 1), layers(codes, end, low))]
    has = lambda c, i, q: q is not None and c >= low and known[c - low][i] >> q & 1
    out = {}
    for entry, c in need.items():
        q, i, at, audit, edits, new = entry, 0, 0, [], [], []
        while i < len(free):
            audit.append("D" * (free[i] - at))
            at = free[i]
            cls, late = codes[i]
            any_, kept = NEXT[q, turn_of(q)], NEXT.get((q, cls))
            if has(c - DELETE, i + 1, q):
                step, c, i = "D", c - DELETE, i + 1
            elif has(c - INSERT, i, any_):
                new.append(turn_of(q))
                step, c, q = "I", c - INSERT, any_
            else:
                step = "K" if has(c - late, i + 1, kept) else "R"
                edits.append((free[i], NONE if step == "K" else turn_of(q), new))
                c, q, i, new = (c - late, kept, i + 1, []) if step == "K" else (c - late - REROLE, any_, i + 1, [])
            at += step != "I"
            audit.append(step)
        audit.append("D" * (len(facts) - at))
        if last and AT_END[q]:
            new = [USER, ASSISTANT][-(AT_END[q] // INSERT):]
            audit.append("I" * len(new))
            edits.append((len(facts), NONE, new))
        out[entry] = (q, "".join(audit), edits)
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) after the damage that their key's checksum tells, with `again` for those repeated."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    h = rows.select("conv", "turn", spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(F.concat(spaced("conv"), F.lit(":"), spaced("turn")).cast("binary")) % 20).alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return h.select("conv", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("h") == 3).alias("again"))


def faulty(rows: DataFrame) -> DataFrame:
    """Narrow rows (conv, turn, role, digest, class, blank, cut_off, again) of (conv, turn, role, text, again)."""
    solid = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    first = F.left("role", F.lit(1))
    cls = F.when(first == "u", USER).when(first == "a", ASSISTANT).when(first == "s", SYSTEM).otherwise(OTHER)
    return rows.select("conv", "turn", "role", F.unhex(F.md5("text")).alias("digest"), cls.alias("class"), (solid == "").alias("blank"), (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("cut_off"), "again")


def _struct(**fields: pa.DataType) -> pa.DataType:
    return pa.struct(list(fields.items()))


_I, _L, _S, _Y = pa.int32(), pa.int64(), pa.string(), pa.bool_()
_FACTS = pa.list_(_struct(**{"at": _L, "turn": _L, "role": _S, "digest": pa.binary(), "class": _I, "fault": _I}))
_SUMMARY = _struct(table=pa.list_(_I), faults=pa.list_(_L), illegal=_L, ends=pa.list_(_I), turns=pa.list_(_L))
_PLACES = pa.list_(_struct(key=_L, after=pa.list_(_L), first=_Y, last=_Y))
_TOTALS = _struct(gaps=_L, blank=_L, duplicate=_L, truncated=_L, illegal=_L, cost=_L)
_EDITS = pa.list_(_struct(end=_I, turn=_L, role=_S, digest=pa.binary(), said=_S, new=pa.list_(_S)))
_PATHS = pa.list_(_struct(entry=_I, state=_I, audit=_S, edits=_EDITS))
_ENTRIES = pa.list_(_struct(key=_L, entry=_I))


def _ddl(kind: pa.DataType) -> str:
    return from_arrow_type(kind).simpleString()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their table of costs, which leaves out what must be deleted, and what is counted in them."""
    for batch in batches:
        out = []
        for rows in batch.column(2).to_pylist():
            turns = [r["turn"] for r in rows if r["turn"] is not None]
            faults, classes = [r["fault"] for r in rows], [r["class"] for r in rows]
            table_ = costs([(r["class"], TRUNCATED if r["fault"] == CUT_OFF else 0) for r in rows if r["fault"] not in (BLANK, DUPLICATE)])
            out.append({"table": table_, "faults": [faults.count(f) for f in (BLANK, DUPLICATE, CUT_OFF)], "illegal": sum(p not in LEGAL for p in zip(classes, classes[1:])),
                        "ends": [classes[0], classes[-1]], "turns": [turns[0], turns[-1], len(set(turns))] if turns else None})
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _SUMMARY)], names=["conv", "key", "rows", "sum"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, chunks, totals) of (conv, array of (key, sum)): per chunk the costs left at its end and whether it is the
    first or last; totals are gaps, blank, duplicate, truncated, illegal and cost."""
    for batch in batches:
        chunks, totals = [], []
        for of in batch.column(1).to_pylist():
            sums, after, places = [x["sum"] for x in of], list(AT_END), []
            for k in range(len(of) - 1, -1, -1):
                places.append({"key": of[k]["key"], "after": after, "first": k == 0, "last": k == len(of) - 1})
                after = left(sums[k]["table"], after)
            blank, twice, late = (sum(s["faults"][f] for s in sums) for f in range(3))
            illegal = sum(s["illegal"] for s in sums) + sum((a["ends"][1], b["ends"][0]) not in LEGAL for a, b in zip(sums, sums[1:]))
            turns = [s["turns"] for s in sums if s["turns"]]
            distinct = sum(t[2] for t in turns) - sum(a[1] == b[0] for a, b in zip(turns, turns[1:]))
            chunks.append(places)
            totals.append({"gaps": turns[-1][1] - turns[0][0] + 1 - distinct if turns else 0, "blank": blank, "duplicate": twice, "truncated": late, "illegal": illegal, "cost": after[START] + DELETE * (blank + twice)})
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chunks, _PLACES), pa.array(totals, _TOTALS)], names=["conv", "chunks", "totals"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, key, first, paths) of chunks with the costs left; paths has an item per entry state that is possible."""
    for batch in batches:
        out = []
        for rows, s, place in zip(*(batch.column(c).to_pylist() for c in ("rows", "sum", "place"))):
            facts = [(r["class"], r["fault"]) for r in rows]
            paths = []
            for entry, (state, audit, edits) in traces(facts, s["table"], place["after"], [START] if place["first"] else [0, 1, 2, 3], place["last"]).items():
                said = []
                for i, becomes, new in edits:
                    r = rows[i] if i < len(rows) else {"turn": None, "role": "", "digest": b""}
                    said.append({"end": int(i == len(rows)), "turn": r["turn"], "role": r["role"], "digest": r["digest"], "said": None if i == len(rows) else r["role"] if becomes == NONE else ROLES[becomes], "new": [ROLES[x] for x in new]})
                paths.append({"entry": entry, "state": state, "audit": audit, "edits": said})
            out.append(paths)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("key"), pa.array(out, _PATHS)], names=["conv", "key", "paths"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, audit, entries) of (conv, array of (key, paths without edits)): the state each chunk is entered in."""
    for batch in batches:
        audits, entries = [], []
        for of in batch.column(1).to_pylist():
            q, audit, keys = START, [], []
            for x in of:
                path = next(p for p in x["paths"] if p["entry"] == q)
                keys.append({"key": x["key"], "entry": q})
                audit.append(path["audit"])
                q = path["state"]
            audits.append("".join(audit))
            entries.append(keys)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(audits, pa.string()), pa.array(entries, _ENTRIES)], names=["conv", "audit", "entries"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, sha) of rows sorted by conversation and place, an edit before the row that it keeps. State is one hash."""
    conv, sha, pending, lines, begun = None, None, None, 0, False
    for batch in batches:
        out = []
        for x in zip(*(batch.column(c).to_pylist() for c in ("conv", "end", "turn", "role", "digest", "edit", "said", "new", "text"))):
            if not begun or x[0] != conv:
                if begun:
                    out.append((conv, sha.hexdigest()))
                conv, sha, pending, lines, begun = x[0], hashlib.sha256(), None, 0, True
            if x[5]:
                pending, more = (x[1:5], x[6]) if x[6] is not None else None, [f"{r}:" for r in x[7]]
            elif pending and pending[0] == x[1:5]:
                pending, more = None, [f"{pending[1]}:{x[8]}"]
            else:
                continue
            for line in more:
                sha.update(("\n" * bool(lines) + line).encode("utf-8", "surrogatepass"))
                lines += 1
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], batch.schema.field("conv").type), pa.array([s for _, s in out], pa.string())], names=["conv", "sha"])
        kind = batch.schema.field("conv").type
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([sha.hexdigest()], pa.string())], names=["conv", "sha"])


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation id of rows.

    Rows are taken by turn, null turns first; rows of one turn by role, then by the MD5 of the text, so that equal rows
    stand together. Null roles and texts count as one space, which is blank; a role whose initial is not s, u or a is
    outside the grammar. A null id is a conversation of its own. damage, if given, changes rows (conv, turn, role, text)
    first and adds `again` to those that occur twice; ids that lose all rows have zeros, an empty audit and the hash of
    nothing. An empty table gives an empty result. Only the four named columns are read.
    """
    plain = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    now = damage(plain) if damage else plain.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("again"))
    narrow = faulty(now)
    doubled = narrow.withColumn("copy", F.explode(F.when(F.col("again"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("again", "copy")
    order = ["conv", "turn", "role", "digest"]
    placed = cut(doubled.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    # places are unique, so this join has no hot key, however often a text is repeated
    first = placed.where(~F.col("blank")).groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut_off"), CUT_OFF).otherwise(NO_FAULT)
    facts = placed.join(first, "at", "left").select("conv", F.shiftright("at", CHUNK_BITS).alias("chunk"), F.struct("at", "turn", "role", "digest", "class", fault.alias("fault")).alias("x"))
    by_chunk = facts.groupBy("conv", "chunk").agg(F.min("x.at").alias("key"), F.sort_array(F.collect_list("x")).alias("rows")).select("conv", "key", "rows")
    kind = dict(plain.dtypes)["conv"]
    chunks = cut(by_chunk.mapInArrow(_summaries, f"conv {kind}, key long, rows {_ddl(_FACTS)}, sum {_ddl(_SUMMARY)}"))
    whole = cut(chunks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("key", "sum"))).alias("chunks")).mapInArrow(_whole, f"conv {kind}, chunks {_ddl(_PLACES)}, totals {_ddl(_TOTALS)}"))
    places = whole.select(F.explode("chunks").alias("place")).select(F.col("place.key").alias("key"), "place")
    paths = cut(chunks.join(places, "key").select("conv", "key", "rows", "sum", "place").mapInArrow(_traced, f"conv {kind}, key long, paths {_ddl(_PATHS)}"))
    bare = F.transform("paths", lambda p: F.struct(p["entry"].alias("entry"), p["state"].alias("state"), p["audit"].alias("audit")))
    chain = cut(paths.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("key", bare.alias("paths")))).alias("chunks")).mapInArrow(_chained, f"conv {kind}, audit string, entries {_ddl(_ENTRIES)}"))
    entered = chain.select(F.explode("entries").alias("e")).select("e.*")
    taken = paths.join(entered, "key").select("conv", F.explode(F.filter("paths", lambda p: p["entry"] == F.col("entry"))[0]["edits"]).alias("x")).select("conv", "x.*")
    edits = taken.select("conv", "end", "turn", "role", "digest", F.lit(True).alias("edit"), "said", "new", F.lit(None).cast("string").alias("text"))
    texts = now.where(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")) != "").select("conv", F.lit(0).alias("end"), "turn", "role", F.unhex(F.md5("text")).alias("digest"), F.lit(False).alias("edit"), F.lit(None).cast("string").alias("said"), F.lit(None).cast("array<string>").alias("new"), "text")
    stream = edits.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "end", "turn", "role", "digest", F.desc("edit"))
    hashes = stream.mapInArrow(_hashed, f"conv {kind}, sha string")

    empty = {"totals": F.lit(None).cast(_ddl(_TOTALS)), "audit": F.lit(None).cast("string"), "sha": F.lit(None).cast("string")}
    parts = [plain.select("conv").distinct().withColumns(empty), *(df.select("conv", *(F.col(c) if c == has else e.alias(c) for c, e in empty.items())) for df, has in ((whole, "totals"), (chain, "audit"), (hashes, "sha")))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("conv").agg(*(F.max(c).alias(c) for c in empty))
    release(placed, chunks)
    counts = [F.coalesce(f"totals.{c}", F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(F.col("conv").alias(conv_col), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"), damage=damaged)


def _oracle() -> str:
    """The same in SQL: a table of (cost, audit) per place and state, the least of which lead on to the next place."""
    blank = r"'^[\x20\x09-\x0D]*$'"
    return rf"""with recursive bytes as (select list(list_reduce(list_prepend(i, range(8)), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end) order by i) as tab from range(256) r(i)),
r0 as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
r1 as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda ch: ascii(ch)::bigint)), lambda crc, b: xor(crc >> 8, tab[(xor(crc, b) & 255) + 1])), 4294967295) % 20 as h from r0, bytes),
r2 as (select conv_id, turn, case when h = 4 then 'user' else role end as role, case h when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when h = 3 then 2 else 1 end)) as copy from r1 where h <> 0),
ids as (select conv_id, row_number() over (order by conv_id) as c from (select distinct conv_id from conversations)),
r3 as (select c, turn, role, text, left(role, 1) as x, row_number() over (partition by c order by turn nulls first, role, md5(text)) as i, regexp_matches(text, {blank}) as blank from r2 join ids on r2.conv_id is not distinct from ids.conv_id),
r4 as materialized (select *, not blank and row_number() over (partition by c, role, text, blank order by i) > 1 as dup, lag(x) over (partition by c order by i) as was from r3),
r5 as materialized (select *, not blank and not dup and not regexp_matches(text, '[.!?][ 	-
]*$') as trunc from r4),
sizes as (select c, count(*) as n, count(*) filter (blank) as blank, count(*) filter (dup) as dup, count(*) filter (trunc) as trunc, count(*) filter (i > 1 and (was || x) not in ('su', 'ua', 'au')) as illegal, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps from r5 group by c),
ins(q, q1, k, lines) as (values (0, 0, 0, []::varchar[]), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []), (0, 2, 1, ['user:']), (1, 2, 1, ['user:']), (2, 3, 1, ['assistant:']), (3, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 3, 2, ['user:', 'assistant:'])),
edit(q1, q2, e, x) as (values (0, 0, 'D', ''), (1, 1, 'D', ''), (2, 2, 'D', ''), (3, 3, 'D', ''), (0, 2, 'R', 'user'), (1, 2, 'R', 'user'), (2, 3, 'R', 'assistant'), (3, 2, 'R', 'user'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a'), (0, 1, 'K', 's')),
dp as (select c, 0::bigint as i, 0 as q, 0::bigint as cost, '' as audit, []::varchar[] as lines from sizes
  union all select w.c, w.i, w.q, (w.best).cost, (w.best).audit, (w.best).lines from (
    select d.c, r.i, e.q2 as q, min({{'cost': d.cost + 5 * s.k + case e.e when 'D' then 2 when 'R' then 1 else 0 end + case when e.e <> 'D' and r.trunc then 5 else 0 end, 'audit': d.audit || repeat('I', s.k) || e.e, 'lines': d.lines || s.lines || case e.e when 'D' then [] when 'R' then [e.x || ':' || r.text] else [r.role || ':' || r.text] end}}) as best
    from dp d join r5 r on r.c = d.c and r.i = d.i + 1 join ins s on s.q = d.q join edit e on e.q1 = s.q1 where (e.e <> 'K' or e.x = r.x) and (e.e = 'D' or not (r.blank or r.dup)) group by d.c, r.i, e.q2) w),
done as (select d.c, min({{'cost': cost + 5 * k, 'audit': audit || repeat('I', k), 'lines': d.lines || s.lines}}) as best from dp d join sizes z on z.c = d.c and z.n = d.i join ins s on s.q = d.q where s.q1 in (0, 3) group by d.c)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(dup, 0) as duplicate, coalesce(trunc, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce((best).cost, 0)::bigint as cost, coalesce((best).audit, '') as audit, sha256(coalesce(array_to_string((best).lines, chr(10)), '')) as repaired_sha256
from ids left join sizes using (c) left join done using (c)"""


ORACLE = _oracle()
