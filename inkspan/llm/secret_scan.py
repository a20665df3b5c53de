"""Secrets by rules and by who owns them, in DataFrame functions only.

Three base rules always hold. Candidates are the values they find and all other tokens with a letter and a digit. One
aggregate over the corpus counts, per hash of a candidate, the distinct owners and repositories it occurs with: what many
owners have is an example that was copied around, what one or two have looks like a live credential of theirs. Tokens
outside base spans are added if their hash is owner-specific and they are the value of a base span somewhere (`value`) or
look like a key by themselves (`key`). Values leave their row as hashes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .spans import found

#: The base kinds in their order, their patterns and least sizes (of an assignment, its value's).
BASE = ("assign", "access", "hex")
KEYWORDS = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
SIGN = KEYWORDS + r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN, ACCESS, HEX = SIGN + "[A-Za-z0-9+/_.=-]+", "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
LEAST = 8
#: Kinds that the method adds, after the base kinds.
KINDS = (*BASE, "value", "key")
#: A run of the characters of values (equals signs, which part a name from its value, at the end only), and such runs
#: with a letter and a digit; points at its ends do not belong to it.
RUN = "[A-Za-z0-9+/_.-]{8,}={0,2}"
TOKEN = r"(?<![A-Za-z0-9+/_.-])(?=[+/_.0-9-]*[A-Za-z])(?=[A-Za-z+/_.-]*[0-9])" + RUN
#: A key by its looks, and how many distinct characters it has at least.
KEY, KEY_DISTINCT = "^[A-Za-z0-9_-]{20,512}$", 12
#: Owners that a live credential has at most.
OWNERS = 2

_SPAN = "array<struct<start:bigint,end:bigint,k:int,hash:string,looks:boolean>>"


def _span(k: int, start: Column, end: Column, value: Column, looks: Column | None = None) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), F.lit(k).alias("k"), F.md5(value).alias("hash"), (F.lit(False) if looks is None else looks).alias("looks"))


def _bare(value: Column) -> Column:
    """A value without points at its ends, so that one that ends a sentence is the same value."""
    return F.regexp_replace(value, r"^\.+|\.+$", "")


def looks_like_key(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike(KEY) & value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]") & (distinct >= KEY_DISTINCT)


def base_spans(text: Column) -> Column:
    """array<struct<start, end, k, hash, looks>> by kind and start; k is the place in BASE, hash that of the value."""
    valued = F.transform(found(text, ASSIGN), lambda x: F.struct(x["start"].alias("a"), x["end"].alias("b"), F.regexp_replace(x["s"], "^" + SIGN, "").alias("v")))
    assign = F.transform(F.filter(valued, lambda x: F.length(x["v"]) >= LEAST), lambda x: _span(0, x["a"], x["b"], _bare(x["v"])))

    def plain(k: int, pattern: str) -> Column:
        return F.transform(found(text, pattern), lambda x: _span(k, x["start"], x["end"], x["s"]))

    return F.concat(assign, plain(1, ACCESS), plain(2, HEX))


def tokens(text: Column) -> Column:
    """array<struct<start, end, k, hash, looks>> of candidates; k is that of `value` until they are judged."""
    def trimmed(x):
        lead = F.length(x["s"]) - F.length(F.regexp_replace(x["s"], r"^\.+", ""))
        return F.struct((x["start"] + lead).alias("a"), _bare(x["s"]).alias("v"))

    return F.transform(F.transform(found(text, TOKEN), trimmed), lambda x: _span(3, x["a"], x["a"] + F.length(x["v"]), x["v"], looks_like_key(x["v"])))


def ownership(occurrences: DataFrame) -> DataFrame:
    """(hash, owners, repos, valued): distinct owners, and distinct repositories of owners, that have a candidate, and
    whether a base rule found it anywhere. Counts are built up in three aggregates, so a hash that is everywhere is
    summed before it moves and no set of owners is held."""
    by_repo = occurrences.groupBy("hash", "owner", "repo").agg(F.max(F.col("k") < len(BASE)).alias("valued"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.max("valued").alias("valued"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.max("valued").alias("valued"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "source", owners: int = OWNERS) -> DataFrame:
    """(id_col, base, spans, n_live, n_copied) per row: base spans and all spans as arrays of (start, k, end) by start,
    then kind, k being the place in KINDS, and how many base spans have an owner-specific or a widely copied value.

    Null texts are empty and have no spans; a null owner or repository is one of its own. Repeated rows and null ids
    stay rows of their own, each with its spans; an empty table gives an empty result. Only the named columns are read,
    so others may have any name. Two base spans may overlap; an added span overlaps no base span.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(_SPAN)
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"),
                           F.when(text.rlike(f"{ACCESS}|{HEX}|{SIGN}"), base_spans(text)).otherwise(none).alias("base"), F.when(text.rlike("[0-9]"), tokens(text)).otherwise(none).alias("tokens")))
    each = rows.where(F.size("base") + F.size("tokens") > 0).select("row", "owner", "repo", F.explode(F.concat("base", "tokens")).alias("x")).select("row", "owner", "repo", "x.*")
    verdict = cut(ownership(each))
    judged = each.join(verdict, "hash").select("row", "start", "end", "k", (F.col("owners") <= owners).alias("live"), F.when(F.col("k") < len(BASE), F.col("k")).when(F.col("owners") > owners, None).when(F.col("valued"), 3).when(F.col("looks"), 4).alias("kind")).where("kind is not null")
    # an added span must not overlap a base span: neither the farthest end of those before it nor the first start after it
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    is_base = F.col("kind") < len(BASE)
    before = F.max(F.when(is_base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    backwards = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"))  # a frame to the last row would be computed anew for each row
    after = F.min(F.when(is_base, F.col("start"))).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    clear = judged.withColumns({"before": before, "after": after}).where(is_base | ~(F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("after") < F.col("end"), F.lit(False))))
    listed = F.sort_array(F.collect_list(F.struct("start", F.col("kind").alias("k"), "end")))
    spans = clear.groupBy("row").agg(listed.alias("spans"), F.count_if(is_base & F.col("live")).alias("n_live"), F.count_if(is_base & ~F.col("live")).alias("n_copied"))
    base = F.sort_array(F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"))))
    out = rows.select("row", "id", base.alias("base")).join(spans, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), "base", F.coalesce("spans", "base").alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"], x["end"])), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only name of an origin that documents have is source, so it stands for the owner and for its repository."""
    out = find_secrets(table(spark, sf_dir, "documents"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{BASE[k]}")

    return out.select("doc_id", *map(count, range(3)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "n_live", "n_copied")


def _positions(name: str, pattern: str) -> str:
    """SQL for (row, owner, start, end, s) of a pattern's matches: lengths of gaps and matches, summed up in order."""
    p = pattern.replace("'", "''")
    return f"""{name}0 as (select row, owner, generate_subscripts(m, 1) as i, unnest(m) as s, unnest(g[:len(m)]) as gap from (select row, owner, regexp_extract_all(t, '{p}') as m, regexp_split_to_array(t, '{p}') as g from d) where len(m) > 0),
{name} as (select row, owner, s, sum(length(gap) + length(s)) over w - length(s) as a, sum(length(gap) + length(s)) over w as b from {name}0 window w as (partition by row order by i))"""


ORACLE = f"""with d as (select row_number() over () as row, doc_id, source as owner, coalesce(text, '') as t from documents),
{_positions('assign', ASSIGN)}, {_positions('access', ACCESS)}, {_positions('hexa', HEX)}, {_positions('runs', RUN)},
valued as (select row, owner, a, b, regexp_replace(s, '^{SIGN.replace("'", "''")}', '') as v from assign),
token as (select row, owner, a + length(s) - length(ltrim(s, '.')) as a, trim(s, '.') as v from runs where regexp_matches(s, '[A-Za-z]') and regexp_matches(s, '[0-9]')),
each as (select row, owner, a, b, 0 as k, md5(trim(v, '.')) as h, false as looks from valued where length(v) >= {LEAST}
  union all select row, owner, a, b, 1, md5(s), false from access union all select row, owner, a, b, 2, md5(s), false from hexa
  union all select row, owner, a, a + length(v), 3, md5(v), regexp_matches(v, '{KEY}') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[0-9]') and len(list_distinct(string_split(v, ''))) >= {KEY_DISTINCT} from token),
owned as (select h, count(distinct coalesce('o' || owner, '')) as owners, bool_or(k < 3) as valued from each group by h),
judged as (select row, a, b, k, owners <= {OWNERS} as live, case when k < 3 then k when owners > {OWNERS} then null when valued then 3 when looks then 4 end as kind from each join owned using (h)),
clear as (select * from judged j where kind < 3 or (kind is not null and not exists (select 1 from judged x where x.row = j.row and x.kind < 3 and x.a < j.b and j.a < x.b))),
names as (select *, [{', '.join(f"'{k}'" for k in KINDS)}][kind + 1] || ':' || a::bigint || ':' || b::bigint as said from clear),
sums as (select row, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, string_agg(said, ',' order by a, kind, b) filter (kind < 3) as base, string_agg(said, ',' order by a, kind, b) as spans, count(*) filter (kind < 3 and live) as n_live, count(*) filter (kind < 3 and not live) as n_copied from names group by row)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied from d left join sums using (row)"""
