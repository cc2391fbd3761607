"""Conversation structure repair by depth-first branch-and-bound.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``.  The cheapest edits that
make it so are searched over nodes (rows consumed, last role): Keep costs 0, Rerole to user or
assistant 2, Delete 3, Insert of an empty user or assistant turn 2; blank and duplicate rows must be
deleted, a truncated row that stays costs 1 more.  The role a Rerole or Insert gives follows from
the node, so the audit (one letter an edit, ``DIKR``) fixes the whole repair.

The search keeps an explicit stack and pops children in ASCII order, so that of equal costs the
first complete audit is the least one.  A prefix is cut when

* its cost plus a lower bound of the suffix passes the incumbent's cost, or equals it once the
  incumbent has an audit; the bound adds what each row costs at least to 2 for every pair of
  neighbours (of rows that may stay, the last role and the end included) that cannot stand
  together, counted over disjoint pairs;
* its node was entered before at no higher cost (the dominance table): the earlier prefix is then
  no worse, and smaller where costs are equal.

A dive that follows the least bound gives the first incumbent's cost.  The search ends when the
stack is empty, which proves the incumbent optimal.

Rows are shuffled once, by conversation, and sorted by Spark; a task streams them and holds one
conversation, which is one row of the result.

Defined results: a null role or text is one space (so the text is blank); in the damage key a null
id or turn is one space too.  Rows are ordered by turn (nulls first), then role, then text, in
UTF-8 byte order; repeated rows of the input are rows.  Rows with a null id are one conversation.
A role's initial is its first character, none for an empty role.  An empty table gives no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mercato.llm.common import partitions, table

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_ROLES = {"u": "user", "a": "assistant"}
_AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}  # the role that a Rerole or Insert gives after the last role
_KEEPS = {"su", "ua", "au", "s", "u"}  # last role and kept role; nothing may come before the last two


def faults(rows: Iterable[tuple[str, str]]) -> list[str]:
    """First fault of each (role, text): ``b``\\ lank, ``d``\\ uplicate, ``t``\\ runcated or none."""
    seen, out = set(), []
    for row in rows:
        text = row[1].rstrip(BLANKS)
        if not text:
            out.append("b")
        elif row in seen:
            out.append("d")
        else:
            out.append("" if text[-1] in ENDS else "t")
            seen.add(row)
    return out


class _Bounds:
    """Lower bounds of the cost of a suffix, by node."""

    def __init__(self, initials: Sequence[str], fault: Sequence[str]):
        n = len(initials)
        self.initials, self.fixed, self.pairs, self.after = initials, [0] * (n + 1), [0] * (n + 2), [n] * (n + 1)
        # after[i]: first row from i on that may stay; pairs[i]: disjoint conflicts among rows from i on
        for i in range(n - 1, -1, -1):
            self.fixed[i] = self.fixed[i + 1] + (DELETE if fault[i] in ("b", "d") else TRUNCATED if fault[i] == "t" else 0)
            if fault[i] in ("b", "d"):
                self.after[i], self.pairs[i] = self.after[i + 1], self.pairs[i + 1]
                continue
            self.after[i] = i
            here, nxt = initials[i], self.after[i + 1]
            if here not in _AFTER or not here:
                self.pairs[i] = 1 + self.pairs[i + 1]  # a role that no legal conversation has
            elif self._clash(here, nxt):
                self.pairs[i] = max(self.pairs[i + 1], 1 + (self.pairs[nxt + 1] if nxt < n else 0))
            else:
                self.pairs[i] = self.pairs[i + 1]

    def _clash(self, last: str, row: int) -> bool:
        if row == len(self.initials):
            return last in ("u", "s")
        return last + self.initials[row] not in _KEEPS

    def __call__(self, i: int, last: str) -> int:
        row = self.after[i]
        pairs = self.pairs[i]
        if self._clash(last, row):
            pairs = max(pairs, 1 + (self.pairs[row + 1] if row < len(self.initials) else 0))
        return self.fixed[i] + min(REROLE, INSERT) * pairs


def cheapest_edits(initials: Sequence[str], fault: Sequence[str]) -> tuple[int, str]:
    """Cost and audit of the repair: least cost, then ASCII-least audit."""
    n, bound = len(initials), _Bounds(initials, fault)

    def children(i: int, last: str, cost: int) -> list[tuple[str, int, str, int]]:
        """(letter, row, last role, cost) in ASCII order."""
        out = [("I", i, _AFTER[last], cost + INSERT)]
        if i < n:
            out.insert(0, ("D", i + 1, last, cost + DELETE))
            if fault[i] not in ("b", "d"):
                stays = cost + (TRUNCATED if fault[i] == "t" else 0)
                if last + initials[i] in _KEEPS and initials[i]:
                    out.append(("K", i + 1, initials[i], stays))
                out.append(("R", i + 1, _AFTER[last], stays + REROLE))
        return out

    # the dive: always the child of least bound; an insert never follows an insert, so it ends
    i, last, cost, letter = 0, "", 0, ""
    while i < n or last not in ("", "a"):
        options = [c for c in children(i, last, cost) if not (c[0] == letter == "I" and i < n)]
        letter, i, last, cost = min(options, key=lambda c: (c[3] + bound(c[1], c[2]), -c[1]))
    best, audit = cost, None
    entered: list[dict[str, int]] = [{} for _ in range(n + 1)]
    stack: list[tuple[int, str, int, tuple | None]] = [(0, "", 0, None)]
    while stack:
        i, last, cost, path = stack.pop()
        reach = cost + bound(i, last)
        if reach > best or (reach == best and audit is not None) or entered[i].get(last, reach + 1) <= cost:
            continue
        entered[i][last] = cost
        if i == n and last in ("", "a"):
            best, audit = cost, path  # every longer audit from here costs more
            continue
        for letter, row, role, total in reversed(children(i, last, cost)):
            stack.append((row, role, total, (path, letter)))
    letters = []
    while audit is not None:
        audit, letter = audit
        letters.append(letter)
    return best, "".join(reversed(letters))


def repaired_turns(rows: Sequence[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The (role, text) that the edits of an audit leave."""
    out: list[tuple[str, str]] = []
    at, last = 0, ""
    for letter in audit:
        if letter == "I":
            last = _AFTER[last]
            out.append((_ROLES[last], ""))
            continue
        role, text = rows[at]
        at += 1
        if letter == "D":
            continue
        last = role[:1] if letter == "K" else _AFTER[last]
        out.append((role if letter == "K" else _ROLES[last], text))
    return out


def repair(turns: Sequence[int | None], rows: Sequence[tuple[str, str]]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and the repaired turns of one conversation in order."""
    fault, initials = faults(rows), [role[:1] for role, _ in rows]
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = cheapest_edits(initials, fault)
    return (gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, repaired_turns(rows, audit))


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _stream(id_type: pa.DataType):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids, results):
            cols = list(zip(*results))
            yield pa.record_batch(
                [pa.array(ids, id_type), *(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.string()),
                 pa.array([[{"role": r, "text": t} for r, t in x] for x in cols[7]], _TURNS)],
                names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"])
        now, turns, rows = None, [], []  # now: the id of the conversation being read, in a tuple
        ids, results, size = [], [], 0
        for b in it:
            for conv, turn, role, text, copies in zip(*(c.to_pylist() for c in b.columns)):
                if now != (conv,):
                    if now is not None:
                        ids.append(now[0])
                        results.append(repair(turns, rows))
                        size += len(rows)
                        if size > 2000:
                            yield from done(ids, results)
                            ids, results, size = [], [], 0
                    now, turns, rows = (conv,), [], []
                turns += [turn] * copies
                rows += [(role, text)] * copies
        if now is not None:
            yield from done([*ids, now[0]], [*results, repair(turns, rows)])
    return run


def repaired_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                           text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """One row per conversation: counts of its faults, cost, audit and the repaired turns.

    ``copies_col`` says how often a row stands in its conversation; 0 keeps the conversation but not the row.
    """
    copies = F.col(copies_col).cast("int") if copies_col else F.lit(1)
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), copies.alias("copies"))
    id_type = rows.dtypes[0][1]
    id_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(id_type)
    if id_arrow is None:
        raise ValueError(f"conversation ids must be bigint, int or string, not {id_type}")
    return (rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(_stream(id_arrow), f"conv_id {id_type}, gaps long, blank long, duplicate long, truncated long, illegal long, "
                                           "cost long, audit string, repaired array<struct<role:string,text:string>>"))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: each row dropped, emptied, stripped of end marks, doubled, made a user's, or left."""
    def known(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = (F.when(F.col("code").isin(0, 1), "").when(F.col("code") == 2, F.regexp_replace(known("text"), "[.!?]", ""))
            .otherwise(known("text")))
    return (turns.withColumn("code", code)
            .select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"),
                    F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("copies")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost, audit and the hash of the repaired text of every damaged conversation."""
    out = repaired_conversations(damaged(table(spark, sf_dir, "conversations")), copies_col="copies")
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return out.withColumn("repaired_sha256", F.sha2(text, 256)).drop("repaired")


# DuckDB: one row a conversation walks over its rows; for each last role it holds the least "cost, audit" as one string.
def _add(state: str, cost: str, letter: str) -> str:
    return f"(lpad((left({state}, 9)::bigint + {cost})::varchar, 9, '0') || substr({state}, 10) || '{letter}')"


_INSERTED = f"""select conv_id, i, z, s, least(u, {_add('z', '2', 'I')}, {_add('s', '2', 'I')}, {_add('a', '2', 'I')}) as u,
    least(a, {_add('u', '2', 'I')}, {_add(_add('z', '2', 'I'), '2', 'I')}, {_add(_add('s', '2', 'I'), '2', 'I')}) as a"""
_STAY = "case when f = 't' then 1 else 0 end"
_RERUN = f"({_STAY} + 2)"
_K = {c: f"case when f not in ('b', 'd') and initial = '{c}' then " for c in "sua"}
_R = "case when f not in ('b', 'd') then "
OP13_SQL = rf"""
with recursive named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
codes as (
  select *, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda c: ascii(c)::bigint)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [1::bigint, 1, 1, 1, 1, 1, 1, 1]),
        lambda x, one: xor(x >> one, case when x % 2 = 1 then 3988292384::bigint else 0 end)))) % 20 as code from named),
hurt as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
    case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when code = 3 then [1, 2] else [1] end) as copy
  from codes where code <> 0),
placed as (
  select *, left(role, 1) as initial, row_number() over w as i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body
  from hurt window w as (partition by conv_id order by turn nulls first, role, text, copy)),
rows_ as (
  select *, case when body = '' then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '' end as f,
    lead(initial) over (partition by conv_id order by i) as following from placed),
counts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
    count(*) filter (where f = 'b') as blank, count(*) filter (where f = 'd') as duplicate, count(*) filter (where f = 't') as truncated,
    count(*) filter (where following is not null and initial || following not in ('su', 'ua', 'au')) as illegal
  from rows_ group by conv_id),
walk as (
  select conv_id, 0::bigint as i, '000000000' as z, null::varchar as s, null::varchar as u, null::varchar as a from counts
  union all
  select conv_id, i,
    {_add('z', '3', 'D')},
    least({_add('s', '3', 'D')}, {_K['s']}{_add('z', _STAY, 'K')} end),
    least({_add('u', '3', 'D')}, {_K['u']}least({_add('z', _STAY, 'K')}, {_add('s', _STAY, 'K')}, {_add('a', _STAY, 'K')}) end,
      {_R}least({_add('z', _RERUN, 'R')}, {_add('s', _RERUN, 'R')}, {_add('a', _RERUN, 'R')}) end),
    least({_add('a', '3', 'D')}, {_K['a']}{_add('u', _STAY, 'K')} end, {_R}{_add('u', _RERUN, 'R')} end)
  from (select w.*, r.i as next_i, r.f, r.initial from ({_INSERTED} from walk) w join rows_ r
        on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1) t(conv_id, before, z, s, u, a, i, f, initial)),
ends as (
  select w.conv_id, least(z, a) as best from ({_INSERTED} from walk) w join counts c on c.conv_id is not distinct from w.conv_id and c.n = w.i),
letters as (
  select conv_id, unnest(string_split(substr(best, 10), '')) as letter, generate_subscripts(string_split(substr(best, 10), ''), 1) as pos from ends
  where length(best) > 9),
edits as (
  select *, count(*) filter (where letter <> 'I') over w as i, count(*) filter (where letter <> 'D') over w as p
  from letters window w as (partition by conv_id order by pos rows between unbounded preceding and current row)),
turns as (
  select e.conv_id, e.p, e.letter, r.role, case when e.letter = 'I' then '' else r.text end as text,
    max(case when e.p = 1 and e.letter = 'K' and r.initial = 's' then 1 else 0 end) over (partition by e.conv_id) as lead_s
  from edits e left join rows_ r on r.conv_id is not distinct from e.conv_id and r.i = e.i and e.letter <> 'I' where e.letter <> 'D'),
texts as (
  select conv_id, string_agg(case when letter = 'K' then role when (p - lead_s) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by p) as whole
  from turns group by conv_id)
select o.conv_id, coalesce(c.gaps, 0) as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate, coalesce(c.truncated, 0) as truncated,
  coalesce(c.illegal, 0) as illegal, coalesce(left(e.best, 9)::bigint, 0) as cost, coalesce(substr(e.best, 10), '') as audit,
  sha256(coalesce(t.whole, '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on c.conv_id is not distinct from o.conv_id left join ends e on e.conv_id is not distinct from o.conv_id
left join texts t on t.conv_id is not distinct from o.conv_id
"""
