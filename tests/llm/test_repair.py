"""Conversation repair against an exhaustive search and SQL."""
import hashlib
import heapq
import random
import re
import zlib

import duckdb

from mercato.llm import conversation_repair as cr, registry

SF = "/root/testdata/sf0.01"


def least(initials, fault):
    """Dijkstra over (cost, audit): the first audit that reaches a legal end is the least."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(initials) and last in ("", "a"):
            return cost, audit
        other = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        heapq.heappush(heap, (cost + 2, audit + "I", i, other))
        if i < len(initials):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last))
            if fault[i] in ("", "t"):
                more = 1 if fault[i] == "t" else 0
                if initials[i] and initials[i] in {"": "su", "s": "u", "u": "a", "a": "u"}[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, initials[i]))
                heapq.heappush(heap, (cost + more + 2, audit + "R", i + 1, other))


def test_search_is_exact():
    rnd = random.Random(1)
    for turn in range(4000):
        n = rnd.randrange(0, 13) if turn else 300
        initials = [rnd.choice(["u", "a", "u", "a", "s", "x", ""]) for _ in range(n)]
        fault = [rnd.choice(["", "", "", "t", "b", "d"]) for _ in range(n)]
        assert cr.cheapest_edits(initials, fault) == least(initials, fault)


def test_bounds_are_lower_bounds():
    rnd = random.Random(2)
    for _ in range(500):
        n = rnd.randrange(1, 9)
        initials = [rnd.choice("uasx") for _ in range(n)]
        fault = [rnd.choice(["", "", "t", "b"]) for _ in range(n)]
        assert cr._Bounds(initials, fault)(0, "") <= least(initials, fault)[0]


def plain(rows):
    """The contract in plain Python over (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        mine += [(turn is not None, turn or 0, role.encode(), text.encode(), turn, role, text)] * (2 if code == 3 else 1)
    out = []
    for conv, mine in convs.items():
        mine.sort(key=lambda x: x[:4])
        turns = {x[4] for x in mine} - {None}
        fault, seen = [], set()
        for *_, role, text in mine:
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
            seen.add((role, text))
        initials = [x[5][:1] for x in mine]
        cost, audit = least(initials, fault)
        lines, i, last = [], 0, ""
        for e in audit:
            given = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
            if e == "I":
                lines.append(given + ":")
                last = given[0]
                continue
            role, text = mine[i][5:]
            i += 1
            if e != "D":
                lines.append(f"{role if e == 'K' else given}:{text}")
                last = lines[-1][0]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(fault.count(x) for x in "bdt"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows():
    rnd = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "u"]
    texts = ["Fine.", "Fine.", "cut off", "", "  \n", None, "What?", "Long. " * 20_000, "Ende!\x0b", "é　"]
    rows = [(c, rnd.choice([None, 0, 1, 2, 3, 3, 9]), rnd.choice(roles[:3] if c % 2 else roles), rnd.choice(texts[:4] if c % 3 else texts))
            for c in range(120) for _ in range(rnd.randrange(0, 9))]
    rows += [(None, t, "user", "No id.") for t in (1, 2, None)] + rows[:40]  # repeated rows
    rows += [(1000, i, "assistant" if i % 2 else "user", f"Turn {i}." if i % 3 else f"turn {i}") for i in range(1500)]
    dropped = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "Gone.")] if dropped >= 120 else rows


SCHEMA = "conv_id long, turn long, role string, text string, code string, copies int, cost double, repaired string"


def digests(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_odd_rows(spark, tmp_path):
    rows = odd_rows()
    path = str(tmp_path / "sf")
    spark.createDataFrame([(*r, "x", 7, 1.0, "y") for r in rows], SCHEMA).repartition(3).write.parquet(path + "/conversations.parquet")
    assert digests(cr.op13_conversation_repair(spark, path)) == plain(rows)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/conversations.parquet/*.parquet'")
    rel = con.sql(registry.oracle_sql()["op13_conversation_repair"])
    cols = cr.op13_conversation_repair(spark, path).columns
    assert sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=str) == plain(rows)


def test_nothing(spark):
    assert cr.repaired_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert digests(registry.queries()["op13_conversation_repair"](spark, SF)) == plain(rows)
