"""Line dedup against a plain version and SQL."""
import collections
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from mercato.llm import line_dedup, registry

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = collections.defaultdict(set)
    for doc, text in rows:
        for x in (text or "").split("\n"):
            held[key(x)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for x in lines:
            docs = held[key(x)] - {None}
            if len(key(x)) < 20 or len(docs) < 3 or doc == max(docs):
                kept.append(x)
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()), key=str)


A, B, C = "A line that many documents hold", "Étude longue de vingt caractères", "x" * 20
ROWS = [
    (1, f"{A}\nown line of the first document\n{B}"), (2, f"  {A.upper()}\t\n{B}\n{B}\nshort\n"), (3, f"{A}\r\n{B.upper()}\n{A}"),
    (4, None), (5, ""), (6, "\n\n"), (7, f"{A}"), (7, f"{A}\n{A}"), (7, f"{A}"), (8, B), (9, C), (10, C[:-1]), (11, C), (12, f"{C}\n{C[:-1]}"),
    (13, C[:-1]), (None, f"{A}\n{C}\nleft"), (None, A), (20, "two documents hold this line"), (21, "two documents hold this line"),
    (22, "one document, two rows, same line"), (22, "one document, two rows, same line"), (22, "one document, two rows, same line\n"),
    (30, "\n".join(f"line {i} of a very long document {i % 700}" for i in range(20_000))),
    (31, "\n".join(f"line {i} of a very long document {i % 700}" for i in range(0, 20_000, 3))),
    (32, "\n".join(f"line {i} of a very long document {i % 700}" for i in range(0, 20_000, 2))),
]


@pytest.mark.parametrize("hot", [1, 50, 10**6])
def test_against_plain(spark, monkeypatch, hot):
    """The same results whether no key counts as hot, some or (nearly) all."""
    monkeypatch.setattr(line_dedup, "HOT", min(hot, 1000))
    df = spark.createDataFrame([(*r, "h", 1, 2) for r in ROWS], "doc_id long, text string, row string, pos int, h1 long").repartition(3)
    assert digests(line_dedup.line_deduped(df)) == plain(ROWS)


def test_odd_rows(spark, odd, nothing):
    assert digests(line_dedup.line_deduped(odd)) == plain([(r.doc_id, r.text) for r in odd.collect()])
    assert line_dedup.line_deduped(nothing).count() == 0


def test_bitmaps(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    found = {(r.doc, r.n_dropped): [tuple(x) for x in r.bitmap] for r in line_dedup.dropped_lines(docs).collect()}
    assert found[(1, 2)] == [(0, 0), (2, 2)] and found[(2, 3)] == [(0, 2)]
    for (_, n), runs in found.items():
        assert sum(b - a + 1 for a, b in runs) == n
        assert all(x[1] + 1 < y[0] for x, y in zip(runs, runs[1:]))


def test_native(spark):
    plan = registry.queries()["op12_line_dedup"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_against_sql(spark):
    df = registry.queries()["op12_line_dedup"](spark, SF)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rel = con.sql(registry.oracle_sql()["op12_line_dedup"])
    assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(rel.fetchall())
