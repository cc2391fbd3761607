"""Joins, substrings and fingerprints against brute force."""
import collections
import hashlib
import random
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mercato.llm import fingerprints as fp
from mercato.llm import ngram_join, rlz
from mercato.llm.common import powers, window_hashes, word_hashes
from mercato.llm.components import connected

SF = "/root/testdata/sf0.001"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return {b" ".join(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({b" ".join(w)} if w else set())


def brute_components(rows):
    """rows: (id, text); ids link when any of their sets do."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(d), find(e)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


def test_word_hashes_match_words():
    data = "Ab  cd\tab\x0bAB é\n".encode()
    h = word_hashes(data)
    assert len(h) == len(data.split()) == 5 and len(set(h.tolist())) == 5
    low = word_hashes(data, lower=True)
    assert low[0] == low[2] == low[3]
    assert np.array_equal(window_hashes(h, 2)[1:], window_hashes(h[1:], 2))
    assert len(word_hashes(b"")) == 0 and len(window_hashes(h, 6)) == 0
    up, down = powers(100)
    assert (up[:100] * down[:100] == 1).all()


def test_pieces_of_long_texts_hash_alike(monkeypatch):
    from mercato.llm import common
    data = b" ".join(b"w%d" % i for i in range(500))
    whole = word_hashes(data)
    monkeypatch.setattr(common, "PIECE", 64)
    assert np.array_equal(word_hashes(data), whole)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 5), (7, 8), (8, 7), (None, 4)] + [(100, 100 + i) for i in range(1, 50)], "a long, b long")
    got = {r.node: r.component for r in connected(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7} | {100 + i: 100 for i in range(50)}
    assert connected(edges.limit(0)).count() == 0


def jobs_of(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_of_paths_and_hubs(spark):
    rnd = random.Random(3)
    path, late = rnd.sample(range(1000, 9000), 700), rnd.sample(range(10_000, 20_000), 300)
    edges = list(zip(path, path[1:])) + [(20_001, x) for x in late] + [(late[5], 20_002), (20_002, 7), (7, 7)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges * 3, "a long, b long")).collect()}
    assert got == {x: min(path) for x in path} | {x: 7 for x in late + [20_001, 20_002, 7]}


def test_components_take_few_jobs(spark):
    edges = spark.createDataFrame([(i, i + 1 + i % 3) for i in range(0, 400, 5)] + [(1000, 1000 + i) for i in range(1, 400)], "a long, b long")
    got, jobs = jobs_of(spark, lambda: connected(edges).count())
    assert got == 560 and jobs <= 13


def test_sketch_comes_with_four_bytes_a_counter():
    parts = pa.record_batch([pa.array([3, 3], pa.int32()), pa.array([ngram_join._packed(np.full(8, 2 ** 32 - 2, dtype=np.uint32))] * 2)], names=["slice", "counts"])
    (out,) = ngram_join._sum_slices(8)(iter([parts]))
    assert np.frombuffer(out.column(1)[0].as_py(), dtype=np.uint32).tolist() == [2 ** 32 - 1] * 8


def test_join_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out, links = ngram_join.ngram_jaccard_join(docs)
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in out.collect()} == want
    assert all(r.n_shingles == len(shingles(dict(rows)[r.doc_id])) for r in out.collect())
    by = dict(rows)
    assert all(r.overlap == len(shingles(by[r.a]) & shingles(by[r.b])) for r in links.collect())


def test_join_odd_rows_with_salted_columns(spark, odd):
    out, _ = ngram_join.ngram_jaccard_join(odd, dense=2, sketch_bits=12)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute_components([r for r in rows if r[0] is not None])
    got = out.collect()
    assert len(got) == len(rows)
    assert all(r.component_id == want.get(r.doc_id) for r in got)
    assert collections.Counter(r.n_shingles for r in got) == collections.Counter(len(shingles(t)) for _, t in rows)


def test_join_of_a_large_group_of_near_copies(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:7 + i % 40] + [f"e{i}"] + words[8 + i % 40:])) for i in range(300)]
    rows += [(1000 + i, " ".join(f"u{i}_{j}" for j in range(30)) + " " + " ".join(words)) for i in range(100)]
    out, links = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == brute_components(rows)


def test_join_takes_few_jobs(spark):
    """Each job is a shuffle of all partitions, however few rows are left: they, not the rows, take the time of many small partitions."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:7 + i % 40] + [f"e{i}"] + words[8 + i % 40:])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, jobs = jobs_of(spark, lambda: {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(docs)[0].collect()})
    assert got == brute_components(rows) and jobs <= 140


def test_join_documents_between_others(spark):
    """The middle of three shares its rare shingles with each of the others alone: columns of two rows, several pivots."""
    rows = []
    for f in range(12):
        words = [f"f{f}w{i}" for i in range(104)]
        rows += [(10 * f + 1, " ".join(words[:95] + [f"f{f}end{i}" for i in range(9)])), (10 * f + 9, " ".join(words)),
                 (10 * f + 2, " ".join([f"f{f}lead{i}" for i in range(9)] + words[9:]))]
    out, _ = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_components(rows)
    assert all(want[10 * f + x] == 10 * f + 1 for f in range(12) for x in (1, 2, 9))
    assert {r.doc_id: r.component_id for r in out.collect()} == want


def test_join_texts_of_one_id_in_a_column(spark):
    base, common = " ".join(f"b{i}" for i in range(104)), " ".join(f"c{i}" for i in range(300))
    rows = [(2, f"{base} {common}"), (2, base + " tail"), (7, base), (2, " "), (7, None)]
    rows += [(20 + x, f"{common} " + " ".join(f"x{x}_{i}" for i in range(300))) for x in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out, _ = ngram_join.ngram_jaccard_join(docs)
    assert {r.doc_id: r.component_id for r in out.collect()} == brute_components(rows) | {7: 2}


def test_empty_tables(spark, nothing):
    assert ngram_join.ngram_jaccard_join(nothing)[0].count() == 0
    assert rlz.substring_dedup(nothing)[0].count() == 0
    assert fp.next_fingerprints(nothing).count() == 0
    assert fp.fingerprints(nothing).count() == 0


def brute_removed(rows, window=50):
    first = {}
    for d, t in sorted(((d, t) for d, t in rows if d is not None), key=lambda x: x[0]):
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i:i + window])] < d:
                    gone[i:i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [1024, 1])
def test_substrings_brute_force(spark, odd, monkeypatch, crowd):
    monkeypatch.setattr(rlz, "CROWD", crowd)
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        out, factors = rlz.substring_dedup(docs)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()), key=str)
        assert got == brute_removed([(r.doc_id, r.text) for r in docs.collect()])
        assert factors.where("length < 50 or ref_doc >= doc_id").count() == 0


@pytest.mark.parametrize("crowd", [1024, 1])
def test_substrings_of_several_texts_per_id(spark, monkeypatch, crowd):
    monkeypatch.setattr(rlz, "CROWD", crowd)
    a, b, c = (" ".join(f"{x}{i}" for i in range(120)) for x in "abc")
    rows = [(1, a), (1, "lead in " + b), (5, c + " " + a[:400]), (5, b + " clean tail words"), (5, b.replace(" ", "\n") + "  clean tail words"),
            (5, b + " clean tail words"), (7, "x y z " + c), (7, b[:420] + " " + a), (7, a), (None, a)]
    rows += [(9, f"{x} " + " ".join(f"only{x}_{i}" for i in range(60)) + " " + t) for x, t in enumerate((a, b, c, a + " end", "none"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out, factors = rlz.substring_dedup(docs, with_text=True)
    out = out.collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str)
    assert got == brute_removed(rows)
    assert {r.kept_text for r in out if r.doc_id == 5 and r.n_words == 123} == {"clean tail words"}
    # every factor copies its words from one place of one text
    texts = [(d, t.split()) for d, t in rows if d is not None]
    for f in factors.collect():
        spans = lambda doc, at: {tuple(w[at:at + f.length]) for d, w in texts if d == doc and at + f.length <= len(w)}
        assert spans(f.doc_id, f.start) & spans(f.ref_doc, f.ref_start)


def test_cut_text():
    text = b"a b\nc d  e"
    assert rlz.cut(text, np.array([False, True, True, False, False])) == b"a\nd  e"
    assert rlz.cut(text, np.ones(5, dtype=bool)) == b""


def test_fingerprints_neighbours(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (docs, odd):
        rows = sorted(((r.doc_id, r.text or "") for r in table.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
        want = []
        for i, (d, t) in enumerate(rows):
            n = rows[(i + 1) % len(rows)][1]
            e = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
            a, b, c = (fp.fingerprint(x.encode()) for x in (t, e, n))
            want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.packed(a), fp.packed(b), fp.likeness(a, b), fp.likeness(a, c)))
        got = [tuple(r)[:7] for r in fp.next_fingerprints(table).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_chunks_resist_shifts():
    rnd = np.random.default_rng(1)
    text = bytes(rnd.integers(97, 123, 20_000, dtype=np.uint8))
    ends = fp.boundaries(text)
    assert ends[-1] == len(text) and all(b - a <= fp.GREATEST for a, b in zip([0] + ends, ends))
    moved = fp.fingerprint(b"inserted " + text)
    assert fp.containment(fp.fingerprint(text), moved) > 0.97
    assert fp.likeness(fp.fingerprint(text), fp.fingerprint(text[::-1])) == 0
    assert fp.likeness({}, {}) == 1 and fp.likeness(fp.fingerprint(b"x"), {}) == 0
    assert fp.unpacked(fp.packed(moved)) == moved


def test_gear_is_the_rolling_hash(monkeypatch):
    data = bytes(range(256)) * 3
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(fp._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert fp.gear(data).tolist() == want
    whole = fp.boundaries(data)
    monkeypatch.setattr(fp, "PIECE", 100)
    assert fp.boundaries(data) == whole


def test_words_and_window_minima():
    """Hashes and sizes of all words, and each window's least block, against plain loops; long texts come in pieces."""
    from mercato.llm import common, pu_quality
    for text in (b"", b" \t\n", b"one", b"\x0bone\x0ctwo\r\n three \xc3\xa9\x85\xa0 ", b"a bb ccc dddd " * 90, b"word\x00s " * 200_000):
        words, sizes = common.words_of(text, lower=True)
        assert sizes.tolist() == [len(w) for w in text.split()]
        assert [int(w) for w in words[:300]] == [int(common.word_hashes(w, lower=True)[0]) for w in text.split()[:300]]
    rnd = np.random.default_rng(3)
    for n, window, block in ((0, 5, 2), (4, 5, 2), (5, 5, 5), (60, 5, 2), (300, 50, 20), (300, 50, 1), (64, 64, 3)):
        words = rnd.integers(0, 40, n).astype(np.uint64)
        hashes = common.window_hashes(words, block, salt=block)
        assert rlz.chosen_blocks(words, window, block).tolist() == [
            int(hashes[i:i + window - block + 1].min()) for i in range(max(0, n - window + 1))]
    assert sorted(pu_quality._runs(np.array([3, 1, 3, 3, 2], dtype=np.uint64)).tolist()) == [1, 1, 3]
