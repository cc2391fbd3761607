"""The pipeline's stages over small tables."""
import corpus_pipeline as cp
import __spark_entry__ as entry
from mercato.llm import pfair

SF = "/root/testdata/sf0.001"


def brute_kept(rows):
    """(id, text) of the rows near_duplicates keeps: texts compared by their own shingle sets, all with all."""
    def shingles(text):
        w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        return {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    nodes = sorted({(r.doc_id, r.text or "", r.text) for r in rows if r.doc_id is not None}, key=lambda x: x[:2])
    sets = [shingles(t) for _, _, t in nodes]
    group = list(range(len(nodes)))
    for i in range(len(nodes)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    kept = [nodes[g] for g in sorted(set(group))]
    return sorted([(d, t) for d, _, t in kept] + [(None, r.text) for r in rows if r.doc_id is None], key=str)


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "substrings", "mixing", "encoding"]


def test_stages(spark):
    docs = cp.table(spark, SF, "documents")
    for name, stage in cp.STAGES[:-1]:
        out = cp.written(stage(spark, docs, SF), f"test-{name}")
        assert out.columns == docs.columns
        assert 0 < out.count() <= docs.count()
        if name == "near_duplicates":
            assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == brute_kept(docs.collect())
        if name == "mixing":
            assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
        docs = out
    assert cp.encoding(spark, docs, SF).count() == docs.count()


def test_odd_rows(spark, odd, nothing):
    for name, stage in cp.STAGES[1:4]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns
        rows = out.collect()
        if name == "near_duplicates":
            assert sorted(((r.doc_id, r.text) for r in rows), key=str) == brute_kept(odd.collect())
        assert stage(spark, nothing, SF).count() == 0


def test_mix_positions(spark, monkeypatch):
    """The order of the mix survives many files, which a scan deals to tasks by size."""
    monkeypatch.setattr(cp, "STAGES", [s for s in cp.STAGES if s[0] in ("mixing", "encoding")])
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20000",
            "spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxRecordsPerFile": "30"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = cp.run(spark, SF).select("doc_id", "mix_position").collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    docs = cp.table(spark, SF, "documents")
    want = [r.doc_id for r in pfair.with_slots(pfair.mixed(docs)).orderBy("slot", "in_block").collect()]
    assert len(want) == docs.count()
    assert [r.doc_id for r in rows] != want  # the rows come in another order
    assert sorted(r.mix_position for r in rows) == list(range(len(want)))
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.mix_position)] == want


def test_substrings_of_texts_that_share_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (2, b), (5, a + " one"), (5, b + " two"), (5, "three"), (5, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(map(tuple, cp.substrings(spark, docs, SF).collect()))
    assert out == [(1, a), (2, b), (5, "one"), (5, "three"), (5, "two")]


def test_texts_that_share_an_id_stay(spark):
    """Wholly different texts under one id are no near duplicates; equal rows are."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (5, b), (6, a + " end"), (7, "c d e"), (4, b + " more"), (8, None), (8, None), (None, a)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, node string")
    out = sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, SF).collect()), key=str)
    assert out == brute_kept(docs.collect()) == sorted([(5, a), (4, b + " more"), (7, "c d e"), (8, None), (None, a)], key=str)


def test_first_and_last_stage_on_odd_rows(spark, odd, nothing):
    kept = cp.quality(spark, odd, SF)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert cp.quality(spark, nothing, SF).count() == 0
    mixed = cp.written(cp.mixing(spark, odd, SF), "odd-mix")
    rows = cp.encoding(spark, mixed, SF).collect()
    assert sorted(r.mix_position for r in rows) == list(range(odd.count()))
    assert cp.encoding(spark, cp.written(cp.mixing(spark, nothing, SF), "odd-mix"), SF).count() == 0
