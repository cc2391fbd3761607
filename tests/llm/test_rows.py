"""Classifiers, rules, sampling, mixing, sharding, chat formatting."""
import collections
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mercato.llm import line_rules, pfair, preference, pu_quality, registry, sharding, sp_sampling, zstd_toxicity

SF = "/root/testdata/sf0.001"


def duck(sql, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con.sql(sql)


def same(df, sql):
    rel = duck(sql)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    a = sorted(([r[c] for c in cols] for r in df.collect()), key=str)
    b = sorted(([r[rel.columns.index(c)] for c in cols] for r in rel.fetchall()), key=str)
    assert a == b


@pytest.mark.parametrize("name", ["op6_line_rules", "op9_preference_format"])
def test_against_sql(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name])


def repeat_words(words):
    count = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if count[tuple(words[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def test_line_rules_odd_rows(spark, odd, nothing):
    got = line_rules.judged(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        words = (r.text or "").encode().split()
        lines = [x for x in (r.text or "").split("\n") if x.encode().split()]
        assert r.n_words == len(words) and r.n_repeat_words == repeat_words(words)
        assert r.word_chars == sum(len(w.decode()) for w in words)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words))
        assert not (r.kept and r.base_failed)
    assert line_rules.judged(nothing).count() == 0
    kept = line_rules.cleaned(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)


def test_lines_that_fail(spark):
    good = " ".join(f"plain{i} words" for i in range(40)) + "."
    rows = [(1, good), (2, good + "\nHome | News | About | Contact"), (3, good + "\nALL IN UPPER CASE HERE"),
            (4, good + "\nWe use cookies on this site."), (5, good + "\na*** b&&& c%%%"), (6, good + "\nx | y"),
            (7, "\n".join(["Home | News | About | Contact"] * 30) + "\n" + good)]
    out = {r.doc_id: r for r in line_rules.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].n_lines_removed for i in range(1, 8)] == [0, 1, 1, 1, 1, 0, 30]
    assert out[1].kept and out[2].clean_text == good and not out[7].kept


def labelled(spark, docs, column):
    ids = sorted({r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None})
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in ids], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("scores,column", [(pu_quality.quality_scores, "quality"), (zstd_toxicity.toxicity_scores, "toxic")])
def test_scores_of_odd_rows(spark, odd, nothing, scores, column):
    out = scores(odd, labelled(spark, odd, column)).collect()
    assert len(out) == odd.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert scores(odd, none).count() == odd.count()
    assert scores(nothing, none).count() == 0


def held_out(spark, sf, name, label):
    scored = registry.queries()[name](spark, sf)
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", label).collect()
    pos, neg = ([r.score for r in rows if r[label] == v] for v in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    return auc, np.mean([r.predicted == r[label] for r in rows])


def test_quality_held_out(spark):
    auc, accuracy = held_out(spark, "/root/testdata/sf0.01", "op2_pu_quality", "quality")
    assert auc > 0.85 and accuracy > 0.9


def test_toxicity_held_out(spark):
    auc, accuracy = held_out(spark, "/root/testdata/sf0.1", "op3_zstd_toxicity", "toxic")
    assert auc > 0.88 and accuracy > 0.93


def test_toxicity_sample_keeps_every_text(spark, monkeypatch):
    """A text larger than the byte bound gives its share; the others stay whole."""
    monkeypatch.setattr(zstd_toxicity, "TRAIN_BYTES", 3000)
    rows = [(i, f"text{i} " + "word " * 10) for i in range(12)] + [(50 + i, "long%d " % i + " ".join(f"x{i}_{k}" for k in range(20_000))) for i in range(3)]
    rows += [(90, "y" * 100_000), (91, None), (92, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1 + i) for i, _ in rows], "doc_id long, toxic int, h long").withColumn("h", F.expr("4 * h + 1"))
    got = zstd_toxicity._sample(docs, labels, 1)
    assert len(got) == 16 and 2500 < sum(map(len, got)) <= 3000
    assert {t.encode() for _, t in rows[:12]} <= set(got)
    monkeypatch.setattr(zstd_toxicity, "TRAIN_ROWS", 5)
    lost = labels.unionByName(spark.createDataFrame([(1000 + i, 1, 0) for i in range(9)], "doc_id long, toxic int, h long").withColumn("h", F.lit(1).cast("long")))
    assert len(zstd_toxicity._sample(docs, lost, 1)) == 5  # labels without a text take no place
    assert zstd_toxicity.share_of([5, 1, 9], 100) == 9 and zstd_toxicity.share_of([5, 1, 9], 9) == 4 and zstd_toxicity.share_of([], 9) == 0


@pytest.mark.parametrize("toxic", [0, 1])
def test_toxicity_of_one_class(spark, toxic):
    docs = spark.createDataFrame([(i, f"dreadful thing number{i}") for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(toxic).alias("toxic"))
    scores = {r.score for r in zstd_toxicity.toxicity_scores(docs, labels).collect()}
    assert len(scores) == 1 and abs(scores.pop() - toxic) < 1e-6


def test_prior_estimate(spark):
    """The prior of a mixture whose parts are known."""
    rnd = np.random.default_rng(3)
    def text(good):
        return " ".join(("word%d" if good else "x%d***") % i for i in rnd.integers(0, 500, 80))
    rows = [(i, text(i % 10 < 7)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    featured = pu_quality.feature_table(docs)
    model = pu_quality.train(featured, docs.where("doc_id % 10 < 4 and doc_id % 3 = 0"))
    assert 0.55 < model.prior < 0.85
    kept = {r.doc_id for r in model.kept(docs).collect()}
    assert sum((i in kept) == (i % 10 < 7) for i in range(1500)) > 1450


@pytest.fixture(scope="module")
def pieces():
    return sp_sampling.Pieces()


def test_round_trip(pieces, odd):
    texts = [r.text or "" for r in odd.collect()] + ["  lead", "trail  ", "﷐ ▁▁ x", "\x00", "a" * 5000]
    for t, samples in zip(texts, sp_sampling.sample_group(texts, list(range(len(texts))), pieces, 3)):
        assert 1 <= len(samples) <= 3
        assert len({tuple(s[0].tolist()) for s in samples}) == len(samples)
        assert all(sp_sampling.decoded(s[0].tolist(), pieces) == t for s in samples)
        assert [s[2] for s in samples] == sorted((s[2] for s in samples), reverse=True)
        assert all(0 <= s[3] <= 1 and s[1] <= 0 for s in samples)


def test_samples_follow_the_distribution(pieces):
    n, first, log, pairs = 6000, collections.Counter(), {}, collections.Counter()
    for s in sp_sampling.sample_group(["that"] * n, list(range(n)), pieces, 2):
        a, b = (tuple(x[0].tolist()) for x in s)
        first[a] += 1
        pairs[a, b] += 1
        log |= {a: s[0][1], b: s[1][1]}
    for k, p in log.items():
        assert abs(first[k] / n - math.exp(p)) < 5 * math.sqrt(math.exp(p) / n) + 1e-3
    for (a, b), c in pairs.items():  # the second is drawn from what the first leaves
        p = math.exp(log[a]) * math.exp(log[b]) / (1 - math.exp(log[a]))
        assert abs(c / n - p) < 5 * math.sqrt(p / n) + 1e-3


def test_all_segmentations_of_a_short_text(pieces):
    rows = sp_sampling.sample_group(["to"], [1], pieces, 50)[0]
    assert abs(sum(math.exp(s[1]) for s in rows) - 1) < 1e-9 and all(s[3] == 1 for s in rows)


def test_samples_do_not_depend_on_neighbours(pieces):
    alone = sp_sampling.sample_group(["the cat sat"], [7], pieces, 3)[0]
    among = sp_sampling.sample_group(["first", "the cat sat", "last"], [1, 7, 9], pieces, 3)[1]
    assert [a[0].tolist() for a in alone] == [b[0].tolist() for b in among]


def test_encodings_on_spark(spark, odd, nothing):
    out = sp_sampling.sampled_encodings(odd, k=2)
    assert out.count() == odd.count() and sp_sampling.sampled_encodings(nothing).count() == 0
    back = sp_sampling.decoded_texts(out.select("doc_id", F.col("samples")[0]["ids"].alias("ids")))
    want = collections.Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == want


def test_mix_keeps_windows(spark, odd, nothing):
    weights = spark.createDataFrame([("s0", 5.0), ("s1", 1.0), ("s2", None), (None, 2.0)], "source string, weight double")
    mix = pfair.with_slots(pfair.mixed(odd, weights, period=37, block_rows=2), block_rows=2)
    rows = mix.collect()
    assert len(rows) == odd.count()
    blocks = {(r.source, r.block): r for r in rows}
    assert sorted(r.slot for r in blocks.values()) == list(range(len(blocks)))
    assert all(r.release <= r.virtual_slot < r.deadline for r in rows)
    by_slot = sorted(blocks.values(), key=lambda r: r.slot)
    assert [r.virtual_slot for r in by_slot] == sorted(r.virtual_slot for r in by_slot)
    ordered = pfair.in_mixed_order(odd, period=50)
    assert ordered.columns == odd.columns and ordered.count() == odd.count()
    assert pfair.mixed(nothing).count() == 0


def test_pattern_deviates_by_less_than_a_block(spark):
    parts = spark.createDataFrame([(f"s{i}", 10, p, i) for i, p in enumerate([1, 3, 7, 11, 28])], "source string, rows long, part int, source_no int")
    rows = pfair.period_pattern(parts, 50).collect()
    assert sorted(r.offset for r in rows) == list(range(50))
    for no, part in enumerate([1, 3, 7, 11, 28]):
        mine = sorted(r.offset for r in rows if r.source_no == no)
        assert len(mine) == part
        assert all(abs(sum(o < t for o in mine) - part * t / 50) < 1 for t in range(51))


def edf(parts, period):
    """Slot by slot: the released block of the earliest deadline, then the first source."""
    given, plan = [0] * len(parts), []
    for t in range(period):
        plan.append(min((-(-(g + 1) * period // p), k) for k, (g, p) in enumerate(zip(given, parts)) if g * period <= t * p)[1])
        given[plan[-1]] += 1
    return plan


@pytest.mark.parametrize("sizes", [[1, 3, 7, 11, 28], [5] * 10, [1] * 40 + [10], [2, 2, 2, 3, 3, 3, 4, 31], [50]])
def test_schedule_slot_by_slot(spark, sizes):
    names = [f"s{i:03d}" for i in range(len(sizes))]
    parts = spark.createDataFrame([(n, 10, p, i) for i, (n, p) in enumerate(zip(names, sizes))], "source string, rows long, part int, source_no int")
    rows = sorted(pfair.period_pattern(parts, sum(sizes)).collect(), key=lambda r: r.offset)
    assert [r.source_no for r in rows] == edf(sizes, sum(sizes))


def test_many_sources(spark):
    """More sources than the period has slots: the period grows with them, and every document gets its slot."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("d"), F.col("id") % 1500).alias("source"))
    mix = pfair.with_slots(pfair.mixed(docs, block_rows=1), block_rows=1)
    rows = mix.collect()
    assert len(rows) == 4000 and sorted(r.slot for r in rows) == list(range(4000))
    assert len({r.source for r in rows}) == 1500 and all(r.release <= r.virtual_slot < r.deadline for r in rows)
    assert all(r.period == 3000 for r in rows)


def test_shards(spark, odd, nothing):
    rows = sharding.shard_documents(odd, shards=5, slots=64).collect()
    assert len(rows) == odd.count() and sharding.shard_documents(nothing).count() == 0
    slots = collections.defaultdict(list)
    where = collections.defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        where[r.virtual_slot].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in where.values())


def test_rebalance_moves_little(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    records = sharding.records_of(docs, slots=512)
    sizes = sharding.slot_sizes(records)
    old = sharding.first_map(sizes, 8)
    new = sharding.edited_map(old, sizes, 9)
    before, after = ({r[1]: r[2] for r in m} for m in (old, new))
    total = sum(r[3] for r in old)
    load = collections.Counter()
    for r in new:
        load[r[2]] += r[3]
    moved = sum(r[3] for r in new if before[r[1]] != r[2])
    assert new[0][0] == 2 and moved < 0.2 * total
    assert max(load.values()) < 1.1 * total / 9 and min(load.values()) > 0.9 * total / 9
    folder = str(tmp_path / "map")
    sharding.save_map(spark, old, folder)
    sharding.save_map(spark, new, folder)
    assert {r.virtual_slot: r.shard for r in sharding.load_map(spark, folder, 1).collect()} == before


def test_preference_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, None, None), (2, 0, "user", "hi"), (2, 1, "assistant", "b"),
            (3, 0, "user", "no reply"), (None, 0, "user", "x"), (4, None, "assistant", "b")]
    rows = [(*r, "x", [1], 7) for r in rows]  # columns whose names the operator uses itself
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, reply string, turns array<int>, at int")
    got = {r.pair_id: r for r in preference.preference_pairs(preference.edited_pairs(turns)).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert not got[3].differs and got[3].prompt == "<|user|>\nno reply<|end|>\n" and got[3].chosen == got[3].rejected == ""
    one = got[1]
    assert one.prompt == "<|user|>\nhi<|end|>\n" and one.prompt_turns == 1
    assert one.chosen == "<|assistant|>\na<|end|>\n<|unknown|>\n<|end|>\n" and one.rejected.startswith("<|assistant|>\nb")
    assert [one.chosen[s.start:s.end] for s in one.chosen_trained] == ["a<|end|>\n"[:len("a") + 8]]
    assert not got[2].differs and got[2].chosen == ""  # the next reply is the same
    assert preference.preference_pairs(preference.edited_pairs(turns.limit(0))).count() == 0


def test_lattice_against_enumeration(pieces):
    """Chances of all segmentations of short tokens, enumerated one by one."""
    def segmentations(text):
        if not text:
            return [((), 0.0)]
        out = []
        for k in range(1, len(text) + 1):
            p = pieces.find(sp_sampling._hash_all([text[:k]]))[0]
            if p >= 0:
                out += [((int(pieces.ids[p]), *rest), pieces.logs[p] + more) for rest, more in segmentations(text[k:])]
        return out
    for text in ("that", "than", "aaaa", "étés"):
        want = segmentations(sp_sampling.BLANK + text)
        total = np.logaddexp.reduce([w for _, w in want])
        got = sp_sampling.sample_group([text], [3], pieces, len(want) + 1)[0]
        assert {tuple(s[0].tolist()): round(s[1], 9) for s in got} == {ids: round(float(w - total), 9) for ids, w in want}


def test_plain_vocabulary(pieces):
    again = sp_sampling.Pieces.of(pieces.plain())
    texts, keys = ["the cat sat on the mat", "ほ x"], [4, 5]
    one, two = (sp_sampling.sample_group(texts, keys, v, 2) for v in (pieces, again))
    assert [[s[0].tolist() for s in r] for r in one] == [[s[0].tolist() for s in r] for r in two]


def test_pieces_by_their_beginnings(pieces):
    """From char to char, the table of beginnings leads to every piece and to nothing else."""
    def walk(text):
        slot = 0
        for c in text:
            to = pieces.base[slot] + pieces.classes[ord(c)]
            if pieces.owner[to] != slot:
                return -1
            slot = to
        return int(pieces.place[slot])
    texts = [pieces.bytes_of[i].decode().replace(" ", sp_sampling.BLANK) for i in pieces.ids.tolist()]
    assert [walk(t) for t in texts] == list(range(len(texts)))
    known, others = set(texts), [t + c for t in texts[::50] for c in "aq\x00\U0010ffff"]
    assert all((walk(t) >= 0) == (t in known) for t in others + [t[:-1] for t in texts[::50] if len(t) > 1])


@pytest.mark.parametrize("k", [1, 2, 5])
def test_open_nodes_far_behind_are_not_drawn(pieces, monkeypatch, k):
    """A long text draws one value a decision and few beside them, with the samples that all open nodes give."""
    rnd = np.random.default_rng(1)
    texts = [" ".join(rnd.choice("alpha beta thing other running stations".split(), n)) for n in (3000, 1, 0, 40, 700)]
    mixed, mix = [], sp_sampling.mix
    monkeypatch.setattr(sp_sampling, "mix", lambda x: mixed.append(x.size) or mix(x))
    near = sp_sampling.sample_group(texts, list(range(5)), pieces, k)
    assert sum(mixed) < 1.1 * sum(len(s[0]) for r in near for s in r) + 1000
    monkeypatch.setattr(sp_sampling, "SPREAD", np.inf)
    mixed.clear()
    every = sp_sampling.sample_group(texts, list(range(5)), pieces, k)
    assert sum(mixed) > 1.5 * sum(len(s[0]) for r in every for s in r)
    assert [[(s[0].tolist(), *s[1:]) for s in r] for r in near] == [[(s[0].tolist(), *s[1:]) for s in r] for r in every]
