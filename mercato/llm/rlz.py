"""Substring deduplication by relative Lempel-Ziv parsing.

A window of ``window`` (50) consecutive words of a document is a duplicate if
the same words also start in a document with a smaller id.  Every document is
parsed into factors, maximal runs of windows copied from consecutive places of
one reference document:

1.  One pass splits every text into words and chooses content-defined
    reference blocks: of the ``window - block + 1`` blocks of ``block`` (25)
    words inside each window the one with the smallest hash.  A window that
    occurs twice has the same block both times, so blocks shared by two word
    sequences are all that has to be looked at (2 of 27 places of a text).
    Copies of a whole word sequence collapse to their smallest id.
2.  The shared blocks come from a min/max aggregate (combined before the
    shuffle).  Around them, and only there, each document's window phrases are
    dealt by phrase hash; the smallest (document, place) of a phrase is its
    entry in the reference index.  Sorted phrases stream through a task.
    Phrases of blocks that many documents share are salted by document, the
    salts' first places then meet in a small aggregate.
3.  Each document's hits, in order of place, are parsed greedily: a factor goes
    on while the next phrase continues in the same reference, and at every
    factor boundary the phrase that crosses it is looked up on its own, so no
    window is lost where the reference changes.  Hits stream by document.
4.  Factors cover at least ``window`` words; the words they cover go.

Phrases are compared by 128 bits (the phrase's and its block's hash).

Defined results: null text has no words.  Texts under ``window`` words lose
nothing.  Of rows that share an id, none is a duplicate of the other (their id
is not smaller); each text of an id is parsed on its own, told apart by 64 bits.  Rows with a null id lose nothing and are no reference.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mercato.llm.common import batches, discard, mix, partitions, small_batches, table, text_bytes, tidy, window_hashes, word_hashes, written

WINDOW = 50
BLOCK = 25
CROWD = 1024
_U = np.uint64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_EMPTY = hashlib.sha256(b"").hexdigest()


def chosen_blocks(words: np.ndarray, window: int, block: int) -> np.ndarray:
    """For each window the hash of its block, the smallest of the window's."""
    least, span = window_hashes(words, block, salt=block), window - block + 1
    if len(words) < window:
        return least[:0]
    k = 1  # blocks that an entry is the least of; twice as many with each turn
    while k < span:
        more = min(k, span - k)
        least, k = np.minimum(least[:-more], least[more:]), k + more
    return least


def _sequences(window: int, block: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            n, sha, blocks = [], [], []
            for text in text_bytes(b.column(1)):
                parts = (text or b"").split()
                n.append(len(parts))
                sha.append(hashlib.sha256(b" ".join(parts)).digest())
                if len(parts) < window:
                    blocks.append([])
                else:
                    chosen = chosen_blocks(word_hashes(text), window, block)
                    new = np.concatenate(([True], chosen[1:] != chosen[:-1]))  # neighbours mostly share their block
                    blocks.append(np.unique(chosen[new]).view(np.int64))
            yield pa.record_batch([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(blocks, pa.list_(pa.int64()))],
                                  names=["doc_id", "raw", "n_words", "sha", "blocks"])
    return run


def _phrases(window: int, block: int, crowd: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            more: list[bytes | None] = []  # further places of a phrase inside its document
            docs, texts, shared = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()
            for doc, nth, text, wanted in zip(docs, texts, text_bytes(b.column(2)), shared):
                words = word_hashes(text)
                mine = chosen_blocks(words, window, block)
                keys = np.array([w["block"] for w in wanted], dtype=np.int64).view(_U)
                order = np.argsort(keys)
                keys, many = keys[order], np.array([w["k"] for w in wanted], dtype=np.int64)[order]
                at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == mine)
                phrase = window_hashes(words, window)
                ordered = np.argsort(phrase[hit], kind="stable")
                new = np.ones(len(hit), dtype=bool)
                new[1:] = phrase[hit][ordered[1:]] != phrase[hit][ordered[:-1]]
                if new.all():
                    more += [None] * len(hit)
                else:
                    places = np.split(hit[ordered].astype(np.int32), np.flatnonzero(new)[1:])
                    hit = np.array([x[0] for x in places])
                    more += [x[1:].tobytes() if len(x) > 1 else None for x in places]
                salts = np.maximum(1, many[at[hit]] // crowd)
                deal = int(mix(np.array([doc], dtype=np.int64).view(_U))[0] >> _U(1))
                for x, v in zip(out, (phrase[hit].view(np.int64), mine[hit].view(np.int64),
                                      np.where(salts > 1, deal % salts, -1).astype(np.int32),
                                      np.full(len(hit), doc, dtype=np.int64), np.full(len(hit), nth, dtype=np.int64), hit.astype(np.int32))):
                    x.append(v)
            if out[0]:
                yield pa.record_batch([*(pa.array(np.concatenate(x)) for x in out), pa.array(more, pa.binary())],
                                      names=["phrase", "block", "salt", "doc", "seq", "place", "more"])
    return run


def _index_hits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted phrases -> the places that repeat an earlier document, and the first document's places in each salted part."""
    last, ref_doc, ref_seq, ref_place = None, 0, 0, 0
    for b in it:
        if b.num_rows == 0:
            continue
        phrase, block, salt, doc, seq, place = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        new = np.ones(len(phrase), dtype=bool)
        new[1:] = (phrase[1:] != phrase[:-1]) | (block[1:] != block[:-1]) | (salt[1:] != salt[:-1])
        here = (phrase[0], block[0], salt[0])
        group = np.cumsum(new) - 1
        firsts = np.flatnonzero(new)
        rd, rs, rp = doc[firsts], seq[firsts], place[firsts]
        if here == last:
            rd, rs, rp = rd.copy(), rs.copy(), rp.copy()
            rd[0], rs[0], rp[0] = ref_doc, ref_seq, ref_place
        hit = doc > rd[group]
        heads = np.flatnonzero(~hit & (salt >= 0))
        more = {i: np.frombuffer(m, dtype=np.int32) for i, m in enumerate(b.column(6).to_pylist()) if m} if b.column(6).null_count < b.num_rows else {}
        if more:  # a phrase's further places share its row's fate
            rows = np.concatenate((np.arange(len(place)), *(np.full(len(m), i) for i, m in more.items())))
            spots = np.concatenate((place, *more.values()))
        for at, is_head in ((np.flatnonzero(hit), False), (heads, True)):
            if len(at):
                if more:
                    chosen = np.isin(rows, at)
                    at, spot = rows[chosen], spots[chosen]
                else:
                    spot = place[at]
                yield pa.record_batch([pa.array(phrase[at] if is_head else np.zeros(len(at), np.int64)),
                                       pa.array(block[at] if is_head else np.zeros(len(at), np.int64)),
                                       pa.array(np.full(len(at), is_head)), pa.array(doc[at]), pa.array(seq[at]), pa.array(spot),
                                       pa.array(rd[group[at]]), pa.array(rs[group[at]]), pa.array(rp[group[at]])],
                                      names=["phrase", "block", "head", "doc", "seq", "place", "ref_doc", "ref_seq", "ref_place"])
        last, ref_doc, ref_seq, ref_place = (phrase[-1], block[-1], salt[-1]), rd[-1], rs[-1], rp[-1]


_FACTOR = ("start", "length", "ref_doc", "ref_seq", "ref_start")


def _parse(window: int):
    """Hits in order of (doc, seq, place) -> the factors of each (doc, seq): runs that continue in one reference."""
    def out(rows: np.ndarray) -> pa.RecordBatch:
        """One row per (doc, seq) of sorted rows (doc, seq, start, hits, ref_doc, ref_seq, ref_start)."""
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
        first = np.flatnonzero(new)
        lengths = rows[:, 3] + window - 1
        parts = pa.StructArray.from_arrays([pa.array(c) for c in (rows[:, 2], lengths, rows[:, 4], rows[:, 5], rows[:, 6])], names=list(_FACTOR))
        factors = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)), pa.int32()), parts)
        return pa.record_batch([pa.array(rows[first, 0]), pa.array(rows[first, 1]), factors], names=["doc_id", "seq", "factors"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 7), dtype=np.int64)  # factors of the (doc, seq) being read, the last of them still open
        for b in it:
            if b.num_rows == 0:
                continue
            doc, seq, place, ref, ref_seq, at = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6))
            cut = np.ones(len(doc), dtype=bool)
            cut[1:] = ((doc[1:] != doc[:-1]) | (seq[1:] != seq[:-1]) | (place[1:] != place[:-1] + 1)
                       | (ref[1:] != ref[:-1]) | (ref_seq[1:] != ref_seq[:-1]) | (at[1:] != at[:-1] + 1))
            starts = np.flatnonzero(cut)
            hits = np.diff(np.append(starts, len(doc)))
            rows = np.column_stack([doc[starts], seq[starts], place[starts], hits, ref[starts], ref_seq[starts], at[starts]])
            if len(held):
                d, q, s, k, r, rq, rs = held[-1]
                if (rows[0][[0, 1, 2, 4, 5, 6]] == (d, q, s + k, r, rq, rs + k)).all():
                    rows[0, 2], rows[0, 3], rows[0, 6] = s, k + rows[0, 3], rs
                    held = held[:-1]
                rows = np.concatenate((held, rows))
            last = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                yield out(rows[:end])
            held = rows[end:]
        if len(held):
            yield out(held)
    return run


def covered(n_words: int, spans) -> np.ndarray:
    """Marks the words that the spans (start, length) cover."""
    step = np.zeros(n_words + 1, dtype=np.int64)
    for start, length in spans:
        step[start] += 1
        step[min(n_words, start + length)] -= 1
    return np.cumsum(step[:-1]) > 0


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without its marked words; what stands between two kept words stays if they were neighbours."""
    spots = [m.span() for m in _WORD.finditer(text)]
    out, keep, k, n = [], ~gone, 0, len(spots)
    while k < n:
        if not keep[k]:
            k += 1
            continue
        end = k
        while end + 1 < n and keep[end + 1]:
            end += 1
        out.append(text[spots[k][0]:spots[end][1]])
        k = end + 1
    return b"\n".join(out)


def _kept(with_text: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            removed, kept, texts = [], [], []
            for text, spans in zip(text_bytes(b.column(2)), b.column(3).to_pylist()):
                parts = text.split()
                gone = covered(len(parts), ((s["start"], s["length"]) for s in spans))
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(b" ".join(w for w, g in zip(parts, gone) if not g)).hexdigest())
                texts.append(cut(text, gone).decode() if with_text else None)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
                                   pa.array(texts, pa.string())], names=["doc_id", "raw", "n_removed", "kept_sha256", "kept_text"])
    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    block: int = BLOCK, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(results, factors).

    results: one row per input row: doc_id, raw (xxhash64 of its text), n_words, n_removed, kept_sha256 and
    kept_text (null unless ``with_text``, and where nothing is removed).  factors: doc_id, seq, start, length,
    ref_doc, ref_seq, ref_start, in words, of the smallest-id document of each word sequence; further copies are
    removed as a whole.  seq and ref_seq tell the word sequences of one id apart (0 if it has one to parse).
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("raw", F.xxhash64("text"))
    base = written(texts.mapInArrow(tidy(_sequences(window, block)), "doc_id long, raw long, n_words long, sha binary, blocks array<long>"), "rlz-base")

    reps = (base.where("doc_id is not null").groupBy("sha")
            .agg(F.min(F.struct("doc_id", "raw")).alias("first"), F.max(F.size("blocks")).alias("n_blocks"))
            .select("sha", F.col("first.doc_id").alias("rep"), F.col("first.raw").alias("lead"),
                    F.when(F.col("n_blocks") > 0, F.xxhash64("sha")).alias("seq")))
    held = base.where("doc_id is not null and size(blocks) > 0")
    cells = held.select(F.xxhash64("sha").alias("seq"), F.explode("blocks").alias("block")).distinct()
    shared = (cells.groupBy("block").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.count("*").alias("k"))
              .where("a <> b").select("block", "k"))
    wanted = cells.join(shared, "block").groupBy("seq").agg(F.collect_list(F.struct("block", "k")).alias("wanted"))
    several = (reps.where("seq is not null").groupBy("rep").agg(F.min("seq").alias("least"), F.max("seq").alias("most"))
               .where("least <> most").select(F.col("rep").alias("doc_id"), "least"))  # ids with more than one word sequence
    # one text of a word sequence leads: its phrases and spans are those of the id's other spacings of these words
    parsed = (held.select("doc_id", "raw", "sha").distinct().join(reps, "sha").where("doc_id = rep").join(wanted, "seq")
              .join(several, "doc_id", "left")
              .select("doc_id", "raw", F.expr("if(seq = coalesce(least, seq), 0L, seq)").alias("seq"), F.expr("raw = lead").alias("leads"), "wanted"))
    candidates = written(texts.where("text is not null").join(parsed.hint("shuffle_hash"), ["doc_id", "raw"])
                         .select("doc_id", "raw", "seq", "leads", "text", "wanted").dropDuplicates(["doc_id", "raw"]), "rlz-texts")

    phrases = (candidates.where("leads").select("doc_id", "seq", "text", "wanted")
               .mapInArrow(tidy(_phrases(window, block, CROWD)), "phrase long, block long, salt int, doc long, seq long, place int, more binary"))
    hits = written(phrases.repartition(n, "phrase", "salt").sortWithinPartitions("phrase", "block", "salt", "doc", "seq", "place")
                   .mapInArrow(tidy(_index_hits), "phrase long, block long, head boolean, doc long, seq long, place int,"
                                            " ref_doc long, ref_seq long, ref_place int"), "rlz-hits")
    heads = hits.where("head").select("phrase", "block", "doc", "seq", "place")
    first = heads.groupBy("phrase", "block").agg(F.min(F.struct("doc", "seq", "place")).alias("f"))
    late = (heads.join(first, ["phrase", "block"]).where("doc > f.doc")
            .select("doc", "seq", "place", F.col("f.doc").alias("ref_doc"), F.col("f.seq").alias("ref_seq"), F.col("f.place").alias("ref_place")))
    found = hits.where("not head").select("doc", "seq", "place", "ref_doc", "ref_seq", "ref_place").unionByName(late)
    fields = ", ".join(f"{name}:bigint" for name in _FACTOR)
    parses = written(found.repartition(n, "doc", "seq").sortWithinPartitions("doc", "seq", "place")
                     .mapInArrow(tidy(_parse(window)), f"doc_id long, seq long, factors array<struct<{fields}>>"), "rlz-factors")

    discard(hits)
    spans = parses.select("doc_id", "seq", F.transform("factors", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("spans"))
    factors = parses.select("doc_id", "seq", F.explode("factors").alias("f")).select("doc_id", "seq", "f.*")
    changed = (candidates.select("doc_id", "raw", "seq", "text").join(spans.hint("shuffle_hash"), ["doc_id", "seq"])
               .select("doc_id", "raw", "text", "spans")
               .mapInArrow(tidy(_kept(with_text)), "doc_id long, raw long, n_removed long, kept_sha256 string, kept_text string"))
    whole = F.expr(f"doc_id <> rep and n_words >= {window}")
    results = (base.select("doc_id", "raw", "n_words", "sha").join(reps.select("sha", "rep"), "sha", "left")
               .join(changed, ["doc_id", "raw"], "left")
               .select("doc_id", "raw", "n_words",
                       F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                       F.when(whole, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
                       F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")))
    return results, factors


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return substring_dedup(table(spark, sf_dir, "documents"))[0].drop("kept_text", "raw")
