"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary texts, one on the
passages of toxic texts that make them toxic (a toxic label covers a whole
document while few of its words carry it, so passages are the words whose
beginnings occur in significantly more toxic than ordinary documents).  Every text is cut
into overlapping windows of a few words, each window is compressed with the
ordinary dictionary alone and with the toxic one laid before it, and the
difference of the two lengths is the window's distance.  Background compresses
equally well either way and cancels out.  The document's distances (largest,
mean, shares and counts above thresholds) are calibrated to a probability by a
logistic fit on labelled rows that gave nothing to the dictionaries.

The dictionaries learn from a bounded sample of labelled rows: at most ``TRAIN_ROWS``
rows with words and ``TRAIN_BYTES`` bytes a class, chosen by a hash of the id.  Where the
chosen texts hold more bytes, each gives at most an equal share (what short texts leave goes
to the longer ones): runs of its words chosen by their hash.  The logistic
fit uses at most ``FIT_ROWS`` labelled rows.  Everything else covers all rows and
whole texts in one pass without a shuffle of texts.

Defined results: null and blank texts have no window and distance 0.  Without
toxic or without ordinary training rows every score is the share of toxic
labels (0 if there are none).  Labels of a repeated id count once per row.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from mercato.llm.common import batches, table, text_bytes, written
from mercato.llm.pu_quality import _matrix, _sigmoid, fold

TRAIN_ROWS = 1500
TRAIN_BYTES = 24_000_000
FIT_ROWS = 20_000
WORDS, STEP = 8, 7
LEVEL = 9
ORDINARY_SIZE, TOXIC_SIZE = 16_384, 2_048
SIGNIFICANT = 6.0
LEVELS = (1, 2, 3, 4, 6)
WIDTH = 4 + 2 * len(LEVELS)


def windows(data: bytes | None, words: int = WORDS, step: int = STEP) -> list[bytes]:
    parts = (data or b"").split()
    return [b" " + b" ".join(parts[i:i + words]) + b" " for i in range(0, max(1, len(parts) - words + step), step)] if parts else []


def telling_prefixes(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Word beginnings of 4 to 12 bytes in significantly more toxic than ordinary texts (z-test of the shares)."""
    least = max(3, 0.01 * len(toxic))
    words = [set(x.split()) for x in toxic]
    kept: dict[bytes, int] = {}
    frequent = None
    for k in range(4, 13):  # a longer beginning is no more frequent than a shorter one
        counts = Counter(p for ws in words for p in {w[:k] for w in ws if len(w) >= k and (frequent is None or w[:k - 1] in frequent)})
        frequent = {p for p, c in counts.items() if c >= least}
        kept |= {p: counts[p] for p in frequent}
    other: Counter = Counter()
    for x in ordinary:
        other.update({w[:k] for w in set(x.split()) for k in range(4, min(len(w), 12) + 1) if w[:k] in kept})
    nt, no = len(toxic), len(ordinary)
    out = set()
    for p, a in kept.items():
        b = other[p]
        share = (a + b) / (nt + no)
        if (a / nt - b / no) / np.sqrt(share * (1 - share) * (1 / nt + 1 / no) + 1e-12) > SIGNIFICANT:
            out.add(p)
    return out


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, d=6, k=segment).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the samples themselves
        return b"".join(samples)[-size:].rjust(16)


class Distance:
    """The two dictionaries; gives a text's distance figures."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes]):
        marks = telling_prefixes(toxic, ordinary) if toxic and ordinary else set()
        samples = []
        for x in toxic:
            hits = [w for w in x.split() if any(w[:k] in marks for k in range(4, min(len(w), 12) + 1))]
            samples += [b" " + b" ".join(hits[i:i + 4]) + b" " for i in range(0, len(hits), 4)]
        plain = [w for x in ordinary for w in windows(x)]
        self.ordinary = _trained(plain, ORDINARY_SIZE, 24)
        self.toxic = _trained(samples, TOXIC_SIZE, 16) if samples else b""

    def compressors(self):
        for content in (self.ordinary, self.toxic + self.ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            yield zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def figures(data: bytes | None, plain, toxic) -> list[float]:
    parts = windows(data)
    if not parts:
        return [0.0] * WIDTH
    r = np.sort(np.array([len(plain.compress(w)) - len(toxic.compress(w)) for w in parts], dtype=np.float64))[::-1]
    above = [np.count_nonzero(r >= t) for t in LEVELS]
    return [r[0], r[:3].sum(), r.mean(), np.log1p(len(r)), *(a / len(r) for a in above), *np.log1p(above)]


def figure_table(docs: DataFrame, distance: Distance) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((distance.ordinary, distance.toxic))  # at most the two dictionary sizes

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Distance.__new__(Distance)
        mine.ordinary, mine.toxic = shared.value
        plain, toxic = mine.compressors()
        for b in batches(it):
            rows = [figures(x, plain, toxic) for x in text_bytes(b.column(1))]
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * WIDTH, pa.int32()),
                                         pa.array(np.array(rows, dtype=np.float32).ravel(), pa.float32()))
            yield pa.record_batch([b.column(0), x], names=["doc_id", "x"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, x array<float>")


def share_of(sizes: list[int], total: int) -> int:
    """The largest bound at which texts of these sizes, each cut to it, hold at most ``total`` bytes."""
    left = total
    for k, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - k) > left:
            return left // (len(sizes) - k)
        left -= size
    return max(sizes, default=0)


def portion(data: bytes, most: int, run: int = 8 * WORDS) -> bytes:
    """At most ``most`` bytes of a text: runs of its words with the smallest hashes, in their order."""
    if len(data) <= most:
        return data
    words = data.split()
    runs = [b" ".join(words[i:i + run]) for i in range(0, len(words), run)]
    taken, left = {}, most
    for i in sorted(range(len(runs)), key=lambda i: hashlib.blake2b(b"%d " % i + runs[i]).digest()):
        if left <= 0:
            break
        taken[i] = runs[i][:left]
        left -= len(taken[i]) + 1
    return b"\n".join(taken[i] for i in sorted(taken))


def _sample(docs: DataFrame, labels: DataFrame, toxic: int) -> list[bytes]:
    """Texts of at most TRAIN_ROWS rows of a class and at most TRAIN_BYTES bytes of them, by a hash of the id, three of four hashes."""
    ids = labels.where(F.col("toxic") == toxic).where("h % 4 <> 0").select("doc_id", "h")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = texts.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("t"))
    picked = sizes.join(ids, "doc_id").orderBy("h", "doc_id", "t").limit(TRAIN_ROWS).collect()  # ids and sizes of at most TRAIN_ROWS rows
    most = share_of([r["size"] for r in picked], TRAIN_BYTES)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            yield pa.record_batch([b.column(0), b.column(1), pa.array([portion(x, most) for x in text_bytes(b.column(2))], pa.binary())],
                                  names=["doc_id", "t", "text"])
    keys = docs.sparkSession.createDataFrame(sorted({(r.doc_id, r.t) for r in picked}), "doc_id long, t long")
    chosen = (texts.withColumn("t", F.xxhash64("text")).join(F.broadcast(keys), ["doc_id", "t"])  # at most TRAIN_ROWS rows
              .select("doc_id", "t", "text").mapInArrow(cut, "doc_id long, t long, text binary").dropDuplicates(["doc_id", "t"]))
    found = {(r.doc_id, r.t): bytes(r.text) for r in chosen.collect()}
    return [found[r.doc_id, r.t] for r in picked]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w)), x.T @ (p - y) / len(y) + ridge * w)
        w -= step * min(1.0, 5.0 / max(np.linalg.norm(step), 1e-12))
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, largest and mean distance of every row."""
    known = (labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0))
             .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .withColumn("h", F.xxhash64("doc_id", F.lit("toxicity")).bitwiseAND(F.lit((1 << 62) - 1))))
    distance = Distance(_sample(docs, known, 1), _sample(docs, known, 0))
    table_ = written(figure_table(docs, distance), "zstd-figures")
    rows = (table_.join(known, "doc_id").orderBy((F.col("h") % 4), "h", "doc_id").limit(FIT_ROWS).select("x", "toxic", "h").collect())
    free = [r for r in rows if r.h % 4 == 0]
    if len({r.toxic for r in free}) < 2:
        free = rows
    y = np.array([r.toxic for r in free], dtype=float)
    x = np.array([r.x for r in free], dtype=float).reshape(len(free), WIDTH)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    if distance.toxic and len(set(y)) == 2:
        weights = _logistic(np.c_[(x - mean) / scale, np.ones(len(x))], y)
    else:
        share = y.mean() if len(y) else 0.0
        weights = np.append(np.zeros(WIDTH), np.log((share + 1e-9) / (1 - share + 1e-9)))

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            m = _matrix(b.column(1)).reshape(b.num_rows, WIDTH)
            s = _sigmoid(np.c_[(m - mean) / scale, np.ones(len(m))] @ weights)
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64()), pa.array(m[:, 0]), pa.array(m[:, 2])],
                                  names=["doc_id", "score", "largest", "mean_distance"])
    scored = table_.mapInArrow(score, "doc_id long, score double, largest double, mean_distance double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "largest", "mean_distance")


def op3_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
