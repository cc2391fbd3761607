"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good texts; the unlabelled set is all web text.
A linear model on per-text statistics minimises the non-negative unbiased risk

    pi R_p+ + max(0, R_u- - pi R_p-)

with the logistic loss.  For this loss the first form is convex, so Newton steps
are used; where the estimated negative risk turns negative, the step goes up its
gradient instead, as the non-negative estimator asks.  The class prior pi is
estimated from the data: a first model separates positives from unlabelled text
on one half of the rows, and on the other half the prior is the smallest ratio
of the two sets' upper score tails, less a margin for chance.

Every statistic, the prior and each step's gradient and curvature are sums over
all rows, added up in Spark; the driver holds vectors of the feature count.
Texts are read once, into a table of about 40 numbers a row.

Defined results: null and blank texts get the features of an empty text.  Rows
that share an id are scored each by its own text; a null id has no label.
Without positives every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mercato.llm.common import batches, discard, small_batches, table, text_bytes, tidy, window_hashes, words_of, written

RIDGE = 1e-3
STEPS = 12
BINS = 400

# Byte classes whose shares are features.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"|",
           b"#*$%&<>~^{}[]\\_=+@", b"-'\"():;/", bytes(range(0x80, 0x100)))
_CLASS = np.zeros((256, len(CLASSES)))
for _i, _c in enumerate(CLASSES):
    _CLASS[list(_c), _i] = 1
_ENDS = tuple(bytes([x]) for x in b".!?:;\"')")


def _runs(x: np.ndarray) -> np.ndarray:
    """How often each distinct value comes."""
    x = np.sort(x)
    return np.diff(np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))))


def features(data: bytes | None) -> np.ndarray:
    """Statistics of a text: byte shares, word lengths, repetition and line shape."""
    data = data or b""
    n = max(1, len(data))
    shares = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ _CLASS / n
    words, lengths = words_of(data)
    count = len(words)
    k = max(1, count)
    sizes = lengths.astype(np.float64) if count else np.zeros(1)
    threes = window_hashes(words, 3)
    seen = _runs(words) if count else np.zeros(1)
    kinds, top, fresh = len(seen), seen.max() / k, len(_runs(threes)) / len(threes) if len(threes) else 1.0
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    out = np.concatenate((
        np.sqrt(shares), np.minimum(shares * 20, 1.0),
        [np.log1p(count), min(1.0, count / 30), sizes.mean() / 10, sizes.std() / 10, sizes.max() > 40,
         kinds / k, 1 - fresh, 1 - len(set(lines)) / m,
         sum(x.rstrip().endswith(_ENDS) for x in lines) / m, np.log1p(count / m), np.log1p(m),
         top, max(0.0, top - 0.3) * 3, max(0.0, 0.35 - kinds / k) * 3 * (k > 20), max(0.0, 0.5 - fresh) * 2]))
    return out.astype(np.float32)


WIDTH = len(features(b""))


def _featured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        rows = [features(x) for x in text_bytes(b.column(1))]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
        x = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * WIDTH, pa.int32()), pa.array(flat, pa.float32()))
        yield pa.record_batch([b.column(0), x], names=["doc_id", "x"])


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(tidy(_featured), "doc_id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _total(rows: DataFrame, per_batch) -> np.ndarray:
    """Sum over all rows of ``per_batch(x, positive, half)``, a fixed-length vector; added up by key in Spark."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in it:
            if b.num_rows:
                part = per_batch(_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "v"])
    summed = rows.select("x", "positive", "half").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(summed))
    for r in summed:
        out[r.k] = r.v
    return out


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(z / 2))


def _softplus(z):
    return np.logaddexp(0, z)


def _with_bias(x, mean, scale):
    return np.hstack((np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))))


def fit(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, prior: float | None, half: int | None, steps: int = STEPS) -> np.ndarray:
    """Weights by Newton steps.

    With a prior: the non-negative unbiased risk.  Without: positives against unlabelled, both weighing
    half.  ``half`` restricts the fit to one half of the rows.
    """
    d = len(mean) + 1
    w = np.zeros(d)
    for _ in range(steps):
        now = w

        def sums(x, positive, which):
            use = np.ones(len(x), dtype=bool) if half is None else which == half
            x, pos = _with_bias(x[use], mean, scale), positive[use].astype(bool)
            z = x @ now
            p, xp, zp = _sigmoid(z), x[pos], z[pos]
            sp = _sigmoid(zp)
            return np.concatenate((
                [len(x), len(xp), _softplus(z).sum(), _softplus(zp).sum(), _softplus(-zp).sum()],
                x.T @ p, xp.T @ sp, xp.sum(axis=0),
                ((x * (p * (1 - p))[:, None]).T @ x).ravel(), ((xp * (sp * (1 - sp))[:, None]).T @ xp).ravel()))

        t = _total(rows, sums)
        nu, np_, u_neg, p_neg, _ = t[:5]
        if np_ == 0 or nu == 0:
            return np.zeros(d)
        gu, gp_neg, xp = (t[5 + i * d:5 + (i + 1) * d] for i in range(3))
        hu, hp = (t[5 + 3 * d + i * d * d:5 + 3 * d + (i + 1) * d * d].reshape(d, d) for i in range(2))
        ridge = RIDGE * np.diag(np.append(np.ones(d - 1), 0))
        if prior is None:
            grad = gu / nu + (gp_neg - xp) / np_ + ridge @ w
            curve = hu / nu + hp / np_ + ridge
            step = -np.linalg.solve(curve + 1e-9 * np.eye(d), grad)
        elif u_neg / nu - prior * p_neg / np_ >= 0:
            grad = gu / nu - prior * xp / np_ + ridge @ w
            step = -np.linalg.solve(hu / nu + ridge + 1e-9 * np.eye(d), grad)
        else:
            step = 0.5 * (gu / nu - prior * gp_neg / np_)
        size = np.linalg.norm(step)
        w = w + step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-4:
            break
    return w


def class_prior(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> float:
    """Share of positives among unlabelled rows: least ratio of upper score tails, first model and tails on different halves."""
    w = fit(rows, mean, scale, None, half=0, steps=6)

    def histogram(x, positive, which):
        score = _sigmoid(_with_bias(x, mean, scale) @ w)
        bin_ = np.minimum((score * BINS).astype(int), BINS - 1)
        test, pos = which == 1, positive.astype(bool)
        return np.concatenate((np.bincount(bin_[test], minlength=BINS), np.bincount(bin_[test & pos], minlength=BINS))).astype(float)

    t = _total(rows, histogram)
    tails = [np.cumsum(x[::-1]) for x in (t[:BINS], t[BINS:])]
    if not len(t) or min(x[-1] for x in tails) == 0:
        return 0.5
    (u, nu), (p, np_) = ((x / x[-1], x[-1]) for x in tails)
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(nu) + 1 / np.sqrt(np_))
    ok = p > 2 * margin
    if not ok.any():
        return 0.5
    best = np.argmin(np.where(ok, (u + margin) / np.where(ok, p, 1), np.inf))
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


class PuModel:
    """A fitted model: standardisation, weights, prior."""

    def __init__(self, mean, scale, weights, prior):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_with_bias(x, self.mean, self.scale) @ self.weights)

    def scored(self, featured: DataFrame) -> DataFrame:
        """(doc_id, score) of a feature table's rows."""
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                s = self.score(_matrix(b.column(1))) if b.num_rows else np.zeros(0)
                yield pa.record_batch([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])
        return featured.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


    def kept(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows of ``docs``, all columns unchanged, whose text scores 0.5 or more; no shuffle."""
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches(it):
                texts = text_bytes(b.column(b.schema.get_field_index(text_col)))
                good = self.score(np.array([features(x) for x in texts], dtype=np.float64)) >= 0.5 if texts else []
                yield b.filter(pa.array(good, pa.bool_()))
        small_batches(docs.sparkSession)
        return docs.mapInArrow(tidy(run), docs.schema)


def train(featured: DataFrame, positives: DataFrame) -> PuModel:
    """Fits on all rows of a feature table; ``positives`` holds the trusted ids (doc_id)."""
    marks = positives.select("doc_id").where("doc_id is not null").distinct().withColumn("positive", F.lit(True))
    rows = written(featured.join(marks, "doc_id", "left").select(
        "x", F.coalesce("positive", F.lit(False)).alias("positive"), F.pmod(F.xxhash64("doc_id", "x"), F.lit(2)).cast("int").alias("half")), "pu-rows")
    t = _total(rows, lambda x, *_: np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0))))
    if not len(t):
        return PuModel(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1), 0.5)
    mean = t[1:WIDTH + 1] / t[0]
    scale = np.sqrt(np.maximum(t[WIDTH + 1:] / t[0] - mean ** 2, 1e-8)) + 1e-3
    prior = class_prior(rows, mean, scale)
    weights = fit(rows, mean, scale, prior, half=None)
    discard(rows)
    return PuModel(mean, scale, weights, prior)


def fold(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def good_ids(labels: DataFrame) -> DataFrame:
    """Trusted positives: ids labelled good outside the held-out fold."""
    return labels.where((F.col("quality") == 1) & (fold(F.col("doc_id"), 3) != 1)).select(F.col("doc_id").cast("long").alias("doc_id"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, prior of every row; learns only from labels outside the held-out fold."""
    featured = written(feature_table(docs), "pu-features")
    model = train(featured, good_ids(labels))
    return model.scored(featured).select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
                                         (F.col("score") >= 0.5).cast("int").alias("predicted"), F.lit(model.prior).alias("prior"))


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
