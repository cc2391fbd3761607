"""Shared helpers of the training-data operators: inputs, scratch tables, word hashing.

Words are the maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; that is
exactly what ``bytes.split()`` yields on UTF-8 text.  A word's hash is a
64-bit polynomial over random byte codes, normalised to its start, so the
hashes of all words (and of all word windows) come from prefix sums without a
Python loop.  Long texts are hashed in pieces cut at white space, so memory
does not grow with the text beyond the resulting 8 bytes a word.
"""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from mercato.session import ensure_checkpoint_dir

PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet below the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables that no remaining plan reads."""
    for t in tables:
        if path := getattr(t, "_written_at", None):  # set by written() alone
            folder = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts travel to Python in Arrow batches of 4 MB, not 10,000 rows of any length, unless the session says otherwise."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------ hashing
def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (shift-multiply rounds) over an array."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BASE = 0x9E3779B97F4A7C15 | 1
_CODES = mix(np.arange(1, 257, dtype=_U) * _U(BASE))
_IS_WORD = bytes(x not in b" \t\n\v\f\r" for x in range(256))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_CODES = _CODES[_LOWER]


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each; grown where used, never shipped."""

    up = down = np.ones(1, dtype=_U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            both = []
            for base in (BASE, pow(BASE, -1, 1 << 64)):
                p = np.full(size, base, dtype=_U)
                p[0] = 1
                both.append(np.cumprod(p, dtype=_U))
            self.up, self.down = both
        return self.up, self.down

    def __getstate__(self):
        return {}

    def __setstate__(self, state):
        pass


powers = _Powers()


def _pieces(data: bytes) -> Iterator[bytes]:
    at, n = 0, len(data)
    while at < n:
        end = at + PIECE
        if end < n:
            found = _SPACE.search(data, end)
            end = found.start() if found else n
        yield data[at:end]
        at = end


def word_hashes(data: bytes, lower: bool = False) -> np.ndarray:
    """One 64-bit hash per word of UTF-8 ``data``; ``lower`` folds A-Z only."""
    return words_of(data, lower)[0]


def words_of(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes``, and each word's bytes."""
    out, sizes = [], []
    codes = _LOWER_CODES if lower else _CODES
    for piece in _pieces(data):
        b = np.frombuffer(piece, dtype=np.uint8)
        inside = np.frombuffer(b"".join((b"\0", piece.translate(_IS_WORD), b"\0")), dtype=bool)
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            up, down = powers(len(b) + 1)
            c = np.zeros(len(b) + 1, dtype=_U)
            np.cumsum(codes.take(b) * up[:len(b)], out=c[1:])
            out.append(mix((c[ends] - c[starts]) * down[starts]))
            sizes.append(ends - starts)
    return (np.concatenate(out), np.concatenate(sizes)) if out else (np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64))


def window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words (empty if there are fewer)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    up, down = powers(len(words) + 1)
    c = np.zeros(len(words) + 1, dtype=_U)
    np.cumsum(words * up[:len(words)], out=c[1:])
    return mix(((c[width:] - c[:n]) * down[:n]) ^ _U(salt))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def release() -> None:
    """Hands memory that is free in this process back to the system; workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function over record batches that releases memory when its task ends."""
    def inner(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(it)
        finally:
            release()
    return inner


def batches(df_batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so that scratch arrays stay small."""
    for b in df_batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
