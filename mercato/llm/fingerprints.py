"""Document fingerprints from content-defined chunks.

A text's UTF-8 bytes are split where a gear hash of the last 32 bytes meets a
mask.  Chunk lengths are normalised: before the aimed length a boundary must
meet the longer mask, after it the shorter one, with a least and a greatest
length.  The hash sees only the last 32 bytes, so boundaries fall on the same
content wherever it stands, and an insertion changes only the chunks around it.
The fingerprint is the set of the chunks' (digest, length); containment of one
text in another is the share of its chunk length whose digests the other has.

The gear hash is computed for all bytes of a text at once, by doubling the
window; texts are handled one at a time in pieces, so memory follows the
longest text only by its own bytes and chunk list.

The neighbour query needs each document beside the next by id.  Ids alone are
range-partitioned first; the smallest id of each range is all the driver sees
(one number per partition).  Texts are then dealt once, by range; the first row
of a range is dealt a second time, to the range before it.

Defined results: null text is empty.  Two empty texts are alike 1, an empty and
a non-empty one 0.  Null ids come first; rows that share an id are ordered by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mercato.llm.common import BASE, mix, partitions, table

LEAST, AIM, GREATEST = 16, 64, 256
LONG_MASK, SHORT_MASK = 0xFE000000, 0xF8000000  # 7 and 5 leading bits: one above and one below log2(AIM)
PIECE = 1 << 20
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE ^ 0x5DEECE66D)) >> np.uint64(32)).astype(np.uint32)


def gear(data: bytes, before: bytes = b"") -> np.ndarray:
    """Gear hash h = (h << 1) + G[byte] after each byte, over a window of 32 bytes; ``before`` precedes the data."""
    b = np.frombuffer(before[-31:] + data, dtype=np.uint8)
    h = _GEAR[b]
    for k in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint32(k)
        h = h + shifted
    return h[len(b) - len(data):]


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    n = len(data)
    if n == 0:
        return []
    hard, soft = [], []
    for at in range(0, n, PIECE):
        h = gear(data[at:at + PIECE], data[max(0, at - 31):at])
        easy = np.flatnonzero((h & np.uint32(SHORT_MASK)) == 0)
        soft.append(easy + (at + 1))
        hard.append(easy[(h[easy] & np.uint32(LONG_MASK)) == 0] + (at + 1))
    hard_list, soft_list = np.concatenate(hard).tolist(), np.concatenate(soft).tolist()
    ends, start, i, j = [], 0, 0, 0
    while n - start > LEAST:
        first, aim, last = start + LEAST, start + AIM, start + GREATEST
        while i < len(hard_list) and hard_list[i] < first:
            i += 1
        if i < len(hard_list) and hard_list[i] < aim and hard_list[i] <= n:
            end = hard_list[i]
        else:
            while j < len(soft_list) and soft_list[j] < aim:
                j += 1
            end = min(n, last, soft_list[j] if j < len(soft_list) else n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def fingerprint(data: bytes | None) -> dict[bytes, int]:
    """Chunk digests (8 bytes) of a text with their lengths."""
    data = data or b""
    out, start = {}, 0
    for end in boundaries(data):
        out[hashlib.blake2b(data[start:end], digest_size=8).digest()] = end - start
        start = end
    return out


def packed(chunks: dict[bytes, int]) -> str:
    """A fingerprint as text: sorted ``digest:length`` in hexadecimal, joined by blanks."""
    return " ".join(f"{d.hex()}:{n:x}" for d, n in sorted(chunks.items()))


def unpacked(text: str) -> dict[bytes, int]:
    return {bytes.fromhex(d): int(n, 16) for d, n in (x.split(":") for x in text.split())}


def containment(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Share of a's chunk length that b holds."""
    total = sum(a.values())
    if total == 0:
        return 1.0 if not b else 0.0
    return sum(n for d, n in a.items() if d in b) / total


def likeness(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """The lesser of the two containments: 1 for equal sets, near 0 for unrelated texts."""
    return min(containment(a, b), containment(b, a))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chunks, fingerprint of every row."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets = [fingerprint((x or "").encode()) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([packed(s) for s in sets], pa.string())],
                                  names=["doc_id", "n_chunks", "fingerprint"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_chunks long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many characters of the next one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _neighbours(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, copied, id, text): each document of a range with the one after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_id"]
    held, rows = None, []

    def result(a, b):
        changed = edited(a.text, b.text)
        marks = a.marks if changed == a.text else fingerprint(changed.encode())
        return (a.id, len(a.text), hashlib.sha256(changed.encode()).hexdigest(), packed(a.marks), packed(marks),
                likeness(a.marks, marks), likeness(a.marks, b.marks), b.id)

    def batch():
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    for b in it:
        for part, copied, doc, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            if copied and (held is None or held.part != part or held.copied):
                continue  # only the first copy follows the last row of its range
            now = SimpleNamespace(part=part, copied=copied, id=doc, text=text, marks=fingerprint(text.encode()))
            if held is not None and held.part == part and not held.copied:
                rows.append(result(held, now))
                if len(rows) >= 256:
                    yield batch()
                    rows = []
            held = now
    if rows:
        yield batch()


def next_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness and that to the next document.

    Next is the next row by id; the first row follows the last.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lows = (rows.where("doc_id is not null").select("doc_id").repartitionByRange(n, "doc_id")
            .groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low")).select("low").distinct())
    starts = np.array(sorted(r.low for r in lows.collect()), dtype=np.int64)  # at most one id per partition
    last = len(starts)  # ranges 1..last hold ids, range 0 the null ids

    @F.pandas_udf("long")
    def range_of(ids: pd.Series) -> pd.Series:
        out = np.searchsorted(starts, ids.fillna(0).to_numpy(dtype=np.int64), side="right")
        return pd.Series(np.where(ids.isna(), 0, out))

    @F.pandas_udf("boolean")
    def opens(ids: pd.Series) -> pd.Series:
        return pd.Series(np.isin(ids.fillna(0).to_numpy(dtype=np.int64), starts) & ~ids.isna().to_numpy())

    placed = rows.withColumn("part", range_of("doc_id"))
    # the first row of a range also closes the range before; the very first row closes the last range
    first_null = rows.where("doc_id is null").orderBy("text").limit(1).withColumn("part", F.lit(last).cast("long"))
    closes = F.when((F.col("part") == 1) & F.lit(first_null.isEmpty()), F.lit(last)).otherwise(F.col("part") - 1)
    copies = placed.where(opens("doc_id")).withColumn("part", closes).unionByName(first_null)
    both = placed.withColumn("copied", F.lit(False)).unionByName(copies.withColumn("copied", F.lit(True)))
    return (both.repartition(n, "part").select("part", "copied", "doc_id", "text").sortWithinPartitions("part", "copied", F.asc_nulls_first("doc_id"), "text")
            .mapInArrow(_neighbours, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
                                     " near_edited double, near_next double, next_id long"))


def op1_gear_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return next_fingerprints(table(spark, sf_dir, "documents"))
