"""Exact counts of items that occur together in an order.

Transactions are (order, item hash) rows.  They are dealt to tasks by order and sorted, and each task
streams its orders through a sparse accumulator: pairs (or trios) of many orders are generated in
numpy a few million at a time, counted by value, and handed on as (a, b, count).  Spark adds these up
before and after the shuffle, so the shuffle carries distinct pairs, not occurrences.

An order with more than ``SPLIT`` items is dealt as several units: unit p counts the pairs (trios)
whose first item hashes to p, so an order of any size is shared by many tasks.

Trios are counted only where all three pairs are frequent (a trio is at most as frequent as each of
its pairs).  The frequent pairs reach the tasks as a bitmap of ``2**BITS`` hashed positions (8 MB
whatever the data); a position two pairs share costs work, not correctness, because the
threshold is applied to the exact counts.

Items are told apart by 64-bit hashes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# the sweep's functions travel to executors by value: they need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT = 2048  # items of an order above which it is dealt as several units
CHUNK = 1 << 22  # pairs or trios generated at once
BITS = 26


def transactions(items: DataFrame) -> DataFrame:
    """(order_id, item) -> (order_id, h) with the hash that stands for the item."""
    return items.select("order_id", F.xxhash64("item").alias("h"))


def item_counts(items: DataFrame) -> DataFrame:
    """(item, h, freq): in how many orders each item occurs."""
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("freq")).withColumn("h", F.xxhash64("item"))


def _units(rows: DataFrame) -> DataFrame:
    """Rows dealt to tasks by order, those of large orders once for each of the order's units."""
    large = (rows.groupBy("order_id").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > SPLIT)
             .select("order_id", F.ceil(F.col("_k") / SPLIT).cast("int").alias("parts")))
    dealt = (rows.join(large, "order_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "order_id", "part").sortWithinPartitions("order_id", "part", "h").select("order_id", "part", "parts", "h")


def _later(first: np.ndarray, end: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with j from first[i] to end[i] - 1 for every i, at most about ``limit`` at a time."""
    size = np.maximum(end - first, 0)
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
        k = size[at:to]
        i = np.repeat(np.arange(at, to), k)
        yield i, first[i] + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        at = to


def _streamed(it: Iterator[pa.RecordBatch], rows_at_once: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole units: (hashes, end of the row's unit, whether the row may come first in a pair of its unit)."""
    def flush(held):
        order, part, parts, h = (np.concatenate(x) for x in zip(*held))
        new = np.ones(len(h), dtype=bool)
        new[1:] = (order[1:] != order[:-1]) | (part[1:] != part[:-1])
        unit = np.cumsum(new) - 1
        end = np.append(np.flatnonzero(new)[1:], len(h))[unit]
        return h, end, h.view(np.uint64) % parts.astype(np.uint64) == part.astype(np.uint64)

    held, n, key = [], 0, None
    for b in it:
        order = b.column(0).to_numpy(zero_copy_only=False)
        part, parts, h = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        if not len(h):
            continue
        if n > rows_at_once:  # cut where the unit that is being read ends
            same = (order == key[0]) & (part == key[1])
            cut = len(h) if same.all() else int(np.argmin(same))
            held.append((order[:cut], part[:cut], parts[:cut], h[:cut]))
            if cut == len(h):
                continue
            yield flush(held)
            order, part, parts, h = order[cut:], part[cut:], parts[cut:], h[cut:]
            held, n = [], 0
        held.append((order, part, parts, h))
        n += len(h)
        key = (order[-1], part[-1])
    if held:
        yield flush(held)


def _counted(*sides: np.ndarray) -> pa.RecordBatch:
    """Distinct rows of parallel hash columns with their number, hashes of a row in ascending order."""
    values, codes = np.unique(np.concatenate(sides), return_inverse=True)
    codes = codes.reshape(len(sides), -1)  # sorted like the hashes; sides come in ascending order already
    if len(values) ** len(sides) < 1 << 62:
        key = codes[0].astype(np.int64)
        for c in codes[1:]:
            key = key * len(values) + c
        key, count = np.unique(key, return_counts=True)
        found = [key // len(values) ** i % len(values) for i in reversed(range(len(sides)))]
    else:
        found, count = np.unique(codes, axis=1, return_counts=True)
    return pa.record_batch([*(pa.array(values[c]) for c in found), pa.array(count.astype(np.int64))], names=["a", "b", "c"][:len(sides)] + ["n"])


def _pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for h, end, leads in _streamed(it):
        rows = np.flatnonzero(leads)
        for i, j in _later(rows + 1, end[rows], CHUNK):
            if len(i):
                yield _counted(h[rows[i]], h[j])


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, count) with a < b over the hashes of (order_id, h) rows, each distinct in its order."""
    part = _units(rows).mapInArrow(_pairs, "a long, b long, n long")
    return part.groupBy("a", "b").agg(F.sum("n").alias("count"))


def _position(a, b):
    """Where a pair of hashes stands in the bitmap."""
    return (a ^ (b >> np.int64(13))) & np.int64((1 << BITS) - 1)


def _bitmap(pairs: DataFrame) -> np.ndarray:
    """The positions of the pairs, one bit each: 2**BITS bits, whatever their number."""
    at = F.col("a").bitwiseXOR(F.shiftright("b", 13)).bitwiseAND(F.lit((1 << BITS) - 1)) + 1
    slices = (pairs.select(at.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")))
    out = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for r in slices.collect():  # at most 2**BITS / 32768 rows of 4 KB
        out[(r.bucket - 1) * 4096:r.bucket * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def _trios(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def frequent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            p = _position(a, b)
            return (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1

        for h, end, leads in _streamed(it):
            rows = np.flatnonzero(leads)
            for i, j in _later(rows + 1, end[rows], CHUNK):
                good = frequent(h[rows[i]], h[j])
                i, j = i[good], j[good]  # the later partners of each leading row, in order
                stop = np.searchsorted(i, i, side="right")
                for x, y in _later(np.arange(1, len(i) + 1), stop, CHUNK):
                    ok = frequent(h[j[x]], h[j[y]])
                    if ok.any():
                        x, y = x[ok], y[ok]
                        yield _counted(h[rows[i[x]]], h[j[x]], h[j[y]])
    return run


def trio_counts(rows: DataFrame, frequent_pairs: DataFrame) -> DataFrame:
    """(a, b, c, count) with a < b < c for trios whose pairs are all among ``frequent_pairs`` (a, b); a few more may come."""
    bits = rows.sparkSession.sparkContext.broadcast(_bitmap(frequent_pairs))
    part = _units(rows).mapInArrow(_trios(bits), "a long, b long, c long, n long")
    return part.groupBy("a", "b", "c").agg(F.sum("n").alias("count"))
