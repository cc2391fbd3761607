"""N-gram Jaccard join by blocked sparse products of the document x n-gram incidence matrix.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of
distinct ``width``-word shingles.  The join is exact (up to 64-bit shingle
hashes) and never forms the full product:

1.  One pass hashes every text and returns set sizes, a 128-bit set signature
    (equal sets collapse to their smallest id) and a count sketch of the
    document frequencies (``2**sketch_bits`` counters; its size is a parameter).
2.  The sketch fixes one global order of shingles, rare first.  Linked sets
    must share a shingle among the first ``n - ceil(t n) + 1`` of each, so only
    that part of the incidence matrix is formed.  It is dealt to tasks in
    column blocks (by shingle; columns the sketch shows to be dense are salted
    by row into sub-columns of about ``dense`` rows).  Sorted column blocks
    stream through a task: memory does not grow with a column.
3.  Linked sets overlap in ``need = ceil(t / (1 + t) * (|A| + |B|))`` shingles or
    more.  The first shingle they share, at places i and j of the order, leaves
    room for ``min(|A| - i, |B| - j)``, so a product cell counts only if both
    places leave room for ``need``.  Cells whose column holds no partner of such a
    size are dropped where the column streams by.
4.  A column pairs its members with one pivot, its smallest document.  Cells are accumulated per
    (pivot, document), before and after the shuffle; each document is first multiplied with the
    pivot it shares most columns with.
5.  A product delivers the texts of the asked pairs, blocks of members with their pivot, and counts
    overlaps block by block of the columns (ranges of shingle hashes): after each, pairs whose
    count and whatever either set has left stay below ``need`` are discarded.  Texts that no pair asks
    for are left out before the shuffle by a bitmap of hashed ids (its size is fixed; a hash that two
    ids share costs a row's shuffle, not correctness).
6.  Links found this way give components.  Columns that still hold several components are opened again:
    their other rows first meet a few more pivots of the column's largest component, then
    a last product takes the rows still outside it with all others, and the two rows of every
    column of two that lie in different components and have not been multiplied.  Documents
    already connected are not paired again, so a group of thousands of near copies
    costs a few stars and not a square, and no link between components is lost.

Parameters that change the layout of the work and no result: ``sketch_bits``, ``dense``, ``PIVOTS`` and ``ROUNDS``
(pivots and rounds of step 6), ``HOLD`` (rows of a column that are weighed together), ``MEMBERS`` (members of
a block), ``ASKED_BITS`` (the bitmap), ``COLUMN_BLOCKS``.

Defined results: a null or blank text has an empty set, size 0, and links with
nothing (its component is itself).  A text of fewer than ``width`` words is one
shingle.  Rows that share an id are one node.  A null id gets a null component
and takes no part.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mercato.llm.common import batches, discard, mix, partitions, small_batches, table, text_bytes, tidy, window_hashes, word_hashes, written
from mercato.llm.components import stars

WIDTH = 5
PERCENT = 75
SKETCH_BITS = 21
DENSE = 1024
PIVOTS, ROUNDS = 16, 1
HOLD = 20_000
MEMBERS = 512
ASKED_BITS = 25
COLUMN_BLOCKS = 4
_SLICE = 1 << 16
_U = np.uint64


def shingle_set(data: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; A-Z fold to lower case."""
    words = word_hashes(data or b"", lower=True)
    if len(words) == 0:
        return words
    if len(words) < width:
        return window_hashes(words, len(words), salt=len(words))
    h = np.sort(window_hashes(words, width))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def _signature(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(np.sum(mix(s ^ _U(c)), dtype=_U).astype(np.int64)) for c in (0x51, 0xA7F3))


def _packed(counts: np.ndarray) -> bytes:
    """A slice of the sketch: how many counters are not zero and, where they are few, these alone; else 0 and all counters."""
    some = np.flatnonzero(counts)
    if 2 * len(some) < len(counts):
        return np.concatenate(([len(some)], some, counts[some])).astype(np.uint32).tobytes()
    return np.concatenate(([0], counts)).astype(np.uint32).tobytes()


def _added(total: np.ndarray, packed: bytes) -> None:
    x = np.frombuffer(packed, dtype=np.uint32)
    n = int(x[0])
    if n:
        total[x[1:n + 1]] += x[n + 1:]
    else:
        total += x[1:]


def _sizes_and_sketch(width: int, bits: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "h1", "h2", "slice", "counts"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        sketch = np.zeros(1 << bits, dtype=np.uint32)
        mask = _U((1 << bits) - 1)
        any_rows = False
        for b in batches(it):
            rows = []
            for text in text_bytes(b.column(1)):
                s = shingle_set(text, width)
                np.add.at(sketch, (s & mask).astype(np.int64), np.uint32(1))  # of the sketch's own type: numpy adds it unconverted
                rows.append((len(s), *_signature(s)))
            any_rows = any_rows or bool(rows)
            n, h1, h2 = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else ([], [], [])
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                                   pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        if any_rows:
            step = min(_SLICE, 1 << bits)
            for i in range(0, 1 << bits, step):
                part = sketch[i:i + step]
                if part.any():
                    yield pa.record_batch([pa.array([v], t) for v, t in zip(
                        (None, None, None, None, i // step, _packed(part)), types)], names=names)
    return run


def _sum_slices(size: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(size, dtype=np.uint64)

        def out():
            counts = np.minimum(total, 2**32 - 1).astype(np.uint32)
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([counts.tobytes()])], names=["slice", "counts"])
        for b in it:
            for k, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != now:
                    if now is not None:
                        yield out()
                    now, total = k, np.zeros(size, dtype=np.uint64)
                _added(total, counts)
        if now is not None:
            yield out()
    return run


def _gathered_sketch(parts: DataFrame, bits: int) -> np.ndarray:
    """The summed sketch: 2**bits counters of 4 bytes, whatever the input's size."""
    out = np.zeros(1 << bits, dtype=np.uint32)
    step = min(_SLICE, 1 << bits)
    summed = (parts.repartition(max(1, (1 << bits) // step), "slice").sortWithinPartitions("slice")
              .mapInArrow(_sum_slices(step), "slice int, counts binary"))
    for row in summed.collect():
        out[row.slice * step:(row.slice + 1) * step] = np.frombuffer(row.counts, dtype=np.uint32)
    return out


def _ranks(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Place of each shingle in the global order: sketched count, then hash."""
    counts = sketch[(s & _U(len(sketch) - 1)).astype(np.int64)].astype(_U)
    return (counts << _U(32)) | (s >> _U(32))


def prefix(s: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles, up to the place in the order that linked sets must share, and their places."""
    if len(s) == 0:
        return s, np.zeros(0, dtype=np.int32)
    ranks = _ranks(s, sketch)
    k = len(s) - -(-percent * len(s) // 100)
    chosen = np.flatnonzero(ranks <= np.partition(ranks, k)[k])
    chosen = chosen[np.argsort(ranks[chosen], kind="stable")]
    r = ranks[chosen]
    return s[chosen], np.searchsorted(r, r, side="left").astype(np.int32)


def _prefix_rows(width: int, percent: int, dense: int, shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        usual = int(sketch.mean())
        for b in batches(it, 1024):
            seen, out = set(), [[], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                s = shingle_set(text, width)
                if doc is None or len(s) == 0 or (key := (len(s), *_signature(s))) in seen:
                    continue  # an equal set of this batch stands for it; step 1 has linked them
                seen.add(key)
                p, place = prefix(s, sketch, percent)
                over = sketch[(p & _U(len(sketch) - 1)).astype(np.int64)].astype(np.int64) - usual
                deal = int(mix(np.array([doc], dtype=np.int64).view(_U))[0] >> _U(1))
                for x, v in zip(out, (p.view(np.int64), np.where(over >= dense, deal % np.maximum(1, over // dense), -1).astype(np.int32),
                                      np.full(len(p), doc, dtype=np.int64), (len(s) << 32) + place.astype(np.int64))):
                    x.append(v)
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], names=["s", "salt", "doc", "n_place"])
    return run


_COLUMN = "s long, salted boolean, pair boolean, doc long, n int, place int, pivot long, pivot_n int, pivot_place int"


def _need(a, b, percent: int):
    """Overlap that sets of these sizes need."""
    return -(-percent * (a + b) // (100 + percent))


def _columns(percent: int, hold: int = HOLD):
    """Rows of sorted columns -> members of columns that can hold a link, with the column's pivot.

    Whole columns are weighed as they stream by; a column of more than ``hold`` rows is passed on as it is.
    """
    def out(cols, pivot_at, keep, pair):
        s, salt, doc, n, place = (c[keep] for c in cols)
        at = pivot_at[keep]
        return pa.record_batch([pa.array(x) for x in (s, salt >= 0, pair, doc, n, place, cols[2][at], cols[3][at], cols[4][at])],
                               names=["s", "salted", "pair", "doc", "n", "place", "pivot", "pivot_n", "pivot_place"])

    def weighed(cols):
        s, salt, doc, n, place = cols
        def groups(mask):
            i = np.flatnonzero(mask)
            new = np.ones(len(i), dtype=bool)
            new[1:] = (s[i[1:]] != s[i[:-1]]) | (salt[i[1:]] != salt[i[:-1]])
            return i, new, np.cumsum(new) - 1
        twice = np.zeros(len(s), dtype=bool)
        twice[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in cols])  # an id's other texts stand for themselves
        i, new, g = groups(~twice)
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(i)))
        n64, at64 = n[i].astype(np.int64), place[i].astype(np.int64)
        largest = np.minimum((n64 - at64) * (100 + percent) // percent - n64, n64 * 100 // percent)
        ok = (size[g] > 1) & (largest >= np.minimum.reduceat(n64, starts)[g])
        two = starts[size == 2]
        need = _need(n64[two], n64[two + 1], percent)
        fit = ((n64[two] - at64[two] >= need) & (n64[two + 1] - at64[two + 1] >= need)
               & (100 * np.minimum(n64[two], n64[two + 1]) >= percent * np.maximum(n64[two], n64[two + 1])))
        ok[two], ok[two + 1] = fit, fit
        keep = np.zeros(len(s), dtype=bool)
        keep[i] = ok | (salt[i] >= 0)
        i, new, g = groups(keep)
        if not len(i):
            return None
        size = np.diff(np.append(np.flatnonzero(new), len(i)))
        good = (size[g] > 1) | (salt[i] >= 0)
        pivot_at = np.zeros(len(s), dtype=np.int64)
        pivot_at[i] = i[np.flatnonzero(new)][g]
        pair = (size[g] == 2) & (salt[i] < 0)  # a column of two holds one pair, its pivot and the other row
        return out(cols, pivot_at, i[good], pair[good]) if good.any() else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long = None, None  # rows of the last column; or key and pivot row of a column too long to hold
        for b in it:
            if b.num_rows == 0:
                continue
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cols[3:] = (cols[3] >> 32).astype(np.int32), (cols[3] & 0xFFFFFFFF).astype(np.int32)
            if long is not None:
                same = (cols[0] == long[0]) & (cols[1] == long[1])
                k = len(same) if same.all() else int(np.argmin(same))
                if k:
                    joined = [np.concatenate(([p], c[:k])) for p, c in zip(long, cols)]
                    yield out(joined, np.zeros(k + 1, dtype=np.int64), np.arange(1, k + 1), np.zeros(k, dtype=bool))
                cols = [c[k:] for c in cols]
                if not len(cols[0]):
                    continue
                long = None
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            split = int(last[-1]) + 1 if len(last) else 0
            held = [c[split:] for c in cols]
            if split and (done := weighed([c[:split] for c in cols])) is not None:
                yield done
            if len(held[0]) > hold:
                yield out(held, np.zeros(len(held[0]), dtype=np.int64), np.arange(len(held[0])), np.zeros(len(held[0]), dtype=bool))
                long, held = [c[0] for c in held], None
        if held is not None and (done := weighed(held)) is not None:
            yield done
    return run


def _asked_for(bits: np.ndarray):
    """Texts whose hashed id is marked in the bitmap."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = bits.value
        for b in it:
            at = b.column(2).to_numpy(zero_copy_only=False)
            keep = (marked[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            if keep.any():
                yield b.filter(pa.array(keep)).select([0, 1])
    return run


def overlaps(pivot: np.ndarray, members: list[np.ndarray], percent: int) -> np.ndarray:
    """Intersection sizes of the members with the pivot, -1 where a pair was discarded.

    Sets are sorted; the blocks of columns are ranges of the shingles' hashes.
    """
    size = np.array([len(m) for m in members], dtype=np.int64)
    need = _need(size, len(pivot), percent)
    alive = np.flatnonzero(100 * np.minimum(size, len(pivot)) >= percent * np.maximum(size, len(pivot)))
    out = np.full(len(members), -1, dtype=np.int64)
    found = np.zeros(len(members), dtype=np.int64)
    edges = np.array([i * (2 ** 64 // COLUMN_BLOCKS) for i in range(1, COLUMN_BLOCKS)], dtype=_U)
    cuts = {i: np.concatenate(([0], np.searchsorted(members[i], edges), [len(members[i])])) for i in alive.tolist()}
    own = np.concatenate(([0], np.searchsorted(pivot, edges), [len(pivot)]))
    for c in range(COLUMN_BLOCKS):
        if not len(alive):
            break
        column = pivot[own[c]:own[c + 1]]
        parts = [members[i][cuts[i][c]:cuts[i][c + 1]] for i in alive.tolist()]
        if len(column):
            flat = np.concatenate(parts)
            hit = column[np.minimum(np.searchsorted(column, flat), len(column) - 1)] == flat
            owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            found[alive] += np.bincount(owner[hit], minlength=len(parts))
        left = np.minimum(size[alive] - [cuts[i][c + 1] for i in alive.tolist()], len(pivot) - own[c + 1])
        alive = alive[found[alive] + left >= need[alive]]
    out[alive] = found[alive]
    return out


def _products(width: int, percent: int):
    """Streams (block, pivot, members...) of texts and multiplies the members of each block with its pivot."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pivots, members, held = None, [], [], 0

        def multiplied():
            rows = []
            for pivot in pivots:
                for (_, d, s), n in zip(members, overlaps(pivot, [m[2] for m in members], percent).tolist()):
                    if n > 0 and 100 * n >= percent * (len(s) + len(pivot) - n):
                        rows.append((block[0], d, n))
            if rows:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], names=["a", "b", "overlap"])
        for b in batches(it):
            for x, k, d, is_member, text in zip(*(b.column(i).to_pylist() for i in range(4)), text_bytes(b.column(4))):
                if (x, k) != block or held > 1 << 20:
                    yield from multiplied()
                    members, held = [], 0
                    if (x, k) != block:
                        block, pivots = (x, k), []
                s = shingle_set(text, width)
                if is_member:
                    members.append((x, d, s))
                    held += len(s)
                else:
                    pivots.append(s)
        if members:
            yield from multiplied()
    return run


def _multiply(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among ``pairs`` (a, b): blocks of about ``MEMBERS`` documents b times one pivot a."""
    spark = pairs.sparkSession
    sized = pairs.groupBy("a").agg(F.count("*").alias("of"))
    blocks = (pairs.join(sized, "a")
              .withColumn("part", F.expr(f"cast(pmod(xxhash64(b), (of div {MEMBERS}) + 1) as int)")).select("a", "b", "part"))
    each = sized.withColumn("part", F.explode(F.expr(f"sequence(0, cast(of div {MEMBERS} as int))")))  # the pivot of every block
    asked = blocks.select("a", "part", F.col("b").alias("doc"), F.lit(True).alias("member")).unionByName(
        each.select("a", "part", F.col("a").alias("doc"), F.lit(False).alias("member")))

    def place(doc: str):
        return F.pmod(F.xxhash64(doc), F.lit(1 << ASKED_BITS))
    marks = pairs.select(F.explode(F.array("a", "b")).alias("doc")).select((place("doc") + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros(1 << (ASKED_BITS - 3), dtype=np.uint8)
    for r in marks.collect():  # at most 2**ASKED_BITS bits, in slices of 4 KB
        bits[(r.bucket - 1) * 4096:r.bucket * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    shared = spark.sparkContext.broadcast(bits)
    wanted = texts.select("doc_id", "text", place("doc_id").alias("p")).mapInArrow(tidy(_asked_for(shared)), "doc long, text string")
    dealt = wanted.join(asked.hint("shuffle_hash"), "doc").select("a", "part", "doc", "member", "text")
    links = written(dealt.repartition(partitions(spark), "a", "part").sortWithinPartitions("a", "part", "member")
                    .mapInArrow(tidy(_products(width, percent)), "a long, b long, overlap long"), "shingle-links")
    shared.destroy()
    return links


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                       percent: int = PERCENT, sketch_bits: int = SKETCH_BITS, dense: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, n_shingles, component_id), one row per input row, and the verified links (a, b, overlap).

    Links are those the method had to verify: a spanning part of every component, with no link left out
    between documents that are not otherwise connected.  ``overlap`` is the exact intersection size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = written(texts.mapInArrow(tidy(_sizes_and_sketch(width, sketch_bits)),
                                     "doc_id long, n long, h1 long, h2 long, slice int, counts binary"), "shingle-sizes")
    sizes = first.where("slice is null").select("doc_id", "n", "h1", "h2")
    sketch = spark.sparkContext.broadcast(_gathered_sketch(first.where("slice is not null").select("slice", "counts"), sketch_bits))

    sets = sizes.where("n > 0 and doc_id is not null")
    smallest = sets.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
    copies = written(sets.join(smallest, ["h1", "h2", "n"]).select("doc_id", "rep").distinct(), "shingle-copies")

    known = texts.where("doc_id is not null")
    cells = known.mapInArrow(tidy(_prefix_rows(width, percent, dense, sketch)),
                                                         "s long, salt int, doc long, n_place long")
    columns = written(cells.repartition(partitions(spark), "s", "salt").sortWithinPartitions("s", "salt", "doc", "n_place")
                      .mapInArrow(tidy(_columns(percent)), _COLUMN), "shingle-columns")
    as_rep = copies.toDF("doc", "rep")
    members = columns.where("not pair").join(as_rep, "doc").select("s", F.col("rep").alias("doc"), "n", "place")

    # first product: every document with the pivot of most of its columns; pivots of one column's salted parts with each other
    def room(n: str, place: str, n2: str, place2: str) -> str:
        need = f"(({percent} * ({n} + {n2}) + {99 + percent}) div {100 + percent})"
        return (f"{n} - {place} >= {need} and {n2} - {place2} >= {need}"
                f" and 100 * least({n}, {n2}) >= {percent} * greatest({n}, {n2})")
    heads = columns.where("salted").select("s", "pivot").distinct()
    joined = heads.join(heads.groupBy("s").agg(F.min("pivot").alias("a")), "s").select("a", F.col("pivot").alias("b"))
    counted = (columns.where(room("n", "place", "pivot_n", "pivot_place")).groupBy(F.col("pivot").alias("a"), F.col("doc").alias("b"))
               .agg(F.count("*").alias("cells"), F.max("pair").alias("pair"))
               .unionByName(joined.withColumn("cells", F.lit(1).cast("long")).withColumn("pair", F.lit(False))).where("a <> b"))
    counted = written(counted.join(as_rep.toDF("a", "ra"), "a").join(as_rep.toDF("b", "rb"), "b").where("ra <> rb")
                      .groupBy(F.col("rb").alias("b"), F.col("ra").alias("a"))
                      .agg(F.sum("cells").alias("cells"), F.max("pair").alias("pair")), "shingle-counted")
    star = counted.groupBy("b").agg(F.max_by("a", F.struct("cells", -F.col("a"))).alias("a"))
    star = written(star.select("a", "b"), "shingle-pairs")
    links = _multiply(star, known, width, percent)

    # columns that hold several components: their other rows with a few pivots of the largest one
    def open_columns(rows: DataFrame, linked: DataFrame) -> DataFrame:
        cells = rows.join(linked.select(F.col("u").alias("doc"), F.col("v").alias("component")), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        parts = cells.groupBy("s", "component").agg(F.count("*").alias("k"))
        mixed = (parts.groupBy("s").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("k", "component")).alias("major"))
                 .where("parts > 1").select("s", "major"))
        return written(cells.join(mixed, "s").select("s", "doc", "n", "place", "component",
                                                     (F.col("component") == F.col("major")).alias("is_major")), "shingle-open")

    def pairs_of(minor: DataFrame, other: DataFrame) -> DataFrame:
        minor, other = minor.toDF("s", "x", "nx", "px", "cx", "mx").drop("mx"), other.toDF("s", "y", "ny", "py", "cy", "major")
        met = minor.join(other, "s").where("cx <> cy and (major or x < y)").where(room("nx", "px", "ny", "py"))
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
        return written(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "shingle-pairs")

    # columns of two: a document met one of its pivots only, the others still have to be asked where they lie apart
    def apart(linked: DataFrame) -> DataFrame:
        twos = counted.where("pair").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return (twos.join(linked.select(F.col("u").alias("a"), F.col("v").alias("ca")), "a", "left")
                .join(linked.select(F.col("u").alias("b"), F.col("v").alias("cb")), "b", "left")
                .where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b"))

    tried, used = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), [columns, star, copies, counted]
    linked, still_open = stars(links), members
    used.append(linked)
    for turn in range(ROUNDS):
        cells = open_columns(still_open, linked)
        nth = F.row_number().over(Window.partitionBy("s").orderBy("place", F.xxhash64(F.lit(turn), "doc")))
        picked = cells.where("is_major").withColumn("nth", nth).where(f"nth <= {PIVOTS}").drop("nth")
        new = untried(pairs_of(cells.where("not is_major"), picked), tried)
        if not new.isEmpty():
            found = _multiply(new, known, width, percent)
            links, linked = links.unionByName(found), stars(linked.select("u", "v").union(found.select("a", "b")), "u", "v")
            used.append(linked)
        tried, still_open = tried.unionByName(new), cells.select("s", "doc", "n", "place")  # a column of one component stays one
        used += [cells, new]

    # last product: what is still apart, each row outside a column's largest component with all others
    cells = open_columns(still_open, linked)
    last = untried(pairs_of(cells.where("not is_major"), cells).unionByName(apart(linked)), tried)
    edges = linked.select("u", "v").union(copies.select("doc_id", "rep"))
    if not last.isEmpty():
        found = _multiply(last, known, width, percent)
        links, edges = links.unionByName(found), edges.union(found.select("a", "b"))

    final = stars(edges, "u", "v")
    discard(*used, cells, last)  # the results read only set sizes, links and components
    sketch.destroy()
    out = (sizes.join(final.select(F.col("u").alias("doc_id"), F.col("v").alias("component")), "doc_id", "left")
           .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))
    return out, links


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))[0]
