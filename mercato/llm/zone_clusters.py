"""Centroid clustering over space-filling-curve zone maps.

Lloyd's rounds on integer vectors, exact throughout:

1.  The ``k`` starting centroids are the vectors whose ids hash lowest.  Their principal axes (a
    ``k`` x ``dims`` matrix on the driver) place every vector on a Hilbert curve of ``AXES`` axes and
    ``BITS`` bits each; the axes only decide which vectors lie together.
2.  Vectors are range-partitioned by their place on the curve (with a salt, so that copies of one
    vector are spread), sorted, and packed into blocks of ``BLOCK`` vectors.  A block keeps its
    min/max box, vector count and component sums: its zone map.  Blocks are written once.
3.  Each round streams the blocks.  For the centroid c nearest to the middle of a block's box, the
    largest value over the box of ``|x - c|^2 - |x - d|^2`` bounds every other centroid d from the box alone;
    where it is negative (or 0 and c has the smaller number) no vector of the block can choose d.
    What is left are the block's candidates.  A block with one candidate adds its stored sums;
    others compare each vector with the candidates in one matrix product.
4.  Per task and cluster one row of counts and sums leaves the task; Spark adds them up, and
    ``k`` x ``dims`` sums reach the driver, which takes the floor of the exact means.

Products run in floating point while all sums stay below 2**53 and are thus exact, else in 64-bit integers.

Defined results: vectors that are null, have another number of components, or hold a null, NaN
or infinite component are left out.  Components are floor(scale * x), x as double, held to
+-2**27, so that a squared distance fits 64 bits.  A null id is kept, and starts no centroid while
other vectors are left.  Repeated rows are rows; of equal ids the smaller vector starts first.
With fewer than ``k`` vectors each is a starting centroid.  A vector as near to two centroids
belongs to the smaller number; an empty centroid stays where it is.  An inertia that does not fit
64 bits is null.  An empty table gives no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mercato.llm.common import discard, mix, partitions, table, written

DIMS, SCALE, K, ROUNDS, SEED = 64, 256, 40, 5, 2
AXES, BITS, BLOCK = 8, 7, 256
LIMIT = 1 << 27


def hilbert_place(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (n x axes), ``bits`` bits an axis.

    Follows J. Skilling, Programming the Hilbert curve (2004): undo the excess rotations from the top bit
    down, then Gray-decode across the axes, and read the bits out plane by plane.
    """
    x = cells.astype(np.int64).copy()
    axes = x.shape[1]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(axes):
            high = (x[:, i] >> level) & 1 == 1
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn[:, None]
    place = np.zeros(len(x), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            place = (place << 1) | ((x[:, i] >> level) & 1)
    return place


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that a vector in the box may be nearest to (ties included as they count)."""
    twice_middle = low + high
    gap = np.abs(2 * centroids - twice_middle)
    c = int(np.argmin((gap.astype(np.float64) ** 2).sum(axis=1)))
    # |x-c|^2 - |x-d|^2 = |c|^2 - |d|^2 + 2 x (d - c), largest at a corner of the box
    apart = centroids - centroids[c]
    corner = np.where(apart > 0, high, low)
    most = ((centroids[c] - corner) ** 2 - (centroids - corner) ** 2).sum(axis=1)
    beaten = (most < 0) | ((most == 0) & (np.arange(len(centroids)) > c))
    beaten[c] = False
    return np.flatnonzero(~beaten)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector (ties: the smaller) and the squared distance, exact."""
    top = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    exact = vectors.shape[1] * (2 * top) ** 2 < 1 << 53
    x, c = (vectors.astype(np.float64), centroids.astype(np.float64)) if exact else (vectors, centroids)
    distance = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)
    chosen = distance.argmin(axis=1)
    return chosen, distance[np.arange(len(x)), chosen].astype(np.int64)


def _quantised(column: pa.ListArray, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that count, and their integer vectors."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=np.int64)
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (sizes == dims))
    at = column.offsets.to_numpy()[rows][:, None] + np.arange(dims) if len(rows) else np.zeros((0, dims), dtype=np.int64)
    values = column.values.cast(pa.float64())
    flat = values.to_numpy(zero_copy_only=False)  # nulls come as NaN
    x = flat[at] if len(rows) else np.zeros((0, dims))
    good = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(scale * x[good]), -LIMIT, LIMIT)
    return rows[good], whole.astype(np.int64)


def _quantise(dims: int, scale: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in it:
            rows, x = _quantised(b.column(1), dims, scale)
            ordinal = np.arange(seen, seen + len(rows), dtype=np.int64)
            seen += len(rows)
            salt = (mix(ordinal.view(np.uint64) + np.uint64(SEED)) >> np.uint64(1)).astype(np.int64)
            vec = pa.array(_bytes(x), pa.binary())
            yield pa.record_batch([b.column(0).take(pa.array(rows)), pa.array(salt), vec], names=["vec_id", "salt", "vec"])
    return run


def _bytes(x: np.ndarray) -> list[bytes]:
    """Rows as bytes that sort as their components do."""
    return [v.tobytes() for v in (x + (1 << 31)).astype(">u4")]


def _numbers(rows: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=">u4").reshape(-1, dims).astype(np.int64) - (1 << 31)


def _placed(dims: int, middle: np.ndarray, axes: np.ndarray, reach: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = _numbers(b.column(2).to_pylist(), dims)
            cells = np.floor(((x - middle) @ axes / reach + 1) * (1 << (BITS - 1)))
            place = hilbert_place(np.clip(cells, 0, (1 << BITS) - 1), BITS)
            yield pa.record_batch([*b.columns, pa.array(place)], names=["vec_id", "salt", "vec", "place"])
    return run


def _packed(dims: int, block: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held = [], []

        def packed():
            x = _numbers(held, dims)
            arrays = [x.min(axis=0), x.max(axis=0), x.sum(axis=0)]
            return pa.record_batch([pa.array([held_ids], pa.list_(pa.int64())), pa.array([b"".join(held)], pa.binary()),
                                    *(pa.array([a.tobytes()], pa.binary()) for a in arrays), pa.array([len(held)], pa.int64())],
                                   names=["ids", "vecs", "low", "high", "sums", "size"])
        for b in it:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held_ids.append(i)
                held.append(v)
                if len(held) == block:
                    yield packed()
                    held_ids, held = [], []
        if held:
            yield packed()
    return run


def zone_mapped(vectors: DataFrame, middle: np.ndarray, axes: np.ndarray, reach: np.ndarray, dims: int = DIMS, block: int = BLOCK) -> DataFrame:
    """Blocks (ids, vecs, low, high, sums, size) of quantised vectors (vec_id, salt, vec) in Hilbert order."""
    placed = vectors.mapInArrow(_placed(dims, middle, axes, reach), "vec_id long, salt long, vec binary, place long")
    return (placed.repartitionByRange(partitions(vectors.sparkSession), "place", "salt").sortWithinPartitions("place", "salt")
            .select("vec_id", "vec").mapInArrow(_packed(dims, block), "ids array<long>, vecs binary, low binary, high binary, sums binary, size long"))


def _box(b: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.int64) for x in b.column(b.schema.get_field_index(name)).to_pylist()]


def _sums(dims: int, centroids: np.ndarray):
    """Blocks -> per cluster the number and component sums of its vectors, and how many products were spared."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids), dtype=np.int64)
        total = np.zeros((len(centroids), dims), dtype=np.int64)
        compared = np.zeros(len(centroids), dtype=np.int64)
        for b in it:
            sizes = b.column(b.schema.get_field_index("size")).to_pylist()
            vecs = b.column(b.schema.get_field_index("vecs"))
            for i, (low, high, sums) in enumerate(zip(_box(b, "low"), _box(b, "high"), _box(b, "sums"))):
                some = candidates(low, high, centroids)
                if len(some) == 1:
                    count[some[0]] += sizes[i]
                    total[some[0]] += sums
                    continue
                compared[some] += sizes[i]
                x = _numbers([vecs[i].as_py()], dims)
                chosen = some[nearest(x, centroids[some])[0]]
                np.add.at(count, chosen, 1)
                np.add.at(total, chosen, x)
        used = np.flatnonzero((count > 0) | (compared > 0))
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(compared[used]),
                               pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "compared", "sums"])
    return run


def _assigned(dims: int, centroids: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, vecs = b.column(b.schema.get_field_index("ids")), b.column(b.schema.get_field_index("vecs"))
            for i, (low, high) in enumerate(zip(_box(b, "low"), _box(b, "high"))):
                some = candidates(low, high, centroids)
                chosen, distance = nearest(_numbers([vecs[i].as_py()], dims), centroids[some])
                yield pa.record_batch([ids.slice(i, 1).flatten(), pa.array(some[chosen].astype(np.int32)), pa.array(distance)],
                                      names=["vec_id", "cluster", "distance"])
    return run


def starting_centroids(vectors: DataFrame, k: int = K, seed: int = SEED, dims: int = DIMS) -> np.ndarray:
    """The k vectors whose ids hash lowest, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(key.alias("key"), "vec").orderBy(F.col("key").asc_nulls_last(), "vec").limit(k).collect()
    return _numbers([r.vec for r in first], dims)


def moved(centroids: np.ndarray, blocks: DataFrame) -> np.ndarray:
    """Centroids after one round: exact floors of the means, empty ones where they were."""
    dims = centroids.shape[1]
    parts = blocks.mapInArrow(_sums(dims, centroids), "cluster int, n long, compared long, sums array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims)))
    out = centroids.copy()
    for r in added.where("n > 0").collect():  # k rows at most
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dims)]
    return out


def zone_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS,
                  dims: int = DIMS, scale: float = SCALE, seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that counts, and the final centroids (k x dims)."""
    taken = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    whole = written(taken.mapInArrow(_quantise(dims, scale), "vec_id long, salt long, vec binary"), "zone-vectors")
    centroids = starting_centroids(whole, k, seed, dims)
    if not len(centroids):
        return whole.selectExpr("vec_id", "0 as cluster", "0L as distance").where("false"), centroids
    middle = centroids.mean(axis=0)
    _, _, axes = np.linalg.svd(centroids - middle, full_matrices=True)
    axes = axes[:min(AXES, dims)].T
    reach = np.maximum(np.abs((centroids - middle) @ axes).max(axis=0), 1.0) * 1.5
    blocks = written(zone_mapped(whole, middle, axes, reach, dims, block), "zone-blocks")
    for _ in range(rounds):
        centroids = moved(centroids, blocks)
    assigned = written(blocks.mapInArrow(_assigned(dims, centroids), "vec_id long, cluster int, distance long"), "zone-assigned")
    discard(whole, blocks)
    return assigned, centroids


def op11_zone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, squared distance, inertias and centroid hash of every vector."""
    assigned, centroids = zone_clusters(table(spark, sf_dir, "embeddings"))
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.cluster: int(r.inertia) for r in assigned.groupBy("cluster").agg(exact.alias("inertia")).collect()}  # k rows at most
    fits = lambda x: x if x < 1 << 63 else None
    rows = [(c, fits(inertia[c]), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
            for c in sorted(inertia)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """DuckDB: the same rounds, one common table expression a step."""
    steps = [f"""v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as x from embeddings
  where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMS}),
c0 as materialized (select row_number() over (order by sha256('{SEED}:' || vec_id) nulls last, x) - 1 as c, x from v order by c limit {K})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} as materialized (select r, any_value(v.x) as x, min_by(c, (d, c)) as c, min(d) as d from (
    select v.r, v.x, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v, c{i} c) v group by r)""")
        if i < ROUNDS:
            steps.append(f"""m{i + 1} as materialized (select c, pos, sum(y) as s, count(*) as n from (select c, unnest(x) as y, generate_subscripts(x, 1) as pos from a{i}) group by c, pos),
c{i + 1} as materialized (select c.c, coalesce(m.x, c.x) as x from c{i} c left join (
    select c, list(((s - ((s % n) + n) % n) // n)::bigint order by pos) as x from m{i + 1} group by c) m using (c))""")
    last = f"""f as (select c, sha256(array_to_string(x, ',')) as centroid_sha256 from c{ROUNDS})
select v.vec_id, a.c::int as cluster, a.d as distance, sum(a.d) over (partition by a.c)::bigint as cluster_inertia,
  sum(a.d) over ()::bigint as inertia, f.centroid_sha256
from a{ROUNDS} a join v using (r) join f using (c)"""
    return "with " + ",\n".join([*steps, last])


OP11_SQL = _sql()
