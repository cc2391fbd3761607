"""Zone-map clustering against plain Lloyd rounds and SQL."""
import hashlib
import itertools

import duckdb
import numpy as np
import pytest

from mercato.llm import registry, zone_clusters as z

SF = "/root/testdata/sf0.001"


def plain(rows, k, rounds, dims, scale=256):
    """Lloyd's rounds in Python integers: {row number: (cluster, distance)} and centroids."""
    kept = [(r, i, [int(np.floor(scale * float(c))) for c in v]) for r, (i, v) in enumerate(rows)
            if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    key = lambda t: (t[1] is None, hashlib.sha256(f"2:{t[1]}".encode()).hexdigest(), t[2])
    centroids = [t[2] for t in sorted(kept, key=key)[:k]]
    for turn in range(rounds + 1):
        chosen = {r: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for r, _, v in kept}
        if turn < rounds:
            for n in range(len(centroids)):
                mine = [v for r, _, v in kept if chosen[r][1] == n]
                if mine:
                    centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((str(i), chosen[r][1], chosen[r][0]) for r, i, _ in kept), centroids


def test_hilbert_steps():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    place = z.hilbert_place(cells, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_every_choice():
    rnd = np.random.default_rng(3)
    spared = 0
    for _ in range(300):
        centroids = rnd.integers(-20, 20, (7, 3))
        middle = rnd.integers(-20, 20, 3)
        x = middle + rnd.integers(-3, 4, (40, 3))
        some = z.candidates(x.min(axis=0), x.max(axis=0), centroids)
        chosen, distance = z.nearest(x, centroids)
        assert set(chosen) <= set(some)
        again, same = z.nearest(x, centroids[some])
        assert (some[again] == chosen).all() and (same == distance).all()
        spared += 7 - len(some)
    assert spared > 300


@pytest.mark.parametrize("top", [1000, z.LIMIT])
def test_distances_are_exact(top):
    rnd = np.random.default_rng(4)
    x, c = rnd.integers(-top, top + 1, (50, 64)), rnd.integers(-top, top + 1, (9, 64))
    chosen, distance = z.nearest(x, c)
    for v, n, d in zip(x.tolist(), chosen, distance):
        assert (d, n) == min((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, w in enumerate(c.tolist()))


def clustered(n, dims=4):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(6, dims))
    return [(i, (centres[i % 6] + rnd.normal(size=dims) / 20).astype(np.float32).tolist()) for i in range(n)]


def test_against_plain_rounds(spark):
    rows = clustered(400)
    rows += [(7, rows[7][1])] * 3 + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(500, 560)]  # repeated rows, copies of one vector
    rows += [(9, [-0.25, 0.0, 0.25, 1.0]), (None, rows[3][1]), (600, None), (601, []), (602, [0.1] * 3), (603, [0.1, None, 0.1, 0.1]),
             (604, [float("nan")] * 4), (605, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 3, 2.0) for r in rows], "vec_id long, embedding array<float>, cluster string, size int, distance double")
    got, centroids = z.zone_clusters(df.repartition(3), k=12, rounds=4, dims=4, block=16)
    want, where = plain(rows, 12, 4, 4)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want
    assert centroids.tolist() == where


def test_fewer_vectors_than_centroids(spark):
    rows = [(1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, [5.0, 5.0])]
    got, centroids = z.zone_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=8, rounds=2, dims=2)
    want, where = plain(rows, 8, 2, 2)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want and centroids.tolist() == where


def test_none(spark):
    got, centroids = z.zone_clusters(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert got.collect() == [] and len(centroids) == 0


def test_huge_components(spark):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]
    got, _ = z.zone_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=1, rounds=0)
    assert all(r.distance >= 0 for r in got.collect())


def test_against_sql(spark):
    df = registry.queries()["op11_zone_clusters"](spark, SF)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    rel = con.sql(registry.oracle_sql()["op11_zone_clusters"])
    assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(rel.fetchall())
