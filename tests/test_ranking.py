"""Order statistics, as-of lookups and k-means rounds: compared with pandas, numpy and plain loops."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mercato.functions import asof, core, lloyd, ranking


@pytest.mark.parametrize("qs", [[0.5], [0.25, 0.5, 0.75, 0.9], [0.0, 1.0]])
def test_exact_quantiles_match_numpy(spark, qs):
    rng = np.random.default_rng(2)
    vals = np.concatenate([rng.normal(100, 30, 900), np.full(300, 42.0)])  # a third of copies
    df = spark.createDataFrame(pd.DataFrame({"v": vals}))
    row = ranking.exact_quantiles(df, "v", qs).first()
    for i, q in enumerate(qs):
        assert row[f"q{i}"] == pytest.approx(float(np.quantile(vals, q)), rel=1e-12)


def test_grouped_quantiles(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 400), "v": rng.integers(0, 30, 400).astype(float)})
    out = ranking.exact_quantiles(spark.createDataFrame(pdf), "v", [0.5, 0.9], by=["g"]).toPandas()
    for _, r in out.iterrows():
        vals = pdf.loc[pdf.g == r["g"], "v"]
        assert r["q0"] == pytest.approx(vals.quantile(0.5))
        assert r["q1"] == pytest.approx(vals.quantile(0.9))


@pytest.mark.parametrize("n", [6, 7, 10, 57])
def test_quantile_bin_matches_qcut(spark, n):
    rng = np.random.default_rng(n)
    vals = rng.normal(0, 1, n)
    pdf = pd.DataFrame({"key": [f"k{i:03d}" for i in range(n)], "v": vals})
    out = ranking.quantile_bin(spark.createDataFrame(pdf), "v", 5, key="key", out="b").toPandas()
    exp = pd.qcut(pdf["v"], 5, labels=[1, 2, 3, 4, 5]).astype(int)
    got = out.set_index("key").loc[pdf["key"], "b"].to_numpy()
    assert list(got) == list(exp)


def test_quantile_bin_rank_fallback(spark):
    # repeated edges: qcut refuses labels, so bins come from ranks with ties in key order
    pdf = pd.DataFrame({"key": [f"c{i:02d}" for i in range(20)], "v": [1] * 12 + [2, 3, 4, 5, 6, 7, 8, 9]})
    out = ranking.quantile_bin(spark.createDataFrame(pdf), "v", 5, key="key", out="b").toPandas()
    ranks = pdf.sort_values(["v", "key"]).reset_index(drop=True)
    ranks["r"] = np.arange(1, 21)
    exp = pd.qcut(ranks["r"], 5, labels=[1, 2, 3, 4, 5]).astype(int)
    got = out.set_index("key").loc[ranks["key"], "b"].to_numpy()
    assert list(got) == list(exp)


def test_quantile_bins_multi_reverse(spark):
    pdf = pd.DataFrame({"key": [f"k{i}" for i in range(30)], "a": np.arange(30.0), "b": np.arange(30.0)[::-1]})
    out = ranking.quantile_bins(spark.createDataFrame(pdf), [("a", 5, "ba", False), ("b", 5, "bb", True)],
                                key="key").toPandas()
    assert (out["ba"] == out["bb"]).all()


def test_equal_width_bin_matches_cut(spark):
    rng = np.random.default_rng(4)
    vals = rng.uniform(10, 500, 300)
    vals[0], vals[1] = vals.min(), vals.max()
    df = spark.createDataFrame(pd.DataFrame({"p": vals}))
    lo, hi = float(vals.min()), float(vals.max())
    got = df.select(ranking.equal_width_bin(F.col("p"), F.lit(lo), F.lit(hi), 20).alias("b")).toPandas()["b"]
    exp = pd.cut(pd.Series(vals), bins=20, labels=False)
    assert list(got) == list(exp)


@pytest.mark.parametrize("values", [[5.0], [], [None, None], [0.0, -0.0], [-5.5, 1e300, -1e300, 0.001, 7.0, 7.0, 7.0], [float("nan"), 1.0, 2.0],
                                    [float(i) for i in range(-50, 51)], [1e-9, 2e-9, 3e-9, 1e12]])
def test_quantiles_of_odd_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = ranking.exact_quantiles(df, "v", [0.0, 0.3, 0.5, 1.0]).first()
    real = [v for v in values if v is not None and v == v]
    assert row["_n"] == (len(real) or None)
    for i, q in enumerate([0.0, 0.3, 0.5, 1.0]):
        assert row[f"q{i}"] == (pytest.approx(float(np.quantile(real, q)), rel=1e-12) if real else None)


def test_weighted_quantiles_with_null_group(spark):
    rows = [("a", 1, 3), ("a", 5, 1), (None, 1, 1), (None, 2, 5), (None, 9, 2)]
    out = ranking.exact_quantiles(spark.createDataFrame(rows, "g string, v long, w long"), "v", [0.5, 0.75], by=["g"], weight="w")
    got = {r["g"]: (r["_n"], r["q0"], r["q1"]) for r in out.collect()}
    assert got == {"a": (4, 1.0, 2.0), None: (8, 2.0, np.quantile([1, 2, 2, 2, 2, 2, 9, 9], 0.75))}


def test_no_size_switch(spark):
    """No job runs while a quantile's plan is built, and nothing is checkpointed."""
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    plan = ranking.exact_quantiles(df, "v", [0.5])._jdf.queryExecution().toString()
    assert "Percentile" not in plan and "Scan ExistingRDD" not in plan and "InPandas" not in plan


def test_quantile_bin_fallback_with_long_shared_prefixes(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"key": [f"customer{i:05d}@example.com" for i in rng.permutation(700)], "v": rng.integers(1, 4, 700)})
    out = ranking.quantile_bins(spark.createDataFrame(pdf), [("v", 5, "b", False), ("v", 4, "c", True)], key="key").toPandas()
    ranks = out.sort_values(["v", "key"]).reset_index(drop=True)
    r = np.arange(700)
    assert list(ranks["b"]) == [max(1, -(-5 * x // 699)) for x in r]
    assert list(ranks["c"]) == [5 - max(1, -(-4 * x // 699)) for x in r]


@pytest.mark.parametrize("values", [[10, 5, 5, 5, 5, 1, 0, 0, 0], [1] * 20, [3], [0, 0], [8, 4, 2, 1, -1], [100] + [0.01] * 50])
def test_rows_within_share(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r["share"]: r["rows"] for r in ranking.rows_within_share(df, "v", [50.0, 80.0, 100.0]).collect()}
    order = np.sort(values)[::-1]
    for share in (50.0, 80.0):
        assert got[share] == int((np.cumsum(order) <= share / 100 * sum(values)).sum()), share


def test_day_gaps(spark):
    rng = np.random.default_rng(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(int(g), start + dt.timedelta(minutes=int(m))) for g, m in zip(np.where(rng.random(400) < 0.4, 0, rng.integers(1, 9, 400)),
                                                                          rng.integers(0, 60 * 24 * 90, 400))]
    rows += rows[:20] + [(99, None)]
    got = ranking.day_gaps(spark.createDataFrame(rows, "g long, t timestamp_ntz"), "g", "t", core.whole_days).collect()
    want = []
    for g in {r[0] for r in rows}:
        times = sorted({t for h, t in rows if h == g and t is not None})
        want += [(g, (b - a).days) for a, b in zip(times, times[1:]) if (b - a).days > 0]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_last_seen_matches_a_loop(spark, parts):
    """One user holds most rows and whole partitions; some find their touch only in earlier partitions."""
    rng = np.random.default_rng(parts)
    rows = []
    for i in range(1500):
        user = "hot" if rng.random() < 0.7 else f"u{rng.integers(0, 30)}"
        kind = str(rng.choice(["buy", "click", "view", "noise"], p=[0.3, 0.004, 0.3, 0.396]))
        rows.append((user, int(rng.integers(0, 900)), i, kind, None if i % 7 == 0 else f"c{i}"))
    rows += [(None, 5, 5000, "buy", "x"), ("lonely", 1, 5001, "buy", "y")]
    df = spark.createDataFrame(rows, "user string, t long, id long, kind string, tag string").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        out = asof.last_seen(df, "user", ["t", "id"], {"click": F.col("kind") == "click", "view": F.col("kind") == "view"},
                             F.col("kind") == "buy", ["t", "tag"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = {r["id"]: (r["click_t"], r["click_tag"], r["view_t"], r["view_tag"]) for r in out}
    want = {}
    for user, t, i, kind, _ in rows:
        if kind == "buy" and user is not None:
            found = []
            for k in ("click", "view"):
                last = max(((a, b, c) for u, a, b, q, c in rows if u == user and q == k and (a, b) <= (t, i)), key=lambda x: x[:2], default=None)
                found += [last[0], last[2]] if last else [None, None]
            want[i] = tuple(found)
    assert got == want


def test_lloyd_rounds(spark):
    rng = np.random.default_rng(6)
    x = (np.concatenate([rng.normal(c, 0.1, (60, 2)) for c in (0, 3, 9)]) * 1000).astype(int)
    df = spark.createDataFrame([(f"id{i}", int(a), int(b)) for i, (a, b) in enumerate(x)], "id string, a long, b long")
    three, one = lloyd.centres(df, "id", ["a", "b"], [3, 1])
    assert one == [[x[:, 0].sum() / 180, x[:, 1].sum() / 180]]
    got = df.select(lloyd.nearest(["a", "b"], three).alias("c"), "a", "b").toPandas()
    for c, g in got.groupby("c"):
        assert three[c] == [g["a"].sum() / len(g), g["b"].sum() / len(g)]  # no centre moves any more
    assert lloyd.centres(df.where("false"), "id", ["a", "b"], [2]) == [[]]
