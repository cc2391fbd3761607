"""Operators: oracle agreement, properties, mini fixtures."""

import datetime as dt
import itertools
import math
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from mercato.context import Context
from mercato.functions import cooccurrence as co
from mercato.operators.store.orders import orders_from_lines
from mercato.plans.registry import REGISTRY
from tests.conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events".split()

SAMPLE = ["ec_monthly_revenue", "ec_rfm_scores", "ec_cohort_matrix", "ec_basket_pairs", "ec_pareto",
          "ec_purchase_gaps", "ec_product_lifecycle", "ec_forecast", "ga_campaigns", "ga_weekly_drift",
          "ga_negative_words", "ga_best_worst", "ma_daily", "ma_creative_fatigue", "ma_ad_ranking",
          "ma_name_summary", "ma_forecast", "ga_saved_impression_share", "ga_saved_places", "ga_saved_weekdays"]


@pytest.fixture(scope="module")
def ctx(spark):
    return Context.from_fixture(spark, SF_SMALL, persist=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("key", SAMPLE)
def test_matches_oracle(spark, ctx, duck, key):
    df = REGISTRY[key](ctx, **E.FIXTURE_PARAMS.get(key, dict)())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(E.oracle_sql()[key])
    want = _rows([d[0] for d in res.description], res.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in res.description)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            if isinstance(x, float) or isinstance(y, float):
                assert x == pytest.approx(y, rel=1e-6, abs=1e-6)
            else:
                assert x == y


def test_shares_sum_to_100(ctx):
    total = REGISTRY["ga_campaigns"](ctx).agg(F.sum("cost_share_pct")).first()[0]
    assert total == pytest.approx(100.0)
    total = REGISTRY["ec_geo_revenue"](ctx).agg(F.sum("pct_revenue")).first()[0]
    assert total == pytest.approx(100.0)


def test_cohort_month_zero_is_100(ctx):
    m = REGISTRY["ec_cohort_matrix"](ctx).where("months_since = 0").select("retention_pct").collect()
    assert m and all(r[0] == pytest.approx(100.0) for r in m)


def test_pareto_cumulative_non_decreasing(ctx):
    p = REGISTRY["ec_pareto"](ctx).orderBy(F.col("revenue").desc(), "product_name").toPandas()
    assert (p["cumulative_pct"].diff().dropna() >= -1e-9).all()


def test_result_independent_of_partitioning(spark):
    a = Context(spark, lines=lambda: Context.from_fixture(spark, SF_SMALL).lines.repartition(3),
                orders=lambda: Context.from_fixture(spark, SF_SMALL).orders.repartition(5))
    x = sorted(tuple(r) for r in REGISTRY["ec_monthly_revenue"](a).collect())
    y = sorted(tuple(r) for r in REGISTRY["ec_monthly_revenue"](Context.from_fixture(spark, SF_SMALL)).collect())
    assert [(r[0], r[2]) for r in x] == [(r[0], r[2]) for r in y]
    assert [r[1] for r in x] == pytest.approx([r[1] for r in y], rel=1e-12)


def test_orders_from_lines_first_non_null(spark):
    rows = [("o1", 1, None, None, 10.0), ("o1", 2, "a@x", dt.datetime(2024, 1, 2), 10.0),
            ("o1", 3, "b@x", None, None), ("o2", 1, None, None, None)]
    lines = spark.createDataFrame(rows, "order_id string, line_no int, email string, date timestamp_ntz, total double")
    got = {r["order_id"]: r for r in orders_from_lines(lines).collect()}
    assert got["o1"]["email"] == "a@x" and got["o1"]["date"] == dt.datetime(2024, 1, 2)
    assert got["o1"]["total"] == 10.0
    assert got["o2"]["email"] is None and got["o2"]["total"] is None


def _brute_pairs(pdf):
    out = {}
    for _, g in pdf.groupby("order_id"):
        for a, b in itertools.combinations(sorted(set(g["item"])), 2):
            out[(a, b)] = out.get((a, b), 0) + 1
    return out


def _brute_trios(pdf):
    out = {}
    for _, g in pdf.groupby("order_id"):
        for t in itertools.combinations(sorted(set(g["item"])), 3):
            out[t] = out.get(t, 0) + 1
    return out


def _named(items, rows, sides):
    names = {r["h"]: r["item"] for r in co.item_counts(items).collect()}
    return {tuple(sorted(names[r[c]] for c in sides)): r["count"] for r in rows.collect()}


@pytest.mark.parametrize("split", [3, 2048])
def test_cooccurrence_matches_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(co, "SPLIT", split)  # 3: most orders are dealt as several units
    rng = np.random.default_rng(7)
    rows = []
    for o in range(400):
        k = 40 if o == 0 else rng.integers(1, 6)  # one very large basket
        for it in rng.choice(list("abcdefghijklmnopqrst"), size=min(k, 20), replace=False):
            rows.append((f"o{o}", str(it)))
    pdf = pd.DataFrame(rows, columns=["order_id", "item"]).drop_duplicates()
    items = spark.createDataFrame(pdf)
    pairs = co.pair_counts(co.transactions(items))
    assert _named(items, pairs, "ab") == _brute_pairs(pdf)
    for least in (1, 9):  # trios of frequent pairs are complete above the threshold
        trios = _named(items, co.trio_counts(co.transactions(items), pairs.where(F.col("count") >= least)), "abc")
        want = _brute_trios(pdf)
        assert {k: v for k, v in trios.items() if v >= least} == {k: v for k, v in want.items() if v >= least}
        assert all(want[k] == v for k, v in trios.items())


def test_pair_bitmap(spark):
    rng = np.random.default_rng(8)
    x = np.sort(rng.integers(-2**63, 2**63 - 1, (500, 2)), axis=1)
    bits = co._bitmap(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])))
    at = co._position(x[:, 0], x[:, 1])
    assert ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1).all()
    assert np.unpackbits(bits).sum() == len(set(at.tolist()))


def test_order_of_many_lines(spark):
    """One order of 100,000 lines and 3,000 products among small orders: one path, exact counts."""
    from mercato.operators.store import basket
    big = spark.range(100_000).selectExpr("-1L as order_id", "concat('p', id % 3000) as product_name")
    small = spark.range(3000).selectExpr("id as order_id", "explode(array(concat('p', id), concat('p', (id + 1) % 3000))) as product_name")
    items = basket.order_items(big.unionByName(small), F.col("product_name"))
    pairs = basket.pairs_with_freqs(items)
    got = pairs.groupBy("count").agg(F.count("*").alias("k")).collect()
    assert {r["count"]: r["k"] for r in got} == {2: 3000, 1: 3000 * 2999 // 2 - 3000}
    assert pairs.where("item_a >= item_b or freq_a <> 3 or freq_b <> 3").count() == 0


def test_kmeans_clusters(ctx):
    c = REGISTRY["ec_niche_clusters"](ctx).toPandas()
    n = ctx.orders.where("email IS NOT NULL AND date IS NOT NULL AND total > 0").select("email").distinct().count()
    assert c["size"].sum() == n
    assert 2 <= len(c) <= 4
    assert list(c.sort_values("avg_spend", ascending=False)["label"])[:2] == ["High Value", "Medium-High"]
    assert math.isclose(c["pct"].sum(), 100.0)


def test_signals_sorted_by_priority(ctx):
    s = REGISTRY["ma_signals"](ctx).toPandas()
    order = s["priority"].map({"high": 0, "medium": 1, "low": 2})
    assert order.is_monotonic_increasing


def test_basket_ranks_every_pair(spark):
    """A pair with the highest lift counts however many pairs are more frequent."""
    from mercato.operators.store import basket
    orders = [[f"{x}{i:02d}" for x in "abc"] + [f"hub{j}" for j in range(3)] for i in range(8) for _ in range(3)]
    orders += [[f"{x}{i} common - T" for i in range(12)] for x in "pq" for _ in range(8)] + [["rare one", "rare two", "rare three"]] * 2
    lines = spark.createDataFrame([(o, p) for o, items in enumerate(orders) for p in items], "order_id long, product_name string")
    ctx = Context(spark, lines=lines)
    item = F.col("product_name")
    top = basket.basket_pairs(ctx, item=item, k=3).collect()
    assert {(r.item_a, r.item_b) for r in top} == {("rare one", "rare three"), ("rare one", "rare two"), ("rare three", "rare two")}
    assert not any("rare" in r.item_a for r in basket.basket_pairs(ctx, item=item, candidates=100).collect())
    assert [r.item_c for r in basket.basket_trios(ctx, item=item, k=1).collect()] == ["rare two"]


def test_degraded_months(spark):
    rows = [(f"o{m}{i}", dt.datetime(2024, m, 1), dt.datetime(2024, m, 1) + dt.timedelta(days=d)) for m, days in
            ((1, [1, 2, 3, 70, -1]), (2, [2, 2, 2, 2]), (3, [5, 9])) for i, d in enumerate(days)]
    orders = spark.createDataFrame(rows, "order_id string, date timestamp_ntz, shipping_date timestamp_ntz")
    got = {r["month"]: r for r in REGISTRY["ext_degraded_months"](Context(spark, orders=orders)).collect()}
    assert {m: (r["orders"], r["median_days"], r["overall_median_days"], r["degraded"]) for m, r in got.items()} == {
        "2024-01": (3, 2.0, 2.0, False), "2024-02": (4, 2.0, 2.0, False), "2024-03": (2, 7.0, 2.0, True)}


def test_upgrades_number_orders_across_days(spark):
    """Halves by date, then order id; the middle may fall into a day of several orders."""
    rng = np.random.default_rng(9)
    rows = [(f"e{c}", f"o{c}-{i:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(rng.integers(0, 24 * 4))), float(rng.integers(1, 100)))
            for c in range(12) for i in range(int(rng.integers(1, 25)))]
    orders = spark.createDataFrame(rows, "email string, order_id string, date timestamp_ntz, total double")
    from mercato.operators.store.customer import _upgrades
    got = {r["email"]: (r["first_half_aov"], r["second_half_aov"]) for r in _upgrades(Context(spark, orders=orders)).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        mine = [r[3] for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[1]))]
        if len(mine) >= 3:
            h = len(mine) // 2
            want[c] = (pytest.approx(sum(mine[:h]) / h), pytest.approx(sum(mine[h:]) / (len(mine) - h)))
    assert got == want


def test_product_ranking_deals_orders_by_the_number_of_lines(spark):
    from mercato.operators.store import product
    ctx = Context.from_fixture(spark, SF_SMALL)
    want = [tuple(r) for r in product.product_ranking(ctx).select("product_name", "units", "orders", "total_products").collect()]
    spark.conf.set("mercato.rowsPerPartition", "100")
    try:
        out = product.product_ranking(ctx)
        tasks = -(-2 * ctx.lines.where("product_name is not null").count() // 100)
        assert f"hashpartitioning(product_name, order_id, {tasks})" in re.sub(r"#\d+", "", out._jdf.queryExecution().toString())
        assert [tuple(r) for r in out.select("product_name", "units", "orders", "total_products").collect()] == want
    finally:
        spark.conf.unset("mercato.rowsPerPartition")


def test_trios_derive_their_items_once(spark):
    from mercato.operators.store import basket
    lines = Context.from_fixture(spark, SF_SMALL).lines
    read = basket.basket_trios(Context(spark, lines=lines), item=F.substring_index("product_name", " - ", -1), min_lift=0.0).inputFiles()
    assert read and all("/order-items-" in f for f in read)
