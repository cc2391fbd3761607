"""Attribution over a long history (several look-back buckets, one dominant user) vs brute force."""

import datetime as dt

import numpy as np
import pytest

from mercato.operators.social.attribution import attribution


def _brute(events, lookback=30, half=7.0):
    out = {}
    for u in {e[0] for e in events}:
        ev = sorted([e for e in events if e[0] == u], key=lambda e: e[1])
        for i, (_, ts, kind, ch) in enumerate(ev):
            if kind != "purchase":
                continue
            t = [e for e in ev if e[2] in ("view", "click") and ts - dt.timedelta(days=lookback) <= e[1] < ts]
            n = len(t)
            if n == 0:
                out[("unattributed", None)] = out.get(("unattributed", None), 0) + 1
                continue
            w = [2 ** (-(ts - e[1]).total_seconds() / 86400 / half) for e in t]
            for j, e in enumerate(t):
                c = e[3]
                credits = {"linear": 1 / n, "time_decay": w[j] / sum(w),
                           "first_touch": 1.0 if j == 0 else 0.0, "last_touch": 1.0 if j == n - 1 else 0.0,
                           "position": 1.0 if n == 1 else 0.5 if n == 2 else (0.4 if j in (0, n - 1) else 0.2 / (n - 2))}
                for m, v in credits.items():
                    out[(m, c)] = out.get((m, c), 0) + v
    return out


def test_attribution_long_history(spark):
    rng = np.random.default_rng(11)
    start = dt.datetime(2024, 1, 1)
    events = []
    for u, n in ((1, 600), (2, 40), (3, 25)):  # user 1 dominates
        for _ in range(n):
            ts = start + dt.timedelta(seconds=int(rng.integers(0, 200 * 86400)), microseconds=int(rng.integers(0, 10**6)))
            kind = rng.choice(["view", "click", "purchase", "signup"], p=[0.45, 0.3, 0.15, 0.1])
            events.append((u, ts, str(kind), str(rng.choice(["MOBILE", "DESKTOP", "TABLET"]))))
    df = spark.createDataFrame(events, "user_id long, ts timestamp_ntz, event_type string, channel string")
    got = {(r["model"], r["channel"]): r["credit"] for r in attribution(df).collect()}
    want = _brute(events)
    assert set(got) == {k for k, v in want.items() if v > 0} | {k for k in got if got[k] == 0}
    for k, v in want.items():
        assert got.get(k, 0.0) == pytest.approx(v, rel=1e-9, abs=1e-9), k


def test_work_grows_linearly(spark):
    """One user with 100,000 events in one month."""
    from mercato.operators.social.attribution import attribution
    events = spark.range(100_000).selectExpr("1 as user_id", "if(id % 50 = 0, 'purchase', 'view') as event_type",
                                             "concat('c', id % 3) as channel", "timestamp_seconds(1700000000 + id * 20) as ts")
    rows = attribution(events).collect()
    linear = {r["channel"]: r["credit"] for r in rows if r["model"] == "linear"}
    assert abs(sum(linear.values()) - 1999) < 1e-6  # the first purchase has no touch before it


def test_many_channels(spark):
    """10,000 channels: credit is summed per touch, no channel has a column."""
    events = spark.range(20_000).selectExpr(
        "id div 4 as user_id", "if(id % 4 = 3, 'purchase', 'click') as event_type",
        "if(id % 4 = 3, null, concat('c', id % 10000)) as channel", "timestamp_seconds(1700000000 + id * 60) as ts")
    got = {(r["model"], r["channel"]): r["credit"] for r in attribution(events).collect()}
    assert len({c for _, c in got}) == 7500
    for model in ("first_touch", "last_touch", "linear", "time_decay", "position"):
        assert sum(v for (m, _), v in got.items() if m == model) == pytest.approx(5000)
    assert got[("first_touch", "c0")] == 2 and got[("last_touch", "c2")] == 2
    assert got[("linear", "c1")] == pytest.approx(2 / 3) and got[("position", "c1")] == pytest.approx(0.4)


def test_windows(spark):
    """Last click and last view at or before each purchase, by age; ties in time count as before."""
    from mercato.context import Context
    from mercato.operators.social.windows import ma_attribution_windows
    day = dt.timedelta(days=1)
    t = dt.datetime(2024, 3, 1)
    rows = [(1, 7, t, "click", 1.0, "A"), (2, 7, t + day, "purchase", 10.0, None), (3, 7, t + 7 * day, "purchase", 20.0, None),
            (4, 7, t + 28 * day, "purchase", 40.0, None), (5, 7, t + 28 * day + dt.timedelta(microseconds=1), "purchase", 80.0, None),
            (6, 8, t, "view", 1.0, "B"), (7, 8, t, "purchase", 160.0, None), (8, 8, t + 2 * day, "purchase", 320.0, None),
            (9, 9, t, "purchase", 640.0, None), (10, 9, t + day, "click", 1.0, "A")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, channel string")
    got = {r["window"]: r for r in ma_attribution_windows(Context(spark, events=events)).collect()}
    assert [(got[w]["purchases"], got[w]["purchase_value"]) for w in ("1d_click", "7d_click", "28d_click", "1d_view")] == [
        (1, 10.0), (2, 30.0), (3, 70.0), (1, 160.0)]
    assert got["7d_click"]["delta_purchases"] == 1 and got["7d_click"]["delta_pct"] == 100.0 and got["1d_view"]["delta_pct"] is None
    assert got["28d_click"]["pct_purchases"] == pytest.approx(300 / 7) and got["1d_click"]["roas"] == 0.0
    by = ma_attribution_windows(Context(spark, events=events), by_channel=True).collect()
    assert {(r["window"], r["channel"]): r["purchases"] for r in by} == {
        ("1d_click", "A"): 1, ("7d_click", "A"): 2, ("28d_click", "A"): 3, ("1d_view", "B"): 1}
