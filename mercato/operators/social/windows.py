"""Conversions per attribution window, from the event stream (``ma_attribution_windows``).

Each purchase is attributed by the last click, and the last view, of the same user at or before it.  One
sorted sweep finds both (``functions.asof``); the windows are then filters on the elapsed time, all
counted in one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.asof import last_seen
from mercato.functions.core import MICROS_PER_DAY, pct_change, safe_div

# The platform's windows, touch kind and days.
WINDOWS = [("1d_click", "click", 1), ("7d_click", "click", 7), ("28d_click", "click", 28), ("1d_view", "view", 1)]


def window_touches(events: DataFrame, conversion: str = "purchase", touches: tuple = ("click", "view")) -> DataFrame:
    """Every conversion with the time and channel of the user's last touch of each kind."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ev = events.where(F.col("ts").isNotNull()).select(
        "event_id", "user_id", "event_type", "value", "channel",
        F.timestamp_diff("MICROSECOND", epoch, F.col("ts").cast("timestamp_ntz")).alias("us"),
        # a touch at the very time of the conversion comes before it
        (F.col("event_type") == conversion).cast("int").alias("turn"))
    return last_seen(ev, "user_id", ["us", "turn", "event_id"], {t: F.col("event_type") == t for t in touches},
                     F.col("event_type") == conversion, ["us", "channel"], label="touches")


def ma_attribution_windows(ctx, by_channel: bool = False) -> DataFrame:
    """Purchases, value and ROAS per window, with the change from the next narrower click window.

    ``by_channel`` splits every window by the channel of the touch (without spend, which has no channel).
    """
    conv = window_touches(ctx.events)
    rows = []
    for i, (name, kind, days) in enumerate(WINDOWS):
        hit = F.col("us") - F.col(f"{kind}_us") <= F.lit(days * MICROS_PER_DAY)
        rows.append(F.when(hit, F.struct(F.lit(i).alias("_i"), F.lit(name).alias("window"), F.col(f"{kind}_channel").alias("channel"))))
    hits = conv.select("value", F.explode(F.array(*rows)).alias("w")).where("w is not null").select("value", "w.*")
    sums = [F.count(F.lit(1)).alias("purchases"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("purchase_value")]
    if by_channel:
        return hits.groupBy("window", "channel").agg(*sums)
    counted = hits.groupBy("window").agg(*sums)
    # one row per window name, whether or not it has purchases
    base = ctx.spark.createDataFrame([(i, n, WINDOWS[i - 1][0] if i and WINDOWS[i - 1][1] == k else None)
                                      for i, (n, k, _) in enumerate(WINDOWS)], "_i int, window string, _narrower string")
    full = base.join(F.broadcast(counted), "window", "left").select(
        "_i", "window", "_narrower", F.coalesce("purchases", F.lit(0)).alias("purchases"),
        F.coalesce("purchase_value", F.lit(0.0)).alias("purchase_value"))
    narrow = full.select(F.col("window").alias("_narrower"), F.col("purchases").alias("_p"))
    spend = ctx.social.agg(F.coalesce(F.sum("spend"), F.lit(0.0))).scalar() if ctx.has("social") else F.lit(0.0)
    total = conv.agg(F.count(F.lit(1))).scalar()
    return full.join(F.broadcast(narrow), "_narrower", "left").select(
        "window", "purchases", "purchase_value", safe_div(F.col("purchases") * 100.0, total).alias("pct_purchases"),
        safe_div("purchase_value", spend).alias("roas"), (F.col("purchases") - F.col("_p")).alias("delta_purchases"),
        pct_change("purchases", "_p").alias("delta_pct"))
