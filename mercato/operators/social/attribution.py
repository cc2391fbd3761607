"""Rule-based multi-touch attribution over an event stream.

Touches (views, clicks) earn credit for a conversion (purchase) of the same
user when they happen in the 30 days before it.  Models: last touch, first
touch, linear, time decay (half-life 7 days) and position based (40 / 20 / 40).

No conversion is joined to its touches one pair at a time, and no column or
state is kept per channel.  A first pass over the user's time-ordered events
gives every conversion, from running sums (the value now less the value 30
days ago), its number of touches, its decay total and its first and last
touch.  A second pass gives every touch the sums, over the conversions of the
following 30 days, of what each pays per touch; a touch's credit is that sum (for
decay, times its own weight).  The credits are then summed by channel, so their
number is free.  First, last and position credit, which name single touches,
leave the conversions.

Window partitions are (user, 30-day bucket) with touches copied into the
following bucket, so a user's history is split by time.  A touch's
conversions lie in its own bucket (its first copy) or the next one (its
second copy).  Touches without a channel are no touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
MODELS = ("last_touch", "first_touch", "linear", "time_decay", "position")


def _credits(channel: Column, **credit) -> list[Column]:
    return [F.struct(F.lit(m).alias("model"), channel.alias("channel"), F.lit(c).cast("double").alias("credit"))
            for m, c in credit.items()]


def attribution(events: DataFrame, channel: str = "channel", lookback_days: int = 30,
                half_life_days: float = 7.0, touch_types: tuple = ("view", "click"),
                conversion_type: str = "purchase") -> DataFrame:
    """Credit per (model, channel) summed over conversions; conversions without touches are ``unattributed``."""
    # micros since the epoch measured between zone-less timestamps: no session time zone (or DST) involved
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    is_conversion = F.col("event_type") == conversion_type
    ev = events.where(is_conversion | (F.col("event_type").isin(*touch_types) & F.col(channel).isNotNull())).select(
        "user_id", F.when(~is_conversion, F.col(channel)).alias("channel"), is_conversion.alias("_conv"),
        F.timestamp_diff("MICROSECOND", epoch, F.col("ts").cast("timestamp_ntz")).alias("_us"))
    span = lookback_days * MICROS_PER_DAY
    ev = ev.withColumn("_b", F.floor(F.col("_us") / F.lit(span)).cast("long"))
    ev = ev.withColumn("_b", F.explode(F.when(F.col("_conv"), F.array(F.col("_b"))).otherwise(F.array(F.col("_b"), F.col("_b") + 1))))
    part = Window.partitionBy("user_id", "_b")
    # base-2 exponent relative to the partition's first event: at most two look-backs of half-lives
    weight = F.pow(F.lit(2.0), (F.col("_us") - F.min("_us").over(part)) / F.lit(half_life_days * MICROS_PER_DAY))
    ev = ev.withColumn("_w", F.when(~F.col("_conv"), weight))
    # sums over the look-back are differences of running sums, the last touch is the last of a running frame and the
    # first touch the last of a running frame from the other end: all frames only grow, so the work is linear
    by_time = part.orderBy("_us")
    upto = by_time.rangeBetween(Window.unboundedPreceding, -1)
    older = by_time.rangeBetween(Window.unboundedPreceding, -span - 1)
    from_end = part.orderBy(F.col("_us").desc()).rangeBetween(Window.unboundedPreceding, span)

    def between(value: Column, wide, narrow) -> Column:
        return F.coalesce(F.sum(value).over(wide), F.lit(0)) - F.coalesce(F.sum(value).over(narrow), F.lit(0))
    n = between((~F.col("_conv")).cast("long"), upto, older)
    seen = ev.select("*", F.when(F.col("_conv"), n).alias("_n"), F.when(F.col("_conv"), between(F.col("_w"), upto, older)).alias("_wt"),
                     F.last("channel", ignorenulls=True).over(from_end).alias("_first"),
                     F.last("channel", ignorenulls=True).over(upto).alias("_last"))
    paying = F.col("_n") > 0
    middle = F.when(F.col("_n") > 2, F.lit(0.2) / (F.col("_n") - 2))
    # what the conversions of the following look-back pay: those up to 30 days ahead less those up to now
    ahead, now = by_time.rangeBetween(Window.unboundedPreceding, span), by_time.rangeBetween(Window.unboundedPreceding, 0)
    paid = seen.select(
        "*", between(paying.cast("long"), ahead, now).alias("_convs"), between(F.when(paying, 1.0 / F.col("_n")), ahead, now).alias("_linear"),
        (between(F.when(paying, 1.0 / F.col("_wt")), ahead, now) * F.col("_w")).alias("_decay"),
        between(middle, ahead, now).alias("_middle"))
    touch = F.when(F.col("_convs") > 0, F.array(*_credits(
        F.col("channel"), linear=F.col("_linear"), time_decay=F.greatest(F.lit(0.0), F.col("_decay")),
        position=F.greatest(F.lit(0.0), F.col("_middle")), first_touch=0.0, last_touch=0.0)))
    # a position credit of the first and last touch includes the middle share they were counted with above
    end = F.when(F.col("_n") == 2, 0.5).otherwise(F.lit(0.4) - F.coalesce(middle, F.lit(0.0)))
    conv = (F.when(F.col("_n") == 0, F.array(*_credits(F.lit(None).cast("string"), unattributed=1.0)))
            .when(F.col("_n") == 1, F.array(*_credits(F.col("_first"), first_touch=1.0, position=1.0), *_credits(F.col("_last"), last_touch=1.0)))
            .otherwise(F.array(*_credits(F.col("_first"), first_touch=1.0, position=end), *_credits(F.col("_last"), last_touch=1.0, position=end))))
    e = paid.select(F.explode(F.when(F.col("_conv"), conv).otherwise(touch)).alias("r")).select("r.*")
    return e.groupBy("model", "channel").agg(F.sum("credit").alias("credit"))


def attribution_models(ctx) -> DataFrame:
    """Credit per channel of the context's event stream."""
    return attribution(ctx.events)
