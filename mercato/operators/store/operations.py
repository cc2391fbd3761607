"""Geography, shipping, cancellation, fulfilment and channel operators (store)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.core import month_key, nonblank, safe_div, whole_days
from mercato.functions.ranking import exact_quantiles
from mercato.operators.store.orders import CANCELLED_SHORT, is_cancelled

NO_REASON = "Sin motivo"


def geo_revenue(ctx) -> DataFrame:
    o = ctx.orders.where(nonblank("state") & F.col("total").isNotNull())
    g = o.groupBy("state").agg(F.count("order_id").alias("orders"), F.sum("total").alias("revenue"),
                               F.avg("total").alias("aov"), F.count_distinct("email").alias("customers"))
    tot = g.agg(F.sum("revenue")).scalar()
    return g.select("*", F.when(tot > 0, F.col("revenue") / tot * 100).otherwise(F.lit(0.0)).alias("pct_revenue"))


def shipping_by_state(ctx) -> DataFrame:
    """Shipping cost per state; flag costly, thin states vs the median state (on 2-decimal values)."""
    o = ctx.orders.where(nonblank("state"))
    g = o.groupBy("state").agg(
        F.avg("shipping_cost").alias("avg_shipping"), F.count("order_id").alias("order_count"),
        (F.avg((F.coalesce(F.col("shipping_cost"), F.lit(0.0)) == 0).cast("double")) * 100).alias("free_shipping_pct"),
        F.avg("total").alias("avg_total"))
    g = g.withColumn("_ship2", F.round("avg_shipping", 2))
    med = exact_quantiles(g, "_ship2", [0.5], prefix="ms").select("ms0").scalar()
    med_orders = exact_quantiles(g, "order_count", [0.5], prefix="mo").select("mo0").scalar()
    flagged = (F.col("_ship2") > med * 1.5) & (F.col("order_count") < med_orders * 0.5)
    return g.select("state", "avg_shipping", "order_count", "free_shipping_pct", "avg_total",
                    F.coalesce(flagged, F.lit(False)).alias("flagged"))


def cancel_rate(ctx) -> DataFrame:
    o = ctx.orders.withColumn("_c", is_cancelled())
    return o.agg(F.count(F.lit(1)).alias("total_orders"), F.count(F.when(F.col("_c"), 1)).alias("cancelled_orders")).select(
        "*", safe_div(F.col("cancelled_orders") * 100.0, F.col("total_orders")).alias("cancel_rate"))


def cancel_monthly(ctx) -> DataFrame:
    o = ctx.orders.where(F.col("date").isNotNull()).withColumn("_c", is_cancelled())
    return o.groupBy(month_key("date").alias("month")).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("_c"), 1)).alias("cancelled")).select(
        "*", (F.col("cancelled") * 100.0 / F.col("total")).alias("rate"))


def cancel_reasons(ctx, k: int = 10) -> DataFrame:
    o = ctx.orders.where(is_cancelled())
    return (o.groupBy(F.coalesce("cancellation_reason", F.lit(NO_REASON)).alias("reason"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "reason").limit(k))


def cancel_by_payment(ctx, min_orders: int = 5) -> DataFrame:
    o = ctx.orders.where(F.col("payment_method").isNotNull()).withColumn("_c", is_cancelled())
    return o.groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("_c"), 1)).alias("cancelled")).where(
        F.col("total") >= min_orders).select("*", (F.col("cancelled") * 100.0 / F.col("total")).alias("rate"))


def city_penetration(ctx, k: int = 20) -> DataFrame:
    o = ctx.orders.where(nonblank("city"))
    g = o.groupBy("city").agg(F.count("order_id").alias("orders"), F.sum("total").alias("revenue"))
    n = g.agg(F.count(F.lit(1))).scalar()
    return g.select("*", n.alias("total_cities")).orderBy(F.col("revenue").desc_nulls_last(), "city").limit(k)


def shipping_method_crosstab(ctx, states: int = 10, methods: int = 5) -> DataFrame:
    """Order counts for the busiest states x shipping methods (long form, zero cells kept)."""
    o = ctx.orders.where(F.col("shipping_method").isNotNull() & F.col("state").isNotNull())
    top_states = (o.groupBy("state").count().orderBy(F.col("count").desc(), "state").limit(states)
                  .select("state"))
    # at most ``methods`` names: a bounded driver-side list
    top_methods = [r[0] for r in o.groupBy("shipping_method").count()
                   .orderBy(F.col("count").desc(), "shipping_method").limit(methods).collect()]
    counts = (o.where(F.col("shipping_method").isin(top_methods))
              .join(F.broadcast(top_states), "state", "left_semi")
              .groupBy("state", "shipping_method").agg(F.count(F.lit(1)).alias("count")))
    grid = top_states.select("state", F.explode(F.array(*[F.lit(m) for m in top_methods])).alias("shipping_method"))
    return grid.join(counts, ["state", "shipping_method"], "left").select(
        "state", "shipping_method", F.coalesce("count", F.lit(0)).alias("count"))


def _fulfilment(ctx) -> DataFrame:
    o = ctx.orders.where(F.col("date").isNotNull() & F.col("shipping_date").isNotNull())
    return o.withColumn("fulfillment_days", whole_days("shipping_date", "date")).where(F.col("fulfillment_days") >= 0)


def fulfillment_stats(ctx, min_orders: int = 10) -> DataFrame:
    f = _fulfilment(ctx)
    q = exact_quantiles(f, "fulfillment_days", [0.5, 0.9], prefix="q")
    return f.agg(F.avg("fulfillment_days").alias("mean_days"), F.count(F.lit(1)).alias("total_orders")).where(
        F.col("total_orders") >= min_orders).select(
        q.select("q0").scalar().alias("median_days"), "mean_days", q.select("q1").scalar().alias("p90_days"),
        "total_orders")


def fulfillment_by_method(ctx, min_orders: int = 5) -> DataFrame:
    f = _fulfilment(ctx).where(F.col("shipping_method").isNotNull())
    q = exact_quantiles(f, "fulfillment_days", [0.5], by=["shipping_method"], prefix="q")
    g = f.groupBy("shipping_method").agg(F.avg("fulfillment_days").alias("mean_days"),
                                         F.count(F.lit(1)).alias("orders"))
    return g.join(q.select("shipping_method", F.col("q0").alias("median_days")), "shipping_method").where(
        F.col("orders") >= min_orders).select(F.col("shipping_method").alias("method"), "median_days", "mean_days",
                                              "orders")


def fulfillment_monthly(ctx) -> DataFrame:
    f = _fulfilment(ctx).withColumn("month", month_key("date"))
    q = exact_quantiles(f, "fulfillment_days", [0.5], by=["month"], prefix="q")
    return q.select("month", F.col("q0").alias("median_days"))


def channel_analysis(ctx) -> DataFrame:
    o = ctx.orders.where(nonblank("channel"))
    c = F.coalesce(F.col("order_status").isin(*CANCELLED_SHORT), F.lit(False)).cast("double")
    return o.groupBy("channel").agg(
        F.count("order_id").alias("orders"), F.sum("total").alias("revenue"), F.avg("total").alias("aov"),
        F.count_distinct("email").alias("customers"), (F.avg(c) * 100).alias("cancel_rate"))


def _shipping_split(ctx) -> DataFrame:
    o = ctx.orders.where(F.col("total").isNotNull() & (F.col("total") > 0))
    return o.withColumn("_free", F.coalesce(F.col("shipping_cost"), F.lit(0.0)) == 0)


def free_shipping(ctx, min_each: int = 5) -> DataFrame:
    o = _shipping_split(ctx)
    g = o.groupBy(F.when(F.col("_free"), "free_shipping").otherwise("paid_shipping").alias("segment")).agg(
        F.count(F.lit(1)).alias("orders"), F.avg("total").alias("aov"), F.sum("total").alias("revenue"))
    counts = o.agg(F.count(F.when(F.col("_free"), 1)).alias("f"), F.count(F.when(~F.col("_free"), 1)).alias("p"))
    ok = (counts.select("f").scalar() >= min_each) & (counts.select("p").scalar() >= min_each)
    return g.where(ok)


def free_shipping_retention(ctx, min_each: int = 5) -> DataFrame:
    """Mean orders per customer among customers with a free (resp. paid) shipping order."""
    o = _shipping_split(ctx)
    per = o.where(F.col("email").isNotNull()).groupBy("email").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.col("_free").cast("int")).alias("_hf"),
        F.max((~F.col("_free")).cast("int")).alias("_hp"))
    counts = o.agg(F.count(F.when(F.col("_free"), 1)).alias("f"), F.count(F.when(~F.col("_free"), 1)).alias("p"))
    ok = (counts.select("f").scalar() >= min_each) & (counts.select("p").scalar() >= min_each)
    return per.agg(F.avg(F.when(F.col("_hf") == 1, F.col("_n"))).alias("free_avg_orders"),
                   F.avg(F.when(F.col("_hp") == 1, F.col("_n"))).alias("paid_avg_orders")).where(ok)
