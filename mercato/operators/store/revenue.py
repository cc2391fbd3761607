"""Revenue, ticket, discount, payment, seasonality and forecast operators (store)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.core import month_key, nonblank, pct_change, safe_div, weekday_mon0
from mercato.functions.ranking import exact_quantiles
from mercato.operators.store.orders import paid_orders

# Display labels of the store report.
TICKET_EDGES = [0, 5000, 10000, 20000, 50000, 100000, 200000]
TICKET_LABELS = ['$0-5K', '$5-10K', '$10-20K', '$20-50K', '$50-100K', '$100-200K', '$200K+']
MONTH_NAMES = ['Ene', 'Feb', 'Mar', 'Abr', 'May', 'Jun', 'Jul', 'Ago', 'Sep', 'Oct', 'Nov', 'Dic']
DAY_NAMES = ['Lunes', 'Martes', 'Miércoles', 'Jueves', 'Viernes', 'Sábado', 'Domingo']


def _monthly(orders: DataFrame) -> DataFrame:
    """Revenue per present calendar month (months are few: one row each)."""
    o = orders.where(F.col("date").isNotNull() & F.col("total").isNotNull())
    return o.groupBy(month_key("date").alias("month")).agg(
        F.sum("total").alias("revenue"),
        F.count("order_id").alias("orders"),
        F.avg("total").alias("avg_ticket"))


def monthly_revenue(ctx) -> DataFrame:
    """Month: revenue, orders, mean ticket, change vs previous present month and vs month - 12."""
    m = _monthly(ctx.orders)
    # the windows run over the aggregated months only (a few hundred rows at most)
    prev = F.lag("revenue").over(Window.orderBy("month"))
    idx = (F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int"))
    m = m.withColumn("_idx", idx)
    # the frame [idx - 12, idx - 12] holds the same month a year earlier, or nothing
    rev12 = F.max("revenue").over(Window.orderBy("_idx").rangeBetween(-12, -12))
    return m.select("month", "revenue", "orders", "avg_ticket",
                    F.when(prev != 0, (F.col("revenue") - prev) / prev * 100).alias("mom_pct"),
                    pct_change(F.col("revenue"), rev12).alias("yoy_pct"))


def revenue_trend(ctx) -> DataFrame:
    """Last present month vs the third-last: up / down / flat (±5 %)."""
    m = _monthly(ctx.orders)
    w = Window.orderBy(F.col("month").desc())
    last3 = m.withColumn("_rn", F.row_number().over(w)).where("_rn <= 3")
    agg = last3.agg(F.count(F.lit(1)).alias("_n"),
                    F.max(F.when(F.col("_rn") == 1, F.col("revenue"))).alias("_last"),
                    F.max(F.when(F.col("_rn") == 3, F.col("revenue"))).alias("_first"))
    o = ctx.orders.where(F.col("date").isNotNull() & F.col("total").isNotNull())
    totals = o.agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total_revenue"),
                   F.count(F.lit(1)).alias("total_orders"))
    trend = (F.when(F.col("_n") < 3, "insufficient_data")
             .when(F.col("_last") > F.col("_first") * 1.05, "up")
             .when(F.col("_last") < F.col("_first") * 0.95, "down").otherwise("flat"))
    return agg.select(trend.alias("trend"),
                      totals.select("total_revenue").scalar().alias("total_revenue"),
                      totals.select("total_orders").scalar().alias("total_orders"))


def ticket_stats(ctx) -> DataFrame:
    o = paid_orders(ctx.orders)
    med = exact_quantiles(o, "total", [0.5], prefix="median_aov")
    return o.agg(F.avg("total").alias("overall_aov")).select(
        "overall_aov", med.select("median_aov0").scalar().alias("median_aov"))


def ticket_histogram(ctx) -> DataFrame:
    """Order count per fixed left-closed ticket bucket (non-empty buckets)."""
    o = paid_orders(ctx.orders)
    t = F.col("total")
    bucket = F.lit(len(TICKET_EDGES) - 1)
    for i in range(len(TICKET_EDGES) - 1, 0, -1):
        bucket = F.when(t < TICKET_EDGES[i], F.lit(i - 1)).otherwise(bucket)
    labels = F.array(*[F.lit(x) for x in TICKET_LABELS])
    return (o.where(t >= 0).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
            .select("bucket", F.element_at(labels, F.col("bucket") + 1).alias("range"), "count"))


def ticket_monthly(ctx) -> DataFrame:
    o = paid_orders(ctx.orders).where(F.col("date").isNotNull())
    return o.groupBy(month_key("date").alias("month")).agg(F.avg("total").alias("aov"))


def new_vs_returning(ctx) -> DataFrame:
    """Mean ticket of first-purchase orders vs later orders (per customer first date)."""
    o = paid_orders(ctx.orders).where(F.col("email").isNotNull())
    first = o.groupBy("email").agg(F.min("date").alias("_first"))
    j = o.join(first, "email")
    is_new = F.coalesce(F.col("date") == F.col("_first"), F.lit(False))
    return j.agg(F.coalesce(F.avg(F.when(is_new, F.col("total"))), F.lit(0.0)).alias("new_aov"),
                 F.coalesce(F.avg(F.when(~is_new, F.col("total"))), F.lit(0.0)).alias("returning_aov"))


def discount_impact(ctx) -> DataFrame:
    """Orders with vs without discount (discount > 0, or a coupon when no discount values)."""
    o = paid_orders(ctx.orders)
    has_disc_values = o.agg(F.count("discount") > 0).scalar()
    flag = F.when(has_disc_values, F.coalesce(F.col("discount"), F.lit(0.0)) > 0).otherwise(nonblank("coupon"))
    seg = F.when(flag, "with_discount").otherwise("without_discount")
    agg = o.groupBy(seg.alias("segment")).agg(
        F.count(F.lit(1)).alias("orders"), F.avg("total").alias("aov"), F.sum("total").alias("revenue"))
    both = o.sparkSession.createDataFrame([("with_discount",), ("without_discount",)], "segment string")
    n_all = o.agg(F.count(F.lit(1))).scalar()
    total_disc = o.agg(F.coalesce(F.sum("discount"), F.lit(0.0))).scalar()
    return both.join(agg, "segment", "left").select(
        "segment",
        F.coalesce("orders", F.lit(0)).alias("orders"),
        F.coalesce("aov", F.lit(0.0)).alias("aov"),
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        safe_div(F.coalesce("orders", F.lit(0)) * 100.0, n_all).alias("pct_orders"),
        F.when(has_disc_values, total_disc).otherwise(F.lit(0.0)).alias("total_discount"))


def top_coupons(ctx, k: int = 10) -> DataFrame:
    o = paid_orders(ctx.orders).where(nonblank("coupon"))
    return (o.groupBy("coupon").agg(F.count(F.lit(1)).alias("uses"), F.sum("total").alias("revenue"),
                                    F.avg("total").alias("aov"))
            .orderBy(F.col("revenue").desc(), "coupon").limit(k))


def payment_mix(ctx) -> DataFrame:
    o = ctx.orders.where(nonblank("payment_method"))
    mix = o.groupBy("payment_method").agg(
        F.count("order_id").alias("order_count"), F.sum("total").alias("revenue"),
        F.avg("total").alias("aov"))
    tot = mix.agg(F.sum("order_count").alias("o"), F.sum("revenue").alias("r"))
    return mix.select("*", safe_div(F.col("order_count") * 100.0, tot.select("o").scalar()).alias("pct_orders"),
                      safe_div(F.col("revenue") * 100.0, tot.select("r").scalar()).alias("pct_revenue"))


def payment_mix_monthly(ctx, top: int = 5) -> DataFrame:
    """Orders per month for the top payment methods by revenue."""
    o = ctx.orders.where(nonblank("payment_method"))
    top_methods = (o.groupBy("payment_method").agg(F.sum("total").alias("_rev"))
                   .orderBy(F.col("_rev").desc_nulls_last(), "payment_method").limit(top).select("payment_method"))
    # at most ``top`` rows: a proven bound for broadcast
    sel = o.where(F.col("date").isNotNull()).join(F.broadcast(top_methods), "payment_method", "left_semi")
    return sel.groupBy(month_key("date").alias("month"), "payment_method").agg(F.count(F.lit(1)).alias("count"))


def _valid_dated(ctx) -> DataFrame:
    return ctx.orders.where(F.col("date").isNotNull() & F.col("total").isNotNull())


def season_month(ctx) -> DataFrame:
    o = _valid_dated(ctx)
    names = F.array(*[F.lit(x) for x in MONTH_NAMES])
    return (o.groupBy(F.month("date").alias("month_num"))
            .agg(F.sum("total").alias("revenue"), F.count(F.lit(1)).alias("orders"))
            .select("month_num", F.element_at(names, F.col("month_num")).alias("month"), "revenue", "orders"))


def season_dow(ctx) -> DataFrame:
    o = _valid_dated(ctx)
    names = F.array(*[F.lit(x) for x in DAY_NAMES])
    return (o.groupBy(weekday_mon0("date").alias("dow"))
            .agg(F.sum("total").alias("revenue"), F.count(F.lit(1)).alias("orders"))
            .select("dow", F.element_at(names, F.col("dow") + 1).alias("day"), "revenue", "orders"))


def season_hour(ctx) -> DataFrame:
    """Revenue and orders by hour, only when some order carries a time of day."""
    o = _valid_dated(ctx)
    has_hours = o.agg(F.coalesce(F.sum(F.hour("date")), F.lit(0)) > 0).scalar()
    return (o.where(has_hours).groupBy(F.hour("date").alias("hour"))
            .agg(F.sum("total").alias("revenue"), F.count(F.lit(1)).alias("orders")))


def season_peaks(ctx) -> DataFrame:
    """Peak and low month by revenue, peak weekday by orders (first in calendar order on ties)."""
    m = season_month(ctx)
    d = season_dow(ctx)
    peak = m.orderBy(F.col("revenue").desc(), "month_num").select("month").limit(1)
    low = m.orderBy(F.col("revenue").asc(), "month_num").select("month").limit(1)
    day = d.orderBy(F.col("orders").desc(), "dow").select("day").limit(1)
    return m.sparkSession.range(1).select(peak.scalar().alias("peak_month"), low.scalar().alias("low_month"),
                                          day.scalar().alias("peak_day"))


def revenue_by_channel(ctx, min_channels: int = 2) -> DataFrame:
    o = ctx.orders.where(nonblank("channel"))
    st = o.groupBy("channel").agg(F.sum("total").alias("revenue"),
                                  F.count("order_id").alias("orders"), F.avg("total").alias("aov"))
    n = st.agg(F.count(F.lit(1))).scalar()
    tot = st.agg(F.sum("revenue")).scalar()
    return st.where(n >= min_channels).select("*", safe_div(F.col("revenue") * 100.0, tot).alias("pct"))


def _monthly_series(ctx) -> DataFrame:
    """(idx, month, revenue) over present months, idx 0-based in month order."""
    m = _monthly(ctx.orders).select("month", "revenue")
    # months are a small bounded set; the ordered window holds one row per month
    return m.withColumn("idx", F.row_number().over(Window.orderBy("month")) - 1)


def forecast(ctx, horizon: int = 6, min_months: int = 6) -> DataFrame:
    """Six months ahead: mean of the clipped linear trend and a 3-month SMA that feeds on earlier forecasts.

    The SMA uses the rounded (2 decimals) earlier forecasts, as the reference
    does; the recursion runs inside one ``aggregate`` over ``sequence(1, h)``.
    """
    s = _monthly_series(ctx)
    x, y = F.col("idx").cast("double"), F.col("revenue")
    # months are a bounded set, so the last three values can ride in the same one-row aggregate
    fit = s.agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.max("month").alias("last_month"),
        F.transform(F.slice(F.sort_array(F.collect_list(F.struct("idx", "revenue"))), -3, 3),
                    lambda e: e["revenue"]).alias("hist"))
    n = F.col("n").cast("double")
    slope = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / (n * F.col("sxx") - F.col("sx") * F.col("sx"))
    fit = fit.where(F.col("n") >= min_months).select("*", slope.alias("m"))
    fit = fit.select("*", ((F.col("sy") - F.col("m") * F.col("sx")) / n).alias("b"))
    m_s, b_s = fit.select("m").scalar(), fit.select("b").scalar()
    std = s.agg(F.stddev_pop(y - (m_s * x + b_s)).alias("sd"))
    base = fit.select("n", "m", "b", "last_month", "hist", std.select("sd").scalar().alias("sd"))

    # state: array of blended (rounded) forecasts; each step appends one value
    def step(acc, i):
        pred = F.greatest(F.col("m") * (F.col("n") - 1 + i) + F.col("b"), F.lit(0.0))
        window = F.slice(F.concat(F.col("hist"), acc), -3, 3)
        sma = F.aggregate(window, F.lit(0.0), lambda a, v: a + v) / F.size(window)
        return F.concat(acc, F.array(F.round((pred + sma) / 2, 2)))

    steps = F.sequence(F.lit(1), F.lit(horizon))
    seq = F.aggregate(steps, F.array().cast("array<double>"), step)
    out = base.select("*", F.posexplode(seq).alias("_i", "predicted"))
    month0 = F.to_date(F.concat(F.col("last_month"), F.lit("-01")))
    # lower/upper use the unrounded blend, recomputed from the same rounded history
    return out.select(
        F.date_format(F.add_months(month0, F.col("_i") + 1), "yyyy-MM").alias("month"),
        F.col("predicted"),
        F.greatest(F.col("predicted") - F.col("sd"), F.lit(0.0)).alias("lower"),
        (F.col("predicted") + F.col("sd")).alias("upper"))


def forecast_history(ctx, months: int = 12, min_months: int = 6) -> DataFrame:
    s = _monthly_series(ctx)
    x, y = F.col("idx").cast("double"), F.col("revenue")
    fit = s.agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
                F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"))
    n = F.col("n").cast("double")
    slope = fit.select(((n * F.col("sxy") - F.col("sx") * F.col("sy")) /
                        (n * F.col("sxx") - F.col("sx") * F.col("sx"))).alias("m"),
                       F.col("n")).where(F.col("n") >= min_months)
    m = slope.select("m").scalar()
    last = s.withColumn("_r", F.row_number().over(Window.orderBy(F.col("idx").desc()))).where(F.col("_r") <= months)
    return last.where(m.isNotNull()).select(
        "month", "revenue", m.alias("trend_slope"),
        F.when(m > 0, "up").when(m < 0, "down").otherwise("flat").alias("trend_direction"))
