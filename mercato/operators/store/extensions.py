"""Store analyses the report catalogue specifies beyond the scripted ones."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.core import line_revenue, month_key, month_start, nonblank, safe_div, whole_days
from mercato.functions.lloyd import GRID, centres, distances
from mercato.functions.ranking import day_gaps, exact_quantiles, rows_within_share
from mercato.functions.text import category, variant_base
from mercato.operators.store import customer as cu

# Catalogue thresholds.
GAP_SEGMENTS = [(30, 'frequent'), (90, 'occasional')]  # median gap < 30, < 90, else sporadic


def pareto_cutoffs(ctx, shares: tuple = (70, 80, 90)) -> DataFrame:
    """Products needed to reach 70 / 80 / 90 % of revenue."""
    l = ctx.lines.where(F.col("product_name").isNotNull())
    p = l.groupBy("product_name").agg(F.sum(line_revenue()).alias("revenue"))
    n = p.agg(F.count(F.lit(1))).scalar()
    need = F.least(F.col("rows") + 1, n)
    return rows_within_share(p, "revenue", list(shares)).select("share", need.alias("products_needed"), (need * 100.0 / n).alias("pct_products"))


def gap_segments(ctx) -> DataFrame:
    """Customers by their median whole-day gap between orders: frequent / occasional / sporadic."""
    gaps = day_gaps(ctx.orders.where(F.col("email").isNotNull()), "email", "date", whole_days)
    med = exact_quantiles(gaps, "gap", [0.5], by=["email"], prefix="m")
    seg = F.when(F.col("m0") < GAP_SEGMENTS[0][0], GAP_SEGMENTS[0][1]).when(
        F.col("m0") < GAP_SEGMENTS[1][0], GAP_SEGMENTS[1][1]).otherwise("sporadic")
    return med.groupBy(seg.alias("segment")).agg(F.count(F.lit(1)).alias("customers"),
                                                 F.avg("m0").alias("avg_median_gap"))


def category_monthly(ctx, top: int = 10) -> DataFrame:
    l = ctx.lines.where(F.col("product_name").isNotNull()).withColumn("category", category("product_name"))
    l = l.withColumn("_rev", line_revenue())
    best = l.groupBy("category").agg(F.sum("_rev").alias("_t")).orderBy(F.col("_t").desc(), "category").limit(top)
    sel = l.where(F.col("date").isNotNull()).join(F.broadcast(best.select("category")), "category", "left_semi")
    return sel.groupBy(month_key("date").alias("month"), "category").agg(F.sum("_rev").alias("revenue"))


def shipping_correlation(ctx, flag_pct: float = 15.0) -> DataFrame:
    """Per state: mean shipping, orders, shipping as % of the mean ticket (flag > 15 %); Pearson r across states."""
    o = ctx.orders.where(nonblank("state"))
    g = o.groupBy("state").agg(F.avg("shipping_cost").alias("avg_shipping"),
                               F.count("order_id").alias("orders"), F.avg("total").alias("avg_total"))
    r = g.agg(F.corr("avg_shipping", F.col("orders").cast("double"))).scalar()
    pct = safe_div(F.col("avg_shipping") * 100, "avg_total")
    return g.select("state", "avg_shipping", "orders", pct.alias("shipping_pct_of_ticket"),
                    (pct > flag_pct).alias("flagged"), r.alias("corr_cost_volume"))


def season_index(ctx) -> DataFrame:
    o = ctx.orders.where(F.col("date").isNotNull() & F.col("total").isNotNull())
    m = o.groupBy(F.month("date").alias("month_num")).agg(F.sum("total").alias("revenue"))
    mean = m.agg(F.avg("revenue")).scalar()
    return m.select("month_num", "revenue", safe_div(F.col("revenue"), mean).alias("season_index"))


def sku_concentration(ctx) -> DataFrame:
    l = ctx.lines.where(nonblank("sku") & F.col("product_name").isNotNull())
    v = l.withColumn("base", variant_base("product_name")).groupBy("base", "sku").agg(
        F.sum(line_revenue()).alias("revenue"))
    g = v.groupBy("base").agg(F.count(F.lit(1)).alias("skus"), F.max("revenue").alias("_top"),
                              F.sum("revenue").alias("_all"))
    return g.where("skus >= 2").select("base", "skus", (safe_div("_top", "_all") * 100).alias("top_variant_share_pct"))


def lifecycle_slope(ctx, min_months: int = 6) -> DataFrame:
    """Slope of the last three present months' revenue (and per cent of their mean), peak month, stage."""
    l = ctx.lines.where(F.col("product_name").isNotNull() & F.col("date").isNotNull())
    mon = l.groupBy("product_name", month_start("date").alias("_m")).agg(F.sum(line_revenue()).alias("_rev"))
    # one row per active month of a product: the calendar bounds each window partition
    w = Window.partitionBy("product_name")
    mon = mon.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= min_months)
    mon = mon.withColumn("_r", F.row_number().over(w.orderBy(F.col("_m").desc())))
    last3 = mon.where("_r <= 3").withColumn("_x", (3 - F.col("_r")).cast("double"))
    fit = last3.groupBy("product_name").agg(F.regr_slope("_rev", "_x").alias("slope"), F.avg("_rev").alias("_mean"))
    peak = mon.groupBy("product_name").agg(
        F.max_by(month_key("_m"), F.struct(F.col("_rev"), -F.unix_date("_m"))).alias("peak_month"))
    pct = safe_div(F.col("slope") * 100, "_mean")
    stage = (F.when(pct > 10, "Growth").when(F.abs(pct) < 5, "Maturity").when(pct < -10, "Decline")
             .otherwise("Transition"))
    return fit.join(peak, "product_name").select("product_name", "slope", pct.alias("slope_pct"), "peak_month",
                                                 stage.alias("stage"))


def upgrade_tenure_corr(ctx) -> DataFrame:
    u = cu._upgrades(ctx)
    o = ctx.orders.where(F.col("email").isNotNull() & F.col("date").isNotNull() & (F.col("total") > 0))
    t = o.groupBy("email").agg(whole_days(F.max("date"), F.min("date")).alias("tenure_days"))
    j = u.join(t, "email")
    return j.agg(F.count(F.lit(1)).alias("customers"),
                 F.corr(F.col("tenure_days").cast("double"), "change_pct").alias("corr_tenure_change"))


def vip_vs_rest(ctx) -> DataFrame:
    c, v = cu._vip(ctx)
    flagged = c.join(v.select("email", F.lit(True).alias("_v")), "email", "left")
    seg = F.when(F.col("_v"), "vip").otherwise("rest")
    return flagged.groupBy(seg.alias("segment")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("revenue").alias("avg_revenue"),
        F.avg("orders").alias("avg_orders"), F.avg("aov").alias("avg_aov"))


def churn_by_cohort(ctx) -> DataFrame:
    c, _, _ = cu._churn(ctx)
    g = c.groupBy(month_key("_first").alias("cohort")).agg(
        F.count(F.lit(1)).alias("customers"), F.count(F.when(F.col("is_churned"), 1)).alias("churned"))
    return g.select("*", (F.col("churned") * 100.0 / F.col("customers")).alias("churn_rate"))


def last_product(ctx, k: int = 10) -> DataFrame:
    """The product of each churned customer's latest line (latest date, then last line), counted."""
    c, _, _ = cu._churn(ctx)
    churned = c.where("is_churned").select("email")
    l = ctx.lines.where(F.col("product_name").isNotNull() & F.col("date").isNotNull()).join(churned, "email",
                                                                                             "left_semi")
    # line numbers may repeat within an order: the product name breaks the remaining ties
    order = (F.struct("date", "order_id", "line_no", "product_name") if "line_no" in l.columns
             else F.struct("date", "order_id", "product_name"))
    last = l.groupBy("email").agg(F.max_by("product_name", order).alias("product_name"))
    return (last.groupBy("product_name").agg(F.count(F.lit(1)).alias("customers"))
            .orderBy(F.col("customers").desc(), "product_name").limit(k))


def dominant_method(ctx, share: float = 80.0) -> DataFrame:
    o = ctx.orders.where(F.col("shipping_method").isNotNull() & F.col("state").isNotNull())
    g = o.groupBy("state", "shipping_method").agg(F.count(F.lit(1)).alias("orders"))
    t = g.groupBy("state").agg(F.sum("orders").alias("_tot"),
                               F.max_by("shipping_method", F.struct("orders", F.col("shipping_method"))).alias("method"),
                               F.max("orders").alias("_top"))
    pct = F.col("_top") * 100.0 / F.col("_tot")
    return t.select("state", "method", pct.alias("share_pct"), (pct > share).alias("dominant"))


def channel_repeat_rate(ctx) -> DataFrame:
    o = ctx.orders.where(nonblank("channel") & F.col("email").isNotNull())
    per = o.groupBy("channel", "email").agg(F.count("order_id").alias("_n"))
    g = per.groupBy("channel").agg(F.count(F.lit(1)).alias("customers"),
                                   F.count(F.when(F.col("_n") >= 2, 1)).alias("repeat_customers"))
    return g.select("*", (F.col("repeat_customers") * 100.0 / F.col("customers")).alias("repeat_rate"))


def free_threshold(ctx, q: float = 0.1) -> DataFrame:
    o = ctx.orders.where((F.col("total") > 0) & (F.coalesce(F.col("shipping_cost"), F.lit(0.0)) == 0))
    p = exact_quantiles(o, "total", [q], prefix="p")
    return p.select(F.col("p0").alias("p10_ticket_free_shipping"), F.col("_n").alias("free_orders"))


def forecast_quality(ctx) -> DataFrame:
    """Fit quality of the linear trend on monthly revenue: MAE, MAPE, R^2."""
    from mercato.operators.store.revenue import _monthly_series
    s = _monthly_series(ctx)
    x, y = F.col("idx").cast("double"), F.col("revenue")
    fit = s.agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
                F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.avg(y).alias("my"))
    n = F.col("n").cast("double")
    m = fit.select(((n * F.col("sxy") - F.col("sx") * F.col("sy")) / (n * F.col("sxx") - F.col("sx") * F.col("sx")))
                   .alias("m"), "sx", "sy", "n", "my").where("n >= 6")
    ms = m.select("m").scalar()
    bs = m.select(((F.col("sy") - F.col("m") * F.col("sx")) / F.col("n")).alias("b")).scalar()
    my = m.select("my").scalar()
    e = s.select((y - (ms * x + bs)).alias("e"), y.alias("y"))
    return e.agg(F.avg(F.abs("e")).alias("mae"),
                 F.avg(F.when(F.col("y") > 0, F.abs("e") / F.col("y"))).alias("mape"),
                 (1 - F.sum(F.col("e") * F.col("e")) / F.sum((F.col("y") - my) * (F.col("y") - my))).alias("r_squared")
                 ).where(ms.isNotNull())


def high_aov_low_volume(ctx) -> DataFrame:
    """Cities whose mean ticket is in the top quarter while their order count is in the bottom quarter."""
    o = ctx.orders.where(nonblank("city"))
    g = o.groupBy("city").agg(F.avg("total").alias("aov"), F.count("order_id").alias("orders"),
                              F.sum("total").alias("revenue"))
    qa = exact_quantiles(g, "aov", [0.75], prefix="a").select("a0").scalar()
    qo = exact_quantiles(g, "orders", [0.25], prefix="o").select("o0").scalar()
    return g.where((F.col("aov") >= qa) & (F.col("orders") <= qo))


def size_pairs(ctx, k: int = 15) -> DataFrame:
    """Sizes bought together in one order (top pairs by orders)."""
    from mercato.functions.text import extract_size
    from mercato.operators.store.basket import order_items, top_pairs
    items = order_items(ctx.lines.where(F.col("product_name").isNotNull()), extract_size("product_name", "sku"))
    return (top_pairs(items, k).select(F.col("item_a").alias("size_a"), F.col("item_b").alias("size_b"), "count"))


def price_elasticity(ctx, min_prices: int = 3) -> DataFrame:
    """Per product with at least three distinct monthly mean prices: mean of (%change qty / %change price)
    between consecutive present months whose price changed."""
    l = ctx.lines.where(F.col("product_name").isNotNull() & F.col("date").isNotNull() & (F.col("product_price") > 0))
    m = l.groupBy("product_name", month_start("date").alias("_m")).agg(
        # exact decimal means: equal price points compare equal regardless of summation order
        F.avg(F.col("product_price").cast("decimal(20,8)")).cast("double").alias("price"), F.coalesce(F.sum("product_qty"), F.lit(0)).alias("qty"))
    # one row per product month: the calendar bounds each window partition
    w = Window.partitionBy("product_name").orderBy("_m")
    m = m.withColumn("_pp", F.lag("price").over(w)).withColumn("_pq", F.lag("qty").over(w))
    e = m.where((F.col("_pp") > 0) & (F.col("_pq") > 0) & (F.col("price") != F.col("_pp"))).select(
        "product_name", (((F.col("qty") - F.col("_pq")) / F.col("_pq")) /
                         ((F.col("price") - F.col("_pp")) / F.col("_pp"))).alias("e"))
    prices = m.groupBy("product_name").agg(F.count_distinct("price").alias("prices"))
    g = e.groupBy("product_name").agg(F.avg("e").alias("elasticity"), F.count(F.lit(1)).alias("changes"))
    return g.join(prices, "product_name").where(F.col("prices") >= min_prices)


def kmeans_elbow(ctx, ks: tuple = (3, 4, 5)) -> DataFrame:
    """Within-cluster sum of squares of k-means on the scaled customer features for several k."""
    x = cu.customer_features(ctx).persist(StorageLevel.MEMORY_AND_DISK)
    found = centres(x, "email", cu.FEATURES, list(ks))
    costs = [F.sum((F.least(*d) if len(d) > 1 else d[0] if d else F.lit(0.0)) / F.lit(float(GRID) * GRID))
             for d in (distances(cu.FEATURES, c) for c in found)]
    row = x.agg(F.array(*[F.struct(F.lit(k).alias("k"), c.alias("inertia")) for k, c in zip(ks, costs)]).alias("all"))
    out = row.select(F.explode("all").alias("r")).select("r.*")
    done = ctx.spark.createDataFrame(out.collect(), out.schema)  # one row per k
    x.unpersist()
    return done


def degraded_months(ctx, factor: float = 1.5, max_days: int = 60) -> DataFrame:
    """Median fulfilment days per month against the overall median; a month above ``factor`` times it is degraded.

    Orders are counted once per month and number of days (negative and more than ``max_days`` days left out); these
    few counts give the medians of every month and, summed over the months, of all.
    """
    o = ctx.orders.where(F.col("date").isNotNull() & F.col("shipping_date").isNotNull())
    days = o.select(month_key("date").alias("month"), whole_days("shipping_date", "date").alias("days")).where(
        F.col("days").between(0, max_days))
    counts = days.groupBy("month", "days").agg(F.count(F.lit(1)).alias("orders"))
    both = counts.select(F.explode(F.array(F.col("month"), F.lit(None).cast("string"))).alias("month"), "days", "orders")
    med = exact_quantiles(both, "days", [0.5], by=["month"], prefix="m", weight="orders")
    overall = med.where(F.col("month").isNull()).select("m0").scalar()
    return med.where(F.col("month").isNotNull()).select(
        "month", F.col("_n").alias("orders"), F.col("m0").alias("median_days"), overall.alias("overall_median_days"),
        safe_div("m0", overall).alias("ratio"), (F.col("m0") > overall * factor).alias("degraded"))
