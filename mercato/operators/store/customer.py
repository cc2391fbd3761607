"""Customer operators: RFM, lifetime value, cohorts, repurchase, churn, VIPs, upgrades, clusters."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.core import month_key, month_start, months_between_periods, nonblank, safe_div, whole_days
from mercato.functions.lloyd import centres, nearest, on_grid
from mercato.functions.ranking import day_gaps, exact_quantiles, quantile_bin, quantile_bins
from mercato.operators.store.orders import customer_orders

# Segment and tier labels of the store report.
CLV_LABELS = ['Low', 'Medium', 'High', 'Very High']
CLUSTER_LABELS = ['High Value', 'Medium-High', 'Medium-Low', 'Low Value']


def _segment(r, f, m):
    """RFM segment rules, evaluated in this order (first match wins)."""
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
            .when((r >= 3) & (f >= 3) & (m >= 3), "Loyal")
            .when((r >= 3) & (f <= 2), "Potential Loyal")
            .when((r >= 4) & (f == 1), "New")
            .when((r == 3) & (f == 1), "Promising")
            .when((r == 2) & (f >= 2) & (f <= 3), "Need Attention")
            .when((r == 2) & (f >= 1) & (f <= 2), "About to Sleep")
            .when((r <= 2) & (f >= 3), "At Risk")
            .when((r == 1) & (f >= 4), "Can't Lose")
            .when((r <= 2) & (f <= 2) & (m <= 2), "Hibernating")
            .when((r == 1) & (f == 1), "Lost")
            .otherwise("Other"))


def rfm_table(ctx, min_orders: int = 50) -> DataFrame:
    o = ctx.orders.where(nonblank("email") & F.col("date").isNotNull()
                         & F.col("total").isNotNull() & (F.col("total") > 0))
    head = o.agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last")).first()  # one driver-side row
    n_orders = head["n"]
    ref = F.lit(head["last"]).cast("timestamp") + F.make_interval(days=F.lit(1))
    c = o.groupBy("email").agg(
        whole_days(ref, F.max("date")).alias("recency"),
        F.count("order_id").alias("frequency"),
        F.sum("total").alias("monetary"))
    if n_orders < min_orders:
        return c.where(F.lit(False)).select("*", *[F.lit(None).cast("int").alias(x) for x in
                                                   ("recency_score", "frequency_score", "monetary_score")],
                                            F.lit(None).cast("string").alias("segment"))
    c = quantile_bins(c, [("recency", 5, "recency_score", True), ("frequency", 5, "frequency_score", False),
                          ("monetary", 5, "monetary_score", False)], key="email")
    return c.withColumn("segment", _segment(F.col("recency_score"), F.col("frequency_score"),
                                            F.col("monetary_score")))


def rfm_scores(ctx, min_orders: int = 50) -> DataFrame:
    return rfm_table(ctx, min_orders).select(
        "email", "recency", "frequency", "monetary", "recency_score", "frequency_score",
        "monetary_score", "segment")


def rfm_segments(ctx, min_orders: int = 50) -> DataFrame:
    r = rfm_table(ctx, min_orders)
    n = r.agg(F.count(F.lit(1))).scalar()
    return r.groupBy("segment").agg(
        F.count(F.lit(1)).alias("count"), F.avg("recency").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"), F.avg("monetary").alias("avg_monetary")
    ).select("*", safe_div(F.col("count") * 100.0, n).alias("pct"))


def clv_table(ctx) -> DataFrame:
    o = customer_orders(ctx.orders)
    c = o.groupBy("email").agg(
        F.sum("total").alias("total_revenue"), F.count("order_id").alias("order_count"),
        F.min("date").alias("_first"), F.max("date").alias("_last"))
    c = c.select("*", (F.col("total_revenue") / F.col("order_count")).alias("aov"),
                 whole_days("_last", "_first").alias("lifespan_days"))
    gap = F.when(F.col("order_count") > 1, F.col("lifespan_days") / (F.col("order_count") - 1))
    freq = F.when(gap.isNotNull() & (gap > 0), 365 / gap).otherwise(F.col("order_count").cast("double"))
    return c.select("*", gap.alias("avg_days_between"), freq.alias("freq_per_year")).withColumn(
        "clv_3y", F.col("aov") * F.col("freq_per_year") * 3)


def clv(ctx) -> DataFrame:
    """Customer lifetime value over 3 years: account-level means and median."""
    c = clv_table(ctx)
    med = exact_quantiles(c, "clv_3y", [0.5], prefix="m").select("m0").scalar()
    return c.agg(F.count(F.lit(1)).alias("total_customers"), F.avg("clv_3y").alias("avg_clv"),
                 F.avg("aov").alias("avg_aov"), F.avg("order_count").alias("avg_orders"),
                 F.avg("lifespan_days").alias("avg_lifespan_days")).select(
        "total_customers", "avg_clv", med.alias("median_clv"), "avg_aov", "avg_orders", "avg_lifespan_days")


def clv_top(ctx, k: int = 10) -> DataFrame:
    return (clv_table(ctx).select("email", "total_revenue", "order_count", "aov", "clv_3y")
            .orderBy(F.col("clv_3y").desc(), "email").limit(k))


def clv_quartiles(ctx) -> DataFrame:
    c = quantile_bin(clv_table(ctx), "clv_3y", 4, key="email", out="_q")
    labels = F.array(*[F.lit(x) for x in CLV_LABELS])
    return c.groupBy("_q").agg(
        F.count(F.lit(1)).alias("count"), F.avg("clv_3y").alias("avg_clv"),
        F.avg("aov").alias("avg_aov"), F.avg("order_count").alias("avg_orders")
    ).select(F.element_at(labels, F.col("_q")).alias("clv_quartile"), "count", "avg_clv", "avg_aov", "avg_orders")


def _cohort_counts(ctx) -> DataFrame:
    o = ctx.orders.where(F.col("email").isNotNull() & F.col("date").isNotNull())
    cm = o.select("email", month_start("date").alias("_m")).distinct()
    # one row per customer-month: the calendar bounds each customer's window partition
    j = cm.withColumn("_cohort", F.min("_m").over(Window.partitionBy("email")))
    return (j.groupBy("_cohort", months_between_periods("_m", "_cohort").alias("months_since"))
            .agg(F.count(F.lit(1)).alias("customers")))


def cohort_matrix(ctx, cohorts: int = 12, max_offset: int = 12) -> DataFrame:
    """Retention % per (cohort month, months since first order) for the last cohorts; empty cells 0."""
    counts = _cohort_counts(ctx)
    sizes = counts.where(F.col("months_since") == 0).select("_cohort", F.col("customers").alias("cohort_size"))
    last = sizes.orderBy(F.col("_cohort").desc()).limit(cohorts)
    present = counts.where(F.col("months_since") <= max_offset).select("months_since").distinct()
    grid = (last.select("_cohort", "cohort_size",
                        F.explode(F.sequence(F.lit(0), F.lit(max_offset))).alias("months_since"))
            # at most max_offset + 1 offsets: a proven bound
            .join(F.broadcast(present), "months_since", "left_semi"))
    cells = grid.join(counts, ["_cohort", "months_since"], "left")
    cust = F.coalesce(F.col("customers"), F.lit(0))
    return cells.select(month_key("_cohort").alias("cohort"), "months_since", cust.alias("customers"),
                        "cohort_size", (cust * 100.0 / F.col("cohort_size")).alias("retention_pct"))


def cohort_curve(ctx, cohorts: int = 12, max_offset: int = 12) -> DataFrame:
    m = cohort_matrix(ctx, cohorts, max_offset)
    return m.groupBy("months_since").agg(F.avg("retention_pct").alias("avg_retention_pct"))


def _order_counts(ctx) -> DataFrame:
    o = ctx.orders.where(F.col("email").isNotNull() & F.col("date").isNotNull())
    return o.groupBy("email").agg(F.count("order_id").alias("order_count"))


def repurchase(ctx) -> DataFrame:
    c = _order_counts(ctx)
    return c.agg(F.count(F.lit(1)).alias("total_customers"),
                 F.count(F.when(F.col("order_count") >= 2, 1)).alias("repeat_customers")).select(
        "*", safe_div(F.col("repeat_customers") * 100.0, F.col("total_customers")).alias("repurchase_rate"))


def order_count_distribution(ctx, k: int | None = None) -> DataFrame:
    c = _order_counts(ctx)
    out = c.groupBy(F.col("order_count").alias("orders")).agg(F.count(F.lit(1)).alias("customers"))
    return out if k is None else out.orderBy("orders").limit(k)


def purchase_gaps(ctx) -> DataFrame:
    """Whole days between consecutive orders of a customer (> 0): median, mean, quartiles.

    Equal timestamps give 0-day gaps that are dropped, so the gaps over
    distinct (customer, timestamp) pairs are the same set.
    """
    gaps = day_gaps(ctx.orders.where(F.col("email").isNotNull()), "email", "date", whole_days)
    q = exact_quantiles(gaps, "gap", [0.5, 0.25, 0.75], prefix="q")
    mean = gaps.agg(F.avg("gap")).scalar()
    return q.select(F.col("q0").alias("median_days"), mean.alias("mean_days"),
                    F.col("q1").alias("p25_days"), F.col("q2").alias("p75_days"))


def _upgrades(ctx) -> DataFrame:
    """First-half and second-half mean ticket of customers with three orders or more (orders by date, then id).

    A customer's days are counted before the shuffle and numbered by a window bounded by the calendar; single orders
    are numbered only within the day that the middle falls into.
    """
    o = customer_orders(ctx.orders).select("email", "date", "order_id", "total", F.to_date("date").alias("_day"))
    days = o.groupBy("email", "_day").agg(F.count(F.lit(1)).alias("_k"), F.sum("total").alias("_s"))
    run = F.sum("_k").over(Window.partitionBy("email").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0))
    days = days.select("*", run.alias("_to"), F.sum("_k").over(Window.partitionBy("email")).alias("_n")).where(F.col("_n") >= 3)
    early = F.greatest(F.lit(0), F.least(F.col("_k"), F.floor(F.col("_n") / 2) - (F.col("_to") - F.col("_k"))))
    days = days.withColumn("_early", early)
    split = days.where("_early > 0 and _early < _k").select("email", "_day", "_early")  # at most one day a customer
    nth = F.row_number().over(Window.partitionBy("email", "_day").orderBy("date", "order_id"))
    within = o.join(split, ["email", "_day"]).select("email", "total", (nth <= F.col("_early")).alias("_first"))
    halves = days.where("_early = 0 or _early = _k").select("email", "_k", "_s", (F.col("_early") > 0).alias("_first")).unionByName(
        within.select("email", F.lit(1).cast("long").alias("_k"), F.col("total").alias("_s"), "_first"))

    def mean(first: bool):
        mine = F.col("_first") == first
        return F.sum(F.when(mine, F.col("_s"))) / F.sum(F.when(mine, F.col("_k")))
    u = halves.groupBy("email").agg(mean(True).alias("first_half_aov"), mean(False).alias("second_half_aov"))
    u = u.where(F.col("first_half_aov") > 0)
    return u.withColumn("change_pct", (F.col("second_half_aov") - F.col("first_half_aov"))
                        / F.col("first_half_aov") * 100)


def upgrade_pattern(ctx, threshold: float = 20.0) -> DataFrame:
    u = _upgrades(ctx)
    up = F.col("change_pct") > threshold
    return u.agg(F.count(F.lit(1)).alias("total_analyzed"), F.count(F.when(up, 1)).alias("upgraders"),
                 F.count(F.when(F.col("change_pct") < -threshold, 1)).alias("downgraders"),
                 F.coalesce(F.avg(F.when(up, F.col("change_pct"))), F.lit(0.0)).alias("avg_upgrade_pct")).select(
        "total_analyzed", "upgraders", safe_div(F.col("upgraders") * 100.0, F.col("total_analyzed")).alias("upgrader_pct"),
        "downgraders", "avg_upgrade_pct")


def top_upgraders(ctx, threshold: float = 20.0, k: int = 10) -> DataFrame:
    return (_upgrades(ctx).where(F.col("change_pct") > threshold)
            .orderBy(F.col("change_pct").desc(), "email").limit(k))


def _vip(ctx, quantile: float = 0.9):
    o = ctx.orders.where(F.col("email").isNotNull() & (F.col("total") > 0))
    c = o.groupBy("email").agg(F.sum("total").alias("revenue"), F.count("order_id").alias("orders"),
                               F.avg("total").alias("aov"))
    cut = exact_quantiles(c, "revenue", [quantile], prefix="c").select("c0").scalar()
    return c, c.where(F.col("revenue") >= cut)


def vip_customers(ctx, k: int = 15) -> DataFrame:
    _, v = _vip(ctx)
    return v.orderBy(F.col("revenue").desc(), "email").limit(k)


def vip_summary(ctx) -> DataFrame:
    c, v = _vip(ctx)
    tot = c.agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("r"))
    return v.agg(F.count(F.lit(1)).alias("vip_count"), F.sum("revenue").alias("vip_revenue"),
                 F.avg("orders").alias("avg_orders"), F.avg("aov").alias("avg_aov")).select(
        "vip_count", safe_div(F.col("vip_count") * 100.0, tot.select("n").scalar()).alias("vip_pct"),
        "vip_revenue", safe_div(F.col("vip_revenue") * 100.0, tot.select("r").scalar()).alias("vip_revenue_pct"),
        "avg_orders", "avg_aov")


def vip_products(ctx, k: int = 10) -> DataFrame:
    _, v = _vip(ctx)
    sel = ctx.lines.join(v.select("email"), "email", "left_semi").where(F.col("product_name").isNotNull())
    return (sel.groupBy("product_name").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "product_name").limit(k))


def vip_states(ctx, k: int = 10) -> DataFrame:
    _, v = _vip(ctx)
    o = ctx.orders.where(F.col("email").isNotNull() & (F.col("total") > 0) & F.col("state").isNotNull())
    sel = o.join(v.select("email"), "email", "left_semi")
    return (sel.groupBy("state").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "state").limit(k))


def _churn(ctx, default_interval: float = 90.0, floor_days: float = 60.0):
    o = ctx.orders.where(F.col("email").isNotNull() & F.col("date").isNotNull())
    max_date = o.agg(F.max("date")).scalar()
    c = o.groupBy("email").agg(F.count("order_id").alias("order_count"),
                               F.max("date").alias("_last"), F.min("date").alias("_first"))
    rep = c.where(F.col("order_count") >= 2).select(
        (whole_days("_last", "_first") / (F.col("order_count") - 1)).alias("avg_interval"))
    med = exact_quantiles(rep, "avg_interval", [0.5], prefix="m").select("m0").scalar()
    interval = F.coalesce(med, F.lit(default_interval))
    threshold = F.greatest(interval * 2, F.lit(floor_days))
    c = c.withColumn("days_since_last", whole_days(max_date, "_last")).withColumn(
        "is_churned", F.col("days_since_last") > threshold)
    return c, interval, threshold


def churn(ctx) -> DataFrame:
    c, interval, threshold = _churn(ctx)
    return c.agg(F.count(F.lit(1)).alias("total_customers"),
                 F.count(F.when(F.col("is_churned"), 1)).alias("churned"),
                 F.count(F.when(~F.col("is_churned"), 1)).alias("active")).select(
        "total_customers", "churned", safe_div(F.col("churned") * 100.0, F.col("total_customers")).alias("churn_rate"),
        "active", threshold.alias("churn_threshold_days"), interval.alias("avg_purchase_interval"))


def churn_products(ctx, k: int = 10) -> DataFrame:
    c, _, _ = _churn(ctx)
    churned = c.where("is_churned").select("email")
    sel = ctx.lines.where(F.col("product_name").isNotNull()).join(churned, "email", "left_semi")
    return (sel.groupBy("product_name").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "product_name").limit(k))


FEATURES = ["_f0", "_f1", "_f2", "_f3"]


def customer_features(ctx) -> DataFrame:
    """Spend, orders, AOV and recency per customer, and the four on the 0..1 grid (min-max over all customers)."""
    o = customer_orders(ctx.orders)
    max_date = o.agg(F.max("date")).scalar()
    c = o.groupBy("email").agg(F.sum("total").alias("total_spend"), F.count("order_id").alias("order_count"),
                               F.avg("total").alias("aov"), F.max("date").alias("_last"))
    c = c.withColumn("days_since_last", whole_days(max_date, "_last")).drop("_last")
    names = ["total_spend", "order_count", "aov", "days_since_last"]
    ends = c.agg(F.struct(*[F.struct(F.min(f).alias("low"), F.max(f).alias("high")).alias(f) for f in names])).scalar()
    return c.select("*", *[on_grid(F.col(f), ends[f]["low"], ends[f]["high"]).alias(x) for f, x in zip(names, FEATURES)])


def niche_clusters(ctx, max_k: int = 4, min_customers: int = 20) -> DataFrame:
    """k-means on min-max scaled spend, orders, AOV and recency; profile per cluster (clusters without customers left out).

    Every round reads the features again, so they are kept until the profile, at most ``max_k`` rows, is done.
    """
    x = customer_features(ctx).persist(StorageLevel.MEMORY_AND_DISK)
    n = x.count()
    k = max(2, min(max_k, n // 5))
    found = centres(x, "email", FEATURES, [k])[0] if n >= min_customers else [[0.0] * len(FEATURES)] * 2
    prof = x.groupBy(nearest(FEATURES, found).alias("cluster")).agg(
        F.count(F.lit(1)).alias("size"), F.avg("total_spend").alias("avg_spend"),
        F.avg("order_count").alias("avg_orders"), F.avg("aov").alias("avg_aov"),
        F.avg("days_since_last").alias("avg_recency"))
    # k profile rows: the ranking window is bounded
    rank = F.row_number().over(Window.orderBy(F.col("avg_spend").desc(), "cluster"))
    labels = F.array(*[F.lit(x) for x in CLUSTER_LABELS])
    out = prof.select(
        "cluster", "size", (F.col("size") * 100.0 / F.lit(max(n, 1))).alias("pct"), "avg_spend", "avg_orders", "avg_aov", "avg_recency",
        F.coalesce(F.try_element_at(labels, rank), F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))).alias("label")
    ).where(F.lit(n >= min_customers))
    done = ctx.spark.createDataFrame(out.collect(), out.schema)
    x.unpersist()
    return done
