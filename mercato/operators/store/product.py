"""Product operators: ranking, anchors, Pareto, cancellations, categories, variants, lifecycle, pricing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.context import spread
from mercato.functions.core import line_revenue, month_start, nonblank, safe_div, trend_pct
from mercato.functions.ranking import equal_width_bin, exact_quantiles, rows_within_share
from mercato.functions.text import category, extract_color, extract_size, variant_base
from mercato.operators.store.orders import is_cancelled, recent_prior_flags


def _named(ctx) -> DataFrame:
    return ctx.lines.where(F.col("product_name").isNotNull()).withColumn("_rev", line_revenue())


def _dealt(lines: DataFrame, *columns: str) -> DataFrame:
    """Lines dealt by product and order, to tell a product's orders apart.

    The number of tasks follows the lines, so a task's table of orders does not grow with them.
    """
    return spread(lines.select("product_name", "order_id", *columns), "product_name", "order_id", rows=2 * lines.count())


def product_ranking(ctx, k: int = 30) -> DataFrame:
    """Revenue, units, orders, mean price and 3-month trend per product; top by revenue."""
    l = _named(ctx)
    recent, prior = recent_prior_flags(l)
    total = l.agg(F.count_distinct("product_name")).scalar()
    g = _dealt(l, "_rev", "product_qty", "product_price", "date").groupBy("product_name").agg(
        F.sum("_rev").alias("revenue"), F.coalesce(F.sum("product_qty"), F.lit(0)).alias("units"),
        F.count_distinct("order_id").alias("orders"), F.avg("product_price").alias("avg_price"),
        F.coalesce(F.sum(F.when(recent, F.col("_rev"))), F.lit(0.0)).alias("_r"),
        F.coalesce(F.sum(F.when(prior, F.col("_rev"))), F.lit(0.0)).alias("_p"))
    return (g.select("product_name", "revenue", "units", "orders", "avg_price",
                     trend_pct("_r", "_p").alias("trend_pct"), total.alias("total_products"))
            .orderBy(F.col("revenue").desc(), "product_name").limit(k))


def _multi_items(ctx, name_expr=None) -> DataFrame:
    """Distinct (order, item) pairs of orders holding at least two distinct items."""
    items = ctx.lines.where(F.col("product_name").isNotNull() & F.col("order_id").isNotNull()).select(
        "order_id", (name_expr if name_expr is not None else F.trim("product_name")).alias("item")).distinct()
    multi = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("_k")).where("_k >= 2")
    return items.join(multi.select("order_id"), "order_id", "left_semi")


def anchor_products(ctx, k: int = 20, companions: int = 5, min_multi: int = 10) -> DataFrame:
    """Products in the most multi-item orders and their most frequent companions.

    Companion counts come from joining each order's anchor rows (at most ``k``
    per order) to the order's items, so the work is linear in the lines, never
    all pairs of an order.
    """
    m = _multi_items(ctx)
    n_multi = m.agg(F.count_distinct("order_id")).scalar()
    counts = m.groupBy("item").agg(F.count(F.lit(1)).alias("multi_order_count"))
    top = counts.orderBy(F.col("multi_order_count").desc(), "item").limit(k)
    # ``top`` has at most k rows: a proven bound for broadcast
    anchors = m.join(F.broadcast(top.select(F.col("item").alias("anchor"))), F.col("item") == F.col("anchor")) \
        .select("order_id", "anchor")
    comp = (anchors.join(m, "order_id").where(F.col("item") != F.col("anchor"))
            .groupBy("anchor", "item").agg(F.count(F.lit(1)).alias("companion_count")))
    w = Window.partitionBy("anchor").orderBy(F.col("companion_count").desc(), "item")
    comp = comp.withColumn("companion_rank", F.row_number().over(w)).where(F.col("companion_rank") <= companions)
    out = top.withColumnRenamed("item", "anchor").join(comp, "anchor")
    return out.where(n_multi >= min_multi).select(
        F.col("anchor").alias("product"), "multi_order_count", F.col("item").alias("companion"),
        "companion_count", "companion_rank")


def pareto(ctx, k: int = 30, share: float = 80.0) -> DataFrame:
    """Revenue per product in descending order with the running share of total revenue.

    How many products make up the share is followed over histogram bins of the revenue, so a
    catalogue of any size never funnels through one task; only the listed products are numbered.
    """
    l = _named(ctx)
    p = l.groupBy("product_name").agg(F.sum("_rev").alias("revenue"))
    total = p.agg(F.sum("revenue")).scalar()
    n_products = p.agg(F.count(F.lit(1))).scalar()
    within = rows_within_share(p, "revenue", [share]).select("rows").scalar()
    products_80 = F.least(within + 1, n_products)
    order = [F.col("revenue").desc(), F.col("product_name")]
    top = p.orderBy(*order).limit(k)  # the window runs over these k rows
    run = F.sum("revenue").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    top = top.select("*", (run / total * 100).alias("cumulative_pct"))
    return top.where(total > 0).select(
        "product_name", "revenue", (F.col("revenue") / total * 100).alias("pct_of_total"), "cumulative_pct",
        n_products.alias("total_products"), products_80.alias("products_80_pct"),
        (products_80 * 100.0 / n_products).alias("pct_products_80"))


def cancel_by_product(ctx, ratio: float = 2.0, min_orders: int = 5, k: int = 15) -> DataFrame:
    """Products whose cancelled lines per distinct order exceed ``ratio`` x the overall line rate."""
    l = ctx.lines.where(F.col("product_name").isNotNull()).withColumn("_c", is_cancelled().cast("int"))
    overall = l.agg(F.avg("_c")).scalar()
    g = _dealt(l, "_c").groupBy("product_name").agg(F.count_distinct("order_id").alias("total_orders"),
                                                    F.sum("_c").alias("cancelled"))
    g = g.withColumn("cancel_rate", F.col("cancelled") / F.col("total_orders"))
    return (g.where((F.col("cancel_rate") > overall * ratio) & (F.col("total_orders") >= min_orders))
            .select("*", overall.alias("overall_rate"))
            .orderBy(F.col("cancel_rate").desc(), "product_name").limit(k))


def revenue_by_category(ctx, k: int = 20) -> DataFrame:
    l = _named(ctx).withColumn("category", category("product_name"))
    recent, prior = recent_prior_flags(l)
    g = l.groupBy("category").agg(
        F.sum("_rev").alias("revenue"), F.coalesce(F.sum("product_qty"), F.lit(0)).alias("units"),
        F.count_distinct("product_name").alias("products"),
        F.coalesce(F.sum(F.when(recent, F.col("_rev"))), F.lit(0.0)).alias("_r"),
        F.coalesce(F.sum(F.when(prior, F.col("_rev"))), F.lit(0.0)).alias("_p"))
    total = g.agg(F.sum("revenue")).scalar()
    return (g.select("category", "revenue", "units", "products",
                     F.when(total > 0, F.col("revenue") / total * 100).otherwise(F.lit(0.0)).alias("pct"),
                     trend_pct("_r", "_p").alias("trend_pct"))
            .orderBy(F.col("revenue").desc(), "category").limit(k))


def category_distribution(ctx, k: int = 15) -> DataFrame:
    return (ctx.lines.groupBy(category("product_name").alias("category")).agg(F.sum(line_revenue()).alias("revenue"))
            .orderBy(F.col("revenue").desc(), "category").limit(k))


def color_lines(ctx) -> DataFrame:
    return ctx.lines.where(F.col("product_name").isNotNull()).withColumn(
        "color", extract_color("product_name")).where(F.col("color").isNotNull())


def color_distribution(ctx, k: int = 20, min_lines: int = 50) -> DataFrame:
    c = color_lines(ctx)
    n = c.agg(F.count(F.lit(1))).scalar()
    return (c.groupBy("color").agg(F.count(F.lit(1)).alias("count")).where(n >= min_lines)
            .orderBy(F.col("count").desc(), "color").limit(k))


def size_lines(ctx) -> DataFrame:
    return ctx.lines.where(F.col("product_name").isNotNull()).withColumn(
        "size", extract_size("product_name", "sku")).where(F.col("size").isNotNull())


def size_distribution(ctx, min_rows: int = 50) -> DataFrame:
    s = size_lines(ctx)
    n = s.agg(F.count(F.lit(1))).scalar()
    return s.groupBy("size").agg(F.count(F.lit(1)).alias("count")).where(n >= min_rows)


def multi_size_customers(ctx, min_rows: int = 50) -> DataFrame:
    s = size_lines(ctx)
    n = s.agg(F.count(F.lit(1))).scalar()
    per = s.where(F.col("email").isNotNull()).groupBy("email").agg(F.count_distinct("size").alias("_k"))
    return (per.agg(F.count(F.when(F.col("_k") >= 2, 1)).alias("customers_multi_size"),
                    F.count(F.lit(1)).alias("_all"))
            .where((F.col("customers_multi_size") > 0) & (n >= min_rows))
            .select("customers_multi_size", (F.col("customers_multi_size") * 100.0 / F.col("_all")).alias("pct_multi_size")))


def sku_variants(ctx, bases: int | None = None, min_rows: int = 20) -> DataFrame:
    """Per base product with at least two SKUs: SKUs by revenue; ``bases`` shows only the first of them by name."""
    l = ctx.lines.where(nonblank("sku") & F.col("product_name").isNotNull())
    n = l.agg(F.count(F.lit(1))).scalar()
    v = l.withColumn("base", variant_base("product_name")).groupBy("base", "sku").agg(
        F.sum(line_revenue()).alias("revenue"), F.coalesce(F.sum("product_qty"), F.lit(0)).alias("units"),
        F.avg("product_price").alias("avg_price"))
    multi = v.groupBy("base").agg(F.count(F.lit(1)).alias("_k")).where("_k >= 2")
    chosen = (multi if bases is None else multi.orderBy("base").limit(bases)).select("base")
    sel = v.join(chosen, "base", "left_semi").where(n >= min_rows)
    w = Window.partitionBy("base").orderBy(F.col("revenue").desc(), "sku")
    return sel.withColumn("variant_rank", F.row_number().over(w))


def _lifecycle(ctx, min_months: int = 6) -> DataFrame:
    l = ctx.lines.where(F.col("product_name").isNotNull() & F.col("date").isNotNull())
    mon = l.groupBy("product_name", month_start("date").alias("_m")).agg(F.sum(line_revenue()).alias("_rev"))
    elig = (mon.groupBy("product_name").agg(F.count(F.lit(1)).alias("months_active"))
            .where(F.col("months_active") >= min_months))
    sel = mon.join(elig, "product_name")
    # each product holds one row per active month, so the window partitions are bounded by the calendar
    w = Window.partitionBy("product_name").orderBy("_m")
    sel = sel.withColumn("_rn", F.row_number().over(w))
    n = F.col("months_active")
    agg = sel.groupBy("product_name", "months_active").agg(
        F.sum("_rev").alias("total_revenue"),
        F.avg(F.when(F.col("_rn") <= 3, F.col("_rev"))).alias("_early"),
        F.avg(F.when(F.col("_rn") > n - 3, F.col("_rev"))).alias("_recent"),
        F.avg(F.when((F.col("_rn") > F.floor(n / 3)) & (F.col("_rn") <= F.floor(2 * n / 3)), F.col("_rev"))).alias("_mid"))
    r, e, m = F.col("_recent"), F.col("_early"), F.col("_mid")
    stage = (F.when((r > m * 1.1) & (r > e), "Growth")
             .when(r < m * 0.8, "Decline")
             .when(r > e * 1.5, "Growth")
             .when(F.when(m > 0, F.abs(r - m) / m < 0.15).otherwise(F.lit(True)), "Maturity")
             .otherwise("Introduction"))
    return agg.select("product_name", stage.alias("stage"), "months_active", "total_revenue")


def product_lifecycle(ctx, min_months: int = 6, products: int | None = None) -> DataFrame:
    """Stage of every product; ``products`` shows only the first of them by name."""
    out = _lifecycle(ctx, min_months)
    return out if products is None else out.orderBy("product_name").limit(products)


def lifecycle_stages(ctx, min_months: int = 6) -> DataFrame:
    return _lifecycle(ctx, min_months).groupBy("stage").agg(F.count(F.lit(1)).alias("count"))


def _priced(ctx) -> DataFrame:
    return ctx.lines.where(F.col("product_price").isNotNull() & (F.col("product_price") > 0))


def price_stats(ctx, min_rows: int = 20) -> DataFrame:
    p = _priced(ctx)
    med = exact_quantiles(p, "product_price", [0.5], prefix="m").select("m0").scalar()
    return p.agg(F.min("product_price").alias("min_price"), F.max("product_price").alias("max_price"),
                 F.avg("product_price").alias("mean_price"), F.count(F.lit(1)).alias("total_items")).where(
        F.col("total_items") >= min_rows).select("min_price", "max_price", "mean_price", med.alias("median_price"),
                                                 "total_items")


def price_sweet_spots(ctx, bins: int = 20, k: int = 5, min_rows: int = 20) -> DataFrame:
    """Units per equal-width price bin (pandas ``cut`` edges); the ``k`` busiest bins."""
    p = _priced(ctx)
    # one-row aggregate; the edges become literals of the binning expression
    st = p.agg(F.min("product_price").alias("lo"), F.max("product_price").alias("hi"),
               F.count(F.lit(1)).alias("n")).first()
    if st["n"] < min_rows:
        return ctx.spark.createDataFrame([], "bin int, bin_left double, bin_right double, volume long")
    lo, hi = F.lit(float(st["lo"])), F.lit(float(st["hi"]))
    b = equal_width_bin(F.col("product_price"), lo, hi, bins)
    step = (hi - lo) / F.lit(float(bins))
    g = p.groupBy(b.alias("bin")).agg(F.coalesce(F.sum("product_qty"), F.lit(0)).alias("volume"))
    left = F.when(F.col("bin") == 0, lo - (hi - lo) * 0.001).otherwise(F.col("bin").cast("double") * step + lo)
    right = F.when(F.col("bin") == bins - 1, hi).otherwise((F.col("bin") + 1).cast("double") * step + lo)
    return (g.select("bin", left.alias("bin_left"), right.alias("bin_right"), "volume")
            .orderBy(F.col("volume").desc(), "bin").limit(k))


def _category_pricing(ctx, min_lines: int = 5, k: int = 15):
    l = ctx.lines.where(F.col("product_name").isNotNull() & (F.col("product_price") > 0)).withColumn(
        "category", category("product_name"))
    g = l.groupBy("category").agg(
        F.count(F.lit(1)).alias("_lines"), F.avg("product_price").alias("avg_price"),
        (F.sum(F.col("product_price") * F.col("product_qty")) / F.sum("product_qty")).alias("weighted_price"),
        F.count_distinct("product_name").alias("product_count")).where(F.col("_lines") >= min_lines)
    top = g.orderBy(F.col("product_count").desc(), "category").limit(k)
    return l, top


def category_pricing(ctx, min_lines: int = 5, k: int = 15) -> DataFrame:
    l, top = _category_pricing(ctx, min_lines, k)
    # ``top`` holds at most k categories: a proven bound for broadcast
    med = exact_quantiles(l.join(F.broadcast(top.select("category")), "category", "left_semi"),
                          "product_price", [0.5], by=["category"], prefix="m")
    return top.join(med.select("category", F.col("m0").alias("median_price")), "category", "left").select(
        "category", "avg_price", "median_price", "weighted_price", "product_count")


def _priced_products(ctx, min_lines: int, k: int) -> DataFrame:
    l, top = _category_pricing(ctx, min_lines, k)
    prods = l.join(F.broadcast(top.select("category", "weighted_price")), "category").groupBy(
        "category", "product_name", "weighted_price").agg(
        F.avg("product_price").alias("avg_price"), F.coalesce(F.sum("product_qty"), F.lit(0)).alias("units"))
    return prods


def underpriced(ctx, factor: float = 0.7, k: int = 3, min_lines: int = 5, categories: int = 15) -> DataFrame:
    p = _priced_products(ctx, min_lines, categories).where(F.col("avg_price") < F.col("weighted_price") * factor)
    w = Window.partitionBy("category").orderBy(F.col("units").desc(), "product_name")
    return p.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(
        "category", "product_name", "avg_price", "units")


def overpriced(ctx, factor: float = 1.5, k: int = 3, min_lines: int = 5, categories: int = 15) -> DataFrame:
    p = _priced_products(ctx, min_lines, categories).where(F.col("avg_price") > F.col("weighted_price") * factor)
    w = Window.partitionBy("category").orderBy(F.col("units").asc(), "product_name")
    return p.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(
        "category", "product_name", "avg_price", "units")
