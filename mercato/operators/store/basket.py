"""Market-basket operators: item pairs and trios, category and colour affinity, bundles, cross-sell.

Counts come from the sparse accumulators of ``mercato.functions.cooccurrence``, at every size the same
way.  Where a support floor holds, only items that reach it take part (support is anti-monotone, so
this is exact); the floor also bounds their number, by the mean basket size over the floor.  Item
names are joined to the counted hashes at the end.

All pairs that meet the support floor are ranked by lift; ``candidates`` restores the reference's cut to
the most frequent before the ranking.  Totals of orders enter the plans as scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.cooccurrence import item_counts, pair_counts, transactions, trio_counts
from mercato.functions.core import line_revenue
from mercato.functions.text import base_product, category, extract_color
from mercato.scratch import written


def order_items(lines: DataFrame, item: Column, where: Column | None = None) -> DataFrame:
    """Distinct (order, item) pairs: the transactions in long form."""
    l = lines.where(F.col("order_id").isNotNull())
    if where is not None:
        l = l.where(where)
    return l.select("order_id", item.alias("item")).where(F.col("item").isNotNull()).distinct()


def order_totals(items: DataFrame) -> DataFrame:
    """One row: orders (n), orders of several items (multi)."""
    per = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("_k"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_k") >= 2, 1)).alias("multi"))


def _named(sets: DataFrame, freq: DataFrame, *sides: str) -> DataFrame:
    """Item names and frequencies of counted hash sets, names in ascending order within a set."""
    for s in sides:
        sets = sets.join(freq.select(F.col("h").alias(s), F.struct("item", "freq").alias(f"_{s}")), s)
    return (sets.withColumn("_all", F.array_sort(F.array(*(f"_{s}" for s in sides))))
            .select(*(F.col("_all")[i]["item"].alias(f"item_{s}") for i, s in enumerate(sides)), "count",
                    *(F.col("_all")[i]["freq"].alias(f"freq_{s}") for i, s in enumerate(sides))))


def _frequent(items: DataFrame, floor: Column | None) -> tuple[DataFrame, DataFrame]:
    """Transactions and frequencies of the items that occur in ``floor`` orders or more (all items without a floor)."""
    freq = item_counts(items)
    rows = transactions(items)
    if floor is None:
        return rows, freq
    freq = freq.where(F.col("freq") >= floor)
    return rows.join(freq.select("h"), "h", "left_semi"), freq


def pairs_with_freqs(items: DataFrame, floor: Column | None = None) -> DataFrame:
    """(item_a < item_b, count, freq_a, freq_b) of the pairs that occur in ``floor`` orders or more."""
    rows, freq = _frequent(items, floor)
    counts = pair_counts(rows)
    return _named(counts if floor is None else counts.where(F.col("count") >= floor), freq, "a", "b")


def trios_with_freqs(items: DataFrame, floor: Column) -> DataFrame:
    """(item_a < item_b < item_c, count, freq_a, freq_b, freq_c) of the trios in ``floor`` orders or more."""
    rows, freq = _frequent(items, floor)
    counts = trio_counts(rows, pair_counts(rows).where(F.col("count") >= floor))
    return _named(counts.where(F.col("count") >= floor), freq, "a", "b", "c")


def _most_frequent(sets: DataFrame, candidates: int | None, *items: str) -> DataFrame:
    """All item sets, or with ``candidates`` the most frequent only, as the reference does before it ranks by lift."""
    return sets if candidates is None else sets.orderBy(F.col("count").desc(), *items).limit(candidates)


def _rank(df: DataFrame, order: list, out: str = "rank") -> DataFrame:
    # callers pass at most a few hundred rows (already limited): the window is bounded
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order)))


def _default_items(ctx, item: Column | None) -> DataFrame:
    if item is not None:
        return order_items(ctx.lines, item, F.col("product_name").isNotNull())
    # shared by pairs, trios, summary, bundles and cross-sell
    return ctx.derived("order_base_products", lambda: order_items(
        ctx.lines, base_product("product_name"), F.col("product_name").isNotNull()))


def _support(n: Column, given: float | None = None, share: float = 1.0) -> Column:
    """The least support of a pair: 0.3 percent of many orders, 1 percent of few."""
    return F.lit(given) if given is not None else F.when(n > 1000, F.lit(0.003)).otherwise(F.lit(0.01)) * share


def lifted_pairs(ctx, item: Column | None = None, candidates: int | None = None, min_lift: float = 1.0,
                 min_multi: int = 10, min_support: float | None = None) -> DataFrame:
    """All pairs of base products above the support floor and the least lift, with support, confidence and lift."""
    items = _default_items(ctx, item)
    total = order_totals(items)
    n, multi = total.select("n").scalar(), total.select("multi").scalar()
    s = _support(n, min_support)
    p = pairs_with_freqs(items, F.greatest(F.lit(1), F.floor(s * n))).where(F.col("count") / n >= s)
    top = _most_frequent(p, candidates, "item_a", "item_b")
    nn = F.greatest(n, F.lit(1)).cast("double")
    support = F.col("count") / nn
    lift = support / ((F.col("freq_a") / nn) * (F.col("freq_b") / nn))
    conf = F.greatest(F.col("count") / F.col("freq_a"), F.col("count") / F.col("freq_b"))
    return (top.select("item_a", "item_b", "count", (support * 100).alias("support"),
                       (conf * 100).alias("confidence"), lift.alias("lift"))
            .where((F.col("lift") > min_lift) & (multi >= min_multi)))


def basket_pairs(ctx, item: Column | None = None, candidates: int | None = None, k: int = 30,
                 min_lift: float = 1.0, min_multi: int = 10, min_support: float | None = None) -> DataFrame:
    """Pairs of base products bought together: support, confidence, lift (percent, unrounded)."""
    out = lifted_pairs(ctx, item, candidates, min_lift, min_multi, min_support)
    order = [F.round("lift", 2).desc(), F.col("count").desc(), "item_a", "item_b"]
    return _rank(out.orderBy(*order).limit(k), order)


def basket_trios(ctx, item: Column | None = None, candidates: int | None = None, k: int = 15,
                 min_lift: float = 1.0, min_multi: int = 10) -> DataFrame:
    """Trios bought together: support of at least half the pair minimum, lift vs independent items."""
    # read by both counting passes and the totals: derived from the lines once
    items = written(_default_items(ctx, item), "order-items")
    total = order_totals(items)
    n, multi = total.select("n").scalar(), total.select("multi").scalar()
    s = _support(n, share=0.5)
    t = trios_with_freqs(items, F.greatest(F.lit(1), F.floor(s * n))).where(F.col("count") / n >= s)
    top = _most_frequent(t, candidates, "item_a", "item_b", "item_c")
    nn = F.greatest(n, F.lit(1)).cast("double")
    support = F.col("count") / nn
    expected = (F.col("freq_a") / nn) * (F.col("freq_b") / nn) * (F.col("freq_c") / nn)
    out = top.select("item_a", "item_b", "item_c", "count", (support * 100).alias("support"),
                     (support / expected).alias("lift")).where((F.col("lift") > min_lift) & (multi >= min_multi))
    order = [F.round("lift", 2).desc(), F.col("count").desc(), "item_a", "item_b", "item_c"]
    return _rank(out.orderBy(*order).limit(k), order)


def basket_summary(ctx) -> DataFrame:
    items = _default_items(ctx, None)
    per = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("_k"))
    return per.agg(F.count(F.lit(1)).alias("total_orders"),
                   F.count(F.when(F.col("_k") >= 2, 1)).alias("multi_product_orders")).select(
        "*", F.when(F.col("total_orders") > 0, F.col("multi_product_orders") * 100.0 / F.col("total_orders"))
        .otherwise(F.lit(0.0)).alias("multi_product_pct"))


def category_affinity(ctx, candidates: int | None = None, k: int = 20, min_multi: int = 5) -> DataFrame:
    """Category pairs of an order (every line counts; no name -> placeholder), by lift."""
    items = order_items(ctx.lines, category("product_name"))
    total = order_totals(items)
    n, multi = total.select("n").scalar(), total.select("multi").scalar()
    top = _most_frequent(pairs_with_freqs(items), candidates, "item_a", "item_b")
    nn = F.greatest(n, F.lit(1)).cast("double")
    lift = (F.col("count") / nn) / ((F.col("freq_a") / nn) * (F.col("freq_b") / nn))
    out = top.select(F.col("item_a").alias("category_a"), F.col("item_b").alias("category_b"), "count",
                     (F.col("count") / nn * 100).alias("support"), lift.alias("lift")).where(multi >= min_multi)
    order = [F.round("lift", 2).desc(), F.col("count").desc(), "category_a", "category_b"]
    return _rank(out.orderBy(*order).limit(k), order)


def top_pairs(items: DataFrame, k: int) -> DataFrame:
    """The k most frequent pairs."""
    return pairs_with_freqs(items).orderBy(F.col("count").desc(), "item_a", "item_b").limit(k)


def color_pairs(ctx, k: int = 15, min_lines: int = 50, min_multi: int = 5) -> DataFrame:
    color = extract_color("product_name")
    l = ctx.lines.where(F.col("product_name").isNotNull())
    n_lines = l.where(color.isNotNull()).agg(F.count(F.lit(1))).scalar()
    items = order_items(l, color)
    multi = order_totals(items).select("multi").scalar()
    return (top_pairs(items, k).where((n_lines >= min_lines) & (multi >= min_multi))
            .select(F.col("item_a").alias("color_a"), F.col("item_b").alias("color_b"), "count"))


def bundles(ctx, pairs: int = 15, discounts: tuple = (0.10, 0.15)) -> DataFrame:
    """Bundle prices for the best basket pairs from the mean price of each base product."""
    top = basket_pairs(ctx).where(F.col("rank") <= pairs)
    prices = (ctx.lines.where(F.col("product_name").isNotNull() & F.col("product_price").isNotNull())
              .groupBy(base_product("product_name").alias("_b")).agg(F.avg("product_price").alias("_p")))
    j = (top.join(prices.withColumnRenamed("_b", "item_a").withColumnRenamed("_p", "price_a"), "item_a", "left")
         .join(prices.withColumnRenamed("_b", "item_b").withColumnRenamed("_p", "price_b"), "item_b", "left"))
    total = F.coalesce("price_a", F.lit(0.0)) + F.coalesce("price_b", F.lit(0.0))
    return j.where(total > 0).select(
        "item_a", "item_b", total.alias("individual_total"),
        (total * (1 - discounts[0])).alias("bundle_price_10pct"),
        (total * (1 - discounts[1])).alias("bundle_price_15pct"),
        "lift", "count", "support")


def cross_sell(ctx, products: int = 20, per_product: int = 3) -> DataFrame:
    """For the top base products by revenue, the best partners by lift among all pairs above the support floor."""
    p = lifted_pairs(ctx).select("item_a", "item_b", "lift", "support", "count")
    rev = (ctx.lines.where(F.col("product_name").isNotNull())
           .groupBy(base_product("product_name").alias("product")).agg(F.sum(line_revenue()).alias("_rev"))
           .orderBy(F.col("_rev").desc(), "product").limit(products).select("product"))
    sides = F.explode(F.array(F.struct(F.col("item_a").alias("product"), F.col("item_b").alias("recommended")),
                              F.struct(F.col("item_b").alias("product"), F.col("item_a").alias("recommended"))))
    recs = p.select(sides.alias("r"), "lift", "support", "count").select("r.*", "lift", "support", "count")
    j = recs.join(F.broadcast(rev), "product")  # at most ``products`` rows
    # a product has at most as many partners as items reach the support floor
    w = Window.partitionBy("product").orderBy(F.round("lift", 2).desc(), F.col("count").desc(), "recommended")
    return j.withColumn("rec_rank", F.row_number().over(w)).where(F.col("rec_rank") <= per_product).select(
        "product", "recommended", "lift", "support", "rec_rank")
