"""Order-level table, hero summary and shared store predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.core import nonblank, pct_change, safe_div

# Order-level columns and cancellation spellings of the store exports.
ORDER_COLUMNS = ['order_id', 'email', 'date', 'order_status', 'payment_status',
                 'total', 'discount', 'shipping_cost', 'state', 'city', 'country',
                 'shipping_method', 'payment_method', 'coupon', 'channel',
                 'cancellation_date', 'cancellation_reason', 'customer_name',
                 'payment_date', 'shipping_date']
CANCELLED = ['cancelled', 'Cancelada', 'cancelada']
CANCELLED_SHORT = ['cancelled', 'Cancelada']


def is_cancelled(statuses=CANCELLED) -> Column:
    return F.coalesce(F.col("order_status").isin(*statuses), F.lit(False))


def orders_from_lines(lines: DataFrame, position: tuple = ("line_no",)) -> DataFrame:
    """One row per order: the first non-null value of each order column in line order.

    ``position`` names the columns giving the line order (file position).  A
    value's sort key is null when the value is null, so ``min_by`` skips it;
    all-null columns stay null.  Partial aggregation keeps the shuffle to one
    row per order per map task.
    """
    pos_cols = [c for c in position if c in lines.columns]
    pos = F.struct(*[F.col(c) for c in pos_cols]) if pos_cols else F.monotonically_increasing_id()
    cols = [c for c in ORDER_COLUMNS if c in lines.columns and c != "order_id"]
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), pos)).alias(c) for c in cols]
    return lines.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(*aggs)


def paid_orders(orders: DataFrame) -> DataFrame:
    """Orders with a positive total (the population of revenue metrics)."""
    return orders.where(F.col("total").isNotNull() & (F.col("total") > 0))


def customer_orders(orders: DataFrame, need_date: bool = True, positive_total: bool = True) -> DataFrame:
    o = orders.where(F.col("email").isNotNull())
    if need_date:
        o = o.where(F.col("date").isNotNull())
    if positive_total:
        o = o.where(F.col("total") > 0)
    return o


def recent_prior_flags(df: DataFrame, date_col: str = "date", months: int = 3,
                       anchor: Column | None = None) -> tuple[Column, Column]:
    """Flags for the last ``months`` calendar months up to the anchor (max date) and the span before."""
    anchor = anchor if anchor is not None else df.agg(F.max(date_col)).scalar()
    cutoff = anchor - F.make_interval(months=F.lit(months))
    prior_start = cutoff - F.make_interval(months=F.lit(months))
    d = F.col(date_col)
    return (d >= cutoff), ((d < cutoff) & (d >= prior_start))


def summary(ctx) -> DataFrame:
    """Hero metrics and 3-month-vs-previous-3-month changes."""
    lines, orders = ctx.lines, ctx.orders
    valid = orders.where(F.col("total").isNotNull() & (F.col("total") > 0))
    date_max = lines.agg(F.max("date")).scalar()
    date_min = lines.agg(F.min("date")).scalar()
    recent, prior = recent_prior_flags(valid, anchor=date_max)
    # one row per customer first: distinct customers are then plain counts
    per = valid.groupBy("email").agg(
        F.sum("total").alias("t"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(recent, F.col("total"))).alias("rt"), F.count(F.when(recent, 1)).alias("rn"),
        F.sum(F.when(prior, F.col("total"))).alias("pt"), F.count(F.when(prior, 1)).alias("pn"))

    def total(c: str):
        return F.coalesce(F.sum(c), F.lit(0))
    known = F.col("email").isNotNull()
    agg = per.agg(
        total("t").cast("double").alias("total_revenue"), total("n").alias("total_orders"), F.count("email").alias("unique_customers"),
        (F.sum("t") / F.nullif(F.sum("n"), F.lit(0))).alias("avg_ticket"),
        total("rt").cast("double").alias("_r_rev"), total("pt").cast("double").alias("_p_rev"), total("rn").alias("_r_n"), total("pn").alias("_p_n"),
        F.count(F.when(known & (F.col("rn") > 0), 1)).alias("_r_c"), F.count(F.when(known & (F.col("pn") > 0), 1)).alias("_p_c"),
        F.coalesce(safe_div(F.sum("rt"), F.sum("rn")), F.lit(0.0)).alias("_r_t"),
        F.coalesce(safe_div(F.sum("pt"), F.sum("pn")), F.lit(0.0)).alias("_p_t"))
    rows = lines.agg(F.count(F.lit(1)).alias("total_rows"))
    return agg.select(
        "total_revenue", "total_orders", "unique_customers", "avg_ticket",
        F.to_date(date_min).alias("date_min"), F.to_date(date_max).alias("date_max"),
        pct_change("_r_rev", "_p_rev").alias("revenue_change_pct"),
        pct_change("_r_n", "_p_n").alias("orders_change_pct"),
        pct_change("_r_c", "_p_c").alias("customers_change_pct"),
        pct_change("_r_t", "_p_t").alias("ticket_change_pct"),
        rows.scalar().alias("total_rows"),
    )


def orders_table(ctx) -> DataFrame:
    """``op_orders_from_lines`` over the context's line table."""
    return orders_from_lines(ctx.lines).select(*ORDER_COLUMNS)


def required_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """One row: whether each required column exists and holds at least one value (one aggregate over all of them)."""
    return df.agg(*[(F.count(F.col(c)) > 0).alias(c) if c in df.columns else F.lit(False).alias(c) for c in required])


__all__ = ["orders_from_lines", "summary", "orders_table", "required_columns", "is_cancelled",
           "nonblank", "ORDER_COLUMNS"]
