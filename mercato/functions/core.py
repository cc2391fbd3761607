"""Column-expression helpers shared by all operators (all JVM-side, codegen-able)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b, default: float = 0.0) -> Column:
    """a / b, or ``default`` when b is null or 0 (ANSI-safe: never divides by 0)."""
    a, b = col(a), col(b)
    return F.when(F.coalesce(b, F.lit(0)) == 0, F.lit(default)).otherwise(a / b)


def pct_change(new, old) -> Column:
    """(new - old) / old * 100 when old > 0, else null."""
    new, old = col(new), col(old)
    return F.when(old > 0, (new - old) / old * 100)


def trend_pct(recent, prior) -> Column:
    """Change in percent; 100 when only recent exists; 0 when neither."""
    recent, prior = col(recent), col(prior)
    return (F.when(prior > 0, (recent - prior) / prior * 100)
            .when(recent > 0, F.lit(100.0)).otherwise(F.lit(0.0)))


def semaphore(value, green: float, yellow: float, reverse: bool = False,
              null_label: str | None = "gray") -> Column:
    """green/yellow/red traffic light; ``reverse`` means lower is better."""
    v = col(value)
    if reverse:
        light = F.when(v <= green, "green").when(v <= yellow, "yellow").otherwise("red")
    else:
        light = F.when(v >= green, "green").when(v >= yellow, "yellow").otherwise("red")
    if null_label is None:
        return light
    return F.when(v.isNull(), F.lit(null_label)).otherwise(light)


def whole_days(later, earlier) -> Column:
    """Floor of elapsed 24-hour periods (23:00 -> 01:00 next day is 0)."""
    diff = F.timestamp_diff("MICROSECOND", col(earlier), col(later))
    return F.floor(diff / F.lit(float(MICROS_PER_DAY))).cast("long")


def month_key(ts) -> Column:
    """Calendar month label ``yyyy-MM``."""
    return F.date_format(col(ts), "yyyy-MM")


def month_start(ts) -> Column:
    return F.trunc(F.to_date(col(ts)), "month")


def months_between_periods(later_month, earlier_month) -> Column:
    """Whole months between two month starts (period arithmetic)."""
    a, b = col(later_month), col(earlier_month)
    return ((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)).cast("int")


def sunday_week_key(d) -> Column:
    """``%Y-W%U``: weeks start on Sunday; days before the first Sunday are week 00."""
    d = col(d)
    week = F.floor((F.dayofyear(d) + 6 - (F.dayofweek(d) - 1)) / 7).cast("int")
    return F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def weekday_mon0(ts) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(col(ts))


def nonblank(c) -> Column:
    c = col(c)
    return c.isNotNull() & (c != "")


def line_revenue(price="product_price", qty="product_qty") -> Column:
    return F.coalesce(col(price), F.lit(0.0)) * F.coalesce(col(qty), F.lit(1))


def sum0(c) -> Column:
    """Sum that yields 0 for an empty or all-null input (pandas semantics)."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def weighted_avg(value, weight) -> Column:
    """Sum of value times weight over the sum of weights, 0 when that is 0."""
    v, w = col(value), col(weight)
    return safe_div(F.sum(v * w), F.sum(w))


def default_number(c, default: float = 0.0) -> Column:
    """The column as a double, or ``default`` where it holds no number."""
    return F.coalesce(col(c).cast("string").try_cast("double"), F.lit(default))


def ratio_metrics(only: tuple = ("roas", "cpa", "ctr", "cpc", "conv_rate", "cpm"), spend="cost", value="conversion_value",
                  conv="conversions", clicks="clicks", impressions="impressions") -> list:
    """Ratios of summed columns (sum/sum, never mean of ratios), in the order of ``only``."""
    ratios = {"roas": safe_div(value, spend), "cpa": safe_div(spend, conv), "ctr": safe_div(clicks, impressions) * 100,
              "cpc": safe_div(spend, clicks), "conv_rate": safe_div(conv, clicks) * 100, "cpm": safe_div(spend, impressions) * 1000}
    return [ratios[name].alias(name) for name in only]
