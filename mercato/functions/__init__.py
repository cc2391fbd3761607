from mercato.functions.core import (line_revenue, month_key, nonblank, pct_change, ratio_metrics,
                                   safe_div, semaphore, sum0, sunday_week_key, trend_pct, whole_days)
from mercato.functions.ranking import equal_width_bin, exact_quantiles, quantile_bin, rows_within_share
from mercato.functions.text import (base_product, category, extract_color, extract_size, parse_name,
                                   variant_base)

__all__ = [
    "line_revenue", "month_key", "nonblank", "pct_change", "ratio_metrics", "safe_div", "semaphore",
    "sum0", "sunday_week_key", "trend_pct", "whole_days", "equal_width_bin", "exact_quantiles",
    "quantile_bin", "rows_within_share", "base_product", "category", "extract_color",
    "extract_size", "parse_name", "variant_base",
]
