"""Saved search-ads reports: fixed selections of a period, each one filter and one aggregate over a canonical table.

A report names its table, dimensions and metrics.  Rows of the period are summed per combination of
dimensions (null is a value of its own), as the ads platforms do when a report selects a dimension:

* ratios are sum over sum;
* shares of impressions are weighted by the eligible impressions a row implies (impressions over share), so a
  campaign's share is right over any period; rows without a share, or with a share of 0, do not weigh.

Status columns hold the export's text in any case; where a status is unknown (null, blank or no such column) the row counts
as enabled.  A table without dates is taken whole.  Dimensions that an export lacks are null columns, so that a report has
the same columns for every export.  Limits are part of a report (its top rows); ties go by the dimensions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.core import safe_div, sum0
from mercato.operators.search.report import DAYS

SHARES = ("search_impression_share", "search_lost_is_budget", "search_lost_is_rank", "search_top_is", "search_abs_top_is")
RATIOS = {"ctr": ("clicks", "impressions", 100), "cpa": ("cost", "conversions", 1)}


@dataclass(frozen=True)
class Report:
    """A saved selection; ``enabled`` names the status columns that must not say otherwise."""

    table: str
    dimensions: tuple[str, ...]
    metrics: tuple[str, ...]
    enabled: tuple[str, ...] = ("campaign_status",)
    where: str = "true"
    seen: bool = False  # only rows with impressions
    order: tuple[str, ...] = ()  # descending
    limit: int | None = None


REPORTS = {
    "active_campaigns": Report("campaign", ("campaign_id", "campaign_name", "campaign_status", "campaign_type", "bid_strategy_type"),
                               ("cost", "impressions", "clicks", "conversions"), order=("cost",)),
    "campaign_days": Report("campaign", ("campaign_id", "campaign_name", "date"),
                            ("cost", "impressions", "clicks", "ctr", "conversions", "conversion_value", "cpa"), order=("date",)),
    "impression_share": Report("campaign", ("campaign_id", "campaign_name"), (*SHARES, "cost", "impressions", "clicks"),
                               where="lower(trim(campaign_type)) = 'search'"),
    "keyword_quality": Report("keyword", ("ad_group_name", "keyword", "match_type", "quality_score", "ad_relevance", "expected_ctr",
                                          "landing_page_experience"), ("impressions", "clicks", "cost", "conversions"),
                              enabled=("keyword_status", "campaign_status"), seen=True, order=("cost",)),
    "search_terms": Report("search_term", ("search_term", "search_term_status", "campaign_name", "ad_group_name"),
                           ("impressions", "clicks", "cost", "conversions", "ctr"), enabled=(), seen=True, order=("cost",), limit=100),
    "asset_groups": Report("campaign", ("asset_group_id", "asset_group_name", "asset_group_status", "ad_strength", "campaign_name"),
                           ("impressions", "clicks", "cost", "conversions", "conversion_value"), where="asset_group_name is not null"),
    "devices": Report("campaign", ("campaign_name", "device"), ("impressions", "clicks", "ctr", "cost", "conversions", "cpa")),
    "places": Report("campaign", ("campaign_name", "country", "region", "location_type"),
                     ("impressions", "clicks", "cost", "conversions", "cpa"), order=("cost",), limit=50),
    "weekdays": Report("campaign", ("campaign_name", "weekday"), ("impressions", "clicks", "cost", "conversions", "cpa")),
}


def _with_columns(rows: DataFrame, names: Sequence[str], kind: str = "string") -> DataFrame:
    return rows.withColumns({c: F.lit(None).cast(kind) for c in names if c not in rows.columns})


def _not_disabled(status: Column) -> Column:
    text = F.upper(F.trim(status.cast("string")))
    return text.isNull() | text.isin("", "ENABLED")


def _metric(name: str) -> Column:
    if name in SHARES:
        eligible = F.when(F.col("search_impression_share") > 0, F.col("impressions") * 100 / F.col("search_impression_share"))
        weight = F.when(F.col(name).isNotNull(), eligible)
        total = F.sum(weight)
        return F.when(total > 0, F.sum(F.col(name) * weight) / total)
    if name in RATIOS:
        over, under, scale = RATIOS[name]
        return safe_div(sum0(F.col(over).cast("double")), sum0(F.col(under).cast("double"))) * scale
    kind = "long" if name in ("impressions", "clicks") else "double"
    return sum0(F.col(name).cast(kind)).cast(kind)


def saved_report(rows: DataFrame, report: Report, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """The report over rows from ``date_from`` to ``date_to`` (both included; None: no bound)."""
    dated = "date" in rows.columns
    if "weekday" in report.dimensions and "weekday" not in rows.columns:
        of_date = F.element_at(F.array(*map(F.lit, DAYS)), F.weekday("date") + 1) if dated else F.lit(None).cast("string")
        given = F.initcap(F.trim("day_of_week")) if "day_of_week" in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn("weekday", F.coalesce(F.when(given != "", given), of_date))
    rows = _with_columns(rows, (*report.dimensions, *report.enabled))
    sums = {c for m in report.metrics for c in ((m,) if m not in RATIOS else RATIOS[m][:2])}
    rows = _with_columns(rows, sorted(sums | (set(SHARES[:1]) if sums & set(SHARES) else set())), "double")
    rows = rows.where(report.where)
    for status in report.enabled:
        rows = rows.where(_not_disabled(F.col(status)))
    if dated and date_from is not None:
        rows = rows.where(F.col("date") >= F.to_date(F.lit(date_from)))
    if dated and date_to is not None:
        rows = rows.where(F.col("date") <= F.to_date(F.lit(date_to)))
    out = rows.groupBy(*report.dimensions).agg(*[_metric(m).alias(m) for m in report.metrics],
                                               *([sum0(F.col("impressions").cast("long")).alias("_seen")] if report.seen else []))
    if report.seen:
        out = out.where("_seen > 0").drop("_seen")
    if report.order:
        # money sums are compared to a millionth, so that ties do not hang on the order of a sum
        keys = [(F.round(c, 6) if c in report.metrics else F.col(c)).desc_nulls_last() for c in report.order]
        out = out.orderBy(*keys, *[F.col(d).asc_nulls_first() for d in report.dimensions])
    return out if report.limit is None else out.limit(report.limit)


def saved(name: str):
    """The operator of a saved report over a context."""
    report = REPORTS[name]

    def run(ctx, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        return saved_report(getattr(ctx, report.table), report, date_from, date_to)
    run.__name__ = f"saved_{name}"
    run.__doc__ = f"The saved report ``{name}``."
    return run
