"""Run the analysis catalogue (lite or full set) of a domain and record a status per analysis."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from mercato.context import MissingTable
from mercato.operators.store.orders import required_columns
from mercato.plans.registry import REGISTRY
from mercato.session import ensure_checkpoint_dir

# Which keys make up the lite / full runs of each report (reference analysis order).
STORE_LITE = [
    "ec_basket_pairs", "ec_basket_trios", "ec_basket_summary", "ec_category_affinity", "ec_category_distribution",
    "ec_product_ranking", "ec_anchor_products", "ec_pareto", "ec_cancel_by_product", "ec_rfm_scores",
    "ec_rfm_segments", "ec_clv", "ec_clv_top", "ec_clv_quartiles", "ec_cohort_matrix", "ec_cohort_curve",
    "ec_repurchase", "ec_purchase_gaps", "ec_order_count_distribution", "ec_monthly_revenue", "ec_revenue_trend",
    "ec_ticket_stats", "ec_ticket_histogram", "ec_ticket_monthly", "ec_new_vs_returning", "ec_revenue_by_category",
    "ec_discount_impact", "ec_top_coupons", "ec_geo_revenue", "ec_shipping_by_state", "ec_cancel_rate",
    "ec_cancel_monthly", "ec_cancel_reasons", "ec_cancel_by_payment", "ec_payment_mix", "ec_payment_mix_monthly",
    "ec_bundles", "ec_season_month", "ec_season_dow", "ec_season_hour", "ec_season_peaks",
]
STORE_FULL = STORE_LITE + [
    "ec_color_distribution", "ec_color_pairs", "ec_size_distribution", "ec_multi_size_customers", "ec_sku_variants",
    "ec_product_lifecycle", "ec_lifecycle_stages", "ec_upgrade_pattern", "ec_top_upgraders", "ec_vip_customers",
    "ec_vip_summary", "ec_vip_products", "ec_vip_states", "ec_churn", "ec_churn_products", "ec_revenue_by_channel",
    "ec_price_stats", "ec_price_sweet_spots", "ec_city_penetration", "ec_shipping_method_crosstab",
    "ec_fulfillment_stats", "ec_fulfillment_by_method", "ec_fulfillment_monthly", "ec_channel_analysis",
    "ec_free_shipping", "ec_free_shipping_retention", "ec_forecast", "ec_forecast_history", "ec_cross_sell",
    "ec_category_pricing", "ec_underpriced", "ec_overpriced", "ec_niche_clusters",
]
SEARCH_LITE = [
    "ga_dashboard", "ga_benchmarks", "ga_daily", "ga_daily_ma7", "ga_daily_trend", "ga_campaigns",
    "ga_budget_vs_results", "ga_bidding_status", "ga_bidding_summary", "ga_qs_histogram", "ga_qs_weighted",
    "ga_qs_components", "ga_low_qs_spend", "ga_top_keywords", "ga_impression_share", "ga_wasted_spend",
    "ga_wasted_terms", "ga_keyword_opportunities", "ga_ad_ranking", "ga_ad_strength", "ga_poor_ads", "ga_funnel",
    "ga_dow", "ga_hour", "ga_best_worst", "ga_geo", "ga_device",
]
SEARCH_FULL = SEARCH_LITE + [
    "ga_asset_groups", "ga_asset_group_strength", "ga_brand_overlap", "ga_learning_period", "ga_learning_summary",
    "ga_weekly_drift", "ga_drift_trend", "ga_match_type", "ga_negative_words", "ga_headlines_ctr",
    "ga_headlines_conv", "ga_conversion_health", "ga_attribution_bias", "ga_auction_insights",
    "ga_scaling_forecast", "ga_scaling_scenarios",
]
SOCIAL_LITE = [
    "ma_dashboard", "ma_benchmarks", "ma_daily", "ma_campaigns", "ma_budget_distribution", "ma_learning_phase",
    "ma_learning_summary", "ma_adsets", "ma_audiences", "ma_ad_ranking", "ma_creative_fatigue", "ma_funnel",
    "ma_dropoff", "ma_dow", "ma_period_trend", "ma_roas_direction", "ma_geo", "ma_placement", "ma_device",
    "ma_signals",
]
SOCIAL_FULL = SOCIAL_LITE + [
    "ma_name_detect", "ma_name_parse", "ma_name_summary", "ma_by_format", "ma_by_stage", "ma_by_creator",
    "ma_by_product", "ma_format_stage_matrix", "ma_relevance", "ma_relevance_distribution", "ma_hook_rate",
    "ma_video_completion", "ma_video_completion_ads", "ma_forecast", "ma_overlap_cv", "ma_pacing",
    "ma_marginal_cpa", "ma_marginal_trend", "ma_attribution_windows",
]
# The columns without which an analysis has nothing to say, by table.
REQUIRED: dict[str, dict[str, list[str]]] = {
    "lines": {
        "product_name": ["ec_basket_pairs", "ec_basket_trios", "ec_basket_summary", "ec_category_affinity", "ec_category_distribution",
                         "ec_product_ranking", "ec_anchor_products", "ec_pareto", "ec_cancel_by_product", "ec_revenue_by_category", "ec_bundles",
                         "ec_color_distribution", "ec_color_pairs", "ec_size_distribution", "ec_multi_size_customers", "ec_product_lifecycle",
                         "ec_lifecycle_stages", "ec_cross_sell", "ec_category_pricing", "ec_underpriced", "ec_overpriced", "ec_vip_products",
                         "ec_churn_products"],
        "product_price": ["ec_bundles", "ec_price_stats", "ec_price_sweet_spots", "ec_category_pricing", "ec_underpriced", "ec_overpriced"],
        "sku": ["ec_sku_variants"],
    },
    "orders": {
        "email": ["ec_rfm_scores", "ec_rfm_segments", "ec_clv", "ec_clv_top", "ec_clv_quartiles", "ec_cohort_matrix", "ec_cohort_curve", "ec_repurchase",
                  "ec_purchase_gaps", "ec_order_count_distribution", "ec_new_vs_returning", "ec_upgrade_pattern", "ec_top_upgraders",
                  "ec_vip_customers", "ec_vip_summary", "ec_vip_products", "ec_vip_states", "ec_churn", "ec_churn_products", "ec_niche_clusters"],
        "state": ["ec_geo_revenue", "ec_shipping_by_state", "ec_vip_states", "ec_shipping_method_crosstab"],
        "city": ["ec_city_penetration"], "coupon": ["ec_top_coupons"], "channel": ["ec_revenue_by_channel", "ec_channel_analysis"],
        "payment_method": ["ec_payment_mix", "ec_payment_mix_monthly", "ec_cancel_by_payment"],
        "shipping_method": ["ec_shipping_method_crosstab", "ec_fulfillment_by_method"],
        "shipping_date": ["ec_fulfillment_stats", "ec_fulfillment_by_method", "ec_fulfillment_monthly"],
    },
}
SETS = {("store", "lite"): STORE_LITE, ("store", "full"): STORE_FULL, ("search", "lite"): SEARCH_LITE,
        ("search", "full"): SEARCH_FULL, ("social", "lite"): SOCIAL_LITE, ("social", "full"): SOCIAL_FULL}
INPUTS = {"store": ["lines"], "search": ["campaign"], "social": ["social"]}


def missing_columns(ctx, keys: list[str]) -> dict[str, str]:
    """Analysis -> the required columns that its table lacks or holds no value of; one aggregate per table."""
    out: dict[str, list[str]] = {}
    for table, columns in REQUIRED.items():
        wanted = [c for c, users in columns.items() if set(users) & set(keys)]
        if wanted:
            held = required_columns(ctx.table(table), wanted).first()
            for c in wanted:
                for key in columns[c] if not held[c] else []:
                    out.setdefault(key, []).append(c)
    return {key: ", ".join(cols) for key, cols in out.items()}


def run_catalogue(ctx, domain: str, mode: str = "lite", params: dict | None = None, path: str | None = None,
                  fmt: str = "parquet") -> tuple[dict[str, DataFrame], DataFrame]:
    """Run every analysis of a set; returns (results, status).

    Each plan runs once: its result is written below ``path`` (a scratch folder unless given) while its rows are
    counted by an observation, and ``results`` reads it back.  An analysis whose inputs or required columns are
    missing, or whose result is empty (the reference's "not enough data" guards), is marked ``skipped``; one that
    fails is marked ``error`` with its message, and the others go on.
    """
    params = params or {}
    spark, keys = ctx.spark, SETS[(domain, mode)]
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/catalogue-{uuid.uuid4().hex}"
    results: dict[str, DataFrame] = {}
    status: list[tuple[str, str, str | None]] = []
    missing = [t for t in INPUTS[domain] if not ctx.has(t)]
    if missing:
        status = [(key, "skipped", f"missing input: {', '.join(missing)}") for key in keys]
        return results, spark.createDataFrame(status, STATUS)
    lacking = missing_columns(ctx, keys) if domain == "store" else {}
    for key in keys:
        if key in lacking:
            status.append((key, "skipped", f"missing columns: {lacking[key]}"))
            continue
        try:
            df = REGISTRY[key](ctx, **params.get(key, {}))
            seen = Observation(key)
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").format(fmt).save(f"{path}/{key}")
            results[key] = spark.read.schema(df.schema).format(fmt).load(f"{path}/{key}")
            rows = seen.get["rows"]
            status.append((key, "ok", None) if rows else (key, "skipped", "insufficient data"))
        except MissingTable as e:
            status.append((key, "skipped", f"missing input: {e}"))
        except Exception as e:  # one analysis must not end the run; its message is the row
            status.append((key, "error", f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:500]))
    return results, spark.createDataFrame(status, STATUS)


STATUS = "analysis string, status string, reason string"


def write_results(results: dict[str, DataFrame], status: DataFrame, path: str) -> None:
    """JSON sink: one folder per analysis plus the run status (nulls stay null)."""
    for key, df in results.items():
        df.write.mode("overwrite").json(f"{path}/{key}")
    status.write.mode("overwrite").json(f"{path}/_status")
