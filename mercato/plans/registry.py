"""Operator registry: key -> callable(ctx) -> DataFrame, with lite/full run sets."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from mercato.operators.search import report as ga
from mercato.operators.search.saved import REPORTS, saved
from mercato.operators.social import report as ma
from mercato.operators.store import basket as bk
from mercato.operators.store import customer as cu
from mercato.operators.store import operations as ops
from mercato.operators.store import product as pd_
from mercato.operators.store import orders as so
from mercato.operators.store import revenue as rv

Op = Callable[..., DataFrame]

REGISTRY: dict[str, Op] = {}


def register(key: str, fn: Op, **params) -> None:
    REGISTRY[key] = functools.partial(fn, **params) if params else fn


# ------------------------------------------------------------------ store
register("op_orders_from_lines", so.orders_table)
register("ec_summary", so.summary)
register("ec_monthly_revenue", rv.monthly_revenue)
register("ec_revenue_trend", rv.revenue_trend)
register("ec_ticket_stats", rv.ticket_stats)
register("ec_ticket_histogram", rv.ticket_histogram)
register("ec_ticket_monthly", rv.ticket_monthly)
register("ec_new_vs_returning", rv.new_vs_returning)
register("ec_discount_impact", rv.discount_impact)
register("ec_top_coupons", rv.top_coupons)
register("ec_payment_mix", rv.payment_mix)
register("ec_payment_mix_monthly", rv.payment_mix_monthly)
register("ec_season_month", rv.season_month)
register("ec_season_dow", rv.season_dow)
register("ec_season_hour", rv.season_hour)
register("ec_season_peaks", rv.season_peaks)
register("ec_revenue_by_channel", rv.revenue_by_channel)
register("ec_forecast", rv.forecast)
register("ec_forecast_history", rv.forecast_history)

register("ec_rfm_scores", cu.rfm_scores)
register("ec_rfm_segments", cu.rfm_segments)
register("ec_clv", cu.clv)
register("ec_clv_top", cu.clv_top)
register("ec_clv_quartiles", cu.clv_quartiles)
register("ec_cohort_matrix", cu.cohort_matrix)
register("ec_cohort_curve", cu.cohort_curve)
register("ec_repurchase", cu.repurchase)
register("ec_order_count_distribution", cu.order_count_distribution)
register("ec_purchase_gaps", cu.purchase_gaps)
register("ec_upgrade_pattern", cu.upgrade_pattern)
register("ec_top_upgraders", cu.top_upgraders)
register("ec_vip_customers", cu.vip_customers)
register("ec_vip_summary", cu.vip_summary)
register("ec_vip_products", cu.vip_products)
register("ec_vip_states", cu.vip_states)
register("ec_churn", cu.churn)
register("ec_churn_products", cu.churn_products)
register("ec_niche_clusters", cu.niche_clusters)

register("ec_product_ranking", pd_.product_ranking)
register("ec_anchor_products", pd_.anchor_products)
register("ec_pareto", pd_.pareto)
register("ec_cancel_by_product", pd_.cancel_by_product)
register("ec_revenue_by_category", pd_.revenue_by_category)
register("ec_category_distribution", pd_.category_distribution)
register("ec_color_distribution", pd_.color_distribution)
register("ec_color_pairs", bk.color_pairs)
register("ec_size_distribution", pd_.size_distribution)
register("ec_multi_size_customers", pd_.multi_size_customers)
register("ec_sku_variants", pd_.sku_variants)
register("ec_product_lifecycle", pd_.product_lifecycle)
register("ec_lifecycle_stages", pd_.lifecycle_stages)
register("ec_price_stats", pd_.price_stats)
register("ec_price_sweet_spots", pd_.price_sweet_spots)
register("ec_category_pricing", pd_.category_pricing)
register("ec_underpriced", pd_.underpriced)
register("ec_overpriced", pd_.overpriced)

register("ec_basket_pairs", bk.basket_pairs)
register("ec_basket_trios", bk.basket_trios)
register("ec_basket_summary", bk.basket_summary)
register("ec_category_affinity", bk.category_affinity)
register("ec_bundles", bk.bundles)
register("ec_cross_sell", bk.cross_sell)

register("ec_geo_revenue", ops.geo_revenue)
register("ec_shipping_by_state", ops.shipping_by_state)
register("ec_cancel_rate", ops.cancel_rate)
register("ec_cancel_monthly", ops.cancel_monthly)
register("ec_cancel_reasons", ops.cancel_reasons)
register("ec_cancel_by_payment", ops.cancel_by_payment)
register("ec_city_penetration", ops.city_penetration)
register("ec_shipping_method_crosstab", ops.shipping_method_crosstab)
register("ec_fulfillment_stats", ops.fulfillment_stats)
register("ec_fulfillment_by_method", ops.fulfillment_by_method)
register("ec_fulfillment_monthly", ops.fulfillment_monthly)
register("ec_channel_analysis", ops.channel_analysis)
register("ec_free_shipping", ops.free_shipping)
register("ec_free_shipping_retention", ops.free_shipping_retention)

# ------------------------------------------------------------------ search ads
register("ga_totals", ga.ga_totals)
register("ga_aggregate_by", ga.ga_aggregate_by)
register("ga_by_date", ga.ga_by_date)
register("ga_date_range", ga.ga_date_range)
register("ga_daily", ga.ga_daily)
register("ga_daily_ma7", ga.ga_daily_ma7)
register("ga_daily_trend", ga.ga_daily_trend)
register("ga_campaigns", ga.ga_campaigns)
register("ga_budget_vs_results", ga.ga_budget_vs_results)
register("ga_bidding_status", ga.ga_bidding_status)
register("ga_bidding_summary", ga.ga_bidding_summary)
register("ga_qs_histogram", ga.ga_qs_histogram)
register("ga_qs_weighted", ga.ga_qs_weighted)
register("ga_qs_components", ga.ga_qs_components)
register("ga_low_qs_spend", ga.ga_low_qs_spend)
register("ga_top_keywords", ga.ga_top_keywords)
register("ga_impression_share", ga.ga_impression_share)
register("ga_wasted_spend", ga.ga_wasted_spend)
register("ga_wasted_terms", ga.ga_wasted_terms)
register("ga_keyword_opportunities", ga.ga_keyword_opportunities)
register("ga_ad_ranking", ga.ga_ad_ranking)
register("ga_ad_strength", ga.ga_ad_strength)
register("ga_poor_ads", ga.ga_poor_ads)
register("ga_funnel", ga.ga_funnel)
register("ga_dow", ga.ga_dow)
register("ga_hour", ga.ga_hour)
register("ga_best_worst", ga.ga_best_worst)
register("ga_geo", ga.ga_geo)
register("ga_device", ga.ga_device)
register("ga_asset_groups", ga.ga_asset_groups)
register("ga_asset_group_strength", ga.ga_asset_group_strength)
register("ga_brand_overlap", ga.ga_brand_overlap)
register("ga_weekly_drift", ga.ga_weekly_drift)
register("ga_drift_trend", ga.ga_drift_trend)
register("ga_match_type", ga.ga_match_type)
register("ga_negative_words", ga.ga_negative_words)
register("ga_headlines_ctr", ga.ga_headlines_ctr)
register("ga_headlines_conv", ga.ga_headlines_conv)
register("ga_conversion_health", ga.ga_conversion_health)
register("ga_attribution_bias", ga.ga_attribution_bias)
register("ga_auction_insights", ga.ga_auction_insights)
register("ga_scaling_forecast", ga.ga_scaling_forecast)
register("ga_scaling_scenarios", ga.ga_scaling_scenarios)
register("ga_conversion_lag_flag", ga.ga_conversion_lag_flag)
register("ga_dashboard", ga.ga_dashboard)
register("ga_benchmarks", ga.ga_benchmarks)
register("ga_summary", ga.ga_summary)
register("ga_signals", ga.ga_signals)
register("ga_learning_period", ga.ga_learning_period)
register("ga_learning_summary", ga.ga_learning_summary)
for _name in REPORTS:
    register(f"ga_saved_{_name}", saved(_name))

# ------------------------------------------------------------------ social ads
register("ma_dashboard", ma.ma_dashboard)
register("ma_benchmarks", ma.ma_benchmarks)
register("ma_daily", ma.ma_daily)
register("ma_campaigns", ma.ma_campaigns)
register("ma_budget_distribution", ma.ma_budget_distribution)
register("ma_learning_phase", ma.ma_learning_phase)
register("ma_learning_summary", ma.ma_learning_summary)
register("ma_adsets", ma.ma_adsets)
register("ma_audiences", ma.ma_audiences)
register("ma_ad_ranking", ma.ma_ad_ranking)
register("ma_creative_fatigue", ma.ma_creative_fatigue)
register("ma_funnel", ma.ma_funnel)
register("ma_dropoff", ma.ma_dropoff)
register("ma_dow", ma.ma_dow)
register("ma_period_trend", ma.ma_period_trend)
register("ma_roas_direction", ma.ma_roas_direction)
register("ma_geo", ma.ma_geo)
register("ma_placement", ma.ma_placement)
register("ma_device", ma.ma_device)
register("ma_signals", ma.ma_signals)
register("ma_name_detect", ma.ma_name_detect)
register("ma_name_parse", ma.ma_name_parse)
register("ma_name_parse_standard", ma.ma_name_parse_standard)
register("ma_name_parse_alternative", ma.ma_name_parse_alternative)
register("ma_name_summary", ma.ma_name_summary)
register("ma_by_format", ma.ma_by_format)
register("ma_by_stage", ma.ma_by_stage)
register("ma_by_creator", ma.ma_by_creator)
register("ma_by_product", ma.ma_by_product)
register("ma_format_stage_matrix", ma.ma_format_stage_matrix)
register("ma_relevance", ma.ma_relevance)
register("ma_relevance_distribution", ma.ma_relevance_distribution)
register("ma_hook_rate", ma.ma_hook_rate)
register("ma_video_completion", ma.ma_video_completion)
register("ma_video_completion_ads", ma.ma_video_completion_ads)
register("ma_forecast", ma.ma_forecast)
register("ma_overlap_cv", ma.ma_overlap_cv)
register("ma_pacing", ma.ma_pacing)
register("ma_marginal_cpa", ma.ma_marginal_cpa)
register("ma_marginal_trend", ma.ma_marginal_trend)

from mercato.operators.social import windows as mw  # noqa: E402

register("ma_attribution_windows", mw.ma_attribution_windows)

# ------------------------------------------------------------------ readers
from mercato.sources import roundtrip as rt  # noqa: E402

register("src_store_csv", rt.src_store_csv)
register("src_orders_from_export", rt.src_orders_from_export)
register("src_ads_csv", rt.src_ads_csv)
register("src_social_json", rt.src_social_json)

# ------------------------------------------------------------------ catalogue extensions
from mercato.operators.store import extensions as ecx  # noqa: E402

register("ext_pareto_cutoffs", ecx.pareto_cutoffs)
register("ext_gap_segments", ecx.gap_segments)
register("ext_category_monthly", ecx.category_monthly)
register("ext_shipping_correlation", ecx.shipping_correlation)
register("ext_season_index", ecx.season_index)
register("ext_sku_concentration", ecx.sku_concentration)
register("ext_lifecycle_slope", ecx.lifecycle_slope)
register("ext_upgrade_tenure_corr", ecx.upgrade_tenure_corr)
register("ext_vip_vs_rest", ecx.vip_vs_rest)
register("ext_churn_by_cohort", ecx.churn_by_cohort)
register("ext_last_product", ecx.last_product)
register("ext_dominant_method", ecx.dominant_method)
register("ext_channel_repeat_rate", ecx.channel_repeat_rate)
register("ext_free_threshold", ecx.free_threshold)
register("ext_forecast_quality", ecx.forecast_quality)
register("ext_high_aov_low_volume", ecx.high_aov_low_volume)

from mercato.operators.social import extensions as acx  # noqa: E402

register("ext_lost_impressions", acx.lost_impressions)
register("ext_day_hour_heatmap", acx.day_hour_heatmap)
register("ext_prior_period", acx.prior_period)
register("ext_brand_split", acx.brand_split)
register("ext_is_quadrant", acx.is_quadrant)
register("ext_wasted_ratio", acx.wasted_ratio)
register("ext_rsa_audit", acx.rsa_audit)
register("ext_winners_losers", acx.winners_losers)
register("ext_relevance_score", acx.relevance_score)
register("ext_hook_class", acx.hook_class)
register("ext_video_dropoff", acx.video_dropoff)
register("ext_weekly_cpa_corr", acx.weekly_cpa_corr)
register("ext_roas_slope", acx.roas_slope)
register("ext_audience_type", acx.audience_type)
register("ext_overlap_by_campaign", acx.overlap_by_campaign)
register("ext_fatigue_class", acx.fatigue_class)

register("ext_low_volume_bidding", acx.low_volume_bidding)
register("ext_qs_component", acx.qs_component)
register("ext_pmax_before_after", acx.pmax_before_after)
register("ext_sustained_cpa", acx.sustained_cpa)
register("ext_metric_divergence", acx.metric_divergence)
register("ext_budget_guard", acx.budget_guard)
register("ext_branded_share", acx.branded_share)
register("ext_weekday_guard", acx.weekday_guard)
register("ext_custom_name_regex", acx.custom_name_regex)
register("ext_size_pairs", ecx.size_pairs)
register("ext_price_elasticity", ecx.price_elasticity)
register("ext_kmeans_elbow", ecx.kmeans_elbow)
register("ext_degraded_months", ecx.degraded_months)

from mercato.operators.social import attribution as atx  # noqa: E402

register("ext_attribution_models", atx.attribution_models)
register("ext_relevance_scenario", acx.relevance_scenario)
register("ext_same_period_comparison", acx.same_period_comparison)
register("ext_is_decline", acx.is_decline)


def run(ctx, key: str, **params) -> DataFrame:
    return REGISTRY[key](ctx, **params)
