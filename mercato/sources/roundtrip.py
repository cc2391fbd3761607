"""Reader checks on data derived from the benchmark tables.

Each function writes a canonical view in a platform's export layout (the
Tiendanube CSV, the search-ads CSV with its preamble, the social API JSON with
action arrays) under the shared checkpoint folder, then reads it back with the
matching reader.  The result must equal the view it came from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.session import ensure_checkpoint_dir
from mercato.sources import search, social, store

STORE_COLUMNS = ['order_id', 'email', 'date', 'order_status', 'total', 'discount', 'shipping_cost', 'coupon',
                 'state', 'city', 'payment_method', 'shipping_date', 'product_name', 'product_price', 'product_qty',
                 'sku', 'channel', 'cancellation_reason']
ADS_COLUMNS = ['campaign_name', 'campaign_type', 'date', 'hour_of_day', 'device', 'impressions', 'clicks', 'cost',
               'conversions', 'conversion_value', 'all_conversions', 'bid_strategy_type', 'target_cpa',
               'target_roas', 'search_impression_share', 'region']
SOCIAL_COLUMNS = ['campaign_name', 'adset_name', 'ad_name', 'date_start', 'impressions', 'reach', 'spend', 'clicks',
                  'device', 'placement', 'region', 'country', 'quality_ranking', 'engagement_ranking',
                  'conversion_ranking', 'purchases', 'leads', 'link_clicks', 'landing_page_views', 'add_to_cart',
                  'checkout_initiated', 'purchase_value']


def _folder(ctx, name: str) -> str:
    return f"{ensure_checkpoint_dir(ctx.spark).rstrip('/')}/exports/{name}-{uuid.uuid4().hex[:8]}"


def src_store_csv(ctx) -> DataFrame:
    path = _folder(ctx, "store")
    store.export_tiendanube_csv(ctx.lines, path)
    lines, platform = store.read_store_csv(ctx.spark, path)
    assert platform == "tiendanube", platform
    return lines.select(*STORE_COLUMNS)


def src_ads_csv(ctx) -> DataFrame:
    path = _folder(ctx, "ads")
    search.export_ads_csv(ctx.campaign, path, currency="USD")
    rows, report, currency = search.read_ads_csv(ctx.spark, path)
    assert report == "campaign" and currency == "USD", (report, currency)
    return rows.select(*ADS_COLUMNS)


def src_social_json(ctx) -> DataFrame:
    path = _folder(ctx, "social")
    social.export_social_json(ctx.social, path)
    return social.read_social_json(ctx.spark, path).select(*SOCIAL_COLUMNS)


def src_orders_from_export(ctx) -> DataFrame:
    """Order table derived from the re-read export (first non-null value per order in line order)."""
    path = _folder(ctx, "store-orders")
    store.export_tiendanube_csv(ctx.lines, path)
    lines, _ = store.read_store_csv(ctx.spark, path)
    return store.orders_of(lines).select("order_id", "email", "date", "order_status", "total", "state",
                                         F.col("shipping_cost"))
