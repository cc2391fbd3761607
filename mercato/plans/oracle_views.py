"""The canonical fixture views in DuckDB SQL (the oracle's side).

Mirrors ``mercato.sources.fixtures`` row for row.  Each oracle query is
``PRELUDE`` followed by a body that reads the views ``lines``, ``ords``,
``camp``, ``social``, ``kw``, ``st``, ``ads`` and ``auction``.
"""

PRELUDE = r"""
WITH
orders_base AS (
  SELECT o.o_orderkey AS order_key,
         CAST(o.o_orderkey AS VARCHAR) AS order_id,
         'c' || CAST(o.o_custkey AS VARCHAR) || '@example.com' AS email,
         o.o_orderdate AS "date",
         CASE o.o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' WHEN 'P' THEN 'cancelled' END AS order_status,
         'paid' AS payment_status,
         'shipped' AS shipping_status,
         'USD' AS currency,
         o.o_totalprice AS subtotal,
         CASE WHEN o.o_orderkey % 4 = 0 THEN o.o_totalprice * 0.1 ELSE 0.0 END AS discount,
         CASE WHEN o.o_orderkey % 3 = 0 THEN 0.0 ELSE CAST(500 + 100 * (o.o_orderkey % 7) AS DOUBLE) END AS shipping_cost,
         o.o_totalprice AS total,
         c.c_name AS customer_name,
         CAST(NULL AS VARCHAR) AS phone,
         CAST(NULL AS VARCHAR) AS shipping_address,
         n.n_name || '-' || CAST(c.c_custkey % 4 AS VARCHAR) AS city,
         CAST(NULL AS VARCHAR) AS locality,
         n.n_name AS state,
         'AR' AS country,
         CAST(NULL AS VARCHAR) AS zip_code,
         'M' || CAST(o.o_orderkey % 4 AS VARCHAR) AS shipping_method,
         c.c_mktsegment AS payment_method,
         CASE WHEN o.o_orderkey % 4 = 0 THEN 'CUP' || CAST(o.o_orderkey % 3 AS VARCHAR) END AS coupon,
         o.o_orderdate AS payment_date,
         o.o_orderdate + to_days(CAST(o.o_orderkey % 9 AS INTEGER)) AS shipping_date,
         o.o_orderpriority AS channel,
         CASE WHEN o.o_orderstatus = 'P' THEN o.o_orderdate + to_days(CAST(o.o_orderkey % 5 + 1 AS INTEGER)) END AS cancellation_date,
         CASE WHEN o.o_orderstatus = 'P' THEN 'r' || CAST(o.o_orderkey % 5 AS VARCHAR) END AS cancellation_reason
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
),
ords AS (
  SELECT * FROM orders_base WHERE order_key IN (SELECT l_orderkey FROM lineitem)
),
lines AS (
  SELECT ob.*,
         l.l_linenumber AS line_no,
         p.p_name || ' - ' || p.p_type AS product_name,
         p.p_retailprice * (1 - l.l_discount) *
           CASE p.p_type WHEN 'SMALL' THEN 0.5 WHEN 'PROMO' THEN 0.6 WHEN 'ECONOMY' THEN 0.8
                         WHEN 'MEDIUM' THEN 1.0 WHEN 'STANDARD' THEN 1.2 WHEN 'LARGE' THEN 2.0 END AS product_price,
         CAST(l.l_quantity AS INTEGER) AS product_qty,
         'SKU' || CAST(p.p_partkey AS VARCHAR) || '-' || (['s', 'm', 'l', 'xl'])[p.p_size % 4 + 1] AS sku
  FROM lineitem l
  JOIN orders_base ob ON l.l_orderkey = ob.order_key
  JOIN part p ON l.l_partkey = p.p_partkey
),
ev_search AS (
  SELECT CAST(ts AS DATE) AS "date", hour(ts) AS hour_of_day, user_id % 60 AS u,
         (['MOBILE', 'DESKTOP', 'TABLET'])[event_id % 3 + 1] AS device,
         count(*) FILTER (WHERE event_type = 'view') AS _views,
         count(*) FILTER (WHERE event_type = 'click') AS _clicks,
         count(*) FILTER (WHERE event_type = 'purchase') AS _purchases,
         count(*) FILTER (WHERE event_type = 'signup') AS _signups,
         count(*) FILTER (WHERE event_type = 'error') AS _errors,
         coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0.0) AS _pvalue,
         coalesce(sum(value) FILTER (WHERE event_type = 'signup'), 0.0) AS _svalue,
         coalesce(sum(value) FILTER (WHERE event_type IN ('click', 'view')), 0.0) AS _spend
  FROM events GROUP BY 1, 2, 3, 4
),
camp AS (
  SELECT "date", hour_of_day, device,
         (['Brand Search ', 'PMax ', 'Display '])[u % 3 + 1] || CAST(u % 6 AS VARCHAR) AS campaign_name,
         (['Search', 'PMax', 'Display'])[u % 3 + 1] AS campaign_type,
         'AS' || CAST(u % 15 AS VARCHAR) AS adset_name,
         (['Shirt', 'Coat', 'Pack', 'Boot'])[u % 4 + 1] || ' | ' || (['UGC', 'video', 'static'])[u % 3 + 1]
           || ' | ' || (['tof', 'bof'])[u % 2 + 1] || ' | Ana | v' || CAST(u % 5 AS VARCHAR) AS ad_name,
         CAST(NULL AS VARCHAR) AS day_of_week,
         100 * _views AS impressions,
         5 * _clicks AS clicks,
         _spend * 0.2 AS cost,
         CAST(_purchases AS DOUBLE) AS conversions,
         _pvalue AS conversion_value,
         CAST(_purchases + _signups AS DOUBLE) AS all_conversions,
         _pvalue + _svalue * 0.5 AS all_conversion_value,
         CAST(_views AS DOUBLE) * 0.05 AS view_through_conversions,
         CASE WHEN u % 2 = 0 THEN 'TARGET_CPA' ELSE 'TARGET_ROAS' END AS bid_strategy_type,
         CASE WHEN u % 2 = 0 THEN CAST(40.0 AS DOUBLE) END AS target_cpa,
         CASE WHEN u % 2 <> 0 THEN CAST(4.0 AS DOUBLE) END AS target_roas,
         CASE WHEN u % 3 <> 2 THEN CAST(45 + 8 * (u % 6) AS DOUBLE) END AS search_impression_share,
         CASE WHEN u % 3 <> 2 THEN CAST(5 + 3 * (u % 6) AS DOUBLE) END AS search_lost_is_rank,
         CASE WHEN u % 3 <> 2 THEN CAST(30 - 4 * (u % 6) AS DOUBLE) END AS search_lost_is_budget,
         CASE WHEN u % 3 <> 2 THEN CAST(20 + 5 * (u % 6) AS DOUBLE) END AS search_top_is,
         CASE WHEN u % 3 <> 2 THEN CAST(10 + 2 * (u % 6) AS DOUBLE) END AS search_abs_top_is,
         CASE WHEN u % 3 = 1 THEN 'AG ' || CAST(u % 15 AS VARCHAR) END AS asset_group_name,
         CASE WHEN u % 3 = 1 THEN (['EXCELLENT', 'GOOD', 'AVERAGE', 'POOR'])[(u % 15) % 4 + 1] END AS ad_strength,
         CAST(NULL AS VARCHAR) AS city,
         'Region ' || CAST(u % 7 AS VARCHAR) AS region,
         'AR' AS country
  FROM ev_search
),
ev_social AS (
  SELECT CAST(ts AS DATE) AS date_start, user_id % 60 AS u,
         (['MOBILE', 'DESKTOP', 'TABLET'])[event_id % 3 + 1] AS device,
         count(*) FILTER (WHERE event_type = 'view') AS _views,
         count(*) FILTER (WHERE event_type = 'click') AS _clicks,
         count(*) FILTER (WHERE event_type = 'purchase') AS _purchases,
         count(*) FILTER (WHERE event_type = 'signup') AS _signups,
         count(*) FILTER (WHERE event_type = 'error') AS _errors,
         coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0.0) AS _pvalue,
         coalesce(sum(value) FILTER (WHERE event_type IN ('click', 'view')), 0.0) AS _spend
  FROM events GROUP BY 1, 2, 3
),
social AS (
  SELECT date_start, device,
         (['Brand Search ', 'PMax ', 'Display '])[u % 3 + 1] || CAST(u % 6 AS VARCHAR) AS campaign_name,
         (['Search', 'PMax', 'Display'])[u % 3 + 1] AS campaign_type,
         'AS' || CAST(u % 15 AS VARCHAR) AS adset_name,
         (['Shirt', 'Coat', 'Pack', 'Boot'])[u % 4 + 1] || ' | ' || (['UGC', 'video', 'static'])[u % 3 + 1]
           || ' | ' || (['tof', 'bof'])[u % 2 + 1] || ' | Ana | v' || CAST(u % 5 AS VARCHAR) AS ad_name,
         (['facebook', 'instagram'])[u % 2 + 1] AS platform,
         (['feed', 'stories', 'reels', 'right_column'])[u % 4 + 1] AS placement,
         'AR' AS country,
         'Region ' || CAST(u % 7 AS VARCHAR) AS region,
         CASE WHEN u % 7 <> 0 THEN (['ABOVE_AVERAGE', 'AVERAGE', 'BELOW_AVERAGE_35'])[u % 3 + 1] END AS quality_ranking,
         (['ABOVE_AVERAGE', 'AVERAGE', 'BELOW_AVERAGE_35'])[(u + 1) % 3 + 1] AS engagement_ranking,
         (['ABOVE_AVERAGE', 'AVERAGE', 'BELOW_AVERAGE_35'])[(u + 2) % 3 + 1] AS conversion_ranking,
         CAST(100 * _views AS DOUBLE) AS impressions,
         CAST(40 * _views AS DOUBLE) AS reach,
         CAST(5 * _clicks AS DOUBLE) AS clicks,
         CAST(3 * _clicks AS DOUBLE) AS link_clicks,
         CAST(2 * _clicks AS DOUBLE) AS landing_page_views,
         CAST(_signups + _purchases AS DOUBLE) AS add_to_cart,
         CAST(_purchases + _errors AS DOUBLE) AS checkout_initiated,
         CAST(_purchases AS DOUBLE) AS purchases,
         CAST(_signups AS DOUBLE) AS leads,
         _spend * 0.2 AS spend,
         _pvalue AS purchase_value,
         CAST(30 * _views + _clicks AS DOUBLE) AS video_3s,
         CAST(20 * _views AS DOUBLE) AS video_p25,
         CAST(12 * _views + _clicks AS DOUBLE) AS video_p50,
         CAST(7 * _views AS DOUBLE) AS video_p75,
         CAST(3 * _views + _errors AS DOUBLE) AS video_p100,
         CAST(5 * _views AS DOUBLE) AS thruplay
  FROM ev_social
),
part_metrics AS (
  SELECT p.*,
         p_retailprice AS cost,
         CAST(100 * p_size AS BIGINT) AS impressions,
         CAST(5 * p_size AS BIGINT) AS clicks,
         CAST(p_size % 4 AS DOUBLE) AS conversions,
         CAST(p_size % 4 AS DOUBLE) * 150.0 AS conversion_value,
         CAST(p_size % 4 AS DOUBLE) AS all_conversions,
         CAST(p_size % 4 AS DOUBLE) * 150.0 AS all_conversion_value,
         (['Brand Search 0', 'PMax 1', 'Brand Search 3'])[p_partkey % 3 + 1] AS campaign_name,
         (['Search', 'PMax', 'Search'])[p_partkey % 3 + 1] AS campaign_type,
         'AG ' || p_brand AS ad_group_name
  FROM part p
),
kw AS (
  SELECT p_name AS keyword,
         (['EXACT', 'PHRASE', 'BROAD'])[p_partkey % 3 + 1] AS match_type,
         CAST(1 + p_size % 10 AS INTEGER) AS quality_score,
         (['Above average', 'Average', 'Below average'])[p_partkey % 3 + 1] AS expected_ctr,
         (['Above average', 'Average', 'Below average'])[(p_partkey // 3) % 3 + 1] AS ad_relevance,
         (['Above average', 'Average', 'Below average'])[(p_partkey // 9) % 3 + 1] AS landing_page_experience,
         cost, impressions, clicks, conversions, conversion_value, all_conversions, all_conversion_value,
         campaign_name, campaign_type, ad_group_name
  FROM part_metrics
),
st AS (
  SELECT p_name || ' ' || lower(p_type) AS search_term,
         CASE WHEN p_partkey % 5 = 0 THEN 'Added' WHEN p_partkey % 5 = 1 THEN 'Excluded' END AS search_term_status,
         cost, impressions, clicks, conversions, conversion_value, all_conversions, all_conversion_value,
         campaign_name, campaign_type, ad_group_name
  FROM part_metrics
),
ads AS (
  SELECT p_name AS headline_1,
         p_name || '|' || p_type || '|' || p_brand AS rsa_headlines,
         (['EXCELLENT', 'GOOD', 'AVERAGE', 'POOR'])[p_partkey % 4 + 1] AS ad_strength,
         cost, impressions, clicks, conversions, conversion_value, all_conversions, all_conversion_value,
         campaign_name, campaign_type, ad_group_name
  FROM part_metrics
),
ev AS (
  SELECT event_id, ts, user_id, event_type, value, (['MOBILE', 'DESKTOP', 'TABLET'])[event_id % 3 + 1] AS channel
  FROM events
),
auction AS (
  SELECT 'rival' || CAST(s_nationkey % 8 AS VARCHAR) || '.com' AS competitor_domain,
         CASE WHEN s_suppkey % 11 <> 0 THEN CAST((s_suppkey * 7 + 10) % 100 AS DOUBLE) END AS auction_is,
         CASE WHEN s_suppkey % 11 <> 0 THEN CAST((s_suppkey * 37 + 3) % 100 AS DOUBLE) END AS auction_overlap,
         CASE WHEN s_suppkey % 11 <> 0 THEN CAST((s_suppkey * 53 + 11) % 100 AS DOUBLE) END AS auction_outranking,
         CASE WHEN s_suppkey % 11 <> 0 THEN CAST((s_suppkey * 17 + 5) % 100 AS DOUBLE) END AS auction_pos_above,
         CASE WHEN s_suppkey % 11 <> 0 THEN CAST((s_suppkey * 29 + 1) % 100 AS DOUBLE) END AS auction_top_rate,
         CASE WHEN s_suppkey % 11 <> 0 THEN CAST((s_suppkey * 13 + 7) % 100 AS DOUBLE) END AS auction_abs_top_rate
  FROM supplier
)
"""


def with_views(body: str) -> str:
    return PRELUDE + body
