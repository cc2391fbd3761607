"""Oracle SQL (DuckDB) for the catalogue extensions."""

from mercato.plans import oracle_store as S
from mercato.plans.oracle_search import SD

SQL = {}

SQL["ext_pareto_cutoffs"] = f"""
, l AS (SELECT product_name, sum({S.REV}) AS revenue FROM lines WHERE product_name IS NOT NULL GROUP BY 1),
t AS (SELECT sum(revenue) AS tot, count(*) AS n FROM l),
c AS (SELECT sum(revenue) OVER (ORDER BY revenue DESC, product_name ROWS UNBOUNDED PRECEDING)
             / (SELECT tot FROM t) * 100 AS cum FROM l)
SELECT CAST(s.share AS INTEGER) AS share,
       least((SELECT count(*) FROM c WHERE cum <= s.share) + 1, (SELECT n FROM t)) AS products_needed,
       least((SELECT count(*) FROM c WHERE cum <= s.share) + 1, (SELECT n FROM t)) * 100.0 / (SELECT n FROM t)
         AS pct_products
FROM (VALUES (70), (80), (90)) s(share)
"""

SQL["ext_gap_segments"] = f"""
, d AS (SELECT DISTINCT email, "date" FROM ords WHERE email IS NOT NULL AND "date" IS NOT NULL),
g AS (SELECT email, {S.DAYS_BETWEEN.format(a='lag("date") OVER (PARTITION BY email ORDER BY "date")', b='"date"')} AS gap
      FROM d),
m AS (SELECT email, quantile_cont(gap, 0.5) AS m0 FROM g WHERE gap > 0 GROUP BY email)
SELECT CASE WHEN m0 < 30 THEN 'frequent' WHEN m0 < 90 THEN 'occasional' ELSE 'sporadic' END AS segment,
       count(*) AS customers, avg(m0) AS avg_median_gap
FROM m GROUP BY 1
"""

SQL["ext_category_monthly"] = f"""
, l AS (SELECT *, {S.CATEGORY} AS category, {S.REV} AS rev FROM lines WHERE product_name IS NOT NULL),
b AS (SELECT category FROM l GROUP BY 1 ORDER BY sum(rev) DESC, category LIMIT 10)
SELECT strftime("date", '%Y-%m') AS month, category, sum(rev) AS revenue
FROM l WHERE "date" IS NOT NULL AND category IN (SELECT category FROM b) GROUP BY 1, 2
"""

SQL["ext_shipping_correlation"] = f"""
, g AS (SELECT state, avg(shipping_cost) AS avg_shipping, count(DISTINCT order_id) AS orders, avg(total) AS avg_total
        FROM ords WHERE state IS NOT NULL AND state <> '' GROUP BY 1)
SELECT state, avg_shipping, orders, {SD('avg_shipping * 100', 'avg_total')} AS shipping_pct_of_ticket,
       {SD('avg_shipping * 100', 'avg_total')} > 15.0 AS flagged,
       (SELECT corr(avg_shipping, CAST(orders AS DOUBLE)) FROM g) AS corr_cost_volume
FROM g
"""

SQL["ext_season_index"] = f"""
, m AS (SELECT CAST(month("date") AS INTEGER) AS month_num, sum(total) AS revenue FROM {S.VALID} GROUP BY 1)
SELECT month_num, revenue, {SD('revenue', '(SELECT avg(revenue) FROM m)')} AS season_index FROM m
"""

SQL["ext_sku_concentration"] = f"""
, v AS (SELECT {S.VARIANT_BASE} AS base, sku, sum({S.REV}) AS revenue FROM lines
        WHERE sku IS NOT NULL AND sku <> '' AND product_name IS NOT NULL GROUP BY 1, 2)
SELECT base, count(*) AS skus, {SD('max(revenue)', 'sum(revenue)')} * 100 AS top_variant_share_pct
FROM v GROUP BY base HAVING count(*) >= 2
"""

SQL["ext_lifecycle_slope"] = f"""
, mon AS (SELECT product_name, CAST(date_trunc('month', "date") AS DATE) AS m, sum({S.REV}) AS rev FROM lines
          WHERE product_name IS NOT NULL AND "date" IS NOT NULL GROUP BY 1, 2),
e AS (SELECT *, count(*) OVER (PARTITION BY product_name) AS n,
             row_number() OVER (PARTITION BY product_name ORDER BY m DESC) AS r FROM mon),
el AS (SELECT * FROM e WHERE n >= 6),
fit AS (SELECT product_name, regr_slope(rev, CAST(3 - r AS DOUBLE)) AS slope, avg(rev) AS mean
        FROM el WHERE r <= 3 GROUP BY 1),
pk AS (SELECT product_name, strftime(arg_max(m, (rev, -epoch(m))), '%Y-%m') AS peak_month FROM el GROUP BY 1)
SELECT product_name, slope, {SD('slope * 100', 'mean')} AS slope_pct, peak_month,
       CASE WHEN {SD('slope * 100', 'mean')} > 10 THEN 'Growth' WHEN abs({SD('slope * 100', 'mean')}) < 5 THEN 'Maturity'
            WHEN {SD('slope * 100', 'mean')} < -10 THEN 'Decline' ELSE 'Transition' END AS stage
FROM fit JOIN pk USING (product_name)
"""

SQL["ext_upgrade_tenure_corr"] = S.UPG + f"""
, tn AS (SELECT email, {S.DAYS_BETWEEN.format(a='min("date")', b='max("date")')} AS tenure_days FROM o GROUP BY 1)
SELECT count(*) AS customers, corr(CAST(tenure_days AS DOUBLE), change_pct) AS corr_tenure_change
FROM uu JOIN tn USING (email)
"""

SQL["ext_vip_vs_rest"] = S.VIP + """
SELECT CASE WHEN email IN (SELECT email FROM v) THEN 'vip' ELSE 'rest' END AS segment, count(*) AS customers,
       avg(revenue) AS avg_revenue, avg(orders) AS avg_orders, avg(aov) AS avg_aov
FROM c GROUP BY 1
"""

SQL["ext_churn_by_cohort"] = S.CHURN + """
SELECT strftime(f, '%Y-%m') AS cohort, count(*) AS customers, count(*) FILTER (WHERE is_churned) AS churned,
       count(*) FILTER (WHERE is_churned) * 100.0 / count(*) AS churn_rate
FROM cc GROUP BY 1
"""

SQL["ext_last_product"] = S.CHURN + """
, lp AS (SELECT email, arg_max(product_name, ("date", order_id, line_no, product_name)) AS product_name FROM lines
         WHERE product_name IS NOT NULL AND "date" IS NOT NULL AND email IN (SELECT email FROM cc WHERE is_churned)
         GROUP BY 1)
SELECT product_name, count(*) AS customers FROM lp GROUP BY 1 ORDER BY customers DESC, product_name LIMIT 10
"""

SQL["ext_dominant_method"] = """
, g AS (SELECT state, shipping_method, count(*) AS orders FROM ords
        WHERE shipping_method IS NOT NULL AND state IS NOT NULL GROUP BY 1, 2),
t AS (SELECT state, sum(orders) AS tot, arg_max(shipping_method, (orders, shipping_method)) AS method,
             max(orders) AS top FROM g GROUP BY 1)
SELECT state, method, top * 100.0 / tot AS share_pct, top * 100.0 / tot > 80.0 AS dominant FROM t
"""

SQL["ext_channel_repeat_rate"] = """
, per AS (SELECT channel, email, count(DISTINCT order_id) AS n FROM ords
          WHERE channel IS NOT NULL AND channel <> '' AND email IS NOT NULL GROUP BY 1, 2)
SELECT channel, count(*) AS customers, count(*) FILTER (WHERE n >= 2) AS repeat_customers,
       count(*) FILTER (WHERE n >= 2) * 100.0 / count(*) AS repeat_rate
FROM per GROUP BY 1
"""

SQL["ext_free_threshold"] = """
SELECT quantile_cont(total, 0.1) AS p10_ticket_free_shipping, count(*) AS free_orders
FROM ords WHERE total > 0 AND coalesce(shipping_cost, 0.0) = 0
"""

SQL["ext_forecast_quality"] = S._SERIES + """
, e AS (SELECT s.revenue - (c.m * s.idx + c.b) AS e, s.revenue AS y FROM s, coef2 c)
SELECT avg(abs(e)) AS mae, avg(abs(e) / y) FILTER (WHERE y > 0) AS mape,
       1 - sum(e * e) / sum((y - (SELECT avg(revenue) FROM s)) * (y - (SELECT avg(revenue) FROM s))) AS r_squared
FROM e
"""

SQL["ext_high_aov_low_volume"] = """
, g AS (SELECT city, avg(total) AS aov, count(DISTINCT order_id) AS orders, sum(total) AS revenue FROM ords
        WHERE city IS NOT NULL AND city <> '' GROUP BY 1)
SELECT * FROM g WHERE aov >= (SELECT quantile_cont(aov, 0.75) FROM g)
                  AND orders <= (SELECT quantile_cont(orders, 0.25) FROM g)
"""

# ------------------------------------------------------------------ ads extensions
SQL["ext_lost_impressions"] = f"""
, g AS (SELECT campaign_name AS campaign, CAST(coalesce(sum(impressions), 0) AS BIGINT) AS impressions,
               {SD('sum(search_impression_share * impressions)', 'sum(impressions)')} AS weighted_is
        FROM camp WHERE search_impression_share > 0 GROUP BY 1)
SELECT *, CASE WHEN weighted_is > 0 THEN impressions * (100 / weighted_is - 1) END AS lost_impressions FROM g
"""

SQL["ext_day_hour_heatmap"] = f"""
, g AS (SELECT dayname("date") AS day, CAST(hour_of_day AS INTEGER) AS hour, coalesce(sum(cost), 0.0) AS cost,
               coalesce(sum(conversions), 0.0) AS conversions, coalesce(sum(clicks), 0) AS c
        FROM camp WHERE "date" IS NOT NULL AND hour_of_day IS NOT NULL GROUP BY 1, 2)
SELECT day, hour, cost, conversions, {SD('cost', 'conversions')} AS cpa, {SD('conversions', 'c')} * 100 AS conv_rate
FROM g
"""

SQL["ext_prior_period"] = f"""
, e AS (SELECT max("date") - 7 AS e FROM camp WHERE "date" IS NOT NULL),
a AS (SELECT coalesce(sum(cost) FILTER (WHERE "date" > e - 14 AND "date" <= e), 0.0) AS cc,
             coalesce(sum(conversions) FILTER (WHERE "date" > e - 14 AND "date" <= e), 0.0) AS vc,
             coalesce(sum(conversion_value) FILTER (WHERE "date" > e - 14 AND "date" <= e), 0.0) AS xc,
             coalesce(sum(cost) FILTER (WHERE "date" > e - 28 AND "date" <= e - 14), 0.0) AS cp,
             coalesce(sum(conversions) FILTER (WHERE "date" > e - 28 AND "date" <= e - 14), 0.0) AS vp,
             coalesce(sum(conversion_value) FILTER (WHERE "date" > e - 28 AND "date" <= e - 14), 0.0) AS xp
      FROM camp, e WHERE "date" IS NOT NULL),
r AS (SELECT 'cost' AS metric, cc AS current, cp AS prior FROM a
      UNION ALL SELECT 'conversions', vc, vp FROM a
      UNION ALL SELECT 'cpa', {SD('cc', 'vc')}, {SD('cp', 'vp')} FROM a
      UNION ALL SELECT 'roas', {SD('xc', 'cc')}, {SD('xp', 'cp')} FROM a)
SELECT *, CASE WHEN prior > 0 THEN (current - prior) / prior * 100 END AS change_pct FROM r
"""

SQL["ext_brand_split"] = f"""
, g AS (SELECT CASE WHEN regexp_matches(campaign_name, '(?i)brand') THEN 'branded' ELSE 'other' END AS segment,
               coalesce(sum(cost), 0.0) AS cost, coalesce(sum(conversions), 0.0) AS conversions,
               coalesce(sum(conversion_value), 0.0) AS conversion_value FROM camp GROUP BY 1)
SELECT *, {SD('conversion_value', 'cost')} AS roas, {SD('cost', 'conversions')} AS cpa FROM g
"""

SQL["ext_is_quadrant"] = """
, g AS (SELECT campaign_name AS campaign, min(search_lost_is_budget) AS lost_budget, min(search_lost_is_rank) AS lost_rank
        FROM camp WHERE campaign_name IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN coalesce(lost_budget, 0) >= 10 AND coalesce(lost_rank, 0) >= 10 THEN 'fix rank first'
               WHEN coalesce(lost_budget, 0) >= 10 THEN 'increase budget'
               WHEN coalesce(lost_rank, 0) >= 10 THEN 'improve rank' ELSE 'healthy' END AS action
FROM g WHERE lost_budget IS NOT NULL OR lost_rank IS NOT NULL
"""

SQL["ext_wasted_ratio"] = f"""
, z AS (SELECT * FROM st WHERE coalesce(conversions, 0.0) = 0 AND coalesce(cost, 0.0) > 0),
w AS (SELECT {SD('coalesce(sum(cost), 0.0)', '(SELECT coalesce(sum(cost), 0.0) FROM st)')} * 100 AS wasted_pct,
             count(*) AS n FROM z)
SELECT wasted_pct, wasted_pct > 20.0 AS flagged FROM w WHERE n > 0
"""

SQL["ext_rsa_audit"] = """
, h AS (SELECT coalesce(ad_group_name, 'N/A') AS ad_group,
               list_filter(list_transform(string_split(rsa_headlines, '|'), lambda x: trim(x)), lambda x: x <> '') AS hs
        FROM ads WHERE rsa_headlines IS NOT NULL AND rsa_headlines <> '')
SELECT ad_group, count(*) AS ads, avg(len(hs)) AS avg_headlines,
       count(*) FILTER (WHERE len(hs) < 3 OR len(hs) > 15) AS ads_out_of_range,
       CAST(sum(len(list_filter(hs, lambda x: length(x) > 30))) AS BIGINT) AS long_headlines
FROM h GROUP BY 1
"""

SOC = ("coalesce(sum(spend), 0.0) AS spend, coalesce(sum(impressions), 0.0) AS impressions, "
       "coalesce(sum(clicks), 0.0) AS clicks, coalesce(sum(purchases), 0.0) AS purchases, "
       "coalesce(sum(purchase_value), 0.0) AS purchase_value, coalesce(sum(reach), 0.0) AS reach")

SQL["ext_winners_losers"] = f"""
, g AS (SELECT ad_name AS ad, {SOC} FROM social WHERE ad_name IS NOT NULL GROUP BY 1),
f AS (SELECT ad, spend, {SD('purchase_value', 'spend')} AS roas FROM g WHERE spend >= 50.0),
r AS (SELECT *, row_number() OVER (ORDER BY roas DESC, ad) AS t, row_number() OVER (ORDER BY roas ASC, ad) AS b FROM f)
SELECT ad, spend, roas, 'winner' AS label FROM r WHERE t <= 3
UNION ALL SELECT ad, spend, roas, 'loser' FROM r WHERE b <= 3
"""

POINTS = ("(CASE WHEN upper({c}) = 'ABOVE_AVERAGE' THEN 3.0 WHEN upper({c}) = 'AVERAGE' THEN 2.0 "
          "WHEN starts_with(upper({c}), 'BELOW_AVERAGE') THEN 1.0 END)")
SQL["ext_relevance_score"] = f"""
, g AS (SELECT ad_name AS ad, min(quality_ranking) AS q, min(engagement_ranking) AS e, min(conversion_ranking) AS c
        FROM social WHERE ad_name IS NOT NULL GROUP BY 1),
p AS (SELECT ad, {POINTS.format(c='q')} AS pq, {POINTS.format(c='e')} AS pe, {POINTS.format(c='c')} AS pc FROM g),
s AS (SELECT ad, CASE WHEN (pq IS NOT NULL)::INT + (pe IS NOT NULL)::INT + (pc IS NOT NULL)::INT > 0
                      THEN (coalesce(pq, 0.0) + coalesce(pe, 0.0) + coalesce(pc, 0.0))
                           / ((pq IS NOT NULL)::INT + (pe IS NOT NULL)::INT + (pc IS NOT NULL)::INT) END AS score FROM p)
SELECT ad, score, CASE WHEN score > 2.5 THEN 'Excelente' WHEN score >= 1.5 THEN 'Normal'
                       WHEN score IS NOT NULL THEN 'Problemático' END AS class FROM s
"""

SQL["ext_hook_class"] = f"""
, g AS (SELECT ad_name AS ad, coalesce(sum(impressions), 0.0) AS impressions, coalesce(sum(video_3s), 0.0) AS v
        FROM social WHERE ad_name IS NOT NULL GROUP BY 1)
SELECT ad, {SD('v * 100', 'impressions')} AS hook_rate,
       CASE WHEN {SD('v * 100', 'impressions')} > 30 THEN 'excellent' WHEN {SD('v * 100', 'impressions')} >= 15 THEN 'normal'
            ELSE 'low' END AS class
FROM g WHERE impressions > 100
"""

SQL["ext_video_dropoff"] = f"""
, g AS (SELECT ad_name AS ad, coalesce(sum(impressions), 0.0) AS impressions, coalesce(sum(video_p25), 0.0) AS a,
               coalesce(sum(video_p50), 0.0) AS b, coalesce(sum(video_p75), 0.0) AS c,
               coalesce(sum(video_p100), 0.0) AS d, coalesce(sum(thruplay), 0.0) AS t
        FROM social WHERE ad_name IS NOT NULL GROUP BY 1),
x AS (SELECT ad, {SD('(a - b) * 100', 'a')} AS drop_25_50, {SD('(b - c) * 100', 'b')} AS drop_50_75,
             {SD('(c - d) * 100', 'c')} AS drop_75_100, {SD('t * 100', 'impressions')} AS thruplay_rate
      FROM g WHERE impressions > 100)
SELECT *, CASE WHEN drop_25_50 >= drop_50_75 AND drop_25_50 >= drop_75_100 THEN 'hook'
               WHEN drop_50_75 >= drop_75_100 THEN 'middle' ELSE 'end' END AS largest_drop
FROM x
"""

WEEKLY = f"""
, wk AS (SELECT CAST(date_trunc('week', date_start) AS DATE) AS week, {SOC} FROM social
         WHERE date_start IS NOT NULL GROUP BY 1)"""

SQL["ext_weekly_cpa_corr"] = WEEKLY + f"""
, c AS (SELECT count(*) AS weeks, corr(spend, {SD('spend', 'purchases')}) AS r FROM wk)
SELECT weeks, r AS corr_spend_cpa,
       CASE WHEN r IS NOT NULL THEN CASE WHEN r < 0.2 THEN 'scaling well' WHEN r <= 0.5 THEN 'mild diminishing returns'
                                         ELSE 'saturation' END END AS class FROM c
"""

SQL["ext_roas_slope"] = WEEKLY + f"""
, x AS (SELECT {SD('purchase_value', 'spend')} AS roas, CAST(row_number() OVER (ORDER BY week) - 1 AS DOUBLE) AS i FROM wk),
s AS (SELECT count(*) AS weeks, regr_slope(roas, i) AS slope FROM x)
SELECT weeks, slope, CASE WHEN slope > 0.05 THEN 'positive' WHEN slope < -0.05 THEN 'negative'
                          WHEN slope IS NOT NULL THEN 'stable' END AS trend FROM s
"""

SQL["ext_audience_type"] = f"""
, t AS (SELECT *, CASE WHEN regexp_matches(adset_name, '(?i)(lal|lookalike)') THEN 'LAL'
                       WHEN regexp_matches(adset_name, '(?i)(retarget|rmk|remarketing)') THEN 'Retargeting'
                       WHEN regexp_matches(adset_name, '(?i)(interes|interest)') THEN 'Intereses'
                       WHEN regexp_matches(adset_name, '(?i)(broad|abierto)') THEN 'Broad' ELSE 'Other' END AS audience_type
        FROM social WHERE adset_name IS NOT NULL),
g AS (SELECT audience_type, {SOC} FROM t GROUP BY 1)
SELECT audience_type, spend, reach, {SD('impressions', 'reach')} AS frequency, {SD('purchase_value', 'spend')} AS roas,
       {SD('spend', 'purchases')} AS cpa, {SD('impressions', 'reach')} > 5.0 AS saturated FROM g
"""

SQL["ext_overlap_by_campaign"] = f"""
, g AS (SELECT campaign_name, adset_name, {SOC} FROM social
        WHERE campaign_name IS NOT NULL AND adset_name IS NOT NULL GROUP BY 1, 2)
SELECT campaign_name AS campaign, count(*) AS adsets,
       count(*) FILTER (WHERE {SD('impressions', 'reach')} > 3.0) AS adsets_over_frequency
FROM g GROUP BY 1
"""

SQL["ext_fatigue_class"] = f"""
, d AS (SELECT ad_name, date_start, {SOC} FROM social WHERE ad_name IS NOT NULL AND date_start IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY ad_name ORDER BY date_start) AS a,
             row_number() OVER (PARTITION BY ad_name ORDER BY date_start DESC) AS z FROM d),
g AS (SELECT ad_name AS ad,
             {SD('coalesce(sum(clicks) FILTER (WHERE a <= 7), 0.0) * 100', 'coalesce(sum(impressions) FILTER (WHERE a <= 7), 0.0)')}
               AS ctr_first,
             {SD('coalesce(sum(clicks) FILTER (WHERE z <= 7), 0.0) * 100', 'coalesce(sum(impressions) FILTER (WHERE z <= 7), 0.0)')}
               AS ctr_last,
             {SD('sum(impressions)', 'sum(reach)')} AS frequency, count(*) AS days_active FROM r GROUP BY 1),
x AS (SELECT *, CASE WHEN ctr_first > 0 THEN (ctr_first - ctr_last) / ctr_first * 100 ELSE 0.0 END AS ctr_drop_pct FROM g)
SELECT *, CASE WHEN frequency > 5 AND ctr_drop_pct > 30 THEN 'Fatigado'
               WHEN frequency >= 3 AND ctr_drop_pct > 0 THEN 'En riesgo' ELSE 'Fresco' END AS class
FROM x
"""

SQL["ext_low_volume_bidding"] = """
SELECT campaign_name AS campaign, strftime("date", '%Y-%m') AS month, coalesce(sum(conversions), 0.0) AS conversions,
       coalesce(sum(conversions), 0.0) < 15.0 AS low_volume
FROM camp WHERE bid_strategy_type IS NOT NULL AND bid_strategy_type <> '' AND "date" IS NOT NULL GROUP BY 1, 2
"""

SQL["ext_qs_component"] = """
, q AS (SELECT *, coalesce(lower(expected_ctr) LIKE '%below%', false) AS b1,
               coalesce(lower(ad_relevance) LIKE '%below%', false) AS b2,
               coalesce(lower(landing_page_experience) LIKE '%below%', false) AS b3 FROM kw WHERE quality_score > 0)
SELECT CASE WHEN b1 AND b2 AND b3 THEN 'misaligned' WHEN b1 THEN 'ad copy' WHEN b2 THEN 'keyword-ad relevance'
            WHEN b3 THEN 'landing page' ELSE 'ok' END AS cause, count(*) AS keywords, coalesce(sum(cost), 0.0) AS cost
FROM q GROUP BY 1
"""

SQL["ext_pmax_before_after"] = """
, s AS (SELECT min("date") AS st FROM camp WHERE "date" IS NOT NULL AND campaign_type = 'PMax')
SELECT avg(search_impression_share) FILTER (WHERE "date" < s.st) AS is_before,
       avg(search_impression_share) FILTER (WHERE "date" >= s.st) AS is_after, s.st AS pmax_start
FROM camp, s WHERE "date" IS NOT NULL AND campaign_type = 'Search' AND search_impression_share IS NOT NULL
GROUP BY s.st
"""

SQL["ext_sustained_cpa"] = f"""
, d AS (SELECT campaign_name, "date", coalesce(sum(cost), 0.0) AS cost, coalesce(sum(conversions), 0.0) AS conv
        FROM camp WHERE "date" IS NOT NULL AND campaign_name IS NOT NULL GROUP BY 1, 2),
b AS (SELECT campaign_name, {SD('sum(cost)', 'sum(conv)')} AS base_cpa FROM d GROUP BY 1),
h AS (SELECT d.*, b.base_cpa, {SD('cost', 'conv')} AS cpa FROM d JOIN b USING (campaign_name)
      WHERE b.base_cpa > 0 AND {SD('cost', 'conv')} > b.base_cpa * (1 + 0.4)),
i AS (SELECT *, "date" - CAST(row_number() OVER (PARTITION BY campaign_name ORDER BY "date") AS INTEGER) AS isl FROM h)
SELECT campaign_name AS campaign, min("date") AS start, max("date") AS "end", count(*) AS days, avg(cpa) AS avg_cpa,
       min(base_cpa) AS base_cpa
FROM i GROUP BY campaign_name, isl HAVING count(*) >= 3
"""

SQL["ext_metric_divergence"] = f"""
, r AS (SELECT min("date") AS a, max("date") AS b FROM camp WHERE "date" IS NOT NULL AND campaign_name IS NOT NULL),
m AS (SELECT a + CAST(floor(datediff('day', a, b) / 2) AS INTEGER) AS mid FROM r),
g AS (SELECT campaign_name,
             CAST(coalesce(sum(impressions) FILTER (WHERE "date" < mid), 0) AS DOUBLE) AS i1,
             CAST(coalesce(sum(clicks) FILTER (WHERE "date" < mid), 0) AS DOUBLE) AS c1,
             coalesce(sum(cost) FILTER (WHERE "date" < mid), 0.0) AS s1,
             coalesce(sum(conversions) FILTER (WHERE "date" < mid), 0.0) AS v1,
             CAST(coalesce(sum(impressions) FILTER (WHERE "date" >= mid), 0) AS DOUBLE) AS i2,
             CAST(coalesce(sum(clicks) FILTER (WHERE "date" >= mid), 0) AS DOUBLE) AS c2,
             coalesce(sum(cost) FILTER (WHERE "date" >= mid), 0.0) AS s2,
             coalesce(sum(conversions) FILTER (WHERE "date" >= mid), 0.0) AS v2
      FROM camp, m WHERE "date" IS NOT NULL AND campaign_name IS NOT NULL GROUP BY 1)
SELECT campaign_name AS campaign,
       coalesce({SD('c2', 'i2')} < {SD('c1', 'i1')} AND (CASE WHEN i1 > 0 THEN (i2 - i1) / i1 * 100 END) > 0, false)
         AS ctr_down_impressions_up,
       coalesce((CASE WHEN v1 > 0 THEN (v2 - v1) / v1 * 100 END) < 0
                AND abs(CASE WHEN c1 > 0 THEN (c2 - c1) / c1 * 100 END) <= 5.0, false) AS conversions_down_clicks_flat,
       coalesce({SD('v2', 'c2')} < {SD('v1', 'c1')} AND (CASE WHEN s1 > 0 THEN (s2 - s1) / s1 * 100 END) > 0, false)
         AS conv_rate_down_spend_up,
       i2 < i1 * 0.01 AS delivery_near_zero
FROM g
"""

SQL["ext_budget_guard"] = """
SELECT campaign_name AS campaign, min(search_lost_is_rank) AS lost_rank, min(search_lost_is_rank) <= 50.0 AS can_scale
FROM camp WHERE campaign_name IS NOT NULL GROUP BY 1 HAVING min(search_lost_is_rank) IS NOT NULL
"""

SQL["ext_branded_share"] = """
, g AS (SELECT campaign_name, min(search_impression_share) AS isv FROM camp WHERE campaign_name IS NOT NULL GROUP BY 1)
SELECT campaign_name AS campaign, regexp_matches(campaign_name, '(?i)brand') AS branded, isv AS impression_share,
       isv < CASE WHEN regexp_matches(campaign_name, '(?i)brand') THEN 70.0 ELSE 50.0 END AS below_floor
FROM g WHERE isv IS NOT NULL
"""

SQL["ext_weekday_guard"] = """
, w AS (SELECT date_trunc('week', "date") AS wk, count(DISTINCT "date") AS d FROM camp WHERE "date" IS NOT NULL GROUP BY 1)
SELECT count(*) FILTER (WHERE d = 7) AS full_weeks, count(*) FILTER (WHERE d = 7) >= 4 AS weekday_report_valid FROM w
"""

SQL["ext_custom_name_regex"] = """
, nm AS (SELECT DISTINCT ad_name AS name FROM social WHERE ad_name IS NOT NULL),
p AS (SELECT name, regexp_matches(name, '^([^|]+?) \\| ([^|]+?) \\| ([^|]+?) \\| ([^|]+?) \\| (.+)$') AS ok FROM nm),
x AS (SELECT name,
             CASE WHEN ok THEN regexp_extract(name, '^([^|]+?) \\| ([^|]+?) \\| ([^|]+?) \\| ([^|]+?) \\| (.+)$', 1) END AS product,
             CASE WHEN ok THEN regexp_extract(name, '^([^|]+?) \\| ([^|]+?) \\| ([^|]+?) \\| ([^|]+?) \\| (.+)$', 2) END AS format,
             CASE WHEN ok THEN regexp_extract(name, '^([^|]+?) \\| ([^|]+?) \\| ([^|]+?) \\| ([^|]+?) \\| (.+)$', 3) END AS stage,
             CASE WHEN ok THEN regexp_extract(name, '^([^|]+?) \\| ([^|]+?) \\| ([^|]+?) \\| ([^|]+?) \\| (.+)$', 4) END AS creator,
             CASE WHEN ok THEN regexp_extract(name, '^([^|]+?) \\| ([^|]+?) \\| ([^|]+?) \\| ([^|]+?) \\| (.+)$', 5) END AS variation,
             ok AS parsed FROM p)
SELECT *, (SELECT avg(CAST(parsed AS DOUBLE)) * 100 FROM x) AS parse_rate_pct,
       (SELECT avg(CAST(parsed AS DOUBLE)) * 100 FROM x) < 50.0 AS low_parse_rate FROM x
"""

SQL["ext_size_pairs"] = S.SIZE_LINES + """
, ob AS (SELECT DISTINCT order_id, size FROM sl WHERE order_id IS NOT NULL)
SELECT a.size AS size_a, b.size AS size_b, count(*) AS count
FROM ob a JOIN ob b ON a.order_id = b.order_id AND a.size < b.size
GROUP BY 1, 2 ORDER BY count DESC, size_a, size_b LIMIT 15
"""

SQL["ext_price_elasticity"] = """
, l AS (SELECT * FROM lines WHERE product_name IS NOT NULL AND "date" IS NOT NULL AND product_price > 0),
m AS (SELECT product_name, date_trunc('month', "date") AS mm, CAST(avg(CAST(product_price AS DECIMAL(20,8))) AS DOUBLE) AS price,
             CAST(coalesce(sum(product_qty), 0) AS BIGINT) AS qty FROM l GROUP BY 1, 2),
g AS (SELECT *, lag(price) OVER (PARTITION BY product_name ORDER BY mm) AS pp,
             lag(qty) OVER (PARTITION BY product_name ORDER BY mm) AS pq FROM m),
e AS (SELECT product_name, ((qty - pq) / pq) / ((price - pp) / pp) AS e FROM g
      WHERE pp > 0 AND pq > 0 AND price <> pp),
pr AS (SELECT product_name, count(DISTINCT price) AS prices FROM m GROUP BY 1)
SELECT product_name, avg(e) AS elasticity, count(*) AS changes, prices
FROM e JOIN pr USING (product_name) GROUP BY product_name, prices HAVING prices >= 3
"""

# brute-force range join of every conversion to its touches: the independent answer
SQL["ext_degraded_months"] = f"""
, d AS (SELECT strftime("date", '%Y-%m') AS month, {S.DAYS_BETWEEN.format(a='"date"', b='shipping_date')} AS days FROM ords
        WHERE "date" IS NOT NULL AND shipping_date IS NOT NULL),
k AS (SELECT * FROM d WHERE days BETWEEN 0 AND 60),
t AS (SELECT quantile_cont(CAST(days AS DOUBLE), 0.5) AS overall FROM k),
m AS (SELECT month, count(*) AS orders, quantile_cont(CAST(days AS DOUBLE), 0.5) AS median_days FROM k GROUP BY 1)
SELECT month, orders, median_days, overall AS overall_median_days,
       CASE WHEN overall = 0 THEN 0.0 ELSE median_days / overall END AS ratio, median_days > overall * 1.5 AS degraded
FROM m, t
"""

SQL["ma_attribution_windows"] = """
, cv AS (SELECT event_id, user_id, ts, value FROM ev WHERE event_type = 'purchase'),
ck AS (SELECT user_id, ts FROM ev WHERE event_type = 'click'),
vw AS (SELECT user_id, ts FROM ev WHERE event_type = 'view'),
c AS (SELECT cv.*, epoch_us(cv.ts) - epoch_us(ck.ts) AS age FROM cv ASOF JOIN ck ON cv.user_id = ck.user_id AND cv.ts >= ck.ts),
v AS (SELECT cv.*, epoch_us(cv.ts) - epoch_us(vw.ts) AS age FROM cv ASOF JOIN vw ON cv.user_id = vw.user_id AND cv.ts >= vw.ts),
w(i, win, days) AS (VALUES (0, '1d_click', 1), (1, '7d_click', 7), (2, '28d_click', 28), (3, '1d_view', 1)),
h AS (SELECT w.i, c.value FROM w, c WHERE w.i < 3 AND c.age <= w.days * 86400000000
      UNION ALL SELECT w.i, v.value FROM w, v WHERE w.i = 3 AND v.age <= w.days * 86400000000),
g AS (SELECT w.i, w.win, count(h.i) AS purchases, coalesce(sum(h.value), 0.0) AS purchase_value FROM w LEFT JOIN h USING (i) GROUP BY 1, 2),
s AS (SELECT coalesce(sum(spend), 0.0) AS spend FROM social)
SELECT g.win AS "window", g.purchases, g.purchase_value, g.purchases * 100.0 / (SELECT count(*) FROM cv) AS pct_purchases,
       CASE WHEN s.spend = 0 THEN 0.0 ELSE g.purchase_value / s.spend END AS roas, g.purchases - p.purchases AS delta_purchases,
       CASE WHEN p.purchases > 0 THEN (g.purchases - p.purchases) / p.purchases * 100 END AS delta_pct
FROM g CROSS JOIN s LEFT JOIN g p ON p.i = g.i - 1 AND g.i < 3
"""


def _lloyd(k: int, rounds: int = 12) -> str:
    """Lloyd's rounds over x(email, f0..f3): c{k}_{rounds} holds the centres, a{k} each customer's nearest and its distance."""
    dist = " + ".join(f"(x.f{i} - c.f{i}) * (x.f{i} - c.f{i})" for i in range(4))
    out = [f"""c{k}_0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(email), email) - 1 AS c, {', '.join(f'CAST(f{i} AS DOUBLE) AS f{i}' for i in range(4))}
  FROM x QUALIFY c < {k})"""]
    for r in range(rounds + 1):
        near = f"""a{k}_{r} AS MATERIALIZED (SELECT email, min_by(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT x.email, c.c, {dist} AS d FROM x, c{k}_{r} c) GROUP BY email)"""
        if r == rounds:
            out.append(near.replace(f"a{k}_{r} AS", f"a{k} AS", 1))
            break
        out += [near, f"""c{k}_{r + 1} AS MATERIALIZED (SELECT o.c, {', '.join(f'coalesce(m.f{i}, o.f{i}) AS f{i}' for i in range(4))} FROM c{k}_{r} o LEFT JOIN (
  SELECT a.c, {', '.join(f'CAST(sum(x.f{i}) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS f{i}' for i in range(4))}
  FROM a{k}_{r} a JOIN x USING (email) GROUP BY a.c) m USING (c))"""]
    return ",\n".join(out)


_GRID = "CAST(floor((CAST({f} AS DOUBLE) - {lo}) / CASE WHEN {hi} - {lo} <> 0 THEN CAST({hi} - {lo} AS DOUBLE) ELSE 1.0 END * 1048576.0 + 0.5) AS BIGINT)"
_FEATURES = ("total_spend", "order_count", "aov", "days_since_last")
_CUSTOMERS = f"""
, oc AS (SELECT * FROM ords WHERE email IS NOT NULL AND "date" IS NOT NULL AND total > 0),
u AS MATERIALIZED (SELECT email, sum(total) AS total_spend, count(order_id) AS order_count, avg(total) AS aov,
  {S.DAYS_BETWEEN.format(a='max("date")', b='(SELECT max("date") FROM oc)')} AS days_since_last FROM oc GROUP BY email),
e AS (SELECT {', '.join(f'min({f}) AS lo{i}, max({f}) AS hi{i}' for i, f in enumerate(_FEATURES))} FROM u),
x AS MATERIALIZED (SELECT u.*, {', '.join(_GRID.format(f=f, lo=f'e.lo{i}', hi=f'e.hi{i}') + f' AS f{i}' for i, f in enumerate(_FEATURES))} FROM u, e)"""

SQL["ec_niche_clusters"] = _CUSTOMERS + ",\n" + _lloyd(4) + """
, p AS (SELECT CAST(a.c AS INTEGER) AS cluster, count(*) AS size, avg(total_spend) AS avg_spend, avg(order_count) AS avg_orders, avg(aov) AS avg_aov,
  avg(days_since_last) AS avg_recency FROM a4 a JOIN x USING (email) GROUP BY 1)
SELECT cluster, size, size * 100.0 / (SELECT count(*) FROM x) AS pct, avg_spend, avg_orders, avg_aov, avg_recency,
  (['High Value', 'Medium-High', 'Medium-Low', 'Low Value'])[row_number() OVER (ORDER BY avg_spend DESC, cluster)] AS label
FROM p WHERE (SELECT count(*) FROM x) >= 20
"""

SQL["ext_kmeans_elbow"] = _CUSTOMERS + ",\n" + ",\n".join(_lloyd(k) for k in (3, 4, 5)) + """
SELECT 3 AS k, sum(d / 1099511627776.0) AS inertia FROM a3 UNION ALL SELECT 4, sum(d / 1099511627776.0) FROM a4
UNION ALL SELECT 5, sum(d / 1099511627776.0) FROM a5
"""

SQL["ext_attribution_models"] = """
, cv AS (SELECT event_id AS cid, user_id, ts FROM ev WHERE event_type = 'purchase'),
tc AS (SELECT user_id, ts, channel FROM ev WHERE event_type IN ('view', 'click')),
p AS (SELECT cv.cid, tc.channel, tc.ts AS tts, cv.ts AS cts,
             row_number() OVER (PARTITION BY cv.cid ORDER BY tc.ts) AS ra,
             row_number() OVER (PARTITION BY cv.cid ORDER BY tc.ts DESC) AS rd,
             count(*) OVER (PARTITION BY cv.cid) AS n,
             pow(2.0, -(epoch_us(cv.ts) - epoch_us(tc.ts)) / (7.0 * 86400000000)) AS w
      FROM cv JOIN tc ON tc.user_id = cv.user_id AND tc.ts < cv.ts
                     AND epoch_us(tc.ts) >= epoch_us(cv.ts) - 30 * 86400000000),
q AS (SELECT *, w / sum(w) OVER (PARTITION BY cid) AS wn FROM p),
c AS (SELECT 'last_touch' AS model, channel, CAST(rd = 1 AS DOUBLE) AS credit FROM q
      UNION ALL SELECT 'first_touch', channel, CAST(ra = 1 AS DOUBLE) FROM q
      UNION ALL SELECT 'linear', channel, 1.0 / n FROM q
      UNION ALL SELECT 'time_decay', channel, wn FROM q
      UNION ALL SELECT 'position', channel,
             CASE WHEN n = 1 THEN 1.0 WHEN n = 2 THEN 0.5 WHEN ra = 1 OR rd = 1 THEN 0.4 ELSE 0.2 / (n - 2) END FROM q
      UNION ALL SELECT 'unattributed', CAST(NULL AS VARCHAR), 1.0 FROM cv WHERE cid NOT IN (SELECT cid FROM p))
SELECT model, channel, sum(credit) AS credit FROM c GROUP BY 1, 2
"""

SQL["ext_relevance_scenario"] = """
, g AS (SELECT ad_name AS ad, coalesce(sum(impressions), 0.0) AS impressions, min(quality_ranking) AS q,
               min(engagement_ranking) AS e, min(conversion_ranking) AS c
        FROM social WHERE ad_name IS NOT NULL GROUP BY 1),
l AS (SELECT *, coalesce(starts_with(upper(q), 'BELOW_AVERAGE'), false) AS lq,
             coalesce(starts_with(upper(e), 'BELOW_AVERAGE'), false) AS le,
             coalesce(starts_with(upper(c), 'BELOW_AVERAGE'), false) AS lc FROM g)
SELECT ad, impressions, CASE WHEN lq AND le AND lc THEN 'audience-creative mismatch' WHEN lq THEN 'creative quality'
                             WHEN le THEN 'ad not compelling' WHEN lc THEN 'post-click experience' ELSE 'ok' END AS issue
FROM l WHERE impressions >= 500.0
"""

SQL["ext_same_period_comparison"] = f"""
, m AS (SELECT max("date") AS mx, CAST(date_trunc('month', max("date")) AS DATE) AS st FROM camp WHERE "date" IS NOT NULL),
p AS (SELECT 'current' AS period, st AS a, mx AS b, datediff('day', st, mx) + 1 AS days FROM m
      UNION ALL SELECT 'previous_month', CAST(st - INTERVAL 1 MONTH AS DATE),
                       least(CAST(st - INTERVAL 1 MONTH AS DATE) + CAST(datediff('day', st, mx) AS INTEGER), last_day(st - INTERVAL 1 MONTH)),
                       least(datediff('day', st, mx) + 1, day(last_day(st - INTERVAL 1 MONTH))) FROM m
      UNION ALL SELECT 'previous_year', CAST(st - INTERVAL 12 MONTH AS DATE),
                       least(CAST(st - INTERVAL 12 MONTH AS DATE) + CAST(datediff('day', st, mx) AS INTEGER), last_day(st - INTERVAL 12 MONTH)),
                       least(datediff('day', st, mx) + 1, day(last_day(st - INTERVAL 12 MONTH))) FROM m),
g AS (SELECT p.period, CAST(p.days AS INTEGER) AS days,
             coalesce(sum(c.cost) FILTER (WHERE c."date" >= p.a AND c."date" <= p.b), 0.0) AS cost,
             coalesce(sum(c.conversions) FILTER (WHERE c."date" >= p.a AND c."date" <= p.b), 0.0) AS conversions,
             coalesce(sum(c.conversion_value) FILTER (WHERE c."date" >= p.a AND c."date" <= p.b), 0.0) AS conversion_value
      FROM p, camp c WHERE c."date" IS NOT NULL GROUP BY 1, 2)
SELECT *, {SD('cost', 'conversions')} AS cpa, {SD('conversion_value', 'cost')} AS roas FROM g
"""

SQL["ext_is_decline"] = """
, wk AS (SELECT campaign_name, date_trunc('week', "date") AS week, avg(search_impression_share) AS isv,
                coalesce(sum(cost), 0.0) AS cost
         FROM camp WHERE "date" IS NOT NULL AND search_impression_share IS NOT NULL GROUP BY 1, 2),
x AS (SELECT *, CAST(row_number() OVER (PARTITION BY campaign_name ORDER BY week) - 1 AS DOUBLE) AS i FROM wk),
g AS (SELECT campaign_name, regr_slope(isv, i) AS is_slope, arg_min(cost, week) AS c0, arg_max(cost, week) AS c1,
             count(*) AS weeks FROM x GROUP BY 1)
SELECT campaign_name AS campaign, weeks, is_slope,
       CASE WHEN c0 > 0 THEN (c1 - c0) / c0 * 100 END AS cost_change_pct,
       coalesce(is_slope < 0 AND abs(CASE WHEN c0 > 0 THEN (c1 - c0) / c0 * 100 END) <= 10.0, false) AS declining_share
FROM g
"""
