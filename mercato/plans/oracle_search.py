"""Oracle SQL (DuckDB) for the search-ads operators (views camp, kw, st, ads, auction)."""

AS_OF = "2024-02-05"


def SD(a: str, b: str) -> str:
    return f"(CASE WHEN coalesce({b}, 0) = 0 THEN 0.0 ELSE ({a}) / ({b}) END)"


def SEM(v: str, g: float, y: float) -> str:
    return (f"(CASE WHEN {v} IS NULL THEN 'gray' WHEN {v} >= {g} THEN 'green' WHEN {v} >= {y} THEN 'yellow' "
            f"ELSE 'red' END)")


def INITCAP(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def LABEL(x: str) -> str:
    return INITCAP(f"replace(replace(replace({x}, 'TARGET_', 'Target '), 'MAXIMIZE_', 'Max '), '_', ' ')")


SUMS = ("CAST(coalesce(sum(impressions), 0) AS BIGINT) AS impressions, "
        "CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clicks, coalesce(sum(cost), 0.0) AS cost, "
        "coalesce(sum(conversions), 0.0) AS conversions, coalesce(sum(conversion_value), 0.0) AS conversion_value, "
        "coalesce(sum(all_conversions), 0.0) AS all_conversions, "
        "coalesce(sum(all_conversion_value), 0.0) AS all_conversion_value")
RATIOS = (f"{SD('clicks', 'impressions')} * 100 AS ctr, {SD('cost', 'clicks')} AS cpc, "
          f"{SD('cost', 'conversions')} AS cpa, {SD('conversion_value', 'cost')} AS roas, "
          f"{SD('conversions', 'clicks')} * 100 AS conv_rate")

SQL = {}

SQL["ga_totals"] = f"\nSELECT *, {RATIOS} FROM (SELECT {SUMS} FROM camp)\n"

def _light(v: str, green: float, yellow: float) -> str:
    return f"CASE WHEN {v} >= {green} THEN 'green' WHEN {v} >= {yellow} THEN 'yellow' ELSE 'red' END"


SQL["ga_benchmarks"] = f"""
, t AS (SELECT *, {RATIOS} FROM (SELECT {SUMS} FROM camp)),
q AS (SELECT sum(quality_score * coalesce(CAST(impressions AS DOUBLE), 1.0)) / nullif(sum(coalesce(CAST(impressions AS DOUBLE), 1.0)), 0) AS weighted,
             avg(quality_score) AS plain FROM kw WHERE quality_score > 0),
s AS (SELECT avg(search_impression_share) AS share FROM camp),
b AS (SELECT ctr, cpc, conv_rate, roas, share, coalesce(weighted, plain) AS qs FROM t, q, s WHERE impressions > 0),
u AS (SELECT 'CTR' AS name, ctr AS value, '%' AS unit, {_light('ctr', 3, 1.5)} AS status FROM b
      UNION ALL SELECT 'CPC', cpc, '', 'yellow' FROM b
      UNION ALL SELECT 'Conv Rate', conv_rate, '%', {_light('conv_rate', 3, 1)} FROM b
      UNION ALL SELECT 'ROAS', roas, 'x', {_light('roas', 4, 2)} FROM b
      UNION ALL SELECT 'Impression Share', share, '%', {_light('share', 80, 50)} FROM b
      UNION ALL SELECT 'Quality Score', qs, '/10', {_light('qs', 7, 5)} FROM b)
SELECT * FROM u WHERE value IS NOT NULL
"""

SQL["ga_aggregate_by"] = f"""
, g AS (SELECT device, {SUMS}, count(*) AS rows,
               first(campaign_type ORDER BY "date", hour_of_day, device, adset_name, ad_name)
                 FILTER (WHERE campaign_type IS NOT NULL) AS campaign_type,
               first(bid_strategy_type ORDER BY "date", hour_of_day, device, adset_name, ad_name)
                 FILTER (WHERE bid_strategy_type IS NOT NULL) AS bid_strategy_type
        FROM camp WHERE device IS NOT NULL GROUP BY device)
SELECT *, {RATIOS} FROM g
"""

DAILY = f"""
, d AS (SELECT "date", CAST(coalesce(sum(impressions), 0) AS BIGINT) AS impressions,
               CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clicks, coalesce(sum(cost), 0.0) AS cost,
               coalesce(sum(conversions), 0.0) AS conversions, coalesce(sum(conversion_value), 0.0) AS conversion_value
        FROM camp WHERE "date" IS NOT NULL GROUP BY 1),
dd AS (SELECT *, {SD('clicks', 'impressions')} * 100 AS ctr, {SD('cost', 'conversions')} AS cpa,
              {SD('conversion_value', 'cost')} AS roas FROM d)"""

SQL["ga_by_date"] = DAILY + "\nSELECT * FROM dd\n"
SQL["ga_date_range"] = "\nSELECT min(\"date\") AS date_min, max(\"date\") AS date_max FROM camp\n"
SQL["ga_conversion_lag_flag"] = f"""
SELECT max("date") AS date_max, coalesce(DATE '{AS_OF}' - max("date") <= 7, false) AS conversion_lag_warning FROM camp
"""

SQL["ga_dashboard"] = f"""
, r AS (SELECT min("date") AS dmin, max("date") AS dmax FROM camp),
p AS (SELECT r.*, datediff('day', dmin, dmax) AS days,
             dmin + CAST(floor(datediff('day', dmin, dmax) / 2) AS INTEGER) AS mid FROM r),
t AS (SELECT {SUMS},
             coalesce(sum(cost) FILTER (WHERE "date" < p.mid), 0.0) AS cost1,
             coalesce(sum(conversions) FILTER (WHERE "date" < p.mid), 0.0) AS conv1,
             coalesce(sum(conversion_value) FILTER (WHERE "date" < p.mid), 0.0) AS value1,
             count(*) FILTER (WHERE "date" < p.mid) AS n1,
             coalesce(sum(cost) FILTER (WHERE "date" >= p.mid), 0.0) AS cost2,
             coalesce(sum(conversions) FILTER (WHERE "date" >= p.mid), 0.0) AS conv2,
             coalesce(sum(conversion_value) FILTER (WHERE "date" >= p.mid), 0.0) AS value2,
             count(*) FILTER (WHERE "date" >= p.mid) AS n2
      FROM camp, p),
x AS (SELECT t.*, p.*, p.days > 7 AND n1 > 0 AND n2 > 0 AS ok,
             {SD('value1', 'cost1')} AS roas1, {SD('value2', 'cost2')} AS roas2,
             {SD('cost1', 'conv1')} AS cpa1, {SD('cost2', 'conv2')} AS cpa2 FROM t, p)
SELECT cost, conversions, conversion_value, {SD('conversion_value', 'cost')} AS roas, {SD('cost', 'conversions')} AS cpa,
       impressions, clicks, {SD('clicks', 'impressions')} * 100 AS ctr, {SD('cost', 'clicks')} AS avg_cpc,
       {SD('conversions', 'clicks')} * 100 AS conv_rate, dmin AS date_min, dmax AS date_max,
       coalesce(DATE '{AS_OF}' - dmax <= 7, false) AS conversion_lag_warning,
       CASE WHEN ok AND cost1 > 0 THEN (cost2 - cost1) / cost1 * 100 END AS cost_change_pct,
       CASE WHEN ok AND conv1 > 0 THEN (conv2 - conv1) / conv1 * 100 END AS conversions_change_pct,
       CASE WHEN ok AND roas1 > 0 THEN (roas2 - roas1) / roas1 * 100 END AS roas_change_pct,
       CASE WHEN ok AND cpa1 > 0 THEN (cpa2 - cpa1) / cpa1 * 100 END AS cpa_change_pct
FROM x WHERE impressions > 0
"""

SQL["ga_benchmarks"] = f"""
, tr AS (SELECT *, {RATIOS} FROM (SELECT {SUMS} FROM camp)),
q AS (SELECT sum(quality_score * coalesce(CAST(impressions AS DOUBLE), 1.0)) AS qw,
             sum(coalesce(CAST(impressions AS DOUBLE), 1.0)) AS w, avg(quality_score) AS qm, count(*) AS n
      FROM kw WHERE quality_score IS NOT NULL AND quality_score > 0),
v AS (SELECT tr.ctr, tr.cpc, tr.conv_rate, tr.roas, (SELECT avg(search_impression_share) FROM camp) AS isv,
             CASE WHEN q.n > 0 THEN CASE WHEN q.w > 0 THEN q.qw / q.w ELSE q.qm END END AS qs
      FROM tr, q WHERE tr.impressions > 0)
SELECT * FROM (
  SELECT 'CTR' AS name, ctr AS value, '%' AS unit, {SEM('ctr', 3, 1.5)} AS status FROM v UNION ALL
  SELECT 'CPC', cpc, '', 'yellow' FROM v UNION ALL
  SELECT 'Conv Rate', conv_rate, '%', {SEM('conv_rate', 3, 1)} FROM v UNION ALL
  SELECT 'ROAS', roas, 'x', {SEM('roas', 4, 2)} FROM v UNION ALL
  SELECT 'Impression Share', isv, '%', {SEM('isv', 80, 50)} FROM v UNION ALL
  SELECT 'Quality Score', qs, '/10', {SEM('qs', 7, 5)} FROM v) WHERE value IS NOT NULL
"""

SQL["ga_daily"] = DAILY + """
SELECT "date", cost, conversions, roas, cpa, ctr, "date" > (SELECT max("date") FROM dd) - 7 AS conversion_lag_warning
FROM dd WHERE (SELECT count(*) FROM dd) >= 3
"""

SQL["ga_daily_ma7"] = DAILY + """
, r AS (SELECT "date", round_even(roas, 2) AS rr, round_even(cpa, 2) AS rc, row_number() OVER (ORDER BY "date") AS rn
        FROM dd WHERE (SELECT count(*) FROM dd) >= 3),
m AS (SELECT "date", rn, avg(rr) OVER w AS roas_ma7, avg(rc) OVER w AS cpa_ma7 FROM r
      WINDOW w AS (ORDER BY "date" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT "date", roas_ma7, cpa_ma7 FROM m WHERE rn >= 7
"""

SQL["ga_daily_trend"] = DAILY + """
, r AS (SELECT round_even(roas, 2) AS rr, row_number() OVER (ORDER BY "date") AS rn, count(*) OVER () AS n
        FROM dd WHERE (SELECT count(*) FROM dd) >= 3),
a AS (SELECT avg(rr) FILTER (WHERE rn <= n // 2) AS f, avg(rr) FILTER (WHERE rn > n // 2) AS s, max(n) AS n FROM r)
SELECT CASE WHEN coalesce(n, 0) < 6 THEN 'flat' WHEN s > f * 1.05 THEN 'up' WHEN s < f * 0.95 THEN 'down'
            ELSE 'flat' END AS trend, f AS first_half_roas, s AS second_half_roas FROM a
"""

CAMP_AGG = f"""
, g AS (SELECT campaign_name, {SUMS}, count(*) AS rows, min(campaign_type) AS campaign_type,
               min(bid_strategy_type) AS bst, min(target_cpa) AS tc, min(target_roas) AS tr,
               min(search_impression_share) AS isv, min(search_lost_is_budget) AS lb, min(search_lost_is_rank) AS lr,
               min(search_top_is) AS ti, min(search_abs_top_is) AS ati
        FROM camp WHERE campaign_name IS NOT NULL GROUP BY 1),
gr AS (SELECT *, {RATIOS} FROM g)"""

SQL["ga_campaigns"] = CAMP_AGG + f"""
SELECT campaign_name AS name, coalesce(campaign_type, 'Unknown') AS type, cost, impressions, clicks, conversions,
       conversion_value, roas, cpa, ctr, cpc, conv_rate, {SEM('roas', 4, 2)} AS roas_status,
       {SD('cost', '(SELECT sum(cost) FROM g)')} * 100 AS cost_share_pct FROM gr
"""

SQL["ga_budget_vs_results"] = CAMP_AGG + f"""
, s AS (SELECT campaign_name AS campaign, cost, roas, conversions,
               {SD('cost', '(SELECT sum(cost) FROM g)')} * 100 AS cost_share_pct,
               CASE WHEN (SELECT sum(conversion_value) FROM g) > 0
                    THEN {SD('conversion_value', '(SELECT sum(conversion_value) FROM g)')} * 100 ELSE 0.0 END
                 AS revenue_share_pct FROM gr)
SELECT *, CASE WHEN cost_share_pct > revenue_share_pct + 10 THEN 'ineficiente'
               WHEN revenue_share_pct > cost_share_pct + 10 THEN 'eficiente' END AS verdict
FROM s WHERE (SELECT count(*) FROM g) >= 2
"""

BIDDING = CAMP_AGG + """
, x AS (SELECT *, upper(bst) LIKE '%CPA%' AS is_cpa, NOT (upper(bst) LIKE '%CPA%') AND upper(bst) LIKE '%ROAS%' AS is_roas
        FROM gr WHERE bst IS NOT NULL AND bst <> ''),
y AS (SELECT *, CASE WHEN is_cpa THEN tc WHEN is_roas THEN tr END AS target,
             CASE WHEN is_cpa THEN cpa WHEN is_roas THEN roas END AS actual FROM x),
z AS (SELECT *, CASE WHEN target IS NOT NULL AND target > 0 THEN round_even((actual - target) / target * 100, 1) END AS drift
      FROM y),
bs AS (SELECT campaign_name AS campaign, """ + LABEL("bst") + """ AS strategy, target, actual, drift AS drift_pct,
              CASE WHEN drift IS NULL THEN 'unknown'
                   WHEN is_cpa AND drift < -10 THEN 'outperforming' WHEN is_cpa AND drift > 20 THEN 'underperforming'
                   WHEN is_roas AND drift > 10 THEN 'outperforming' WHEN is_roas AND drift < -20 THEN 'underperforming'
                   ELSE 'on_target' END AS status FROM z)"""

SQL["ga_bidding_status"] = BIDDING + "\nSELECT * FROM bs\n"
SQL["ga_bidding_summary"] = BIDDING + """
SELECT * FROM (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'outperforming') AS outperforming,
                      count(*) FILTER (WHERE status = 'on_target') AS on_target,
                      count(*) FILTER (WHERE status = 'underperforming') AS underperforming FROM bs) WHERE total > 0
"""

QS = "\n, q AS (SELECT * FROM kw WHERE quality_score IS NOT NULL AND quality_score > 0)"

SQL["ga_qs_histogram"] = QS + """
, c AS (SELECT CAST(quality_score AS INTEGER) AS qs, count(*) AS cnt FROM q GROUP BY 1)
SELECT CAST(s.qs AS INTEGER) AS qs, coalesce(c.cnt, 0) AS count
FROM (SELECT range AS qs FROM range(1, 11)) s LEFT JOIN c ON c.qs = s.qs WHERE (SELECT count(*) FROM q) >= 5
"""
SQL["ga_qs_weighted"] = QS + f"""
SELECT * FROM (SELECT {SD('sum(quality_score * greatest(coalesce(CAST(impressions AS DOUBLE), 0.0), 1.0))',
                          'sum(greatest(coalesce(CAST(impressions AS DOUBLE), 0.0), 1.0))')} AS avg_qs_weighted,
                      count(*) AS keywords FROM q) WHERE keywords > 0
"""
SQL["ga_qs_components"] = QS + """
, s AS (SELECT 'expected_ctr' AS component, expected_ctr AS grade FROM q UNION ALL
        SELECT 'ad_relevance', ad_relevance FROM q UNION ALL
        SELECT 'landing_page_experience', landing_page_experience FROM q)
SELECT component, count(*) FILTER (WHERE replace(lower(grade), '_', ' ') = 'above average') AS above,
       count(*) FILTER (WHERE replace(lower(grade), '_', ' ') = 'average') AS average,
       count(*) FILTER (WHERE replace(lower(grade), '_', ' ') = 'below average') AS below
FROM s WHERE grade IS NOT NULL AND grade <> '' GROUP BY 1
"""
SQL["ga_low_qs_spend"] = QS + """
SELECT coalesce(keyword, 'N/A') AS keyword, quality_score AS qs, cost,
       CASE WHEN lower(expected_ctr) LIKE '%below%' THEN 'expected_ctr'
            WHEN lower(ad_relevance) LIKE '%below%' THEN 'ad_relevance'
            WHEN lower(landing_page_experience) LIKE '%below%' THEN 'landing_page_experience'
            ELSE 'unknown' END AS weak_component
FROM q WHERE quality_score <= 4 AND coalesce(cost, 0.0) > 0
ORDER BY cost DESC, keyword, qs, weak_component LIMIT 10
"""

SQL["ga_top_keywords"] = f"""
, k AS (SELECT * FROM kw WHERE coalesce(conversions, 0.0) >= 1)
SELECT coalesce(keyword, 'N/A') AS keyword, coalesce(conversions, 0.0) AS conversions, coalesce(cost, 0.0) AS cost,
       {SD('coalesce(cost, 0.0)', 'coalesce(conversions, 0.0)')} AS cpa,
       {SD('coalesce(conversions, 0.0)', 'clicks')} * 100 AS conv_rate, {SD('clicks', 'impressions')} * 100 AS ctr,
       {SD('coalesce(cost, 0.0)', 'clicks')} AS cpc, quality_score,
       CASE WHEN coalesce(cost, 0.0) > 0 THEN {SEM(SD('conversion_value', 'coalesce(cost, 0.0)'), 4, 2)}
            ELSE 'gray' END AS cpa_status
FROM k WHERE (SELECT count(*) FROM k) >= 3
ORDER BY coalesce(k.conversions, 0.0) DESC, coalesce(k.cost, 0.0) DESC, coalesce(k.keyword, 'N/A'), k.clicks DESC,
         k.impressions DESC, k.quality_score, k.conversion_value
LIMIT 20
"""

SQL["ga_impression_share"] = CAMP_AGG + f"""
, o AS (SELECT campaign_name AS campaign, isv AS "is", lb AS lost_budget, lr AS lost_rank, ti AS top_is,
               ati AS abs_top_is,
               CASE WHEN coalesce(isv <> 0, false) THEN {SEM('isv', 80, 50)} ELSE 'gray' END AS is_status,
               CASE WHEN coalesce(lr <> 0, false) AND coalesce(lb <> 0, false) THEN
                    CASE WHEN lr > lb THEN 'Rank loss dominante — mejorar QS o subir bid'
                         WHEN lb > lr THEN 'Budget loss dominante — aumentar presupuesto'
                         ELSE 'Pérdida mixta rank + budget' END ELSE '' END AS diagnosis
        FROM g WHERE isv IS NOT NULL)
SELECT *, (SELECT avg(round_even("is", 1)) FROM o) AS account_avg_is FROM o
"""

ZERO = "\n, z AS (SELECT * FROM st WHERE coalesce(conversions, 0.0) = 0 AND coalesce(cost, 0.0) > 0)"

SQL["ga_wasted_spend"] = ZERO + f"""
SELECT * FROM (SELECT coalesce(sum(cost), 0.0) AS total_wasted,
                      {SD('coalesce(sum(cost), 0.0)', '(SELECT coalesce(sum(cost), 0.0) FROM st)')} * 100 AS wasted_pct,
                      count(*) AS total_zero_conv_terms FROM z) WHERE total_zero_conv_terms > 0
"""
SQL["ga_wasted_terms"] = ZERO + """
SELECT coalesce(search_term, 'N/A') AS search_term, cost, CAST(coalesce(clicks, 0) AS BIGINT) AS clicks,
       0 AS conversions
FROM z ORDER BY cost DESC, coalesce(search_term, 'N/A'), clicks DESC LIMIT 20
"""
SQL["ga_keyword_opportunities"] = f"""
, o AS (SELECT * FROM st WHERE coalesce(conversions, 0.0) >= 1
          AND NOT coalesce(search_term_status IN ('Added', 'ADDED', 'Excluded', 'EXCLUDED'), false))
SELECT coalesce(search_term, 'N/A') AS search_term, coalesce(conversions, 0.0) AS conversions,
       coalesce(cost, 0.0) AS cost, {SD('coalesce(cost, 0.0)', 'coalesce(conversions, 0.0)')} AS cpa,
       {SD('coalesce(conversions, 0.0)', 'clicks')} * 100 AS conv_rate,
       coalesce(search_term_status, 'None') AS status,
       (SELECT count(*) FROM o) AS total_opportunities,
       (SELECT coalesce(sum(conversions), 0.0) FROM o) AS potential_conversions
FROM o ORDER BY coalesce(o.conversions, 0.0) DESC, coalesce(o.cost, 0.0) DESC, coalesce(o.search_term, 'N/A'),
                o.clicks DESC, coalesce(o.search_term_status, 'None') LIMIT 20
"""

SQL["ga_ad_ranking"] = f"""
SELECT coalesce(ad_group_name, 'N/A') AS ad_group,
       coalesce(headline_1, trim(split_part(rsa_headlines, '|', 1)), 'N/A') AS headline,
       CAST(coalesce(impressions, 0) AS BIGINT) AS impressions, CAST(coalesce(clicks, 0) AS BIGINT) AS clicks,
       coalesce(conversions, 0.0) AS conversions, {SD('clicks', 'impressions')} * 100 AS ctr,
       {SD('coalesce(conversions, 0.0)', 'clicks')} * 100 AS conv_rate,
       {SD('coalesce(cost, 0.0)', 'coalesce(conversions, 0.0)')} AS cpa, ad_strength
FROM ads WHERE coalesce(conversions, 0.0) >= 1
ORDER BY coalesce(ads.conversions, 0.0) DESC, coalesce(ads.cost, 0.0) DESC, coalesce(ads.ad_group_name, 'N/A'),
         coalesce(ads.headline_1, trim(split_part(ads.rsa_headlines, '|', 1)), 'N/A'), ads.clicks DESC,
         ads.impressions DESC, ads.ad_strength
LIMIT 15
"""

STRENGTH = """
, s AS (SELECT *, CASE WHEN lower(ad_strength) LIKE '%excellent%' THEN 'Excellent'
                       WHEN lower(ad_strength) LIKE '%good%' THEN 'Good'
                       WHEN lower(ad_strength) LIKE '%average%' THEN 'Average'
                       WHEN lower(ad_strength) LIKE '%poor%' THEN 'Poor' ELSE trim(ad_strength) END AS strength
        FROM ads WHERE ad_strength IS NOT NULL AND ad_strength <> '')"""

SQL["ga_ad_strength"] = STRENGTH + f"""
, g AS (SELECT strength, count(*) AS cnt, coalesce(sum(clicks), 0) AS c, coalesce(sum(impressions), 0) AS i,
               coalesce(sum(conversions), 0.0) AS v, coalesce(sum(cost), 0.0) AS k FROM s GROUP BY 1)
SELECT l.strength, CAST(l.level AS INTEGER) AS level, coalesce(g.cnt, 0) AS count,
       CASE WHEN coalesce(g.cnt, 0) > 0 THEN g.cnt * 100.0 / (SELECT count(*) FROM s) ELSE 0.0 END AS pct,
       CASE WHEN coalesce(g.cnt, 0) > 0 THEN {SD('g.c', 'g.i')} * 100 END AS avg_ctr,
       CASE WHEN coalesce(g.cnt, 0) > 0 THEN CASE WHEN g.v > 0 THEN g.k / g.v END END AS avg_cpa
FROM (VALUES ('Excellent', 0), ('Good', 1), ('Average', 2), ('Poor', 3)) l(strength, level) LEFT JOIN g USING (strength)
"""
SQL["ga_poor_ads"] = STRENGTH + """
SELECT coalesce(ad_group_name, 'N/A') AS ad_group, 'Poor' AS ad_strength, coalesce(cost, 0.0) AS cost
FROM s WHERE strength = 'Poor' ORDER BY cost DESC, ad_group LIMIT 5
"""

SQL["ga_funnel"] = f"""
, tr AS (SELECT *, {RATIOS}, {SD('cost', 'impressions')} * 1000 AS cpm,
                {SD('conversions', 'impressions')} * 100 AS ocr
         FROM (SELECT {SUMS} FROM camp) WHERE impressions > 0)
SELECT 1 AS step_order, 'Impressions' AS step, CAST(impressions AS DOUBLE) AS value,
       CAST(NULL AS DOUBLE) AS rate_from_prev, CAST(100.0 AS DOUBLE) AS pct_of_top, cpm, cpc, cpa,
       ocr AS overall_conversion_rate FROM tr
UNION ALL SELECT 2, 'Clicks', CAST(clicks AS DOUBLE), ctr, {SD('clicks', 'impressions')} * 100, cpm, cpc, cpa, ocr FROM tr
UNION ALL SELECT 3, 'Conversions', conversions, conv_rate, {SD('conversions', 'impressions')} * 100, cpm, cpc, cpa, ocr
FROM tr
"""

DOW = f"""
, dw0 AS (SELECT coalesce({INITCAP('upper(trim(day_of_week))')}, dayname("date")) AS day, cost, conversions, clicks,
                 impressions FROM camp),
dw AS (SELECT day, CAST(list_position(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'], day) - 1
                        AS INTEGER) AS day_order,
              coalesce(sum(cost), 0.0) AS cost, coalesce(sum(conversions), 0.0) AS conversions,
              {SD('coalesce(sum(cost), 0.0)', 'coalesce(sum(conversions), 0.0)')} AS cpa,
              {SD('coalesce(sum(clicks), 0)', 'coalesce(sum(impressions), 0)')} * 100 AS ctr
       FROM dw0 WHERE day IS NOT NULL GROUP BY day),
dwo AS (SELECT * FROM dw WHERE day_order >= 0)"""
HOUR = f"""
, hr AS (SELECT CAST(hour_of_day AS INTEGER) AS hour, coalesce(sum(cost), 0.0) AS cost,
                coalesce(sum(conversions), 0.0) AS conversions,
                {SD('coalesce(sum(cost), 0.0)', 'coalesce(sum(conversions), 0.0)')} AS cpa
         FROM camp WHERE hour_of_day IS NOT NULL GROUP BY 1)"""

SQL["ga_dow"] = DOW + "\nSELECT * FROM dwo\n"
SQL["ga_hour"] = HOUR + "\nSELECT * FROM hr\n"
SQL["ga_best_worst"] = DOW + HOUR + """
SELECT (SELECT day FROM dwo ORDER BY CASE WHEN round_even(cpa, 2) > 0 THEN round_even(cpa, 2) ELSE 99999.0 END,
                                     day_order LIMIT 1) AS best_day,
       (SELECT day FROM dwo ORDER BY round_even(cpa, 2) DESC, day_order LIMIT 1) AS worst_day,
       (SELECT list(hour ORDER BY k, hour) FROM (
          SELECT hour, CASE WHEN round_even(cpa, 2) > 0 THEN round_even(cpa, 2) ELSE 99999.0 END AS k
          FROM hr ORDER BY k, hour LIMIT 3)) AS best_hours,
       (SELECT list(hour ORDER BY k, hour) FROM (
          SELECT hour, -round_even(cpa, 2) AS k FROM hr ORDER BY k, hour LIMIT 3)) AS worst_hours
"""

SQL["ga_geo"] = f"""
, g AS (SELECT region AS location, {SUMS} FROM camp WHERE region IS NOT NULL GROUP BY 1)
SELECT location, cost, conversions, {SD('cost', 'conversions')} AS cpa, {SD('conversion_value', 'cost')} AS roas,
       {SD('clicks', 'impressions')} * 100 AS ctr, {SD('cost', '(SELECT sum(cost) FROM g)')} * 100 AS cost_share_pct,
       {SEM(SD('conversion_value', 'cost'), 4, 2)} AS cpa_status, 'region' AS geo_level
FROM g ORDER BY conversions DESC, location LIMIT 15
"""

DEVICE_LABEL = ("replace(replace(replace(replace(replace(replace(device, 'MOBILE', 'Mobile'), 'DESKTOP', 'Desktop'), "
                "'TABLET', 'Tablet'), 'Mobile phones', 'Mobile'), 'Computers', 'Desktop'), 'Tablets', 'Tablet')")
SQL["ga_device"] = f"""
, g AS (SELECT device, {SUMS} FROM camp WHERE device IS NOT NULL GROUP BY 1)
SELECT {DEVICE_LABEL} AS device, cost, impressions, clicks, conversions, {SD('clicks', 'impressions')} * 100 AS ctr,
       {SD('cost', 'clicks')} AS cpc, {SD('conversions', 'clicks')} * 100 AS conv_rate, {SD('cost', 'conversions')} AS cpa,
       {SD('conversion_value', 'cost')} AS roas, {SD('cost', '(SELECT sum(cost) FROM g)')} * 100 AS cost_share_pct,
       CASE WHEN (SELECT sum(conversions) FROM g) > 0
            THEN {SD('conversions', '(SELECT sum(conversions) FROM g)')} * 100 ELSE 0.0 END AS conv_share_pct
FROM g
"""

SQL["ga_asset_groups"] = f"""
, g AS (SELECT asset_group_name AS name, {SUMS}, min(ad_strength) AS ad_strength FROM camp
        WHERE asset_group_name IS NOT NULL AND asset_group_name <> '' GROUP BY 1)
SELECT name, impressions, clicks, conversions, cost, {SD('clicks', 'impressions')} * 100 AS ctr,
       {SD('cost', 'conversions')} AS cpa, {SD('conversion_value', 'cost')} AS roas, ad_strength FROM g
"""
SQL["ga_asset_group_strength"] = """
, g AS (SELECT asset_group_name AS name, min(ad_strength) AS s FROM camp
        WHERE asset_group_name IS NOT NULL AND asset_group_name <> '' AND ad_strength IS NOT NULL AND ad_strength <> ''
        GROUP BY 1)
SELECT name, trim(s) AS ad_strength,
       CASE WHEN lower(s) LIKE '%poor%' THEN 'Faltan assets mínimos. Agregar: 5+ headlines, 5+ descriptions, 3+ images, 1+ video'
            WHEN lower(s) LIKE '%average%' THEN 'Agregar más variaciones de headlines y al menos 1 video para mejorar a Good'
            WHEN lower(s) LIKE '%good%' THEN 'Agregar 2+ headlines y 1+ video para alcanzar Excellent'
            ELSE 'Excelente cobertura de assets' END AS recommendation
FROM g
"""

SQL["ga_brand_overlap"] = """
, t AS (SELECT *, lower(trim(search_term)) AS term FROM st WHERE search_term IS NOT NULL),
p AS (SELECT term, coalesce(sum(conversions), 0.0) AS pmax_conversions, coalesce(sum(cost), 0.0) AS pmax_cost
      FROM t WHERE term <> '' AND (campaign_type = 'PMax' OR lower(campaign_name) LIKE '%pmax%') GROUP BY 1),
b AS (SELECT term, coalesce(sum(conversions), 0.0) AS search_conversions, coalesce(sum(cost), 0.0) AS search_cost
      FROM t WHERE term <> '' AND campaign_type = 'Search' AND regexp_matches(campaign_name, '(?i)brand') GROUP BY 1)
SELECT * FROM p JOIN b USING (term) WHERE pmax_conversions > 0
"""

LEARN = f"""
, r AS (SELECT * FROM camp WHERE "date" IS NOT NULL
          AND "date" >= (SELECT max("date") FROM camp WHERE "date" IS NOT NULL) - 14),
g AS (SELECT campaign_name, coalesce(sum(conversions), 0.0) AS c, min(bid_strategy_type) AS bst FROM r
      WHERE campaign_name IS NOT NULL GROUP BY 1),
lp AS (SELECT campaign_name AS campaign, {INITCAP("replace(replace(bst, 'TARGET_', 'Target '), '_', ' ')")} AS strategy,
              c AS conv_last_14d, CASE WHEN c < 160 THEN 'learning' ELSE 'stable' END AS status,
              CASE WHEN c < 160 THEN (CASE WHEN c > 0 THEN round_even({SD('160 - c', 'c / 14')}, 0)
                                           WHEN c = 0 THEN 999.0 ELSE 0.0 END) ELSE 0.0 END AS est_days_remaining
       FROM g WHERE bst IS NOT NULL AND bst <> '')"""

SQL["ga_learning_period"] = LEARN + "\nSELECT * FROM lp\n"
SQL["ga_learning_summary"] = LEARN + """
SELECT count(*) AS total_smart_bidding, count(*) FILTER (WHERE status = 'learning') AS in_learning,
       count(*) FILTER (WHERE status = 'stable') AS stable FROM lp
"""

WEEKLY = f"""
, r AS (SELECT * FROM camp WHERE bid_strategy_type IS NOT NULL AND bid_strategy_type <> '' AND "date" IS NOT NULL
          AND campaign_name IS NOT NULL AND campaign_name <> ''),
info AS (SELECT campaign_name, min(bid_strategy_type) AS bst, min(target_cpa) AS tc, min(target_roas) AS tr
         FROM r GROUP BY 1),
wk AS (SELECT campaign_name, strftime("date", '%Y-W%U') AS week, coalesce(sum(cost), 0.0) AS c,
              coalesce(sum(conversions), 0.0) AS v, coalesce(sum(conversion_value), 0.0) AS val FROM r GROUP BY 1, 2),
j AS (SELECT wk.*, info.bst, info.tc, info.tr, upper(info.bst) LIKE '%CPA%' AS is_cpa,
             NOT (upper(info.bst) LIKE '%CPA%') AND upper(info.bst) LIKE '%ROAS%' AS is_roas
      FROM wk JOIN info USING (campaign_name)),
x AS (SELECT *, CASE WHEN is_cpa THEN tc WHEN is_roas THEN tr END AS target,
             CASE WHEN is_cpa THEN {SD('c', 'v')} WHEN is_roas THEN {SD('val', 'c')} END AS actual
      FROM j WHERE is_cpa OR is_roas),
wd AS (SELECT campaign_name AS campaign, week, CASE WHEN is_cpa THEN 'cpa' ELSE 'roas' END AS metric, actual,
              CASE WHEN coalesce(target <> 0, false) THEN round_even({SD('actual - target', 'target')} * 100, 1) END
                AS drift_pct, bst, target FROM x)"""

SQL["ga_weekly_drift"] = WEEKLY + "\nSELECT campaign, week, metric, actual, drift_pct FROM wd\n"
SQL["ga_drift_trend"] = WEEKLY + f"""
, a AS (SELECT campaign, bst, target, metric,
               arg_min(drift_pct, week) FILTER (WHERE drift_pct IS NOT NULL) AS f,
               arg_max(drift_pct, week) FILTER (WHERE drift_pct IS NOT NULL) AS l, count(drift_pct) AS n
        FROM wd GROUP BY 1, 2, 3, 4)
SELECT campaign, {LABEL('bst')} AS strategy, target,
       CASE WHEN n < 2 THEN 'stable'
            WHEN l < f THEN CASE WHEN metric = 'cpa' THEN 'improving' ELSE 'worsening' END
            WHEN l > f THEN CASE WHEN metric = 'cpa' THEN 'worsening' ELSE 'improving' END
            ELSE 'stable' END AS trend, l AS current_drift_pct
FROM a
"""

SQL["ga_match_type"] = f"""
, g AS (SELECT match_type, {SUMS}, count(*) AS rows FROM kw WHERE match_type IS NOT NULL GROUP BY 1)
SELECT {INITCAP("replace(replace(replace(match_type, 'EXACT', 'Exact'), 'PHRASE', 'Phrase'), 'BROAD', 'Broad')")} AS type,
       rows AS keywords, cost, conversions, {SD('cost', 'conversions')} AS cpa, {SD('clicks', 'impressions')} * 100 AS ctr,
       {SD('conversions', 'clicks')} * 100 AS conv_rate, {SD('cost', '(SELECT sum(cost) FROM g)')} * 100 AS cost_share_pct,
       CASE WHEN (SELECT sum(conversions) FROM g) > 0
            THEN {SD('conversions', '(SELECT sum(conversions) FROM g)')} * 100 ELSE 0.0 END AS conv_share_pct
FROM g WHERE (SELECT count(*) FROM g) >= 2
"""

SQL["ga_negative_words"] = ZERO + """
, w AS (SELECT unnest(string_split_regex(trim(lower(coalesce(search_term, ''))), '\\s+')) AS term, cost FROM z),
g AS (SELECT term, count(*) AS occurrences, sum(cost) AS total_cost FROM w WHERE length(term) >= 4 GROUP BY 1),
t AS (SELECT * FROM (SELECT * FROM g ORDER BY total_cost DESC, term LIMIT 15) WHERE occurrences >= 2)
SELECT term, occurrences, total_cost, (SELECT coalesce(sum(total_cost), 0.0) FROM t) AS total_potential_savings,
       (SELECT count(*) FROM st WHERE search_term_status IN ('Excluded', 'EXCLUDED')) AS already_excluded,
       (SELECT count(*) FROM t) AS new_suggestions
FROM t
"""

HEADS = """
, a AS (SELECT * FROM ads WHERE (headline_1 IS NOT NULL AND headline_1 <> '')
                              OR (rsa_headlines IS NOT NULL AND rsa_headlines <> '')),
e AS (SELECT unnest(CASE WHEN rsa_headlines IS NOT NULL AND rsa_headlines <> ''
                         THEN list_filter(list_transform(string_split(rsa_headlines, '|'), lambda h: trim(h)),
                                          lambda h: h <> '')
                         ELSE [headline_1] END) AS headline,
             CAST(coalesce(impressions, 0) AS BIGINT) AS i, CAST(coalesce(clicks, 0) AS BIGINT) AS c,
             coalesce(conversions, 0.0) AS v FROM a),
h AS (SELECT headline, CAST(sum(i) AS BIGINT) AS impressions, CAST(sum(c) AS BIGINT) AS clicks,
             sum(v) AS conversions FROM e GROUP BY 1)"""

SQL["ga_headlines_ctr"] = HEADS + f"""
SELECT headline, {SD('clicks', 'impressions')} * 100 AS ctr, impressions FROM h WHERE impressions >= 100
ORDER BY round_even({SD('h.clicks', 'h.impressions')} * 100, 2) DESC, headline LIMIT 10
"""
SQL["ga_headlines_conv"] = HEADS + f"""
SELECT headline, {SD('conversions', 'clicks')} * 100 AS conv_rate, conversions FROM h WHERE clicks >= 10
ORDER BY round_even(h.conversions, 1) DESC, headline LIMIT 10
"""

SQL["ga_conversion_health"] = f"""
, t AS (SELECT coalesce(sum(conversions), 0.0) AS conv, coalesce(sum(all_conversions), 0.0) AS allc,
               coalesce(sum(view_through_conversions), 0.0) AS vt FROM camp),
d AS (SELECT "date", coalesce(sum(conversions), 0.0) AS c FROM camp WHERE "date" IS NOT NULL GROUP BY 1),
r AS (SELECT c, row_number() OVER (ORDER BY "date" DESC) AS rn FROM d),
l AS (SELECT count(*) AS n, sum(c) FILTER (WHERE rn <= 7) / 7 AS l7, avg(c) FILTER (WHERE rn > 7) AS e FROM r),
x AS (SELECT *, CASE WHEN allc > 0 THEN conv / allc * 100 ELSE 100.0 END AS primary_pct, {SD('l7', 'e')} AS ratio
      FROM t, l)
SELECT conv AS primary_conversions, allc AS all_conversions, primary_pct, allc - conv AS secondary_only,
       vt AS view_through, CASE WHEN allc > 0 THEN vt / allc * 100 ELSE 0.0 END AS view_through_pct,
       CASE WHEN n >= 14 THEN l7 END AS last_7d_daily_avg, CASE WHEN n >= 14 THEN e END AS period_daily_avg,
       CASE WHEN n >= 14 THEN ratio END AS lag_ratio,
       CASE WHEN n >= 14 THEN CASE WHEN ratio < 0.65 THEN 'significant_lag' WHEN ratio < 0.85 THEN 'mild_lag'
                                   ELSE 'normal' END END AS lag_status,
       CASE WHEN primary_pct > 50 THEN 'good' ELSE 'review_needed' END AS health
FROM x WHERE conv <> 0 OR allc <> 0
"""

SQL["ga_attribution_bias"] = """
, g AS (SELECT campaign_name, coalesce(min(campaign_type), 'Unknown') AS t FROM camp
        WHERE campaign_name IS NOT NULL GROUP BY 1),
x AS (SELECT *, t = 'Search' AND lower(campaign_name) LIKE '%brand%' AS over,
             t IN ('Display', 'Video', 'Demand Gen') OR lower(campaign_name) LIKE '%pmax%' OR t = 'PMax' AS under FROM g)
SELECT campaign_name AS campaign,
       CASE WHEN over THEN 'Lower funnel' WHEN under THEN 'Upper funnel' ELSE 'Mid funnel' END AS type,
       CASE WHEN over THEN 'Overcounted in Last Click' WHEN under THEN 'Undercounted in Last Click'
            ELSE 'Neutral' END AS likely_bias
FROM x
"""

SQL["ga_auction_insights"] = """
, g AS (SELECT competitor_domain AS domain, round_even(avg(auction_is), 1) AS impression_share,
               round_even(avg(auction_overlap), 1) AS overlap_rate,
               round_even(avg(auction_outranking), 1) AS outranking_share,
               round_even(avg(auction_top_rate), 1) AS top_rate, round_even(avg(auction_abs_top_rate), 1) AS abs_top_rate
        FROM auction WHERE competitor_domain IS NOT NULL AND competitor_domain <> '' GROUP BY 1)
SELECT *, CASE WHEN coalesce(overlap_rate <> 0, false) AND overlap_rate > 70
                    AND coalesce(outranking_share <> 0, false) AND outranking_share < 50 THEN 'high'
               WHEN coalesce(overlap_rate <> 0, false) AND overlap_rate > 50 THEN 'medium' ELSE 'low' END AS threat_level,
       (SELECT round_even(avg(search_impression_share), 1) FROM camp
        WHERE coalesce(search_impression_share <> 0, false)) AS our_is
FROM g ORDER BY coalesce(overlap_rate, 0.0) DESC, domain LIMIT 10
"""

SCALE = """
, t AS (SELECT coalesce(sum(cost), 0.0) AS cost, coalesce(sum(conversions), 0.0) AS conv FROM camp),
s AS (SELECT avg(search_lost_is_budget) FILTER (WHERE coalesce(search_lost_is_budget <> 0, false)) AS lb,
             coalesce(avg(search_lost_is_rank) FILTER (WHERE coalesce(search_lost_is_rank <> 0, false)), 0.0) AS lr,
             coalesce(datediff('day', min("date"), max("date")) + 1, 30) AS days FROM camp),
x AS (SELECT *, CASE WHEN lb > 0 THEN conv * (lb / 100) ELSE 0.0 END AS add_conv,
             CASE WHEN lb > 0 THEN cost * (lb / 100) ELSE 0.0 END AS add_cost FROM t, s WHERE cost <> 0 AND lb IS NOT NULL)"""

SQL["ga_scaling_forecast"] = SCALE + f"""
SELECT CASE WHEN days > 0 THEN cost / days ELSE 0.0 END AS current_daily_budget, lb AS is_lost_budget,
       lr AS is_lost_rank, lb AS headroom_pct, add_conv AS estimated_additional_conversions,
       add_cost AS estimated_additional_cost, {SD('add_cost', 'add_conv')} AS estimated_marginal_cpa, lr < 20 AS viable
FROM x
"""
SQL["ga_scaling_scenarios"] = SCALE + f"""
SELECT p AS budget_increase_pct, CAST(p AS DOUBLE) * 0.7 AS est_conv_increase_pct,
       {SD('cost', 'conv')} * (1 + p / 100 * 0.15) AS est_new_cpa
FROM x, (VALUES (10), (25), (50)) v(p)
"""

SQL["ga_summary"] = f"""
, tr AS (SELECT *, {RATIOS} FROM (SELECT {SUMS} FROM camp))
SELECT cost AS total_cost, conversions AS total_conversions, conversion_value AS total_conversion_value, roas, cpa,
       impressions AS total_impressions, clicks AS total_clicks, ctr, cpc AS avg_cpc,
       (SELECT min("date") FROM camp) AS date_min, (SELECT max("date") FROM camp) AS date_max,
       (SELECT list_sort(list(DISTINCT campaign_type) FILTER (WHERE campaign_type IS NOT NULL)) FROM camp)
         AS campaign_types,
       coalesce(DATE '{AS_OF}' - (SELECT max("date") FROM camp) <= 7, false) AS conversion_lag_warning,
       (SELECT count(*) FROM camp) AS total_rows
FROM tr
"""

SQL["src_ads_csv"] = """
SELECT campaign_name, campaign_type, "date", CAST(hour_of_day AS BIGINT) AS hour_of_day, device, impressions, clicks,
       cost, conversions, conversion_value, all_conversions, bid_strategy_type, coalesce(target_cpa, 0.0) AS target_cpa,
       coalesce(target_roas, 0.0) AS target_roas, search_impression_share, region
FROM camp
"""


def nested(body: str) -> str:
    """A query body (CTEs that follow the prelude, then a select) as a subquery."""
    return "(WITH one AS (SELECT 1 AS one)" + body + ")" if body.lstrip().startswith(",") else f"({body})"


SQL["ga_signals"] = f"""
, u AS (
  SELECT 'high' AS priority, name AS area, 'benchmark_red' AS type, value FROM {nested(SQL["ga_benchmarks"])} WHERE status = 'red'
  UNION ALL SELECT 'high', campaign, 'bidding_underperforming', drift_pct FROM {nested(SQL["ga_bidding_status"])} WHERE status = 'underperforming'
  UNION ALL SELECT 'medium', campaign, 'learning', conv_last_14d FROM {nested(SQL["ga_learning_period"].replace("160", "30"))}
            WHERE status = 'learning'
  UNION ALL SELECT 'medium', 'Search Terms', 'wasted_spend', wasted_pct FROM {nested(SQL["ga_wasted_spend"])} WHERE wasted_pct > 20)
SELECT * FROM u ORDER BY CASE WHEN priority = 'high' THEN 0 ELSE 1 END, type, area LIMIT 10
"""

# Saved reports over a period; the views hold no status columns, ids or location types.
IN_PERIOD = "\"date\" BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'"
DELIVERY = ("CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, sum(cost) AS cost, "
            "sum(conversions) AS conversions")
CPA = SD("sum(cost)", "sum(conversions)") + " AS cpa"
CTR = SD("sum(clicks)", "sum(impressions)") + " * 100 AS ctr"

SQL["ga_saved_active_campaigns"] = f"""
SELECT CAST(NULL AS VARCHAR) AS campaign_id, campaign_name, CAST(NULL AS VARCHAR) AS campaign_status, campaign_type, bid_strategy_type,
       {DELIVERY}
FROM camp WHERE {IN_PERIOD} GROUP BY campaign_name, campaign_type, bid_strategy_type ORDER BY cost DESC
"""

SQL["ga_saved_campaign_days"] = f"""
SELECT CAST(NULL AS VARCHAR) AS campaign_id, campaign_name, "date", {DELIVERY}, sum(conversion_value) AS conversion_value, {CTR}, {CPA}
FROM camp WHERE {IN_PERIOD} GROUP BY campaign_name, "date" ORDER BY "date" DESC
"""

SQL["ga_saved_impression_share"] = f"""
, e AS (SELECT *, impressions * 100 / nullif(search_impression_share, 0) AS eligible FROM camp
        WHERE campaign_type = 'Search' AND {IN_PERIOD}),
s AS (SELECT campaign_name, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, sum(cost) AS cost,
             nullif(sum(eligible), 0) AS eligible, sum(search_impression_share * eligible) AS a, sum(search_lost_is_budget * eligible) AS b,
             sum(search_lost_is_rank * eligible) AS r, sum(search_top_is * eligible) AS t, sum(search_abs_top_is * eligible) AS u
      FROM e GROUP BY campaign_name)
SELECT CAST(NULL AS VARCHAR) AS campaign_id, campaign_name, a / eligible AS search_impression_share, b / eligible AS search_lost_is_budget,
       r / eligible AS search_lost_is_rank, t / eligible AS search_top_is, u / eligible AS search_abs_top_is, cost, impressions, clicks
FROM s
"""

SQL["ga_saved_keyword_quality"] = f"""
SELECT ad_group_name, keyword, match_type, quality_score, ad_relevance, expected_ctr, landing_page_experience, {DELIVERY}
FROM kw GROUP BY ALL HAVING sum(impressions) > 0 ORDER BY cost DESC
"""

SQL["ga_saved_search_terms"] = f"""
SELECT search_term, search_term_status, campaign_name, ad_group_name, {DELIVERY}, {CTR}
FROM st GROUP BY search_term, search_term_status, campaign_name, ad_group_name HAVING sum(impressions) > 0
ORDER BY round(sum(cost), 6) DESC, search_term NULLS FIRST, search_term_status NULLS FIRST, campaign_name, ad_group_name LIMIT 100
"""

SQL["ga_saved_asset_groups"] = f"""
SELECT CAST(NULL AS VARCHAR) AS asset_group_id, asset_group_name, CAST(NULL AS VARCHAR) AS asset_group_status, ad_strength, campaign_name,
       {DELIVERY}, sum(conversion_value) AS conversion_value
FROM camp WHERE asset_group_name IS NOT NULL AND {IN_PERIOD} GROUP BY asset_group_name, ad_strength, campaign_name
"""

SQL["ga_saved_devices"] = f"""
SELECT campaign_name, device, {DELIVERY}, {CTR}, {CPA} FROM camp WHERE {IN_PERIOD} GROUP BY campaign_name, device
"""

SQL["ga_saved_places"] = f"""
SELECT campaign_name, country, region, CAST(NULL AS VARCHAR) AS location_type, {DELIVERY}, {CPA}
FROM camp WHERE {IN_PERIOD} GROUP BY campaign_name, country, region
ORDER BY round(sum(cost), 6) DESC, campaign_name, country, region LIMIT 50
"""

SQL["ga_saved_weekdays"] = f"""
SELECT campaign_name, dayname("date") AS weekday, {DELIVERY}, {CPA} FROM camp WHERE {IN_PERIOD} GROUP BY campaign_name, weekday
"""
