"""Oracle SQL (DuckDB) for the social-ads operators (view ``social``)."""

from mercato.plans.oracle_search import INITCAP, SD, nested


def SEM(v: str, g: float, y: float, reverse: bool = False) -> str:
    if reverse:
        return f"(CASE WHEN {v} <= {g} THEN 'green' WHEN {v} <= {y} THEN 'yellow' ELSE 'red' END)"
    return f"(CASE WHEN {v} >= {g} THEN 'green' WHEN {v} >= {y} THEN 'yellow' ELSE 'red' END)"


BASE = ["spend", "impressions", "clicks", "link_clicks", "purchases", "purchase_value", "reach"]


def SUMS(cols=BASE) -> str:
    return ", ".join(f"coalesce(sum({c}), 0.0) AS {c}" for c in cols)


RATIOS = (f"{SD('purchase_value', 'spend')} AS roas, {SD('spend', 'purchases')} AS cpa, "
          f"{SD('clicks * 100', 'impressions')} AS ctr, {SD('spend * 1000', 'impressions')} AS cpm")

SQL = {}

SQL["ma_dashboard"] = f"""
, t AS (SELECT {SUMS()}, min(date_start) AS date_min, max(date_start) AS date_max,
               count(DISTINCT campaign_name) AS num_campaigns, count(DISTINCT adset_name) AS num_adsets,
               count(DISTINCT ad_name) AS num_ads FROM social)
SELECT spend, purchases, purchase_value AS revenue, {RATIOS}, impressions, reach, clicks, link_clicks,
       {SD('impressions', 'reach')} AS frequency, date_min, date_max, num_campaigns, num_adsets, num_ads FROM t
"""

SQL["ma_benchmarks"] = f"""
, t AS (SELECT {SUMS()} FROM social),
v AS (SELECT {SD('clicks * 100', 'impressions')} AS ctr, {SD('spend * 1000', 'impressions')} AS cpm,
             CASE WHEN reach > 0 THEN {SD('impressions', 'reach')} ELSE 0.0 END AS freq,
             {SD('purchase_value', 'spend')} AS roas, {SD('spend', 'link_clicks')} AS cpc,
             {SD('spend', 'purchases')} AS cpa FROM t)
SELECT 'CTR (all)' AS metric, ctr AS value, '%' AS unit, {SEM('ctr', 2.0, 1.0)} AS semaphore FROM v UNION ALL
SELECT 'CPM', cpm, '$', 'contextual' FROM v UNION ALL
SELECT 'Frecuencia', freq, 'x', {SEM('freq', 3.0, 5.0, True)} FROM v UNION ALL
SELECT 'ROAS', roas, 'x', {SEM('roas', 3.0, 1.5)} FROM v UNION ALL
SELECT 'CPC (Link Click)', cpc, '$', 'contextual' FROM v UNION ALL
SELECT 'CPA (Purchase)', cpa, '$', 'contextual' FROM v
"""

DAILY = f"\n, d AS (SELECT date_start, {SUMS()} FROM social WHERE date_start IS NOT NULL GROUP BY 1)"

SQL["ma_daily"] = DAILY + f"\nSELECT date_start AS \"date\", spend, purchases, {RATIOS} FROM d\n"


def by(key: str) -> str:
    return f"\n, g AS (SELECT {key}, {SUMS()} FROM social WHERE {key} IS NOT NULL GROUP BY 1)"


SQL["ma_campaigns"] = by("campaign_name") + f"""
SELECT campaign_name AS campaign, spend, impressions, purchases, purchase_value AS revenue, {RATIOS},
       {SD('impressions', 'reach')} AS frequency,
       {SEM(f"round_even({SD('purchase_value', 'spend')}, 2)", 3.0, 1.5)} AS roas_semaphore,
       {SEM(f"round_even({SD('clicks * 100', 'impressions')}, 2)", 2.0, 1.0)} AS ctr_semaphore,
       {SEM(f"round_even({SD('impressions', 'reach')}, 2)", 3.0, 5.0, True)} AS freq_semaphore
FROM g
"""

SQL["ma_budget_distribution"] = by("campaign_name") + f"""
, x AS (SELECT campaign_name AS campaign, spend,
               round_even({SD('spend * 100', '(SELECT sum(spend) FROM g)')}, 1) AS spend_pct, purchases,
               CASE WHEN (SELECT sum(purchases) FROM g) > 0
                    THEN round_even({SD('purchases * 100', '(SELECT sum(purchases) FROM g)')}, 1) ELSE 0.0 END
                 AS purchases_pct,
               {SD('purchase_value', 'spend')} AS roas FROM g)
SELECT *, CASE WHEN spend_pct > purchases_pct + 5.0 THEN 'over' WHEN purchases_pct > spend_pct + 5.0 THEN 'under'
               ELSE 'balanced' END AS efficiency FROM x
"""

LEARN = """
, lp AS (SELECT adset_name AS adset, coalesce(sum(purchases), 0.0) + coalesce(sum(leads), 0.0) AS optimization_events,
                coalesce(sum(spend), 0.0) AS spend, count(DISTINCT date_start) AS days
         FROM social WHERE adset_name IS NOT NULL GROUP BY 1),
lps AS (SELECT *, CASE WHEN optimization_events >= 50 THEN 'active' WHEN optimization_events >= 10 THEN 'learning'
                       ELSE 'learning_limited' END AS status,
               greatest(0.0, 50.0 - optimization_events) AS events_needed FROM lp)"""

SQL["ma_learning_phase"] = LEARN + "\nSELECT * FROM lps\n"
SQL["ma_learning_summary"] = LEARN + """
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active,
       count(*) FILTER (WHERE status = 'learning') AS learning,
       count(*) FILTER (WHERE status = 'learning_limited') AS learning_limited FROM lps
"""

SQL["ma_adsets"] = by("adset_name") + f"""
, a AS (SELECT {SD('(SELECT sum(spend) FROM g)', '(SELECT sum(purchases) FROM g)')} AS avg_cpa)
SELECT adset_name AS adset, spend, impressions, purchases, purchase_value AS revenue, {RATIOS},
       CASE WHEN a.avg_cpa > 0 THEN round_even({SD('spend', 'purchases')}, 2) > a.avg_cpa * 1.3 ELSE false END
         AS breakdown_warning, a.avg_cpa
FROM g, a
"""

SQL["ma_audiences"] = by("adset_name") + f"""
SELECT adset_name AS audience, spend, reach, purchases, {SD('purchase_value', 'spend')} AS roas,
       {SD('spend', 'purchases')} AS cpa, {SD('purchases * 100', 'reach')} AS conv_rate FROM g
"""

SQL["ma_ad_ranking"] = by("ad_name") + f"""
, r AS (SELECT ad_name, spend, purchases, round_even({SD('purchase_value', 'spend')}, 2) AS roas,
               round_even({SD('spend', 'purchases')}, 2) AS cpa, round_even({SD('clicks * 100', 'impressions')}, 2) AS ctr
        FROM g),
stt AS (SELECT CASE WHEN max(roas) > 0 THEN max(roas) ELSE 1.0 END AS mr,
              coalesce(min(cpa) FILTER (WHERE cpa > 0), 1.0) AS mc,
              CASE WHEN max(ctr) > 0 THEN max(ctr) ELSE 1.0 END AS mt, count(*) AS n FROM r),
sc AS (SELECT r.*, (roas / mr) * 0.4 + (1 - least(greatest(cpa, 0.0), mc * 10) / (mc * 10)) * 0.35
                   + (ctr / mt) * 0.25 AS score, n FROM r, stt)
SELECT CAST(row_number() OVER (ORDER BY score DESC, ad_name) AS INTEGER) AS rank, ad_name AS ad, spend, purchases,
       roas, cpa, ctr, score, n AS total_ads
FROM sc ORDER BY score DESC, ad_name LIMIT 20
"""

FATIGUE = f"""
, dd AS (SELECT ad_name, date_start, coalesce(sum(impressions), 0.0) AS impressions,
                coalesce(sum(clicks), 0.0) AS clicks, coalesce(sum(reach), 0.0) AS reach
         FROM social WHERE ad_name IS NOT NULL AND date_start IS NOT NULL GROUP BY 1, 2),
rr AS (SELECT *, row_number() OVER (PARTITION BY ad_name ORDER BY date_start) AS rn,
              count(*) OVER (PARTITION BY ad_name) AS n FROM dd),
a AS (SELECT ad_name, n, coalesce(sum(clicks) FILTER (WHERE rn <= n // 2), 0.0) AS c1,
             coalesce(sum(impressions) FILTER (WHERE rn <= n // 2), 0.0) AS i1,
             coalesce(sum(clicks) FILTER (WHERE rn > n // 2), 0.0) AS c2,
             coalesce(sum(impressions) FILTER (WHERE rn > n // 2), 0.0) AS i2,
             sum(impressions) AS i, sum(reach) AS r FROM rr GROUP BY 1, 2 HAVING n >= 5),
b AS (SELECT ad_name, n, {SD('c1 * 100', 'i1')} AS f1, {SD('c2 * 100', 'i2')} AS f2, {SD('i', 'r')} AS fr FROM a),
fa AS (SELECT ad_name AS ad, f1 AS ctr_first_half, f2 AS ctr_second_half,
              CASE WHEN f1 > 0 THEN {SD('(f2 - f1) * 100', 'f1')} ELSE 0.0 END AS ctr_change_pct,
              fr AS avg_frequency, n AS days_active FROM b),
fat AS (SELECT *, ctr_change_pct < -20 AS ctr_drop, avg_frequency > 4 AS high_frequency FROM fa
        WHERE ctr_change_pct < -20 OR avg_frequency > 4)"""

SQL["ma_creative_fatigue"] = FATIGUE + """
SELECT *, (SELECT count(DISTINCT ad_name) FROM social) AS total_analyzed FROM fat
ORDER BY ctr_change_pct, ad LIMIT 15
"""

TOT = ("\n, t AS (SELECT " + SUMS(sorted(set(BASE) | {"landing_page_views", "add_to_cart", "checkout_initiated",
                                                   "leads"})) + " FROM social)")

SQL["ma_funnel"] = TOT + f"""
SELECT stage_order, stage, value, pct FROM (
  SELECT 0 AS stage_order, 'Impressions' AS stage, impressions AS value, CAST(100.0 AS DOUBLE) AS pct, true AS k FROM t
  UNION ALL SELECT 1, 'Clicks (all)', clicks, {SD('clicks * 100', 'impressions')}, true FROM t
  UNION ALL SELECT 2, 'Link Clicks', link_clicks, {SD('link_clicks * 100', 'impressions')}, true FROM t
  UNION ALL SELECT 3, 'Landing Page Views', landing_page_views, {SD('landing_page_views * 100', 'impressions')},
                   landing_page_views > 0 FROM t
  UNION ALL SELECT 4, 'Add to Cart', add_to_cart, {SD('add_to_cart * 100', 'impressions')}, add_to_cart > 0 FROM t
  UNION ALL SELECT 5, 'Checkout Initiated', checkout_initiated, {SD('checkout_initiated * 100', 'impressions')},
                   checkout_initiated > 0 FROM t
  UNION ALL SELECT 6, 'Purchases', purchases, {SD('purchases * 100', 'impressions')}, true FROM t)
WHERE k
"""

DROP = TOT + """
, s AS (SELECT 0 AS step_order, 'Impressions → Clicks' AS transition, impressions AS from_value, link_clicks AS to_value FROM t
        UNION ALL SELECT 1, 'Clicks → Landing Page Views', link_clicks, landing_page_views FROM t
        UNION ALL SELECT 2, 'Landing Page Views → Add to Cart', landing_page_views, add_to_cart FROM t
        UNION ALL SELECT 3, 'Add to Cart → Checkout', add_to_cart, checkout_initiated FROM t
        UNION ALL SELECT 4, 'Checkout → Purchase', checkout_initiated, purchases FROM t),
dr AS (SELECT *, """ + SD('to_value * 100', 'from_value') + " AS conversion_rate, 100 - " + SD('to_value * 100', 'from_value') + """ AS dropoff_rate
       FROM s WHERE from_value > 0 AND to_value > 0)"""

SQL["ma_dropoff"] = DROP + "\nSELECT * FROM dr\n"

SQL["ma_dow"] = f"""
, g AS (SELECT CAST(isodow(date_start) - 1 AS INTEGER) AS day_num, {SUMS()} FROM social
        WHERE date_start IS NOT NULL GROUP BY 1),
o AS (SELECT dayname(date_start) AS day, day_num, spend, purchases, {SD('purchase_value', 'spend')} AS roas,
             {SD('spend', 'purchases')} AS cpa, {SD('spend * 1000', 'impressions')} AS cpm
      FROM g, (SELECT DATE '2024-01-01' + day_num AS date_start) x)
SELECT *, (SELECT day FROM o ORDER BY round_even(roas, 2) DESC, day_num LIMIT 1) AS best_day,
       (SELECT day FROM o ORDER BY round_even(roas, 2) ASC, day_num LIMIT 1) AS worst_day FROM o
"""

SQL["ma_period_trend"] = DAILY + f"""
, w AS (SELECT d.*, p.window_days FROM d, (VALUES (30), (60), (90)) p(window_days)
        WHERE (SELECT count(*) FROM d) >= 7 AND d.date_start >= (SELECT max(date_start) FROM d) - p.window_days)
SELECT 'last_' || CAST(window_days AS VARCHAR) || 'd' AS period,
       {SD('sum(purchase_value)', 'sum(spend)')} AS roas, {SD('sum(spend)', 'sum(purchases)')} AS cpa,
       sum(spend) AS spend, sum(purchases) AS purchases, count(*) AS days
FROM w GROUP BY window_days
"""

LAST = DAILY + "\n, lr AS (SELECT *, row_number() OVER (ORDER BY date_start DESC) AS r FROM d)"

SQL["ma_roas_direction"] = LAST + f"""
, a AS (SELECT count(*) AS n,
               {SD('coalesce(sum(purchase_value) FILTER (WHERE r <= 7), 0.0)', 'coalesce(sum(spend) FILTER (WHERE r <= 7), 0.0)')} AS l,
               {SD('coalesce(sum(purchase_value) FILTER (WHERE r > 7 AND r <= 14), 0.0)',
                   'coalesce(sum(spend) FILTER (WHERE r > 7 AND r <= 14), 0.0)')} AS p FROM lr)
SELECT CASE WHEN n < 14 THEN 'insufficient_data' WHEN l > p THEN 'improving' WHEN l < p THEN 'declining'
            ELSE 'stable' END AS trend, CASE WHEN n >= 14 THEN l END AS roas_last,
       CASE WHEN n >= 14 THEN p END AS roas_prev FROM a
"""

SQL["ma_geo"] = by("region") + f"""
SELECT region, spend, impressions, purchases, {SD('purchase_value', 'spend')} AS roas, {SD('spend', 'purchases')} AS cpa,
       {SD('spend * 1000', 'impressions')} AS cpm, 'region' AS geo_type, (SELECT count(*) FROM g) AS total_regions
FROM g ORDER BY spend DESC, region LIMIT 20
"""

SQL["ma_placement"] = by("placement") + f"""
, a AS (SELECT {SD('(SELECT sum(spend) FROM g)', '(SELECT sum(purchases) FROM g)')} AS avg_cpa)
SELECT placement, spend, impressions, purchases, {RATIOS},
       CASE WHEN a.avg_cpa > 0 AND purchases > 0 THEN round_even({SD('spend', 'purchases')}, 2) > a.avg_cpa * 1.3
            ELSE false END AS breakdown_warning, a.avg_cpa
FROM g, a
"""

SQL["ma_device"] = by("device") + f"""
SELECT device, spend, {SD('spend * 100', '(SELECT sum(spend) FROM g)')} AS spend_pct, impressions, purchases, {RATIOS}
FROM g
"""

# ---------------------------------------------------------------- naming convention
FMT = ("map {'ugc': 'UGC', 'estatico': 'Estático', 'static': 'Estático', 'estático': 'Estático', 'video': 'Video', "
       "'carrusel': 'Carrusel', 'carousel': 'Carrusel', 'catálogo': 'Catálogo', 'catalogo': 'Catálogo', "
       "'catalog': 'Catálogo', 'colección': 'Colección', 'coleccion': 'Colección', 'collection': 'Colección', "
       "'imagen': 'Estático', 'image': 'Estático', 'reel': 'Video', 'reels': 'Video', 'dpa': 'Catálogo'}")
STAGE = ("map {'tof': 'TOF', 'tofu': 'TOF', 'top': 'TOF', 'prospecting': 'TOF', 'mof': 'MOF', 'mofu': 'MOF', "
         "'mid': 'MOF', 'consideration': 'MOF', 'bof': 'BOF', 'bofu': 'BOF', 'bot': 'BOF', 'retargeting': 'BOF', "
         "'ret': 'BOF', 'rmk': 'BOF', 'remarketing': 'BOF'}")

# the fixture's ad names are pipe-separated ("standard" naming), so the oracle parses that form
PARSED = f"""
, nm AS (SELECT DISTINCT ad_name AS name FROM social WHERE ad_name IS NOT NULL),
pp AS (SELECT name, list_transform(string_split(name, '|'), lambda p: trim(p)) AS parts FROM nm),
pn AS (SELECT name,
              CASE WHEN len(parts) >= 1 AND parts[1] <> '' THEN {INITCAP('parts[1]')} END AS product,
              CASE WHEN len(parts) >= 2 THEN coalesce({FMT}[lower(parts[2])], parts[2]) END AS format,
              CASE WHEN len(parts) >= 3 THEN coalesce({STAGE}[lower(parts[3])], upper(parts[3])) END AS stage,
              CASE WHEN len(parts) >= 4 AND parts[4] <> '' THEN {INITCAP('parts[4]')} END AS creator,
              CASE WHEN len(parts) >= 5 AND parts[5] <> '' THEN parts[5] END AS variation FROM pp)"""

SQL["ma_name_detect"] = """
, nm AS (SELECT DISTINCT ad_name AS n FROM social WHERE ad_name IS NOT NULL),
v AS (SELECT count(*) AS c, count(*) FILTER (WHERE contains(n, ' | ')) AS pipe,
             count(*) FILTER (WHERE len(string_split(n, '_')) >= 3) AS under,
             count(*) FILTER (WHERE len(list_filter(string_split(upper(n), '_')[1:2],
                                                   lambda p: list_contains(['TOF','MOF','BOF','TOFU','MOFU','BOFU'], p))) > 0)
               AS stg FROM nm)
SELECT CASE WHEN pipe > c * 0.3 THEN 'standard' WHEN under > c * 0.3 AND stg > c * 0.2 THEN 'alternative'
            ELSE 'unknown' END AS format FROM v
"""
SQL["ma_name_parse"] = PARSED + "\nSELECT * FROM pn\n"
SQL["ma_name_parse_standard"] = PARSED + "\nSELECT * FROM pn\n"

SQL["ma_name_parse_alternative"] = f"""
, nm AS (SELECT DISTINCT ad_name AS name FROM social WHERE ad_name IS NOT NULL),
pp AS (SELECT name, list_transform(string_split(name, '_'), lambda p: trim(p)) AS parts FROM nm)
SELECT name, CASE WHEN len(parts) >= 2 THEN {INITCAP("replace(parts[2], '-', ' ')")} END AS product,
       CASE WHEN len(parts) >= 3 THEN coalesce({FMT}[lower(parts[3])], parts[3]) END AS format,
       coalesce({STAGE}[lower(parts[1])], upper(parts[1])) AS stage,
       CAST(NULL AS VARCHAR) AS creator, CASE WHEN len(parts) >= 4 THEN parts[4] END AS variation FROM pp
"""

SQL["ma_name_summary"] = PARSED + """
, f AS (SELECT 'format' AS field, format AS value FROM pn UNION ALL SELECT 'stage', stage FROM pn
        UNION ALL SELECT 'creator', creator FROM pn UNION ALL SELECT 'product', product FROM pn),
c AS (SELECT field, value, count(*) AS count FROM f WHERE value IS NOT NULL GROUP BY 1, 2),
cr AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY count DESC, value) AS r FROM c)
SELECT field, value, count FROM cr WHERE field <> 'product' OR r <= 15
UNION ALL SELECT 'names', 'parsed', count(*) FILTER (WHERE NOT (format IS NULL AND stage IS NULL)) FROM pn
UNION ALL SELECT 'names', 'unparsed', count(*) FILTER (WHERE format IS NULL AND stage IS NULL) FROM pn
"""


def by_field(field: str) -> str:
    return PARSED + f"""
, j AS (SELECT s.*, pn.{field} AS fld FROM social s JOIN pn ON pn.name = s.ad_name),
g AS (SELECT fld AS {field}, {SUMS()} FROM j WHERE fld IS NOT NULL GROUP BY 1)
SELECT {field}, spend, impressions, clicks, purchases, purchase_value, reach, {RATIOS} FROM g
"""


for _f in ("format", "stage", "creator", "product"):
    SQL[f"ma_by_{_f}"] = by_field(_f)

SQL["ma_format_stage_matrix"] = PARSED + f"""
, j AS (SELECT s.*, pn.format, pn.stage FROM social s JOIN pn ON pn.name = s.ad_name),
g AS (SELECT format, stage, coalesce(sum(spend), 0.0) AS spend, coalesce(sum(purchase_value), 0.0) AS purchase_value,
             coalesce(sum(purchases), 0.0) AS purchases FROM j WHERE format IS NOT NULL AND stage IS NOT NULL GROUP BY 1, 2)
SELECT *, {SD('purchase_value', 'spend')} AS roas FROM g
"""

REL = """
, rel AS (SELECT ad_name AS name,
                 min(quality_ranking) AS quality_ranking, min(engagement_ranking) AS engagement_ranking,
                 min(conversion_ranking) AS conversion_ranking FROM social WHERE ad_name IS NOT NULL GROUP BY 1)"""

SQL["ma_relevance"] = REL + "\nSELECT * FROM rel\n"
SQL["ma_relevance_distribution"] = REL + """
, e AS (SELECT 'quality_ranking' AS ranking, quality_ranking AS value FROM rel
        UNION ALL SELECT 'engagement_ranking', engagement_ranking FROM rel
        UNION ALL SELECT 'conversion_ranking', conversion_ranking FROM rel)
SELECT ranking, value, count(*) AS count FROM e WHERE value IS NOT NULL GROUP BY 1, 2
"""

SQL["ma_hook_rate"] = f"""
, g AS (SELECT ad_name AS ad, coalesce(sum(impressions), 0.0) AS impressions, coalesce(sum(video_3s), 0.0) AS video_3s,
               coalesce(sum(spend), 0.0) AS spend FROM social WHERE ad_name IS NOT NULL GROUP BY 1),
f AS (SELECT *, {SD('video_3s * 100', 'impressions')} AS hook_rate FROM g WHERE impressions > 100)
SELECT ad, impressions, video_3s, hook_rate, spend,
       (SELECT {SD('sum(video_3s) * 100', 'sum(impressions)')} FROM f) AS avg_hook_rate
FROM f ORDER BY round_even(hook_rate, 2) DESC, ad LIMIT 20
"""

SQL["ma_video_completion"] = f"""
, t AS (SELECT {SUMS(['impressions', 'video_p25', 'video_p50', 'video_p75', 'video_p100'])} FROM social)
SELECT 'video_p25' AS metric, video_p25 AS value, {SD('video_p25 * 100', 'impressions')} AS rate FROM t
UNION ALL SELECT 'video_p50', video_p50, {SD('video_p50 * 100', 'impressions')} FROM t
UNION ALL SELECT 'video_p75', video_p75, {SD('video_p75 * 100', 'impressions')} FROM t
UNION ALL SELECT 'video_p100', video_p100, {SD('video_p100 * 100', 'impressions')} FROM t
"""

SQL["ma_video_completion_ads"] = f"""
, g AS (SELECT ad_name AS ad, {SUMS(['impressions', 'video_p25', 'video_p50', 'video_p75', 'video_p100'])}
        FROM social WHERE ad_name IS NOT NULL GROUP BY 1)
SELECT ad, impressions, {SD('video_p25 * 100', 'impressions')} AS p25_rate, {SD('video_p50 * 100', 'impressions')} AS p50_rate,
       {SD('video_p75 * 100', 'impressions')} AS p75_rate, {SD('video_p100 * 100', 'impressions')} AS p100_rate
FROM g WHERE impressions > 100
"""

SQL["ma_forecast"] = LAST + f"""
, r30 AS (SELECT *, CAST((SELECT count(*) FROM lr WHERE r <= 30) - r AS DOUBLE) AS x,
                 {SD('purchase_value', 'spend')} AS y2 FROM lr WHERE r <= 30),
fit AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(spend) AS sy1, sum(y2) AS sy2, sum(x * spend) AS sxy1,
               sum(x * y2) AS sxy2, sum(x * x) AS sxx FROM r30),
c AS (SELECT n, (n * sxy1 - sx * sy1) / (n * sxx - sx * sx) AS m1, (n * sxy2 - sx * sy2) / (n * sxx - sx * sx) AS m2,
             sx, sy1, sy2 FROM fit WHERE (SELECT count(*) FROM d) >= 14),
cc AS (SELECT *, (sy1 - m1 * sx) / n AS b1, (sy2 - m2 * sx) / n AS b2 FROM c)
SELECT CAST(k AS INTEGER) AS day, greatest(0.0, m1 * (n - 1 + k) + b1) AS forecast_spend,
       greatest(0.0, m2 * (n - 1 + k) + b2) AS forecast_roas,
       CASE WHEN m1 > 0 THEN 'increasing' ELSE 'decreasing' END AS spend_trend,
       CASE WHEN m2 > 0 THEN 'improving' ELSE 'declining' END AS roas_trend
FROM cc, range(1, 31) t(k)
"""

SQL["ma_overlap_cv"] = f"""
, d AS (SELECT adset_name, date_start, coalesce(sum(spend), 0.0) AS spend, coalesce(sum(impressions), 0.0) AS impressions
        FROM social WHERE adset_name IS NOT NULL AND date_start IS NOT NULL GROUP BY 1, 2),
g AS (SELECT adset_name, avg({SD('spend * 1000', 'impressions')}) AS avg_cpm,
             stddev_samp({SD('spend * 1000', 'impressions')}) AS cpm_std FROM d GROUP BY 1),
c AS (SELECT *, {SD('cpm_std', 'avg_cpm')} AS cv FROM g)
SELECT adset_name AS adset, avg_cpm, cpm_std, cv, CASE WHEN cv > 0.6 THEN 'high' ELSE 'medium' END AS risk
FROM c WHERE cv > 0.4 AND avg_cpm > 0 ORDER BY cv DESC, adset LIMIT 10
"""

SQL["ma_pacing"] = f"""
, d AS (SELECT campaign_name, date_start, coalesce(sum(spend), 0.0) AS spend FROM social
        WHERE campaign_name IS NOT NULL AND date_start IS NOT NULL GROUP BY 1, 2),
a AS (SELECT *, avg(spend) OVER (PARTITION BY campaign_name) AS m FROM d),
g AS (SELECT campaign_name AS campaign, avg(spend) AS avg_daily_spend, stddev_samp(spend) AS spend_std,
             count(*) FILTER (WHERE spend < m * 0.5) AS underspend_days,
             count(*) FILTER (WHERE spend > m * 1.5) AS overspend_days, count(*) AS total_days
      FROM a GROUP BY 1 HAVING count(*) >= 3)
SELECT campaign, avg_daily_spend, spend_std, {SD('spend_std', 'avg_daily_spend')} AS cv, underspend_days, overspend_days,
       total_days,
       CASE WHEN {SD('spend_std', 'avg_daily_spend')} < 0.3 THEN 'stable'
            WHEN {SD('spend_std', 'avg_daily_spend')} < 0.5 THEN 'variable' ELSE 'erratic' END AS pacing
FROM g
"""

MARG = DAILY + f"""
, mg AS (SELECT date_start AS "date", spend, purchases, {SD('spend', 'purchases')} AS daily_cpa,
                {SD('sum(spend) OVER run', 'sum(purchases) OVER run')} AS avg_cpa,
                {SD('sum(spend) OVER roll', 'sum(purchases) OVER roll')} AS marginal_cpa_3d
         FROM d WHERE (SELECT count(*) FROM d) >= 7
         WINDOW run AS (ORDER BY date_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                roll AS (ORDER BY date_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""

SQL["ma_marginal_cpa"] = MARG + "\nSELECT * FROM mg\n"
SQL["ma_marginal_trend"] = MARG + """
, r AS (SELECT *, row_number() OVER (ORDER BY "date" DESC) AS rn FROM mg),
a AS (SELECT count(*) AS n, avg(marginal_cpa_3d) FILTER (WHERE rn <= 7) AS rc,
             avg(marginal_cpa_3d) FILTER (WHERE rn > 7 AND rn <= 14) AS pv FROM r)
SELECT CASE WHEN n < 14 THEN 'insufficient_data' WHEN rc > pv * 1.1 THEN 'rising' WHEN rc < pv * 0.9 THEN 'falling'
            ELSE 'stable' END AS trend, CASE WHEN n >= 14 THEN rc END AS recent_marginal_cpa,
       CASE WHEN n >= 14 THEN pv END AS previous_marginal_cpa FROM a
"""

SQL["src_social_json"] = """
SELECT campaign_name, adset_name, ad_name, date_start, impressions, reach, spend, clicks, device, placement, region,
       country, quality_ranking, engagement_ranking, conversion_ranking, purchases, leads, link_clicks,
       landing_page_views, add_to_cart, checkout_initiated, purchase_value
FROM social
"""

SQL["ma_signals"] = f"""
, u AS (
  SELECT 'high' AS priority, metric AS area, 'benchmark_red' AS type, value FROM {nested(SQL["ma_benchmarks"])} WHERE semaphore = 'red'
  UNION ALL SELECT 'high', 'Learning Phase', 'learning_limited', CAST(learning_limited AS DOUBLE) FROM {nested(SQL["ma_learning_summary"])}
            WHERE learning_limited > 0
  UNION ALL SELECT 'medium', 'Creative Fatigue', 'fatigue', CAST(n AS DOUBLE) FROM {nested(FATIGUE + " SELECT count(*) AS n FROM fat")} WHERE n > 0
  UNION ALL SELECT 'medium', transition, 'funnel_leak', dropoff_rate FROM {nested(SQL["ma_dropoff"])} WHERE dropoff_rate > 95)
SELECT * FROM u ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, type, area LIMIT 10
"""
