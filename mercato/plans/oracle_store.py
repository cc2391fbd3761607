"""Oracle SQL (DuckDB) for the store operators.

Each body follows ``oracle_views.PRELUDE`` and reads the views ``lines`` and
``ords``.  They restate the rules independently of the Spark code; ties are
broken by the same keys.
"""

MONTHS = "['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic']"
DAYS = "['Lunes','Martes','Miércoles','Jueves','Viernes','Sábado','Domingo']"
VALID = "ords WHERE \"date\" IS NOT NULL AND total IS NOT NULL"
MONTHLY = f"""
, m AS (
  SELECT strftime("date", '%Y-%m') AS month, sum(total) AS revenue,
         count(DISTINCT order_id) AS orders, avg(total) AS avg_ticket
  FROM {VALID} GROUP BY 1
)"""

SQL = {}

SQL["ec_monthly_revenue"] = MONTHLY + """
, m2 AS (SELECT *, lag(revenue) OVER (ORDER BY month) AS prev FROM m)
SELECT a.month, a.revenue, a.orders, a.avg_ticket,
       CASE WHEN a.prev <> 0 THEN (a.revenue - a.prev) / a.prev * 100 END AS mom_pct,
       CASE WHEN b.revenue > 0 THEN (a.revenue - b.revenue) / b.revenue * 100 END AS yoy_pct
FROM m2 a LEFT JOIN m b
  ON b.month = strftime(strptime(a.month || '-01', '%Y-%m-%d') - INTERVAL 12 MONTH, '%Y-%m')
"""

SQL["ec_revenue_trend"] = MONTHLY + f"""
, r AS (SELECT revenue, row_number() OVER (ORDER BY month DESC) AS rn FROM m)
SELECT CASE WHEN (SELECT count(*) FROM r WHERE rn <= 3) < 3 THEN 'insufficient_data'
            WHEN l.v > f.v * 1.05 THEN 'up' WHEN l.v < f.v * 0.95 THEN 'down' ELSE 'flat' END AS trend,
       (SELECT coalesce(sum(total), 0.0) FROM {VALID}) AS total_revenue,
       (SELECT count(*) FROM {VALID}) AS total_orders
FROM (SELECT max(revenue) FILTER (WHERE rn = 1) AS v FROM r) l,
     (SELECT max(revenue) FILTER (WHERE rn = 3) AS v FROM r) f
"""

SQL["ec_ticket_stats"] = """
SELECT avg(total) AS overall_aov, quantile_cont(total, 0.5) AS median_aov
FROM ords WHERE total IS NOT NULL AND total > 0
"""

SQL["ec_ticket_histogram"] = """
SELECT bucket, (['$0-5K', '$5-10K', '$10-20K', '$20-50K', '$50-100K', '$100-200K', '$200K+'])[bucket + 1] AS range,
       count(*) AS count
FROM (SELECT CASE WHEN total < 5000 THEN 0 WHEN total < 10000 THEN 1 WHEN total < 20000 THEN 2
                  WHEN total < 50000 THEN 3 WHEN total < 100000 THEN 4 WHEN total < 200000 THEN 5 ELSE 6 END AS bucket
      FROM ords WHERE total IS NOT NULL AND total > 0)
GROUP BY bucket
"""

SQL["ec_ticket_monthly"] = """
SELECT strftime("date", '%Y-%m') AS month, avg(total) AS aov
FROM ords WHERE total IS NOT NULL AND total > 0 AND "date" IS NOT NULL GROUP BY 1
"""

SQL["ec_new_vs_returning"] = """
, o AS (SELECT * FROM ords WHERE total IS NOT NULL AND total > 0 AND email IS NOT NULL),
f AS (SELECT email, min("date") AS fd FROM o GROUP BY email)
SELECT coalesce(avg(total) FILTER (WHERE coalesce(o."date" = f.fd, false)), 0.0) AS new_aov,
       coalesce(avg(total) FILTER (WHERE NOT coalesce(o."date" = f.fd, false)), 0.0) AS returning_aov
FROM o JOIN f USING (email)
"""

SQL["ec_discount_impact"] = """
, o AS (SELECT * FROM ords WHERE total IS NOT NULL AND total > 0),
h AS (SELECT count(discount) > 0 AS has FROM o),
s AS (SELECT CASE WHEN (CASE WHEN (SELECT has FROM h) THEN coalesce(discount, 0) > 0
                             ELSE coalesce(coupon <> '', false) END)
                  THEN 'with_discount' ELSE 'without_discount' END AS segment, total FROM o),
a AS (SELECT segment, count(*) AS orders, avg(total) AS aov, sum(total) AS revenue FROM s GROUP BY segment)
SELECT seg.segment, coalesce(a.orders, 0) AS orders, coalesce(a.aov, 0.0) AS aov,
       coalesce(a.revenue, 0.0) AS revenue,
       CASE WHEN (SELECT count(*) FROM o) = 0 THEN 0.0
            ELSE coalesce(a.orders, 0) * 100.0 / (SELECT count(*) FROM o) END AS pct_orders,
       CASE WHEN (SELECT has FROM h) THEN (SELECT coalesce(sum(discount), 0.0) FROM o) ELSE 0.0 END AS total_discount
FROM (VALUES ('with_discount'), ('without_discount')) seg(segment) LEFT JOIN a USING (segment)
"""

SQL["ec_top_coupons"] = """
SELECT coupon, count(*) AS uses, sum(total) AS revenue, avg(total) AS aov
FROM ords WHERE total IS NOT NULL AND total > 0 AND coupon IS NOT NULL AND coupon <> ''
GROUP BY coupon ORDER BY revenue DESC, coupon LIMIT 10
"""

SQL["ec_payment_mix"] = """
, mix AS (SELECT payment_method, count(DISTINCT order_id) AS order_count, sum(total) AS revenue, avg(total) AS aov
          FROM ords WHERE payment_method IS NOT NULL AND payment_method <> '' GROUP BY 1)
SELECT *,
  CASE WHEN coalesce((SELECT sum(order_count) FROM mix), 0) = 0 THEN 0.0
       ELSE order_count * 100.0 / (SELECT sum(order_count) FROM mix) END AS pct_orders,
  CASE WHEN coalesce((SELECT sum(revenue) FROM mix), 0) = 0 THEN 0.0
       ELSE revenue * 100.0 / (SELECT sum(revenue) FROM mix) END AS pct_revenue
FROM mix
"""

SQL["ec_payment_mix_monthly"] = """
, o AS (SELECT * FROM ords WHERE payment_method IS NOT NULL AND payment_method <> ''),
t AS (SELECT payment_method FROM o GROUP BY 1 ORDER BY sum(total) DESC NULLS LAST, payment_method LIMIT 5)
SELECT strftime("date", '%Y-%m') AS month, payment_method, count(*) AS count
FROM o WHERE "date" IS NOT NULL AND payment_method IN (SELECT payment_method FROM t) GROUP BY 1, 2
"""

SQL["ec_season_month"] = f"""
SELECT CAST(month("date") AS INTEGER) AS month_num, ({MONTHS})[month("date")] AS month,
       sum(total) AS revenue, count(*) AS orders
FROM {VALID} GROUP BY 1, 2
"""

SQL["ec_season_dow"] = f"""
SELECT CAST(isodow("date") - 1 AS INTEGER) AS dow, ({DAYS})[isodow("date")] AS day,
       sum(total) AS revenue, count(*) AS orders
FROM {VALID} GROUP BY 1, 2
"""

SQL["ec_season_hour"] = f"""
SELECT CAST(hour("date") AS INTEGER) AS hour, sum(total) AS revenue, count(*) AS orders
FROM {VALID} AND (SELECT coalesce(sum(hour("date")), 0) FROM {VALID}) > 0
GROUP BY 1
"""

SQL["ec_season_peaks"] = f"""
, m AS (SELECT month("date") AS mn, sum(total) AS revenue FROM {VALID} GROUP BY 1),
d AS (SELECT isodow("date") - 1 AS dow, count(*) AS orders FROM {VALID} GROUP BY 1)
SELECT (SELECT ({MONTHS})[mn] FROM m ORDER BY revenue DESC, mn LIMIT 1) AS peak_month,
       (SELECT ({MONTHS})[mn] FROM m ORDER BY revenue ASC, mn LIMIT 1) AS low_month,
       (SELECT ({DAYS})[dow + 1] FROM d ORDER BY orders DESC, dow LIMIT 1) AS peak_day
"""

SQL["ec_revenue_by_channel"] = """
, chs AS (SELECT channel, sum(total) AS revenue, count(DISTINCT order_id) AS orders, avg(total) AS aov
         FROM ords WHERE channel IS NOT NULL AND channel <> '' GROUP BY 1)
SELECT *, CASE WHEN coalesce((SELECT sum(revenue) FROM chs), 0) = 0 THEN 0.0
               ELSE revenue * 100.0 / (SELECT sum(revenue) FROM chs) END AS pct
FROM chs WHERE (SELECT count(*) FROM chs) >= 2
"""

_SERIES = MONTHLY + """
, s AS (SELECT month, revenue, row_number() OVER (ORDER BY month) - 1 AS idx FROM m),
fit AS (SELECT count(*) AS n, sum(CAST(idx AS DOUBLE)) AS sx, sum(revenue) AS sy,
               sum(idx * revenue) AS sxy, sum(CAST(idx AS DOUBLE) * idx) AS sxx, max(month) AS last_month FROM s),
coef AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS m FROM fit WHERE n >= 6),
coef2 AS (SELECT *, (sy - m * sx) / n AS b FROM coef)"""

SQL["ec_forecast"] = _SERIES + """
, sd AS (SELECT stddev_pop(revenue - (c.m * idx + c.b)) AS sd FROM s, coef2 c),
hist AS (SELECT list(revenue ORDER BY idx) AS h FROM (SELECT * FROM s ORDER BY idx DESC LIMIT 3)),
rec AS (
  SELECT 0 AS i, CAST([] AS DOUBLE[]) AS acc
  UNION ALL
  SELECT i + 1, list_append(acc, round((greatest(c.m * (c.n - 1 + i + 1) + c.b, 0.0)
         + list_sum(list_concat(h.h, acc)[-3:]) / len(list_concat(h.h, acc)[-3:])) / 2, 2))
  FROM rec, coef2 c, hist h WHERE i < 6
)
SELECT strftime(strptime(c.last_month || '-01', '%Y-%m-%d') + to_months(CAST(k AS INTEGER)), '%Y-%m') AS month,
       r.acc[k] AS predicted,
       greatest(r.acc[k] - (SELECT sd FROM sd), 0.0) AS lower,
       r.acc[k] + (SELECT sd FROM sd) AS upper
FROM (SELECT acc FROM rec WHERE i = 6) r, coef2 c, range(1, 7) t(k)
"""

SQL["ec_forecast_history"] = _SERIES + """
SELECT s.month, s.revenue, c.m AS trend_slope,
       CASE WHEN c.m > 0 THEN 'up' WHEN c.m < 0 THEN 'down' ELSE 'flat' END AS trend_direction
FROM s, coef2 c WHERE s.idx >= (SELECT max(idx) FROM s) - 11
"""

RECURSIVE = {"ec_forecast"}

SQL["op_orders_from_lines"] = """
SELECT order_id, email, "date", order_status, payment_status, total, discount, shipping_cost, state, city,
       country, shipping_method, payment_method, coupon, channel, cancellation_date, cancellation_reason,
       customer_name, payment_date, shipping_date
FROM ords
"""

SQL["ec_summary"] = """
, v AS (SELECT * FROM ords WHERE total IS NOT NULL AND total > 0),
b AS (SELECT max("date") AS dmax, min("date") AS dmin, count(*) AS nrows FROM lines),
f AS (SELECT v.*, v."date" >= b.dmax - INTERVAL 3 MONTH AS rec,
             (v."date" < b.dmax - INTERVAL 3 MONTH AND v."date" >= (b.dmax - INTERVAL 3 MONTH) - INTERVAL 3 MONTH) AS pri
      FROM v, b),
a AS (SELECT coalesce(sum(total), 0.0) AS total_revenue, count(*) AS total_orders,
             count(DISTINCT email) AS unique_customers, avg(total) AS avg_ticket,
             coalesce(sum(total) FILTER (WHERE rec), 0.0) AS r_rev, coalesce(sum(total) FILTER (WHERE pri), 0.0) AS p_rev,
             count(*) FILTER (WHERE rec) AS r_n, count(*) FILTER (WHERE pri) AS p_n,
             count(DISTINCT email) FILTER (WHERE rec) AS r_c, count(DISTINCT email) FILTER (WHERE pri) AS p_c,
             coalesce(avg(total) FILTER (WHERE rec), 0.0) AS r_t, coalesce(avg(total) FILTER (WHERE pri), 0.0) AS p_t
      FROM f)
SELECT total_revenue, total_orders, unique_customers, avg_ticket,
       CAST(b.dmin AS DATE) AS date_min, CAST(b.dmax AS DATE) AS date_max,
       CASE WHEN p_rev > 0 THEN (r_rev - p_rev) / p_rev * 100 END AS revenue_change_pct,
       CASE WHEN p_n > 0 THEN (r_n - p_n) / p_n * 100 END AS orders_change_pct,
       CASE WHEN p_c > 0 THEN (r_c - p_c) / p_c * 100 END AS customers_change_pct,
       CASE WHEN p_t > 0 THEN (r_t - p_t) / p_t * 100 END AS ticket_change_pct,
       b.nrows AS total_rows
FROM a, b
"""


def _qbin(col: str, q: int, rank_col: str, edges_col: str, n_col: str, reverse: bool = False) -> str:
    """SQL for pandas qcut bins: compare with exact edges when they are distinct, else bin the rank."""
    distinct = " AND ".join(f"{edges_col}[{i}] < {edges_col}[{i + 1}]" for i in range(1, q + 1))
    by_edges = "1 + " + " + ".join(f"CAST({col} > {edges_col}[{i}] AS INTEGER)" for i in range(2, q + 1))
    by_rank = f"greatest(1, CAST(ceil({q} * ({rank_col} - 1) / greatest({n_col} - 1, 1)) AS INTEGER))"
    b = f"CAST(CASE WHEN {distinct} THEN {by_edges} ELSE {by_rank} END AS INTEGER)"
    return f"({q + 1} - {b})" if reverse else b


def _fracs(q: int) -> str:
    return "[" + ", ".join(str(i / q) for i in range(q + 1)) + "]"


SEGMENT = """CASE WHEN recency_score >= 4 AND frequency_score >= 4 AND monetary_score >= 4 THEN 'Champions'
     WHEN recency_score >= 3 AND frequency_score >= 3 AND monetary_score >= 3 THEN 'Loyal'
     WHEN recency_score >= 3 AND frequency_score <= 2 THEN 'Potential Loyal'
     WHEN recency_score >= 4 AND frequency_score = 1 THEN 'New'
     WHEN recency_score = 3 AND frequency_score = 1 THEN 'Promising'
     WHEN recency_score = 2 AND frequency_score >= 2 AND frequency_score <= 3 THEN 'Need Attention'
     WHEN recency_score = 2 AND frequency_score >= 1 AND frequency_score <= 2 THEN 'About to Sleep'
     WHEN recency_score <= 2 AND frequency_score >= 3 THEN 'At Risk'
     WHEN recency_score = 1 AND frequency_score >= 4 THEN 'Can''t Lose'
     WHEN recency_score <= 2 AND frequency_score <= 2 AND monetary_score <= 2 THEN 'Hibernating'
     WHEN recency_score = 1 AND frequency_score = 1 THEN 'Lost'
     ELSE 'Other' END"""

DAYS_BETWEEN = "CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000.0) AS BIGINT)"

RFM = f"""
, o AS (SELECT * FROM ords WHERE email IS NOT NULL AND email <> '' AND "date" IS NOT NULL
                               AND total IS NOT NULL AND total > 0),
ref AS (SELECT max("date") + INTERVAL 1 DAY AS r FROM o),
c AS (SELECT email, {DAYS_BETWEEN.format(a='max("date")', b='(SELECT r FROM ref)')} AS recency,
             count(DISTINCT order_id) AS frequency, sum(total) AS monetary
      FROM o GROUP BY email),
e AS (SELECT quantile_cont(recency, {_fracs(5)}) AS er, quantile_cont(frequency, {_fracs(5)}) AS ef,
             quantile_cont(monetary, {_fracs(5)}) AS em, count(*) AS n FROM c),
rk AS (SELECT email, row_number() OVER (ORDER BY recency, email) AS rr,
              row_number() OVER (ORDER BY frequency, email) AS rf,
              row_number() OVER (ORDER BY monetary, email) AS rm FROM c),
sc AS (SELECT c.*, {_qbin('recency', 5, 'rr', 'er', 'n', reverse=True)} AS recency_score,
              {_qbin('frequency', 5, 'rf', 'ef', 'n')} AS frequency_score,
              {_qbin('monetary', 5, 'rm', 'em', 'n')} AS monetary_score
       FROM c JOIN rk USING (email), e
       WHERE (SELECT count(*) FROM o) >= 50),
rfm AS (SELECT *, {SEGMENT} AS segment FROM sc)"""

SQL["ec_rfm_scores"] = RFM + """
SELECT email, recency, frequency, monetary, recency_score, frequency_score, monetary_score, segment FROM rfm
"""

SQL["ec_rfm_segments"] = RFM + """
SELECT segment, count(*) AS count, avg(recency) AS avg_recency, avg(frequency) AS avg_frequency,
       avg(monetary) AS avg_monetary, count(*) * 100.0 / (SELECT count(*) FROM rfm) AS pct
FROM rfm GROUP BY segment
"""

CLV = f"""
, o AS (SELECT * FROM ords WHERE email IS NOT NULL AND "date" IS NOT NULL AND total > 0),
c0 AS (SELECT email, sum(total) AS total_revenue, count(DISTINCT order_id) AS order_count,
              min("date") AS f, max("date") AS l FROM o GROUP BY email),
c1 AS (SELECT *, total_revenue / order_count AS aov, {DAYS_BETWEEN.format(a='f', b='l')} AS lifespan_days FROM c0),
c2 AS (SELECT *, CASE WHEN order_count > 1 THEN lifespan_days / (order_count - 1) END AS avg_days_between FROM c1),
cl AS (SELECT *, aov * (CASE WHEN avg_days_between IS NOT NULL AND avg_days_between > 0 THEN 365 / avg_days_between
                             ELSE CAST(order_count AS DOUBLE) END) * 3 AS clv_3y FROM c2)"""

SQL["ec_clv"] = CLV + """
SELECT count(*) AS total_customers, avg(clv_3y) AS avg_clv, quantile_cont(clv_3y, 0.5) AS median_clv,
       avg(aov) AS avg_aov, avg(order_count) AS avg_orders, avg(lifespan_days) AS avg_lifespan_days FROM cl
"""

SQL["ec_clv_top"] = CLV + """
SELECT email, total_revenue, order_count, aov, clv_3y FROM cl ORDER BY clv_3y DESC, email LIMIT 10
"""

SQL["ec_clv_quartiles"] = CLV + f"""
, e AS (SELECT quantile_cont(clv_3y, {_fracs(4)}) AS ec, count(*) AS n FROM cl),
rk AS (SELECT email, row_number() OVER (ORDER BY clv_3y, email) AS rc FROM cl),
b AS (SELECT cl.*, {_qbin('clv_3y', 4, 'rc', 'ec', 'n')} AS qb FROM cl JOIN rk USING (email), e)
SELECT (['Low', 'Medium', 'High', 'Very High'])[qb] AS clv_quartile, count(*) AS count, avg(clv_3y) AS avg_clv,
       avg(aov) AS avg_aov, avg(order_count) AS avg_orders
FROM b GROUP BY qb
"""

COHORT = """
, om AS (SELECT email, CAST(date_trunc('month', "date") AS DATE) AS m FROM ords
         WHERE email IS NOT NULL AND "date" IS NOT NULL GROUP BY 1, 2),
fc AS (SELECT email, min(m) AS cohort FROM om GROUP BY email),
cnt AS (SELECT cohort, CAST((year(m) - year(cohort)) * 12 + month(m) - month(cohort) AS INTEGER) AS months_since,
               count(*) AS customers FROM om JOIN fc USING (email) GROUP BY 1, 2),
sz AS (SELECT cohort, customers AS cohort_size FROM cnt WHERE months_since = 0 ORDER BY cohort DESC LIMIT 12),
pr AS (SELECT DISTINCT months_since FROM cnt WHERE months_since <= 12),
cm AS (SELECT strftime(g.cohort, '%Y-%m') AS cohort, g.months_since, coalesce(c.customers, 0) AS customers,
              g.cohort_size, coalesce(c.customers, 0) * 100.0 / g.cohort_size AS retention_pct
       FROM (SELECT sz.cohort, sz.cohort_size, pr.months_since FROM sz, pr) g
       LEFT JOIN cnt c ON c.cohort = g.cohort AND c.months_since = g.months_since)"""

SQL["ec_cohort_matrix"] = COHORT + "\nSELECT * FROM cm\n"
SQL["ec_cohort_curve"] = COHORT + "\nSELECT months_since, avg(retention_pct) AS avg_retention_pct FROM cm GROUP BY 1\n"

COUNTS = """
, c AS (SELECT email, count(DISTINCT order_id) AS order_count FROM ords
        WHERE email IS NOT NULL AND "date" IS NOT NULL GROUP BY email)"""

SQL["ec_repurchase"] = COUNTS + """
SELECT count(*) AS total_customers, count(*) FILTER (WHERE order_count >= 2) AS repeat_customers,
       CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE order_count >= 2) * 100.0 / count(*) END
         AS repurchase_rate
FROM c
"""

SQL["ec_order_count_distribution"] = COUNTS + """
SELECT order_count AS orders, count(*) AS customers FROM c GROUP BY 1
"""

SQL["ec_purchase_gaps"] = f"""
, d AS (SELECT DISTINCT email, "date" FROM ords WHERE email IS NOT NULL AND "date" IS NOT NULL),
g AS (SELECT {DAYS_BETWEEN.format(a='lag("date") OVER (PARTITION BY email ORDER BY "date")', b='"date"')} AS gap FROM d),
gg AS (SELECT gap FROM g WHERE gap > 0)
SELECT quantile_cont(gap, 0.5) AS median_days, avg(gap) AS mean_days,
       quantile_cont(gap, 0.25) AS p25_days, quantile_cont(gap, 0.75) AS p75_days FROM gg
"""

UPG = """
, o AS (SELECT email, "date", order_id, total FROM ords WHERE email IS NOT NULL AND "date" IS NOT NULL AND total > 0),
p AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY "date", order_id) AS pos,
             count(*) OVER (PARTITION BY email) AS n FROM o),
u AS (SELECT email, avg(total) FILTER (WHERE pos <= n // 2) AS first_half_aov,
             avg(total) FILTER (WHERE pos > n // 2) AS second_half_aov FROM p WHERE n >= 3 GROUP BY email),
uu AS (SELECT *, (second_half_aov - first_half_aov) / first_half_aov * 100 AS change_pct FROM u WHERE first_half_aov > 0)"""

SQL["ec_upgrade_pattern"] = UPG + """
SELECT count(*) AS total_analyzed, count(*) FILTER (WHERE change_pct > 20) AS upgraders,
       CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE change_pct > 20) * 100.0 / count(*) END AS upgrader_pct,
       count(*) FILTER (WHERE change_pct < -20) AS downgraders,
       coalesce(avg(change_pct) FILTER (WHERE change_pct > 20), 0.0) AS avg_upgrade_pct
FROM uu
"""

SQL["ec_top_upgraders"] = UPG + """
SELECT email, first_half_aov, second_half_aov, change_pct FROM uu WHERE change_pct > 20
ORDER BY change_pct DESC, email LIMIT 10
"""

VIP = """
, o AS (SELECT * FROM ords WHERE email IS NOT NULL AND total > 0),
c AS (SELECT email, sum(total) AS revenue, count(DISTINCT order_id) AS orders, avg(total) AS aov FROM o GROUP BY email),
v AS (SELECT * FROM c WHERE revenue >= (SELECT quantile_cont(revenue, 0.9) FROM c))"""

SQL["ec_vip_customers"] = VIP + "\nSELECT * FROM v ORDER BY revenue DESC, email LIMIT 15\n"
SQL["ec_vip_summary"] = VIP + """
SELECT count(*) AS vip_count, count(*) * 100.0 / (SELECT count(*) FROM c) AS vip_pct, sum(revenue) AS vip_revenue,
       sum(revenue) * 100.0 / (SELECT sum(revenue) FROM c) AS vip_revenue_pct,
       avg(orders) AS avg_orders, avg(aov) AS avg_aov FROM v
"""
SQL["ec_vip_products"] = VIP + """
SELECT product_name, count(*) AS count FROM lines
WHERE product_name IS NOT NULL AND email IN (SELECT email FROM v)
GROUP BY 1 ORDER BY count DESC, product_name LIMIT 10
"""
SQL["ec_vip_states"] = VIP + """
SELECT state, count(*) AS count FROM o WHERE state IS NOT NULL AND email IN (SELECT email FROM v)
GROUP BY 1 ORDER BY count DESC, state LIMIT 10
"""

CHURN = f"""
, o AS (SELECT * FROM ords WHERE email IS NOT NULL AND "date" IS NOT NULL),
c AS (SELECT email, count(DISTINCT order_id) AS order_count, max("date") AS l, min("date") AS f FROM o GROUP BY email),
iv AS (SELECT coalesce((SELECT quantile_cont({DAYS_BETWEEN.format(a='f', b='l')} / (order_count - 1), 0.5)
                        FROM c WHERE order_count >= 2), 90.0) AS ivl),
th AS (SELECT ivl, greatest(ivl * 2, 60.0) AS threshold FROM iv),
cc AS (SELECT c.*, {DAYS_BETWEEN.format(a='l', b='(SELECT max("date") FROM o)')} > (SELECT threshold FROM th) AS is_churned
       FROM c)"""

SQL["ec_churn"] = CHURN + """
SELECT count(*) AS total_customers, count(*) FILTER (WHERE is_churned) AS churned,
       CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE is_churned) * 100.0 / count(*) END AS churn_rate,
       count(*) FILTER (WHERE NOT is_churned) AS active,
       (SELECT threshold FROM th) AS churn_threshold_days, (SELECT ivl FROM th) AS avg_purchase_interval
FROM cc
"""
SQL["ec_churn_products"] = CHURN + """
SELECT product_name, count(*) AS count FROM lines
WHERE product_name IS NOT NULL AND email IN (SELECT email FROM cc WHERE is_churned)
GROUP BY 1 ORDER BY count DESC, product_name LIMIT 10
"""

# ------------------------------------------------------------------ name rules in SQL
BASE = ("trim(split_part(trim(regexp_replace(trim(product_name), '\\s*\\([^)]*\\)\\s*$', '')), ' - ', 1))")
CATEGORY = """(CASE WHEN product_name IS NULL THEN 'Sin categoría'
     WHEN instr(trim(product_name), ' - ') > 0 THEN trim(split_part(trim(product_name), ' - ', 1))
     WHEN instr(trim(product_name), ' | ') > 0 THEN trim(split_part(trim(product_name), ' | ', 1))
     WHEN instr(trim(product_name), ' / ') > 0 THEN trim(split_part(trim(product_name), ' / ', 1))
     WHEN regexp_extract(trim(product_name), '^(\\S+)', 1) <> '' THEN regexp_extract(trim(product_name), '^(\\S+)', 1)
     ELSE 'Sin categoría' END)"""
VARIANT_BASE = """(CASE WHEN instr(product_name, ' - ') > 0 THEN trim(split_part(product_name, ' - ', 1))
     WHEN instr(product_name, ' | ') > 0 THEN trim(split_part(product_name, ' | ', 1))
     WHEN instr(product_name, ' / ') > 0 THEN trim(split_part(product_name, ' / ', 1))
     ELSE trim(product_name) END)"""
_COLOURS = ("['negro','blanco','rojo','azul','verde','rosa','gris','beige','marrón','marron','celeste','naranja',"
            "'violeta','bordo','crudo','natural','nude','camel','coral','fucsia','lila','mostaza','terracota',"
            "'turquesa','dorado','plateado','chocolate','arena','hueso','salmón','salmon','oliva','tostado','aqua',"
            "'ivory','black','white','red','blue','green','pink','grey','gray','brown','orange','purple','yellow',"
            "'gold','silver']")
_SIZES = ("['xxs','xs','s','m','l','xl','xxl','xxxl','2xl','3xl','unico','único','u','os','one size','free size',"
          "'34','35','36','37','38','39','40','41','42','43','44','45','46','28','29','30','31','32','33']")
_COLOR_HIT = f"list_filter({_COLOURS}, lambda c: list_contains(string_split_regex(lower(product_name), '\\s+'), c))[1]"
COLOR = f"(upper(({_COLOR_HIT})[1]) || lower(({_COLOR_HIT})[2:]))"
SIZE = (f"upper(list_filter(string_split_regex(trim(regexp_replace(lower(concat_ws(' ', product_name, sku)), "
        f"'[-/]', ' ', 'g')), '\\s+'), lambda t: list_contains({_SIZES}, t))[1])")
REV = "coalesce(product_price, 0.0) * coalesce(product_qty, 1)"
CANC3 = "coalesce(order_status IN ('cancelled', 'Cancelada', 'cancelada'), false)"

RECENT = """
, mx AS (SELECT max("date") AS d FROM l),
f AS (SELECT l.*, l."date" >= mx.d - INTERVAL 3 MONTH AS rec,
             (l."date" < mx.d - INTERVAL 3 MONTH AND l."date" >= (mx.d - INTERVAL 3 MONTH) - INTERVAL 3 MONTH) AS pri
      FROM l, mx)"""
TREND = """CASE WHEN coalesce(sum(rev) FILTER (WHERE pri), 0) > 0
            THEN (coalesce(sum(rev) FILTER (WHERE rec), 0) - sum(rev) FILTER (WHERE pri)) / sum(rev) FILTER (WHERE pri) * 100
            WHEN coalesce(sum(rev) FILTER (WHERE rec), 0) > 0 THEN 100.0 ELSE 0.0 END"""

SQL["ec_product_ranking"] = f"""
, l AS (SELECT *, {REV} AS rev FROM lines WHERE product_name IS NOT NULL){RECENT}
SELECT product_name, sum(rev) AS revenue, CAST(coalesce(sum(product_qty), 0) AS BIGINT) AS units,
       count(DISTINCT order_id) AS orders, avg(product_price) AS avg_price, {TREND} AS trend_pct,
       (SELECT count(DISTINCT product_name) FROM l) AS total_products
FROM f GROUP BY product_name ORDER BY revenue DESC, product_name LIMIT 30
"""

SQL["ec_anchor_products"] = """
, it AS (SELECT DISTINCT order_id, trim(product_name) AS item FROM lines WHERE product_name IS NOT NULL AND order_id IS NOT NULL),
mo AS (SELECT order_id FROM it GROUP BY order_id HAVING count(*) >= 2),
m AS (SELECT * FROM it WHERE order_id IN (SELECT order_id FROM mo)),
cnt AS (SELECT item, count(*) AS multi_order_count FROM m GROUP BY item ORDER BY multi_order_count DESC, item LIMIT 20),
comp AS (SELECT a.item AS anchor, b.item AS companion, count(*) AS companion_count
         FROM m a JOIN m b ON a.order_id = b.order_id AND a.item <> b.item
         WHERE a.item IN (SELECT item FROM cnt) GROUP BY 1, 2),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY anchor ORDER BY companion_count DESC, companion) AS INTEGER)
              AS companion_rank FROM comp)
SELECT cnt.item AS product, cnt.multi_order_count, rk.companion, rk.companion_count, rk.companion_rank
FROM cnt JOIN rk ON rk.anchor = cnt.item WHERE rk.companion_rank <= 5 AND (SELECT count(*) FROM mo) >= 10
"""

SQL["ec_pareto"] = f"""
, l AS (SELECT product_name, sum({REV}) AS revenue FROM lines WHERE product_name IS NOT NULL GROUP BY 1),
t AS (SELECT sum(revenue) AS tot, count(*) AS n FROM l),
c AS (SELECT *, sum(revenue) OVER (ORDER BY revenue DESC, product_name ROWS UNBOUNDED PRECEDING)
                / (SELECT tot FROM t) * 100 AS cumulative_pct FROM l),
p80 AS (SELECT least(count(*) FILTER (WHERE cumulative_pct <= 80) + 1, (SELECT n FROM t)) AS k FROM c)
SELECT product_name, revenue, revenue / (SELECT tot FROM t) * 100 AS pct_of_total, cumulative_pct,
       (SELECT n FROM t) AS total_products, (SELECT k FROM p80) AS products_80_pct,
       (SELECT k FROM p80) * 100.0 / (SELECT n FROM t) AS pct_products_80
FROM c WHERE (SELECT tot FROM t) > 0 ORDER BY revenue DESC, product_name LIMIT 30
"""

SQL["ec_cancel_by_product"] = f"""
, l AS (SELECT *, CAST({CANC3} AS INTEGER) AS c FROM lines WHERE product_name IS NOT NULL),
o AS (SELECT avg(c) AS r FROM l),
g AS (SELECT product_name, count(DISTINCT order_id) AS total_orders, CAST(sum(c) AS BIGINT) AS cancelled FROM l GROUP BY 1)
SELECT product_name, total_orders, cancelled, cancelled / total_orders AS cancel_rate, (SELECT r FROM o) AS overall_rate
FROM g WHERE cancelled / total_orders > (SELECT r FROM o) * 1.2 AND total_orders >= 5
ORDER BY cancel_rate DESC, product_name LIMIT 15
"""

SQL["ec_revenue_by_category"] = f"""
, l AS (SELECT *, {CATEGORY} AS category, {REV} AS rev FROM lines WHERE product_name IS NOT NULL){RECENT},
g AS (SELECT category, sum(rev) AS revenue, CAST(coalesce(sum(product_qty), 0) AS BIGINT) AS units,
             count(DISTINCT product_name) AS products, {TREND} AS trend_pct FROM f GROUP BY 1)
SELECT category, revenue, units, products,
       CASE WHEN (SELECT sum(revenue) FROM g) > 0 THEN revenue / (SELECT sum(revenue) FROM g) * 100 ELSE 0.0 END AS pct,
       trend_pct
FROM g ORDER BY revenue DESC, category LIMIT 20
"""

SQL["ec_category_distribution"] = f"""
SELECT {CATEGORY} AS category, sum({REV}) AS revenue FROM lines GROUP BY 1 ORDER BY revenue DESC, category LIMIT 15
"""

COLOR_LINES = f"""
, cl AS (SELECT * FROM (SELECT *, {COLOR} AS color FROM lines WHERE product_name IS NOT NULL) WHERE color IS NOT NULL)"""

SQL["ec_color_distribution"] = COLOR_LINES + """
SELECT color, count(*) AS count FROM cl WHERE (SELECT count(*) FROM cl) >= 50
GROUP BY color ORDER BY count DESC, color LIMIT 20
"""

SQL["ec_color_pairs"] = COLOR_LINES + """
, ob AS (SELECT DISTINCT order_id, color FROM cl WHERE order_id IS NOT NULL),
mo AS (SELECT order_id FROM ob GROUP BY 1 HAVING count(*) >= 2)
SELECT a.color AS color_a, b.color AS color_b, count(*) AS count
FROM ob a JOIN ob b ON a.order_id = b.order_id AND a.color < b.color
WHERE (SELECT count(*) FROM cl) >= 50 AND (SELECT count(*) FROM mo) >= 5
GROUP BY 1, 2 ORDER BY count DESC, color_a, color_b LIMIT 15
"""

SIZE_LINES = f"""
, sl AS (SELECT * FROM (SELECT *, {SIZE} AS size FROM lines WHERE product_name IS NOT NULL) WHERE size IS NOT NULL)"""

SQL["ec_size_distribution"] = SIZE_LINES + """
SELECT size, count(*) AS count FROM sl WHERE (SELECT count(*) FROM sl) >= 50 GROUP BY size
"""

SQL["ec_multi_size_customers"] = SIZE_LINES + """
, per AS (SELECT email, count(DISTINCT size) AS k FROM sl WHERE email IS NOT NULL GROUP BY email),
a AS (SELECT count(*) FILTER (WHERE k >= 2) AS customers_multi_size, count(*) AS alln FROM per)
SELECT customers_multi_size, customers_multi_size * 100.0 / alln AS pct_multi_size FROM a
WHERE customers_multi_size > 0 AND (SELECT count(*) FROM sl) >= 50
"""

SQL["ec_sku_variants"] = f"""
, l AS (SELECT * FROM lines WHERE sku IS NOT NULL AND sku <> '' AND product_name IS NOT NULL),
v AS (SELECT {VARIANT_BASE} AS base, sku, sum({REV}) AS revenue, CAST(coalesce(sum(product_qty), 0) AS BIGINT) AS units,
             avg(product_price) AS avg_price FROM l GROUP BY 1, 2),
b AS (SELECT base FROM v GROUP BY base HAVING count(*) >= 2)
SELECT v.*, CAST(row_number() OVER (PARTITION BY v.base ORDER BY revenue DESC, sku) AS INTEGER) AS variant_rank
FROM v WHERE base IN (SELECT base FROM b) AND (SELECT count(*) FROM l) >= 20
"""

LIFECYCLE = f"""
, l AS (SELECT * FROM lines WHERE product_name IS NOT NULL AND "date" IS NOT NULL),
mon AS (SELECT product_name, date_trunc('month', "date") AS m, sum({REV}) AS rev FROM l GROUP BY 1, 2),
el AS (SELECT product_name, count(*) AS months_active FROM mon GROUP BY 1 HAVING count(*) >= 6),
s AS (SELECT mon.*, el.months_active, row_number() OVER (PARTITION BY mon.product_name ORDER BY m) AS rn
      FROM mon JOIN el USING (product_name)),
a AS (SELECT product_name, months_active, sum(rev) AS total_revenue, avg(rev) FILTER (WHERE rn <= 3) AS e,
             avg(rev) FILTER (WHERE rn > months_active - 3) AS r,
             avg(rev) FILTER (WHERE rn > months_active // 3 AND rn <= (2 * months_active) // 3) AS mid
      FROM s GROUP BY 1, 2),
lc AS (SELECT product_name,
              CASE WHEN r > mid * 1.1 AND r > e THEN 'Growth' WHEN r < mid * 0.8 THEN 'Decline'
                   WHEN r > e * 1.5 THEN 'Growth'
                   WHEN (CASE WHEN mid > 0 THEN abs(r - mid) / mid < 0.15 ELSE true END) THEN 'Maturity'
                   ELSE 'Introduction' END AS stage, months_active, total_revenue FROM a)"""

SQL["ec_product_lifecycle"] = LIFECYCLE + "\nSELECT * FROM lc\n"
SQL["ec_lifecycle_stages"] = LIFECYCLE + "\nSELECT stage, count(*) AS count FROM lc GROUP BY stage\n"

PRICED = "\n, pp AS (SELECT * FROM lines WHERE product_price IS NOT NULL AND product_price > 0)"

SQL["ec_price_stats"] = PRICED + """
SELECT * FROM (SELECT min(product_price) AS min_price, max(product_price) AS max_price, avg(product_price) AS mean_price,
                      quantile_cont(product_price, 0.5) AS median_price, count(*) AS total_items FROM pp)
WHERE total_items >= 20
"""

SQL["ec_price_sweet_spots"] = PRICED + """
, pst AS (SELECT min(product_price) AS lo, max(product_price) AS hi, count(*) AS n FROM pp),
b AS (SELECT CAST(len(list_filter(range(1, 20), lambda k: pp.product_price > CAST(k AS DOUBLE) * ((pst.hi - pst.lo) / 20.0) + pst.lo))
                  AS INTEGER) AS bin, product_qty FROM pp, pst),
v AS (SELECT bin, CAST(coalesce(sum(product_qty), 0) AS BIGINT) AS volume FROM b GROUP BY bin)
SELECT bin, CASE WHEN bin = 0 THEN lo - (hi - lo) * 0.001 ELSE CAST(bin AS DOUBLE) * ((hi - lo) / 20.0) + lo END AS bin_left,
       CASE WHEN bin = 19 THEN hi ELSE CAST(bin + 1 AS DOUBLE) * ((hi - lo) / 20.0) + lo END AS bin_right, volume
FROM v, pst WHERE n >= 20 ORDER BY volume DESC, bin LIMIT 5
"""

CATPRICE = f"""
, l AS (SELECT *, {CATEGORY} AS category FROM lines WHERE product_name IS NOT NULL AND product_price > 0),
g AS (SELECT category, avg(product_price) AS avg_price, quantile_cont(product_price, 0.5) AS median_price,
             sum(product_price * product_qty) / sum(product_qty) AS weighted_price,
             count(DISTINCT product_name) AS product_count FROM l GROUP BY 1 HAVING count(*) >= 5),
top AS (SELECT * FROM g ORDER BY product_count DESC, category LIMIT 15),
pr AS (SELECT l.category, l.product_name, top.weighted_price, avg(l.product_price) AS avg_price,
              CAST(coalesce(sum(l.product_qty), 0) AS BIGINT) AS units
       FROM l JOIN top USING (category) GROUP BY 1, 2, 3)"""

SQL["ec_category_pricing"] = CATPRICE + "\nSELECT category, avg_price, median_price, weighted_price, product_count FROM top\n"
SQL["ec_underpriced"] = CATPRICE + """
SELECT category, product_name, avg_price, units FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY units DESC, product_name) AS r
  FROM pr WHERE avg_price < weighted_price * 0.7) WHERE r <= 3
"""
SQL["ec_overpriced"] = CATPRICE + """
SELECT category, product_name, avg_price, units FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY units ASC, product_name) AS r
  FROM pr WHERE avg_price > weighted_price * 1.5) WHERE r <= 3
"""

# ------------------------------------------------------------------ baskets (plain self-joins in the oracle)


def _basket_base(item: str, where: str = "product_name IS NOT NULL AND ") -> str:
    return f"""
, it AS (SELECT DISTINCT order_id, {item} AS item FROM lines WHERE {where}order_id IS NOT NULL),
ob AS (SELECT order_id, count(*) AS k FROM it GROUP BY 1),
tot AS (SELECT count(*) AS n, count(*) FILTER (WHERE k >= 2) AS multi FROM ob),
fr AS (SELECT item, count(*) AS f FROM it GROUP BY 1),
ms AS (SELECT CASE WHEN n > 1000 THEN 0.003 ELSE 0.01 END AS s, n FROM tot),
pc AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS cnt
       FROM it a JOIN it b ON a.order_id = b.order_id AND a.item < b.item GROUP BY 1, 2)"""


PAIRS = _basket_base(BASE) + """
, pt AS (SELECT * FROM pc),
pm AS (SELECT pt.item_a, pt.item_b, pt.cnt AS count, pt.cnt / ms.n * 100 AS support,
              greatest(pt.cnt / fa.f, pt.cnt / fb.f) * 100 AS confidence,
              (pt.cnt / ms.n) / ((fa.f / ms.n) * (fb.f / ms.n)) AS lift
       FROM pt, ms, fr fa, fr fb WHERE fa.item = pt.item_a AND fb.item = pt.item_b AND pt.cnt / ms.n >= ms.s),
lifted AS (SELECT * FROM pm WHERE lift > 1.0 AND (SELECT multi FROM tot) >= 10),
pairs AS (SELECT * FROM lifted ORDER BY round(lift, 2) DESC, count DESC, item_a, item_b LIMIT 30),
pr AS (SELECT *, CAST(row_number() OVER (ORDER BY round(lift, 2) DESC, count DESC, item_a, item_b) AS INTEGER) AS rank
       FROM pairs)"""

SQL["ec_basket_pairs"] = PAIRS + "\nSELECT item_a, item_b, count, support, confidence, lift, rank FROM pr\n"

TYPE_ITEM = "trim(string_split(product_name, ' - ')[-1])"
SQL["ec_basket_trios"] = _basket_base(TYPE_ITEM) + """
, tc AS (SELECT a.item AS item_a, b.item AS item_b, c.item AS item_c, count(*) AS cnt
         FROM it a JOIN it b ON a.order_id = b.order_id AND a.item < b.item
                   JOIN it c ON c.order_id = a.order_id AND b.item < c.item GROUP BY 1, 2, 3),
tt AS (SELECT * FROM tc),
tm AS (SELECT tt.item_a, tt.item_b, tt.item_c, tt.cnt AS count, tt.cnt / ms.n * 100 AS support,
              (tt.cnt / ms.n) / ((fa.f / ms.n) * (fb.f / ms.n) * (fc.f / ms.n)) AS lift
       FROM tt, ms, fr fa, fr fb, fr fc
       WHERE fa.item = tt.item_a AND fb.item = tt.item_b AND fc.item = tt.item_c AND tt.cnt / ms.n >= ms.s * 0.5)
SELECT *, CAST(row_number() OVER (ORDER BY round(lift, 2) DESC, count DESC, item_a, item_b, item_c) AS INTEGER) AS rank
FROM (SELECT * FROM tm WHERE lift > 0 ORDER BY round(lift, 2) DESC, count DESC, item_a, item_b, item_c LIMIT 15)
WHERE (SELECT multi FROM tot) >= 10
"""

SQL["ec_basket_summary"] = _basket_base(BASE) + """
SELECT n AS total_orders, multi AS multi_product_orders,
       CASE WHEN n > 0 THEN multi * 100.0 / n ELSE 0.0 END AS multi_product_pct FROM tot
"""

SQL["ec_category_affinity"] = _basket_base(CATEGORY, where="") + """
, pt AS (SELECT * FROM pc),
pm AS (SELECT pt.item_a AS category_a, pt.item_b AS category_b, pt.cnt AS count, pt.cnt / ms.n * 100 AS support,
              (pt.cnt / ms.n) / ((fa.f / ms.n) * (fb.f / ms.n)) AS lift
       FROM pt, ms, fr fa, fr fb WHERE fa.item = pt.item_a AND fb.item = pt.item_b)
SELECT *, CAST(row_number() OVER (ORDER BY round(lift, 2) DESC, count DESC, category_a, category_b) AS INTEGER) AS rank
FROM (SELECT * FROM pm ORDER BY round(lift, 2) DESC, count DESC, category_a, category_b LIMIT 20)
WHERE (SELECT multi FROM tot) >= 5
"""

SQL["ec_bundles"] = PAIRS + f"""
, pz AS (SELECT {BASE} AS b, avg(product_price) AS p FROM lines
         WHERE product_name IS NOT NULL AND product_price IS NOT NULL GROUP BY 1),
bt AS (SELECT pr.*, coalesce(pa.p, 0.0) + coalesce(pb.p, 0.0) AS tot FROM pr
       LEFT JOIN pz pa ON pa.b = pr.item_a LEFT JOIN pz pb ON pb.b = pr.item_b WHERE pr.rank <= 15)
SELECT item_a, item_b, tot AS individual_total, tot * 0.9 AS bundle_price_10pct, tot * 0.85 AS bundle_price_15pct,
       lift, count, support FROM bt WHERE tot > 0
"""

SQL["ec_cross_sell"] = PAIRS + f"""
, recs AS (SELECT item_a AS product, item_b AS recommended, lift, support, count FROM lifted
           UNION ALL SELECT item_b, item_a, lift, support, count FROM lifted),
tp AS (SELECT {BASE} AS product, sum({REV}) AS rv FROM lines WHERE product_name IS NOT NULL
       GROUP BY 1 ORDER BY rv DESC, product LIMIT 20)
SELECT product, recommended, lift, support, rec_rank FROM (
  SELECT recs.*, CAST(row_number() OVER (PARTITION BY product ORDER BY round(lift, 2) DESC, count DESC, recommended) AS INTEGER) AS rec_rank
  FROM recs WHERE product IN (SELECT product FROM tp)) WHERE rec_rank <= 3
"""

# ------------------------------------------------------------------ operations
SQL["ec_geo_revenue"] = """
, g AS (SELECT state, count(DISTINCT order_id) AS orders, sum(total) AS revenue, avg(total) AS aov,
               count(DISTINCT email) AS customers
        FROM ords WHERE state IS NOT NULL AND state <> '' AND total IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN (SELECT sum(revenue) FROM g) > 0 THEN revenue / (SELECT sum(revenue) FROM g) * 100 ELSE 0.0 END
          AS pct_revenue FROM g
"""

SQL["ec_shipping_by_state"] = """
, g AS (SELECT state, avg(shipping_cost) AS avg_shipping, count(DISTINCT order_id) AS order_count,
               avg(CAST(coalesce(shipping_cost, 0.0) = 0 AS DOUBLE)) * 100 AS free_shipping_pct,
               avg(total) AS avg_total, round(avg(shipping_cost), 2) AS s2
        FROM ords WHERE state IS NOT NULL AND state <> '' GROUP BY 1)
SELECT state, avg_shipping, order_count, free_shipping_pct, avg_total,
       coalesce(s2 > (SELECT quantile_cont(s2, 0.5) FROM g) * 1.5
                AND order_count < (SELECT quantile_cont(order_count, 0.5) FROM g) * 0.5, false) AS flagged
FROM g
"""

CANC_O = f"\n, co AS (SELECT *, {CANC3} AS c FROM ords)"

SQL["ec_cancel_rate"] = CANC_O + """
SELECT count(*) AS total_orders, count(*) FILTER (WHERE c) AS cancelled_orders,
       CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE c) * 100.0 / count(*) END AS cancel_rate FROM co
"""
SQL["ec_cancel_monthly"] = CANC_O + """
SELECT strftime("date", '%Y-%m') AS month, count(*) AS total, count(*) FILTER (WHERE c) AS cancelled,
       count(*) FILTER (WHERE c) * 100.0 / count(*) AS rate
FROM co WHERE "date" IS NOT NULL GROUP BY 1
"""
SQL["ec_cancel_reasons"] = CANC_O + """
SELECT coalesce(cancellation_reason, 'Sin motivo') AS reason, count(*) AS count FROM co WHERE c
GROUP BY 1 ORDER BY count DESC, reason LIMIT 10
"""
SQL["ec_cancel_by_payment"] = CANC_O + """
SELECT payment_method, count(*) AS total, count(*) FILTER (WHERE c) AS cancelled,
       count(*) FILTER (WHERE c) * 100.0 / count(*) AS rate
FROM co WHERE payment_method IS NOT NULL GROUP BY 1 HAVING count(*) >= 5
"""
SQL["ec_city_penetration"] = """
, g AS (SELECT city, count(DISTINCT order_id) AS orders, sum(total) AS revenue FROM ords
        WHERE city IS NOT NULL AND city <> '' GROUP BY 1)
SELECT *, (SELECT count(*) FROM g) AS total_cities FROM g ORDER BY revenue DESC NULLS LAST, city LIMIT 20
"""
SQL["ec_shipping_method_crosstab"] = """
, o AS (SELECT * FROM ords WHERE shipping_method IS NOT NULL AND state IS NOT NULL),
ts AS (SELECT state FROM o GROUP BY 1 ORDER BY count(*) DESC, state LIMIT 10),
tmm AS (SELECT shipping_method FROM o GROUP BY 1 ORDER BY count(*) DESC, shipping_method LIMIT 5),
c AS (SELECT state, shipping_method, count(*) AS cnt FROM o GROUP BY 1, 2)
SELECT ts.state, tmm.shipping_method, coalesce(c.cnt, 0) AS count
FROM ts CROSS JOIN tmm LEFT JOIN c ON c.state = ts.state AND c.shipping_method = tmm.shipping_method
"""

FULFIL = f"""
, ff AS (SELECT * FROM (SELECT *, {DAYS_BETWEEN.format(a='"date"', b='shipping_date')} AS d FROM ords
                        WHERE "date" IS NOT NULL AND shipping_date IS NOT NULL) WHERE d >= 0)"""

SQL["ec_fulfillment_stats"] = FULFIL + """
SELECT * FROM (SELECT quantile_cont(CAST(d AS DOUBLE), 0.5) AS median_days, avg(d) AS mean_days,
                      quantile_cont(CAST(d AS DOUBLE), 0.9) AS p90_days, count(*) AS total_orders FROM ff)
WHERE total_orders >= 10
"""
SQL["ec_fulfillment_by_method"] = FULFIL + """
SELECT shipping_method AS method, quantile_cont(CAST(d AS DOUBLE), 0.5) AS median_days, avg(d) AS mean_days,
       count(*) AS orders
FROM ff WHERE shipping_method IS NOT NULL GROUP BY 1 HAVING count(*) >= 5
"""
SQL["ec_fulfillment_monthly"] = FULFIL + """
SELECT strftime("date", '%Y-%m') AS month, quantile_cont(CAST(d AS DOUBLE), 0.5) AS median_days FROM ff GROUP BY 1
"""
SQL["ec_channel_analysis"] = """
SELECT channel, count(DISTINCT order_id) AS orders, sum(total) AS revenue, avg(total) AS aov,
       count(DISTINCT email) AS customers,
       avg(CAST(coalesce(order_status IN ('cancelled', 'Cancelada'), false) AS DOUBLE)) * 100 AS cancel_rate
FROM ords WHERE channel IS NOT NULL AND channel <> '' GROUP BY 1
"""

FREE = """
, fo AS (SELECT *, coalesce(shipping_cost, 0.0) = 0 AS fr FROM ords WHERE total IS NOT NULL AND total > 0),
ok AS (SELECT count(*) FILTER (WHERE fr) >= 5 AND count(*) FILTER (WHERE NOT fr) >= 5 AS ok FROM fo)"""

SQL["ec_free_shipping"] = FREE + """
SELECT CASE WHEN fr THEN 'free_shipping' ELSE 'paid_shipping' END AS segment, count(*) AS orders,
       avg(total) AS aov, sum(total) AS revenue
FROM fo WHERE (SELECT ok FROM ok) GROUP BY 1
"""
SQL["ec_free_shipping_retention"] = FREE + """
, per AS (SELECT email, count(*) AS n, max(CAST(fr AS INTEGER)) AS hf, max(CAST(NOT fr AS INTEGER)) AS hp
          FROM fo WHERE email IS NOT NULL GROUP BY 1)
SELECT avg(n) FILTER (WHERE hf = 1) AS free_avg_orders, avg(n) FILTER (WHERE hp = 1) AS paid_avg_orders
FROM per WHERE (SELECT ok FROM ok)
"""

# ------------------------------------------------------------------ readers (round trips of derived exports)
SQL["src_store_csv"] = """
SELECT order_id, email, "date", order_status, total, discount, shipping_cost, coupon, state, city, payment_method,
       shipping_date, product_name, product_price, product_qty, sku, channel, cancellation_reason FROM lines
"""
SQL["src_orders_from_export"] = """
SELECT order_id, email, "date", order_status, total, state, shipping_cost FROM ords
"""
