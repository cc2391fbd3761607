"""Social-ads operators over insight rows (campaign x ad set x ad x day x breakdown).

Missing metric columns count as 0.  Ratios the reference rounds before a rule
uses them (lights, warnings, scores, balance verdicts) are rounded
half-to-even to 2 decimals for the rule; reported values stay unrounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.core import safe_div, semaphore, sum0
from mercato.functions.text import STAGE_TOKENS, parse_name

# Social report labels and thresholds.
BENCH_NAMES = ['CTR (all)', 'CPM', 'Frecuencia', 'ROAS', 'CPC (Link Click)', 'CPA (Purchase)']
DAYS = ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']
FUNNEL = [('Impressions', 'impressions'), ('Clicks (all)', 'clicks'), ('Link Clicks', 'link_clicks'),
          ('Landing Page Views', 'landing_page_views'), ('Add to Cart', 'add_to_cart'),
          ('Checkout Initiated', 'checkout_initiated'), ('Purchases', 'purchases')]
VIDEO = ['video_p25', 'video_p50', 'video_p75', 'video_p100']
RANKINGS = ['quality_ranking', 'engagement_ranking', 'conversion_ranking']


def _v(df: DataFrame, c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)


def _sum(df: DataFrame, c: str) -> Column:
    return sum0(_v(df, c).cast("double")).cast("double").alias(c)


BASE = ["spend", "impressions", "clicks", "link_clicks", "purchases", "purchase_value", "reach"]


def _agg(df: DataFrame, keys: list, extra: list | None = None) -> DataFrame:
    cols = BASE + (extra or [])
    g = df
    for k in keys:
        g = g.where(F.col(k).isNotNull())
    return g.groupBy(*keys).agg(*[_sum(df, c) for c in cols])


def _ratios(prefix: str = "") -> list:
    return [safe_div("purchase_value", "spend").alias(prefix + "roas"),
            safe_div("spend", "purchases").alias(prefix + "cpa"),
            safe_div(F.col("clicks") * 100, "impressions").alias(prefix + "ctr"),
            safe_div(F.col("spend") * 1000, "impressions").alias(prefix + "cpm")]


def _r2(c) -> Column:
    return F.bround(c if isinstance(c, Column) else F.col(c), 2)


def ma_dashboard(ctx) -> DataFrame:
    s = ctx.social
    t = s.agg(*[_sum(s, c) for c in BASE], F.min("date_start").alias("date_min"), F.max("date_start").alias("date_max"),
              F.count_distinct("campaign_name").alias("num_campaigns"), F.count_distinct("adset_name").alias("num_adsets"),
              F.count_distinct("ad_name").alias("num_ads"))
    return t.select(F.col("spend"), F.col("purchases"), F.col("purchase_value").alias("revenue"), *_ratios(),
                    "impressions", "reach", "clicks", "link_clicks",
                    safe_div("impressions", "reach").alias("frequency"), "date_min", "date_max", "num_campaigns",
                    "num_adsets", "num_ads")


def ma_benchmarks(ctx) -> DataFrame:
    s = ctx.social
    t = s.agg(*[_sum(s, c) for c in BASE])
    v = t.select(safe_div(F.col("clicks") * 100, "impressions").alias("ctr"),
                 safe_div(F.col("spend") * 1000, "impressions").alias("cpm"),
                 F.when(F.col("reach") > 0, safe_div("impressions", "reach")).otherwise(F.lit(0.0)).alias("freq"),
                 safe_div("purchase_value", "spend").alias("roas"), safe_div("spend", "link_clicks").alias("cpc"),
                 safe_div("spend", "purchases").alias("cpa"))

    def row(name, col, unit, light):
        return F.struct(F.lit(name).alias("metric"), F.col(col).alias("value"), F.lit(unit).alias("unit"),
                        light.alias("semaphore"))

    ctx_light = F.lit("contextual")
    return v.select(F.explode(F.array(
        row(BENCH_NAMES[0], "ctr", "%", semaphore("ctr", 2.0, 1.0, null_label=None)),
        row(BENCH_NAMES[1], "cpm", "$", ctx_light),
        row(BENCH_NAMES[2], "freq", "x", semaphore("freq", 3.0, 5.0, reverse=True, null_label=None)),
        row(BENCH_NAMES[3], "roas", "x", semaphore("roas", 3.0, 1.5, null_label=None)),
        row(BENCH_NAMES[4], "cpc", "$", ctx_light),
        row(BENCH_NAMES[5], "cpa", "$", ctx_light))).alias("m")).select("m.*")


def _daily(ctx) -> DataFrame:
    s = ctx.social
    return _agg(s, ["date_start"])


def ma_daily(ctx) -> DataFrame:
    d = _daily(ctx)
    return d.select(F.col("date_start").alias("date"), "spend", "purchases", *_ratios())


def ma_campaigns(ctx) -> DataFrame:
    g = _agg(ctx.social, ["campaign_name"])
    roas, ctr = _r2(safe_div("purchase_value", "spend")), _r2(safe_div(F.col("clicks") * 100, "impressions"))
    freq = _r2(safe_div("impressions", "reach"))
    return g.select(F.col("campaign_name").alias("campaign"), "spend", "impressions", "purchases",
                    F.col("purchase_value").alias("revenue"), *_ratios(),
                    safe_div("impressions", "reach").alias("frequency"),
                    semaphore(roas, 3.0, 1.5, null_label=None).alias("roas_semaphore"),
                    semaphore(ctr, 2.0, 1.0, null_label=None).alias("ctr_semaphore"),
                    semaphore(freq, 3.0, 5.0, reverse=True, null_label=None).alias("freq_semaphore"))


def ma_budget_distribution(ctx, band: float = 5.0) -> DataFrame:
    g = _agg(ctx.social, ["campaign_name"])
    ts, tp = g.agg(F.sum("spend")).scalar(), g.agg(F.sum("purchases")).scalar()
    sp = F.bround(safe_div(F.col("spend") * 100, ts), 1)
    pp = F.when(tp > 0, F.bround(safe_div(F.col("purchases") * 100, tp), 1)).otherwise(F.lit(0.0))
    out = g.select(F.col("campaign_name").alias("campaign"), "spend", sp.alias("spend_pct"), "purchases",
                   pp.alias("purchases_pct"), safe_div("purchase_value", "spend").alias("roas"))
    eff = (F.when(F.col("spend_pct") > F.col("purchases_pct") + band, "over")
           .when(F.col("purchases_pct") > F.col("spend_pct") + band, "under").otherwise("balanced"))
    return out.withColumn("efficiency", eff)


def ma_learning_phase(ctx, active: int = 50, learning: int = 10) -> DataFrame:
    s = ctx.social.where(F.col("adset_name").isNotNull())
    g = s.groupBy("adset_name").agg(_sum(s, "purchases"), _sum(s, "leads"), _sum(s, "spend"),
                                    F.count_distinct("date_start").alias("days"))
    ev = F.col("purchases") + F.col("leads")
    return g.select(F.col("adset_name").alias("adset"), ev.alias("optimization_events"), "spend", "days",
                    F.when(ev >= active, "active").when(ev >= learning, "learning").otherwise("learning_limited")
                    .alias("status"), F.greatest(F.lit(0.0), F.lit(float(active)) - ev).alias("events_needed"))


def ma_learning_summary(ctx) -> DataFrame:
    p = ma_learning_phase(ctx)
    return p.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("status") == "active", 1)).alias("active"),
                 F.count(F.when(F.col("status") == "learning", 1)).alias("learning"),
                 F.count(F.when(F.col("status") == "learning_limited", 1)).alias("learning_limited"))


def ma_adsets(ctx, factor: float = 1.3) -> DataFrame:
    g = _agg(ctx.social, ["adset_name"])
    avg_cpa = safe_div(g.agg(F.sum("spend")).scalar(), g.agg(F.sum("purchases")).scalar())
    cpa2 = _r2(safe_div("spend", "purchases"))
    return g.select(F.col("adset_name").alias("adset"), "spend", "impressions", "purchases",
                    F.col("purchase_value").alias("revenue"), *_ratios(),
                    F.when(avg_cpa > 0, cpa2 > avg_cpa * factor).otherwise(F.lit(False)).alias("breakdown_warning"),
                    avg_cpa.alias("avg_cpa"))


def ma_audiences(ctx) -> DataFrame:
    g = _agg(ctx.social, ["adset_name"])
    return g.select(F.col("adset_name").alias("audience"), "spend", "reach", "purchases",
                    safe_div("purchase_value", "spend").alias("roas"), safe_div("spend", "purchases").alias("cpa"),
                    safe_div(F.col("purchases") * 100, "reach").alias("conv_rate"))


def ma_ad_ranking(ctx, k: int = 20) -> DataFrame:
    """Score = .4 ROAS/max + .35 (1 - clipped CPA / (10 x min CPA)) + .25 CTR/max on 2-decimal ratios."""
    g = _agg(ctx.social, ["ad_name"]).select(
        "ad_name", "spend", "purchases", _r2(safe_div("purchase_value", "spend")).alias("roas"),
        _r2(safe_div("spend", "purchases")).alias("cpa"), _r2(safe_div(F.col("clicks") * 100, "impressions")).alias("ctr"))
    st = g.agg(F.max("roas").alias("mr"), F.min(F.when(F.col("cpa") > 0, F.col("cpa"))).alias("mc"),
               F.max("ctr").alias("mt"), F.count(F.lit(1)).alias("n"))
    mr = F.when(st.select("mr").scalar() > 0, st.select("mr").scalar()).otherwise(F.lit(1.0))
    mc = F.coalesce(st.select("mc").scalar(), F.lit(1.0))
    mt = F.when(st.select("mt").scalar() > 0, st.select("mt").scalar()).otherwise(F.lit(1.0))
    cap = mc * 10
    clipped = F.least(F.greatest(F.col("cpa"), F.lit(0.0)), cap)
    score = (F.col("roas") / mr) * 0.4 + (1 - clipped / cap) * 0.35 + (F.col("ctr") / mt) * 0.25
    top = g.withColumn("score", score).orderBy(F.col("score").desc(), "ad_name").limit(k)
    # at most k rows: bounded window
    return top.select(F.row_number().over(Window.orderBy(F.col("score").desc(), "ad_name")).alias("rank"),
                      F.col("ad_name").alias("ad"), "spend", "purchases", "roas", "cpa", "ctr", "score",
                      st.select("n").scalar().alias("total_ads"))


def _fatigue(ctx, min_days: int = 5, drop: float = -20.0, max_freq: float = 4.0) -> DataFrame:
    s = ctx.social.where(F.col("ad_name").isNotNull() & F.col("date_start").isNotNull())
    d = s.groupBy("ad_name", "date_start").agg(_sum(s, "impressions"), _sum(s, "clicks"), _sum(s, "reach"))
    # one row per active day of an ad: the calendar bounds each window partition
    w = Window.partitionBy("ad_name").orderBy("date_start")
    d = d.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("ad_name")))
    mid = F.floor(F.col("_n") / 2)
    first = F.col("_rn") <= mid
    a = d.groupBy("ad_name", "_n").agg(
        sum0(F.when(first, F.col("clicks"))).alias("_c1"), sum0(F.when(first, F.col("impressions"))).alias("_i1"),
        sum0(F.when(~first, F.col("clicks"))).alias("_c2"), sum0(F.when(~first, F.col("impressions"))).alias("_i2"),
        F.sum("impressions").alias("_i"), F.sum("reach").alias("_r")).where(F.col("_n") >= min_days)
    c1, c2 = safe_div(F.col("_c1") * 100, "_i1"), safe_div(F.col("_c2") * 100, "_i2")
    a = a.select("ad_name", "_n", c1.alias("ctr_first_half"), c2.alias("ctr_second_half"),
                 safe_div("_i", "_r").alias("avg_frequency"))
    change = F.when(F.col("ctr_first_half") > 0,
                    safe_div((F.col("ctr_second_half") - F.col("ctr_first_half")) * 100, "ctr_first_half")).otherwise(F.lit(0.0))
    a = a.withColumn("ctr_change_pct", change)
    return a.select(F.col("ad_name").alias("ad"), "ctr_first_half", "ctr_second_half", "ctr_change_pct",
                    "avg_frequency", F.col("_n").alias("days_active"),
                    (F.col("ctr_change_pct") < drop).alias("ctr_drop"),
                    (F.col("avg_frequency") > max_freq).alias("high_frequency")).where(
        F.col("ctr_drop") | F.col("high_frequency"))


def ma_creative_fatigue(ctx, k: int = 15) -> DataFrame:
    total = ctx.social.agg(F.count_distinct("ad_name")).scalar()
    return (_fatigue(ctx).orderBy("ctr_change_pct", "ad").limit(k)
            .select("*", total.alias("total_analyzed")))


def _totals(ctx) -> DataFrame:
    s = ctx.social
    cols = sorted({c for _, c in FUNNEL} | set(BASE) | {"leads"})
    return s.agg(*[_sum(s, c) for c in cols])


def ma_funnel(ctx) -> DataFrame:
    t = _totals(ctx)
    always = {"impressions", "clicks", "link_clicks", "purchases"}
    rows = [F.struct(F.lit(i).alias("stage_order"), F.lit(name).alias("stage"), F.col(c).alias("value"),
                     F.when(F.lit(c == "impressions"), F.lit(100.0))
                     .otherwise(safe_div(F.col(c) * 100, "impressions")).alias("pct"),
                     (F.lit(True) if c in always else (F.col(c) > 0)).alias("_keep"))
            for i, (name, c) in enumerate(FUNNEL)]
    return t.select(F.explode(F.array(*rows)).alias("s")).select("s.*").where("_keep").drop("_keep")


def ma_dropoff(ctx) -> DataFrame:
    t = _totals(ctx)
    clicks = "link_clicks" if "link_clicks" in ctx.social.columns else "clicks"
    steps = [("Impressions → Clicks", "impressions", clicks),
             ("Clicks → Landing Page Views", clicks, "landing_page_views"),
             ("Landing Page Views → Add to Cart", "landing_page_views", "add_to_cart"),
             ("Add to Cart → Checkout", "add_to_cart", "checkout_initiated"),
             ("Checkout → Purchase", "checkout_initiated", "purchases")]
    rows = [F.struct(F.lit(i).alias("step_order"), F.lit(label).alias("transition"), F.col(a).alias("from_value"),
                     F.col(b).alias("to_value")) for i, (label, a, b) in enumerate(steps)]
    x = t.select(F.explode(F.array(*rows)).alias("s")).select("s.*").where(
        (F.col("from_value") > 0) & (F.col("to_value") > 0))
    conv = safe_div(F.col("to_value") * 100, "from_value")
    return x.select("*", conv.alias("conversion_rate"), (100 - conv).alias("dropoff_rate"))


def ma_dow(ctx) -> DataFrame:
    s = ctx.social.where(F.col("date_start").isNotNull()).withColumn("day_num", F.weekday("date_start"))
    g = _agg(s, ["day_num"])
    names = F.array(*[F.lit(x) for x in DAYS])
    out = g.select(F.element_at(names, F.col("day_num") + 1).alias("day"), "day_num", "spend", "purchases",
                   safe_div("purchase_value", "spend").alias("roas"), safe_div("spend", "purchases").alias("cpa"),
                   safe_div(F.col("spend") * 1000, "impressions").alias("cpm"))
    best = out.orderBy(_r2("roas").desc(), "day_num").select("day").limit(1).scalar()
    worst = out.orderBy(_r2("roas").asc(), "day_num").select("day").limit(1).scalar()
    return out.select("*", best.alias("best_day"), worst.alias("worst_day"))


def ma_period_trend(ctx, min_days: int = 7, periods: tuple = (30, 60, 90)) -> DataFrame:
    d = _daily(ctx)
    n = d.agg(F.count(F.lit(1))).scalar()
    mx = d.agg(F.max("date_start")).scalar()
    e = d.where(n >= min_days).select("*", F.explode(F.array(*[F.lit(p) for p in periods])).alias("window_days"))
    e = e.where(F.col("date_start") >= F.date_sub(mx, F.col("window_days")))
    g = e.groupBy("window_days").agg(F.sum("spend").alias("spend"), F.sum("purchases").alias("purchases"),
                                     F.sum("purchase_value").alias("_v"), F.count(F.lit(1)).alias("days"))
    return g.select(F.concat(F.lit("last_"), F.col("window_days").cast("string"), F.lit("d")).alias("period"),
                    safe_div("_v", "spend").alias("roas"), safe_div("spend", "purchases").alias("cpa"), "spend",
                    "purchases", "days")


def _last_rows(d: DataFrame, order: str) -> DataFrame:
    # one row per day: the calendar bounds the unpartitioned window
    return d.withColumn("_r", F.row_number().over(Window.orderBy(F.col(order).desc())))


def ma_roas_direction(ctx, span: int = 7) -> DataFrame:
    d = _last_rows(_daily(ctx), "date_start")
    a = d.agg(F.count(F.lit(1)).alias("_n"),
              safe_div(sum0(F.when(F.col("_r") <= span, F.col("purchase_value"))),
                       sum0(F.when(F.col("_r") <= span, F.col("spend")))).alias("roas_last"),
              safe_div(sum0(F.when((F.col("_r") > span) & (F.col("_r") <= 2 * span), F.col("purchase_value"))),
                       sum0(F.when((F.col("_r") > span) & (F.col("_r") <= 2 * span), F.col("spend")))).alias("roas_prev"))
    last, prev = F.col("roas_last"), F.col("roas_prev")
    trend = (F.when(F.col("_n") < 2 * span, "insufficient_data").when(last > prev, "improving")
             .when(last < prev, "declining").otherwise("stable"))
    return a.select(trend.alias("trend"), F.when(F.col("_n") >= 2 * span, last).alias("roas_last"),
                    F.when(F.col("_n") >= 2 * span, prev).alias("roas_prev"))


def ma_geo(ctx, k: int = 20) -> DataFrame:
    s = ctx.social
    counts = s.agg(*[F.count(c).alias(c) for c in ("region", "country") if c in s.columns]).first()
    level = "region" if "region" in s.columns and counts["region"] > 0 else "country"
    g = _agg(s, [level])
    n = g.agg(F.count(F.lit(1))).scalar()
    return (g.select(F.col(level).alias("region"), "spend", "impressions", "purchases",
                     safe_div("purchase_value", "spend").alias("roas"), safe_div("spend", "purchases").alias("cpa"),
                     safe_div(F.col("spend") * 1000, "impressions").alias("cpm"))
            .orderBy(F.col("spend").desc(), "region").limit(k)
            .select("*", F.lit(level).alias("geo_type"), n.alias("total_regions")))


def ma_placement(ctx, factor: float = 1.3) -> DataFrame:
    g = _agg(ctx.social, ["placement"])
    avg_cpa = safe_div(g.agg(F.sum("spend")).scalar(), g.agg(F.sum("purchases")).scalar())
    cpa2 = _r2(safe_div("spend", "purchases"))
    return g.select("placement", "spend", "impressions", "purchases", *_ratios(),
                    F.when((avg_cpa > 0) & (F.col("purchases") > 0), cpa2 > avg_cpa * factor).otherwise(F.lit(False))
                    .alias("breakdown_warning"), avg_cpa.alias("avg_cpa"))


def ma_device(ctx) -> DataFrame:
    g = _agg(ctx.social, ["device"])
    ts = g.agg(F.sum("spend")).scalar()
    return g.select("device", "spend", safe_div(F.col("spend") * 100, ts).alias("spend_pct"), "impressions",
                    "purchases", *_ratios())


def ma_signals(ctx, k: int = 10) -> DataFrame:
    """Red benchmark lights, learning-limited ad sets, fatigued ads, funnel leaks over 95 %."""
    b = ma_benchmarks(ctx).where(F.col("semaphore") == "red").select(
        F.lit("high").alias("priority"), F.col("metric").alias("area"), F.lit("benchmark_red").alias("type"),
        F.col("value"))
    lim = ma_learning_summary(ctx).where(F.col("learning_limited") > 0).select(
        F.lit("high").alias("priority"), F.lit("Learning Phase").alias("area"), F.lit("learning_limited").alias("type"),
        F.col("learning_limited").cast("double").alias("value"))
    fat = _fatigue(ctx).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
        F.lit("medium").alias("priority"), F.lit("Creative Fatigue").alias("area"), F.lit("fatigue").alias("type"),
        F.col("n").cast("double").alias("value"))
    leak = ma_dropoff(ctx).where(F.col("dropoff_rate") > 95).select(
        F.lit("medium").alias("priority"), F.col("transition").alias("area"), F.lit("funnel_leak").alias("type"),
        F.col("dropoff_rate").alias("value"))
    u = b.unionByName(lim).unionByName(fat).unionByName(leak)
    prio = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return u.orderBy(prio, "type", "area").limit(k)


# ---------------------------------------------------------------- naming convention

def name_column(df: DataFrame) -> str | None:
    return "ad_name" if "ad_name" in df.columns else ("adset_name" if "adset_name" in df.columns else None)


def detect_name_format(ctx) -> str:
    """Vote over all distinct names."""
    s = ctx.social
    col = name_column(s)
    if col is None:
        return "unknown"
    names = s.where(F.col(col).isNotNull()).select(F.col(col).alias("n")).distinct()
    parts = F.split(F.col("n"), "_")
    head2 = F.transform(F.slice(parts, 1, 2), lambda p: F.upper(p))
    stage_hit = F.exists(head2, lambda p: F.array_contains(F.array(*[F.lit(t) for t in STAGE_TOKENS]), p))
    v = names.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("n").contains(" | "), 1)).alias("pipe"),
                  F.count(F.when(F.size(parts) >= 3, 1)).alias("under"),
                  F.count(F.when(stage_hit, 1)).alias("stage")).first()
    n = v["n"]
    if v["pipe"] > n * 0.3:
        return "standard"
    if v["under"] > n * 0.3 and v["stage"] > n * 0.2:
        return "alternative"
    return "unknown"


def ma_name_detect(ctx) -> DataFrame:
    return ctx.spark.createDataFrame([(detect_name_format(ctx),)], "format string")


def _parsed_names(ctx, fmt: str | None = None) -> DataFrame:
    fmt = fmt or detect_name_format(ctx)
    s = ctx.social
    col = name_column(s)
    names = s.where(F.col(col).isNotNull()).select(F.col(col).alias("name")).distinct()
    return names.select("name", parse_name(F.col("name"), fmt).alias("p")).select(
        "name", "p.product", "p.format", "p.stage", "p.creator", "p.variation")


def ma_name_parse(ctx) -> DataFrame:
    return _parsed_names(ctx)


def ma_name_parse_standard(ctx) -> DataFrame:
    return _parsed_names(ctx, "standard")


def ma_name_parse_alternative(ctx) -> DataFrame:
    return _parsed_names(ctx, "alternative")


def ma_name_summary(ctx, products: int = 15) -> DataFrame:
    """Counts per parsed field value (products: top 15), plus parsed / unparsed name counts."""
    fmt = detect_name_format(ctx)
    if fmt == "unknown":
        return ctx.spark.createDataFrame([], "field string, value string, count long")
    p = _parsed_names(ctx, fmt)
    fields = p.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))
                                          for f in ("format", "stage", "creator", "product")])).alias("s")).select("s.*")
    counts = fields.where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))
    # products: a distributed top-k (take-ordered) instead of one window over every distinct product
    top_products = (counts.where(F.col("field") == "product").orderBy(F.col("count").desc(), "value")
                    .limit(products))
    counts = counts.where(F.col("field") != "product").unionByName(top_products)
    unparsed = F.col("format").isNull() & F.col("stage").isNull()
    tot = p.agg(F.count(F.when(~unparsed, 1)).alias("parsed"), F.count(F.when(unparsed, 1)).alias("unparsed"))
    extra = tot.select(F.explode(F.array(
        F.struct(F.lit("names").alias("field"), F.lit("parsed").alias("value"), F.col("parsed").alias("count")),
        F.struct(F.lit("names").alias("field"), F.lit("unparsed").alias("value"), F.col("unparsed").alias("count"))
    )).alias("s")).select("s.*")
    return counts.unionByName(extra)


def _by_field(ctx, field: str) -> DataFrame:
    fmt = detect_name_format(ctx)
    s = ctx.social
    col = name_column(s)
    x = s.withColumn("_f", parse_name(F.col(col), fmt)[field])
    g = _agg(x, ["_f"])
    return g.select(F.col("_f").alias(field), "spend", "impressions", "clicks", "purchases", "purchase_value", "reach",
                    *_ratios()).where(F.lit(fmt != "unknown"))


def ma_by_format(ctx) -> DataFrame:
    return _by_field(ctx, "format")


def ma_by_stage(ctx) -> DataFrame:
    return _by_field(ctx, "stage")


def ma_by_creator(ctx) -> DataFrame:
    return _by_field(ctx, "creator")


def ma_by_product(ctx) -> DataFrame:
    return _by_field(ctx, "product")


def ma_format_stage_matrix(ctx) -> DataFrame:
    fmt = detect_name_format(ctx)
    s = ctx.social
    col = name_column(s)
    p = parse_name(F.col(col), fmt)
    x = s.withColumn("format", p["format"]).withColumn("stage", p["stage"])
    g = _agg(x, ["format", "stage"])
    return g.select("format", "stage", "spend", "purchase_value", "purchases",
                    safe_div("purchase_value", "spend").alias("roas")).where(F.lit(fmt != "unknown"))


def ma_relevance(ctx, k: int | None = None) -> DataFrame:
    s = ctx.social
    col = name_column(s)
    cols = [c for c in RANKINGS if c in s.columns]
    order = F.struct(*[F.col(c) for c in ("date_start", "device", "campaign_name", "adset_name") if c in s.columns])
    g = s.where(F.col(col).isNotNull()).groupBy(col).agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols])
    out = g.withColumnRenamed(col, "name")
    return out if k is None else out.orderBy("name").limit(k)


def ma_relevance_distribution(ctx) -> DataFrame:
    s = ctx.social
    col = name_column(s)
    cols = [c for c in RANKINGS if c in s.columns]
    order = F.struct(*[F.col(c) for c in ("date_start", "device", "campaign_name", "adset_name") if c in s.columns])
    g = s.where(F.col(col).isNotNull()).groupBy(col).agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols])
    e = g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("ranking"), F.col(c).alias("value")) for c in cols]))
                 .alias("s")).select("s.*")
    return e.where(F.col("value").isNotNull()).groupBy("ranking", "value").agg(F.count(F.lit(1)).alias("count"))


def ma_hook_rate(ctx, k: int = 20, min_impressions: float = 100) -> DataFrame:
    s = ctx.social
    col = name_column(s)
    g = s.where(F.col(col).isNotNull()).groupBy(col).agg(_sum(s, "impressions"), _sum(s, "video_3s"),
                                                         _sum(s, "spend")).where(F.col("impressions") > min_impressions)
    hook = safe_div(F.col("video_3s") * 100, "impressions")
    avg = g.agg(safe_div(F.sum("video_3s") * 100, F.sum("impressions"))).scalar()
    return (g.select(F.col(col).alias("ad"), "impressions", "video_3s", hook.alias("hook_rate"), "spend")
            .orderBy(_r2("hook_rate").desc(), "ad").limit(k).select("*", avg.alias("avg_hook_rate")))


def ma_video_completion(ctx) -> DataFrame:
    s = ctx.social
    cols = [c for c in VIDEO if c in s.columns]
    t = s.agg(_sum(s, "impressions"), *[_sum(s, c) for c in cols])
    return t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"),
                                                 safe_div(F.col(c) * 100, "impressions").alias("rate"))
                                        for c in cols])).alias("s")).select("s.*")


def ma_video_completion_ads(ctx, k: int | None = None, min_impressions: float = 100) -> DataFrame:
    s = ctx.social
    col = name_column(s)
    cols = [c for c in VIDEO if c in s.columns]
    g = s.where(F.col(col).isNotNull()).groupBy(col).agg(_sum(s, "impressions"), *[_sum(s, c) for c in cols])
    g = g.where(F.col("impressions") > min_impressions)
    g = g if k is None else g.orderBy(col).limit(k)
    return g.select(F.col(col).alias("ad"), "impressions",
                    *[safe_div(F.col(c) * 100, "impressions").alias(c.replace("video_", "") + "_rate") for c in cols])


def ma_forecast(ctx, history: int = 30, horizon: int = 30, min_days: int = 14) -> DataFrame:
    """Linear trend of daily spend and ROAS over the last 30 days, projected 30 days, floored at 0."""
    d = _last_rows(_daily(ctx), "date_start")
    n_all = d.agg(F.count(F.lit(1))).scalar()
    r = d.where(F.col("_r") <= history)
    n = F.col("n").cast("double")
    roas = safe_div("purchase_value", "spend")
    # x = 0..n-1 in date order equals (n - _r)
    x = (r.agg(F.count(F.lit(1))).scalar() - F.col("_r")).cast("double")
    fit = r.select(x.alias("x"), F.col("spend").alias("y1"), roas.alias("y2")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y1").alias("sy1"), F.sum("y2").alias("sy2"),
        F.sum(F.col("x") * F.col("y1")).alias("sxy1"), F.sum(F.col("x") * F.col("y2")).alias("sxy2"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"))
    den = n * F.col("sxx") - F.col("sx") * F.col("sx")
    m1 = (n * F.col("sxy1") - F.col("sx") * F.col("sy1")) / den
    m2 = (n * F.col("sxy2") - F.col("sx") * F.col("sy2")) / den
    f = fit.where(n_all >= min_days).select("n", m1.alias("m1"), ((F.col("sy1") - m1 * F.col("sx")) / n).alias("b1"),
                                             m2.alias("m2"), ((F.col("sy2") - m2 * F.col("sx")) / n).alias("b2"))
    e = f.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("day"))
    at = (F.col("n") - 1 + F.col("day")).cast("double")
    return e.select("day", F.greatest(F.lit(0.0), F.col("m1") * at + F.col("b1")).alias("forecast_spend"),
                    F.greatest(F.lit(0.0), F.col("m2") * at + F.col("b2")).alias("forecast_roas"),
                    F.when(F.col("m1") > 0, "increasing").otherwise("decreasing").alias("spend_trend"),
                    F.when(F.col("m2") > 0, "improving").otherwise("declining").alias("roas_trend"))


def ma_overlap_cv(ctx, k: int = 10) -> DataFrame:
    s = ctx.social.where(F.col("adset_name").isNotNull() & F.col("date_start").isNotNull())
    d = s.groupBy("adset_name", "date_start").agg(_sum(s, "spend"), _sum(s, "impressions"))
    d = d.withColumn("cpm", safe_div(F.col("spend") * 1000, "impressions"))
    g = d.groupBy("adset_name").agg(F.avg("cpm").alias("avg_cpm"), F.stddev_samp("cpm").alias("cpm_std"))
    g = g.withColumn("cv", safe_div("cpm_std", "avg_cpm"))
    sus = g.where((F.col("cv") > 0.4) & (F.col("avg_cpm") > 0))
    return (sus.select(F.col("adset_name").alias("adset"), "avg_cpm", "cpm_std", "cv",
                       F.when(F.col("cv") > 0.6, "high").otherwise("medium").alias("risk"))
            .orderBy(F.col("cv").desc(), "adset").limit(k))


def ma_pacing(ctx, min_days: int = 3) -> DataFrame:
    s = ctx.social.where(F.col("campaign_name").isNotNull() & F.col("date_start").isNotNull())
    d = s.groupBy("campaign_name", "date_start").agg(_sum(s, "spend"))
    # per campaign and day: the calendar bounds each window partition
    w = Window.partitionBy("campaign_name")
    d = d.withColumn("_avg", F.avg("spend").over(w))
    g = d.groupBy("campaign_name").agg(
        F.avg("spend").alias("avg_daily_spend"), F.stddev_samp("spend").alias("spend_std"),
        F.count(F.when(F.col("spend") < F.col("_avg") * 0.5, 1)).alias("underspend_days"),
        F.count(F.when(F.col("spend") > F.col("_avg") * 1.5, 1)).alias("overspend_days"),
        F.count(F.lit(1)).alias("total_days")).where(F.col("total_days") >= min_days)
    cv = safe_div("spend_std", "avg_daily_spend")
    return g.select(F.col("campaign_name").alias("campaign"), "avg_daily_spend", "spend_std", cv.alias("cv"),
                    "underspend_days", "overspend_days", "total_days",
                    F.when(cv < 0.3, "stable").when(cv < 0.5, "variable").otherwise("erratic").alias("pacing"))


def _marginal(ctx, min_days: int = 7) -> DataFrame:
    d = _daily(ctx).select("date_start", "spend", "purchases")
    n = d.agg(F.count(F.lit(1))).scalar()
    # one row per day: the calendar bounds the unpartitioned window
    w = Window.orderBy("date_start")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    roll = w.rowsBetween(-2, 0)
    return d.where(n >= min_days).select(
        F.col("date_start").alias("date"), "spend", "purchases", safe_div("spend", "purchases").alias("daily_cpa"),
        safe_div(F.sum("spend").over(run), F.sum("purchases").over(run)).alias("avg_cpa"),
        safe_div(F.sum("spend").over(roll), F.sum("purchases").over(roll)).alias("marginal_cpa_3d"))


def ma_marginal_cpa(ctx) -> DataFrame:
    return _marginal(ctx)


def ma_marginal_trend(ctx, span: int = 7) -> DataFrame:
    m = _last_rows(_marginal(ctx), "date")
    a = m.agg(F.count(F.lit(1)).alias("_n"), F.avg(F.when(F.col("_r") <= span, F.col("marginal_cpa_3d"))).alias("recent"),
              F.avg(F.when((F.col("_r") > span) & (F.col("_r") <= 2 * span), F.col("marginal_cpa_3d"))).alias("previous"))
    r, p = F.col("recent"), F.col("previous")
    trend = (F.when(F.col("_n") < 2 * span, "insufficient_data").when(r > p * 1.1, "rising")
             .when(r < p * 0.9, "falling").otherwise("stable"))
    return a.select(trend.alias("trend"), F.when(F.col("_n") >= 2 * span, r).alias("recent_marginal_cpa"),
                    F.when(F.col("_n") >= 2 * span, p).alias("previous_marginal_cpa"))
