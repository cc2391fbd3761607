"""Search / shopping ads operators over campaign, keyword, search-term, ad and auction rows.

All ratios are sum/sum (never means of ratios) and use ``safe_div``.  Values
the reference rounds *before* reusing them in a rule (moving averages of
rounded daily values, drift percentages feeding a status, auction rates
feeding a threat level) are rounded half-to-even here too (``bround``);
everything else is left unrounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.core import nonblank, ratio_metrics, safe_div, semaphore, sum0, sunday_week_key, weighted_avg

METRICS = ["impressions", "clicks", "cost", "conversions", "conversion_value", "all_conversions",
           "all_conversion_value"]
# Text of the search-ads report rules.
DAYS = ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']
STRENGTH_LEVELS = ['Excellent', 'Good', 'Average', 'Poor']
COMPONENTS = ['expected_ctr', 'ad_relevance', 'landing_page_experience']
IS_RANK_TEXT = 'Rank loss dominante — mejorar QS o subir bid'
IS_BUDGET_TEXT = 'Budget loss dominante — aumentar presupuesto'
IS_MIXED_TEXT = 'Pérdida mixta rank + budget'
ASSET_TEXT_POOR = 'Faltan assets mínimos. Agregar: 5+ headlines, 5+ descriptions, 3+ images, 1+ video'
ASSET_TEXT_AVERAGE = 'Agregar más variaciones de headlines y al menos 1 video para mejorar a Good'
ASSET_TEXT_GOOD = 'Agregar 2+ headlines y 1+ video para alcanzar Excellent'
ASSET_TEXT_EXCELLENT = 'Excelente cobertura de assets'
ROW_ORDER = ["date", "hour_of_day", "device", "adset_name", "ad_name"]


def _m(df: DataFrame, c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)) if c in df.columns else F.lit(0)


def _sums(df: DataFrame) -> list:
    return [
        sum0(F.coalesce(F.col("impressions"), F.lit(0)).cast("long")).cast("long").alias("impressions"),
        sum0(F.coalesce(F.col("clicks"), F.lit(0)).cast("long")).cast("long").alias("clicks"),
        *[sum0(_m(df, c).cast("double")).cast("double").alias(c) for c in METRICS[2:]],
    ]


def _ratios() -> list:
    return ratio_metrics(("ctr", "cpc", "cpa", "roas", "conv_rate"))


def first_value(c: str, order: list) -> Column:
    """First non-null value in row order (``min_by`` skips rows whose sort key is null)."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*[F.col(o) for o in order])))


def aggregate_by(rows: DataFrame, key: str, carry: list | None = None) -> DataFrame:
    """Sums, row count, ratios and first non-null carried columns per key (null keys dropped)."""
    order = [c for c in ROW_ORDER if c in rows.columns] or [key]
    carry = [c for c in (carry or []) if c in rows.columns]
    g = rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        *_sums(rows), F.count(F.lit(1)).alias("rows"), *[first_value(c, order).alias(c) for c in carry])
    return g.select("*", *_ratios())


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(*_sums(rows)).select("*", *_ratios())


def ga_totals(ctx) -> DataFrame:
    return totals(ctx.campaign)


def ga_aggregate_by(ctx, key: str = "device") -> DataFrame:
    return aggregate_by(ctx.campaign, key, ["campaign_type", "bid_strategy_type"])


def by_date(rows: DataFrame) -> DataFrame:
    g = rows.where(F.col("date").isNotNull()).groupBy("date").agg(*_sums(rows))
    return g.select("date", "impressions", "clicks", "cost", "conversions", "conversion_value",
                    (safe_div("clicks", "impressions") * 100).alias("ctr"),
                    safe_div("cost", "conversions").alias("cpa"), safe_div("conversion_value", "cost").alias("roas"))


def ga_by_date(ctx) -> DataFrame:
    return by_date(ctx.campaign)


def ga_date_range(ctx) -> DataFrame:
    return ctx.campaign.agg(F.min("date").alias("date_min"), F.max("date").alias("date_max"))


def ga_conversion_lag_flag(ctx, as_of: str | None = None) -> DataFrame:
    """True when the data reaches into the last 7 days before ``as_of`` (default: today)."""
    ref = F.to_date(F.lit(as_of)) if as_of else F.current_date()
    mx = ctx.campaign.agg(F.max("date").alias("date_max"))
    return mx.select("date_max", F.coalesce(F.datediff(ref, "date_max") <= 7, F.lit(False))
                     .alias("conversion_lag_warning"))


def ga_dashboard(ctx, as_of: str | None = None) -> DataFrame:
    """Totals plus second-half vs first-half change of cost, conversions, ROAS and CPA."""
    rows = ctx.campaign
    rng = rows.agg(F.min("date").alias("dmin"), F.max("date").alias("dmax"))
    dmin, dmax = rng.select("dmin").scalar(), rng.select("dmax").scalar()
    days = F.datediff(dmax, dmin)
    mid = F.date_add(dmin, F.floor(days / 2).cast("int"))
    first = F.col("date") < mid
    second = F.col("date") >= mid

    def half(cond, suffix):
        return [sum0(F.when(cond, F.col("cost"))).alias("cost" + suffix),
                sum0(F.when(cond, F.col("conversions"))).alias("conv" + suffix),
                sum0(F.when(cond, F.col("conversion_value"))).alias("value" + suffix),
                F.count(F.when(cond, 1)).alias("n" + suffix)]

    t = rows.agg(*_sums(rows), *half(first, "1"), *half(second, "2"))
    ok = (days > 7) & (F.col("n1") > 0) & (F.col("n2") > 0)

    def change(a1, a2):
        return F.when(ok & (a1 > 0), (a2 - a1) / a1 * 100)

    roas1, roas2 = safe_div("value1", "cost1"), safe_div("value2", "cost2")
    cpa1, cpa2 = safe_div("cost1", "conv1"), safe_div("cost2", "conv2")
    ref = F.to_date(F.lit(as_of)) if as_of else F.current_date()
    return t.where(F.col("impressions") > 0).select(
        "cost", "conversions", "conversion_value", safe_div("conversion_value", "cost").alias("roas"),
        safe_div("cost", "conversions").alias("cpa"), "impressions", "clicks",
        (safe_div("clicks", "impressions") * 100).alias("ctr"), safe_div("cost", "clicks").alias("avg_cpc"),
        (safe_div("conversions", "clicks") * 100).alias("conv_rate"),
        dmin.alias("date_min"), dmax.alias("date_max"),
        F.coalesce(F.datediff(ref, dmax) <= 7, F.lit(False)).alias("conversion_lag_warning"),
        change(F.col("cost1"), F.col("cost2")).alias("cost_change_pct"),
        change(F.col("conv1"), F.col("conv2")).alias("conversions_change_pct"),
        change(roas1, roas2).alias("roas_change_pct"),
        change(cpa1, cpa2).alias("cpa_change_pct"))


def ga_benchmarks(ctx) -> DataFrame:
    """Traffic lights: CTR, CPC (always yellow), conversion rate, ROAS, impression share, quality score."""
    t = totals(ctx.campaign)
    kw = ctx.keyword.where(F.col("quality_score").isNotNull() & (F.col("quality_score") > 0))
    w = F.coalesce(F.col("impressions").cast("double"), F.lit(1.0))
    qs = kw.agg(F.sum(F.col("quality_score") * w).alias("qw"), F.sum(w).alias("w"),
                F.avg("quality_score").alias("qm"), F.count(F.lit(1)).alias("n"))
    avg_qs = F.when(qs.select("n").scalar() > 0,
                    F.when(qs.select("w").scalar() > 0, qs.select("qw").scalar() / qs.select("w").scalar())
                    .otherwise(qs.select("qm").scalar()))
    avg_is = ctx.campaign.agg(F.avg("search_impression_share")).scalar()
    base = t.where(F.col("impressions") > 0).select(
        F.col("ctr"), F.col("cpc"), F.col("conv_rate"), F.col("roas"),
        avg_is.alias("is"), avg_qs.alias("qs"))
    rows = base.select(F.explode(F.array(
        F.struct(F.lit("CTR").alias("name"), F.col("ctr").alias("value"), F.lit("%").alias("unit"),
                 semaphore("ctr", 3, 1.5).alias("status")),
        F.struct(F.lit("CPC").alias("name"), F.col("cpc").alias("value"), F.lit("").alias("unit"),
                 F.lit("yellow").alias("status")),
        F.struct(F.lit("Conv Rate").alias("name"), F.col("conv_rate").alias("value"), F.lit("%").alias("unit"),
                 semaphore("conv_rate", 3, 1).alias("status")),
        F.struct(F.lit("ROAS").alias("name"), F.col("roas").alias("value"), F.lit("x").alias("unit"),
                 semaphore("roas", 4, 2).alias("status")),
        F.struct(F.lit("Impression Share").alias("name"), F.col("is").alias("value"), F.lit("%").alias("unit"),
                 semaphore("is", 80, 50).alias("status")),
        F.struct(F.lit("Quality Score").alias("name"), F.col("qs").alias("value"), F.lit("/10").alias("unit"),
                 semaphore("qs", 7, 5).alias("status")),
    )).alias("m")).select("m.*")
    return rows.where(F.col("value").isNotNull())


def _daily(ctx, min_days: int = 3) -> DataFrame:
    d = by_date(ctx.campaign)
    n = d.agg(F.count(F.lit(1))).scalar()
    return d.where(n >= min_days)


def ga_daily(ctx) -> DataFrame:
    d = _daily(ctx)
    mx = d.agg(F.max("date")).scalar()
    return d.select("date", "cost", "conversions", "roas", "cpa", "ctr",
                    (F.col("date") > F.date_sub(mx, 7)).alias("conversion_lag_warning"))


def ga_daily_ma7(ctx) -> DataFrame:
    """7-row moving mean of the 2-decimal daily ROAS and CPA (full windows only)."""
    d = _daily(ctx).select("date", F.bround("roas", 2).alias("_roas"), F.bround("cpa", 2).alias("_cpa"))
    # one row per day: the calendar bounds the unpartitioned window
    w = Window.orderBy("date")
    frame = w.rowsBetween(-6, 0)
    return (d.withColumn("_rn", F.row_number().over(w))
            .select("date", F.avg("_roas").over(frame).alias("roas_ma7"), F.avg("_cpa").over(frame).alias("cpa_ma7"),
                    "_rn").where(F.col("_rn") >= 7).drop("_rn"))


def ga_daily_trend(ctx, min_days: int = 6) -> DataFrame:
    d = _daily(ctx).select("date", F.bround("roas", 2).alias("_roas"))
    w = Window.orderBy("date")
    d = d.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    half = F.floor(F.col("_n") / 2)
    a = d.agg(F.avg(F.when(F.col("_rn") <= half, F.col("_roas"))).alias("first_half_roas"),
              F.avg(F.when(F.col("_rn") > half, F.col("_roas"))).alias("second_half_roas"),
              F.max("_n").alias("_n"))
    f, s = F.col("first_half_roas"), F.col("second_half_roas")
    trend = (F.when(F.coalesce(F.col("_n"), F.lit(0)) < min_days, "flat").when(s > f * 1.05, "up")
             .when(s < f * 0.95, "down").otherwise("flat"))
    return a.select(trend.alias("trend"), "first_half_roas", "second_half_roas")


def ga_campaigns(ctx) -> DataFrame:
    g = aggregate_by(ctx.campaign, "campaign_name", ["campaign_type"])
    tot = g.agg(F.sum("cost")).scalar()
    return g.select(F.col("campaign_name").alias("name"), F.coalesce("campaign_type", F.lit("Unknown")).alias("type"),
                    "cost", "impressions", "clicks", "conversions", "conversion_value", "roas", "cpa", "ctr", "cpc",
                    "conv_rate", semaphore("roas", 4, 2).alias("roas_status"),
                    (safe_div(F.col("cost"), tot) * 100).alias("cost_share_pct"))


def ga_budget_vs_results(ctx, gap: float = 10.0) -> DataFrame:
    g = aggregate_by(ctx.campaign, "campaign_name")
    tc = g.agg(F.sum("cost")).scalar()
    tv = g.agg(F.sum("conversion_value")).scalar()
    n = g.agg(F.count(F.lit(1))).scalar()
    cs = safe_div(F.col("cost"), tc) * 100
    rs = F.when(tv > 0, safe_div(F.col("conversion_value"), tv) * 100).otherwise(F.lit(0.0))
    out = g.select(F.col("campaign_name").alias("campaign"), "cost", "roas", "conversions",
                   cs.alias("cost_share_pct"), rs.alias("revenue_share_pct"))
    verdict = (F.when(F.col("cost_share_pct") > F.col("revenue_share_pct") + gap, "ineficiente")
               .when(F.col("revenue_share_pct") > F.col("cost_share_pct") + gap, "eficiente"))
    return out.withColumn("verdict", verdict).where(n >= 2)


def strategy_label(c: Column) -> Column:
    """``TARGET_CPA`` -> ``Target Cpa`` (title case after the prefix rewrite)."""
    s = F.regexp_replace(F.regexp_replace(c, "TARGET_", "Target "), "MAXIMIZE_", "Max ")
    return F.initcap(F.regexp_replace(s, "_", " "))


def _drift_status(strategy: Column, target_cpa: Column, target_roas: Column, cpa: Column, roas: Column):
    is_cpa = F.upper(strategy).contains("CPA")
    is_roas = ~is_cpa & F.upper(strategy).contains("ROAS")
    target = F.when(is_cpa, target_cpa).when(is_roas, target_roas)
    actual = F.when(is_cpa, cpa).when(is_roas, roas)
    drift = F.when(target.isNotNull() & (target > 0), F.bround((actual - target) / target * 100, 1))
    status = (F.when(drift.isNull(), "unknown")
              .when(is_cpa & (drift < -10), "outperforming").when(is_cpa & (drift > 20), "underperforming")
              .when(is_roas & (drift > 10), "outperforming").when(is_roas & (drift < -20), "underperforming")
              .otherwise("on_target"))
    return target, actual, drift, status


def ga_bidding_status(ctx) -> DataFrame:
    g = aggregate_by(ctx.campaign, "campaign_name", ["bid_strategy_type", "target_cpa", "target_roas"])
    g = g.where(nonblank("bid_strategy_type"))
    target, actual, drift, status = _drift_status(F.col("bid_strategy_type"), F.col("target_cpa"),
                                                  F.col("target_roas"), F.col("cpa"), F.col("roas"))
    return g.select(F.col("campaign_name").alias("campaign"), strategy_label(F.col("bid_strategy_type")).alias("strategy"),
                    target.alias("target"), actual.alias("actual"), drift.alias("drift_pct"), status.alias("status"))


def ga_bidding_summary(ctx) -> DataFrame:
    s = ga_bidding_status(ctx)
    return s.agg(F.count(F.lit(1)).alias("total"),
                 F.count(F.when(F.col("status") == "outperforming", 1)).alias("outperforming"),
                 F.count(F.when(F.col("status") == "on_target", 1)).alias("on_target"),
                 F.count(F.when(F.col("status") == "underperforming", 1)).alias("underperforming")).where("total > 0")


def _qs_rows(ctx) -> DataFrame:
    return ctx.keyword.where(F.col("quality_score").isNotNull() & (F.col("quality_score") > 0))


def ga_qs_histogram(ctx, min_rows: int = 5) -> DataFrame:
    q = _qs_rows(ctx)
    n = q.agg(F.count(F.lit(1))).scalar()
    counts = q.groupBy(F.col("quality_score").cast("int").alias("qs")).agg(F.count(F.lit(1)).alias("count"))
    scale = ctx.spark.range(1, 11).select(F.col("id").cast("int").alias("qs"))
    return scale.join(counts, "qs", "left").select("qs", F.coalesce("count", F.lit(0)).alias("count")).where(n >= min_rows)


def ga_qs_weighted(ctx) -> DataFrame:
    q = _qs_rows(ctx)
    w = F.greatest(F.coalesce(F.col("impressions").cast("double"), F.lit(0.0)), F.lit(1.0))
    return q.agg(weighted_avg("quality_score", w).alias("avg_qs_weighted"),
                 F.count(F.lit(1)).alias("keywords")).where("keywords > 0")


def ga_qs_components(ctx) -> DataFrame:
    q = _qs_rows(ctx)
    stacked = q.select(F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("grade"))
                                           for c in COMPONENTS])).alias("s")).select("s.*")
    g = F.regexp_replace(F.lower("grade"), "_", " ")
    return (stacked.where(nonblank("grade")).groupBy("component").agg(
        F.count(F.when(g == "above average", 1)).alias("above"),
        F.count(F.when(g == "average", 1)).alias("average"),
        F.count(F.when(g == "below average", 1)).alias("below")))


def ga_low_qs_spend(ctx, max_qs: int = 4, k: int = 10) -> DataFrame:
    q = _qs_rows(ctx).where((F.col("quality_score") <= max_qs) & (F.coalesce("cost", F.lit(0.0)) > 0))
    weak = F.lit("unknown")
    for c in reversed(COMPONENTS):
        weak = F.when(F.lower(F.col(c)).contains("below"), F.lit(c)).otherwise(weak)
    out = q.select(F.coalesce("keyword", F.lit("N/A")).alias("keyword"), F.col("quality_score").alias("qs"),
                   "cost", weak.alias("weak_component"))
    return out.orderBy(F.col("cost").desc(), "keyword", "qs", "weak_component").limit(k)


def ga_top_keywords(ctx, k: int = 20, min_rows: int = 3) -> DataFrame:
    kw = ctx.keyword.where(F.coalesce("conversions", F.lit(0.0)) >= 1)
    n = kw.agg(F.count(F.lit(1))).scalar()
    cost, conv = F.coalesce("cost", F.lit(0.0)), F.coalesce("conversions", F.lit(0.0))
    out = kw.select(
        F.coalesce("keyword", F.lit("N/A")).alias("keyword"), conv.alias("conversions"), cost.alias("cost"),
        safe_div(cost, conv).alias("cpa"), (safe_div(conv, "clicks") * 100).alias("conv_rate"),
        (safe_div("clicks", "impressions") * 100).alias("ctr"), safe_div(cost, "clicks").alias("cpc"),
        "quality_score",
        F.when(cost > 0, semaphore(safe_div("conversion_value", cost), 4, 2)).otherwise(F.lit("gray")).alias("cpa_status"),
        F.col("clicks").alias("_clicks"), F.col("impressions").alias("_impr"), F.col("conversion_value").alias("_val"))
    return (out.where(n >= min_rows)
            .orderBy(F.col("conversions").desc(), F.col("cost").desc(), "keyword", F.col("_clicks").desc(),
                     F.col("_impr").desc(), "quality_score", "_val")
            .limit(k).drop("_clicks", "_impr", "_val"))


def ga_impression_share(ctx) -> DataFrame:
    """Per campaign: first non-null share values (not averaged) and a rank-vs-budget diagnosis."""
    carry = ["search_impression_share", "search_lost_is_budget", "search_lost_is_rank", "search_top_is",
             "search_abs_top_is"]
    g = aggregate_by(ctx.campaign, "campaign_name", carry).where(F.col("search_impression_share").isNotNull())
    lr, lb = F.col("search_lost_is_rank"), F.col("search_lost_is_budget")
    both = F.coalesce(lr != 0, F.lit(False)) & F.coalesce(lb != 0, F.lit(False))
    diag = (F.when(both & (lr > lb), IS_RANK_TEXT).when(both & (lb > lr), IS_BUDGET_TEXT)
            .when(both, IS_MIXED_TEXT).otherwise(F.lit("")))
    is_ = F.col("search_impression_share")
    status = F.when(F.coalesce(is_ != 0, F.lit(False)), semaphore(is_, 80, 50)).otherwise(F.lit("gray"))
    out = g.select(F.col("campaign_name").alias("campaign"), is_.alias("is"), lb.alias("lost_budget"),
                   lr.alias("lost_rank"), F.col("search_top_is").alias("top_is"),
                   F.col("search_abs_top_is").alias("abs_top_is"), status.alias("is_status"), diag.alias("diagnosis"))
    avg = out.agg(F.avg(F.bround("is", 1))).scalar()
    return out.select("*", avg.alias("account_avg_is"))


def _zero_conv_terms(ctx) -> DataFrame:
    return ctx.search_term.where((F.coalesce("conversions", F.lit(0.0)) == 0) & (F.coalesce("cost", F.lit(0.0)) > 0))


def ga_wasted_spend(ctx) -> DataFrame:
    z = _zero_conv_terms(ctx)
    total = ctx.search_term.agg(sum0("cost")).scalar()
    return z.agg(sum0("cost").alias("total_wasted"), F.count(F.lit(1)).alias("total_zero_conv_terms")).where(
        "total_zero_conv_terms > 0").select("total_wasted", (safe_div(F.col("total_wasted"), total) * 100)
                                            .alias("wasted_pct"), "total_zero_conv_terms")


def ga_wasted_terms(ctx, k: int = 20) -> DataFrame:
    z = _zero_conv_terms(ctx)
    return (z.select(F.coalesce("search_term", F.lit("N/A")).alias("search_term"), "cost",
                     F.coalesce("clicks", F.lit(0)).cast("long").alias("clicks"), F.lit(0).alias("conversions"))
            .orderBy(F.col("cost").desc(), "search_term", F.col("clicks").desc()).limit(k))


def ga_keyword_opportunities(ctx, k: int = 20) -> DataFrame:
    st = ctx.search_term
    opp = st.where((F.coalesce("conversions", F.lit(0.0)) >= 1)
                   & ~F.coalesce(F.col("search_term_status").isin("Added", "ADDED", "Excluded", "EXCLUDED"),
                                 F.lit(False)))
    tot = opp.agg(F.count(F.lit(1)).alias("n"), sum0("conversions").alias("c"))
    conv, cost = F.coalesce("conversions", F.lit(0.0)), F.coalesce("cost", F.lit(0.0))
    out = opp.select(F.coalesce("search_term", F.lit("N/A")).alias("search_term"), conv.alias("conversions"),
                     cost.alias("cost"), safe_div(cost, conv).alias("cpa"),
                     (safe_div(conv, "clicks") * 100).alias("conv_rate"),
                     F.coalesce("search_term_status", F.lit("None")).alias("status"),
                     F.col("clicks").alias("_clicks"))
    return (out.orderBy(F.col("conversions").desc(), F.col("cost").desc(), "search_term", F.col("_clicks").desc(),
                        "status").limit(k).drop("_clicks")
            .select("*", tot.select("n").scalar().alias("total_opportunities"),
                    tot.select("c").scalar().alias("potential_conversions")))


def _ad_source(ctx) -> DataFrame:
    return ctx.ad if ctx.has("ad") and ctx.ad.limit(1).count() > 0 else ctx.campaign


def ga_ad_ranking(ctx, k: int = 15) -> DataFrame:
    src = _ad_source(ctx)
    key = "ad_group_name" if "ad_group_name" in src.columns and \
        src.where(nonblank("ad_group_name")).limit(1).count() > 0 else "campaign_name"
    has_conv = src.where(F.coalesce("conversions", F.lit(0.0)) >= 1).limit(1).count() > 0
    sel = src.where((F.coalesce("conversions", F.lit(0.0)) >= 1) if has_conv else (F.coalesce("clicks", F.lit(0)) >= 1))
    first_rsa = F.trim(F.split(F.col("rsa_headlines"), r"\|").getItem(0)) if "rsa_headlines" in src.columns else F.lit(None)
    head = F.coalesce(F.col("headline_1") if "headline_1" in src.columns else F.lit(None), first_rsa, F.lit("N/A"))
    conv, cost = F.coalesce("conversions", F.lit(0.0)), F.coalesce("cost", F.lit(0.0))
    out = sel.select(F.coalesce(F.col(key), F.lit("N/A")).alias("ad_group"), head.alias("headline"),
                     F.coalesce("impressions", F.lit(0)).cast("long").alias("impressions"),
                     F.coalesce("clicks", F.lit(0)).cast("long").alias("clicks"), conv.alias("conversions"),
                     (safe_div("clicks", "impressions") * 100).alias("ctr"),
                     (safe_div(conv, "clicks") * 100).alias("conv_rate"), safe_div(cost, conv).alias("cpa"),
                     F.col("ad_strength") if "ad_strength" in src.columns else F.lit(None).cast("string").alias("ad_strength"),
                     cost.alias("_cost"))
    return (out.orderBy(F.col("conversions").desc(), F.col("_cost").desc(), "ad_group", "headline",
                        F.col("clicks").desc(), F.col("impressions").desc(), "ad_strength")
            .limit(k).drop("_cost"))


def _strength(c: Column) -> Column:
    s = F.lower(c)
    return (F.when(s.contains("excellent"), "Excellent").when(s.contains("good"), "Good")
            .when(s.contains("average"), "Average").when(s.contains("poor"), "Poor").otherwise(F.trim(c)))


def ga_ad_strength(ctx) -> DataFrame:
    src = _ad_source(ctx).where(nonblank("ad_strength")).withColumn("strength", _strength(F.col("ad_strength")))
    n = src.agg(F.count(F.lit(1))).scalar()
    g = src.groupBy("strength").agg(
        F.count(F.lit(1)).alias("count"), sum0("clicks").alias("_c"), sum0("impressions").alias("_i"),
        sum0("conversions").alias("_v"), sum0("cost").alias("_k"))
    levels = ctx.spark.createDataFrame([(x, i) for i, x in enumerate(STRENGTH_LEVELS)], "strength string, level int")
    j = levels.join(g, "strength", "left")
    cnt = F.coalesce("count", F.lit(0))
    return j.select("strength", "level", cnt.alias("count"),
                    F.when(cnt > 0, cnt * 100.0 / n).otherwise(F.lit(0.0)).alias("pct"),
                    F.when(cnt > 0, safe_div("_c", "_i") * 100).alias("avg_ctr"),
                    F.when(cnt > 0, F.when(F.col("_v") > 0, F.col("_k") / F.col("_v"))).alias("avg_cpa"))


def ga_poor_ads(ctx, k: int = 5) -> DataFrame:
    src = _ad_source(ctx).where(nonblank("ad_strength") & (_strength(F.col("ad_strength")) == "Poor"))
    grp = F.col("ad_group_name") if "ad_group_name" in src.columns else F.lit(None)
    return (src.select(F.coalesce(grp, F.lit("N/A")).alias("ad_group"), F.lit("Poor").alias("ad_strength"),
                       F.coalesce("cost", F.lit(0.0)).alias("cost"))
            .orderBy(F.col("cost").desc(), "ad_group").limit(k))


def ga_funnel(ctx) -> DataFrame:
    t = totals(ctx.campaign).where(F.col("impressions") > 0)

    def step(order, name, value, rate, pct):
        return F.struct(F.lit(order).alias("step_order"), F.lit(name).alias("step"),
                        value.cast("double").alias("value"), rate.cast("double").alias("rate_from_prev"),
                        pct.cast("double").alias("pct_of_top"))

    steps = t.select(
        safe_div("cost", "impressions").alias("_cpm"), "cpc", "cpa",
        (safe_div("conversions", "impressions") * 100).alias("overall_conversion_rate"),
        F.explode(F.array(
            step(1, "Impressions", F.col("impressions"), F.lit(None), F.lit(100.0)),
            step(2, "Clicks", F.col("clicks"), F.col("ctr"), safe_div("clicks", "impressions") * 100),
            step(3, "Conversions", F.col("conversions"), F.col("conv_rate"),
                 safe_div("conversions", "impressions") * 100))).alias("s"))
    return steps.select("s.*", (F.col("_cpm") * 1000).alias("cpm"), "cpc", "cpa", "overall_conversion_rate")


def _dow_name(rows: DataFrame) -> Column:
    raw = F.upper(F.trim(F.col("day_of_week"))) if "day_of_week" in rows.columns else F.lit(None)
    mapped = F.when(raw.isin([d.upper() for d in DAYS]), F.initcap(raw)).otherwise(F.initcap(raw))
    return F.coalesce(mapped, F.date_format("date", "EEEE"))


def ga_dow(ctx) -> DataFrame:
    rows = ctx.campaign
    d = rows.withColumn("day", _dow_name(rows)).where(F.col("day").isNotNull())
    g = d.groupBy("day").agg(sum0("cost").alias("cost"), sum0("conversions").alias("conversions"),
                             sum0("clicks").alias("_c"), sum0("impressions").alias("_i"))
    order = F.array_position(F.array(*[F.lit(x) for x in DAYS]), F.col("day")).cast("int")
    return g.where(order > 0).select("day", (order - 1).alias("day_order"), "cost", "conversions",
                                     safe_div("cost", "conversions").alias("cpa"),
                                     (safe_div("_c", "_i") * 100).alias("ctr"))


def ga_hour(ctx) -> DataFrame:
    rows = ctx.campaign.where(F.col("hour_of_day").isNotNull())
    g = rows.groupBy(F.col("hour_of_day").cast("int").alias("hour")).agg(
        sum0("cost").alias("cost"), sum0("conversions").alias("conversions"))
    return g.select("hour", "cost", "conversions", safe_div("cost", "conversions").alias("cpa"))


def ga_best_worst(ctx) -> DataFrame:
    """Best / worst weekday and the 3 best / worst hours by 2-decimal CPA (0 CPA sorts last for best)."""
    d = ga_dow(ctx).withColumn("_cpa", F.bround("cpa", 2))
    h = ga_hour(ctx).withColumn("_cpa", F.bround("cpa", 2))
    best_key = F.when(F.col("_cpa") > 0, F.col("_cpa")).otherwise(F.lit(99999.0))
    best_day = d.orderBy(best_key, "day_order").select("day").limit(1).scalar()
    worst_day = d.orderBy(F.col("_cpa").desc(), "day_order").select("day").limit(1).scalar()
    best_h = h.orderBy(best_key, "hour").limit(3).agg(F.sort_array(F.collect_list(
        F.struct(best_key.alias("k"), F.col("hour")))).alias("_l")).select(
        F.transform("_l", lambda e: e["hour"]).alias("v")).scalar()
    worst_h = h.orderBy(F.col("_cpa").desc(), "hour").limit(3).agg(F.sort_array(F.collect_list(
        F.struct((-F.col("_cpa")).alias("k"), F.col("hour")))).alias("_l")).select(
        F.transform("_l", lambda e: e["hour"]).alias("v")).scalar()
    return ctx.spark.range(1).select(best_day.alias("best_day"), worst_day.alias("worst_day"),
                                     best_h.alias("best_hours"), worst_h.alias("worst_hours"))


def ga_geo(ctx, k: int = 15) -> DataFrame:
    rows = ctx.campaign
    cands = [c for c in ("city", "region", "country", "location") if c in rows.columns]
    counts = rows.agg(*[F.count(F.when(nonblank(c), 1)).alias(c) for c in cands]).first()
    level = next((c for c in cands if counts[c] > 0), None)
    if level is None:
        return ctx.spark.createDataFrame([], "location string, cost double, conversions double, cpa double, "
                                             "roas double, ctr double, cost_share_pct double, cpa_status string, "
                                             "geo_level string")
    g = aggregate_by(rows, level)
    tot = g.agg(F.sum("cost")).scalar()
    return (g.select(F.col(level).alias("location"), "cost", "conversions", "cpa", "roas", "ctr",
                     (safe_div(F.col("cost"), tot) * 100).alias("cost_share_pct"),
                     semaphore("roas", 4, 2).alias("cpa_status"), F.lit(level).alias("geo_level"))
            .orderBy(F.col("conversions").desc(), "location").limit(k))


def device_label(c: Column) -> Column:
    s = c
    for a, b in (("MOBILE", "Mobile"), ("DESKTOP", "Desktop"), ("TABLET", "Tablet"),
                 ("Mobile phones", "Mobile"), ("Computers", "Desktop"), ("Tablets", "Tablet")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def ga_device(ctx) -> DataFrame:
    g = aggregate_by(ctx.campaign, "device")
    tc = g.agg(F.sum("cost")).scalar()
    tv = g.agg(F.sum("conversions")).scalar()
    return g.select(device_label(F.col("device")).alias("device"), "cost", "impressions", "clicks", "conversions",
                    "ctr", "cpc", "conv_rate", "cpa", "roas", (safe_div(F.col("cost"), tc) * 100).alias("cost_share_pct"),
                    F.when(tv > 0, safe_div(F.col("conversions"), tv) * 100).otherwise(F.lit(0.0)).alias("conv_share_pct"))


def ga_asset_groups(ctx) -> DataFrame:
    rows = ctx.campaign.where(nonblank("asset_group_name"))
    g = aggregate_by(rows, "asset_group_name", ["ad_strength"])
    return g.select(F.col("asset_group_name").alias("name"), "impressions", "clicks", "conversions", "cost", "ctr",
                    "cpa", "roas", "ad_strength")


def ga_asset_group_strength(ctx) -> DataFrame:
    rows = ctx.campaign.where(nonblank("asset_group_name") & nonblank("ad_strength"))
    order = [c for c in ROW_ORDER if c in rows.columns]
    g = rows.groupBy("asset_group_name").agg(
        F.min_by(F.col("ad_strength"), F.struct(*[F.col(o) for o in order])).alias("_s"))
    s = F.lower("_s")
    rec = (F.when(s.contains("poor"), ASSET_TEXT_POOR).when(s.contains("average"), ASSET_TEXT_AVERAGE)
           .when(s.contains("good"), ASSET_TEXT_GOOD).otherwise(ASSET_TEXT_EXCELLENT))
    return g.select(F.col("asset_group_name").alias("name"), F.trim("_s").alias("ad_strength"), rec.alias("recommendation"))


def ga_brand_overlap(ctx, brand_pattern: str = "(?i)brand") -> DataFrame:
    """Search terms seen both in Performance Max and in branded Search campaigns (PMax side converting)."""
    st = ctx.search_term.withColumn("term", F.lower(F.trim("search_term"))).where(nonblank("term"))
    ctype = F.col("campaign_type") if "campaign_type" in st.columns else F.lit(None)
    pmax = ((ctype == "PMax") | F.lower("campaign_name").contains("pmax"))
    brand = (ctype == "Search") & F.col("campaign_name").rlike(brand_pattern)
    p = st.where(pmax).groupBy("term").agg(sum0("conversions").alias("pmax_conversions"),
                                           sum0("cost").alias("pmax_cost"))
    b = st.where(brand).groupBy("term").agg(sum0("conversions").alias("search_conversions"),
                                            sum0("cost").alias("search_cost"))
    return p.join(b, "term").where(F.col("pmax_conversions") > 0)


def _strategy_rows(rows: DataFrame) -> DataFrame:
    return rows.where(nonblank("bid_strategy_type"))


def ga_learning_period(ctx, min_conversions: float = 30.0, window_days: int = 14) -> DataFrame:
    rows = ctx.campaign.where(F.col("date").isNotNull())
    mx = rows.agg(F.max("date")).scalar()
    recent = rows.where(F.col("date") >= F.date_sub(mx, window_days))
    g = aggregate_by(recent, "campaign_name", ["bid_strategy_type"]).where(nonblank("bid_strategy_type"))
    c = F.col("conversions")
    learning = c < min_conversions
    est = (F.when(learning & (c > 0), F.bround(safe_div(F.lit(min_conversions) - c, c / window_days), 0))
           .when(c == 0, F.lit(999.0)).otherwise(F.lit(0.0)))
    return g.select(F.col("campaign_name").alias("campaign"),
                    F.initcap(F.regexp_replace(F.regexp_replace("bid_strategy_type", "TARGET_", "Target "), "_", " "))
                    .alias("strategy"), c.alias("conv_last_14d"),
                    F.when(learning, "learning").otherwise("stable").alias("status"),
                    F.when(learning, est).otherwise(F.lit(0.0)).alias("est_days_remaining"))


def ga_learning_summary(ctx, min_conversions: float = 30.0) -> DataFrame:
    s = ga_learning_period(ctx, min_conversions)
    return s.agg(F.count(F.lit(1)).alias("total_smart_bidding"),
                 F.count(F.when(F.col("status") == "learning", 1)).alias("in_learning"),
                 F.count(F.when(F.col("status") == "stable", 1)).alias("stable"))


def _weekly(ctx) -> DataFrame:
    rows = _strategy_rows(ctx.campaign).where(F.col("date").isNotNull() & nonblank("campaign_name"))
    order = [c for c in ROW_ORDER if c in rows.columns]
    info = rows.groupBy("campaign_name").agg(
        F.min_by(F.struct("bid_strategy_type", "target_cpa", "target_roas"),
                 F.struct(*[F.col(o) for o in order])).alias("_i"))
    wk = rows.groupBy("campaign_name", sunday_week_key("date").alias("week")).agg(
        sum0("cost").alias("_cost"), sum0("conversions").alias("_conv"), sum0("conversion_value").alias("_val"))
    j = wk.join(info, "campaign_name")
    strat = F.upper(F.col("_i.bid_strategy_type"))
    is_cpa = strat.contains("CPA")
    is_roas = ~is_cpa & strat.contains("ROAS")
    target = F.when(is_cpa, F.col("_i.target_cpa")).when(is_roas, F.col("_i.target_roas"))
    actual = F.when(is_cpa, safe_div("_cost", "_conv")).when(is_roas, safe_div("_val", "_cost"))
    drift = F.when(F.coalesce(target != 0, F.lit(False)), F.bround(safe_div(actual - target, target) * 100, 1))
    return j.where(is_cpa | is_roas).select(
        F.col("campaign_name").alias("campaign"), "week", F.when(is_cpa, "cpa").otherwise("roas").alias("metric"),
        actual.alias("actual"), drift.alias("drift_pct"), F.col("_i.bid_strategy_type").alias("_strategy"),
        target.alias("_target"))


def ga_weekly_drift(ctx) -> DataFrame:
    return _weekly(ctx).drop("_strategy", "_target")


def ga_drift_trend(ctx) -> DataFrame:
    w = _weekly(ctx)
    g = w.groupBy("campaign", "_strategy", "_target", "metric").agg(
        F.min_by("drift_pct", F.when(F.col("drift_pct").isNotNull(), F.col("week"))).alias("_first"),
        F.max_by("drift_pct", F.when(F.col("drift_pct").isNotNull(), F.col("week"))).alias("current_drift_pct"),
        F.count("drift_pct").alias("_n"))
    cpa = F.col("metric") == "cpa"
    last, first = F.col("current_drift_pct"), F.col("_first")
    trend = (F.when(F.col("_n") < 2, "stable")
             .when(last < first, F.when(cpa, "improving").otherwise("worsening"))
             .when(last > first, F.when(cpa, "worsening").otherwise("improving")).otherwise("stable"))
    return g.select("campaign", strategy_label(F.col("_strategy")).alias("strategy"), F.col("_target").alias("target"),
                    trend.alias("trend"), "current_drift_pct")


def ga_match_type(ctx, min_types: int = 2) -> DataFrame:
    g = aggregate_by(ctx.keyword, "match_type")
    n = g.agg(F.count(F.lit(1))).scalar()
    tc, tv = g.agg(F.sum("cost")).scalar(), g.agg(F.sum("conversions")).scalar()
    name = F.initcap(F.replace(F.replace(F.replace(F.col("match_type"), F.lit("EXACT"), F.lit("Exact")),
                                         F.lit("PHRASE"), F.lit("Phrase")), F.lit("BROAD"), F.lit("Broad")))
    return g.where(n >= min_types).select(
        name.alias("type"), F.col("rows").alias("keywords"), "cost", "conversions", "cpa", "ctr", "conv_rate",
        (safe_div(F.col("cost"), tc) * 100).alias("cost_share_pct"),
        F.when(tv > 0, safe_div(F.col("conversions"), tv) * 100).otherwise(F.lit(0.0)).alias("conv_share_pct"))


def ga_negative_words(ctx, k: int = 15, min_len: int = 4, min_count: int = 2) -> DataFrame:
    """Words (longer than 3 letters) of zero-conversion costly terms; each occurrence counts."""
    z = _zero_conv_terms(ctx)
    words = z.select(F.explode(F.split(F.trim(F.lower(F.coalesce("search_term", F.lit("")))), r"\s+")).alias("term"),
                     F.col("cost"))
    g = words.where(F.length("term") >= min_len).groupBy("term").agg(
        F.count(F.lit(1)).alias("occurrences"), F.sum("cost").alias("total_cost"))
    top = g.orderBy(F.col("total_cost").desc(), "term").limit(k).where(F.col("occurrences") >= min_count)
    excluded = ctx.search_term.where(F.col("search_term_status").isin("Excluded", "EXCLUDED")).agg(
        F.count(F.lit(1))).scalar()
    savings = top.agg(sum0("total_cost")).scalar()
    n = top.agg(F.count(F.lit(1))).scalar()
    return top.select("term", "occurrences", "total_cost", savings.alias("total_potential_savings"),
                      excluded.alias("already_excluded"), n.alias("new_suggestions"))


def _headlines(ctx) -> DataFrame:
    ad = ctx.ad.where(nonblank("headline_1") | nonblank("rsa_headlines"))
    parts = F.filter(F.transform(F.split(F.col("rsa_headlines"), r"\|"), lambda h: F.trim(h)), lambda h: h != "")
    heads = F.when(nonblank("rsa_headlines"), parts).otherwise(F.array(F.col("headline_1")))
    e = ad.select(F.explode(heads).alias("headline"), F.coalesce("impressions", F.lit(0)).cast("long").alias("i"),
                  F.coalesce("clicks", F.lit(0)).cast("long").alias("c"),
                  F.coalesce("conversions", F.lit(0.0)).alias("v"))
    return e.groupBy("headline").agg(F.sum("i").alias("impressions"), F.sum("c").alias("clicks"),
                                     F.sum("v").alias("conversions"))


def ga_headlines_ctr(ctx, k: int = 10, min_impressions: int = 100) -> DataFrame:
    h = _headlines(ctx).where(F.col("impressions") >= min_impressions)
    ctr = safe_div("clicks", "impressions") * 100
    return (h.select("headline", ctr.alias("ctr"), "impressions")
            .orderBy(F.bround("ctr", 2).desc(), "headline").limit(k))


def ga_headlines_conv(ctx, k: int = 10, min_clicks: int = 10) -> DataFrame:
    h = _headlines(ctx).where(F.col("clicks") >= min_clicks)
    return (h.select("headline", (safe_div("conversions", "clicks") * 100).alias("conv_rate"), "conversions")
            .orderBy(F.bround("conversions", 1).desc(), "headline").limit(k))


def ga_conversion_health(ctx, min_days: int = 14) -> DataFrame:
    rows = ctx.campaign
    t = totals(rows)
    d = by_date(rows).select("date", "conversions")
    # one row per day: the calendar bounds the unpartitioned window
    d = d.withColumn("_r", F.row_number().over(Window.orderBy(F.col("date").desc())))
    lag = d.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("_r") <= 7, F.col("conversions"))).alias("_l7"),
                F.avg(F.when(F.col("_r") > 7, F.col("conversions"))).alias("_e"))
    n, l7, e = lag.select("_n").scalar(), lag.select("_l7").scalar(), lag.select("_e").scalar()
    last7 = l7 / 7
    ratio = safe_div(last7, e)
    has = n >= min_days
    vt = rows.agg(sum0("view_through_conversions")).scalar()
    allc = F.col("all_conversions")
    primary = F.when(allc > 0, F.col("conversions") / allc * 100).otherwise(F.lit(100.0))
    return t.where((F.col("conversions") != 0) | (allc != 0)).select(
        F.col("conversions").alias("primary_conversions"), allc.alias("all_conversions"), primary.alias("primary_pct"),
        (allc - F.col("conversions")).alias("secondary_only"), vt.alias("view_through"),
        F.when(allc > 0, vt / allc * 100).otherwise(F.lit(0.0)).alias("view_through_pct"),
        F.when(has, last7).alias("last_7d_daily_avg"), F.when(has, e).alias("period_daily_avg"),
        F.when(has, ratio).alias("lag_ratio"),
        F.when(has, F.when(ratio < 0.65, "significant_lag").when(ratio < 0.85, "mild_lag").otherwise("normal"))
        .alias("lag_status"),
        F.when(primary > 50, "good").otherwise("review_needed").alias("health"))


def ga_attribution_bias(ctx) -> DataFrame:
    g = aggregate_by(ctx.campaign, "campaign_name", ["campaign_type"])
    t = F.coalesce("campaign_type", F.lit("Unknown"))
    name = F.lower("campaign_name")
    over = (t == "Search") & name.contains("brand")
    under = t.isin("Display", "Video", "Demand Gen") | name.contains("pmax") | (t == "PMax")
    return g.select(F.col("campaign_name").alias("campaign"),
                    F.when(over, "Lower funnel").when(under, "Upper funnel").otherwise("Mid funnel").alias("type"),
                    F.when(over, "Overcounted in Last Click").when(under, "Undercounted in Last Click")
                    .otherwise("Neutral").alias("likely_bias"))


def ga_auction_insights(ctx, k: int = 10) -> DataFrame:
    """Per competitor: mean of each rate (nulls ignored, 1 decimal) and a threat level."""
    a = ctx.auction.where(nonblank("competitor_domain"))
    rates = ["auction_is", "auction_overlap", "auction_outranking", "auction_top_rate", "auction_abs_top_rate"]
    g = a.groupBy("competitor_domain").agg(*[F.bround(F.avg(r), 1).alias(r) for r in rates])
    ov, out = F.col("auction_overlap"), F.col("auction_outranking")
    truthy = lambda c: F.coalesce(c != 0, F.lit(False))
    threat = (F.when(truthy(ov) & (ov > 70) & truthy(out) & (out < 50), "high")
              .when(truthy(ov) & (ov > 50), "medium").otherwise("low"))
    ours = ctx.campaign.where(F.coalesce(F.col("search_impression_share") != 0, F.lit(False))).agg(
        F.bround(F.avg("search_impression_share"), 1)).scalar()
    return (g.select(F.col("competitor_domain").alias("domain"), F.col("auction_is").alias("impression_share"),
                     ov.alias("overlap_rate"), out.alias("outranking_share"), F.col("auction_top_rate").alias("top_rate"),
                     F.col("auction_abs_top_rate").alias("abs_top_rate"), threat.alias("threat_level"))
            .orderBy(F.coalesce("overlap_rate", F.lit(0.0)).desc(), "domain").limit(k)
            .select("*", ours.alias("our_is")))


def _scaling(ctx):
    rows = ctx.campaign
    t = totals(rows)
    truthy = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    s = rows.agg(F.avg(F.when(truthy("search_lost_is_budget"), F.col("search_lost_is_budget"))).alias("lb"),
                 F.avg(F.when(truthy("search_lost_is_rank"), F.col("search_lost_is_rank"))).alias("lr"),
                 F.min("date").alias("dmin"), F.max("date").alias("dmax"))
    lb = s.select("lb").scalar()
    lr = F.coalesce(s.select("lr").scalar(), F.lit(0.0))
    days = F.coalesce(F.datediff(s.select("dmax").scalar(), s.select("dmin").scalar()) + 1, F.lit(30))
    return t.where((F.col("cost") != 0) & lb.isNotNull()), lb, lr, days


def ga_scaling_forecast(ctx) -> DataFrame:
    t, lb, lr, days = _scaling(ctx)
    add_conv = F.when(lb > 0, F.col("conversions") * (lb / 100)).otherwise(F.lit(0.0))
    add_cost = F.when(lb > 0, F.col("cost") * (lb / 100)).otherwise(F.lit(0.0))
    return t.select(F.when(days > 0, F.col("cost") / days).otherwise(F.lit(0.0)).alias("current_daily_budget"),
                    lb.alias("is_lost_budget"), lr.alias("is_lost_rank"), lb.alias("headroom_pct"),
                    add_conv.alias("estimated_additional_conversions"), add_cost.alias("estimated_additional_cost"),
                    safe_div(add_cost, add_conv).alias("estimated_marginal_cpa"), (lr < 20).alias("viable"))


def ga_scaling_scenarios(ctx, steps: tuple = (10, 25, 50)) -> DataFrame:
    t, _, _, _ = _scaling(ctx)
    s = t.select("cpa", F.explode(F.array(*[F.lit(p) for p in steps])).alias("budget_increase_pct"))
    return s.select("budget_increase_pct", (F.col("budget_increase_pct") * 0.7).alias("est_conv_increase_pct"),
                    (F.col("cpa") * (1 + F.col("budget_increase_pct") / 100 * 0.15)).alias("est_new_cpa"))


def ga_summary(ctx, as_of: str | None = None) -> DataFrame:
    """Hero totals over campaign rows (keyword/term/ad rows are views of the same spend)."""
    rows = ctx.campaign
    t = totals(rows)
    ref = F.to_date(F.lit(as_of)) if as_of else F.current_date()
    extra = rows.agg(F.min("date").alias("date_min"), F.max("date").alias("date_max"),
                     F.sort_array(F.collect_set("campaign_type")).alias("campaign_types"),
                     F.count(F.lit(1)).alias("total_rows"))
    return t.select(F.col("cost").alias("total_cost"), F.col("conversions").alias("total_conversions"),
                    F.col("conversion_value").alias("total_conversion_value"), "roas", "cpa",
                    F.col("impressions").alias("total_impressions"), F.col("clicks").alias("total_clicks"), "ctr",
                    F.col("cpc").alias("avg_cpc"), extra.select("date_min").scalar().alias("date_min"),
                    extra.select("date_max").scalar().alias("date_max"),
                    extra.select("campaign_types").scalar().alias("campaign_types"),
                    F.coalesce(F.datediff(ref, extra.select("date_max").scalar()) <= 7, F.lit(False))
                    .alias("conversion_lag_warning"), extra.select("total_rows").scalar().alias("total_rows"))


def ga_signals(ctx, k: int = 10, wasted_share: float = 20.0) -> DataFrame:
    """Threshold breaches of the other analyses, by priority (the reference leaves this to a person).

    Red benchmark lights and underperforming bidding campaigns are high
    priority; campaigns still learning and wasted search-term spend above
    ``wasted_share`` percent are medium.
    """
    red = ga_benchmarks(ctx).where(F.col("status") == "red").select(
        F.lit("high").alias("priority"), F.col("name").alias("area"), F.lit("benchmark_red").alias("type"),
        F.col("value"))
    bid = ga_bidding_status(ctx).where(F.col("status") == "underperforming").select(
        F.lit("high").alias("priority"), F.col("campaign").alias("area"),
        F.lit("bidding_underperforming").alias("type"), F.col("drift_pct").alias("value"))
    learn = ga_learning_period(ctx).where(F.col("status") == "learning").select(
        F.lit("medium").alias("priority"), F.col("campaign").alias("area"), F.lit("learning").alias("type"),
        F.col("conv_last_14d").alias("value"))
    waste = ga_wasted_spend(ctx).where(F.col("wasted_pct") > wasted_share).select(
        F.lit("medium").alias("priority"), F.lit("Search Terms").alias("area"), F.lit("wasted_spend").alias("type"),
        F.col("wasted_pct").alias("value"))
    u = red.unionByName(bid).unionByName(learn).unionByName(waste)
    prio = F.when(F.col("priority") == "high", 0).otherwise(1)
    return u.orderBy(prio, "type", "area").limit(k)
