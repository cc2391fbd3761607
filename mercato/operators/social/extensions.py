"""Ads analyses the report catalogues specify beyond the scripted ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.core import nonblank, safe_div, sum0
from mercato.operators.search import report as ga
from mercato.operators.social.report import _agg, name_column

# Catalogue thresholds and audience-name patterns.
AUDIENCE_PATTERNS = [('LAL', '(?i)(lal|lookalike)'), ('Retargeting', '(?i)(retarget|rmk|remarketing)'),
                     ('Intereses', '(?i)(interes|interest)'), ('Broad', '(?i)(broad|abierto)')]
RANK_POINTS = [('ABOVE_AVERAGE', 3), ('AVERAGE', 2), ('BELOW_AVERAGE', 1)]


# ---------------------------------------------------------------- search ads

def lost_impressions(ctx) -> DataFrame:
    """Impression-weighted search share per campaign and the impressions it implies were lost."""
    r = ctx.campaign.where(F.col("search_impression_share") > 0)
    g = r.groupBy("campaign_name").agg(
        sum0("impressions").alias("impressions"),
        safe_div(F.sum(F.col("search_impression_share") * F.col("impressions")), F.sum("impressions"))
        .alias("weighted_is"))
    lost = F.when(F.col("weighted_is") > 0, F.col("impressions") * (100 / F.col("weighted_is") - 1))
    return g.select(F.col("campaign_name").alias("campaign"), "impressions", "weighted_is",
                    lost.alias("lost_impressions"))


def day_hour_heatmap(ctx) -> DataFrame:
    r = ctx.campaign.where(F.col("date").isNotNull() & F.col("hour_of_day").isNotNull())
    g = r.groupBy(F.date_format("date", "EEEE").alias("day"), F.col("hour_of_day").cast("int").alias("hour")).agg(
        sum0("cost").alias("cost"), sum0("conversions").alias("conversions"), sum0("clicks").alias("_c"))
    return g.select("day", "hour", "cost", "conversions", safe_div("cost", "conversions").alias("cpa"),
                    (safe_div("conversions", "_c") * 100).alias("conv_rate"))


def prior_period(ctx, days: int = 14, lag_days: int = 7) -> DataFrame:
    """Last ``days`` days before the conversion-lag window vs the same number of days before them."""
    r = ctx.campaign.where(F.col("date").isNotNull())
    mx = r.agg(F.max("date")).scalar()
    end = F.date_sub(mx, lag_days)
    cur = (F.col("date") > F.date_sub(end, days)) & (F.col("date") <= end)
    pri = (F.col("date") > F.date_sub(end, 2 * days)) & (F.col("date") <= F.date_sub(end, days))
    a = r.agg(*[sum0(F.when(c, F.col(m))).alias(f"{m}_{s}") for s, c in (("c", cur), ("p", pri))
                for m in ("cost", "conversions", "conversion_value")])
    rows = []
    for name, cexpr, pexpr in (
            ("cost", F.col("cost_c"), F.col("cost_p")),
            ("conversions", F.col("conversions_c"), F.col("conversions_p")),
            ("cpa", safe_div("cost_c", "conversions_c"), safe_div("cost_p", "conversions_p")),
            ("roas", safe_div("conversion_value_c", "cost_c"), safe_div("conversion_value_p", "cost_p"))):
        rows.append(F.struct(F.lit(name).alias("metric"), cexpr.cast("double").alias("current"),
                             pexpr.cast("double").alias("prior")))
    e = a.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return e.select("*", F.when(F.col("prior") > 0, (F.col("current") - F.col("prior")) / F.col("prior") * 100)
                    .alias("change_pct"))


def network_breakdown(ctx) -> DataFrame:
    """Metrics per network with its share of cost, clicks and conversions, and the total of all (network ``total``).

    Networks and total come from one aggregate with grouping sets; its rows, one per network, then share one array,
    so the shares need no second pass.  ``kind`` tells search partners from search.  Needs exports with a network column.
    """
    r = ctx.campaign.where(nonblank("network"))
    g = r.rollup("network").agg(*ga._sums(r), F.grouping("network").alias("_total"))
    rows = g.agg(F.collect_list(F.struct("*")).alias("_rows"))
    total = F.filter("_rows", lambda x: x["_total"] == 1)[0]
    e = rows.select(F.explode("_rows").alias("_r"), total.alias("_all")).select("_r.*", "_all")
    name = F.lower("network")
    kind = (F.when(F.col("_total") == 1, "total").when(name.contains("partner"), "search_partners")
            .when(name.contains("search"), "search").otherwise("other"))
    shares = [(safe_div(F.col(m), F.col("_all")[m]) * 100).alias(f"{m}_share_pct") for m in ("cost", "clicks", "conversions")]
    return e.select(F.coalesce("network", F.lit("total")).alias("network"), kind.alias("kind"), "impressions", "clicks", "cost",
                    "conversions", "conversion_value", *ga.ratio_metrics(), *shares)


def brand_split(ctx, pattern: str = "(?i)brand") -> DataFrame:
    r = ctx.campaign.withColumn("segment", F.when(F.col("campaign_name").rlike(pattern), "branded")
                                .otherwise("other"))
    g = r.groupBy("segment").agg(sum0("cost").alias("cost"), sum0("conversions").alias("conversions"),
                                 sum0("conversion_value").alias("conversion_value"))
    return g.select("*", safe_div("conversion_value", "cost").alias("roas"), safe_div("cost", "conversions").alias("cpa"))


def is_quadrant(ctx, budget_cut: float = 10.0, rank_cut: float = 10.0) -> DataFrame:
    g = ga.aggregate_by(ctx.campaign, "campaign_name", ["search_lost_is_budget", "search_lost_is_rank"])
    g = g.where(F.col("search_lost_is_budget").isNotNull() | F.col("search_lost_is_rank").isNotNull())
    b = F.coalesce(F.col("search_lost_is_budget"), F.lit(0.0)) >= budget_cut
    k = F.coalesce(F.col("search_lost_is_rank"), F.lit(0.0)) >= rank_cut
    action = (F.when(b & k, "fix rank first").when(b, "increase budget").when(k, "improve rank")
              .otherwise("healthy"))
    return g.select(F.col("campaign_name").alias("campaign"), F.col("search_lost_is_budget").alias("lost_budget"),
                    F.col("search_lost_is_rank").alias("lost_rank"), action.alias("action"))


def wasted_ratio(ctx, limit_pct: float = 20.0) -> DataFrame:
    w = ga.ga_wasted_spend(ctx)
    return w.select("wasted_pct", (F.col("wasted_pct") > limit_pct).alias("flagged"))


def rsa_audit(ctx, min_h: int = 3, max_h: int = 15, max_len: int = 30) -> DataFrame:
    a = ctx.ad.where(nonblank("rsa_headlines"))
    heads = F.filter(F.transform(F.split("rsa_headlines", r"\|"), lambda h: F.trim(h)), lambda h: h != "")
    a = a.select(F.coalesce("ad_group_name", F.lit("N/A")).alias("ad_group"), F.size(heads).alias("_n"),
                 F.size(F.filter(heads, lambda h: F.length(h) > max_len)).alias("_long"))
    return a.groupBy("ad_group").agg(
        F.count(F.lit(1)).alias("ads"), F.avg("_n").alias("avg_headlines"),
        F.count(F.when((F.col("_n") < min_h) | (F.col("_n") > max_h), 1)).alias("ads_out_of_range"),
        F.sum("_long").cast("long").alias("long_headlines"))


# ---------------------------------------------------------------- social ads

def winners_losers(ctx, min_spend: float = 50.0, k: int = 3) -> DataFrame:
    g = _agg(ctx.social, ["ad_name"]).where(F.col("spend") >= min_spend)
    g = g.select(F.col("ad_name").alias("ad"), "spend", safe_div("purchase_value", "spend").alias("roas"))
    # two distributed top-k scans (take-ordered), no window over all ads
    w = g.orderBy(F.col("roas").desc(), "ad").limit(k).select("ad", "spend", "roas", F.lit("winner").alias("label"))
    l_ = g.orderBy(F.col("roas").asc(), "ad").limit(k).select("ad", "spend", "roas", F.lit("loser").alias("label"))
    return w.unionByName(l_)


def _points(c):
    expr = F.lit(None).cast("double")
    for prefix, pts in reversed(RANK_POINTS):
        expr = F.when(F.upper(c).startswith(prefix) if prefix == 'BELOW_AVERAGE' else (F.upper(c) == prefix),
                      F.lit(float(pts))).otherwise(expr)
    return expr


def relevance_score(ctx) -> DataFrame:
    s = ctx.social
    col = name_column(s)
    order = F.struct(*[F.col(c) for c in ("date_start", "device", "campaign_name", "adset_name") if c in s.columns])
    cols = ["quality_ranking", "engagement_ranking", "conversion_ranking"]
    g = s.where(F.col(col).isNotNull()).groupBy(col).agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols])
    pts = [_points(F.col(c)) for c in cols]
    n = sum((p.isNotNull().cast("int") for p in pts), F.lit(0))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in pts), F.lit(0.0))
    score = F.when(n > 0, total / n)
    label = (F.when(score > 2.5, "Excelente").when(score >= 1.5, "Normal").when(score.isNotNull(), "Problemático"))
    return g.select(F.col(col).alias("ad"), score.alias("score"), label.alias("class"))


def hook_class(ctx, min_impressions: float = 100) -> DataFrame:
    s = ctx.social
    g = _agg(s, [name_column(s)], ["video_3s"]).where(F.col("impressions") > min_impressions)
    h = safe_div(F.col("video_3s") * 100, "impressions")
    return g.select(F.col(name_column(s)).alias("ad"), h.alias("hook_rate"),
                    F.when(h > 30, "excellent").when(h >= 15, "normal").otherwise("low").alias("class"))


def video_dropoff(ctx, min_impressions: float = 100) -> DataFrame:
    s = ctx.social
    g = _agg(s, [name_column(s)], ["video_3s", "video_p25", "video_p50", "video_p75", "video_p100", "thruplay"])
    g = g.where(F.col("impressions") > min_impressions)

    def drop(a, b):
        return safe_div((F.col(a) - F.col(b)) * 100, a)

    stages = F.array(F.struct(drop("video_p25", "video_p50").alias("d"), F.lit("hook").alias("s")),
                     F.struct(drop("video_p50", "video_p75").alias("d"), F.lit("middle").alias("s")),
                     F.struct(drop("video_p75", "video_p100").alias("d"), F.lit("end").alias("s")))
    return g.select(F.col(name_column(s)).alias("ad"), drop("video_p25", "video_p50").alias("drop_25_50"),
                    drop("video_p50", "video_p75").alias("drop_50_75"), drop("video_p75", "video_p100").alias("drop_75_100"),
                    safe_div(F.col("thruplay") * 100, "impressions").alias("thruplay_rate"),
                    F.array_max(stages)["s"].alias("largest_drop"))


def _weekly(ctx) -> DataFrame:
    s = ctx.social.where(F.col("date_start").isNotNull())
    return _agg(s.withColumn("week", F.date_trunc("week", "date_start").cast("date")), ["week"])


def weekly_cpa_corr(ctx) -> DataFrame:
    w = _weekly(ctx).select("spend", safe_div("spend", "purchases").alias("cpa"))
    return w.agg(F.count(F.lit(1)).alias("weeks"), F.corr("spend", "cpa").alias("corr_spend_cpa")).select(
        "weeks", "corr_spend_cpa", F.when(F.col("corr_spend_cpa").isNotNull(),
                                          F.when(F.col("corr_spend_cpa") < 0.2, "scaling well")
                                          .when(F.col("corr_spend_cpa") <= 0.5, "mild diminishing returns")
                                          .otherwise("saturation")).alias("class"))


def roas_slope(ctx, band: float = 0.05) -> DataFrame:
    w = _weekly(ctx).select("week", safe_div("purchase_value", "spend").alias("roas"))
    # one row per week: the calendar bounds the window
    w = w.withColumn("_x", (F.row_number().over(Window.orderBy("week")) - 1).cast("double"))
    a = w.agg(F.count(F.lit(1)).alias("weeks"), F.regr_slope("roas", "_x").alias("slope"))
    return a.select("weeks", "slope", F.when(F.col("slope") > band, "positive").when(F.col("slope") < -band, "negative")
                    .when(F.col("slope").isNotNull(), "stable").alias("trend"))


def audience_type(ctx, saturation: float = 5.0) -> DataFrame:
    kind = F.lit("Other")
    for name, pat in reversed(AUDIENCE_PATTERNS):
        kind = F.when(F.col("adset_name").rlike(pat), name).otherwise(kind)
    s = ctx.social.where(F.col("adset_name").isNotNull()).withColumn("audience_type", kind)
    g = _agg(s, ["audience_type"])
    f = safe_div("impressions", "reach")
    return g.select("audience_type", "spend", "reach", f.alias("frequency"),
                    safe_div("purchase_value", "spend").alias("roas"), safe_div("spend", "purchases").alias("cpa"),
                    (f > saturation).alias("saturated"))


def overlap_by_campaign(ctx, max_freq: float = 3.0) -> DataFrame:
    g = _agg(ctx.social, ["campaign_name", "adset_name"])
    f = safe_div("impressions", "reach")
    return g.groupBy(F.col("campaign_name").alias("campaign")).agg(
        F.count(F.lit(1)).alias("adsets"), F.count(F.when(f > max_freq, 1)).alias("adsets_over_frequency"))


def fatigue_class(ctx, days: int = 7) -> DataFrame:
    s = ctx.social.where(F.col("ad_name").isNotNull() & F.col("date_start").isNotNull())
    d = _agg(s, ["ad_name", "date_start"])
    # one row per active day of an ad: the calendar bounds each window partition
    w = Window.partitionBy("ad_name")
    d = (d.withColumn("_a", F.row_number().over(w.orderBy("date_start")))
         .withColumn("_z", F.row_number().over(w.orderBy(F.col("date_start").desc()))))
    g = d.groupBy("ad_name").agg(
        safe_div(sum0(F.when(F.col("_a") <= days, F.col("clicks"))) * 100,
                 sum0(F.when(F.col("_a") <= days, F.col("impressions")))).alias("ctr_first"),
        safe_div(sum0(F.when(F.col("_z") <= days, F.col("clicks"))) * 100,
                 sum0(F.when(F.col("_z") <= days, F.col("impressions")))).alias("ctr_last"),
        safe_div(F.sum("impressions"), F.sum("reach")).alias("frequency"), F.count(F.lit(1)).alias("days_active"))
    drop = F.when(F.col("ctr_first") > 0, (F.col("ctr_first") - F.col("ctr_last")) / F.col("ctr_first") * 100) \
        .otherwise(F.lit(0.0))
    cls = (F.when((F.col("frequency") > 5) & (drop > 30), "Fatigado")
           .when((F.col("frequency") >= 3) & (drop > 0), "En riesgo").otherwise("Fresco"))
    return g.select(F.col("ad_name").alias("ad"), "ctr_first", "ctr_last", drop.alias("ctr_drop_pct"), "frequency",
                    "days_active", cls.alias("class"))


def low_volume_bidding(ctx, min_monthly: float = 15.0) -> DataFrame:
    """Smart-bidding campaigns with fewer than 15 conversions in a calendar month."""
    r = ctx.campaign.where(nonblank("bid_strategy_type") & F.col("date").isNotNull())
    g = r.groupBy("campaign_name", F.date_format("date", "yyyy-MM").alias("month")).agg(
        sum0("conversions").alias("conversions"))
    return g.select(F.col("campaign_name").alias("campaign"), "month", "conversions",
                    (F.col("conversions") < min_monthly).alias("low_volume"))


def qs_component(ctx) -> DataFrame:
    """Cause class of each scored keyword from its below-average components."""
    q = ctx.keyword.where(F.col("quality_score") > 0)
    below = [F.coalesce(F.lower(F.col(c)).contains("below"), F.lit(False))
             for c in ("expected_ctr", "ad_relevance", "landing_page_experience")]
    cause = (F.when(below[0] & below[1] & below[2], "misaligned").when(below[0], "ad copy")
             .when(below[1], "keyword-ad relevance").when(below[2], "landing page").otherwise("ok"))
    return q.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("keywords"), sum0("cost").alias("cost"))


def pmax_before_after(ctx) -> DataFrame:
    """Mean search impression share of Search campaigns before vs from the first Performance Max day."""
    r = ctx.campaign.where(F.col("date").isNotNull())
    start = r.where(F.col("campaign_type") == "PMax").agg(F.min("date")).scalar()
    s = r.where((F.col("campaign_type") == "Search") & F.col("search_impression_share").isNotNull())
    return s.agg(F.avg(F.when(F.col("date") < start, F.col("search_impression_share"))).alias("is_before"),
                 F.avg(F.when(F.col("date") >= start, F.col("search_impression_share"))).alias("is_after"),
                 start.alias("pmax_start"))


def sustained_cpa(ctx, rise: float = 0.4, min_days: int = 3) -> DataFrame:
    """Runs of consecutive days whose CPA exceeds the campaign's period CPA by ``rise`` (gaps and islands)."""
    r = ctx.campaign.where(F.col("date").isNotNull() & F.col("campaign_name").isNotNull())
    d = r.groupBy("campaign_name", "date").agg(sum0("cost").alias("cost"), sum0("conversions").alias("conv"))
    base = d.groupBy("campaign_name").agg(safe_div(F.sum("cost"), F.sum("conv")).alias("base_cpa"))
    d = d.join(base, "campaign_name").withColumn("cpa", safe_div("cost", "conv"))
    hot = d.where((F.col("base_cpa") > 0) & (F.col("cpa") > F.col("base_cpa") * (1 + rise)))
    # consecutive dates share (date - row number); one row per campaign day bounds each partition
    w = Window.partitionBy("campaign_name").orderBy("date")
    hot = hot.withColumn("_island", F.date_sub("date", F.row_number().over(w)))
    g = hot.groupBy("campaign_name", "_island").agg(F.min("date").alias("start"), F.max("date").alias("end"),
                                                    F.count(F.lit(1)).alias("days"), F.avg("cpa").alias("avg_cpa"),
                                                    F.first("base_cpa").alias("base_cpa"))
    return g.where(F.col("days") >= min_days).select(F.col("campaign_name").alias("campaign"), "start", "end", "days",
                                                     "avg_cpa", "base_cpa")


def metric_divergence(ctx, flat: float = 5.0) -> DataFrame:
    """Second half vs first half per campaign: CTR down with impressions up, conversions down with clicks flat,
    conversion rate down with spend up, delivery near zero."""
    r = ctx.campaign.where(F.col("date").isNotNull() & F.col("campaign_name").isNotNull())
    rng = r.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    mid = F.date_add(rng.select("a").scalar(), F.floor(F.datediff(rng.select("b").scalar(),
                                                                   rng.select("a").scalar()) / 2).cast("int"))
    h1, h2 = F.col("date") < mid, F.col("date") >= mid
    g = r.groupBy("campaign_name").agg(*[sum0(F.when(h, F.col(m))).cast("double").alias(f"{m}{i}")
                                         for i, h in ((1, h1), (2, h2))
                                         for m in ("impressions", "clicks", "cost", "conversions")])

    def chg(m):
        return F.when(F.col(f"{m}1") > 0, (F.col(f"{m}2") - F.col(f"{m}1")) / F.col(f"{m}1") * 100)

    ctr1, ctr2 = safe_div("clicks1", "impressions1"), safe_div("clicks2", "impressions2")
    cr1, cr2 = safe_div("conversions1", "clicks1"), safe_div("conversions2", "clicks2")
    return g.select(F.col("campaign_name").alias("campaign"),
                    F.coalesce((ctr2 < ctr1) & (chg("impressions") > 0), F.lit(False)).alias("ctr_down_impressions_up"),
                    F.coalesce((chg("conversions") < 0) & (F.abs(chg("clicks")) <= flat), F.lit(False))
                    .alias("conversions_down_clicks_flat"),
                    F.coalesce((cr2 < cr1) & (chg("cost") > 0), F.lit(False)).alias("conv_rate_down_spend_up"),
                    (F.col("impressions2") < F.col("impressions1") * 0.01).alias("delivery_near_zero"))


def budget_guard(ctx, max_rank_lost: float = 50.0) -> DataFrame:
    g = ga.aggregate_by(ctx.campaign, "campaign_name", ["search_lost_is_rank"])
    g = g.where(F.col("search_lost_is_rank").isNotNull())
    return g.select(F.col("campaign_name").alias("campaign"), F.col("search_lost_is_rank").alias("lost_rank"),
                    (F.col("search_lost_is_rank") <= max_rank_lost).alias("can_scale"))


def branded_share(ctx, branded_min: float = 70.0, other_min: float = 50.0, pattern: str = "(?i)brand") -> DataFrame:
    g = ga.aggregate_by(ctx.campaign, "campaign_name", ["search_impression_share"])
    g = g.where(F.col("search_impression_share").isNotNull())
    branded = F.col("campaign_name").rlike(pattern)
    floor = F.when(branded, F.lit(branded_min)).otherwise(F.lit(other_min))
    return g.select(F.col("campaign_name").alias("campaign"), branded.alias("branded"),
                    F.col("search_impression_share").alias("impression_share"),
                    (F.col("search_impression_share") < floor).alias("below_floor"))


def weekday_guard(ctx, min_weeks: int = 4) -> DataFrame:
    """A weekday report needs at least four full (7-day) weeks of data."""
    r = ctx.campaign.where(F.col("date").isNotNull())
    w = r.groupBy(F.date_trunc("week", "date").alias("wk")).agg(F.count_distinct("date").alias("d"))
    return w.agg(F.count(F.when(F.col("d") == 7, 1)).alias("full_weeks")).select(
        "full_weeks", (F.col("full_weeks") >= min_weeks).alias("weekday_report_valid"))


def custom_name_regex(ctx, pattern: str = r"^(?P<product>[^|]+?) \| (?P<format>[^|]+?) \| (?P<stage>[^|]+?) \| "
                                              r"(?P<creator>[^|]+?) \| (?P<variation>.+)$",
                      min_rate: float = 50.0) -> DataFrame:
    """Parse ad names with a user pattern of named groups; unparsed names keep null fields; flag a low parse rate."""
    import re
    groups = list(re.compile(pattern).groupindex.items())
    java = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    s = ctx.social
    names = s.where(F.col(name_column(s)).isNotNull()).select(F.col(name_column(s)).alias("name")).distinct()
    ok = F.col("name").rlike(java)
    fields = [F.when(ok, F.regexp_extract("name", java, idx)).alias(g) for g, idx in groups]
    out = names.select("name", *fields, ok.alias("parsed"))
    rate = out.agg(F.avg(F.col("parsed").cast("double")) * 100).scalar()
    return out.select("*", rate.alias("parse_rate_pct"), (rate < min_rate).alias("low_parse_rate"))


def relevance_scenario(ctx, min_impressions: float = 500.0) -> DataFrame:
    """Which ranking is below average for ads with at least 500 impressions, and the likely issue."""
    s = ctx.social
    col = name_column(s)
    order = F.struct(*[F.col(c) for c in ("date_start", "device", "campaign_name", "adset_name") if c in s.columns])
    cols = ["quality_ranking", "engagement_ranking", "conversion_ranking"]
    g = s.where(F.col(col).isNotNull()).groupBy(col).agg(
        sum0("impressions").alias("impressions"),
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols])
    low = [F.coalesce(F.upper(F.col(c)).startswith("BELOW_AVERAGE"), F.lit(False)) for c in cols]
    issue = (F.when(low[0] & low[1] & low[2], "audience-creative mismatch").when(low[0], "creative quality")
             .when(low[1], "ad not compelling").when(low[2], "post-click experience").otherwise("ok"))
    return g.where(F.col("impressions") >= min_impressions).select(F.col(col).alias("ad"), "impressions",
                                                                   issue.alias("issue"))


def same_period_comparison(ctx) -> DataFrame:
    """Month to date vs the same days of the previous month and of the same month a year earlier."""
    r = ctx.campaign.where(F.col("date").isNotNull())
    mx = r.agg(F.max("date")).scalar()
    start = F.trunc(mx, "month")
    span = F.datediff(mx, start)
    def same_days(months: int):  # a shorter month ends the period on its last day
        first = F.add_months(start, -months)
        return first, F.least(F.date_add(first, span), F.last_day(first))
    periods = [("current", start, mx), ("previous_month", *same_days(1)), ("previous_year", *same_days(12))]
    aggs = []
    for name, a, b in periods:
        inside = (F.col("date") >= a) & (F.col("date") <= b)
        aggs += [sum0(F.when(inside, F.col("cost"))).alias(f"{name}_cost"),
                 sum0(F.when(inside, F.col("conversions"))).alias(f"{name}_conv"),
                 sum0(F.when(inside, F.col("conversion_value"))).alias(f"{name}_value")]
    t = r.agg(*aggs)
    rows = [F.struct(F.lit(name).alias("period"), (F.datediff(b, a) + 1).alias("days"), F.col(f"{name}_cost").alias("cost"),
                     F.col(f"{name}_conv").alias("conversions"), F.col(f"{name}_value").alias("conversion_value"))
            for name, a, b in periods]
    e = t.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return e.select("*", safe_div("cost", "conversions").alias("cpa"), safe_div("conversion_value", "cost").alias("roas"))


def is_decline(ctx, stable_pct: float = 10.0) -> DataFrame:
    """Campaigns whose weekly impression share falls while weekly spend stays within +-10 %."""
    r = ctx.campaign.where(F.col("date").isNotNull() & F.col("search_impression_share").isNotNull())
    wk = r.groupBy("campaign_name", F.date_trunc("week", "date").alias("week")).agg(
        F.avg("search_impression_share").alias("is"), sum0("cost").alias("cost"))
    # one row per campaign week: the calendar bounds each window partition
    w = Window.partitionBy("campaign_name").orderBy("week")
    wk = wk.withColumn("_x", (F.row_number().over(w) - 1).cast("double"))
    g = wk.groupBy("campaign_name").agg(
        F.regr_slope("is", "_x").alias("is_slope"), F.min_by("cost", "week").alias("_c0"),
        F.max_by("cost", "week").alias("_c1"), F.count(F.lit(1)).alias("weeks"))
    change = F.when(F.col("_c0") > 0, (F.col("_c1") - F.col("_c0")) / F.col("_c0") * 100)
    return g.select(F.col("campaign_name").alias("campaign"), "weeks", "is_slope", change.alias("cost_change_pct"),
                    F.coalesce((F.col("is_slope") < 0) & (F.abs(change) <= stable_pct), F.lit(False))
                    .alias("declining_share"))
