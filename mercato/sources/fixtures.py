"""Canonical views derived from the benchmark parquet tables.

The store, search-ads and social-ads operators consume three canonical
schemas (see ``mercato.schema``).  The benchmark ships TPC-H-like tables
instead, so these functions derive the canonical views from them with plain
joins and expressions; ``mercato.plans.oracle_views`` states the same views
in SQL so that DuckDB sees identical rows.

Fixed values (fixture mapping, must match the SQL views):
  order status      F -> closed, O -> open, P -> cancelled
  price factor      SMALL 0.5, PROMO 0.6, ECONOMY 0.8, MEDIUM 1.0, STANDARD 1.2, LARGE 2.0
  size letter       p_size % 4: 0 s, 1 m, 2 l, 3 xl
  campaign prefix   user_id % 3: 0 'Brand Search ', 1 'PMax ', 2 'Display '
  ad name parts     product Shirt Coat Pack Boot (u % 4); format UGC video static (u % 3);
                    stage tof bof (u % 2); creator Ana; variation v(u % 5)
  devices           event_id % 3: MOBILE DESKTOP TABLET
  match types       p_partkey % 3: EXACT PHRASE BROAD
  term status       p_partkey % 5: 0 Added, 1 Excluded, else null
  part campaigns    p_partkey % 3: Brand Search 0, PMax 1, Brand Search 3
  component grades  Above average, Average, Below average
  ad strength       EXCELLENT GOOD AVERAGE POOR
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(idx: Column, values: list) -> Column:
    """values[idx] for a small fixed literal list (idx is 0-based)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx.cast("int") + 1)


def _orders_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and nation, in the columns of these tables; ``_order_columns`` derives the canonical ones."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    # nation has 25 rows by the TPC-H definition: a proven bound for broadcast
    n = F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == n["n_nationkey"])


def _order_columns() -> list[Column]:
    k = F.col("o_orderkey")
    cancelled = F.col("o_orderstatus") == "P"
    promo = (k % 4) == 0
    return [
        k.alias("order_key"),
        k.cast("string").alias("order_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.col("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "closed")
        .when(F.col("o_orderstatus") == "O", "open")
        .when(cancelled, "cancelled").alias("order_status"),
        F.lit("paid").alias("payment_status"),
        F.lit("shipped").alias("shipping_status"),
        F.lit("USD").alias("currency"),
        F.col("o_totalprice").alias("subtotal"),
        F.when(promo, F.col("o_totalprice") * 0.1).otherwise(F.lit(0.0)).alias("discount"),
        F.when((k % 3) == 0, F.lit(0.0)).otherwise((500 + 100 * (k % 7)).cast("double")).alias("shipping_cost"),
        F.col("o_totalprice").alias("total"),
        F.col("c_name").alias("customer_name"),
        F.lit(None).cast("string").alias("phone"),
        F.lit(None).cast("string").alias("shipping_address"),
        F.concat(F.col("n_name"), F.lit("-"), (F.col("c_custkey") % 4).cast("string")).alias("city"),
        F.lit(None).cast("string").alias("locality"),
        F.col("n_name").alias("state"),
        F.lit("AR").alias("country"),
        F.lit(None).cast("string").alias("zip_code"),
        F.concat(F.lit("M"), (k % 4).cast("string")).alias("shipping_method"),
        F.col("c_mktsegment").alias("payment_method"),
        F.when(promo, F.concat(F.lit("CUP"), (k % 3).cast("string"))).alias("coupon"),
        F.col("o_orderdate").alias("payment_date"),
        (F.col("o_orderdate") + F.make_interval(days=(k % 9).cast("int"))).alias("shipping_date"),
        F.col("o_orderpriority").alias("channel"),
        F.when(cancelled, F.col("o_orderdate") + F.make_interval(days=((k % 5) + 1).cast("int")))
        .alias("cancellation_date"),
        F.when(cancelled, F.concat(F.lit("r"), (k % 5).cast("string"))).alias("cancellation_reason"),
    ]


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order that has at least one line (what the line table implies)."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey"))
    base = _orders_base(spark, sf_dir)
    return base.join(li, base["o_orderkey"] == li["l_orderkey"], "left_semi").select(*_order_columns())


def lines_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines: lineitem joined to its part, order, customer and nation.

    What the joins deal out are the tables' own columns, the orders' only once they meet their lines; the
    canonical columns, several times as wide, are derived from the joined rows.
    """
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    factor = (F.when(F.col("p_type") == "SMALL", 0.5).when(F.col("p_type") == "PROMO", 0.6)
              .when(F.col("p_type") == "ECONOMY", 0.8).when(F.col("p_type") == "MEDIUM", 1.0)
              .when(F.col("p_type") == "STANDARD", 1.2).when(F.col("p_type") == "LARGE", 2.0))
    size = _pick(F.col("p_size") % 4, ["s", "m", "l", "xl"])
    orders = _orders_base(spark, sf_dir)
    return (
        li.join(p, li["l_partkey"] == p["p_partkey"])
        .join(orders, li["l_orderkey"] == orders["o_orderkey"])
        .select(
            *_order_columns(),
            F.col("l_linenumber").alias("line_no"),
            F.concat(F.col("p_name"), F.lit(" - "), F.col("p_type")).alias("product_name"),
            (F.col("p_retailprice") * (1 - F.col("l_discount")) * factor).alias("product_price"),
            F.col("l_quantity").cast("int").alias("product_qty"),
            F.concat(F.lit("SKU"), F.col("p_partkey").cast("string"), F.lit("-"), size).alias("sku"),
        )
    )


# ---------------------------------------------------------------- ads facts

_AD_PRODUCTS = ["Shirt", "Coat", "Pack", "Boot"]
_AD_FORMATS = ["UGC", "video", "static"]
_AD_STAGES = ["tof", "bof"]
_CAMPAIGN_PREFIX = ["Brand Search ", "PMax ", "Display "]
_CAMPAIGN_TYPES = ["Search", "PMax", "Display"]
_DEVICES = ["MOBILE", "DESKTOP", "TABLET"]
_STRENGTHS = ["EXCELLENT", "GOOD", "AVERAGE", "POOR"]
_PLACEMENTS = ["feed", "stories", "reels", "right_column"]
_RANKINGS = ["ABOVE_AVERAGE", "AVERAGE", "BELOW_AVERAGE_35"]


def _event_counts(ev: DataFrame, keys: list) -> DataFrame:
    t = F.col("event_type")

    def n(kind):
        return F.count(F.when(t == kind, 1))

    return ev.groupBy(*keys).agg(
        n("view").alias("_views"), n("click").alias("_clicks"), n("purchase").alias("_purchases"),
        n("signup").alias("_signups"), n("error").alias("_errors"),
        F.coalesce(F.sum(F.when(t == "purchase", F.col("value"))), F.lit(0.0)).alias("_pvalue"),
        F.coalesce(F.sum(F.when(t == "signup", F.col("value"))), F.lit(0.0)).alias("_svalue"),
        F.coalesce(F.sum(F.when(t.isin("click", "view"), F.col("value"))), F.lit(0.0)).alias("_spend"),
    )


def _ad_dimensions(u: Column) -> list:
    camp_idx = u % 3
    return [
        F.concat(_pick(camp_idx, _CAMPAIGN_PREFIX), (u % 6).cast("string")).alias("campaign_name"),
        _pick(camp_idx, _CAMPAIGN_TYPES).alias("campaign_type"),
        F.concat(F.lit("AS"), (u % 15).cast("string")).alias("adset_name"),
        F.concat_ws(" | ", _pick(u % 4, _AD_PRODUCTS), _pick(u % 3, _AD_FORMATS),
                    _pick(u % 2, _AD_STAGES), F.lit("Ana"),
                    F.concat(F.lit("v"), (u % 5).cast("string"))).alias("ad_name"),
    ]


def campaign_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search-ads campaign report rows: day x hour x campaign/ad x device."""
    ev = read(spark, sf_dir, "events").select(
        F.to_date("ts").alias("date"), F.hour("ts").alias("hour_of_day"),
        (F.col("user_id") % 60).alias("u"), _pick(F.col("event_id") % 3, _DEVICES).alias("device"),
        "event_type", "value")
    g = _event_counts(ev, ["date", "hour_of_day", "u", "device"])
    u = F.col("u")
    camp = u % 6
    display = (u % 3) == 2
    pmax = (u % 3) == 1
    cpa_bid = (u % 2) == 0
    return g.select(
        "date", "hour_of_day", "device", *_ad_dimensions(u),
        F.lit(None).cast("string").alias("day_of_week"),
        (100 * F.col("_views")).alias("impressions"),
        (5 * F.col("_clicks")).alias("clicks"),
        (F.col("_spend") * 0.2).alias("cost"),
        F.col("_purchases").cast("double").alias("conversions"),
        F.col("_pvalue").alias("conversion_value"),
        (F.col("_purchases") + F.col("_signups")).cast("double").alias("all_conversions"),
        (F.col("_pvalue") + F.col("_svalue") * 0.5).alias("all_conversion_value"),
        (F.col("_views") * 0.05).alias("view_through_conversions"),
        F.when(cpa_bid, "TARGET_CPA").otherwise("TARGET_ROAS").alias("bid_strategy_type"),
        F.when(cpa_bid, F.lit(40.0)).alias("target_cpa"),
        F.when(~cpa_bid, F.lit(4.0)).alias("target_roas"),
        F.when(~display, (45 + 8 * camp).cast("double")).alias("search_impression_share"),
        F.when(~display, (5 + 3 * camp).cast("double")).alias("search_lost_is_rank"),
        F.when(~display, (30 - 4 * camp).cast("double")).alias("search_lost_is_budget"),
        F.when(~display, (20 + 5 * camp).cast("double")).alias("search_top_is"),
        F.when(~display, (10 + 2 * camp).cast("double")).alias("search_abs_top_is"),
        F.when(pmax, F.concat(F.lit("AG "), (u % 15).cast("string"))).alias("asset_group_name"),
        F.when(pmax, _pick((u % 15) % 4, _STRENGTHS)).alias("ad_strength"),
        F.lit(None).cast("string").alias("city"),
        F.concat(F.lit("Region "), (u % 7).cast("string")).alias("region"),
        F.lit("AR").alias("country"),
    )


def social_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Social-ads insight rows: day x campaign x ad set x ad x device."""
    ev = read(spark, sf_dir, "events").select(
        F.to_date("ts").alias("date_start"), (F.col("user_id") % 60).alias("u"),
        _pick(F.col("event_id") % 3, _DEVICES).alias("device"), "event_type", "value")
    g = _event_counts(ev, ["date_start", "u", "device"])
    u = F.col("u")
    v, c = F.col("_views"), F.col("_clicks")
    return g.select(
        "date_start", "device", *_ad_dimensions(u),
        _pick(u % 2, ["facebook", "instagram"]).alias("platform"),
        _pick(u % 4, _PLACEMENTS).alias("placement"),
        F.lit("AR").alias("country"),
        F.concat(F.lit("Region "), (u % 7).cast("string")).alias("region"),
        F.when((u % 7) != 0, _pick(u % 3, _RANKINGS)).alias("quality_ranking"),
        _pick((u + 1) % 3, _RANKINGS).alias("engagement_ranking"),
        _pick((u + 2) % 3, _RANKINGS).alias("conversion_ranking"),
        (100 * v).cast("double").alias("impressions"),
        (40 * v).cast("double").alias("reach"),
        (5 * c).cast("double").alias("clicks"),
        (3 * c).cast("double").alias("link_clicks"),
        (2 * c).cast("double").alias("landing_page_views"),
        (F.col("_signups") + F.col("_purchases")).cast("double").alias("add_to_cart"),
        (F.col("_purchases") + F.col("_errors")).cast("double").alias("checkout_initiated"),
        F.col("_purchases").cast("double").alias("purchases"),
        F.col("_signups").cast("double").alias("leads"),
        (F.col("_spend") * 0.2).alias("spend"),
        F.col("_pvalue").alias("purchase_value"),
        (30 * v + c).cast("double").alias("video_3s"),
        (20 * v).cast("double").alias("video_p25"),
        (12 * v + c).cast("double").alias("video_p50"),
        (7 * v).cast("double").alias("video_p75"),
        (3 * v + F.col("_errors")).cast("double").alias("video_p100"),
        (5 * v).cast("double").alias("thruplay"),
    )


def _part_metrics() -> list:
    s = F.col("p_size")
    return [
        F.col("p_retailprice").alias("cost"),
        (100 * s).cast("long").alias("impressions"),
        (5 * s).cast("long").alias("clicks"),
        (s % 4).cast("double").alias("conversions"),
        ((s % 4) * 150.0).alias("conversion_value"),
        (s % 4).cast("double").alias("all_conversions"),
        ((s % 4) * 150.0).alias("all_conversion_value"),
        _pick(F.col("p_partkey") % 3, ["Brand Search 0", "PMax 1", "Brand Search 3"]).alias("campaign_name"),
        _pick(F.col("p_partkey") % 3, ["Search", "PMax", "Search"]).alias("campaign_type"),
        F.concat(F.lit("AG "), F.col("p_brand")).alias("ad_group_name"),
    ]


_GRADES = ["Above average", "Average", "Below average"]


def keyword_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        F.col("p_name").alias("keyword"),
        _pick(k % 3, ["EXACT", "PHRASE", "BROAD"]).alias("match_type"),
        (1 + F.col("p_size") % 10).cast("int").alias("quality_score"),
        _pick(k % 3, _GRADES).alias("expected_ctr"),
        _pick(F.floor(k / 3) % 3, _GRADES).alias("ad_relevance"),
        _pick(F.floor(k / 9) % 3, _GRADES).alias("landing_page_experience"),
        *_part_metrics(),
    )


def search_term_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.col("p_name"), F.lit(" "), F.lower(F.col("p_type"))).alias("search_term"),
        F.when(k % 5 == 0, "Added").when(k % 5 == 1, "Excluded").alias("search_term_status"),
        *_part_metrics(),
    )


def ad_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        F.col("p_name").alias("headline_1"),
        F.concat_ws("|", F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("rsa_headlines"),
        _pick(k % 4, _STRENGTHS).alias("ad_strength"),
        *_part_metrics(),
    )


def auction_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auction-insight rows: one per supplier, competitor domain by nation."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")

    def rate(mult, off):
        return F.when(k % 11 != 0, ((k * mult + off) % 100).cast("double"))

    return s.select(
        F.concat(F.lit("rival"), (F.col("s_nationkey") % 8).cast("string"), F.lit(".com")).alias("competitor_domain"),
        rate(7, 10).alias("auction_is"),
        rate(37, 3).alias("auction_overlap"),
        rate(53, 11).alias("auction_outranking"),
        rate(17, 5).alias("auction_pos_above"),
        rate(29, 1).alias("auction_top_rate"),
        rate(13, 7).alias("auction_abs_top_rate"),
    )


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw touch / conversion events; the channel is the event's device (as in the ads facts)."""
    return read(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", _pick(F.col("event_id") % 3, _DEVICES).alias("channel"))
