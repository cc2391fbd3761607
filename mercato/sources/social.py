"""Social-ads exports (Ads Manager CSV or API JSON with action arrays) -> canonical insight rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.core import default_number
from mercato.functions.parse import parse_date_first, parse_number
from mercato.sources.exports import first_lines, groups
from mercato.sources.headers import Kind, Names, kind_of, looks_like_json, read_json_rows

# Header map and API field map of the social-ads exports.
CSV_COLUMNS = {
    'Campaign name': 'campaign_name', 'Ad set name': 'adset_name', 'Ad name': 'ad_name', 'Day': 'date_start',
    'Date': 'date_start', 'Reporting starts': 'date_start', 'Reporting ends': 'date_stop',
    'Impressions': 'impressions', 'Reach': 'reach', 'Frequency': 'frequency', 'Clicks (all)': 'clicks',
    'Link clicks': 'link_clicks', 'CPC (cost per link click)': 'cpc_link', 'CPC (all)': 'cpc',
    'CPM (cost per 1,000 impressions)': 'cpm', 'CTR (link click-through rate)': 'ctr_link', 'CTR (all)': 'ctr',
    'Results': 'results', 'Cost per result': 'cost_per_result', 'Result type': 'result_type',
    'Purchases': 'purchases', 'Purchase ROAS (return on ad spend)': 'purchase_roas',
    'Purchase conversion value': 'purchase_value', 'Cost per purchase': 'cost_per_purchase', 'Leads': 'leads',
    'Cost per lead': 'cost_per_lead', 'ThruPlays': 'thruplay', 'Video plays at 25%': 'video_p25',
    'Video plays at 50%': 'video_p50', 'Video plays at 75%': 'video_p75', 'Video plays at 100%': 'video_p100',
    '3-second video plays': 'video_3s', 'Quality ranking': 'quality_ranking',
    'Engagement rate ranking': 'engagement_ranking', 'Conversion rate ranking': 'conversion_ranking',
    'Impression device': 'device', 'Platform': 'platform', 'Placement': 'placement', 'Country': 'country',
    'Region': 'region', 'Landing page views': 'landing_page_views', 'Adds to cart': 'add_to_cart',
    'Checkouts initiated': 'checkout_initiated', 'Website purchases': 'purchases',
    'Outbound clicks': 'outbound_clicks', 'Outbound CTR': 'outbound_ctr', 'Cost per ThruPlay': 'cost_per_thruplay',
}
NUMERIC = ['impressions', 'reach', 'frequency', 'spend', 'clicks', 'link_clicks', 'cpc', 'cpc_link', 'cpm', 'ctr',
           'ctr_link', 'results', 'cost_per_result', 'purchases', 'purchase_roas', 'purchase_value',
           'cost_per_purchase', 'leads', 'cost_per_lead', 'thruplay', 'video_p25', 'video_p50', 'video_p75',
           'video_p100', 'video_3s', 'landing_page_views', 'add_to_cart', 'checkout_initiated', 'outbound_clicks',
           'outbound_ctr', 'cost_per_thruplay']
API_FIELDS = {
    'campaign_name': 'campaign_name', 'adset_name': 'adset_name', 'ad_name': 'ad_name', 'date_start': 'date_start',
    'date_stop': 'date_stop', 'impressions': 'impressions', 'reach': 'reach', 'frequency': 'frequency',
    'spend': 'spend', 'clicks': 'clicks', 'cpc': 'cpc', 'cpm': 'cpm', 'ctr': 'ctr', 'cpp': 'cpp',
    'quality_ranking': 'quality_ranking', 'engagement_rate_ranking': 'engagement_ranking',
    'conversion_rate_ranking': 'conversion_ranking', 'device': 'device', 'platform': 'platform',
    'placement': 'placement', 'country': 'country', 'region': 'region',
}
ACTIONS = {'purchases': 'purchase', 'leads': 'lead', 'link_clicks': 'link_click',
           'landing_page_views': 'landing_page_view', 'add_to_cart': 'add_to_cart',
           'checkout_initiated': 'initiate_checkout'}
DATE_FORMATS = ['yyyy-MM-dd', 'yyyy-MM-dd HH:mm:ss', "yyyy-MM-dd'T'HH:mm:ss", 'MM/dd/yyyy', 'dd/MM/yyyy',
                'MMM d, yyyy']


# columns that every analysis of the catalogue may read; an export without them gets typed nulls
BASE_TEXT = ['campaign_name', 'adset_name', 'device', 'placement', 'country', 'region', 'quality_ranking',
             'engagement_ranking', 'conversion_ranking']
BASE_NUMBERS = ['impressions', 'reach', 'frequency', 'spend', 'clicks', 'purchases', 'purchase_value', 'leads',
                'landing_page_views', 'add_to_cart', 'checkout_initiated']


def with_base_columns(df: DataFrame) -> DataFrame:
    kinds = {**dict.fromkeys(BASE_TEXT, "string"), **dict.fromkeys(BASE_NUMBERS, "double"), 'date_start': "date"}
    if 'adset_name' not in df.columns or 'ad_name' not in df.columns:
        kinds['ad_name'] = "string"
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c not in df.columns])


def action_value(actions: Column, action_type: str) -> Column:
    """Value of the first element of an action array with this type, else 0."""
    hit = F.filter(actions, lambda a: a["action_type"] == F.lit(action_type))
    return F.coalesce(F.try_element_at(hit, F.lit(1))["value"].cast("string").try_cast("double"), F.lit(0.0))


NAMES = Names(CSV_COLUMNS, {'Amount spent': 'spend'})
# Headers that tell a social-ads export, two of them at least.
KINDS = (Kind('social', frozenset({'Campaign name', 'Impressions', 'Reach'}), hits=2),)


def header_kind(headers: list[str]) -> str:
    """``social`` for the header of a social-ads export, else ``unknown``."""
    return kind_of([h.strip().strip('"') for h in headers], KINDS, 'unknown')


def read_social_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Insight rows of CSV exports; each file is read by its own header.  Headers of another kind raise an error."""
    found = groups(spark, path, first_lines(spark, path, encoding), NAMES, encoding)
    other = [",".join(g.headers)[:80] for g in found if header_kind(g.headers) == 'unknown']
    if other or not found:
        raise ValueError(f"no social-ads export: {'; '.join(other) or path}")
    rows = None
    for g in found:
        cols = {}
        for i, c in enumerate(g.headers):
            target = NAMES.column(c) or c.strip().strip('"')
            if target not in cols:
                cols[target] = F.col(f"c{i}")
        df = g.rows.where("surplus is null").select(*[e.alias(n) for n, e in cols.items()])
        for c in NUMERIC:
            if c in df.columns:
                df = df.withColumn(c, parse_number(c, default=0.0))
        if 'date_start' in df.columns:
            df = df.withColumn('date_start', F.to_date(parse_date_first('date_start', DATE_FORMATS)))
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    return with_base_columns(rows)


def read_social_json(spark: SparkSession, path: str) -> DataFrame:
    """API insight rows (list, ``{data: [...]}`` or one object) with ``actions`` / ``action_values`` arrays."""
    raw = read_json_rows(spark, path)
    if 'data' in raw.columns and isinstance(raw.schema['data'].dataType, T.ArrayType):
        raw = raw.select(F.explode('data').alias('_r')).select('_r.*')
    cols = {canon: F.col(api) for api, canon in API_FIELDS.items() if api in raw.columns}
    if 'actions' in raw.columns:
        for canon, kind in ACTIONS.items():
            cols[canon] = action_value(F.col('actions'), kind)
    if 'action_values' in raw.columns:
        cols['purchase_value'] = action_value(F.col('action_values'), 'purchase')
    df = raw.select(*[e.alias(n) for n, e in cols.items()])
    for c in NUMERIC:
        if c in df.columns:
            df = df.withColumn(c, default_number(c))
    if 'date_start' in df.columns:
        df = df.withColumn('date_start', F.to_date(parse_date_first(F.col('date_start').cast("string"), DATE_FORMATS)))
    return with_base_columns(df)


def read_social(spark: SparkSession, path: str) -> DataFrame:
    """Choose the reader by extension (CSV for .csv/.tsv/.txt, JSON for .json, else by the first character)."""
    low = path.lower()
    if low.endswith('.json'):
        return read_social_json(spark, path)
    if low.endswith(('.csv', '.tsv', '.txt')) or not looks_like_json(spark, path):
        return read_social_csv(spark, path)
    return read_social_json(spark, path)


def export_social_json(rows: DataFrame, path: str) -> None:
    """Write insight rows as API JSON lines: counts of funnel events go into ``actions``."""
    acts = F.array(*[F.struct(F.lit(kind).alias("action_type"), F.col(canon).cast("string").alias("value"))
                     for canon, kind in ACTIONS.items() if canon in rows.columns])
    vals = F.array(F.struct(F.lit("purchase").alias("action_type"),
                            F.col("purchase_value").cast("string").alias("value")))
    keep = [c for c in ('campaign_name', 'adset_name', 'ad_name', 'impressions', 'reach', 'spend', 'clicks',
                        'device', 'placement', 'region', 'country') if c in rows.columns]
    out = rows.select(*keep, F.date_format("date_start", "yyyy-MM-dd").alias("date_start"),
                      F.col("quality_ranking"), F.col("engagement_ranking").alias("engagement_rate_ranking"),
                      F.col("conversion_ranking").alias("conversion_rate_ranking"),
                      acts.alias("actions"), vals.alias("action_values"))
    out.write.mode("overwrite").json(path)
