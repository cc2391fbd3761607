"""Typed parsing of exported text values (numbers, percentages, dates), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercato.functions.core import col

# Tokens the exports use for "no value".
NULL_TOKENS = ['', '-', '--', 'N/A', 'nan', 'None']
# Date formats of the search-ads exports, tried in this order (first success per row).
ADS_DATE_FORMATS = ['yyyy-MM-dd', 'MM/dd/yyyy', 'dd/MM/yyyy', 'MMM d, yyyy', 'MMMM d, yyyy']


def is_null_token(c) -> Column:
    s = F.trim(col(c))
    return s.isNull() | s.isin(*NULL_TOKENS)


def parse_number(c, default: float | None = 0.0) -> Column:
    """Number from export text: currency codes/symbols, %, < > removed; a trailing ``,dd`` means the
    comma is the decimal mark (dots are then thousands), otherwise commas are thousands separators.

    Null tokens give ``default`` (0 in the ads exports; ``None`` for the store export).
    """
    s = F.trim(col(c))
    s = F.trim(F.regexp_replace(s, r"[A-Z]{3}|\$|€|£", ""))
    s = F.regexp_replace(s, r"[%<>\s]", "")
    eu = s.rlike(r",\d{2}$")
    s = F.when(eu, F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(s, ",", ""))
    # digits, points and signs alone are left as they are by the steps above
    v = F.when(col(c).rlike(r"^[0-9][0-9.\-]*$"), col(c).try_cast("double")).otherwise(s.try_cast("double"))
    out = F.when(is_null_token(c), F.lit(default).cast("double")).otherwise(v)
    return out if default is None else F.coalesce(out, F.lit(default).cast("double"))


def parse_percent(c) -> Column:
    """Percentage text ``"< 10%"`` -> 10.0 (approximate marks dropped); null tokens -> null."""
    s = F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"[<>%\s]", ""), ",", "")
    return F.when(is_null_token(c), F.lit(None).cast("double")).otherwise(s.try_cast("double"))


def percent_is_approximate(c) -> Column:
    return F.trim(col(c)).rlike(r"^[<>]")


def parse_date_first(c, formats: list[str]) -> Column:
    """First format that parses the value (per row), as a zone-less timestamp."""
    s = F.trim(col(c))
    parsed = [F.try_to_timestamp(s, F.lit(f)) for f in formats]
    return F.when(is_null_token(c), F.lit(None)).otherwise(F.coalesce(*parsed)).cast("timestamp_ntz")


def strip_zone(c) -> Column:
    """Drop a trailing zone (``Z``, ``+0000``, ``-03:00``) without converting the wall clock."""
    return F.regexp_replace(F.trim(col(c)), r"\s*(Z|[+-]\d{2}:?\d{2})$", "")


def parse_ads_date(c) -> Column:
    return F.to_date(parse_date_first(c, ADS_DATE_FORMATS))
