"""Saved search-ads reports on literal rows: statuses, periods, shares, missing columns, top rows."""

import datetime as dt

import pytest

from mercato.operators.search.saved import REPORTS, Report, saved_report

SCHEMA = ("date date, campaign_name string, campaign_status string, campaign_type string, search_impression_share double, "
          "search_lost_is_rank double, impressions long, clicks long, cost double, conversions double")


def day(n):
    return dt.date(2024, 1, n)


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([
        (day(1), "a", "Enabled", "Search", 50.0, 10.0, 100, 10, 5.0, 1.0),
        (day(2), "a", " ENABLED ", "search", 10.0, 40.0, 100, 0, 5.0, 0.0),
        (day(3), "a", "", "Search", None, None, 7, 1, 1.0, 0.0),
        (day(9), "a", "Enabled", "Search", 90.0, 0.0, 1000, 99, 99.0, 9.0),
        (day(1), "b", "Paused", "Search", 50.0, 1.0, 500, 5, 50.0, 1.0),
        (day(2), "c", None, "Display", 0.0, None, None, None, None, None),
        (None, "d", "enabled", "Search", 20.0, 0.0, 10, 1, 1.0, 1.0),
    ], SCHEMA)


def found(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_disabled_campaigns_and_other_days_stay_out(rows):
    out = found(saved_report(rows, REPORTS["devices"], "2024-01-01", "2024-01-03"), "campaign_name")
    assert set(out) == {("a",), ("c",)}  # b is paused, d has no date
    a, c = out[("a",)], out[("c",)]
    assert (a.impressions, a.clicks, a.cost, a.conversions, a.device) == (207, 11, 11.0, 1.0, None)
    assert a.cpa == pytest.approx(11.0) and a.ctr == pytest.approx(1100 / 207)
    assert (c.impressions, c.clicks, c.cost, c.ctr, c.cpa) == (0, 0, 0.0, 0.0, 0.0)


def test_without_bounds_all_rows_count(rows):
    out = found(saved_report(rows, REPORTS["devices"]), "campaign_name")
    assert out[("a",)].impressions == 1207 and ("d",) in out and ("b",) not in out


def test_shares_are_weighted_by_eligible_impressions(rows):
    out = found(saved_report(rows, REPORTS["impression_share"], "2024-01-01", "2024-01-03"), "campaign_name")
    assert set(out) == {("a",)}  # c is no search campaign
    # 100 of 200 and 100 of 1000 eligible impressions
    assert out[("a",)].search_impression_share == pytest.approx(200 / 1200 * 100)
    assert out[("a",)].search_lost_is_rank == pytest.approx((10 * 200 + 40 * 1000) / 1200)
    assert out[("a",)].search_top_is is None  # the export has no such column


def test_weekdays_come_from_the_export_or_the_date(rows, spark):
    out = found(saved_report(rows, REPORTS["weekdays"], "2024-01-01", "2024-01-02"), "campaign_name", "weekday")
    assert {k for k in out if k[0] == "a"} == {("a", "Monday"), ("a", "Tuesday")}
    named = spark.createDataFrame([("a", "SUNDAY", 1, 1, 1.0, 1.0), ("a", " ", 1, 1, 1.0, 1.0)],
                                  "campaign_name string, day_of_week string, impressions long, clicks long, cost double, conversions double")
    assert set(found(saved_report(named, REPORTS["weekdays"]), "weekday")) == {("Sunday",), (None,)}


def test_top_rows_and_ties(spark):
    terms = spark.createDataFrame([(f"t{i:03d}", "c", "g", 1 if i else 0, 1, float(i // 2), 0.0) for i in range(300)],
                                  "search_term string, campaign_name string, ad_group_name string, impressions long, clicks long, cost double, conversions double")
    out = [r.search_term for r in saved_report(terms, REPORTS["search_terms"]).collect()]
    assert out == [f"t{i:03d}" for j in range(149, 99, -1) for i in (2 * j, 2 * j + 1)]
    rest = Report("search_term", ("search_term",), ("cost",), enabled=(), seen=True)
    assert saved_report(terms, rest).where("search_term = 't000'").isEmpty()  # never shown


@pytest.mark.parametrize("name", REPORTS)
def test_no_rows_and_no_optional_columns(spark, name):
    none = spark.createDataFrame([], "campaign_name string, campaign_type string, asset_group_name string, cost double")
    out = saved_report(none, REPORTS[name], "2024-01-01", "2024-01-31")
    assert out.columns == [*REPORTS[name].dimensions, *REPORTS[name].metrics] and out.isEmpty()
