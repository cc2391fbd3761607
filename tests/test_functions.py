"""Row-level rules: days, weeks, names, colours, sizes, ad-name parsing, lights."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mercato.functions import core, text


def _one(spark, expr, **cols):
    names = list(cols)
    row = spark.createDataFrame([tuple(cols[n] for n in names)], names) if cols else spark.range(1)
    return row.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("a,b,days", [
    (dt.datetime(2024, 1, 1, 23, 0), dt.datetime(2024, 1, 2, 1, 0), 0),
    (dt.datetime(2024, 1, 1, 10, 0), dt.datetime(2024, 1, 2, 10, 0), 1),
    (dt.datetime(2024, 1, 2, 10, 0), dt.datetime(2024, 1, 1, 22, 0), -1),
])
def test_whole_days_floor(spark, a, b, days):
    df = spark.createDataFrame([(a, b)], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(core.whole_days("b", "a")).first()[0] == days


def test_sunday_week_key_matches_strftime(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(0, 3700, 3)]
    days += [dt.date(2023, 12, 31), dt.date(2024, 1, 6), dt.date(2024, 1, 7)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = {r["d"]: r["k"] for r in df.select("d", core.sunday_week_key("d").alias("k")).collect()}
    for d in days:
        assert got[d] == d.strftime("%Y-W%U"), d


def test_safe_div_and_semaphore(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(core.safe_div("a", "b")).collect()] == [0.0, 0.0, 1.5]
    lights = spark.createDataFrame([(5.0,), (3.0,), (1.0,), (None,)], "v double").select(
        core.semaphore("v", 4, 2).alias("s"), core.semaphore("v", 3, 5, reverse=True).alias("r")).collect()
    assert [r["s"] for r in lights] == ["green", "yellow", "red", "gray"]
    assert [r["r"] for r in lights] == ["yellow", "green", "green", "gray"]


@pytest.mark.parametrize("name,base", [
    ("Biker Cadbury (2, Chocolate)", "Biker Cadbury"),
    ("Pack x 3 Bombachas Bella Algodón (3)", "Pack x 3 Bombachas Bella Algodón"),
    ("Remera Lisa - Negro - S", "Remera Lisa"),
    ("Bikini Agnes (1, Lavanda)", "Bikini Agnes"),
])
def test_base_product(spark, name, base):
    assert _one(spark, text.base_product("n"), n=name) == base


@pytest.mark.parametrize("name,cat", [
    ("Remera Lisa - Negro - S", "Remera Lisa"),
    ("Short | Jean", "Short"),
    ("Gorra / Azul", "Gorra"),
    ("Campera Puffer", "Campera"),
    ("   ", "Sin categoría"),
])
def test_category(spark, name, cat):
    assert _one(spark, text.category("n"), n=name) == cat


def test_category_null(spark):
    df = spark.createDataFrame([(None,)], "n string")
    assert df.select(text.category("n")).first()[0] == "Sin categoría"


@pytest.mark.parametrize("name,color", [
    ("Remera Lisa - Negro - S", "Negro"),
    ("Buzo blanco y negro", "Negro"),  # list order wins, not position in the name
    ("Campera Puffer", None),
    ("red widget", "Red"),
])
def test_extract_color(spark, name, color):
    assert _one(spark, text.extract_color("n"), n=name) == color


@pytest.mark.parametrize("name,sku,size", [
    ("Remera Lisa - Negro - S", "RL-N-S", "S"),
    ("Jean Mom", "JM/42", "42"),
    ("Campera one size", None, None),  # two-word sizes never match single tokens
    ("Medias", "MED-XL", "XL"),
])
def test_extract_size(spark, name, sku, size):
    df = spark.createDataFrame([(name, sku)], "n string, s string")
    assert df.select(text.extract_size("n", "s")).first()[0] == size


def test_parse_names(spark):
    df = spark.createDataFrame([("Remera Básica | UGC | TOF | Maria | v1",), ("TOF_Campera-Puffer_Video_v2",),
                                ("agosto retargeting dinamico",)], "n string")
    std = df.select(text.parse_name("n", "standard").alias("p")).first()["p"]
    assert (std["product"], std["format"], std["stage"], std["creator"], std["variation"]) == \
        ("Remera Básica", "UGC", "TOF", "Maria", "v1")
    alt = df.select(text.parse_name("n", "alternative").alias("p")).collect()[1]["p"]
    assert (alt["product"], alt["format"], alt["stage"], alt["creator"], alt["variation"]) == \
        ("Campera Puffer", "Video", "TOF", None, "v2")
    unk = df.select(text.parse_name("n", "unknown").alias("p")).collect()[2]["p"]
    assert unk["raw"] == "agosto retargeting dinamico" and unk["format"] is None and unk["product"] is None


def test_two_segment_pipe_name(spark):
    df = spark.createDataFrame([("Zapatilla | reels",)], "n string")
    p = df.select(text.parse_name("n", "standard").alias("p")).first()["p"]
    assert (p["product"], p["format"], p["stage"], p["creator"]) == ("Zapatilla", "Video", None, None)


def test_month_helpers(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 31, 10),)], "t timestamp_ntz")
    r = df.select(core.month_key("t").alias("k"), core.month_start("t").alias("m")).first()
    assert r["k"] == "2024-03" and r["m"] == dt.date(2024, 3, 1)
    assert df.select(F.expr("t - INTERVAL 3 MONTHS")).first()[0] == dt.datetime(2023, 12, 31, 10)
