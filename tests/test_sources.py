"""Readers on literal mini exports (the shapes the benchmark tables cannot reach)."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mercato.context import Context
from mercato.functions.parse import parse_ads_date, parse_number, parse_percent, percent_is_approximate
from mercato.operators.store.orders import orders_from_lines
from mercato.plans.catalogue import run_catalogue, write_results
from mercato.sources import search, social, store
from tests.conftest import SF_SMALL


def _write(tmp_path, name, text, encoding="utf-8"):
    p = tmp_path / name
    p.write_text(text, encoding=encoding)
    return str(p)


def test_number_and_percent_rules(spark):
    vals = ["1.234,56", "1,234.56", "$ 12", "--", "< 10%", "N/A", None, "ARS 3,50"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(parse_number("v")).collect()]
    assert got == [1234.56, 1234.56, 12.0, 0.0, 10.0, 0.0, 0.0, 3.5]
    got = [r[0] for r in df.select(parse_number("v", default=None)).collect()]
    assert got[3] is None and got[6] is None
    pct = df.select(parse_percent("v").alias("p"), percent_is_approximate("v").alias("a")).collect()
    assert pct[4]["p"] == 10.0 and pct[4]["a"] is True and pct[3]["p"] is None


def test_ads_dates(spark):
    df = spark.createDataFrame([("2024-12-31",), ("12/31/2024",), ("Jan 15, 2024",), ("bad text",)], "v string")
    got = [r[0] for r in df.select(parse_ads_date("v")).collect()]
    assert got == [dt.date(2024, 12, 31), dt.date(2024, 12, 31), dt.date(2024, 1, 15), None]


TIENDANUBE = (
    "Número de orden;Email;Fecha;Estado de la orden;Estado del pago;Total;Costo de envío;Provincia o estado;"
    "Nombre del producto;Precio del producto;Cantidad del producto;SKU;Medio de envío\n"
    "101;;31/12/2024 10:05;Cerrada;Pagado;1.234,56;0;Córdoba;Remera Lisa - Negro - S;617,28;;RL-N-S;Correo\n"
    "101;ana@x.com;31/12/2024 10:05;Cerrada;Pagado;1.234,56;0;Córdoba;Short (2, Azul);617,28;1;SH-A;Correo\n"
    "102;bo@x.com;01/01/2025 09:00;Cancelada;Reembolsado;500;350;Salta;Gorra;500;2;G-1;Retiro\n"
)


def test_tiendanube_csv(spark, tmp_path):
    path = _write(tmp_path, "orders.csv", TIENDANUBE)
    lines, platform = store.read_store_csv(spark, path)
    assert platform == "tiendanube"
    rows = {(r["order_id"], r["sku"]): r for r in lines.collect()}
    first = rows[("101", "RL-N-S")]
    assert first["date"] == dt.datetime(2024, 12, 31, 10, 5)
    assert first["total"] == pytest.approx(1234.56) and first["product_price"] == pytest.approx(617.28)
    assert first["product_qty"] == 1 and first["order_status"] == "closed" and first["email"] is None
    assert rows[("102", "G-1")]["order_status"] == "cancelled"
    assert rows[("102", "G-1")]["payment_status"] == "refunded"
    orders = {r["order_id"]: r for r in orders_from_lines(lines).collect()}
    assert orders["101"]["email"] == "ana@x.com"  # first non-null in line order


def test_shopify_and_woocommerce(spark, tmp_path):
    shop = ("Name,Email,Created at,Financial Status,Lineitem name,Lineitem quantity,Lineitem price,Total,Cancelled at\n"
            "#1,a@x,2024-12-31T10:05:00+0000,paid,Cap,1,10.00,10.00,\n"
            "#2,b@x,2024-12-30T08:00:00-0300,voided,Cap,1,10.00,10.00,2024-12-30T09:00:00-0300\n")
    lines, platform = store.read_store_csv(spark, _write(tmp_path, "shop.csv", shop))
    assert platform == "shopify"
    r = {x["order_id"]: x for x in lines.collect()}
    assert r["#1"]["date"] == dt.datetime(2024, 12, 31, 10, 5)  # zone dropped, wall clock kept
    assert r["#1"]["order_status"] == "closed" and r["#2"]["order_status"] == "cancelled"
    assert r["#2"]["payment_status"] == "cancelled"
    woo = ("Order ID,Order Status,Order Date,Billing First Name,Billing Last Name,Product Name,Quantity,"
           "Product Price,Order Total\n"
           "7,wc-completed,2024-03-01 12:00:00,Ana,Paz,Mate,2,5.5,11\n"
           "8,Custom Status ,2024-03-02 12:00:00,Bo,,Mate,1,5.5,5.5\n")
    lines, platform = store.read_store_csv(spark, _write(tmp_path, "woo.csv", woo))
    assert platform == "woocommerce"
    r = {x["order_id"]: x for x in lines.collect()}
    assert r["7"]["customer_name"] == "Ana Paz" and r["8"]["customer_name"] == "Bo"
    assert r["7"]["order_status"] == "closed" and r["8"]["order_status"] == "custom status"


ADS_KEYWORDS = (
    "Keyword report\n"
    "December 1, 2024 - December 31, 2024\n"
    "Keyword,Match type,Campaign,Quality score,Impressions,Clicks,Cost (ARS),Cost / conv. (ARS),Conversions,"
    "Search impr. share,Day\n"
    "zapatillas,Exact,Brand Search,7,\"1,200\",30,\"4.500,50\",\"1.500,17\",3,< 10%,2024-12-01\n"
    "botas,Phrase,Brand Search,--,100,2,--,--,0,45.5%,Dec 2, 2024\n"
)


def test_ads_csv_keywords(spark, tmp_path):
    rows, report, currency = search.read_ads_csv(spark, _write(tmp_path, "kw.csv", ADS_KEYWORDS))
    assert report == "keyword" and currency == "ARS"
    r = {x["keyword"]: x for x in rows.collect()}
    z = r["zapatillas"]
    assert z["impressions"] == 1200 and z["cost"] == pytest.approx(4500.50)
    assert z["cost_per_conversion"] == pytest.approx(1500.17)  # longest prefix wins over "Cost"
    assert z["quality_score"] == 7 and z["search_impression_share"] == 10.0
    assert r["botas"]["quality_score"] is None and r["botas"]["cost"] == 0.0


def test_ads_csv_auction_share(spark, tmp_path):
    text = ("Display URL domain,Impression share,Overlap rate,Outranking share\n"
            "rival.com,35%,72%,40%\nyou,< 10%,--,--\n")
    rows, report, _ = search.read_ads_csv(spark, _write(tmp_path, "auction.csv", text))
    r = {x["competitor_domain"]: x for x in rows.collect()}
    assert r["rival.com"]["auction_is"] == 35.0 and r["rival.com"]["auction_overlap"] == 72.0
    assert r["you"]["auction_overlap"] is None


def test_ads_json_nested(spark, tmp_path):
    doc = {"results": [
        {"campaign": {"name": "Brand", "advertisingChannelType": "x", "advertising_channel_type": "SEARCH",
                      "target_cpa": {"target_cpa_micros": 25000000}},
         "ad_group_criterion": {"keyword": {"text": "zapas", "match_type": "EXACT"}},
         "metrics": {"impressions": "120", "clicks": "7", "cost_micros": "3500000", "ctr": 0.0583,
                     "conversions": 1.5},
         "segments": {"date": "2024-12-01", "device": "MOBILE"}}]}
    rows = search.read_ads_json(spark, _write(tmp_path, "api.json", json.dumps(doc))).collect()
    r = rows[0]
    assert r["campaign_name"] == "Brand" and r["campaign_type"] == "Search" and r["keyword"] == "zapas"
    assert r["impressions"] == 120 and r["cost"] == pytest.approx(3.5) and r["target_cpa"] == pytest.approx(25.0)
    assert r["ctr"] == pytest.approx(5.83) and r["date"] == dt.date(2024, 12, 1)


def test_social_csv(spark, tmp_path):
    text = ("Campaign name,Ad set name,Ad name,Day,Impressions,Reach,Amount spent (ARS),Purchases,"
            "Purchase conversion value\n"
            "C1,AS1,\"Remera | UGC | TOF | Ana | v1\",2024-12-01,\"1,000\",800,\"1.234,56\",2,\"5.000,00\"\n"
            "C1,AS1,\"Remera | UGC | TOF | Ana | v1\",2024-12-02,500,400,--,,0\n")
    df = social.read_social(spark, _write(tmp_path, "meta.csv", text))
    r = sorted(df.collect(), key=lambda x: x["date_start"])
    assert r[0]["spend"] == pytest.approx(1234.56) and r[0]["impressions"] == 1000.0
    assert r[0]["purchase_value"] == pytest.approx(5000.0)
    assert r[1]["spend"] == 0.0 and r[1]["purchases"] == 0.0 and r[1]["date_start"] == dt.date(2024, 12, 2)


def test_social_json_actions(spark, tmp_path):
    doc = {"data": [
        {"campaign_name": "C1", "date_start": "2024-12-01", "impressions": "100", "spend": "10.5",
         "actions": [{"action_type": "purchase", "value": "2"}, {"action_type": "purchase", "value": "9"},
                     {"value": "4"}, {"action_type": "link_click", "value": "7"}],
         "action_values": [{"action_type": "purchase", "value": "55.5"}]},
        {"campaign_name": "C2", "date_start": "2024-12-02", "impressions": "50", "spend": "3"}]}
    df = social.read_social(spark, _write(tmp_path, "meta.json", json.dumps(doc)))
    r = {x["campaign_name"]: x for x in df.collect()}
    assert r["C1"]["purchases"] == 2.0 and r["C1"]["link_clicks"] == 7.0  # first of a type wins
    assert r["C1"]["purchase_value"] == 55.5 and r["C1"]["leads"] == 0.0
    assert r["C2"]["purchases"] == 0.0 and r["C2"]["spend"] == 3.0


def test_catalogue_runner(spark, tmp_path):
    ctx = Context.from_fixture(spark, SF_SMALL)
    results, status = run_catalogue(ctx, "social", "lite")
    st = {r["analysis"]: r["status"] for r in status.collect()}
    assert st["ma_dashboard"] == "ok" and set(st.values()) <= {"ok", "skipped"}
    write_results({k: results[k] for k in ["ma_dashboard", "ma_daily"]}, status, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out" / "ma_daily"))
    assert back.count() == results["ma_daily"].count()
    empty = Context(spark, lines=lambda: ctx.lines)
    _, st2 = run_catalogue(empty, "social", "lite")
    assert {r["status"] for r in st2.collect()} == {"skipped"}


def test_ads_folder_and_list_inputs(spark, tmp_path):
    folder = tmp_path / "exports"
    folder.mkdir()
    _write(folder, "kw.csv", ADS_KEYWORDS)
    _write(folder, "camp.csv", "Campaign,Day,Impressions,Clicks,Cost (ARS)\nBrand,2024-12-01,100,5,\"1.000,00\"\n")
    _write(folder, "notes.md", "ignored")
    got = search.read_ads_inputs(spark, str(folder))
    assert set(got) == {"keyword", "campaign"}
    assert got["campaign"].first()["cost"] == 1000.0
    both = search.read_ads_inputs(spark, f"{folder}/kw.csv,{folder}/camp.csv")
    assert both["keyword"].count() == 2


def test_latin1_store_export(spark, tmp_path):
    p = tmp_path / "latin.csv"
    p.write_text(TIENDANUBE, encoding="latin-1")
    lines, platform = store.read_store_csv(spark, str(p), encoding="ISO-8859-1")
    assert platform == "tiendanube"
    assert {r["state"] for r in lines.collect()} == {"Córdoba", "Salta"}


def test_header_below_a_long_preamble(spark, tmp_path):
    text = "".join(f"Note {i}\n" for i in range(60)) + "Campaign,Day,Impressions,Clicks,Cost (ARS)\nNote 3,2024-12-01,100,5,10\n"
    rows, report, currency = search.read_ads_csv(spark, _write(tmp_path, "long.csv", text))
    assert (report, currency) == ("campaign", "ARS")
    assert [(r["campaign_name"], r["impressions"], r["cost"]) for r in rows.collect()] == [("Note 3", 100, 10.0)]
    with pytest.raises(ValueError):
        search.read_ads_csv(spark, _write(tmp_path, "none.csv", "a,b\n1,2\n"))


def test_quoted_line_breaks(spark, tmp_path):
    terms = 'Search terms\nSearch term,Campaign,Impressions,Clicks\n"red\nshoe",C,10,1\nblue,C,5,0\n'
    rows, report, _ = search.read_ads_csv(spark, _write(tmp_path, "terms.csv", terms))
    assert report == "search_term"
    assert {r["search_term"]: r["impressions"] for r in rows.collect()} == {"red\nshoe": 10, "blue": 5}
    shop = ("Name,Email,Created at,Financial Status,Lineitem name,Lineitem quantity,Lineitem price,Total\n"
            '#1,a@x,2024-12-31T10:05:00+0000,paid,"Cap\nline ""two""",1,10.00,10.00\n')
    lines, _ = store.read_store_csv(spark, _write(tmp_path, "shop.csv", shop))
    assert [(r["order_id"], r["product_name"], r["total"]) for r in lines.collect()] == [("#1", 'Cap\nline "two"', 10.0)]
    meta = 'Campaign name,Ad name,Day,Impressions\nC,"a\nb",2024-12-01,7\n'
    assert [r["ad_name"] for r in social.read_social(spark, _write(tmp_path, "meta.csv", meta)).collect()] == ["a\nb"]


def test_surplus_fields_do_not_depend_on_the_columns_read(spark, tmp_path):
    text = "Order ID,Order Status,Product Name,Order Total\n" + "".join(
        f"{i},wc-completed,Mate,5{',x' if i % 2 else ''}\n" for i in range(6)) + "9,wc-completed\n"
    path = _write(tmp_path, "woo.csv", text)
    lines, platform = store.read_store_csv(spark, path)
    assert platform == "woocommerce" and store.malformed_rows(spark, path) == 3
    assert lines.count() == lines.select("total").count() == len(lines.select("total").collect()) == len(lines.collect()) == 4


def test_search_json_lines_and_wrapped_documents(spark, tmp_path):
    record = {"campaign": {"name": "B"}, "metrics": {"impressions": "3"}}
    lines = _write(tmp_path, "rows.json", "".join(json.dumps(record) + "\n" for _ in range(5)))
    assert search.read_ads_json(spark, lines).count() == 5
    for name, doc in (("a.json", [record] * 4), ("b.json", {"data": [record] * 3}), ("c.json", {"results": [record] * 2})):
        n = len(doc) if isinstance(doc, list) else len(next(iter(doc.values())))
        for text in (json.dumps(doc), json.dumps(doc, indent=1)):
            assert search.read_ads_json(spark, _write(tmp_path, name, text)).count() == n


def test_minimal_exports_run_the_catalogue(spark, tmp_path):
    ads = "Campaign,Day,Impressions,Clicks,Cost,Conversions\n" + "".join(f"C{i % 2},2024-12-{i + 1:02d},100,{i},10,{i % 3}\n" for i in range(20))
    rows, _, _ = search.read_ads_csv(spark, _write(tmp_path, "ads.csv", ads))
    _, status = run_catalogue(Context(spark, campaign=rows, keyword=rows, search_term=rows, ad=rows, auction=rows), "search", "lite")
    assert {r["analysis"]: r["status"] for r in status.collect()}["ga_benchmarks"] == "ok"
    meta = "Campaign name,Ad set name,Ad name,Impressions,Amount spent (USD)\nC,A,a,10,1\nC,A,b,20,2\n"
    _, status = run_catalogue(Context(spark, social=social.read_social(spark, _write(tmp_path, "meta.csv", meta))), "social", "lite")
    assert {r["status"] for r in status.collect()} <= {"ok", "skipped"}


def test_every_catalogue_key_is_registered():
    from mercato.plans.catalogue import REQUIRED, SETS
    from mercato.plans.registry import REGISTRY
    assert not {k for keys in SETS.values() for k in keys} - set(REGISTRY)
    assert not {k for columns in REQUIRED.values() for users in columns.values() for k in users} - set(REGISTRY)


def test_an_error_is_a_status_row(spark, tmp_path, monkeypatch):
    """A failing analysis ends neither the run nor the others; each plan runs once; missing columns skip."""
    from mercato.plans import catalogue
    runs = spark.sparkContext.accumulator(0)

    def counted(ctx):
        def once(it):
            for b in it:
                runs.add(b.num_rows)
                yield b
        return ctx.lines.select("order_id").mapInArrow(once, "order_id string")
    monkeypatch.setitem(catalogue.SETS, ("store", "tiny"), ["good", "bad", "broken", "ec_sku_variants", "none"])
    for key, fn in (("good", counted), ("bad", lambda ctx: ctx.lines.select(F.raise_error(F.lit("no luck")).alias("x"))),
                    ("broken", lambda ctx: ctx.lines.select("no_such_column")), ("none", lambda ctx: ctx.lines.where("false"))):
        monkeypatch.setitem(catalogue.REGISTRY, key, fn)
    lines = spark.createDataFrame([("a", None), ("b", None)], "order_id string, sku string")
    results, status = catalogue.run_catalogue(Context(spark, lines=lines), "store", "tiny", path=str(tmp_path / "out"), fmt="json")
    got = {r["analysis"]: (r["status"], r["reason"]) for r in status.collect()}
    assert got["good"] == ("ok", None) and got["none"] == ("skipped", "insufficient data") and got["ec_sku_variants"] == ("skipped", "missing columns: sku")
    assert got["bad"][0] == got["broken"][0] == "error" and "no_such_column" in got["broken"][1]
    assert results["good"].count() == 2 and runs.value == 2 and spark.read.json(str(tmp_path / "out" / "good")).count() == 2


def test_month_end_comparison(spark):
    from mercato.plans.registry import REGISTRY
    days = spark.sql("select explode(sequence(date'2023-03-01', date'2024-03-31')) as date").withColumns(
        {"cost": F.lit(1.0), "conversions": F.lit(1.0), "conversion_value": F.lit(1.0)})
    got = {r["period"]: (r["days"], r["cost"]) for r in REGISTRY["ext_same_period_comparison"](Context(spark, campaign=days)).collect()}
    assert got == {"current": (31, 31.0), "previous_month": (29, 29.0), "previous_year": (31, 31.0)}


def test_one_row_per_order(spark):
    orders = Context.from_fixture(spark, SF_SMALL).orders
    assert orders.count() == orders.select("order_id").distinct().count()


def test_folder_of_exports_with_different_headers(spark, tmp_path):
    folder = tmp_path / "ads exports"
    folder.mkdir()
    _write(folder, "a [1].csv", "Report\nCampaign,Day,Clicks,Cost (USD)\nA,2024-01-01,1,10\nB,2024-01-02,2,20\n")
    _write(folder, "b%20.csv", "Cost (EUR);Clicks;Campaign;Impressions\n30;3;C;300\n")
    _write(folder, "c.csv", "Campaign,Day,Clicks,Cost (USD)\nD,2024-01-04,4,40\n")
    _write(folder, "empty.csv", "")
    rows, report, currency = search.read_ads_csv(spark, str(folder))
    assert (report, currency) == ("campaign", "EUR,USD")
    got = sorted((r.campaign_name, r.clicks, r.cost, r.impressions) for r in rows.collect())
    assert got == [("A", 1, 10.0, None), ("B", 2, 20.0, None), ("C", 3, 30.0, 300), ("D", 4, 40.0, None)]
    _write(folder, "part2.csv", "E,2024-01-05,5,50\n")
    with pytest.raises(ValueError, match="part2.csv"):
        search.read_ads_csv(spark, str(folder))


def test_folders_of_store_and_social_exports(spark, tmp_path):
    """Each file by its own header: other column order, other separator, other platform."""
    shop = tmp_path / "shop"
    shop.mkdir()
    (shop / "a.csv").write_text("Name,Email,Created at,Financial Status,Subtotal,Total,Lineitem name,Lineitem quantity\n"
                                "#1,a@x,2024-12-31T10:05:00+0000,paid,80,99,Cap,1\n")
    (shop / "b.csv").write_text("Name;Total;Subtotal;Created at;Financial Status;Lineitem name;Lineitem quantity;Note\n"
                                "#2;99;80;2024-12-31T10:05:00+0000;paid;Cap;1;hi\n")
    (shop / "c.csv").write_text("Order ID,Order Status,Order Date,Product Name,Quantity,Product Price,Order Total\n"
                                "7,wc-completed,2024-03-01 12:00:00,Mate,2,5.5,11\n")
    lines, platform = store.read_store_csv(spark, str(shop))
    assert platform == "shopify,woocommerce"
    got = {r["order_id"]: (r["total"], r["subtotal"], r["order_status"], r["Note"]) for r in lines.collect()}
    assert got == {"#1": (99.0, 80.0, "closed", None), "#2": (99.0, 80.0, "closed", "hi"), "7": (11.0, None, "closed", None)}
    meta = tmp_path / "meta"
    meta.mkdir()
    (meta / "a.csv").write_text("Campaign name,Day,Impressions,Reach,Amount spent (USD)\nC1,2024-12-01,900,5,7\n")
    (meta / "b.csv").write_text("Campaign name,Day,Amount spent (EUR),Reach,Impressions\nC2,2024-12-01,7,5,900\n")
    got = {r["campaign_name"]: (r["impressions"], r["spend"]) for r in social.read_social_csv(spark, str(meta)).collect()}
    assert got == {"C1": (900.0, 7.0), "C2": (900.0, 7.0)}


def test_social_header_check(spark, tmp_path):
    assert social.header_kind(["Campaign name", " Reach"]) == "social" and social.header_kind(["Reach", "Name"]) == "unknown"
    with pytest.raises(ValueError, match="Name,Total"):
        social.read_social_csv(spark, _write(tmp_path, "x.csv", "Name,Total\n1,2\n"))


@pytest.fixture()
def tiny_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_file_in_many_ranges(spark, tmp_path, tiny_ranges):
    """Quoted line breaks, doubled and stray quotes, CRLF and a field longer than several ranges: the rows of a whole read."""
    import random
    from mercato.sources import ranges
    rnd = random.Random(4)

    def value():
        x = "".join(rnd.choice(["a", "b", "é", " ", '"', "\n", ",", ";", "\r\n", '5" pipe', "x" * 30]) for _ in range(rnd.randrange(0, 6)))
        if any(c in x for c in '",\n\r') and rnd.random() < 0.95 or rnd.random() < 0.2:
            return '"' + x.replace('"', '""') + '"'
        return x.replace("\n", "").replace("\r", "").replace(",", "").lstrip('"')
    rows = [",".join(value() for _ in range(4)) for _ in range(2000)]
    rows.insert(1000, 'a,"' + "long\n" * 3000 + '",c,d')
    path = tmp_path / "x.csv"
    path.write_text("h1,h2,h3,h4\n" + "\n".join(rows) + "\n", newline="")
    read = ranges.pieces(spark, str(path), "\n")
    assert read.rdd.getNumPartitions() > 20
    kinds = read.select("f").distinct().withColumn("kind", F.lit(0).cast("long"))
    got = ranges.csv_fields(ranges.records(spark, str(path), kinds, [ranges.csv_scan(",")]), 4, ",").orderBy("line_no").collect()
    want = (spark.read.option("multiLine", True).option("escape", '"').option("columnPruning", False)
            .schema("a string, b string, c string, d string").csv(str(path)).collect())
    assert [tuple(r["fields"][:4]) for r in got] == [tuple(r) for r in want]
    assert len({r["line_no"] for r in got}) == len(got)


def test_large_exports_in_many_ranges(spark, tmp_path, tiny_ranges):
    notes = ['"two\nlines, ""quoted"""', "plain", '"; not a separator"', "'"]
    text = "Campaign report\n\"All\ntime\"\nCampaign,Day,Impressions,Clicks,Cost (USD),Ad group\n" + "".join(
        f"C{i % 7},2024-12-{i % 28 + 1:02d},{i},{i % 5},\"{i},50\",{notes[i % 4]}\n" for i in range(1500))
    rows, kind, currency = search.read_ads_csv(spark, _write(tmp_path, "big.csv", text))
    assert (kind, currency) == ("campaign", "USD") and rows.rdd.getNumPartitions() > 1
    got = rows.agg(F.count("*"), F.sum("impressions"), F.sum("cost"), F.count_distinct("ad_group_name")).first()
    assert tuple(got) == (1500, sum(range(1500)), sum(i + 0.5 for i in range(1500)), 4)
    latin = "Número de orden;Email;Fecha;Estado de la orden;Total;Nombre del producto\n" + "".join(
        f"{i};a{i}@x;31/12/2024 10:05;Cerrada;{i},50;\"Ñandú\n{i % 3}\"\n" for i in range(800))
    path = tmp_path / "latin.csv"
    path.write_bytes(latin.encode("latin-1"))
    lines, platform = store.read_store_csv(spark, str(path), encoding="ISO-8859-1")
    assert platform == "tiendanube"
    assert tuple(lines.agg(F.count("*"), F.sum("total"), F.count_distinct("product_name"), F.min("date")).first()) == (
        800, sum(i + 0.5 for i in range(800)), 3, dt.datetime(2024, 12, 31, 10, 5))
    order = [r["order_id"] for r in lines.orderBy("line_no").collect()]
    assert order == [str(i) for i in range(800)]


@pytest.mark.parametrize("form", ["array", "data", "results", "object"])
@pytest.mark.parametrize("indent", [None, 1])
def test_json_documents_in_many_ranges(spark, tmp_path, tiny_ranges, form, indent):
    rows = [{"campaign": {"name": f"C{i}", "note": 'a }{ ][ " \\ \n x' * (i % 3)}, "metrics": {"impressions": str(i), "cost_micros": i * 1000000},
             "segments": {"date": "2024-12-01"}, "l": [{"a": 1}, {"b": [2, {}]}]} for i in range(400)]
    doc = {"array": rows, "data": {"data": rows, "paging": {"cursors": {"after": "x"}, "z": [{"q": 1}]}}, "results": {"results": rows},
           "object": {"paging": {"next": None}, "data": rows}}[form]
    got = search.read_ads_json(spark, _write(tmp_path, "api.json", json.dumps(doc, indent=indent)))
    assert tuple(got.agg(F.count("*"), F.sum("impressions"), F.sum("cost"), F.count_distinct("campaign_name")).first()) == (400, 79800, 79800.0, 400)


def test_pages_of_json_lines(spark, tmp_path):
    pages = "\n".join(json.dumps({"data": [{"campaign_name": f"C{p}{i}", "impressions": "1"} for i in range(3)]}) for p in range(4))
    assert social.read_social_json(spark, _write(tmp_path, "pages.json", pages)).count() == 12


def test_network_breakdown(spark, tmp_path):
    text = ("Campaign,Network,Day,Impressions,Clicks,Cost (USD),Conversions,Conv. value\n"
            "A,Search,2024-12-01,100,10,50,5,500\nA,Search partners,2024-12-01,300,10,30,1,50\nB,Search,2024-12-02,100,20,20,4,400\nB,,2024-12-02,9,9,9,9,9\n")
    rows, _, _ = search.read_ads_csv(spark, _write(tmp_path, "net.csv", text))
    from mercato.operators.social.extensions import network_breakdown
    df = network_breakdown(Context(spark, campaign=rows))
    got = {r["network"]: r for r in df.collect()}
    assert {n: (r["kind"], r["cost"], r["clicks"], r["cost_share_pct"], r["conversions_share_pct"]) for n, r in got.items()} == {
        "Search": ("search", 70.0, 30, 70.0, 90.0), "Search partners": ("search_partners", 30.0, 10, 30.0, 10.0), "total": ("total", 100.0, 40, 100.0, 100.0)}
    assert got["total"]["roas"] == 9.5 and got["Search"]["cpa"] == pytest.approx(70 / 9)
    plan = network_breakdown(Context(spark, campaign=spark.createDataFrame(rows.collect(), rows.schema)))._jdf.queryExecution()
    assert plan.sparkPlan().toString().count("Window") == 0 and plan.executedPlan().toString().count("hashpartitioning") == 1


def test_rows_are_not_dealt_by_file(spark, tmp_path, tiny_ranges):
    """One file's rows stay in the tasks that read its ranges, and its records are split once."""
    path = _write(tmp_path, "one.csv", "Número de orden;Email;Fecha;Estado de la orden;Total;Nombre del producto\n" + "".join(
        f"{i};a{i}@x;31/12/2024 10:05;Cerrada;{x};Ñandú\n" for i, x in enumerate(["1.234,50", "USD 12.5", "-7", "1.2.3", "12", "INF", "", "-"] * 500)))
    lines, platform = store.read_store_csv(spark, path)
    assert platform == "tiendanube" and lines.rdd.getNumPartitions() > 1
    plan = lines._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "from_csv" not in plan
    got = lines.orderBy(F.col("order_id").cast("int")).select("total").collect()
    assert [r[0] for r in got[:8]] == [1234.5, 12.5, -7.0, None, 12.0, None, None, None] and len(got) == 4000


def _order_lines(spark, n):
    return spark.range(n).select(
        (F.col("id") / 4).cast("int").cast("string").alias("order_id"), F.lit("a@x").alias("email"), F.lit("closed").alias("order_status"),
        F.lit(dt.datetime(2024, 12, 31, 10, 5)).alias("date"), F.lit(99.5).alias("total"), F.concat(F.lit("Ñandú; "), "id").alias("product_name"),
        F.lit(2).alias("product_qty"))


def test_an_export_takes_little_disk(spark, tmp_path, monkeypatch):
    """Export and scratch tables of one read stay below the text itself; files are short, as a task reads one whole."""
    from pathlib import Path

    from mercato.sources import exports, ranges
    labels, kept = [], []
    for module in (exports, ranges):
        def spy(df, label, *rest, real=module.written):
            labels.append(label)
            kept.append(real(df, label, *rest))
            return kept[-1]
        monkeypatch.setattr(module, "written", spy)
    monkeypatch.setattr(store, "EXPORT_ROWS", 700, raising=False)
    store.export_tiendanube_csv(_order_lines(spark, 6000).repartition(2, "order_id"), str(tmp_path / "x"))
    files = [p for p in (tmp_path / "x").iterdir() if p.name.startswith("part-")]
    text = sum(len(r["value"].encode()) + 1 for r in spark.read.text(str(tmp_path / "x")).collect())
    lines, platform = store.read_store_csv(spark, str(tmp_path / "x"))
    got = lines.select("order_id", "email", "order_status", "date", "total", "product_name", "product_qty")
    want = _order_lines(spark, 6000)
    assert platform == "tiendanube" and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    held = [p for t in kept for p in Path(t._written_at.removeprefix("file:")).rglob("part-*")]
    assert sum(p.stat().st_size for p in [*files, *held]) < text / 2
    assert len(files) >= 8 and "range-parts" not in labels
    assert kept[labels.index("export-fields")].where("part = 0 and record is not null").isEmpty()


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = {str(x) for x in _each(blocks.getAllFiles())}
    store.export_tiendanube_csv(_order_lines(spark, 4000).repartition(3, "order_id"), str(tmp_path / "x"))
    left = {str(x) for x in _each(blocks.getAllFiles())} - before
    assert not [x for x in left if "shuffle_" in x], left


def _each(scala_seq):
    it = scala_seq.iterator()
    while it.hasNext():
        yield it.next()


def test_headers_above_and_inside_records(spark, tmp_path, tiny_ranges):
    """Rows above a header and its repeats are no rows; a header line that stands inside quotes only is an error."""
    head = "Campaign,Day,Clicks,Cost (USD)\r\n"
    rows = [f"C{i},2024-01-01,{i},1\r\n" for i in range(400)]
    text = f'"All\n{"time " * 90}\n",x\r\nnotes,more,and,more,yet\r\n' + head + "".join(rows[:200]) + head + '"C\nx",2024-01-02,7,1\r\n' + "".join(rows[200:])
    got, kind, _ = search.read_ads_csv(spark, _write(tmp_path, "ads.csv", text))
    assert kind == "campaign" and tuple(got.agg(F.count("*"), F.sum("clicks"), F.sum("cost")).first()) == (401, sum(range(400)) + 7, 401.0)
    with pytest.raises(Exception, match="inside a quoted field: Campaign,Day"):
        search.read_ads_csv(spark, _write(tmp_path, "lost.csv", f'a,"b\n{head}",c\nd,e,f\n'))


def test_line_view_deals_out_the_tables_own_columns(spark):
    """Columns derived from an order are made once its lines have met it, not carried through the joins."""
    from mercato.sources.fixtures import lines_view
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lines_view(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert 0 < plan.rindex("@example.com") < plan.index("Exchange hashpartitioning")
