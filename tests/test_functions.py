"""Scalar expressions and traps, case by case."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from bidlens.functions import fields, titles
from bidlens.operators import ingest, market, outcomes
from bidlens.sources.adapters import TITLES

REF = datetime(2025, 1, 15, 14, 30)


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_parse_price(spark):
    assert apply(spark, ["£12.50", "£180", "£1,234.56", "£1,740.70", "Free postage", "", None, "£10.00 to £20.00"], fields.parse_price) == [12.5, 180, 1234.56, 1740.7, None, None, None, 10]


def test_parse_end_time(spark):
    cases = {
        "Today 21:44": datetime(2025, 1, 16, 4, 44), "(Today 21:44)": datetime(2025, 1, 16, 4, 44), "Fri, 10:00": datetime(2025, 1, 17, 17), "Wed, 10:00": datetime(2025, 1, 22, 17), "18/01, 09:00": datetime(2025, 1, 18, 16),
        "18/01, 23:00": datetime(2025, 1, 19, 6), "14/01, 09:00": datetime(2026, 1, 14, 16), "31/02, 10:00": None, "Abc, 10:00": None, "Today": None, "": None, "junk": None, None: None,
    }
    assert apply(spark, list(cases), lambda c: fields.parse_end_time(c, F.lit(REF))) == list(cases.values())


def test_parse_sold_date(spark):
    assert apply(spark, ["Sold 1 Dec 2025", "5 Jan 2024", "2025-12-01", "", None], fields.parse_sold_date) == [date(2025, 12, 1), date(2024, 1, 5), None, None, None]


EXPECTED = {
    "GPU": [("Asus", "RTX 3060", 12), ("Msi", "RTX 3060 TI", 8), ("Zotac", "RTX 4070 TI", 16), ("Sapphire", "RX 7900 XT", 24), ("Xfx", "RX 580", 8), ("Inno3D", "GTX 1080 TI", 11), ("NVIDIA", None, 12), ("Gigabyte", "RTX 2080 SUPER", 8), ("AMD", "GTX 1660", 6), ("Palit", "GTX 970", 4), ("AMD", "RX 6700 XT", 12), ("Pny", "RTX 4090", None)],
    "CPU": [("Intel", "i5-6600K", "LGA1151", 4), ("Intel", "i5-9400F", None, 6), ("", "i5-6500", "LGA1151", None), ("AMD", "Ryzen 5 3400G", "AM4", None), ("", "Ryzen 9 7940HS", None, 8), ("AMD", "Ryzen 7 5800X3D", "AM4", 8), None, None, ("Intel", "i9-14900K", None, None), ("AMD", "Ryzen 5 3960X", None, 10), ("", None, None, 8), ("Intel", "i3-530", "LGA1156", 2)],
    "HDD": [("Seagate", 8000, "SAS", '3.5"', 7200), ("Western Digital", 4000, "SATA", '3.5"', 5400), ("Toshiba", 1500, "SATA", '2.5"', None), ("Hgst", 600, "SAS", '2.5"', 10000), ("Hitachi", 12000, "SATA", '3.5"', 7200), ("Western Digital", 6000, "SATA", '3.5"', None), ("Samsung", 500, "SATA", '3.5"', None), ("", None, "SATA", '3.5"', None), ("Western Digital", 10000, "SATA", '3.5"', None), ("", 900, "SAS", '3.5"', 15000), ("Maxtor", 250, "SATA", '3.5"', None), ("Fujitsu", 4100, "SAS", '3.5"', None)],
    "RAM": [("Corsair", "DDR4", 16, 3200), ("Kingston", "DDR3", 8, 1600), ("G.Skill", "DDR5", 32, None), None, ("Hynix", "DDR4", 4, 2400), None, None, ("Micron", "DDR5", 64, None), None, ("TeamGroup", "DDR5", 16, None), ("PNY", "DDR4", 32, 2666), None],
}
COLUMNS = {"GPU": ["brand", "model", "vram"], "CPU": ["brand", "model", "socket", "cores"], "HDD": ["brand", "capacity_gb", "interface", "form_factor", "rpm"], "RAM": ["brand", "ram_type", "capacity_gb", "speed"]}


@pytest.mark.parametrize("category", sorted(EXPECTED))
def test_titles(spark, category):
    df = spark.createDataFrame([(i, category, t) for i, t in enumerate(TITLES[category])], "id int, category string, title string")
    got = {r["id"]: tuple(r[c] for c in COLUMNS[category]) for r in ingest.enrich(df).collect()}
    assert [got.get(i) for i in range(12)] == EXPECTED[category]


def test_sizes_of_any_length(spark):
    big = ["99999999999 GB", "99999999K", "9999999999999999999999 TB", "99999x99999 GB", "9" * 400 + " GB", "9" * 400 + " x 2GB", "2 x 8GB 99999999999 GB", "99999 core 99999999999 core", ""]
    assert apply(spark, big, titles.hdd_capacity_gb) == [None, None, None, 99999, None, 2, 8, None, None]
    assert apply(spark, big, titles.hdd_rpm)[:2] == [None, None]
    assert apply(spark, big, titles.ram_capacity_gb) == [None, None, None, None, None, None, 16, None, None]
    assert apply(spark, big, titles.cpu_cores)[7] == 99999
    for category in ("GPU", "CPU", "HDD", "RAM"):
        df = spark.createDataFrame([(i, category, t) for i, t in enumerate(big)], "id int, category string, title string")
        assert ingest.enrich(df).count() == (1 if category == "RAM" else 9) - (category == "RAM")


def test_variants_as_listed_or_longest(spark):
    names = ["RTX 4070 Ti SUPER", "RX 7900 XTX", "RTX 3060Ti", "RX 6700 XT", "GTX 1650"]
    assert apply(spark, names, titles.gpu_model) == ["RTX 4070 TI", "RX 7900 XT", "RTX 3060 TI", "RX 6700 XT", "GTX 1650"]
    assert apply(spark, names, lambda c: titles.gpu_model(c, True)) == ["RTX 4070 TI SUPER", "RX 7900 XTX", "RTX 3060 TI", "RX 6700 XT", "GTX 1650"]


CARD = '<a href="https://x/itm/{id}?a"></a><div class="s-card__title"><span>{title}</span></div><span class="s-card__price">{price}</span><span class="su-styled-text secondary large">1,204 bids</span><span class="s-item__reviews-count"><span>3,107 reviews</span></span><span class="s-card__time-end">{end}</span>'


def test_cards_without_a_price_are_left_out_and_counted(spark):
    cards = [CARD.format(id=i, title="T", price=p, end=e) for i, (p, e) in enumerate([("£1.50", "Today 10:00"), ("soon", "Today 10:00"), ("£2", "31/02, 10:00"), ("£3", "")])]
    cards += [CARD.format(id="x", title="T", price="£1", end=""), "<p>nothing</p>"]
    df = spark.createDataFrame([("q", c) for c in cards], "query string, card string")
    got = ingest.normalise(df, F.lit(REF)).orderBy("id").collect()
    assert [(r["id"], r["price"], r["shipping"], r["bid_count"], r["reviews_count"]) for r in got] == [(0, 1.5, 0.0, 1204, 3107), (2, 2.0, 0.0, 1204, 3107), (3, 3.0, 0.0, 1204, 3107)]
    assert tuple(ingest.quarantine(df, F.lit(REF), ["query"]).first()) == ("q", 6, 1, 1, 1, 1)


def test_pages_land_once_and_are_reused(spark, tmp_path):
    schema = "query string, mode string, fetched_at timestamp, html string"
    read = lambda: spark.read.schema("query string, fetched_at timestamp, html string, mode string").parquet(f"{tmp_path}/p")
    first = spark.createDataFrame([("a", "sold", REF, "1"), ("a", "active", REF, "2")], schema)
    ingest.land_pages(first, f"{tmp_path}/p")
    ingest.land_pages(first.unionByName(spark.createDataFrame([("b", "sold", REF, "3")], schema)), f"{tmp_path}/p", read())
    assert read().count() == 3
    asked = spark.createDataFrame([("a", "sold"), ("b", "active")], "query string, mode string")
    assert [tuple(r) for r in ingest.to_fetch(asked, read()).collect()] == [("b", "active")]


def test_page_lists_are_trimmed_each_by_itself(spark):
    rows = [("a", p, s) for p, s in [(100, 0), (105, 0), (102, None), (98, 900), (101, 0), (500, 0)]] + [("b", None, 5)]
    got = ingest.page_price_summary(spark.createDataFrame(rows, "q string, price_pence long, ship_pence long"), ["q"]).orderBy("q").collect()
    assert [tuple(r) for r in got] == [("a", [98, 100, 101, 102, 105], [0, 0, 0, 0, 0]), ("b", [], [5])]


def test_orders(spark):
    """Queries whose feature is an order give it."""
    from bidlens.plans import queries as plans

    sf = "/root/testdata/sf0.001"
    for name, key in [("deals_hdd", lambda r: (-r["potential_gain"], r["id"])), ("outcomes_pending", lambda r: (r["end_time"], r["id"])), ("suspect_order", lambda r: (r["category"], r["price_pence"], r["id"])), ("sort_any", lambda r: (-r["discount_pct"], r["id"]))]:
        got = [key(r) for r in plans.QUERIES[name](spark, sf).collect()]
        assert got and got == sorted(got), name


def test_search_url_rejects_unknown_choices(spark):
    f = lambda c: fields.search_url(F.lit("rtx 3060/ti"), c, F.lit("used"), F.lit("all"), F.lit("sold"))
    assert apply(spark, ["uk"], f) == ["https://www.example.co.uk/sch/i.html?_from=R40&_nkw=rtx+3060/ti&LH_Complete=1&LH_Sold=1&LH_ItemCondition=3000&LH_All=1"]
    with pytest.raises(Exception, match="unknown country"):
        apply(spark, ["xx"], f)


def test_trim_one_sigma(spark):
    rows = [("a", x) for x in (100, 105, 102, 98, 101, 500)] + [("b", 42)] + [("c", 7)] * 5 + [("d", None)]
    got = ingest.trim_one_sigma(spark.createDataFrame(rows, "q string, price_pence long"), ["q"]).collect()
    assert sorted((r["q"], r["price_pence"]) for r in got) == sorted(x for x in rows if x[1] not in (500, None))


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id long, t string, seq int")
    once = ingest.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, ingest.upsert(once, new).collect())) == [(1, "a"), (2, "y"), (3, "z")]


def test_zero_average_gives_null(spark):
    df = spark.createDataFrame([(5, 0), (5, 100), (-5, 100), (1, 3)], "p long, w long")
    assert [r[0] for r in df.select(market.tenths("p", "w")).collect()] == [None, 5.0, -5.0, 33.3]


def test_refresh_tiers(spark):
    now = datetime(2024, 6, 1, 12)
    minutes = [0.0, 5.0, 5.1, 15.0, 60.0, 60.1]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(minutes)], "id int, m double").withColumn("end_time", F.timestamp_seconds(F.unix_seconds(F.lit(now)) + (F.col("m") * 60).cast("long")))
    assert {r["id"]: r["interval"] for r in outcomes.refresh_tier(df, F.lit(now)).collect()} == {1: 1, 2: 5, 3: 5, 4: 15}


def test_sold_price_is_truncated(spark):
    assert spark.range(1).select((F.lit(19.99) * 100).cast("long")).first()[0] == 1998
