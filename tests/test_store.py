"""The listing table and its model, isolated runs, quarantine, trend and the database source."""

from __future__ import annotations

import datetime
import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlens.operators import ingest, market, model, runs, table
from bidlens.sources import jdbc
from bidlens.sources.adapters import TITLES

ROW = "id long, category string, title string, price_pence long, bids int, end_time timestamp, sold_date date, url string, seq int"
REF = datetime.datetime(2025, 1, 15, 14, 30)


def listing(i, category="GPU", title="MSI RTX 3060 12GB", price=1000, sold=None, seq=0):
    return (i, category, title, price, 1, REF, sold, f"u{i}", seq)


def modified(base):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{base}/rows/**/*.parquet", recursive=True)}


def test_the_model_follows_any_batches(spark, tmp_path):
    """Insertions, sales, sales taken back, changes of price, title, product and category, repeats: as from scratch after each batch."""
    rng = np.random.default_rng(1)
    kept, now = model.Store(spark, f"{tmp_path}/s"), {}
    names = [(c, t) for c in ("GPU", "HDD", "RAM", "CPU") for t in TITLES[c][:4]]
    for number in range(5):
        rows = []
        for seq in range(60):
            c, t = names[int(rng.integers(0, len(names)))]
            sold = datetime.date(2025, 1, int(rng.integers(1, 29))) if rng.random() < 0.6 else None
            rows.append(listing(int(rng.integers(0, 50)), c, t, None if rng.random() < 0.1 else int(rng.integers(1, 30)) * 100, sold, seq))
        kept.merge(spark.createDataFrame(rows, ROW), number)
        now |= {r[0]: r for r in rows}
        if number == 3:
            kept.compact(3)
        whole = market.market_listing(ingest.enrich(spark.createDataFrame(list(now.values()), ROW)))
        for count, priced in ((1, False), (2, True)):
            want = sorted(map(tuple, market.clean_stats(whole, count, priced).collect()), key=str)
            assert sorted(map(tuple, kept.clean_stats(count, priced).collect()), key=str) == want and want
        assert sorted(tuple(r)[:8] for r in kept.listing().collect()) == sorted(r[:8] for r in now.values())
    assert kept.listing().where("is_sold <> (sold_date is not null)").isEmpty()


def test_a_batch_counts_once(spark, tmp_path):
    kept = model.Store(spark, f"{tmp_path}/s")
    first = spark.createDataFrame([listing(i, sold=REF.date()) for i in range(6)], ROW)
    again = spark.createDataFrame([listing(0, price=2000, sold=REF.date()), listing(1, sold=None)], ROW)
    kept.merge(first, 0)
    for _ in range(2):  # as after a failure before the batch was noted
        kept.merge(again, 1)
    assert sorted((r["price_pence"], r["c"]) for r in kept.histogram().collect()) == [(1000, 4), (2000, 1)]
    assert model.Store(spark, f"{tmp_path}/none").histogram().isEmpty() and model.Store(spark, f"{tmp_path}/none").listing().isEmpty()


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    kept = model.Store(spark, f"{tmp_path}/s")
    kept.merge(spark.createDataFrame([listing(1), listing(2, sold=REF.date()), listing(3, "CPU"), listing(4, "HDD", sold=REF.date())], ROW), 0)
    before = modified(f"{tmp_path}/s/listing")
    # the one active GPU is sold: its old partition goes, HDD and CPU stay as they are
    assert kept.merge(spark.createDataFrame([listing(1, sold=REF.date())], ROW), 1) == {("GPU", False), ("GPU", True)}
    after = modified(f"{tmp_path}/s/listing")
    same = {f for f in after if before.get(f) == after[f]}
    assert {f.split("/rows/")[1].rsplit("/", 1)[0] for f in same} == {"category=CPU/is_sold=false", "category=HDD/is_sold=true"}
    assert not any("GPU/is_sold=false" in f for f in after)
    assert sorted((r["id"], r["is_sold"]) for r in kept.listing().collect()) == [(1, True), (2, True), (3, False), (4, True)]
    plan = kept.listing().where("category = 'CPU' and not is_sold")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan and "category=GPU" not in plan
    # a listing that changes its category leaves the old one's partition
    kept.merge(spark.createDataFrame([listing(3, "RAM", "Micron 64GB DDR5")], ROW), 2)
    assert sorted((r["id"], r["category"]) for r in kept.listing().collect()) == [(1, "GPU"), (2, "GPU"), (3, "RAM"), (4, "HDD")]


def test_partitions_of_odd_names(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "id long, category string, v int, seq int")
    base = f"{tmp_path}/t"
    table.merge(base, rows((1, "a/b=c %", 1, 0), (2, None, 1, 0), (3, "é x", 1, 0)), ("category",))
    table.merge(base, rows((1, "z", 2, 0), (2, "z", 2, 0), (3, "é x", 2, 0)), ("category",))
    got = table.read_table(spark, base, spark.createDataFrame([], "id long, category string, v int").schema)
    assert sorted(map(tuple, got.collect())) == [(1, "z", 2), (2, "z", 2), (3, "é x", 2)]


def test_a_failing_category_stops_no_other(spark, tmp_path):
    tries = []

    def job(category):
        tries.append(category)
        if category == "CPU" or (category == "HDD" and tries.count("HDD") == 1):
            return spark.range(3).select(F.raise_error(F.lit(f"pages of {category}")).cast("string").alias("k"))
        return spark.range(5).select(F.col("id").cast("string").alias("k"))

    base = f"{tmp_path}/r"
    log = runs.run_all(spark, base, "a", ("GPU", "CPU", "HDD", "RAM"), job)
    rows = sorted((r["category"], r["attempt"], r["ok"]) for r in log.collect())
    assert rows == [("CPU", 1, False), ("CPU", 2, False), ("GPU", 1, True), ("HDD", 1, False), ("HDD", 2, True), ("RAM", 1, True)]
    assert all("pages of CPU" in r["error"] for r in log.where("category = 'CPU'").collect())
    assert sorted((r["category"], r["count"]) for r in runs.results(spark, base, "a", "k string").groupBy("category").count().collect()) == [("GPU", 5), ("HDD", 5), ("RAM", 5)]
    first = runs.marker(spark, base).first()
    assert first["id"] == 1 and first["last_scrape_at"] >= log.agg(F.max("ended")).first()[0]
    # the same run again: only what failed is tried; another run goes its own way and moves the marker
    tries.clear()
    runs.run_all(spark, base, "a", ("GPU", "CPU", "HDD", "RAM"), job)
    assert tries == ["CPU", "CPU"]
    runs.run_all(spark, base, "b", ("GPU",), job)
    assert runs.marker(spark, base).count() == 1 and runs.marker(spark, base).first()["last_scrape_at"] > first["last_scrape_at"]
    assert runs.marker(spark, f"{tmp_path}/none").isEmpty()


def test_a_run_that_dies_leaves_the_old_marker(spark, tmp_path):
    base = f"{tmp_path}/r"
    runs.run_all(spark, base, "a", ("GPU",), lambda c: spark.range(1))
    before = runs.marker(spark, base).collect()

    def dies(category):
        if category == "CPU":
            raise KeyboardInterrupt
        return spark.range(1)

    with pytest.raises(KeyboardInterrupt):
        runs.run_all(spark, base, "b", ("GPU", "CPU"), dies)
    assert runs.marker(spark, base).collect() == before


def test_cards_are_kept_or_quarantined_in_one_pass(spark, tmp_path):
    card = '<a href="/itm/{id}"></a><div class="s-card__title"><span>{title}</span></div><span class="s-card__price">{price}</span><span class="s-card__time-end">{end}</span>'
    cards = [card.format(id=1, title="A", price="£1", end=""), card.format(id=2, title="B", price="soon", end=""), card.format(id="x", title="C", price="£3", end=""), "<p>no title</p>", card.format(id=5, title="E", price="£5", end="junk"), None]
    df = spark.createDataFrame([("q", c) for c in cards], "query string, card string")
    seen = ingest.land_cards(df, f"{tmp_path}/c", F.lit(REF))
    assert seen == {"cards": 6, "no_title": 2, "no_price": 1, "no_id": 1, "bad_end": 1}
    assert sorted(r["id"] for r in ingest.kept_cards(spark, f"{tmp_path}/c").collect()) == [1, 5]
    held = ingest.quarantined_cards(spark, f"{tmp_path}/c")
    assert sorted((r["lack"], r["card"]) for r in held.where("card is not null").collect()) == sorted([("price", cards[1]), ("id", cards[2]), ("title", cards[3])])
    assert ingest.normalise(held.where("lack = 'price'").withColumn("card", F.replace("card", F.lit("soon"), F.lit("£2"))), F.lit(REF)).first()["id"] == 2


def test_trend(spark):
    def sales(model_, points):
        return [(1, "GPU", f"MSI {model_} 12GB", p, 1, REF, REF.date() - datetime.timedelta(days=d), "u", 0) for d, p in points]

    rows = sales("RTX 3060", [(0, 1000), (10, 900), (20, 800), (29, 710), (29, 710)]) + sales("RTX 3070", [(1, 500)] * 6) + sales("RTX 3080", [(d, 1000 + d) for d in range(0, 30, 5)])
    rows += sales("RTX 3090", [(d, 5000 + 100 * d) for d in range(0, 30, 5)]) + sales("GTX 1060", [(1, 5), (2, 6)]) + sales("GTX 1070", [(d, 7) for d in range(30, 40)]) + [listing(9, price=None, sold=REF.date())]
    got = {r["k1"]: (r["sales"], None if r["slope"] is None else round(r["slope"], 6), r["direction"]) for r in market.trend(market.market_listing(ingest.enrich(spark.createDataFrame(rows, ROW))), F.lit(REF)).collect()}
    assert got == {"RTX 3060": (5, 10.0, "rising"), "RTX 3070": (6, None, "flat"), "RTX 3080": (6, -1.0, "falling"), "RTX 3090": (6, -100.0, "falling")}


def test_database_scan_in_parts(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{tmp_path}/derby.log")
    url, rows = f"jdbc:derby:{tmp_path}/db;create=true", spark.createDataFrame([(3 * i, f"t{i}", i * 10 if i % 4 else None) for i in range(100)], "id long, title string, price long")
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    jdbc.save(rows, url, "listing", 2, **driver)
    assert jdbc.bounds(spark, url, "listing", **driver) == (0, 297)
    got = jdbc.scan(spark, url, "listing", 4, **driver)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert sorted(r["count"] for r in sizes) == [25, 25, 25, 25]
    some = got.where("price > 500").select("id")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(PRICE), *GreaterThan(PRICE,500)]" in plan.replace("price", "PRICE") and "title" not in plan.lower()
    assert some.count() == rows.where("price > 500").count()
    jdbc.save(rows.limit(0), url, "empty", 1, **driver)
    assert jdbc.scan(spark, url, "empty", 4, **driver).isEmpty()


def test_prices_on_the_bound_of_a_deviation_are_kept(spark):
    """Of three prices at even steps the outer ones lie just on the bounds: the sample deviation is the step."""
    from bidlens.operators import ingest

    rows = [(p, p * 7 + 1 + k * (p % 97 + 1)) for p in range(500) for k in range(3)]
    df = spark.createDataFrame(rows, "page int, price_pence long").repartition(6)
    assert ingest.trim_one_sigma(df, ["page"]).count() == len(rows)
    far = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, None), (2, 5), (3, 7), (3, 7), (4, 2**62), (4, 2**62 - 2)], "page int, price_pence long")
    assert sorted(map(tuple, ingest.trim_one_sigma(far, ["page"]).collect())) == [(1, 1), (1, 2), (2, 5), (3, 7), (3, 7), (4, 2**62 - 2), (4, 2**62)]
    got = ingest.page_price_summary(df.withColumn("ship_pence", F.col("price_pence")), ["page"]).select(F.size("price_list"), F.size("shipping_list")).distinct().collect()
    assert [tuple(r) for r in got] == [(3, 3)]
    assert ingest.trim_one_sigma(df.withColumn("price_pence", F.lit(1.5)), ["page"]).count() == len(rows)
