"""Listings, pages and a ledger derived from the driver tables by fixed formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-06-01 12:00:00"
CATEGORIES = ("GPU", "CPU", "HDD", "RAM")
# The titles that stand for listings, twelve a category.
TITLES = {
    "GPU": ("ASUS GeForce RTX 3060 12GB OC", "MSI RTX3060Ti Gaming X 8GB", "Zotac RTX 4070 Ti SUPER 16GB", "Sapphire Radeon RX 7900 XTX 24GB", "XFX RX580 8 GB EXTREME", "INNO3D GTX 1080 Ti 11GB", "Nvidia TITAN X Pascal 12GB", "Gigabyte AORUS RTX 2080 SUPER 8GB", "EXTREME edition GTX 1660 6GB", "Palit gtx 970 4gb", "RX 6700 XT 12GB Pulse", "PNY RTX 4090"),
    "CPU": ("Intel Core i5-6600K LGA 1151 Quad Core", "Intel i5 9400F 6 Core", "I5 CPU 6500 LGA1151", "AMD Ryzen 5 3400G AM4", "Ryzen R9 7940HS octa core", "AMD Ryzen 7 5800X3D 8 core AM 4", "HP Mini PC Intel i5-8500T", "Intel i7-4790K 16GB DDR3 256GB SSD", "Intel Core i9 14900K", "AMD Ryzen Threadripper PRO 5 3960X dodeca", "Xeon E5-2670 8 Core", "Intel i3 530 dual core LGA 1156"),
    "HDD": ('Seagate Exos 8TB SAS 7.2K 3.5"', "WD Red 4TB SATA 5400rpm", 'Toshiba 1.5 TB 2.5"', "HGST 600GB SAS 10K rpm 2.5", "Hitachi 12TB SATA 7200 RPM", "Western Digital Gold 6TB", "Samsung Spinpoint 500 GB", "Generic hard drive", "New WD Purple 10TB", "Dell 900GB SAS 15K", "Maxtor 250GB", "Fujitsu 4.1TB SAS"),
    "RAM": ("Corsair Vengeance 16GB (2x8GB) DDR4 3200MHz", "Kingston HyperX 8GB DDR3 1600 MHz", "G.Skill 32GB 2 x 16GB DDR5-6000", "Crucial 8GB DDR3L", "SK Hynix 4GB DDR4 2400MHz", "Gaming PC 16GB DDR4", "Samsung 512GB DDR4", "Micron 64GB 32GB DDR5", "Generic DDR4", "ddr5 16gb teamgroup", "4×8GB DDR4 PNY 2666MHz", "Lexar 1GB DDR3"),
}
# what a few titles end with: sizes that no column could hold
HUGE = " 99999999999 x 99999999999 GB 99999999999K"

#: How many cards one task makes and reads, about: some 60 MB of markup.
CARDS_A_TASK = 1 << 16


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sighting of a listing (several for one id) with `seq`, the order in which they were written."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", F.col("l_shipdate").cast("timestamp").alias("ship"))
    li = li.withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber")).withColumn("c", (F.col("l_partkey") % 4).cast("int"))
    sold = F.col("l_returnflag") != "N"
    n = (F.floor(F.col("l_partkey") / 4) % 12).cast("int")
    names = F.array(*[F.array(*map(F.lit, TITLES[c])) for c in CATEGORIES])
    title = F.when((F.col("c") == 0) & (F.col("id") % 499 == 0), F.concat(F.lit("Asus GTX 9"), (50 + F.col("id") % 40).cast("string"))).otherwise(F.get(F.get(names, F.col("c")), n))
    title = F.when(F.col("id") % 251 == 5, F.concat(title, F.lit(HUGE))).otherwise(title)
    price = F.round(F.col("l_extendedprice") * 100).cast("long") * F.when(F.col("id") % 41 == 0, 8).otherwise(1)
    ahead = (F.col("id") * 7 + F.col("l_suppkey") * 13) % 2880 - 720
    category = F.get(F.array(*map(F.lit, CATEGORIES)), F.col("c"))
    return li.select(
        "id",
        category.alias("category"),
        title.alias("title"),
        F.when(~(sold & (F.col("id") % 17 == 0)), price).alias("price_pence"),
        F.col("l_quantity").cast("int").alias("bids"),
        F.when(sold, F.timestamp_seconds(F.unix_seconds("ship") + 43200)).otherwise(F.timestamp_seconds(F.unix_seconds(as_of()) + ahead * 60)).alias("end_time"),
        F.when(sold, F.col("ship").cast("date")).alias("sold_date"),
        F.concat(F.lit("https://www.example.com/itm/"), F.col("id").cast("string")).alias("url"),
        F.concat_ws("-", category, (F.col("l_suppkey") % 8).cast("string"), F.floor(F.col("id") / 8192).cast("string")).alias("query"),
        F.when(sold, "sold").otherwise("active").alias("mode"),
        F.struct("ship", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag").alias("seq"),
    )


def cards(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """A result card's markup for each sighting. By id, some have comments, references, white space, elements in titles, attributes in
    other quotes, order and case, a class that only begins like the bids', bids before postage, or a tag left open. Dealt by the columns `by`, if named."""
    s = snapshots(spark, sf_dir)
    # narrow rows are dealt, not the markup made of them: their number sets that of the tasks, as their bytes tell nothing of it
    s = s.repartition(max(spark.sparkContext.defaultParallelism, -(-s.count() // CARDS_A_TASK)), *by) if by else s
    clock = F.format_string("%02d:%02d", F.col("id") % 24, F.col("id") % 60)
    days = F.array(*[F.lit(d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")])
    end = (
        F.when(F.col("id") % 5 == 0, F.concat(F.lit("Today "), clock))
        .when(F.col("id") % 5 == 1, F.concat(F.get(days, (F.col("id") % 7).cast("int")), F.lit(", "), clock))
        .when(F.col("id") % 5 == 2, F.concat(F.format_string("(%02d/%02d, ", F.col("id") % 31 + 1, F.col("id") % 12 + 1), clock, F.lit(")")))
        .when(F.col("id") % 5 == 3, "soon")
        .otherwise("")
    )
    pounds = F.format_string("%d.%02d", F.floor(F.col("price_pence") / 100), F.col("price_pence") % 100)

    def on(m: int, r: int, text, other=""):
        """text where the id leaves r by m, else the other."""
        return F.when(F.col("id") % m == r, text).otherwise(other)

    link = F.concat(on(97, 0, "https://www.example.com/shop", F.col("url")), on(3, 1, "?a=1&amp;b=2"))
    few = (F.col("id") % 9).cast("string")
    postage = on(4, 0, '<span class="su-styled-text secondary large"><span>Free postage</span></span>', on(4, 1, F.concat(F.lit('<span class="su-styled-text secondary large"><span>+£'), on(8, 1, F.concat(F.lit("<b>"), few, F.lit("</b>")), few), F.lit(".50 postage</span></span>"))))
    bidding = F.concat(on(9, 5, '<span class="su-styled-text secondary">99 bids watching</span>'), F.lit('<span class="su-styled-text secondary large">'), F.format_string("1,%03d bids", F.col("bids")), F.lit("</span>"))
    card = F.concat(
        F.lit('<div class="su-card-container su-card-container--horizontal">'),
        on(7, 3, '<!-- <span class="s-card__price">£1.00</span> -->'),
        on(9, 4, F.concat(F.lit("<A data-n='1 > 0' HREF='"), link, F.lit("'>")), F.concat(F.lit('<a href="'), link, F.lit('">'))),
        F.lit("</a>"),
        on(10, 6, "<div id=t class='wide s-card__title'>", '<div class="s-card__title">'),
        on(3, 0, "<span>New listing</span>"),
        F.lit("<span>"),
        on(10, 1, "\n  "),
        F.col("title"),
        on(13, 0, " &amp; box"),
        on(11, 2, "<i></i>"),
        on(10, 1, " &nbsp; "),
        F.lit("</span></div>"),
        on(6, 5, "<br><span data-x=\"a > b\" class='s-card__price'>£", '<span class="s-card__price">£'),
        F.when(F.col("price_pence").isNotNull(), pounds).otherwise(""),
        F.lit("</span>"),
        on(5, 2, F.concat(bidding, postage), F.concat(postage, bidding)),
        on(6, 0, F.concat(F.lit('<span class="s-item__reviews-count"><span>'), (F.col("id") % 1000).cast("string"), F.lit(" reviews</span></span>"))),
        on(8, 3, '<SPAN CLASS="s-card__time-left">', '<span class="s-card__time-left">'),
        on(2, 0, F.concat((F.col("id") % 24).cast("string"), F.lit("h left"))),
        on(8, 3, "</SPAN>", "</span>"),
        F.lit('<span class="s-card__time-end">'),
        end,
        F.lit("</span>"),
        F.when(F.col("sold_date").isNotNull(), F.concat(F.lit('<span class="su-styled-text positive default">Sold '), F.date_format("sold_date", "d MMM yyyy"), F.lit("</span>"))).otherwise(""),
        on(19, 7, "<p>unclosed"),
        F.lit("</div>"),
    )
    return s.select("query", "mode", "category", "id", "seq", card.alias("card"))


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, mode, fetched_at, html: the cards of a page after one placeholder card. Two versions of a
    page where the query's hash is even, the older one cut short. A page holds at most some thousand cards."""
    head = '<html><body><div class="su-card-container su-card-container--horizontal">Shop on site</div>'
    p = cards(spark, sf_dir, "query", "mode").groupBy("query", "mode").agg(F.array_sort(F.collect_list("card")).alias("cards"))
    html = F.concat(F.lit(head), F.concat_ws("", "cards"), F.lit("</body></html>"))
    p = p.select("query", "mode", html.alias("whole"))
    now = F.struct(as_of().alias("fetched_at"), F.col("whole").alias("html"))
    old = F.struct(F.timestamp_seconds(F.unix_seconds(as_of()) - 3600).alias("fetched_at"), F.substring("whole", 1, 400).alias("html"))
    return p.select("query", "mode", F.inline(F.when(F.length("query") % 2 == 0, F.array(now, old)).otherwise(F.array(now))))


def ledger(listings: DataFrame) -> DataFrame:
    """Deals surfaced earlier, for latest listings with id % 7 = 0."""
    price, sold = F.coalesce("price_pence", F.lit(100000).cast("long")), F.col("sold_date").isNotNull()
    end = F.when(sold, F.col("end_time")).otherwise(F.timestamp_seconds(F.unix_seconds(as_of()) - F.col("id") % 240 * 3600))
    return listings.where("id % 7 = 0").select(
        "id",
        "category",
        F.floor(price * 3 / 4).cast("long").alias("surfaced_pence"),
        F.floor(price * 5 / 4).cast("long").alias("avg_market_pence"),
        end.alias("end_time"),
        F.timestamp_seconds(F.unix_seconds(end) - 5400).alias("surfaced_at"),
        F.lit(False).alias("gave_up"),
        (F.col("price_pence").isNull() & sold).alias("ended_unsold"),
        F.when(sold & (F.col("id") % 2 == 0), F.col("price_pence")).alias("final_pence"),
    )
