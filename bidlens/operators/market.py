"""Market model, deals and price guides. Money is integer pence until the last step.

An average is floor((2 * sum + n) / (2 * n)), half up; percentages are integer tenths, half away from zero.
The statistics are keyed by product, not by listing: they stay small beside the listings, and Spark
broadcasts them when their measured size allows and shuffles otherwise. No hint forces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["category", "k1", "k2"]


def market_listing(enriched: DataFrame) -> DataFrame:
    """One relation for all categories: GPU and CPU by (model, null), HDD by (capacity, interface), RAM by
    (type, capacity)."""
    c = F.col("category")
    k1 = F.when(c == "HDD", F.col("capacity_gb").cast("string")).when(c == "RAM", F.col("ram_type")).otherwise(F.col("model"))
    k2 = F.when(c == "HDD", F.col("interface")).when(c == "RAM", F.col("capacity_gb").cast("string"))
    return enriched.withColumn("k1", k1).withColumn("k2", k2)


def half_up(total: Column, n: Column) -> Column:
    return F.expr(f"(2 * {total} + {n}) div (2 * {n})") if isinstance(total, str) else F.floor((2 * total + n) / (2 * n)).cast("long")


def tenths(part: str, whole: str) -> Column:
    """part / whole in percent with one decimal; null for a whole of 0."""
    return F.expr(f"case when {whole} <> 0 then sign({part}) * ((2000 * abs({part}) + abs({whole})) div (2 * abs({whole}))) * sign({whole}) / 10.0D end").cast("double")


def pounds(pence: str) -> Column:
    return F.expr(f"cast({pence} as double) / 100.0D")


def sold(listings: DataFrame) -> DataFrame:
    return listings.where("sold_date is not null and k1 is not null")


def raw_stats(listings: DataFrame, min_count: int = 5, priced_only: bool = False) -> DataFrame:
    """Mean and population deviation of sold prices by product. Unsold endings (no price) count towards
    min_count unless priced_only."""
    s = sold(listings)
    s = s.where("price_pence is not null") if priced_only else s
    return s.groupBy(*KEYS).agg(F.count("*").alias("sold_count"), F.avg("price_pence").alias("mean_pence"), F.stddev_pop("price_pence").alias("sd_pence")).where(F.col("sold_count") >= min_count)


def with_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Join on category, k1 and, null-safe, k2."""
    s = stats.select(*[F.col(k).alias(f"_{k}") for k in KEYS], *[c for c in stats.columns if c not in KEYS])
    on = (F.col("category") == F.col("_category")) & (F.col("k1") == F.col("_k1")) & F.col("k2").eqNullSafe(F.col("_k2"))
    return rows.join(s, on).drop(*[f"_{k}" for k in KEYS])


def in_band(rows_with_stats: DataFrame) -> DataFrame:
    """Prices within two deviations of the mean, bounds included."""
    return rows_with_stats.where(F.col("price_pence").between(F.col("mean_pence") - 2 * F.col("sd_pence"), F.col("mean_pence") + 2 * F.col("sd_pence")))


def clean_stats(listings: DataFrame, min_count: int = 5, priced_only: bool = False) -> DataFrame:
    """Counts, averages and ranges of the sold prices within two deviations of their mean. The listings are read
    once, to a histogram of prices by product: exact sums over it give the mean and the deviation, and its
    rows within those the rest."""
    return stats_of(sold(listings).groupBy(*KEYS, "price_pence").agg(F.count("*").alias("c")), min_count, priced_only)


def stats_of(hist: DataFrame, min_count: int = 5, priced_only: bool = False) -> DataFrame:
    """As clean_stats, from the histogram (KEYS, price_pence, c) of sold prices."""
    hist = hist.where("price_pence is not null") if priced_only else hist
    exact = "decimal(38,0)"
    raw = hist.groupBy(*KEYS).agg(
        F.sum("c").alias("sold_count"),
        F.sum(F.expr(f"cast(if(price_pence is null, 0, c) as {exact})")).alias("n"),
        F.sum(F.expr(f"cast(price_pence * c as {exact})")).alias("t"),
        F.sum(F.expr(f"cast(cast(price_pence as decimal(12,0)) * cast(price_pence as decimal(12,0)) * cast(c as decimal(12,0)) as {exact})")).alias("q"),
    ).where(F.col("sold_count") >= min_count)
    spread = F.coalesce(F.try_subtract(F.try_multiply("n", "q"), F.try_multiply("t", "t")).cast("double"), F.col("n").cast("double") * F.col("q").cast("double") - F.col("t").cast("double") * F.col("t").cast("double"))
    mean = F.col("t").cast("double") / F.nullif(F.col("n"), F.lit(0)).cast("double")
    raw = raw.select(*KEYS, "sold_count", mean.alias("mean_pence"), (F.sqrt(F.greatest(spread, F.lit(0.0))) / F.nullif(F.col("n"), F.lit(0)).cast("double")).alias("sd_pence"))
    out = in_band(with_stats(hist, raw)).groupBy(*KEYS).agg(F.first("sold_count").alias("sold_count"), F.sum("c").alias("n"), F.sum(F.col("price_pence") * F.col("c")).alias("total"), F.min("price_pence").alias("min_pence"), F.max("price_pence").alias("max_pence"))
    return out.select(*KEYS, "sold_count", half_up("total", "n").alias("avg_pence"), "min_pence", "max_pence")


def trend(sales: DataFrame, as_of: Column, days: int = 30, min_count: int = 5) -> DataFrame:
    """Where each product's sold prices go over the last `days` days: the slope of price against day (pence a day, least squares), sales,
    and rising, falling or flat (a change of under a hundredth of the mean over the span). Sales are first counted by day and
    price, so repeats cross the shuffle once; exact sums of those rows give the slope. Sold on one day only: no slope."""
    day = F.datediff(F.col("sold_date"), as_of.cast("date"))
    s = sold(sales).where(F.col("price_pence").isNotNull()).withColumn("x", day).where((F.col("x") > -days) & (F.col("x") <= 0))
    hist = s.groupBy(*KEYS, "x", "price_pence").agg(F.count("*").alias("c"))
    n, y, x = F.col("n"), F.col("y"), F.col("x")
    sums = hist.groupBy(*KEYS).agg(
        F.sum("c").alias("n"),
        F.sum(F.expr("cast(x * c as decimal(38,0))")).alias("x"),
        F.sum(F.expr("cast(price_pence * c as decimal(38,0))")).alias("y"),
        F.sum(F.expr("cast(x * x * c as decimal(38,0))")).alias("xx"),
        F.sum(F.expr("cast(x * price_pence * c as decimal(38,0))")).alias("xy"),
    ).where(F.col("n") >= min_count)
    slope = (n * F.col("xy") - x * y).cast("double") / F.nullif((n * F.col("xx") - x * x).cast("double"), F.lit(0.0))
    mean = y.cast("double") / n.cast("double")
    out = sums.select(*KEYS, F.col("n").alias("sales"), mean.alias("mean_pence"), slope.alias("slope"))
    change = F.col("slope") * days / F.col("mean_pence")
    return out.withColumn("direction", F.when(F.col("slope").isNull() | (F.abs(change) < 0.01), "flat").when(change > 0, "rising").otherwise("falling"))


def deal_score(found: DataFrame, as_of: Column) -> DataFrame:
    """score: the discount in percent, divided by the hours left and by the bids (none counts as one)."""
    hours = (F.unix_seconds("end_time") - F.unix_seconds(as_of)) / 3600.0
    return found.withColumn("score", F.col("discount_pct") / hours / F.greatest(F.col("bids"), F.lit(1)))


def few_bids(found: DataFrame, most: int = 4) -> DataFrame:
    """Deals of at most so many bids: with more the price has likely been bid up."""
    return found.where(F.coalesce(F.col("bids"), F.lit(0)) <= most)


def active_in_window(listings: DataFrame, as_of: Column, hours: int = 2, from_hours: int = 0) -> DataFrame:
    """Unsold listings that end within (from_hours, hours), both strict; hours is held to 1..24."""
    hours = max(1, min(24, hours))
    now = F.unix_seconds(as_of)
    return listings.where(F.col("sold_date").isNull() & (F.col("end_time") > F.timestamp_seconds(now + from_hours * 3600)) & (F.col("end_time") < F.timestamp_seconds(now + hours * 3600)))


def below_threshold(rows: DataFrame, min_discount: int = 20) -> DataFrame:
    return rows.where(F.col("price_pence") * 100 < F.col("avg_pence") * (100 - max(0, min_discount)))


def deal_label() -> Column:
    """HDD `8TB SAS` from 1000 GB on (floor), RAM `16GB DDR4`, else the model."""
    return F.expr("""case when category = 'HDD' then case when capacity_gb >= 1000 then concat(capacity_gb div 1000, 'TB ', coalesce(interface, 'SATA'))
      when capacity_gb is not null then concat(capacity_gb, 'GB ', coalesce(interface, 'SATA')) else coalesce(interface, 'SATA') end
      when category = 'RAM' then concat(capacity_gb, 'GB ', ram_type) else model end""")


def deals(listings: DataFrame, as_of: Column, hours: int = 2, min_discount: int = 20) -> DataFrame:
    """Active listings that end soon below their product's cleaned price. Reading has no side effect."""
    found = below_threshold(with_stats(active_in_window(listings, as_of, hours), clean_stats(listings)), min_discount)
    return found.withColumn("gain_pence", F.col("avg_pence") - F.col("price_pence")).withColumn("discount_pct", tenths("gain_pence", "avg_pence")).withColumn("label", deal_label())


def deal_counts(listings: DataFrame, as_of: Column, categories, hours: int = 2, min_discount: int = 20) -> DataFrame:
    """Deals by category against the untrimmed, unrounded mean; 0 where there are none."""
    s = with_stats(active_in_window(listings, as_of, hours), raw_stats(listings))
    n = s.where(F.col("price_pence") * 100.0 < F.col("mean_pence") * (100 - max(0, min_discount))).groupBy("category").agg(F.count("*").alias("deals"))
    every = listings.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return every.join(n, "category", "left").select("category", F.coalesce("deals", F.lit(0)).cast("long").alias("deals"))


def price_guide(listings: DataFrame) -> DataFrame:
    """Products with three priced sales or more: sales before trimming, prices after."""
    return clean_stats(listings, 3, True)


def listing_totals(listings: DataFrame, run_log: DataFrame) -> DataFrame:
    n = listings.agg(F.count_if(F.col("sold_date").isNull()).alias("active"), F.count_if(F.col("sold_date").isNotNull()).alias("sold"))
    return n.join(run_log.agg(F.max("finished_at").alias("last_run")), how="cross")  # one row each


def threshold_sweep(found: DataFrame, params: DataFrame) -> DataFrame:
    """Deal counts for each raw parameter row (window, discount): bad numbers take the defaults 2 and 20,
    windows are held to 1..24 hours and discounts to 0 and up. found has ends_in seconds, price and
    average. Candidates are first counted by (hour they fit, per-mille of the average), so the small
    histogram, not the rows, meets the parameters."""
    p = params.select("param_id", F.greatest(F.lit(1), F.least(F.lit(24), F.coalesce(F.col("window").try_cast("int"), F.lit(2)))).alias("hours"), F.greatest(F.lit(0), F.coalesce(F.col("discount").try_cast("int"), F.lit(20))).alias("discount"))
    # smallest whole hour count under which the row is in the window, and largest discount that it beats
    rows = found.where("ends_in > 0 and ends_in < 86400").select((F.expr("ends_in div 3600") + 1).cast("int").alias("h"), F.expr("case when avg_pence > 0 then floor((avg_pence * 100 - price_pence * 100 - 1) / avg_pence) else -1 end").cast("int").alias("d"))
    hist = rows.where("d >= 0").groupBy("h", "d").agg(F.count("*").alias("n"))
    return p.join(hist, (F.col("h") <= F.col("hours")) & (F.col("d") >= F.col("discount")), "left").groupBy("param_id", "hours", "discount").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("deals"))


def sort_any(rows: DataFrame, column: str, ascending: bool, allowed) -> DataFrame:
    if column not in allowed:
        raise ValueError(f"cannot sort by {column}")
    return rows.orderBy(F.col(column).asc() if ascending else F.col(column).desc(), "id" if "id" in rows.columns else column)
