"""The ledger of surfaced deals: sightings, refresh plans, resolution, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import latest
from .market import tenths

#: Minutes left and the refresh interval that they call for.
TIERS = ((5, 1), (15, 5), (60, 15))
WEEK, DELAY = 7 * 86400, 6 * 3600


def record_first_sighting(ledger: DataFrame, surfaced: DataFrame) -> DataFrame:
    """ledger and the surfaced rows whose id it lacks."""
    return ledger.unionByName(surfaced.dropDuplicates(["id"]).join(ledger.select("id"), "id", "left_anti").select(*ledger.columns))


def upgrade(ledger: DataFrame, model: DataFrame, defaults: dict) -> DataFrame:
    """ledger with the columns of model that it lacks, at their defaults."""
    out = model.limit(0).unionByName(ledger, allowMissingColumns=True)
    return out.select(*[F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in out.columns])


def with_listing(ledger: DataFrame, listings: DataFrame) -> DataFrame:
    return ledger.join(listings.select("id", "title", "price_pence", "bids", "sold_date"), "id")


def resolved(ledger: DataFrame, listings: DataFrame, limit: int | None = 200) -> DataFrame:
    """Sold or ended deals, latest surfaced first; the list is a top-200 report."""
    r = with_listing(ledger, listings).where("sold_date is not null").withColumn("paid_pence", F.coalesce("final_pence", "price_pence"))
    r = r.withColumn("actual_pct", tenths("(avg_market_pence - paid_pence)", "avg_market_pence")).orderBy(F.desc("surfaced_at"), "id")
    return r.limit(limit) if limit else r


def pending(ledger: DataFrame, listings: DataFrame) -> DataFrame:
    return with_listing(ledger, listings).where("sold_date is null")


def summary(ledger: DataFrame, listings: DataFrame) -> DataFrame:
    """Over the listed (top 200) outcomes: how many, how many beat the market, win rate, and the pending."""
    r = resolved(ledger, listings).agg(F.count("*").alias("total"), F.count_if(F.col("paid_pence") < F.col("avg_market_pence")).alias("beat"))
    p = pending(ledger, listings).agg(F.count("*").alias("pending"))
    rate = F.when(F.col("total") > 0, F.bround(F.col("beat") * 100.0 / F.col("total"), 1)).otherwise(0.0)
    return r.join(p, how="cross").withColumn("win_rate", rate)  # one row each


def active_deals(ledger: DataFrame, listings: DataFrame, as_of: Column) -> DataFrame:
    return pending(ledger, listings).where(F.col("end_time") > as_of)


def refresh_tier(rows: DataFrame, as_of: Column) -> DataFrame:
    """interval in minutes by the time left; rows past their end or an hour away have none and go."""
    left = (F.unix_seconds("end_time") - F.unix_seconds(as_of)) / 60.0
    tier = F.lit(None).cast("int")
    for most, every in reversed(TIERS):
        tier = F.when(left <= most, every).otherwise(tier)
    return rows.withColumn("interval", F.when(left > 0, tier)).where("interval is not null")


def refresh_due(rows: DataFrame, state: DataFrame, as_of: Column) -> DataFrame:
    """due: never refreshed, or longer ago than the interval. next_refreshed is the state to keep."""
    r = refresh_tier(rows, as_of).join(state.select("id", "last_refreshed"), "id", "left")
    due = F.col("last_refreshed").isNull() | ((F.unix_seconds(as_of) - F.unix_seconds("last_refreshed")) >= F.col("interval") * 60)
    return r.withColumn("due", due).withColumn("next_refreshed", F.when(due, as_of).otherwise(F.col("last_refreshed")))


def give_up(ledger: DataFrame, listings: DataFrame, as_of: Column) -> DataFrame:
    """ledger with gave_up set where the end is over a week past and nothing was sold."""
    unsold = listings.where("sold_date is null").select(F.col("id").alias("_id"))
    old = F.unix_seconds("end_time") < F.unix_seconds(as_of) - WEEK
    return ledger.join(unsold, F.col("id") == F.col("_id"), "left").withColumn("gave_up", F.col("gave_up") | (F.col("_id").isNotNull() & old)).drop("_id")


def verify_window(ledger: DataFrame, listings: DataFrame, as_of: Column) -> DataFrame:
    """Unsold deals that ended between a week and six hours ago, both strict."""
    ago = F.unix_seconds(as_of) - F.unix_seconds("end_time")
    return pending(ledger, listings).where(~F.col("gave_up") & (ago > DELAY) & (ago < WEEK))


def resolve(window: DataFrame, sightings: DataFrame) -> DataFrame:
    """Each deal of the window: SOLD with date, price (truncated pence) and bids if a sold page shows it
    with a date; else UNSOLD if a completed page shows it (ends unsold at its end time); else PENDING."""
    s = sightings.where("mode = 'sold' and sold_date is not null").select("id", "seq", F.col("sold_date").alias("s_date"), (F.col("price") * 100).cast("long").alias("s_pence"), F.col("bids").alias("s_bids"))
    c = sightings.where("mode = 'completed'").select("id").distinct().withColumn("c", F.lit(True))
    j = window.select("id", "end_time").join(latest(s), "id", "left").join(c, "id", "left")
    status = F.when(F.col("s_date").isNotNull(), "SOLD").when(F.col("c"), "UNSOLD").otherwise("PENDING")
    return j.withColumn("status", status).select("id", "status", F.when(F.col("status") == "SOLD", F.col("s_date")).when(F.col("status") == "UNSOLD", F.col("end_time").cast("date")).alias("sold_date"), F.col("s_pence").alias("price_pence"), F.col("s_bids").alias("bids"), (F.col("status") == "UNSOLD").alias("ended_unsold"))


def final_price_lock(ledger: DataFrame, listings: DataFrame) -> DataFrame:
    """final_pence takes the sale's price once and keeps it."""
    s = listings.where("sold_date is not null").select(F.col("id").alias("_id"), F.col("price_pence").alias("_p"))
    take = F.when(F.col("final_pence").isNull() & ~F.col("ended_unsold"), F.col("_p")).otherwise(F.col("final_pence"))
    return ledger.join(s, F.col("id") == F.col("_id"), "left").withColumn("final_pence", take).drop("_id", "_p")
