"""Continuous verification of outcomes: deals that have ended meet the pages that show how, as both arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.outcomes import DELAY, WEEK
from .upserts import SCHEMA, run_to_end, shared_dir

FOUND = "deal long, id long, end_time timestamp, mode string, seq long, sold_date date, price double, bids int, at timestamp"


def follow(deals: DataFrame, sightings: DataFrame, base: str) -> DataFrame:
    """A row (deal, id, end_time, status, sold_date, price_pence, bids, ended_unsold) for each deal of the stream `deals` (deal, id, end_time) that a
    page has settled, or whose week is over, after all that the streams hold, in folder `base`.

    A deal looks for pages of its id in the stream `sightings` (id, mode, seq, sold_date, price, bids, at) from six hours to a week after its
    end, both strict: a left outer join of the streams on the id and that span. Watermarks (a day for pages, two for deals)
    bound the state: a page is kept until no deal can need it, a deal until its week is over, when it comes out without a page.
    SOLD: a sold page with a date shows it, the latest counts, price cut to pence; UNSOLD: else a completed page does, it ended unsold
    at its end; PENDING: neither did, and the week is over."""
    d = deals.withWatermark("end_time", "2 days").select("deal", "id", "end_time").alias("d")
    shows = "(mode = 'sold' and sold_date is not null) or mode = 'completed'"
    s = sightings.withWatermark("at", "1 day").where(shows).select(F.col("id").alias("shown"), "mode", "seq", "sold_date", "price", "bids", "at")
    span = f"id = shown and at > end_time + interval {DELAY} seconds and at < end_time + interval {WEEK} seconds"
    found = d.join(s, F.expr(span), "left_outer").select(*[c.split()[0] for c in FOUND.split(", ")])
    run_to_end(found.writeStream.outputMode("append").format("parquet").option("path", f"{base}/found").option("checkpointLocation", f"{base}/log"))
    return settle(deals.sparkSession.read.schema(FOUND).parquet(f"{base}/found"))


def settle(found: DataFrame) -> DataFrame:
    """One row a deal from its rows with pages (or the one without)."""
    sold = F.when(F.col("mode") == "sold", F.struct("sold_date", (F.col("price") * 100).cast("long").alias("price_pence"), "bids"))
    one = found.groupBy("deal").agg(F.first("id").alias("id"), F.first("end_time").alias("end_time"), F.max_by(sold, F.when(F.col("mode") == "sold", F.col("seq"))).alias("s"), F.count_if(F.col("mode") == "completed").alias("c"))
    status = F.when(F.col("s").isNotNull(), "SOLD").when(F.col("c") > 0, "UNSOLD").otherwise("PENDING")
    day = F.when(F.col("s").isNotNull(), F.col("s.sold_date")).when(F.col("c") > 0, F.col("end_time").cast("date"))
    return one.select("deal", "id", "end_time", status.alias("status"), day.alias("sold_date"), F.col("s.price_pence").alias("price_pence"), F.col("s.bids").alias("bids"), (status == "UNSOLD").alias("ended_unsold"))


def streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """events as both: a signup surfaces a deal on one of its user's eight listings, which ends half a day later; purchases and clicks are sold and
    completed pages of a listing, every fourth sold page without a date."""
    e = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir).where("user_id is not null and ts is not null")
    at = F.col("ts").cast("timestamp")
    listing = (F.col("user_id") * 8 + F.col("event_id") % 8).alias("id")
    deals = e.where("event_type = 'signup'").select(F.col("event_id").alias("deal"), listing, (at + F.expr("interval 12 hours")).alias("end_time"))
    mode = F.when(F.col("event_type") == "purchase", "sold").otherwise("completed").alias("mode")
    dated = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 4 != 0), at.cast("date")).alias("sold_date")
    pages = e.where("event_type in ('purchase', 'click')").select(listing, mode, F.col("event_id").alias("seq"), dated, F.col("value").alias("price"), (F.col("event_id") % 30).cast("int").alias("bids"), at.alias("at"))
    return deals, pages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return follow(*streams(spark, sf_dir), f"{shared_dir(spark)}/verify-{uuid.uuid4().hex}")
