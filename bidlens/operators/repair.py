"""Corrupted prices: find, split, purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import delete_cascade


def suspect_prices(listings: DataFrame, gpu: DataFrame, cpu: DataFrame, below: int = 1000) -> DataFrame:
    """Listings of either category under `below` pence; an id in both counts as GPU."""
    g = gpu.select(F.col("id").alias("_g"), F.col("model").alias("g_model"))
    c = cpu.select(F.col("id").alias("_c"), F.col("model").alias("c_model"))
    rows = listings.where(F.col("price_pence") < below)
    j = rows.join(g, F.col("id") == F.col("_g"), "left").join(c, F.col("id") == F.col("_c"), "left").where("_g is not null or _c is not null")
    return j.select("id", F.when(F.col("_g").isNotNull(), "GPU").otherwise("CPU").alias("category"), F.when(F.col("_g").isNotNull(), F.col("g_model")).otherwise(F.col("c_model")).alias("model"), "title", "price_pence", "end_time", "sold_date")


def suspect_split(suspects: DataFrame, as_of: Column) -> DataFrame:
    return suspects.withColumn("state", F.when((F.col("end_time") > as_of) & F.col("sold_date").isNull(), "active").otherwise("ended"))


def purge(tables: dict[str, DataFrame], suspects: DataFrame, as_of: Column, dry_run: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """Deletes the ended suspects from every table; a dry run reports what it would delete."""
    ended = suspect_split(suspects, as_of).where("state = 'ended'")
    kept, counts = delete_cascade(tables, ended)
    return (tables if dry_run else kept), counts
