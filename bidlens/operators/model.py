"""A listing table with the market model beside it, kept up to date batch by batch.

The model is a histogram of sold prices by product. A batch of upserts changes it by what its rows add and what the rows that they
replace take back, so the work follows the batch and not the table; statistics are read from the histogram alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import market, table
from .ingest import enrich

HISTOGRAM = "category string, k1 string, k2 string, price_pence long, c long"
LISTING = "id long, category string, title string, price_pence long, bids int, end_time timestamp, sold_date date, url string, is_sold boolean"


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changes in the histogram as `new` listings replace `old` ones: counts added and, as negative ones, taken back. Only sold
    listings with a product count; one that is sold no more, or whose title or price changes, is taken back."""
    signed = old.withColumn("c", F.lit(-1)).unionByName(new.withColumn("c", F.lit(1))).where("sold_date is not null")
    rows = market.sold(market.market_listing(enrich(signed)))
    return rows.groupBy(*market.KEYS, "price_pence").agg(F.sum("c").cast("long").alias("c")).where("c <> 0")


class Store:
    """Folder `base`: `listing/` by category and is_sold, and `changes/`, the histogram's changes by batch.

    The changes of a batch are written before its rows, and not again if they stand: a batch that fails in between and runs
    again (under its number) counts once. Batches run one after another, in the order of their numbers."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def merge(self, batch: DataFrame, number: int) -> set[tuple]:
        """Upserts batch (the columns of LISTING but is_sold, and seq); returns the partitions touched."""

        def note(old: DataFrame, new: DataFrame) -> None:
            path = f"{self.base}/changes/batch={number}"
            if not self._exists(f"{path}/_SUCCESS"):
                delta(old, new).write.mode("overwrite").parquet(path)

        rows = batch.withColumn("is_sold", F.col("sold_date").isNotNull()).select("seq", *[c.split()[0] for c in LISTING.split(", ")])
        return table.merge(f"{self.base}/listing", rows, before=note)

    def listing(self) -> DataFrame:
        return table.read_table(self.spark, f"{self.base}/listing", self.spark.createDataFrame([], LISTING).schema)

    def histogram(self) -> DataFrame:
        """Counts of sold prices by product over all batches."""
        path = f"{self.base}/changes"
        if not self._exists(path):
            return self.spark.createDataFrame([], HISTOGRAM)
        changes = self.spark.read.schema(HISTOGRAM + ", batch long").parquet(path)
        return changes.groupBy(*market.KEYS, "price_pence").agg(F.sum("c").alias("c")).where("c <> 0")

    def compact(self, below: int) -> None:
        """Adds up the changes of the batches under `below`, as those of batch -1; those batches are done."""
        path = f"{self.base}/changes"
        changes = self.spark.read.schema(HISTOGRAM + ", batch long").parquet(path).where(F.col("batch") < below)
        done = [r[0] for r in changes.select("batch").distinct().collect()]
        if len(done) > 1:
            whole = changes.groupBy(*market.KEYS, "price_pence").agg(F.sum("c").alias("c")).where("c <> 0")
            whole.write.mode("overwrite").parquet(f"{self.base}/compacted")
            fs = self.spark._jvm.org.apache.hadoop.fs
            to = fs.Path(f"{path}/batch=-1")
            system = to.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for b in done:
                system.delete(fs.Path(f"{path}/batch={b}"), True)
            system.rename(fs.Path(f"{self.base}/compacted"), to)

    def clean_stats(self, min_count: int = 5, priced_only: bool = False) -> DataFrame:
        return market.stats_of(self.histogram(), min_count, priced_only)
