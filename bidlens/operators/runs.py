"""A run over all categories in which one that fails stops none of the others."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import exists

LOG = "run_id string, category string, attempt int, ok boolean, error string, began timestamp, ended timestamp"
MARKER = "id int, last_scrape_at timestamp"


def run_all(spark: SparkSession, base: str, run_id: str, categories: Iterable[str], job: Callable[[str], DataFrame], attempts: int = 2, clock=None) -> DataFrame:
    """Runs job(category) as a Spark job for each category in turn, writes what it gives to `results/run_id=.../category=...` in folder `base`, and
    returns this run's log (LOG), a row an attempt. A job that raises is tried again, up to `attempts` times, and then left: its
    category has no folder in this run, the next one goes on. A category that an earlier, broken-off run with this id has written whole is
    not run again. When all categories have ended, failed ones included, the marker (`marker/`, one row: id 1 and the
    time) is overwritten; a run that dies before leaves the old one."""
    now = clock or (lambda: datetime.datetime.now(datetime.timezone.utc))
    for category in categories:
        path = f"{base}/results/run_id={run_id}/category={category}"
        for attempt in range(1, attempts + 1):
            if exists(spark, f"{path}/_SUCCESS"):
                break
            began, error = now(), None
            try:
                job(category).write.mode("overwrite").parquet(path)
            except Exception as e:  # noqa: BLE001 - whatever it is, the other categories must run
                error = f"{type(e).__name__}: {e}"[:500]
            spark.createDataFrame([(run_id, category, attempt, error is None, error, began, now())], LOG).coalesce(1).write.mode("append").parquet(f"{base}/log")
            if error is None:
                break
    spark.createDataFrame([(1, now())], MARKER).coalesce(1).write.mode("overwrite").parquet(f"{base}/marker")
    return spark.read.schema(LOG).parquet(f"{base}/log").where(F.col("run_id") == run_id)


def results(spark: SparkSession, base: str, run_id: str, schema: str) -> DataFrame:
    """What the categories of a run gave; only folders written whole count."""
    path = f"{base}/results/run_id={run_id}"
    return spark.read.schema(schema + ", category string").parquet(path) if exists(spark, path) else spark.createDataFrame([], schema + ", category string")


def marker(spark: SparkSession, base: str) -> DataFrame:
    """When the last run ended; no row if none has."""
    return spark.read.schema(MARKER).parquet(f"{base}/marker") if exists(spark, f"{base}/marker") else spark.createDataFrame([], MARKER)
