"""First sightings as a stream: a deal enters the ledger once, at the price at which it was first seen."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import exists
from .upserts import SCHEMA, run_to_end, shared_dir


def record_first_sightings(rows: DataFrame, base: str, static: DataFrame | None = None, key: str = "id", order: str = "at") -> DataFrame:
    """The sightings that entered the ledger in folder `base` after all that the stream `rows` holds: of each key that the ledger `static`
    lacks, the first row (least `order`) of the first batch that has it. What is known keeps its row, however late or often it
    comes again.

    The state is the ledger itself: a batch meets the keys of earlier batches in an anti join (which reads the key column
    alone) and writes a folder of its own number, so that a batch that runs again writes the same rows and a process that starts
    anew goes on."""
    spark = rows.sparkSession
    known = None if static is None else static.select(key)

    def add(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != key]
        new = batch.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*batch.columns)
        if known is not None:
            new = new.join(known, key, "left_anti")
        if exists(batch.sparkSession, f"{base}/ledger"):
            before = batch.sparkSession.read.schema(f"`{key}` {batch.schema[key].dataType.simpleString()}, batch long").parquet(f"{base}/ledger")
            new = new.join(before.where(F.col("batch") != number).select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{base}/ledger/batch={number}")

    run_to_end(rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{base}/log"))
    if not exists(spark, f"{base}/ledger"):
        return spark.createDataFrame([], rows.schema)
    return spark.read.schema(rows.schema).parquet(f"{base}/ledger").select(*rows.columns)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as sightings of deals (sixteen a user); the static ledger knows every fifth deal."""
    e = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir).where("user_id is not null and event_type <> 'error'")
    rows = e.select((F.col("user_id") * 16 + F.col("event_id") % 16).alias("id"), "value", F.col("event_id").alias("at"))
    known = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null").select((F.col("user_id") * 16 + F.col("event_id") % 16).alias("id")).where("id % 5 = 0").distinct()
    return record_first_sightings(rows, f"{shared_dir(spark)}/first-{uuid.uuid4().hex}", known)
