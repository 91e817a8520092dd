"""Continuous upsert: a stream of snapshots merged into a partitioned table, batch by batch."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import table

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in local mode with none set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextlib.contextmanager
def with_state_store(spark: SparkSession):
    """Streams that begin inside keep their state in RocksDB, which states of several variables need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_to_end(writer) -> None:
    """Runs the stream over all that its source holds now."""
    writer.trigger(availableNow=True).start().awaitTermination()


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of snapshots: purchases are sales, errors are rows that can't be read."""
    e = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return e.select(F.col("user_id").alias("id"), F.when(F.col("event_type") != "error", F.col("value")).alias("price"), F.when(F.col("event_type") == "purchase", "sold").otherwise("active").alias("mode"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"))


#: Folders of ids that a table of one mode is dealt to: a batch rewrites those in which its ids lie.
BUCKETS = 16


def merge_stream(rows: DataFrame, base: str, key: str = "id", order: str = "seq", buckets: int = BUCKETS) -> DataFrame:
    """The table in folder `base` after all that the stream `rows` holds: the last write (greatest `order`) of each key.

    The table lies in partitions by a hash of the key. A batch rewrites those that its keys fall in, all others keep their files. A
    process that starts anew on the same folder goes on where the last one stopped, and a batch that failed and runs
    again ends in the same table."""
    spark = rows.sparkSession
    bucketed = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.merge(base, bucketed(batch), ("bucket",), key, order, keep_order=True)

    run_to_end(rows.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/log"))
    schema = bucketed(spark.createDataFrame([], rows.schema)).schema
    return table.read_table(spark, base, schema).select(*rows.columns)


def run(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """The table of snapshots after all that the stream holds; rows without a price or an id are left out."""
    rows = snapshots(spark, sf_dir).where("price is not null and id is not null").select("id", "price", "mode", "seq")
    return merge_stream(rows, base or f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}")
