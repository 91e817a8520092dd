"""Tables in partitions: a batch rewrites only the partitions that it touches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ingest import latest

#: The partitions of a listing table.
LAYOUT = ("category", "is_sold")


def read_table(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    """The table's rows; an empty one if nothing was written yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/rows")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/rows").select(*schema.names)


def one_of(by: Iterable[str], values: Iterable[tuple]) -> Column:
    """Whether a row lies in one of the partitions; on partition columns alone, so files of others aren't read."""
    out = F.lit(False)
    for v in values:
        same = F.lit(True)
        for c, x in zip(by, v, strict=True):
            same = same & F.col(c).eqNullSafe(F.lit(x))
        out = out | same
    return out


def _folder(by: Iterable[str], values: tuple) -> str:
    """The folder of a partition, as Spark names it."""

    def name(x) -> str:
        x = str(x).lower() if isinstance(x, bool) else str(x)
        return re.sub(r"[\x00-\x1f\"#%'*/:=?\\{\[\]^\x7f]", lambda m: f"%{ord(m.group()):02X}", x) if x else ""

    return "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if x is None or x == '' else name(x)}" for c, x in zip(by, values, strict=True))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _partitions(rows: DataFrame, by: tuple[str, ...]) -> set[tuple]:
    """The partitions that rows lie in: as many at the most as the table has."""
    return {tuple(r) for r in rows.select(*by).distinct().collect()}


def merge(base: str, batch: DataFrame, by: tuple[str, ...] = LAYOUT, key: str = "id", order: str = "seq", keep_order: bool = False, before=None) -> set[tuple]:
    """Upserts batch into the table in folder `base` (`rows/`, partitioned by the columns `by`); returns the partitions that were touched.

    Within a batch the last row of a key by `order` counts. Across batches the later batch wins, or, with keep_order, the
    greater order (which is then a column of the table). Of the table, only keys and partition columns are read
    to find where the batch's keys lie; those partitions and those that the batch goes to are read whole and rewritten by
    dynamic partition overwrite, all others keep their files. A partition whose rows all move elsewhere is removed first: all of
    them are in the batch. A batch that failed half-way and runs again ends in the same table. Readers see each partition
    as it was before or after, not the whole batch at once. before(old, new), if given, gets the rows that the batch replaces and brings."""
    spark = batch.sparkSession
    inbox = f"{base}/inbox-{uuid.uuid4().hex}"
    last = latest(batch, key, order) if not keep_order else latest(batch.withColumn("_order", F.col(order)), key, "_order")
    columns = [c for c in batch.columns if keep_order or c != order]
    last.select(*columns).write.parquet(inbox)
    try:
        new = spark.read.schema(last.select(*columns).schema).parquet(inbox)
        table = read_table(spark, base, new.schema)
        if keep_order:
            older = new.select(key, F.col(order).alias("_order"))
            beaten = table.select(key, order).join(older, key).where(F.col(order) > F.col("_order")).select(key)
            new = new.join(beaten, key, "left_anti").select(*columns)
        moved = _partitions(table.select(key, *by).join(new.select(key), key, "left_semi"), by)
        into = _partitions(new, by)
        touched = table.where(one_of(by, moved | into))
        if before is not None:
            before(touched.where(one_of(by, moved)).join(new.select(key), key, "left_semi"), new)
        kept = touched.join(new.select(key), key, "left_anti")
        gone = moved - into
        emptied = gone - _partitions(kept.where(one_of(by, gone)), by) if gone else gone
        for p in emptied:
            _delete(spark, f"{base}/rows/{_folder(by, p)}")
        out = kept.where(~one_of(by, emptied)).unionByName(new).hint("rebalance", *by)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{base}/rows")
        return moved | into
    finally:
        _delete(spark, inbox)
