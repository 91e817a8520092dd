"""Listings in a relational database, read and written in partitions of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def bounds(spark: SparkSession, url: str, table: str, key: str = "id", **options: str) -> tuple[int, int] | None:
    """Least and greatest key, which the database finds; None for an empty table."""
    name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    query = f"select min({name}) as lo, max({name}) as hi from {table}"
    r = spark.read.format("jdbc").options(url=url, query=query, **options).load().first()
    return None if r[0] is None else (int(r[0]), int(r[1]))


def scan(spark: SparkSession, url: str, table: str, partitions: int, key: str = "id", **options: str) -> DataFrame:
    """The table in as many parts, each a range of the key between its least and greatest value, read side by side. Filters and the
    choice of columns are pushed into the database's queries. Keys outside the bounds (inserted since) belong to the outer parts; null
    keys to the first."""
    found = bounds(spark, url, table, key, **options)
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if found is None or partitions < 2:
        return reader.load()
    lo, hi = found
    return reader.options(partitionColumn=key, lowerBound=str(lo), upperBound=str(hi + 1), numPartitions=str(min(partitions, hi - lo + 1))).load()


def save(rows: DataFrame, url: str, table: str, partitions: int, mode: str = "append", **options: str) -> None:
    """Writes rows over at most `partitions` connections."""
    rows.coalesce(partitions).write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
