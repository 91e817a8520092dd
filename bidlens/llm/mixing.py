"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, written

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Weights go round over the sources by code point, null last. Shares of share * total by weight stop
    at most * size; what is over is dealt again by weight until none is above. That end state is
    target = min(most * size, level * weight) at one level, found by sorting sources by where they
    stop. One small row a source, the only rows that meet in one task: for a source a site, some 100 bytes each,
    not for a source a document.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("weight"))
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # level if this source and all later ones are below their caps
    s = s.withColumn("level", (share * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("free", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(everything)["level"]
    return s.select("source", "source_size", F.when(level.isNull() | (level * F.col("weight") > most * F.col("source_size")), most * F.col("source_size")).otherwise(level * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix-1", keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for every row of docs, and with `keep` those
    columns in a struct `row`, so that each row's copies stay with it.

    A document's expected copies are its source's target / size. Within a source the documents stand
    in order of size, then doc_id, then a hash of the text and of the other columns kept (rows alike in all of them are
    interchangeable); the prefix sums of the copies plus one random offset a source give a
    document one copy for each whole number that they cross, so a source's words differ from its target
    by about one document's. The order, not the layout, decides: reruns agree. A document without words (empty or null text)
    has 0 taken words. Repeated rows each stand for themselves. A null source is one source.

    A range sort on (source, size, doc_id, hash, place) deals a hot source, and a row that is repeated without end, over many tasks; ranks are a row's place
    in its partition plus the rows of its source in earlier partitions (one count a partition and
    source). Without `keep` only sizes and ids are sorted, never texts.
    """
    row = [F.struct(*keep).alias("row")] if keep else []
    rest = [c for c in keep or () if c not in ("doc_id", "source", "text")]
    hashes = F.xxhash64("text", F.to_json(F.struct(*rest))) if rest else F.xxhash64("text")
    named = ["row"] if keep else []
    sized = docs.where("doc_id is not null").select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hashes.alias("hash"), *row)
    sized = written(sized.withColumn("tie", F.hash(F.monotonically_increasing_id())))
    goal = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    order = [F.col("source").asc_nulls_last(), "size", "doc_id", "hash", "tie"]
    laid = written(sized.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "source", "size", *named, F.monotonically_increasing_id().alias("place"), F.spark_partition_id().alias("part")))
    release(sized)
    parts = laid.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = written(parts.select(F.col("source").alias("s"), F.col("part").alias("p"), "first", before.alias("before")))
    goal = goal.withColumnRenamed("source", "s")
    ranked = laid.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select("doc_id", "source", "size", *named, (F.col("before") + F.col("place") - F.col("first")).alias("rank"))
    all_ = ranked.join(goal, F.col("source").eqNullSafe(F.col("s")))
    offset = F.conv(F.substring(F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit("|" + seed))), 1, 4), 16, 10).cast("double") / 65536.0
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return all_.withColumn("e", copies).withColumn("u", offset).select("doc_id", "size", "source", "source_size", "target", *named, (F.floor(F.col("e") * (F.col("rank") + 1) + F.col("u")) - F.floor(F.col("e") * F.col("rank") + F.col("u"))).cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def op8_mix_sources(spark, sf_dir) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS weight FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, source_size::DOUBLE / weight) FILTER (WHERE level * weight <= 2.0::DOUBLE * source_size) AS level FROM l),
g AS (SELECT source, source_size, CASE WHEN v.level IS NULL OR v.level * weight > 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size ELSE v.level * weight END AS target FROM w, v),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS rank,
  CASE WHEN g.source_size > 0 THEN least(2.0::DOUBLE, g.target / g.source_size) ELSE 0.0::DOUBLE END AS e,
  CAST('0x' || substr(md5(coalesce(d.source, '') || '|mix-1'), 1, 4) AS INT) / 65536.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(floor(e * (rank + 1) + u) - floor(e * rank + u) AS BIGINT) * size AS taken FROM r
"""
