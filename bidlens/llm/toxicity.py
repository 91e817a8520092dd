"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, passes, words

U64 = np.uint64
BITS = 20
#: Labelled rows the model is fitted on at the most: those of smallest hash.
SAMPLE = 12_000


def features(data: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document index, slot) of every word, pair of neighbours and pair with one word between."""
    h, doc, _, _ = words(data, off)
    slots, docs = [h], [doc]
    for gap, salt in ((1, 0xA5A5A5A5), (2, 0x5A5A5A5A5A)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            slots.append(mix(h[:-gap] * U64(3) + h[gap:] * U64(7) + U64(salt))[same])
            docs.append(doc[:-gap][same])
    return np.concatenate(docs), (np.concatenate(slots) >> U64(64 - bits)).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int = BITS, alpha=2.0, beta=1.0, l1: float | None = None, l2=0.0, epochs=6) -> np.ndarray:
    """Weights after `epochs` passes in the given order; the last is the bias, which is not shrunk.

    Per-coordinate rates alpha / (beta + sqrt(n)) and proximal L1 (McMahan et al., 2013): coordinates
    whose |z| stays below l1 are exactly 0. Features are 0 or 1, so a long text weighs no more than
    what it contains. l1 follows the rows (a thousandth of them, at least 1) unless given."""
    l1 = max(1.0, len(rows) / 1000) if l1 is None else l1
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weight(i):
        shrink = np.where(i == 1 << bits, 0.0, l1)
        w = (np.sign(z[i]) * shrink - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= shrink, 0.0, w)

    for _ in range(epochs):
        for slots, y in rows:
            i = np.r_[slots, 1 << bits]
            w = weight(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weight(np.arange(len(z)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) of the fitted model, nonzero ones only.

    Only labels whose crc32(doc_id as text) mod 3 is not 1 count; a document labelled more than once
    takes the highest label. The sample (`sample` rows at the most, smallest hash first) has a proven
    bound: it is broadcast to the texts and fitted in one task. With no labels all weights are 0."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    known = known.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = known.orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "toxic")

    def slots(batches):
        for batch in batches:
            ids, toxic = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for a, off, data in passes(batch.column(1)):
                d, s = features(data, off, bits)
                order = np.argsort(d, kind="stable")
                cut = np.searchsorted(d[order], np.arange(len(off)))
                own = [np.unique(s[order[cut[i] : cut[i + 1]]]).astype("<i4").tobytes() for i in range(len(off) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + len(own)]), pa.array(toxic[a : a + len(own)].astype(np.int32)), pa.array(own, pa.binary())], ["doc_id", "toxic", "slots"])

    def train(batches):
        rows = [(r["doc_id"], r["toxic"], r["slots"]) for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (int(mix(np.array([r[0]], np.int64).view(np.uint64))[0]), r[2]))
        w = ftrl([(np.frombuffer(s, "<i4"), y) for _, y, s in rows], bits)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["slot", "weight"])

    got = texts.mapInArrow(slots, "doc_id long, toxic int, slots binary").repartition(1).mapInArrow(train, "slot long, weight double").toPandas()
    return got["slot"].to_numpy(np.int64), got["weight"].to_numpy(float)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = 0.7, bits: int = BITS) -> DataFrame:
    """All columns of docs with score (0 to 1) and predicted (1 if score >= threshold); columns of docs that
    bear those two names give way to these. Each distinct feature of a text counts once; a text without
    words, or null, has the bias's score. The weights, at most 2**bits, are broadcast. No shuffle."""
    weights = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    names = docs.columns

    def run(batches):
        slot, weight = weights.value
        dense = np.zeros(1 << bits)
        dense[slot[slot < 1 << bits]] = weight[slot < 1 << bits]
        bias = float(weight[slot == 1 << bits].sum())
        for batch in batches:
            out = []
            for _, off, data in passes(batch.column(names.index("text"))):
                d, s = features(data, off, bits)
                hot = np.flatnonzero(dense[s])
                pair = np.unique(d[hot] << bits | s[hot])
                out.append(np.bincount(pair >> bits, dense[pair & (1 << bits) - 1], len(off) - 1) + bias)
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(out), -35, 35))) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op3_toxicity(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs.select("doc_id", "text"), learn(docs, labels))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
