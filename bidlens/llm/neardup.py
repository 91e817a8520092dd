"""MinHash near-duplicates: one-permutation hashing with optimal densification, star-shaped edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bands_for, bitmaps, linked, mix, passes, release, settled, shingles, words, written

U64 = np.uint64
#: 32 bands of 5 bins: a pair of similarity 0.8 misses every band with odds of 3 in a million.
BANDS, ROWS = bands_for(0.8, 1 - 4e-6, 32)
#: Longs of a set's bitmap: 1024 bits.
LONGS = 16


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; of fewer than `size` words, their whole run is one."""
    h, doc, _, _ = words(data, off)
    s, at = shingles(h, doc, size)
    owner = doc[at] if len(at) else at
    cut, wcut = np.searchsorted(owner, np.arange(len(off))), np.searchsorted(doc, np.arange(len(off)))
    out = []
    for i in range(len(off) - 1):
        if cut[i] == cut[i + 1] and wcut[i] < wcut[i + 1]:
            total = U64(wcut[i + 1] - wcut[i])
            for x in h[wcut[i] : wcut[i + 1]]:
                total = mix(np.array([total * U64(31) + x], np.uint64))[0]
            out.append(np.array([total]))
        else:
            out.append(np.unique(s[cut[i] : cut[i + 1]]))
    return out


def one_permutation(values: np.ndarray, bins: int) -> np.ndarray:
    """The least hash in each of `bins` equal ranges; an empty bin takes that of a bin drawn for it by a
    fixed sequence of hashes, the first that isn't empty (Shrivastava, 2017), so that each bin agrees
    with the odds of the sets' similarity."""
    v = mix(values)
    where = ((v >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, where, v)
    full = np.zeros(bins, bool)
    full[where] = True
    empty = np.flatnonzero(~full)
    turn = 1
    while len(empty):
        to = (mix(empty.astype(np.uint64) * U64(0x10001) + U64(turn << 40)) % U64(bins)).astype(np.int64)
        hit = full[to]
        out[empty[hit]] = out[to[hit]]
        empty = empty[~hit]
        turn += 1
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    sig = one_permutation(values, bands * rows).reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + sig[:, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, band keys, bitmap. Whole texts, a few at a time."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, off, data in passes(batch.column(1)):
                n, x, y, keys = [], [], [], []
                sets = shingle_sets(data, off, size)
                for s in sets:
                    n.append(len(s))
                    x.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    y.append(int(mix(s ^ U64(0x5DEECE66D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    keys.append(band_keys(s, bands, rows).tolist() if len(s) else [])
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + len(n)]), pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(keys, pa.list_(pa.int64())), bitmaps(sets, LONGS)], ["doc_id", "n_shingles", "x", "y", "keys", "bits"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, x long, y long, keys array<long>, bits array<long>")


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    Documents with equal shingle sets (equal by size and two 64-bit hashes) are one class from the start, so
    thousands of copies are one node. Classes meet in banded buckets, candidates are stars (see `linked`),
    and a link stands when 100 * intersection >= percent * union on the full sets of words, recomputed
    from the texts. A text without words is linked with nothing. Rows that share a doc_id are one document with several texts.
    """
    sig = written(signatures(docs, size, bands, rows))
    own = ["n_shingles", "x", "y"]
    classes = written(sig.where("n_shingles > 0").groupBy(*own).agg(F.min(F.struct("doc_id", "keys", "bits")).alias("least")).select(*own, F.col("least.doc_id").alias("node"), "least.keys", "least.bits"))
    texts = docs.where("doc_id is not null").select("doc_id", "text")

    def confirm(batches):
        held: tuple = (None, None, None)
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            left, right = batch.column(2), batch.column(3)
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                t = left[i].as_py() or ""
                if held[0] != a[i] or held[1] != t:
                    held = (a[i], t, word_set(t, size))
                s, o = held[2], word_set(right[i].as_py() or "", size)
                both = len(s & o)
                good[i] = both > 0 and 100 * both >= percent * (len(s) + len(o) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        # few documents are in pairs: a written list of them, if small enough to broadcast, spares the others the shuffle
        named = written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
        own = texts.join(named, "doc_id", "left_semi")
        one = pairs.join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b")
        two = one.join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a")
        return two.select("a", "b", "left", "right").mapInArrow(confirm, "a long, b long").distinct()

    labels = linked(classes.select("node", F.col("n_shingles").cast("int").alias("n"), "keys", "bits"), verify, percent, LONGS)
    of = written(classes.join(labels, "node", "left").select(*[F.col(c).alias(f"_{c}") for c in own], F.coalesce("label", "node").alias("component_id")))
    release(classes)
    out = sig.join(of, (F.col("n_shingles") == F.col("_n_shingles")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def word_set(text: str, size: int) -> set[tuple[bytes, ...]]:
    """The distinct runs of `size` words of a text, A-Z lower-cased; of fewer words, the whole run."""
    w = text.encode().lower().split()
    return set(zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else {tuple(w)} if w else set()


def op7_minhash_near_dedup(spark, sf_dir) -> DataFrame:
    out = settled(spark, lambda: near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
