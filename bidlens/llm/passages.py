"""Substring dedup by paragraph MinHash banding.

A paragraph here is a content-defined block of words: it ends at the words whose hash, taken with the
word before, is the least among the `reach` words on either side. Blocks (11 words on average) thus fall
alike in every copy of a passage, also in the middle of a line, which line breaks would miss.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bands_for, buckets_for, linked, mix, passes, release, repeated_places, settled, shingles, words, written

U64 = np.uint64
REACH, SHINGLE = 5, 5
#: Tuned for pairs of similarity 0.8: 4 bands of 2, which miss such a pair with odds of 1.7 %, of 0.9 with 0.2 %.
BANDS, ROWS = bands_for(0.8, 0.98, 4)
#: Longs of a block's bitmap: 256 bits for about 7 shingles.
LONGS = 4
_BITS = f"transform(sequence(0, {LONGS - 1}), i -> aggregate(filter(shingles, x -> pmod(shiftright(x, 6), {LONGS}) = i), 0L, (b, x) -> b | shiftleft(1L, cast(x & 63 as int))))"


def blocks(data: np.ndarray, off: np.ndarray, reach: int = REACH):
    """Words (hash, document, first and end byte) and each block's first word; a last entry ends them. A
    document's blocks depend on its own text alone: no word is before its first, and none is near its ends."""
    h, doc, start, end = words(data, off)
    n = len(h)
    if not n:
        return h, doc, start, end, np.zeros(1, np.int64)
    before = np.r_[U64(0), h[:-1]]
    before[1:][doc[1:] != doc[:-1]] = 0
    two = mix(h * U64(3) + before * U64(5))
    # `reach` greatest numbers between documents, so that none sees another's words
    at = np.arange(n) + reach * doc
    size = n + reach * (len(off) - 2)
    wide = np.full(size + 2 * reach, np.iinfo(np.uint64).max, np.uint64)
    wide[at + reach] = two
    least = np.min([wide[i : i + size] for i in range(2 * reach + 1) if i != reach], axis=0)[at]
    ends = two < least
    ends[:-1] |= doc[1:] != doc[:-1]
    ends[-1] = True
    return h, doc, start, end, np.r_[0, np.flatnonzero(ends) + 1]


def sketches(h, doc, first, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS):
    """Shingles (hash, block) and each block's band keys. A block under `size` words is one shingle."""
    n = len(first) - 1
    block = np.repeat(np.arange(n), np.diff(first))
    s, at = shingles(h, block, size)
    owner = block[at] if len(at) else at
    lone = np.flatnonzero(np.bincount(owner, minlength=n) == 0)
    if len(lone):
        total = np.zeros(len(lone), np.uint64)
        for i in range(size - 1):
            there = first[lone] + i < first[lone + 1]
            total = np.where(there, mix(total * U64(31) + h[np.minimum(first[lone] + i, len(h) - 1)]), total)
        s, owner = np.r_[s, total], np.r_[owner, lone]
        order = np.argsort(owner, kind="stable")
        s, owner = s[order], owner[order]
    cut = np.searchsorted(owner, np.arange(n))
    keys = np.zeros((n, bands), np.uint64)
    for b in range(bands):
        key = np.full(n, b + 1, np.uint64)
        for r in range(rows):
            key = mix(key * U64(0x9E3779B97F4A7C15) + np.minimum.reduceat(mix(s + U64((b * rows + r + 1) * 0x632BE59BD9B4E019 % 2**64)), cut))
        keys[:, b] = key
    return s, owner, keys


def duplicate_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block, tag): blocks whose component also holds a block of a document with a smaller doc_id.

    Band keys that one document alone holds are dropped without loss before anything else moves. Equal
    blocks are one class (equal in their number of shingles and two 64-bit hashes of them all); classes meet in band buckets as stars (see
    `linked`), links are confirmed by exact Jaccard (0.8) on the five-word shingles, and components decide. tag: the text's hash.
    """
    texts = docs.where("doc_id is not null").select("doc_id", "text")

    def keys_of(off, data):
        h, doc, _, _, first = blocks(data, off)
        if len(first) < 2:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, _, keys = sketches(h, doc, first)
        own = doc[first[:-1]]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        return keys.ravel(), np.repeat(own, keys.shape[1]), np.repeat(place, keys.shape[1])

    places = repeated_places(texts, keys_of, buckets_for(texts)).groupBy("doc_id").agg(F.collect_set("place").alias("places"))

    def describe(batches):
        names = ["doc_id", "block", "tag", "n", "x", "y", "shingles", "keys"]
        for batch in batches:
            ids, lists, tags = batch.column(0).to_numpy(), batch.column(2), batch.column(3).to_numpy()
            for a, off, data in passes(batch.column(1)):
                h, doc, _, _, first = blocks(data, off)
                if len(first) < 2:
                    continue
                s, owner, keys = sketches(h, doc, first)
                own = doc[first[:-1]]
                cut = np.searchsorted(own, np.arange(len(off)))
                take = np.concatenate([cut[i] + np.intersect1d(lists[a + i].values.to_numpy(), np.arange(cut[i + 1] - cut[i])) for i in range(len(off) - 1)]).astype(np.int64)
                edge = np.searchsorted(owner, np.arange(len(first)))
                sets = [np.unique(s[edge[b] : edge[b + 1]]) for b in take]
                for c in range(0, len(take), 8192):
                    t, part = take[c : c + 8192], sets[c : c + 8192]
                    size = np.array([len(x) for x in part])
                    flat = np.concatenate(part)
                    lead = np.r_[0, np.cumsum(size)]
                    x, y = (np.add.reduceat(mix(flat ^ U64(salt)), lead[:-1]).view(np.int64) for salt in (0, 0x5DEECE66D))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a + own[t]]), pa.array((t - cut[own[t]]).astype(np.int32)), pa.array(tags[a + own[t]]), pa.array(size.astype(np.int32)), pa.array(x), pa.array(y), pa.ListArray.from_arrays(pa.array(lead.astype(np.int32)), pa.array(flat.view(np.int64))), pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys[t].ravel().view(np.int64)))],
                        names,
                    )

    found = texts.join(places, "doc_id").select("doc_id", "text", "places", F.xxhash64("text").alias("tag"))
    found = written(found.mapInArrow(describe, "doc_id long, block int, tag long, n int, x long, y long, shingles array<long>, keys array<long>"))
    own = ["n", "x", "y"]
    classes = found.groupBy(*own).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.first(F.struct("shingles", "keys")).alias("one"))
    classes = written(classes.select(*own, "first_doc", "last_doc", "one.shingles", "one.keys").withColumn("node", F.monotonically_increasing_id()))
    where = written(found.select("doc_id", "block", "tag", *own))
    release(found)

    def verify(pairs: DataFrame) -> DataFrame:
        named = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
        sets = classes.select("node", "shingles").join(named, "node", "left_semi")
        one = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
        two = one.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
        both = F.size(F.array_intersect("left", "right"))
        return two.where(both * 100 >= 80 * (F.size("left") + F.size("right") - both)).select("a", "b")

    labels = linked(classes.select("node", "n", "keys", F.expr(_BITS).alias("bits")), verify, 80, LONGS)
    of = classes.select("node", *own, "first_doc", "last_doc").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    low = of.groupBy("label").agg(F.min("first_doc").alias("low"))
    lows = written(of.join(low, "label").where("low < last_doc").select(*own, "low"))
    release(classes)
    return where.join(lows, own).where("low < doc_id").select("doc_id", "block", "tag")


def remove_passages(docs: DataFrame, min_words: int = 15) -> DataFrame:
    """All columns of docs with text cut, and n_blocks, n_removed (words): runs of neighbouring
    duplicate blocks of at least min_words words go from every document but that of smallest doc_id. Columns
    of docs that bear those two names give way to these.

    Shorter repeats (common lines, licences, headings) stay. Passages that repeat inside one document
    alone stay. A text loses the bytes from a run's first word to the word after its last. A null text stays null;
    rows that share a doc_id lose nothing to one another."""
    kept = docs.where("doc_id is not null").drop("n_blocks", "n_removed")
    names = kept.columns
    where = names.index("text")
    dup = settled(docs.sparkSession, lambda: duplicate_blocks(docs).groupBy("doc_id", "tag").agg(F.collect_set("block").alias("blocks")))
    # columns by place, whatever their names: the row in a struct beside the key and the blocks
    rows = kept.select(F.struct(*names).alias("row"), F.col("doc_id").alias("key"), F.xxhash64("text").alias("hash"))
    joined = rows.join(dup, (F.col("key") == F.col("doc_id")) & (F.col("hash") == F.col("tag")), "left").select("row", "blocks")

    def cut(batches):
        for batch in batches:
            row, lists = batch.column(0), batch.column(1)
            texts, counts, gone = [], [], []
            cols = row.flatten()
            for a, off, data in passes(cols[where]):
                h, doc, start, end, first = blocks(data, off)
                own = doc[first[:-1]] if len(first) > 1 else np.zeros(0, np.int64)
                edge = np.searchsorted(own, np.arange(len(off)))
                raw = data.tobytes()
                for i in range(len(off) - 1):
                    whole = raw[off[i] : off[i + 1]]
                    n = int(edge[i + 1] - edge[i])
                    counts.append(n)
                    lost, parts, at = 0, [], int(off[i])
                    if lists[a + i].is_valid:
                        got = np.sort(lists[a + i].values.to_numpy())
                        got = got[got < n]
                        for run in np.split(got, np.flatnonzero(np.diff(got) > 1) + 1):
                            if not len(run):
                                continue
                            f, e = int(first[edge[i] + run[0]]), int(first[edge[i] + run[-1] + 1])
                            if e - f < min_words:
                                continue
                            stop = int(start[e]) if e < len(start) and doc[e] == i else int(off[i + 1])
                            parts.append(raw[at : int(start[f])])
                            at, lost = stop, lost + e - f
                    gone.append(lost)
                    null = not cols[where][a + i].is_valid
                    texts.append(None if null else (b"".join(parts) + raw[at : off[i + 1]]).decode() if lost else whole.decode())
            cols[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int32()), pa.array(gone, pa.int32())], [*names, "n_blocks", "n_removed"])

    schema = T.StructType([*kept.schema.fields, T.StructField("n_blocks", T.IntegerType()), T.StructField("n_removed", T.IntegerType())])
    return joined.mapInArrow(cut, schema)


def op9_substring_dedup(spark, sf_dir) -> DataFrame:
    out = remove_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_blocks", "n_removed", (F.col("n_removed") > 0).alias("changed"), "text")
