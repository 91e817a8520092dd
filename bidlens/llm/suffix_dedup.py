"""Exact substring dedup by suffix sorting with bucket-pointer refinement.

Hashes only choose what meets: whole texts are taken for equal by length and SHA-256, everything else by its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BUCKET_BYTES, differ, mix, parallelism, passes, powers, prefix, release, repeated_places, settled, span_hash, written

U64 = np.uint64
#: Documents that are sampled for keys with many contexts, at least, one in MOST at the least; contexts that make a key hot.
SAMPLED, MOST, HOT = 16_384, 4096, 512


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every `width` neighbours, in log2(width) passes."""
    done = 1
    while done * 2 <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def runs(off: np.ndarray, data: np.ndarray, length: int, gram: int, hot: np.ndarray | None = None):
    """Runs of neighbouring windows of `length` bytes that share their least q-gram hash: (that hash,
    document index, first window, last window), places within the document. Equal windows have equal
    least hashes, wherever they stand: they lie in runs of one key. Windows of a `hot` key (a sorted array), which would
    bring too many contexts to one place, are runs by themselves, keyed by their own hash."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, none
    sums = prefix(data)
    _, down = powers(len(sums))
    h = mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    least = mix(_sliding(h, length - gram + 1, np.minimum)[:n])  # least hashes crowd at 0; buckets take equal ranges
    inside = np.zeros(len(data) + 1, np.int32)
    short = np.diff(off) < length
    inside[off[:-1][~short]] += 1
    np.add.at(inside, off[1:][~short] - length + 1, -1)
    ok = np.cumsum(inside)[:n] > 0
    if hot is not None and len(hot):
        at = np.flatnonzero(ok & (hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least))
        least[at] = mix(span_hash(sums, at, at + length) ^ U64(0x0DDB1A5E5BAD5EED))
    new = ok.copy()
    same = ok[1:] & ok[:-1] & (least[1:] == least[:-1])
    starts = np.zeros(n, bool)
    starts[off[:-1][~short]] = True
    new[1:] &= ~same | starts[1:]
    first = np.flatnonzero(new)
    after = np.flatnonzero(ok & np.r_[new[1:] | ~ok[1:], True])
    doc = np.searchsorted(off, first, "right") - 1
    return least[first], doc, first - off[doc], after - off[doc]


def bucket_refine(data: np.ndarray, starts: np.ndarray, length: int, base: int = 8, batch: int = 1 << 16) -> np.ndarray:
    """Number of the `length` bytes at each start: equal numbers, equal bytes.

    Bucket-pointer refinement (Schürmann and Stoye, 2005). Suffixes are first sorted into buckets by their q-gram
    (`base` bytes, read as one number); a suffix points at its bucket, the place where that begins. Buckets are then refined from left to
    right, a batch of neighbouring ones at a time: a bucket's suffixes are sorted by the pointers of the suffixes `depth` further on, where
    depth is how many bytes all of the bucket share, and its parts get pointers of their own at once, so that whatever is refined after
    them, their own parts first of all, sorts by the finer pointers and gains as many bytes as the bucket pointed at shares. Sorted
    neighbours are compared byte by byte at last.
    """
    base = min(base, length)
    n = len(data)
    long_ = np.concatenate([data, np.zeros(length + base, np.uint8)])
    number = np.zeros(n + length, np.uint64)
    for i in range(base):
        number = number << U64(8) | long_[i : i + n + length]
    order = np.argsort(number[:n], kind="stable")
    new = np.r_[True, number[order][1:] != number[order][:-1]]
    lead = np.flatnonzero(new)
    pointer, depth = np.full(n + length, -1), np.full(n + length, length)
    pointer[order] = np.repeat(lead, np.diff(np.r_[lead, n]))
    depth[:n] = base
    begins = np.zeros(n, bool)
    begins[starts] = True
    wanted = np.add.reduceat(begins[order].astype(np.int64), lead) > 0
    size = np.diff(np.r_[lead, n])
    live = lead[wanted & (size > 1)]
    width = size[wanted & (size > 1)]
    cut = np.searchsorted(np.cumsum(width), np.arange(0, width.sum(), batch), "right")
    for a, b in zip(cut, [*cut[1:], len(live)], strict=False):
        if a == b:
            continue
        at = np.repeat(live[a:b] - (np.cumsum(width[a:b]) - width[a:b]), width[a:b]) + np.arange(width[a:b].sum())
        while len(at) and base < length:
            p = order[at]
            to = pointer[p + depth[p]]
            o = np.lexsort((to, pointer[p]))
            p, to = p[o], to[o]
            order[at] = p
            new = np.r_[True, (pointer[p][1:] != pointer[p][:-1]) | (to[1:] != to[:-1])]
            lead = np.flatnonzero(new)
            size = np.diff(np.r_[lead, len(p)])
            deep = depth[p] + depth[p + depth[p]]
            pointer[p], depth[p] = np.repeat(at[lead], size), deep
            at = at[np.repeat(size > 1, size) & (deep < length)]
    s = order[begins[order]]
    same = np.ones(max(0, len(s) - 1), bool)
    for i in [*range(0, length - base + 1, base), length - base]:
        same &= number[s[1:] + i] == number[s[:-1] + i]
    of = np.zeros(n, np.int64)
    of[s] = np.cumsum(np.r_[False, ~same]) if len(s) else 0
    return of[starts]


_SEGMENT = "bucket int, done boolean, keys binary, docs binary, tags binary, starts binary, sizes binary, data binary"
_RANGE = "doc_id long, tag long, start int, stop int"


def tag_of(raw: bytes) -> int:
    return int(hashlib.sha256(raw).hexdigest()[:8], 16)


def text_tag(c: str) -> Column:
    """`tag_of`'s number, as a column."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long")


def _ranges(doc, tag, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(doc, np.int64)), pa.array(np.asarray(tag, np.int64)), pa.array(np.asarray(start, np.int32)), pa.array(np.asarray(stop, np.int32))], ["doc_id", "tag", "start", "stop"])


def later_copies(own: DataFrame) -> DataFrame:
    """(doc_id, tag, start, stop): texts that a document with a smaller doc_id holds as they are; they lose
    all their bytes, and what they share with others that first document shares too."""
    first = own.groupBy("h", "stop").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    return written(own.join(first, ["h", "stop"]).where("doc_id > first").select("doc_id", "tag", F.lit(0).alias("start"), "stop"))


def uncopied(texts: DataFrame, places: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id, text, places) of the texts that have places, less whole copies of earlier ones."""
    whole = copies.groupBy("doc_id").agg(F.collect_set("tag").alias("whole"))
    rows = texts.join(places.join(whole, "doc_id", "left"), "doc_id")
    return rows.where(~F.coalesce(F.array_contains("whole", text_tag("text")), F.lit(False))).select("doc_id", "text", "places")


def hot_keys(texts: DataFrame, documents: int, length: int, gram: int) -> np.ndarray:
    """Sorted keys that meet HOT different runs or more in a sample of the documents: a common line's edges. Which keys are listed
    decides where windows meet, never whether; a million keys at the most are listed."""
    every = max(1, min(documents // SAMPLED, MOST))

    def run(batches):
        for batch in batches:
            for _, off, data in passes(batch.column(0)):
                key, doc, first, last = runs(off, data, length, gram)
                if len(key):
                    a = off[doc] + first
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(span_hash(prefix(data), a, a + last - first + length).view(np.int64))], ["key", "run"])

    part = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").mapInArrow(run, "key long, run long").distinct()
    many = part.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "key").limit(1 << 20)
    return np.sort(np.array([r["key"] for r in many.collect()], np.int64).view(np.uint64))


def covered(docs: DataFrame, length: int = 50, gram: int = 25) -> DataFrame:
    """(doc_id, tag, start, stop): bytes of strings of `length` bytes that also start in a document with a
    smaller doc_id. tag is 32 bits of the text's SHA-256, which tell rows that share a doc_id apart.

    Whole copies of an earlier document are settled at once (`later_copies`) and ship nothing.

    1. Runs of windows are keyed by their least q-gram hash (about one key for 13 bytes); keys held by one
       document alone are dropped without loss. Windows of keys with many contexts are keyed each by itself (`hot_keys`).
    2. The runs that are left travel with their bytes to their key's bucket. Equal runs within a task
       travel once, for the smallest doc_id, and the others are settled where they stand: a passage in a
       third of all documents costs one run for each task.
    3. In a bucket equal runs again are one. Where a key has several, their windows' suffixes are
       bucketed and refined by bucket pointers down to `length` bytes, and each bucket's smallest doc_id
       decides.

    Buckets follow the partitions and the bytes of text, so that a task's share is bounded.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    own = written(texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("h"), text_tag("text").alias("tag"), F.octet_length("text").alias("stop")).where("stop > 0"))
    total = own.agg(F.coalesce(F.sum("stop"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    buckets = max(2 * parallelism(spark), -(-total["bytes"] // BUCKET_BYTES))
    copies = later_copies(own)
    release(own)
    hot = hot_keys(texts, total["n"], length, gram)

    def keys_of(off, data):
        key, doc, first, _ = runs(off, data, length, gram, hot)
        return key, doc, first

    found = repeated_places(texts, keys_of, buckets)
    places = found.groupBy("doc_id").agg(F.collect_set("place").alias("places"))

    def ship(batches):
        seen: dict[bytes, list[tuple]] = {}
        size = 0

        def flush():
            rows: dict[int, list[tuple]] = {}
            settled = []
            for raw, got in seen.items():
                low = min(x[1] for x in got)
                for key, doc, tag, start in got:
                    if doc == low:
                        rows.setdefault((key >> 32) * buckets >> 32, []).append((key, doc, tag, start, raw))
                    else:
                        settled.append((doc, tag, start, start + len(raw)))
            out = [(b, False, *_segments(r)) for b, r in rows.items()]
            for n, a in enumerate(range(0, len(settled), 4096)):
                d, t, s, e = map(np.array, zip(*settled[a : a + 4096], strict=True))
                out.append((int((d[0] + n) % buckets), True, b"", d.astype("<i8").tobytes(), t.astype("<i8").tobytes(), s.astype("<i4").tobytes(), (e - s).astype("<i4").tobytes(), b""))
            kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 6)
            names = [x.split()[0] for x in _SEGMENT.split(", ")]
            for a in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[a : a + 64], strict=True), kinds, strict=True)], names)

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            for a, off, data in passes(batch.column(1)):
                key, doc, first, last = runs(off, data, length, gram, hot)
                raw = data.tobytes()
                cut = np.searchsorted(doc, np.arange(len(off)))
                for i in range(len(off) - 1):
                    s = slice(cut[i], cut[i + 1])
                    wanted = np.flatnonzero(np.isin(first[s], lists[a + i].values.to_numpy()))
                    if not len(wanted):
                        continue
                    d, base = int(ids[a + i]), int(off[i])
                    tag = tag_of(raw[base : off[i + 1]])
                    for k, f, e in zip(key[s][wanted].tolist(), first[s][wanted].tolist(), last[s][wanted].tolist(), strict=True):
                        piece = raw[base + f : base + e + length]
                        seen.setdefault(piece, []).append((k, d, tag, f))
                        size += len(piece) + 350
                if size > 16 << 20:
                    yield from flush()
                    seen.clear()
                    size = 0
        yield from flush()

    def settle(batches):
        held = []
        for batch in batches:
            for r in batch.to_pylist():
                doc, tag, start, size = (np.frombuffer(r[c], k) for c, k in (("docs", "<i8"), ("tags", "<i8"), ("starts", "<i4"), ("sizes", "<i4")))
                if r["done"]:
                    yield _ranges(doc, tag, start, start + size)
                else:
                    raw = np.frombuffer(pa.decompress(r["data"], int(size.sum()), "zstd"), np.uint8)
                    held.append((np.frombuffer(r["keys"], "<u8"), doc, tag, start, size, _each_hash(raw, size), raw))
        if not held:
            return
        key, doc, tag, start, size, own, data = map(np.concatenate, zip(*held, strict=True))
        held.clear()
        begin = np.cumsum(size.astype(np.int64)) - size
        # equal runs are one: the smallest document keeps them for now, the others lose them
        order = np.lexsort((doc, own, size, key))
        new = np.r_[True, (key[order][1:] != key[order][:-1]) | (own[order][1:] != own[order][:-1]) | (size[order][1:] != size[order][:-1])]
        like = np.flatnonzero(~new)
        new[like[differ(data, begin[order[like - 1]], data, begin[order[like]], size[order[like]])]] = True
        group = np.empty(len(key), np.int64)
        group[order] = np.cumsum(new) - 1
        one = order[new]
        low = doc[one]
        lost = np.flatnonzero(doc != low[group])
        for a in range(0, len(lost), 1 << 16):
            i = lost[a : a + (1 << 16)]
            yield _ranges(doc[i], tag[i], start[i], start[i] + size[i])
        # keys with unlike runs: their windows are sorted, a few keys at a time
        k = key[one]
        first = np.r_[True, k[1:] != k[:-1]]
        number = np.cumsum(first) - 1
        unlike = np.flatnonzero(np.bincount(number)[number] > 1)
        keepers = np.flatnonzero(doc == low[group])
        keepers = keepers[np.argsort(group[keepers], kind="stable")]
        cut = np.searchsorted(group[keepers], np.arange(len(one) + 1))
        bytes_ = np.cumsum(size[one[unlike]].astype(np.int64))
        a = 0
        while a < len(unlike):
            b = max(a + 1, int(np.searchsorted(bytes_, (bytes_[a - 1] if a else 0) + (1 << 20))))
            while b < len(unlike) and number[unlike[b]] == number[unlike[b - 1]]:
                b += 1
            part = unlike[a:b]
            yield from _compare(part, one[part], low[part], data, begin, size, length, keepers, cut, doc, tag, start)
            a = b

    found = uncopied(texts, places, copies).mapInArrow(ship, _SEGMENT).repartitionById(buckets, F.col("bucket")).mapInArrow(settle, _RANGE)
    return found.unionByName(copies.where(F.col("stop") >= length))


def _each_hash(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each of the strings that lie end to end in data, about a million bytes at a time."""
    end = np.cumsum(size.astype(np.int64))
    out, a = [np.zeros(0, np.uint64)], 0
    while a < len(size):
        from_ = end[a] - size[a]
        b = max(a + 1, int(np.searchsorted(end, from_ + (1 << 20), "right")))
        sums = prefix(data[from_ : end[b - 1]])
        out.append(span_hash(sums, end[a:b] - size[a:b] - from_, end[a:b] - from_))
        a = b
    return np.concatenate(out)


def _compare(part, one, low, data, begin, size, length, keepers, cut, doc, tag, start):
    """Ranges that runs of `part` lose to one another, by the windows that they share."""
    pieces = [data[begin[i] : begin[i] + size[i]] for i in one]
    joined = np.concatenate(pieces)
    n = size[one].astype(np.int64)
    at = np.cumsum(n) - n
    windows = n - length + 1
    run = np.repeat(np.arange(len(part)), windows)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    bucket = bucket_refine(joined, at[run] + inner, length)
    least = np.full(bucket.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, bucket, low[run])
    gone = np.flatnonzero(least[bucket] < low[run])
    if not len(gone):
        return
    new = np.r_[True, (run[gone][1:] != run[gone][:-1]) | (inner[gone][1:] != inner[gone][:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(gone)] - 1
    run, f, e = run[gone[first]], inner[gone[first]], inner[gone[last]] + length
    many = cut[part[run] + 1] - cut[part[run]]
    who = keepers[np.repeat(cut[part[run]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    yield _ranges(doc[who], tag[who], start[who] + np.repeat(f, many), start[who] + np.repeat(e, many))


def _segments(rows: list[tuple]) -> tuple:
    key, doc, tag, start, raw = zip(*rows, strict=True)
    return (np.array(key, "<u8").tobytes(), np.array(doc, "<i8").tobytes(), np.array(tag, "<i8").tobytes(), np.array(start, "<i4").tobytes(), np.array([len(x) for x in raw], "<i4").tobytes(), pa.compress(b"".join(raw), "zstd", asbytes=True))


def remove_covered(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every document.

    Strings are judged on the input and never cross documents; overlaps count. Rows with equal doc_id
    don't remove from one another. Empty and short texts keep everything."""
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    ranges = covered(docs, length).groupBy("doc_id").agg(F.collect_list(F.struct("tag", "start", "stop")).alias("ranges"))

    def cut(batches):
        for batch in batches:
            rows = []
            ranges = batch.column(2)
            for i, (d, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                raw = (text or "").encode()
                got = ranges[i]
                if got.is_valid:
                    v = got.values
                    tag, start, stop = (v.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                    own = tag == tag_of(raw)
                    mark = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(mark, start[own], 1)
                    np.add.at(mark, stop[own], -1)
                    gone = np.cumsum(mark)[:-1] > 0
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                else:
                    spans, kept = 0, raw
                rows.append((d, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.join(ranges, "doc_id", "left").select("doc_id", "text", "ranges").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_suffix_dedup(spark, sf_dir) -> DataFrame:
    return settled(spark, lambda: remove_covered(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
