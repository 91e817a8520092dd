"""Shared pieces: written tables, vectorised text hashing, packed key search, components.

Conventions of every operator here: a null text is the empty text; a row with a null id takes no
part and is not returned; columns beyond those named are ignored; rows that share an id are judged
row by row unless the operator says otherwise; an empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import math
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one numpy pass holds; a longer document is a pass of its own.
PASS_BYTES = 1 << 19
#: Key entries gathered before they are packed for the shuffle.
FLUSH = 1 << 19


# -- written tables ---------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in local mode with none set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


class _Open(threading.local):
    """The lists of written tables that are to be deleted, innermost last; a thread has its own."""

    def __init__(self):
        self.lists: list[list[str]] = []


_open = _Open()


@contextlib.contextmanager
def _noted():
    """The paths of the tables written inside, as a list that grows."""
    own: list[str] = []
    _open.lists.append(own)
    try:
        yield own
    finally:
        _open.lists.pop()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.own_path = path
    if _open.lists:
        _open.lists[-1].append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.own_path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are deleted at the end: what is to stay must have been written elsewhere."""
    own: list[str] = []
    try:
        with _noted() as own:
            yield
    finally:
        for path in own:
            _delete(spark, path)


def settled(spark: SparkSession, build) -> DataFrame:
    """build()'s rows as one written table, which counts as the caller's. The tables that build() wrote on the way are
    deleted, also when it or the last write fails."""
    own: list[str] = []
    try:
        with _noted() as own:
            result = build()
        return written(result)
    finally:
        for path in own:
            _delete(spark, path)


#: Bytes of text whose keys one task of a search holds, about.
BUCKET_BYTES = 64 << 20


def buckets_for(texts: DataFrame) -> int:
    """Twice the shuffle partitions, and more where that many would hold too much text each."""
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(2 * parallelism(texts.sparkSession), -(-total // BUCKET_BYTES))


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# -- vectorised hashing of UTF-8 text ---------------------------------------------------------

_MULT = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's first n powers and their inverses modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, PASS_BYTES + 4096)
        for name, base in (("up", _MULT), ("down", pow(_MULT, -1, 2**64))):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hash reads the hash of any span of data."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def differ(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the strings of x at a differ from those of y at b, byte by byte, about a million bytes at a time."""
    end = np.cumsum(size.astype(np.int64))
    out, i = np.zeros(len(size), bool), 0
    while i < len(size):
        from_ = end[i] - size[i]
        j = max(i + 1, int(np.searchsorted(end, from_ + (1 << 20), "right")))
        lead = end[i:j] - size[i:j] - from_
        inner = np.arange(end[j - 1] - from_)
        unlike = x[np.repeat(a[i:j] - lead, size[i:j]) + inner] != y[np.repeat(b[i:j] - lead, size[i:j]) + inner]
        at = np.flatnonzero(unlike)
        out[i + np.searchsorted(lead + size[i:j], at, "right")] = True
        i = j
    return out


def passes(col: pa.Array, most: int = PASS_BYTES):
    """(first row, offsets, bytes) of runs of texts, each about `most` bytes at the most."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, off[a : b + 1] - off[a], raw[off[a] : off[b]]
        a = b


def runs(data: np.ndarray, off: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of the maximal runs of the table's bytes within one text, of `least` bytes or more."""
    inside = table[data]
    step = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    inner = np.unique(inner[inside[inner] & inside[inner - 1]])
    start, end = np.sort(np.r_[start, inner]), np.sort(np.r_[end, inner])
    long = end - start >= least
    return start[long], end[long]


def words(data: np.ndarray, off: np.ndarray, lower: bool = True):
    """Hash, document index, first and end byte of each word (a run of bytes but ASCII white space)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = prefix(_LOWER[data] if lower else data)
    return span_hash(sums, start, end), np.searchsorted(off, start, "right") - 1, start, end


def shingles(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of `size` words of one document."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * U64(_MULT) + h[i : i + n]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(total[at]), at


# -- packed search for keys that several documents hold ----------------------------------------

_PACKED = "bucket int, passing boolean, keys binary, docs binary, places binary, known binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("bucket", "passing", "keys", "docs", "places", "known")
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def _planes(x: np.ndarray) -> bytes:
    """Byte planes, which compress better than whole integers."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack(key: np.ndarray, doc: np.ndarray, place: np.ndarray, buckets: int):
    """Rows for the shuffle. A key that several documents of this flush hold is known to repeat: its
    places pass through as they are and one entry stands for them, so a hot key costs each flush one
    entry."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    new = np.r_[True, k[1:] != k[:-1]]
    at = np.flatnonzero(new)
    end = np.r_[at[1:], len(k)] - 1
    many = d[at] != d[end]
    group = np.cumsum(new) - 1
    known = np.zeros(len(k), bool)
    known[order] = many[group]
    stand = np.zeros(len(k), bool)
    stand[order[at[many]]] = True
    bucket = ((key >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    send = np.flatnonzero(~known | stand)
    send = send[np.argsort(bucket[send].astype(np.uint32), kind="stable")]
    rows, lows = [], key[send].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    edges = np.searchsorted(bucket[send], np.arange(buckets + 1))
    for b in np.flatnonzero(edges[1:] > edges[:-1]):
        s = slice(edges[b], edges[b + 1])
        i = send[s]
        rows.append((int(b), False, lows[s].tobytes(), doc[i].astype("<i8").tobytes(), _planes(place[i]), stand[i].tobytes()))
    went = np.flatnonzero(known)
    for n, a in enumerate(range(0, len(went), 4096)):
        i = went[a : a + 4096]
        rows.append((int((int(key[i[0]]) + n) % buckets), True, b"", doc[i].astype("<i8").tobytes(), _planes(place[i]), b""))
    for a in range(0, len(rows), 256):
        yield _rows(rows[a : a + 256])


def repeated_places(docs: DataFrame, keys_of, buckets: int) -> DataFrame:
    """(doc_id, place) of every key that documents with different doc_id hold.

    keys_of(offsets, bytes) gives (key uint64, document index, place) arrays for a run of texts. The
    keys cross the shuffle once, packed as five bytes and a place beside their document. Two unlike
    keys can agree in their five bytes and bucket with odds of about a millionth, which only adds work
    for the exact step that follows. Work and memory of a task follow its share of the keys.
    """
    def emit(batches):
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, off, data in passes(batch.column(1)):
                key, doc, place = keys_of(off, data)
                held.append((key, ids[a + doc], place.astype(np.uint32)))
                n += len(key)
                if n >= FLUSH:
                    yield from _pack(*map(np.concatenate, zip(*held, strict=True)), buckets)
                    held, n = [], 0
        if n:
            yield from _pack(*map(np.concatenate, zip(*held, strict=True)), buckets)

    def find(batches):
        keys, ids, places, known = [], [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                doc, place = np.frombuffer(r["docs"], "<i8"), _unplanes(r["places"])
                if r["passing"]:
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place.astype(np.int32))], ["doc_id", "place"])
                    continue
                low = np.zeros((len(doc), 8), np.uint8)
                low[:, :5] = np.frombuffer(r["keys"], np.uint8).reshape(-1, 5)
                keys.append(low.view("<u8").ravel())
                ids.append(doc)
                places.append(place)
                known.append(np.frombuffer(r["known"], bool))
        if not keys:
            return
        key, doc, place, stand = map(np.concatenate, (keys, ids, places, known))
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        d = doc[order]
        many = (np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)) | np.logical_or.reduceat(stand[order], at)
        keep = np.repeat(many, np.diff(np.r_[at, len(key)]))
        take = order[keep & ~stand[order]]
        for a in range(0, len(take), 1 << 16):
            i = take[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(place[i].astype(np.int32))], ["doc_id", "place"])

    return docs.select("doc_id", "text").mapInArrow(emit, _PACKED).repartitionById(buckets, F.col("bucket")).mapInArrow(find, "doc_id long, place int")


# -- connected components ---------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node that links reach. edges: (a, b), any order, longs.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) until only stars are left: O(log^2)
    rounds, each a minimum by key, which combines before the shuffle, and a join with those minima.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        release(e, least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        release(large, least)
        # stars: each node hangs on one other, and none hangs on a node that hangs itself
        many = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        if e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi").isEmpty() and many.isEmpty():
            break
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    out = written(e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots))
    release(e)
    return out


# -- links between the classes of a banded index ----------------------------------------------


def bitmaps(sets: list[np.ndarray], longs: int) -> pa.ListArray:
    """Each set of hashes as a bitmap of 64 * longs bits, in an array of longs."""
    out = np.zeros((len(sets), 64 * longs), np.uint8)
    for i, s in enumerate(sets):
        out[i, (mix(s) % U64(64 * longs)).astype(np.int64)] = 1
    flat = np.packbits(out, axis=1, bitorder="little").view("<i8").ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * longs), pa.array(flat))


def room(longs: int) -> str:
    """How many of a set's n members its bitmap hides, as they share bits."""
    return "n - (" + " + ".join(f"bit_count(bits[{i}])" for i in range(longs)) + ")"


def may_link(percent: int, longs: int) -> str:
    """Whether sets of n and m members with bitmaps p and q, rooms r and s, can reach the similarity. A bit
    that one bitmap alone has set stands for at least one member that the other set lacks, so the bits in
    both and the smaller room bound the intersection, and this never fails for a link."""
    both = " + ".join(f"bit_count(p[{i}] & q[{i}])" for i in range(longs))
    return f"({both} + least(r, s)) * {100 + percent}L >= (n + m) * {percent}L"


def bands_for(threshold: float, recall: float, keys: int) -> tuple[int, int]:
    """(bands, rows): of the settings that find a pair of similarity `threshold` with odds of at least `recall`
    by at most `keys` bands, the one of most rows, which pairs of less similarity meet least by."""
    found = None
    for rows in range(1, 65):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands > keys:
            break
        found = (bands, rows)
    if found is None:
        raise ValueError(f"{keys} bands can't reach a recall of {recall}")
    return found


def linked(nodes: DataFrame, verify, percent: int, longs: int, rounds: int = 3, few: int = 4096) -> DataFrame:
    """(node, label) of nodes (node long, n int, keys array<long>, bits array<long>) that verified links join.

    Star-shaped candidates bound the pairs: a bucket's members are held against one of them alone, the one
    that meets most others over all its buckets (in a family of near copies, the text they stem from).
    Those links' components settle most buckets. A bucket may still hold several. While one has over `few` members outside
    the first centre's component, a new centre is taken from those, again for a star, `rounds` stars in all at the most. Members
    still outside are then held against all of the bucket's members in other components, so no link between members
    of a bucket is lost and no pair inside a component is made. From the second star on, pairs must pass the sets' bitmaps
    (n members each, `longs` longs in bits), whose bound lets through every link and few others, so that
    families of texts that are alike but never enough make few pairs. verify(pairs) gets (a, b) and
    returns those that are links, of at least `percent`; sizes in a lower ratio can't be links.
    """
    fits = f"least(n, m) * 100L >= greatest(n, m) * {percent}L"
    pair = [F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")]
    every = nodes.select("node", "n", F.explode(F.array_distinct("keys")).alias("key"))
    many = written(every.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"))
    rows = written(every.join(many, "key"))
    score = written(rows.groupBy("node").agg(F.sum("many").alias("score")))
    scored = written(rows.join(score, "node").drop("many"))
    release(many, rows, score)
    best = F.max_by(F.struct("node", "n"), F.struct("score", -F.col("node")))
    hubs = written(scored.groupBy("key").agg(best.alias("hub")).select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("m")))
    live = written(scored.join(hubs, "key"))
    release(scored, hubs)
    tried = written(live.where("node <> hub").where(fits).withColumnRenamed("hub", "x").select(*pair).distinct())
    good = written(verify(tried))
    label = components(good)
    for turn in range(1, rounds + 1):
        # tables are written before they are joined, so that Spark knows the small ones and broadcasts them
        main = label.select(F.col("node").alias("hub"), F.col("label").alias("main"))
        now = live.drop("label", "main").join(label, "node", "left").join(main, "hub", "left")
        now = written(now.select("key", "node", "n", "score", "hub", F.coalesce("label", "node").alias("label"), F.coalesce("main", "hub").alias("main")))
        mixed = written(now.where("label <> main").groupBy("key").agg(F.count("*").alias("apart")))
        most = mixed.agg(F.max("apart")).first()[0]
        release(live)
        if not most:
            release(now, mixed)
            return label
        live = written(now.join(mixed.select("key"), "key", "left_semi"))
        release(now, mixed)
        apart = live.where("label <> main")
        if turn == 1:
            named = written(live.select("node").distinct())
            bits = written(nodes.join(named, "node", "left_semi").select("node", "bits", F.expr(room(longs)).alias("room")))
            release(named)
        if turn < rounds and most > few:
            best = F.max_by(F.struct("node", "n", "label"), F.struct("score", -F.col("node")))
            others = apart.groupBy("key").agg(best.alias("c")).select("key", F.col("c.node").alias("x"), F.col("c.n").alias("m"), F.col("c.label").alias("other"))
        else:
            others = apart.select("key", F.col("node").alias("x"), F.col("n").alias("m"), F.col("label").alias("other"))
        inside = live.select("key", "node", "n", "label").join(bits.select("node", F.col("bits").alias("p"), F.col("room").alias("r")), "node")
        others = others.join(bits.select(F.col("node").alias("x"), F.col("bits").alias("q"), F.col("room").alias("s")), "x")
        pairs = inside.join(others, "key").where("label <> other").where(fits).where(may_link(percent, longs)).select(*pair).distinct()
        star = written(pairs.join(tried, ["a", "b"], "left_anti"))
        more = written(verify(star))
        tried = tried.unionByName(star)
        last = turn == rounds or most <= few
        if more.isEmpty():
            few = most  # further stars would find no more: all that is left is held against all
        else:
            good = good.unionByName(more)
            label = components(good)
        if last:
            release(live, bits)
            return label
    return label
