"""Ranked lexical search: bit-sliced Bloom signatures bound every document's score, and what they can't exclude is scored exactly."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import differ, mix, passes, prefix, runs, settled, span_hash, written

U64 = np.uint64
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: A document has an entry for each term and each of these numbers of occurrences that the term reaches in it.
LEVELS = (1, 2, 3, 5, 9)
#: Bits a signature has for each entry, and how many of them an entry sets.
BITS_PER_ENTRY, HASHES = 16, 5
#: Bits of the longest signature: that of a text with more entries is fuller, so it is scored exactly more often.
WIDEST = 1 << 22
#: Bits of a block of signatures, about.
BLOCK_BITS = 1 << 22
#: Entries, and documents, that an indexing task gathers before it cuts blocks, and terms before it adds them up.
GATHERED, GATHERED_DOCS, GATHERED_TERMS = 1 << 21, 1 << 13, 1 << 20
#: Items, and terms over all items, of one block of queries.
QUERY_ITEMS, QUERY_TERMS = 1024, 1 << 18
#: How many times k documents of an item are scored for its first kth score.
SEEDS = 3
#: Terms whose slices a task unfolds at once.
TERMS_AT_ONCE = 2048
INDEX = "term string, df long, width int, ids binary, sizes binary, peaks binary, slices binary"


# -- the index --------------------------------------------------------------------------------


def terms(data: np.ndarray, off: np.ndarray):
    """Lower-cased bytes, and hash, document index, first and end byte of each term."""
    low = _FOLD[data]
    start, end = runs(low, off, _IN_TERM, 1)
    h = span_hash(prefix(low), start, end) if len(start) else np.zeros(0, np.uint64)
    return low, h, np.searchsorted(off, start, "right") - 1, start, end


def counted(h: np.ndarray, doc: np.ndarray):
    """(place of one occurrence, occurrences) of each different term of each document, documents in order."""
    order = np.lexsort((h, doc))
    new = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])]) if len(h) else np.zeros(0, np.int64)
    return order[new], np.diff(np.r_[new, len(h)])


def slots(h: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    """What the bits of an entry are stepped from: bit i of a signature of w bits (a power of two) is (a + i * b) mod w."""
    x = mix(h + np.asarray(level).astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    return (x & U64(0xFFFFFFFF)).astype(np.int64), (x >> U64(32)).astype(np.int64) | 1


def strings(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    ends = np.r_[0, np.cumsum(size)]
    raw = low[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw.tobytes()))


def width_for(entries: int) -> int:
    return min(WIDEST, max(64, 1 << math.ceil(math.log2(BITS_PER_ENTRY * max(1, entries)))))


def cut_blocks(ids, sizes, peaks, counts, hashes, levels):
    """Blocks of documents of about as many entries each, so that one width suits all: ids, terms, most occurrences of a term, and a bitmap of
    the documents for each bit of the signatures. counts are entries of each document, which follow one another in hashes and levels."""
    begin = np.r_[0, np.cumsum(counts)[:-1]]
    order, i = np.argsort(counts, kind="stable")[::-1], 0
    while i < len(order):
        width = width_for(int(counts[order[i]]))
        j = i
        most = max(8, BLOCK_BITS // width)
        while j < len(order) and j - i < most and width_for(int(counts[order[j]])) == width:
            j += 1
        d = order[i:j]
        at = np.repeat(begin[d] - np.r_[0, np.cumsum(counts[d])[:-1]], counts[d]) + np.arange(counts[d].sum())
        column = np.repeat(np.arange(len(d)), counts[d])
        bits = np.zeros((width, -(-len(d) // 8) * 8), np.uint8)
        a, b = slots(hashes[at], levels[at])
        for k in range(HASHES):
            bits[(a + k * b) & (width - 1), column] = 1
        yield width, ids[d].astype("<i8").tobytes(), sizes[d].astype("<i8").tobytes(), peaks[d].astype("<i4").tobytes(), np.packbits(bits, axis=1, bitorder="little").tobytes()
        i = j


def index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lexicon, blocks) of docs (doc_id, text), two views of one written table.

    lexicon: term, df. blocks: ids, sizes (terms with repeats), peaks (most occurrences of one term) and bit slices of a
    block's documents. Rows without an id or a term are left out; rows that share an id are documents each. Equal terms of
    one document are told by 64-bit hashes. Texts are read whole and once."""

    def build(batches):
        tables, rows, held, n, m = [], 0, [], 0, 0

        def summed():
            t = pa.concat_tables(tables).group_by("term").aggregate([("df", "sum")])
            return pa.table({"term": t.column("term"), "df": t.column("df_sum")})

        def words(t):
            for batch in t.combine_chunks().to_batches(max_chunksize=1 << 16):
                none = [pa.nulls(batch.num_rows, pa.int32()), *[pa.nulls(batch.num_rows, pa.binary())] * 4]
                yield pa.RecordBatch.from_arrays([batch.column("term").cast(pa.string()), batch.column("df"), *none], INDEX_NAMES)

        def blocks():
            for width, *parts in cut_blocks(*map(np.concatenate, zip(*held, strict=True))):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([width], pa.int32()), *[pa.array([p], pa.binary()) for p in parts]], INDEX_NAMES)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, off, data in passes(batch.column(1)):
                low, h, doc, start, end = terms(data, off)
                if not len(h):
                    continue
                one, tf = counted(h, doc)
                _, pick, df = np.unique(h[one], return_index=True, return_counts=True)
                tables.append(pa.table({"term": strings(low, start[one[pick]], end[one[pick]]), "df": pa.array(df.astype(np.int64))}))
                rows += len(df)
                if rows > GATHERED_TERMS:
                    t = summed()
                    if len(t) > GATHERED_TERMS // 2:
                        yield from words(t)
                        tables, rows = [], 0
                    else:
                        tables, rows = [t], len(t)
                level = np.searchsorted(LEVELS, tf, "right")
                named, edge = np.unique(doc[one], return_index=True)
                counts = np.add.reduceat(level, edge)
                lead = np.cumsum(level) - level
                held.append((ids[first + named], np.bincount(doc, minlength=len(off) - 1)[named], np.maximum.reduceat(tf, edge), counts, np.repeat(h[one], level), np.arange(level.sum()) - np.repeat(lead, level)))
                n, m = n + int(counts.sum()), m + len(named)
                if n > GATHERED or m > GATHERED_DOCS:
                    yield from blocks()
                    held, n, m = [], 0, 0
        if held:
            yield from blocks()
        if tables:
            yield from words(summed())

    made = written(docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, INDEX))
    lexicon = made.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    return lexicon, made.where("width is not null").select("width", "ids", "sizes", "peaks", "slices")


INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def totals(blocks: DataFrame) -> tuple[int, int]:
    """Documents with a term, and their terms with repeats."""

    def add(batches):
        n = size = 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n, size = n + len(x) // 8, size + int(np.frombuffer(x, "<i8").sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([size])], ["n", "size"])

    r = blocks.select("sizes").mapInArrow(add, "n long, size long").agg(F.sum("n"), F.sum("size")).first()
    return r[0] or 0, r[1] or 0


# -- queries ----------------------------------------------------------------------------------


def items_of(queries: DataFrame, lexicon: DataFrame, n: int) -> DataFrame:
    """item_id, and its terms with their weights above 0, from queries (item_id, text); rows that share an item_id are one item,
    rows without one none. Terms that no document holds are left out."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    asked = queries.where("item_id is not null").select("item_id", F.explode(found).alias("term")).distinct()
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * n + 2) / (F.col("df") * 2 + 1).cast("double"))).cast("long")
    return asked.join(lexicon, "term").select("item_id", "term", weight.alias("w")).where("w > 0").groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("terms"))


class Block:
    """A bounded block of queries as arrays: ids of the items; each one's terms as places in `hashes` (ascending) and `raw`, with weights."""

    def __init__(self, rows: list, n: int, total: int):
        self.n, self.total = n, total
        self.ids = np.array([r["item_id"] for r in rows], np.int64)
        names = sorted({t["term"] for r in rows for t in r["terms"]})
        raw = [x.encode() for x in names]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        end = np.cumsum([len(x) for x in raw])
        start = end - [len(x) for x in raw]
        h = span_hash(prefix(flat), start, end)
        order = np.argsort(h, kind="stable")
        self.raw, self.start, self.size, self.hashes = flat, start[order], (end - start)[order], h[order]
        place = {names[i]: p for p, i in enumerate(order.tolist())}
        self.own = [np.array([place[t["term"]] for t in r["terms"]]) for r in rows]
        self.w = [np.array([t["w"] for t in r["terms"]], np.int64) for r in rows]

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        """8 * m of documents of so many terms."""
        return np.array([8 * (10 + 90 * s * self.n // self.total) for s in sizes.tolist()], np.int64)

    def bounds(self, width: int, sizes: np.ndarray, peaks: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """[item, document] -> a score that the document can't exceed. Each level that a term's bits show adds what the level's most
        occurrences give over the level before; a term that shows no bits adds nothing, as it isn't there."""
        norm = self.lengths(sizes)
        reach = np.array([*(x - 1 for x in LEVELS[1:]), 0])[:, None]
        reach = np.where(reach == 0, peaks[None, :], np.minimum(reach, peaks[None, :])).astype(np.int64)
        worth = 1_000_000_000 * reach // (1000 * reach + norm[None, :])
        gain = np.maximum(np.diff(worth, axis=0, prepend=0), 0)
        # sums below 2**53 are exact in doubles, for which products are fast
        kind = np.float64 if max((int(w.sum()) for w in self.w), default=0) < 9_000_000_000 else np.int64
        out = np.zeros((len(self.ids), len(sizes)), kind)
        for a in range(0, len(self.hashes), TERMS_AT_ONCE):
            h = self.hashes[a : a + TERMS_AT_ONCE]
            value = np.zeros((len(h), len(sizes)), kind)
            for level in range(len(LEVELS)):
                x, step = slots(h, level)
                hit = slices[x & (width - 1)]
                for k in range(1, HASHES):
                    hit &= slices[(x + k * step) & (width - 1)]
                some = np.flatnonzero(hit.any(1))
                if not len(some):
                    break
                value[some] += np.unpackbits(hit[some], axis=1, bitorder="little", count=len(sizes)) * gain[level]
            live = value.any(1)
            for i, (own, w) in enumerate(zip(self.own, self.w, strict=True)):
                here = np.flatnonzero((own >= a) & (own < a + len(h)))
                here = here[live[own[here] - a]]
                if len(here):
                    out[i] += w[here].astype(kind) @ value[own[here] - a]
        return out.astype(np.int64)

    def scores(self, data: np.ndarray, off: np.ndarray, wanted: list[np.ndarray]):
        """(document index, item place, score) of the wanted items of each text; a term counts if its bytes agree."""
        low, h, doc, start, end = terms(data, off)
        sizes = np.bincount(doc, minlength=len(off) - 1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        t = np.flatnonzero((self.hashes[at] == h) & (self.size[at] == end - start))
        t = t[~differ(low, start[t], self.raw, self.start[at[t]], self.size[at[t]])]
        pair, tf = np.unique(doc[t] * len(self.hashes) + at[t], return_counts=True)
        d, term = pair // len(self.hashes), pair % len(self.hashes)
        worth = 1_000_000_000 * tf // (1000 * tf + self.lengths(sizes)[d])
        edge = np.searchsorted(d, np.arange(len(off)))
        values = np.zeros(len(self.hashes), np.int64)
        for i, items in enumerate(wanted):
            s = slice(edge[i], edge[i + 1])
            values[term[s]] = worth[s]
            for item in items.tolist():
                yield i, item, int(self.w[item] @ values[self.own[item]])
            values[term[s]] = 0


def query_blocks(items: DataFrame, n: int, total: int, most_items: int, most_terms: int):
    """Blocks of at most so many items and terms (or one item of more), read from the items' partitions in turn."""
    rows, size = [], 0
    for r in items.toLocalIterator():
        if rows and (len(rows) == most_items or size + len(r["terms"]) > most_terms):
            yield Block(rows, n, total)
            rows, size = [], 0
        rows.append(r)
        size += len(r["terms"])
    if rows:
        yield Block(rows, n, total)


# -- the search -------------------------------------------------------------------------------


BOUNDS = "item int, doc_id long, bound long"


def _bounds(batches, block: Block):
    """(bounds, ids) of each block of signatures."""
    for batch in batches:
        for r in batch.to_pylist():
            ids, sizes, peaks = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["sizes"], "<i8"), np.frombuffer(r["peaks"], "<i4")
            yield block.bounds(r["width"], sizes, peaks, np.frombuffer(r["slices"], np.uint8).reshape(r["width"], -1)), ids


def _chosen(item: np.ndarray, doc: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(doc.astype(np.int64)), pa.array(bound.astype(np.int64))], ["item", "doc_id", "bound"])


def seeds(blocks: DataFrame, block: Block, k: int) -> DataFrame:
    """The k documents of highest bound of each item, of each task."""

    def look(batches):
        best = docs = np.zeros((len(block.ids), 0), np.int64)
        for bounds, ids in _bounds(batches, block):
            best, docs = np.hstack([best, bounds]), np.hstack([docs, np.broadcast_to(ids, bounds.shape)])
            if best.shape[1] > k:
                top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                best, docs = np.take_along_axis(best, top, 1), np.take_along_axis(docs, top, 1)
        item, place = np.nonzero(best)
        yield _chosen(item, docs[item, place], best[item, place])

    return blocks.mapInArrow(look, BOUNDS)


def candidates(blocks: DataFrame, block: Block, least: np.ndarray, last: np.ndarray) -> DataFrame:
    """All (item, document) whose bound is above the item's kth score so far, or equals it at no larger doc_id."""

    def look(batches):
        for bounds, ids in _bounds(batches, block):
            item, d = np.nonzero((bounds > least[:, None]) | ((bounds == least[:, None]) & (bounds > 0) & (ids[None, :] <= last[:, None])))
            yield _chosen(item, ids[d], bounds[item, d])

    return blocks.mapInArrow(look, BOUNDS)


def scored(docs: DataFrame, pairs: DataFrame, block: Block) -> DataFrame:
    """(item, doc_id, score above 0) of the pairs (item, doc_id), from the documents' whole texts."""

    def score(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            offsets, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(zero_copy_only=False)
            for first, off, data in passes(batch.column(1)):
                wanted = [flat[offsets[first + i] : offsets[first + i + 1]] for i in range(len(off) - 1)]
                got = np.array([x for x in block.scores(data, off, wanted) if x[2] > 0], np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 1].astype(np.int32)), pa.array(ids[first + got[:, 0]]), pa.array(got[:, 2])], ["item", "doc_id", "score"])

    wanted = written(pairs.groupBy("doc_id").agg(F.collect_set("item").alias("items")))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(wanted, "doc_id").select("doc_id", "text", "items").mapInArrow(score, "item int, doc_id long, score long")


def top(scores: DataFrame, k: int) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, most_items: int = QUERY_ITEMS, most_terms: int = QUERY_TERMS, built=None) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 of each item of queries (item_id, text), ties to the
    smaller doc_id. `built` is index(docs), if it stands already.

    Items come in blocks of a bounded size, which travel with the tasks. For each block the index is read twice: for the
    highest bounds (three times k an item), whose documents' exact scores give each item a score to beat, and for all documents whose bounds don't rule
    them out; those are scored on their whole texts. No document is dropped otherwise, so the result is exact however full the
    signatures are. Null and empty texts have no terms; items and documents without terms, or without an id, have no rows."""
    return settled(docs.sparkSession, lambda: _search(docs, queries, k, most_items, most_terms, *(built or index(docs))))


def _search(docs, queries, k, most_items, most_terms, lexicon, blocks) -> DataFrame:
    n, total = totals(blocks)
    out = None
    items = written(items_of(queries, lexicon, n))
    for block in query_blocks(items, n, total, most_items, most_terms):
        first = top(seeds(blocks, block, SEEDS * k).withColumnRenamed("bound", "score"), SEEDS * k)
        found = top(scored(docs, first.select("item", "doc_id"), block), k)
        worst = F.min_by(F.struct("score", "doc_id"), F.struct("score", -F.col("doc_id"))).alias("r")
        least, last = np.zeros(len(block.ids), np.int64), np.full(len(block.ids), np.iinfo(np.int64).max)
        for r in found.groupBy("item").agg(F.count("*").alias("n"), worst).where(F.col("n") >= k).collect():  # a row an item of the block
            least[r["item"]], last[r["item"]] = r["r"]["score"], r["r"]["doc_id"]
        best = top(scored(docs, candidates(blocks, block, least, last).select("item", "doc_id"), block), k)
        names = docs.sparkSession.createDataFrame(pa.table({"item": pa.array(np.arange(len(block.ids)), pa.int32()), "item_id": pa.array(block.ids)}))
        part = written(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # at most `most_items` names
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_lexical_search(spark, sf_dir) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents WHERE doc_id IS NOT NULL),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY 1),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM s),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, a GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark WHERE item_id IS NOT NULL)),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN s USING (doc_id), a GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
