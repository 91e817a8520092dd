"""Filter interaction audit: what each filter removes in every order, from sorted posting lists of failing documents."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, written

#: Documents of one stretch of ids, whose lists a task holds at once.
STRETCH = 1 << 16
#: Places that a merge looks ahead in each list.
AHEAD = 4096
LETTERS = "ABCDE"
POSTINGS = "part string, first_id long, last_id long, docs int, lists array<array<int>>"
SIZES = "part string, docs long, before int, filter int, removed long, good long, toxic long"


# -- judging ----------------------------------------------------------------------------------


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, fails (bit i for the i-th of the five filters), good and toxic, of each row of docs that has an id.

    A: under 100 words; B: under 80 distinct words in 100; C: over 10 capitals A-Z in 100 code points; D: one of
    `#$%&*|`; E: a smaller doc_id has this text. A null text is empty and a null lang the part ''. Rows that
    share a doc_id are judged each for itself (and are no copies of one another). A document labelled more than once
    is good or toxic if any label says so. Equal texts are told by SHA-256 and length; the least doc_id of a
    text is aggregated before the shuffle and joined back by doc_id, so that a text that a third of all
    rows share is no hot key."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+", -1), "")
    d = docs.where("doc_id is not null").select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    failing = [
        F.size("words") < 100,
        F.size(F.array_distinct("words")) * 100 < F.size("words") * 80,
        F.length(F.regexp_replace("text", "[^A-Z]+", "")) * 100 > F.length("text") * 10,
        F.col("text").rlike("[#$%&*|]"),
    ]
    fails = sum((f.cast("int") * (1 << i) for i, f in enumerate(failing)), F.lit(0))
    d = written(d.select("doc_id", "part", fails.alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("size")))
    first = d.groupBy("digest", "size").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    d = d.join(first, ["doc_id", "digest", "size"], "left").join(known, "doc_id", "left")
    copy = F.when(F.col("first").isNull(), 1 << 4).otherwise(0)
    return d.select("doc_id", "part", (F.col("fails") + copy).alias("fails"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


# -- posting lists ----------------------------------------------------------------------------


def postings(judged: DataFrame, filters: int = len(LETTERS), stretch: int = STRETCH) -> DataFrame:
    """The lists of each part, a row for a stretch of at most `stretch` documents: first and last id, how many documents,
    and ascending lists of the places (by id, from 0) of those that fail each filter, of the good and of the toxic ones.
    Rows that share an id have places of their own. Stretches are cut from rows dealt by ranges of (part, id), so that a part
    that holds most rows is spread like any other."""

    def cut(batches):
        held = None

        def emit(rows):
            ids, fails, marks = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("doc_id", "fails", "marks"))
            bits = fails.astype(np.int64) | marks.astype(np.int64) << filters
            lists = [np.flatnonzero(bits >> i & 1).astype(np.int32) for i in range(filters + 2)]
            ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
            inner = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists), pa.int32()))
            outer = pa.ListArray.from_arrays(pa.array([0, filters + 2], pa.int32()), inner)
            return pa.RecordBatch.from_arrays([rows.column("part").slice(0, 1).combine_chunks(), pa.array(ids[:1]), pa.array(ids[-1:]), pa.array([len(ids)], pa.int32()), outer], ["part", "first_id", "last_id", "docs", "lists"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            part = table.column("part").combine_chunks()
            edge = np.flatnonzero(np.r_[True, np.asarray(pc.not_equal(part.slice(1), part.slice(0, len(part) - 1)).to_numpy(zero_copy_only=False), bool)]) if len(part) else []
            for a, b in zip(edge, [*edge[1:], len(part)], strict=True):
                rows = table.slice(a, b - a)
                if held is not None and held.column("part")[0] != rows.column("part")[0]:
                    yield emit(held)
                    held = None
                rows = rows if held is None else pa.concat_tables([held, rows])
                while len(rows) >= stretch:
                    yield emit(rows.slice(0, stretch))
                    rows = rows.slice(stretch)
                held = rows if len(rows) else None
        if held is not None:
            yield emit(held)

    marks = F.col("good").cast("int") + F.col("toxic").cast("int") * 2
    rows = judged.select("part", "doc_id", F.col("fails").cast("int").alias("fails"), marks.alias("marks"))
    return rows.repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id").mapInArrow(cut, POSTINGS)


def gallop(a: np.ndarray, at: int, key: int) -> int:
    """The first place of ascending a, from `at` on, whose value is above key: steps double until one overshoots, and
    the last step is bisected."""
    step, n = 1, len(a)
    while at + step < n and a[at + step] <= key:
        at += step
        step *= 2
    return at + int(np.searchsorted(a[at : at + step + 1], key, "right"))


def merge(lists: list[np.ndarray], ahead: int = AHEAD):
    """(values, bits) of consecutive stretches of the union of ascending lists: bit i is set for a value of list i. A
    stretch ends at the least of the values that the lists have `ahead` places on; each list gallops there."""
    at = [0] * len(lists)
    while True:
        ends = [a[min(p + ahead, len(a)) - 1] for a, p in zip(lists, at, strict=True) if p < len(a)]
        if not ends:
            return
        to = min(ends)
        cut = [gallop(a, p, to) if p < len(a) else p for a, p in zip(lists, at, strict=True)]
        here = [a[p:q] for a, p, q in zip(lists, at, cut, strict=True)]
        values = np.unique(np.concatenate(here))
        bits = np.zeros(len(values), np.int64)
        for i, part in enumerate(here):
            bits[np.searchsorted(values, part)] |= 1 << i
        at = cut
        yield values, bits


def set_sizes(lists: list[np.ndarray], filters: int, ahead: int = AHEAD) -> np.ndarray:
    """[before, filter] -> sizes of: the filter's list less the union of the lists in the set `before`; that, good; that, toxic."""
    out = np.zeros((1 << filters, filters, 3), np.int64)
    every, marks = np.arange(1 << filters), (1 << filters) - 1
    for _, bits in merge(lists, ahead):
        n = np.bincount(bits, minlength=1 << (filters + 2))
        kinds = np.flatnonzero(n)
        outside = (every[:, None] & kinds[None, :] & marks) == 0  # [before, kind]
        for f in range(filters):
            fails = (kinds >> f & 1) * n[kinds]
            for j, which in enumerate((np.ones(len(kinds), int), kinds >> filters & 1, kinds >> (filters + 1) & 1)):
                out[:, f, j] += outside @ (fails * which)
    return out


# -- the audit --------------------------------------------------------------------------------


def interactions(lists: DataFrame, filters: int = len(LETTERS)) -> DataFrame:
    """part, docs, before (set of filters, as bits), filter, and how many documents (and good, and toxic ones) the filter removes
    after that set, for every set without it; parts whose documents all pass have zeros."""

    def sizes(batches):
        total: dict[str, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                part, inner = batch.column(0)[i].as_py(), batch.column(4)[i].values
                got = set_sizes([x.values.to_numpy(zero_copy_only=False) for x in inner], filters)
                seen = total.setdefault(part, [0, np.zeros_like(got)])
                seen[0] += batch.column(3)[i].as_py()
                seen[1] += got
            if len(total) > 256:
                yield from rows(total)
                total = {}
        yield from rows(total)

    def rows(total):
        for part, (docs, got) in total.items():
            before, f = np.array([(b, f) for b in range(1 << filters) for f in range(filters) if not b >> f & 1]).T
            cols = [got[before, f, j] for j in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(f), pa.string()), pa.array([docs] * len(f), pa.int64()), pa.array(before, pa.int32()), pa.array(f, pa.int32()), *map(pa.array, cols)], ["part", "docs", "before", "filter", "removed", "good", "toxic"])

    sums = [F.sum(c).alias(c) for c in ("docs", "removed", "good", "toxic")]
    return lists.mapInArrow(sizes, SIZES).groupBy("part", "before", "filter").agg(*sums)


def orders(found: DataFrame, names: str = LETTERS) -> DataFrame:
    """A row for each part, order of the filters and step; the orders (n! times n rows) are a parameter's table."""
    steps = [("".join(names[i] for i in p), s + 1, sum(1 << i for i in p[:s]), p[s]) for p in permutations(range(len(names))) for s in range(len(names))]
    table = found.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int")
    own, along = Window.partitionBy("part", "filter"), Window.partitionBy("part", "filter_order").orderBy("step")
    alone = F.expr(f"{(1 << len(names)) - 1} - shiftleft(1, filter)")
    r = found.join(table, ["before", "filter"])
    return r.select(
        "part",
        "filter_order",
        "step",
        (F.col("docs") - F.sum("removed").over(along)).alias("kept"),
        "removed",
        (F.max(F.when(F.col("before") == 0, F.col("removed"))).over(own) - F.col("removed")).alias("redundant"),
        F.max(F.when(F.col("before") == alone, F.col("removed"))).over(own).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("removed").over(own).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters of `judge` in all 120 orders, by part. An empty table gives no row."""
    return settled(docs.sparkSession, lambda: orders(interactions(postings(written(judge(docs, labels))))))


def op12_filter_audit(spark, sf_dir) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 100)::INT + 2 * (100 * list_unique(w) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (min(doc_id) OVER (PARTITION BY t) < doc_id)::INT AS m FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, good, toxic, m, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(range(5)) AS i),
p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT list_aggregate(list_transform(o, lambda k: substr('ABCDE', k + 1, 1)), 'string_agg', '') AS filter_order, CAST(step AS INT) AS step, o[step] AS k, CAST(1 << o[step] AS INT) AS own,
  CAST(coalesce(list_sum(list_transform(o[1:step - 1], lambda k: 1 << k)), 0) AS INT) AS before FROM p, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, k, CAST(sum(n) FILTER (WHERE m & (before | own) = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (WHERE m & own > 0 AND m & before = 0) AS BIGINT) AS removed,
  CAST(sum(n) FILTER (WHERE m & own > 0 AND m & before > 0) AS BIGINT) AS redundant, CAST(sum(n) FILTER (WHERE m = own) AS BIGINT) AS unique_fails,
  CAST(sum(n) FILTER (WHERE m & own > 0 AND m & before = 0 AND good) AS BIGINT) AS good_lost, CAST(sum(n) FILTER (WHERE m & own > 0 AND m & before = 0 AND toxic) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost,
  coalesce(toxic_lost, 0) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM r
"""
