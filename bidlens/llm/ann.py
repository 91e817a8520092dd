"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, written
from .vectors import SAFE, by_length, distance, finite, first_k, fitting_sample, heads, list_column, ranked

#: Rows that the codebooks are fitted on, and of those the rows that give a first kth distance, at the most.
SAMPLE, PROBES = 8192, 2048
#: Entries, and queries, that one task holds at the most.
BLOCK, PART = 16_384, 8192


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.maximum(0, (x**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * x @ c.T)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[a : a + 4096], c).argmin(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def traverse(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, far: np.ndarray, enough: int) -> list[int]:
    """Cells in order of summed distance until they hold `enough` entries (multi-sequence algorithm): a
    heap holds the pairs of ranks whose neighbours before them have been taken. Cells that are `far`, which
    can't hold a neighbour, are passed over; the walk ends when no other is left."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    la, rb, a, b = left[a].tolist(), right[b].tolist(), a.tolist(), b.tolist()
    enough = min(enough, int(sizes[~far].sum()))
    heap, met, out, got = [(la[0] + rb[0], 0, 0)], {(0, 0)}, [], 0
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * len(rb) + b[j]
        if sizes[cell] and not far[cell]:
            out.append(cell)
            got += int(sizes[cell])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(la) and q < len(rb) and (p, q) not in met:
                met.add((p, q))
                heapq.heappush(heap, (la[p] + rb[q], p, q))
    return out


def visited(d1: np.ndarray, d2: np.ndarray, r1: np.ndarray, r2: np.ndarray, sizes: np.ndarray, kth: float, enough: int) -> np.ndarray:
    """The cells that a query visits. d1, d2: squared distances of its halves to the centroids; r1, r2: the
    cells' radii in either half; kth: the squared distance within which its k nearest surely lie."""
    d1, d2 = np.nan_to_num(d1, nan=np.inf), np.nan_to_num(d2, nan=np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        one = np.maximum(0, np.repeat(np.sqrt(d1), len(d2)) - r1) ** 2
        low = one + np.maximum(0, np.tile(np.sqrt(d2), len(d1)) - r2) ** 2
    return np.array(traverse(d1, d2, sizes, low * (1 - 1e-6) > kth, enough), np.int32)


def bundles(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """A bundle for each cell, neighbouring small cells together, and the blocks that each bundle takes."""
    of, held = np.zeros(len(sizes), np.int64), [0]
    for c, size in enumerate(sizes.tolist()):
        if held[-1] and held[-1] + size > block:
            held.append(0)
        of[c] = len(held) - 1
        held[-1] += size
    return of, np.maximum(1, -(-np.array(held) // block))


def nearest_k(y: np.ndarray, names: np.ndarray, x: np.ndarray, ids: np.ndarray, seen: np.ndarray, k: int):
    """(query row, entry row, score) that hold each query's k nearest ids among the entries it has seen. A
    product of matrices leaves what rounding can't tell apart; those pairs are then measured exactly."""
    rows, cols, out = [], [], []
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
    safe = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) < SAFE
    step = max(1, (1 << 22) // max(1, len(x)))
    n = min(x.shape[1], y.shape[1])
    for a in range(0, len(y), step):
        part = slice(a, a + step)
        able = seen[part] & (names[part][:, None] != ids[None, :])
        if safe:
            size = (y[part] ** 2).sum(1)[:, None] + (x**2).sum(1)[None, :]
            d = size - 2 * y[part, :n] @ x[:, :n].T
            high = np.where(able, d + 1e-11 * size, np.inf)[:, order]
            high = np.minimum.reduceat(high, first, axis=1)
            if high.shape[1] > k:
                able &= d - 1e-11 * size <= np.partition(high, k - 1, axis=1)[:, k - 1][:, None]
        r, c = np.nonzero(able)
        for b in range(0, len(r), 1 << 14):
            out.append(distance(y[a + r[b : b + (1 << 14)]], x[c[b : b + (1 << 14)]]))
        rows.append(a + r)
        cols.append(c)
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    r, c, d = np.concatenate(rows), np.concatenate(cols), np.concatenate(out) if out else np.zeros(0)
    best = first_k(r, ids[c], d, k)
    return r[best], c[best], d[best]


def search(rows: DataFrame, every: int = 100, k: int = 10, codes: int = 128, share: float = 0.45) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by Euclidean distance, ties to smaller vec_id.

    Codebooks of the two halves are fitted on a bounded sample (SAMPLE rows of smallest hash); every row
    is indexed. A query visits cells in order of summed distance until they hold `share` of all entries (20 k at
    least). Cells that provably hold none of its k nearest (farther, less their radii, than its kth among PROBES sampled
    rows) are passed over: clustered vectors visit far fewer; vectors without clusters, like the test tables',
    take that share for a recall over 0.9. Entries meet queries in groups of (bundle of small cells or block of a
    large one, part of the queries), each of bounded size. The cells' sizes and radii, at most codes**2 rows,
    are all that the driver holds besides. Vectors take any length and any finite value (see `vectors`); the codebooks see
    the commonest sampled length, the distances see all. A distance beyond the doubles is infinite.
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    good = finite(rows, zero=False)
    sid, sample = fitting_sample(good, SAMPLE)
    if not len(sid):
        return spark.createDataFrame([], schema)
    dim = int(np.bincount([len(v) for v in sample]).argmax())
    head, _ = heads(list_column(np.concatenate(sample), np.array([len(v) for v in sample])), dim)
    half, head = dim // 2, np.clip(head, -SAFE, SAFE)
    c1, c2 = kmeans(head[:, :half], codes), kmeans(head[:, half:], codes)
    probe, probe_ids = head[:PROBES], sid[:PROBES]
    whole = np.array([len(v) <= dim and np.abs(v).max() < SAFE for v in sample[:PROBES]])
    probe, probe_ids = probe[whole], probe_ids[whole]  # vectors that their heads hold wholly

    def assign(batches):
        for b in batches:
            v, _ = heads(b.column(1), dim)
            a1, a2 = nearest(v[:, :half], c1), nearest(v[:, half:], c2)
            r1, r2 = distance(v[:, :half], c1[a1]), distance(v[:, half:], c2[a2])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((a1 * len(c2) + a2).astype(np.int32)), pa.array(r1), pa.array(r2)], ["vec_id", "vector", "cell", "r1", "r2"])

    entries = written(good.mapInArrow(assign, "vec_id long, vector array<double>, cell int, r1 double, r2 double"))
    sizes, r1, r2 = (np.zeros(len(c1) * len(c2)) for _ in range(3))
    asks = 0
    ask = F.pmod("vec_id", F.lit(every)) == 0
    for r in entries.groupBy("cell").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2"), F.sum(ask.cast("long")).alias("asks")).collect():  # at most codes**2 rows
        sizes[r["cell"]], r1[r["cell"]], r2[r["cell"]] = r["n"], r["r1"], r["r2"]
        asks += r["asks"]
    sizes = sizes.astype(np.int64)
    enough = max(20 * k, int(np.ceil(share * sizes.sum())))
    block = min(BLOCK, max(1024, int(sizes.sum()) // (2 * parallelism(spark))))
    of, blocks = bundles(sizes, block)
    parts = max(1, -(-asks // PART))

    def place(batches):
        n = 0
        for b in batches:
            bundle = of[b.column(2).to_numpy()]
            at = (n + np.arange(len(bundle))) % blocks[bundle]
            n += len(bundle)
            for p in range(parts):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(bundle.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), p, np.int32))], ["vec_id", "vector", "cell", "bundle", "block", "part"])

    def route(batches):
        turn = 0
        for b in batches:
            names = b.column(0).to_numpy()
            v, rest = heads(b.column(1), dim)
            d1, d2 = distances(v[:, :half], c1), distances(v[:, half:], c2)
            bound = np.full(len(v), np.inf)
            if len(probe_ids) > k:
                size = (v**2).sum(1)[:, None] + (probe**2).sum(1)[None, :] + (rest**2)[:, None]
                d = np.where(names[:, None] == probe_ids[None, :], np.inf, size - 2 * v @ probe.T + 1e-11 * size)
                bound = np.partition(d, k - 1, axis=1)[:, k - 1]
            for i in range(len(names)):
                cells = visited(d1[i], d2[i], r1, r2, sizes, bound[i], enough)
                cells = cells[np.argsort(of[cells], kind="stable")]
                to, at = np.unique(of[cells], return_index=True)
                own = np.split(cells, at[1:])
                n = blocks[to]
                pick = np.repeat(np.arange(len(to)), n)
                count = len(pick)
                if count:
                    vector = b.column(1).slice(i, 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(count, names[i])), vector.take(pa.array(np.zeros(count, np.int32))), pa.array([own[j].tobytes() for j in pick], pa.binary()), pa.array(to[pick].astype(np.int32)), pa.array((np.arange(count) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)), pa.array(np.full(count, turn % parts, np.int32))], ["query_id", "vector", "cells", "bundle", "block", "part"])
                turn += 1

    placed = entries.select("vec_id", "vector", "cell").mapInArrow(place, "vec_id long, vector array<double>, cell int, bundle int, block int, part int")
    asked = entries.where(ask).select("vec_id", "vector").mapInArrow(route, "query_id long, vector array<double>, cells binary, bundle int, block int, part int")

    def rerank(e: pa.Table, q: pa.Table) -> pa.Table:
        found = []
        if len(e) and len(q):
            ids, names, cell = e["vec_id"].to_numpy(), q["query_id"].to_numpy(), e["cell"].to_numpy()
            want = [np.frombuffer(c, np.int32) for c in q["cells"].to_pylist()]
            for i, y in by_length(q["vector"]):
                for j, x in by_length(e["vector"]):
                    seen = np.array([np.isin(cell[j], want[n]) for n in i])
                    r, c, d = nearest_k(y, names[i], x, ids[j], seen, k)
                    found.append((names[i][r], ids[j][c], d))
        name, vec, score = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": name, "vec_id": vec, "score": score})

    key = ["bundle", "block", "part"]
    found = placed.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    return ranked(found, k, F.min("score"), F.col("score").asc())


def op2_multi_index(spark, sf_dir) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
