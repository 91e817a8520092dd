"""Exact top-k search by inner product: cover trees over queries and over data, descended together."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import nearest
from .common import parallelism, written
from .vectors import SAFE, by_length, distance, finite, first_k, fitting_sample, heads, list_column, ranked

#: Rows that the top cells and the first bounds are taken from, at the most, and top cells.
SAMPLE, CELLS = 2048, 256
#: Rows, and queries, that one task holds at the most.
BLOCK, PART = 4096, 4096
#: A node of so few rows is a leaf; by what a node's radius shrinks from level to level.
LEAF, BASE = 16, 1.3
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as doubles, which hold it exactly unless it is infinite."""
    with np.errstate(over="ignore"):
        return np.floor(x * 256.0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of floor(256 * x) of the rows of a and b, exactly: by doubles while no sum can pass
    2**53, by 64-bit integers below 2**63, else by whole numbers of any size. What a long can't hold is
    the nearest that it can, but for the lowest."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    y, x = scaled(a), scaled(b)
    big = float(np.abs(y).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, n)
    if big < 2**53:
        return (y @ x.T).astype(np.int64)
    if big < 2**62 and max(np.abs(y).max(), np.abs(x).max()) < 2**62:
        return y.astype(np.int64) @ x.astype(np.int64).T
    whole = [np.array([[int(v) * 256 if abs(v) > 2**45 else int(np.floor(v * 256.0)) for v in row] for row in m.tolist()], object).reshape(len(m), n) for m in (a, b)]
    return np.array([[max(-HIGHEST, min(HIGHEST, sum(p * q for p, q in zip(u, v, strict=True)))) for v in whole[1]] for u in whole[0]], np.int64).reshape(len(a), len(b))


class CoverTree:
    """Nested levels over the rows of x. A node covers its rows within `radius` of its centre, one of them.
    Its children's centres are a net of those rows, the node's own centre first: all rows lie within radius / BASE of
    their nearest one, and the centres lie farther apart than that. There may be any number of them. A leaf's children are its
    rows themselves: few ones, or rows so far from one another that a net at the next radius would take more than half of
    them as centres. `rows` lists the rows so that a node's are rows[start:end]."""

    def __init__(self, x: np.ndarray):
        self.centre, self.radius, self.start, self.end, self.children = [], [], [], [], []
        self.rows = np.arange(len(x))
        first = int(((x - x.mean(0)) ** 2).sum(1).argmin()) if len(x) and x.shape[1] else 0
        self._add(first, 0, len(x), np.sqrt(((x - x[first]) ** 2).sum(1)))
        todo = [(0, np.sqrt(((x - x[first]) ** 2).sum(1)))]
        while todo:
            node, far = todo.pop()
            a, b = self.start[node], self.end[node]
            if b - a <= LEAF or self.radius[node] <= 0:
                continue
            own = self.rows[a:b]
            centres, least, of = [self.centre[node]], far.copy(), np.zeros(b - a, np.int64)
            while least.max() > self.radius[node] / BASE and 2 * len(centres) <= b - a:
                new = int(own[least.argmax()])
                d = np.sqrt(((x[own] - x[new]) ** 2).sum(1))
                of[d < least] = len(centres)
                least = np.minimum(least, d)
                centres.append(new)
            if 2 * len(centres) > b - a or len(centres) == 1:
                continue
            order = np.argsort(of, kind="stable")
            self.rows[a:b], least = own[order], least[order]
            cut = np.searchsorted(of[order], np.arange(len(centres) + 1))
            for i, c in enumerate(centres):
                self.children[node].append(len(self.radius))
                todo.append((len(self.radius), least[cut[i] : cut[i + 1]]))
                self._add(c, a + int(cut[i]), a + int(cut[i + 1]), least[cut[i] : cut[i + 1]])
        self.centres, self.radii = x[self.centre], np.array(self.radius)

    def _add(self, centre: int, start: int, end: int, far: np.ndarray) -> None:
        self.centre.append(centre)
        self.radius.append(float(far.max(initial=0)))
        self.start.append(start)
        self.end.append(end)
        self.children.append([])


def upper(q: np.ndarray, rq: np.ndarray, c: np.ndarray, rc: np.ndarray) -> np.ndarray:
    """At the most this is the inner product of any query of a node and any row of another. What overflows is
    no bound: infinite."""
    n = min(q.shape[1], c.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        nq, nc = np.sqrt((q**2).sum(1)), np.sqrt((c**2).sum(1))
        bound = q[:, :n] @ c[:, :n].T + nq[:, None] * rc[None, :] + rq[:, None] * nc[None, :] + rq[:, None] * rc[None, :]
        bound = bound + 1e-9 * (nq + rq)[:, None] * (nc + rc)[None, :] + 1
    return np.where(np.isnan(bound), np.inf, bound)


def descend(y: np.ndarray, names: np.ndarray, kth: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """(query row, id, score) that hold each query's k highest of the rows x; those below its `kth` may be left
    out. Each query first meets the leaf whose centre fits it best. Then pairs of nodes are taken in order of their bounds; one
    whose bound is below the worst kth score of its queries is pruned, others split on the side of larger radius until two
    leaves meet, of which the queries go whose own bound is below their kth score."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    top, who = np.full((len(y), k), LOWEST), np.zeros((len(y), k), np.int64)
    kth = kth.copy()

    def scan(q: np.ndarray, r: np.ndarray) -> None:
        r = np.sort(r)
        step = max(1, (1 << 20) // len(q))
        for a in range(0, len(r), step):
            part = r[a : a + step]
            one = np.flatnonzero(np.r_[True, ids[part][1:] != ids[part][:-1]])
            s, own = np.maximum.reduceat(products(y[q], x[part]), one, axis=1), ids[part][one]
            s[names[q][:, None] == own[None, :]] = LOWEST
            edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(q), LOWEST)
            i, j = np.nonzero((s >= edge[:, None]) & (s > LOWEST) & (s >= kth[q][:, None]))
            m, n = np.nonzero(top[q] > LOWEST)
            i, id_, score = np.r_[m, i], np.r_[who[q][m, n], own[j]], np.r_[top[q][m, n], s[i, j]]
            best = first_k(i, id_, ~score, k)
            i = i[best]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            top[q[i], place], who[q[i], place] = score[best], id_[best]
            kth[q] = np.maximum(kth[q], np.where(top[q][:, -1] > LOWEST, top[q][:, -1].astype(float), -np.inf))

    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) < SAFE:
        ys = scaled(y)
        tq, tx = CoverTree(ys), CoverTree(scaled(x))
        leaves = np.array([c for c, below in enumerate(tx.children) if not below])
        n = min(y.shape[1], x.shape[1])
        near = leaves[(ys[:, :n] @ tx.centres[leaves, :n].T).argmax(1)]
        for c in np.unique(near):  # each query's nearest leaf first: its kth score rules out much of the rest
            scan(np.flatnonzero(near == c), tx.rows[tx.start[c] : tx.end[c]])
        heap, turn = [(-np.inf, 0, 0, 0)], 0
        while heap:
            bound, _, a, b = heapq.heappop(heap)
            q = tq.rows[tq.start[a] : tq.end[a]]
            if -bound < kth[q].min():
                continue
            if not tq.children[a] and not tx.children[b]:
                # the leaf's children are its queries themselves: each has a bound of its own
                q = q[(near[q] != b) & (upper(ys[q], np.zeros(len(q)), tx.centres[[b]], tx.radii[[b]])[:, 0] >= kth[q])]
                if len(q):
                    scan(q, tx.rows[tx.start[b] : tx.end[b]])
                continue
            down = bool(tx.children[b]) and (not tq.children[a] or tx.radius[b] >= tq.radius[a])
            i, j = ([a], tx.children[b]) if down else (tq.children[a], [b])
            bounds = upper(tq.centres[i], tq.radii[i], tx.centres[j], tx.radii[j])
            for n, p in enumerate(i):
                worst = kth[tq.rows[tq.start[p] : tq.end[p]]].min()
                for m, c in enumerate(j):
                    if bounds[n, m] >= worst:
                        turn += 1
                        heapq.heappush(heap, (-bounds[n, m], turn, p, c))
    else:  # no distances at such sizes: all rows are scanned
        scan(np.arange(len(y)), np.arange(len(x)))
    q, place = np.nonzero(top > LOWEST)
    return q, who[q, place], top[q, place]


def search(rows: DataFrame, every: int = 50, k: int = 5, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products, ties to smaller vec_id. Exact.

    The top cells are a net of a bounded sample (SAMPLE rows of smallest hash, the farthest from those before
    taken next); queries and data fall to their nearest, and each cell has a covering radius on either side. The sample itself
    gives each query a first kth score, and a query cell its worst; a pair of cells whose bound is below
    that never meets. The rest meet in groups of (cell, block, part): a cell of many rows is dealt over blocks, the
    queries over parts of neighbouring cells, each of bounded size. In a group both sides get cover trees, which
    are descended together (`descend`). The driver holds the sample and at most `cells` rows of statistics.
    Vectors take any length and any finite value (see `vectors`); scores that a long can't hold are the nearest that it
    can, and tie.
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    data = finite(rows, zero=True)
    sid, sample = fitting_sample(data, SAMPLE)
    if not len(sid):
        return spark.createDataFrame([], schema)
    lengths = np.array([len(v) for v in sample])
    dim = int(np.bincount(lengths).argmax())
    samples = list_column(np.concatenate(sample), lengths)
    head = np.clip(scaled(heads(samples, dim)[0]), -SAFE, SAFE)
    centres = net(head, cells)
    ask = F.pmod("vec_id", F.lit(every)) == 0

    def assign(batches):
        for b in batches:
            v, rest = heads(b.column(1), dim)
            names = b.column(0).to_numpy()
            y = scaled(v)
            own = nearest(np.clip(y, -SAFE, SAFE), centres)
            far = np.where(rest > 0, np.inf, distance(y, centres[own]))  # no bound for vectors beyond the centres' length
            far = np.where(np.isfinite(far), far, np.inf)
            kth = np.full(len(names), -np.inf)
            q = np.flatnonzero(names % every == 0)
            for i, x in by_length(b.column(1).take(pa.array(q))):
                s = np.concatenate([np.zeros((len(i), 0), np.int64), *(products(x, z) for _, z in by_length(samples))], axis=1)
                of = np.concatenate([j for j, _ in by_length(samples)])
                s[names[q[i]][:, None] == sid[of][None, :]] = LOWEST
                if s.shape[1] > k:
                    kth[q[i]] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(far), pa.array(kth)], ["vec_id", "vector", "cell", "far", "kth"])

    placed = written(data.mapInArrow(assign, "vec_id long, vector array<double>, cell int, far double, kth double"))
    n, rc, rq, asks, worst = (np.zeros(len(centres)) for _ in range(5))
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("rc"), F.max(F.when(ask, F.col("far"))).alias("rq"), F.count_if(ask).alias("asks"), F.min(F.when(ask, F.col("kth"))).alias("worst"))
    for r in stats.collect():  # at most `cells` rows
        c = r["cell"]
        n[c], rc[c], asks[c] = r["n"], r["rc"], r["asks"]
        rq[c], worst[c] = r["rq"] or 0.0, r["worst"] if r["worst"] is not None else 0.0
    meet = (upper(centres, rq, centres, rc) >= worst[:, None]) & (asks > 0)[:, None] & (n > 0)[None, :]
    block = min(BLOCK, max(1024, int(n.sum()) // (2 * parallelism(spark))))
    blocks = np.maximum(1, -(-n // block)).astype(np.int64)
    first = ((np.cumsum(asks) - asks) // PART).astype(np.int64)  # a cell's first part, and how many it is dealt over
    spread = np.maximum(1, -(-asks // PART)).astype(np.int64)
    wanted = [np.unique(np.concatenate([np.arange(first[q], first[q] + spread[q]) for q in np.flatnonzero(meet[:, c])] or [np.zeros(0, np.int64)])) for c in range(len(centres))]
    to_cell = [np.repeat(np.flatnonzero(m), blocks[m]) for m in meet]
    to_block = [np.concatenate([np.arange(blocks[c]) for c in np.flatnonzero(m)] or [np.zeros(0, np.int64)]) for m in meet]

    def deal(batches):
        turn = 0
        for b in batches:
            cell = b.column(2).to_numpy()
            at = (turn + np.arange(len(cell))) % blocks[cell]
            turn += len(cell)
            many = np.array([len(w) for w in wanted])[cell]
            i = np.repeat(np.arange(len(cell)), many)
            part = np.concatenate([wanted[c] for c in cell]) if len(cell) else np.zeros(0, np.int64)
            for a in range(0, len(i), 4096):
                s = slice(a, a + 4096)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i[s])), b.column(1).take(pa.array(i[s])), pa.array(cell[i[s]]), pa.array(at[i[s]].astype(np.int32)), pa.array(part[s].astype(np.int32))], ["vec_id", "vector", "cell", "block", "part"])

    def route(batches):
        turn = 0
        for b in batches:
            cell = b.column(2).to_numpy()
            part = first[cell] + (turn + np.arange(len(cell))) % spread[cell]
            turn += len(cell)
            many = np.array([len(t) for t in to_cell])[cell]
            i = np.repeat(np.arange(len(cell)), many)
            c, at = (np.concatenate([t[q] for q in cell]) if len(cell) else np.zeros(0, np.int64) for t in (to_cell, to_block))
            for a in range(0, len(i), 4096):
                s = slice(a, a + 4096)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i[s])), b.column(1).take(pa.array(i[s])), b.column(3).take(pa.array(i[s])), pa.array(c[s].astype(np.int32)), pa.array(at[s].astype(np.int32)), pa.array(part[i[s]].astype(np.int32))], ["query_id", "vector", "kth", "cell", "block", "part"])

    left = placed.select("vec_id", "vector", "cell").mapInArrow(deal, "vec_id long, vector array<double>, cell int, block int, part int")
    right = placed.where(ask).select(F.col("vec_id").alias("query_id"), "vector", "cell", "kth").mapInArrow(route, "query_id long, vector array<double>, kth double, cell int, block int, part int")

    def dual(e: pa.Table, q: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 3]
        if len(e) and len(q):
            ids, names, kth = e["vec_id"].to_numpy(), q["query_id"].to_numpy(), q["kth"].to_numpy()
            for i, y in by_length(q["vector"]):
                for j, x in by_length(e["vector"]):
                    r, c, s = descend(y, names[i], kth[i], x, ids[j], k)
                    found.append((names[i][r], c, s))
        name, vec, score = map(np.concatenate, zip(*found, strict=True))
        best = first_k(name, vec, ~score, k)
        return pa.table({"query_id": name[best], "vec_id": vec[best], "score": score[best]})

    key = ["cell", "block", "part"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(dual, "query_id long, vec_id long, score long")
    return ranked(found, k, F.max("score"), F.col("score").desc())


def net(x: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` rows, each the farthest from those before it."""
    out, d = [0], distance(x, np.broadcast_to(x[0], x.shape))
    while len(out) < min(most, len(x)) and d.max() > 0:
        out.append(int(d.argmax()))
        d = np.minimum(d, distance(x, np.broadcast_to(x[out[-1]], x.shape)))
    return x[out]


def op10_exact_topk(spark, sf_dir) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, max(CAST(coalesce(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])), 0) AS BIGINT)) AS score
  FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, d.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
