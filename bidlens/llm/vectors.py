"""Vector tables: which rows take part, matrices of a column, and exact distances at any magnitude.

Shared definitions of the two searches. Missing components count as 0: vectors of unlike length meet as
if the shorter one went on with zeros, so every row is a candidate. Rows that share a vec_id are one entry
with several vectors: a pair of ids has the best score of their rows, and an id stands once in a list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Components up to this size (and squares of them) are safe in doubles.
SAFE = 1e150


def finite(rows: DataFrame, zero: bool) -> DataFrame:
    """vec_id and vector (doubles) of the rows whose vector is there and finite; all-zero ones if asked for."""
    v = F.col("embedding").cast("array<double>").alias("vector")
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = rows.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v).where(good)
    return out if zero else out.where(F.exists("vector", lambda x: x != 0))


def fitting_sample(data: DataFrame, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and vectors of the `most` rows of smallest hash, one for an id. The driver holds no more."""
    got: dict[int, np.ndarray] = {}
    for r in data.orderBy(F.xxhash64("vec_id", "vector"), "vec_id", "vector").limit(most).collect():
        got.setdefault(r["vec_id"], np.array(r["vector"], float))
    return np.array(list(got), np.int64), list(got.values())


def by_length(col) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in a list column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return []
    size = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (size == size[0]).all():
        return [(np.arange(len(col)), flat.reshape(len(col), size[0]))]
    at = np.cumsum(size) - size
    out = []
    for n in np.unique(size):
        i = np.flatnonzero(size == n)
        out.append((i, flat[at[i][:, None] + np.arange(n)]))
    return out


def heads(col, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The first dim components of each vector, zeros where it has fewer, and the norm of the rest."""
    out, rest = np.zeros((len(col), dim)), np.zeros(len(col))
    for i, x in by_length(col):
        n = min(dim, x.shape[1])
        out[i, :n] = x[:, :n]
        if x.shape[1] > dim:
            with np.errstate(over="ignore"):
                rest[i] = np.sqrt((x[:, dim:] ** 2).sum(1))
    return out, rest


def list_column(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of row i of a to row i of b, in doubles; rows whose squares would overflow or
    vanish are scaled by a power of two first. Beyond the doubles it is infinite."""
    n = min(a.shape[1], b.shape[1])
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        diff = np.concatenate([a[:, :n] - b[:, :n], a[:, n:], b[:, n:]], axis=1)
        out = np.sqrt((diff * diff).sum(1))
        odd = np.flatnonzero(~(out < SAFE) | (out < 1 / SAFE))
        if len(odd):
            top = np.abs(diff[odd]).max(axis=1, initial=0)
            odd = odd[(top > 0) & (top < np.inf)]
            power = np.frexp(np.abs(diff[odd]).max(axis=1, initial=0))[1]
            part = np.ldexp(diff[odd], -power[:, None])
            out[odd] = np.ldexp(np.sqrt((part * part).sum(1)), power)
    return out


def first_k(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k lowest scores, ties to smaller id, an id once."""
    o = np.lexsort((score, ids, row))
    o = o[np.r_[True, (row[o][1:] != row[o][:-1]) | (ids[o][1:] != ids[o][:-1])]] if len(o) else o
    o = o[np.lexsort((ids[o], score[o], row[o]))]
    return o[np.arange(len(o)) - np.searchsorted(row[o], row[o]) < k]


def ranked(found: DataFrame, k: int, best, order) -> DataFrame:
    """query_id, rank, vec_id, score: each id's k best, ties to smaller vec_id. One shuffle, on query_id."""
    one = found.repartition("query_id").groupBy("query_id", "vec_id").agg(best.alias("score"))
    w = Window.partitionBy("query_id").orderBy(order, "vec_id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
