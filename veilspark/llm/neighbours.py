"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, survivors again in double.

Queries and candidates are dealt to the cells of a grid, each a bounded block of either side. In a
cell, vectors are rounded to 8 bits and multiplied tile by tile. The norm of what rounding took away
bounds the error of every product, so a candidate is dropped only if its best possible score is below
the k-th best sure score. The few survivors are computed again from the original vectors, in double
precision and in the order of the components, and per-query heaps merge the tiles. Nothing is
approximate in the outcome.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.staging import stage

#: Most queries and candidates in a cell of the grid, and the sides of a tile.
CELL_QUERIES = 8_192
CELL_CANDIDATES = 32_768
MIN_CELLS = 12
TILE_QUERIES = 256
TILE_CANDIDATES = 4_096
EXACT_PAIRS = 500_000
#: Components multiplied at once; sums of so many products of 8-bit numbers are exact in float32.
SLICE = 1_024


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite and not null, at least one not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit values (held as float32), scales, norms of the rounded vectors, norms of the errors."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = np.finfo(np.float64).tiny
    q = np.rint(x / scale[:, None])
    rounded = q * scale[:, None]
    return q.astype(np.float32), scale, np.linalg.norm(rounded, axis=1), np.linalg.norm(x - rounded, axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], SLICE):
        out += a[:, at : at + SLICE] @ b[:, at : at + SLICE].T
    return out


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i))
    for at in range(0, len(i), EXACT_PAIRS):
        some = slice(at, at + EXACT_PAIRS)
        for k in range(a.shape[1]):
            out[some] += a[i[some], k] * b[j[some], k]
    return out


def _thin(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors, the ``k`` with the smallest ids: no other can be among the first ``k``."""
    raw = np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * 8}").reshape(-1)
    _, group = np.unique(raw, return_inverse=True)
    order = np.lexsort((ids, group.reshape(-1)))
    sorted_group = group.reshape(-1)[order]
    start = np.concatenate(([True], sorted_group[1:] != sorted_group[:-1]))
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    kept = order[rank < k]
    return ids[kept], vectors[kept]


def search(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query its ``k`` best candidates as (-score, id), best first, ties to the smaller id."""
    cid, c = _thin(cid, c, k + 1)
    best: list[list[tuple[float, int]]] = [[] for _ in qid]
    q8, q_scale, q_norm, q_error = quantise(q)
    c8, c_scale, c_norm, c_error = quantise(c)
    # Room for the rounding of the products themselves, far above what doubles lose.
    slack = 1e-9 * np.outer(q_norm + q_error, np.ones(1)).ravel()
    for at in range(0, len(qid), TILE_QUERIES):
        rows = slice(at, at + TILE_QUERIES)
        floor = np.full(len(qid[rows]), -np.inf)
        for to in range(0, len(cid), TILE_CANDIDATES):
            cols = slice(to, to + TILE_CANDIDATES)
            about = _products(q8[rows], c8[cols]) * q_scale[rows, None] * c_scale[None, cols]
            error = q_error[rows, None] * (c_norm + c_error)[None, cols] + q_norm[rows, None] * c_error[None, cols]
            error += slack[rows, None] * (c_norm + c_error)[None, cols]
            own = qid[rows, None] == cid[None, cols]
            sure = np.where(own, -np.inf, about - error)
            if sure.shape[1] >= k:
                floor = np.maximum(floor, np.partition(sure, -k, axis=1)[:, -k])
            i, j = np.nonzero(~own & (about + error >= floor[:, None]))
            score = _exact(q[rows], c[cols], i, j)
            order = np.lexsort((cid[cols][j], -score, i))
            i, j, score = i[order], j[order], score[order]
            cuts = np.searchsorted(i, np.arange(len(floor) + 1))
            for r in range(len(floor)):
                part = slice(cuts[r], min(cuts[r] + k, cuts[r + 1]))
                found = zip((-score[part]).tolist(), cid[cols][j[part]].tolist(), strict=True)
                merged = heapq.merge(best[at + r], found)
                best[at + r] = [x for x, _ in zip(merged, range(k))]
                if len(best[at + r]) == k:
                    floor[r] = max(floor[r], -best[at + r][-1][0])
    return best


def _cell(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def side(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table.column("id").to_numpy()
        flat = table.column("vector").combine_chunks().flatten().to_numpy().astype(np.float64)
        return ids, flat.reshape(len(ids), -1)

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if queries.num_rows and candidates.num_rows:
            (qid, q), (cid, c) = side(queries), side(candidates)
            for row, name, found in zip(queries.column("mark").to_pylist(), qid.tolist(), search(qid, q, cid, c, k)):
                for score, other in found:
                    for column, value in zip(out, (name, row, other, -score), strict=True):
                        column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["query_id", "mark", "vec_id", "score"])

    return run


def nearest(
    queries: DataFrame, candidates: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids. Rows that repeat
    id and vector count once. A row is compared with all candidates of other ids and of its length.
    Rows of one id with different vectors are queries of their own. Other columns are not looked at.
    """

    def prepared(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"))
        rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()
        return rows.withColumns({"dim": F.size("vector"), "mark": F.xxhash64("vector")})

    q, c = stage(prepared(queries), "queries"), stage(prepared(candidates), "candidates")
    n_q = max(1, ceil(q.count() / CELL_QUERIES))
    n_c = max(ceil(c.count() / CELL_CANDIDATES), ceil(MIN_CELLS / n_q))
    place = lambda n: F.pmod(F.xxhash64("id", "mark"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumns({"i": place(n_q)}).withColumn("j", every(n_c))
    right = c.withColumns({"j": place(n_c)}).withColumn("i", every(n_q)).drop("mark")
    cells = left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j"))
    found = cells.applyInArrow(_cell(k), "query_id long, mark long, vec_id long, score double")
    order = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
