"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree gives a row a long bit string of random-hyperplane signs and keeps
the strings of a block in a sorted array, which stands for the whole prefix
tree.  A query descends each tree to its longest common prefix by binary
search; then all trees ascend together, one bit at a time, widening the range
of rows that share the shorter prefix until enough candidates are found.  These
are scored by the inner product on the original vectors, those among the best in
one fixed order of summation: equal vectors tie, and ties go by id.

Inner products become angles by one added component (see ``pivot_search``), so
long vectors are found as well.  Vectors null, zero or holding null or
non-finite components take no part; an empty table gives no rows; see
``vector_blocks`` for repeated ids, lengths and rows without an id.  Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmosaic.llm.vector_blocks import best, search, usable

#: How far sums of products in another order may differ, as a share of both lengths.
ROUNDING = 1e-12

TREES, BITS, SEED = 32, 24, 20_240_601
ROW_BLOCK = 8192
#: Candidates, counted once for each tree that gives them, as a share of a block's rows.
REACH = 1.0


def planes(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, TREES * BITS))


def strings(points: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """A bit string for each tree (first axis) and point, as an integer."""
    signs = (points @ normals > 0).reshape(len(points), TREES, BITS)
    return (signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).T.copy()


def in_order(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, so that equal vectors score the same in any block."""
    out = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        out += rows[:, j] * q[j]
    return out


def forest_kernel(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    squares = (rows**2).sum(axis=1)
    lengths = np.sqrt(squares)
    normals = planes(rows.shape[1] + 1)
    lifted = np.column_stack([rows, np.sqrt(np.maximum(squares.max() - squares, 0))])
    order = np.empty((TREES, len(rows)), np.int64)
    index = np.empty((TREES, len(rows)), np.int64)
    for t, s in enumerate(strings(lifted, normals)):
        order[t] = np.argsort(s, kind="stable")
        index[t] = s[order[t]]
    asked = strings(np.column_stack([queries, np.zeros(len(queries))]), normals)
    wanted = max(REACH * len(rows), 4 * k)
    # ranges of rows that share the first `depth` bits, for all trees, from long prefixes to short ones
    low = np.empty((len(queries), TREES), np.int64)
    high = np.empty((len(queries), TREES), np.int64)
    open_ = np.arange(len(queries))
    for depth in range(BITS, -1, -1):
        unit = 1 << (BITS - depth)
        for t in range(TREES):
            first = asked[t, open_] // unit * unit
            low[open_, t] = np.searchsorted(index[t], first, "left")
            high[open_, t] = np.searchsorted(index[t], first + unit, "left")
        open_ = open_[(high[open_] - low[open_]).sum(axis=1) < wanted]
        if not len(open_):
            break
    found = []
    for i, q in enumerate(queries):
        seen = np.zeros(len(rows), bool)
        for t in np.flatnonzero(high[i] > low[i]):
            seen[order[t, low[i, t] : high[i, t]]] = True
        at = np.flatnonzero(seen)
        at = at[ids[at] != query_ids[i]]
        if len(at) < k:  # the trees gave the same few: up to the roots
            at = np.flatnonzero(ids != query_ids[i])
        scores = rows[at] @ q
        if len(scores) > k:  # those that any order of summation may place among the k best
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            at = at[scores >= kth - ROUNDING * lengths.max() * np.sqrt(q @ q)]
        scores = in_order(rows[at], q)
        b = best(scores, ids[at], k)
        found.append((np.full(len(b), query_ids[i]), ids[at[b]], scores[b]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows whose id is divisible by ``every``."""
    rows = usable(vectors).where(F.exists("v", lambda x: x != 0))
    return search(rows, rows.where(F.col("id") % every == 0), forest_kernel, "double", k, ROW_BLOCK)
