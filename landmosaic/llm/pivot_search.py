"""Exact top-k inner-product search by pivot-table elimination.

Adding one component turns the largest inner product into the smallest
Euclidean distance: with ``m`` the largest norm of a block,
``|(q, 0) - (x, sqrt(m^2 - x.x))|^2 = q.q + m^2 - 2 q.x``.  Distances of all
rows to a table of pivots are computed once for a block; for a query,
``max_p |d(q, p) - d(x, p)|`` bounds its distance to a row from below.  Rows
are evaluated in the order of these bounds, in growing steps, until the next
bound rules out every row left.  Scores are exact integers; the bounds carry a
margin for rounding, and a row whose bound ties with the k-th score is kept, so
ties are settled by id.

Components are floor(64 * x).  Products beyond the whole numbers that doubles hold
are summed as Python integers; scores beyond a long are held at its end.  Rows
that take no part, vectors of different lengths and repeated ids: see
``vector_blocks``; an empty table gives no rows, and extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmosaic.llm.vector_blocks import best, search, usable

SCALE = 64
PIVOTS = 32
ROW_BLOCK = 4096
FIRST_STEP = 256


def choose_pivots(rows: np.ndarray, n: int) -> np.ndarray:
    """Row numbers far from one another: each next one is the farthest from those chosen."""
    gap = ((rows - rows.mean(axis=0)) ** 2).sum(axis=1)
    chosen = [int(gap.argmax())]
    gap = np.full(len(rows), np.inf)
    while len(chosen) < min(n, len(rows)):
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
        if gap.max() <= 0:
            break
        chosen.append(int(gap.argmax()))
    return np.array(chosen)


def distances(squares: np.ndarray, points: np.ndarray, pivot_squares: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(squares[:, None] + pivot_squares - 2 * (points @ pivots.T), 0))


def pivot_kernel(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, tally: list | None = None):
    """Each query's best ``k`` rows of this block, exactly; ``tally`` takes the number of rows evaluated for each."""
    exact = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1] < 2**53
    whole = rows if exact else np.array([[int(x) for x in r] for r in rows], object)  # beyond doubles: Python's own integers
    squares = (rows**2).sum(axis=1)
    top = squares.max()
    lifted = np.column_stack([rows, np.sqrt(top - squares)])
    at = choose_pivots(lifted, PIVOTS)
    pivots, full = lifted[at], np.full(len(rows), top)
    table = distances(full, lifted, full[at], pivots).T.astype(np.float32).copy()
    asked = (queries**2).sum(axis=1)
    asked_table = distances(asked, queries, full[at], pivots[:, :-1]).astype(np.float32)
    # rounding of the tables and bounds, in units of distance
    margin = 1e-5 * float(np.sqrt(top) + np.sqrt(asked.max(initial=0))) + 1e-3
    found = []
    for i, q in enumerate(queries):
        bound = np.abs(table[0] - asked_table[i, 0])
        for p in range(1, len(at)):
            np.maximum(bound, np.abs(table[p] - asked_table[i, p]), out=bound)
        ceiling = (asked[i] + top - np.maximum(bound.astype(np.float64) - margin, 0) ** 2) / 2
        if not np.isfinite(asked[i] + top):  # squares beyond doubles bound nothing
            bound, ceiling = np.zeros(len(rows)), np.full(len(rows), np.inf)
        q = q if exact else np.array([int(x) for x in q], object)
        step = min(FIRST_STEP, len(rows))
        part = np.argpartition(bound, step - 1)
        todo, rest = part[:step], part[step:]
        got, scores = np.zeros(0, np.int64), np.zeros(0, whole.dtype)
        while True:
            fresh = todo[ids[todo] != query_ids[i]]
            got, scores = np.concatenate([got, fresh]), np.concatenate([scores, whole[fresh] @ q])
            if len(scores) >= k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k] if exact else sorted(scores)[-k]
                rest = rest[ceiling[rest] >= float(kth)]
            if not len(rest):
                break
            step *= 4
            if len(rest) > step:
                order = np.argpartition(bound[rest], step - 1)
                todo, rest = rest[order[:step]], rest[order[step:]]
            else:
                todo, rest = rest, rest[:0]
        b = best(scores, ids[got], k)
        longs = np.rint(scores[b]).astype(np.int64) if exact else np.array([max(-(2**63), min(2**63 - 1, x)) for x in scores[b]], np.int64)
        found.append((np.full(len(b), query_ids[i]), ids[got[b]], longs))
        if tally is not None:
            tally.append(len(got))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def top_k(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows whose id is divisible by ``every``."""
    scaled = usable(vectors).select("id", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")).alias("v"))
    return search(scaled, scaled.where(F.col("id") % every == 0), pivot_kernel, "long", k, ROW_BLOCK)


#: The same search in SQL, every pair of a query and a row.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""
