"""A stated query set against all rows, in blocks.

Rows and queries are dealt into blocks of bounded size by a hash of their id;
every (row block, query block) pair is one group of a co-grouped Arrow
function, which returns each query's best rows of that block.  A window then
ranks what the blocks found.  No group grows with the input.

Vectors null, empty, or holding null or non-finite components take no part, nor
do rows without an id.  Vectors of different lengths are compared as if the
shorter one ended in zeros.  A row repeated counts once, and of different vectors
under one id the greatest, component by component from the first, stands for it.
Only the id and the vector are read, so further columns, whatever their names,
change nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 8192


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v`` of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(fine & finite)
    return rows.groupBy("id").agg(F.max("v").alias("v"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column, padded with zeros to the longest."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def padded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))


def search(vectors: DataFrame, queries: DataFrame, kernel: Callable, score_type: str, k: int, row_block: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` rows of each query.

    ``kernel(ids, rows, query_ids, queries, k)`` gives query numbers, row ids
    and scores of at least the best ``k`` rows of its block for each query.
    """
    n_rows, n_queries = -(-vectors.count() // row_block) or 1, -(-queries.count() // QUERY_BLOCK) or 1
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select("id", "v", block(n_rows).alias("rb")).select("*", each(n_queries).alias("qb"))
    asked = queries.select("id", "v", block(n_queries).alias("qb")).select("*", each(n_rows).alias("rb"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = not (left.num_rows and right.num_rows)
        if empty:
            q, i, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            x, y = padded(matrix(left["v"]), matrix(right["v"]))
            q, i, s = kernel(left["id"].to_numpy(), x, right["id"].to_numpy(), y, k)
        return pa.table({"query_id": q, "vec_id": i, "score": pa.array(s).cast(pa.int64() if score_type == "long" else pa.float64())})

    found = rows.groupBy("rb", "qb").cogroup(asked.groupBy("rb", "qb")).applyInArrow(run, f"query_id long, vec_id long, score {score_type}")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", nth.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]
