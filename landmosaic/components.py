"""Connected components by alternating large-star and small-star rounds.

Both stars are an aggregate followed by an equi-join, so no neighbourhood is
ever gathered into one row: a hot vertex only costs a skewed join, which AQE
splits.  Before the rounds every partition reduces its own edges to a
forest, which collapses whatever locality the edge table already has; vertices
that one forest alone holds, below its tops, are left out of the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landmosaic.storage import discard, materialize

#: Edges that one local forest holds at a time; bounds a task's memory.
FOREST_EDGES = 500_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of the given edges with the smallest vertex of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while len(a):
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:  # pointer jumping
            jumped = parent[parent]
            if np.array_equal(jumped, parent):
                break
            parent = jumped
        a, b = parent[a], parent[b]
        keep = a != b
        a, b = a[keep], b[keep]
    keep = parent != np.arange(len(nodes))
    return nodes[keep], nodes[parent[keep]]


def _local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(us: list, vs: list) -> pa.RecordBatch:
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    us, vs, held = [], [], 0
    for batch in batches:
        us.append(batch.column(0).to_numpy(zero_copy_only=False))
        vs.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= FOREST_EDGES:
            yield out(us, vs)
            us, vs, held = [], [], 0
    if held:
        yield out(us, vs)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every vertex with an edge; component is its smallest vertex.

    Null ends, loops and repeated edges are ignored; no edges give no rows.
    Isolated vertices are the caller's: they are their own component.
    """
    pairs = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a <> b")
    pairs = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = pairs.mapInArrow(_local_forests, "u long, v long")
    marks = stars.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")).distinct()  # the tops of the stars
    own = Window.partitionBy("u").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leaf = F.count("*").over(own) == F.when(F.count("v").over(own) == 1, 1).otherwise(0)
    first = F.row_number().over(Window.partitionBy("u").orderBy("v")) == 1
    # a vertex with one top, that is no top itself, follows its top and takes no part in the rounds
    ends = materialize(stars.unionByName(marks).repartition("u").distinct().select("u", "v", leaf.alias("leaf"), first.alias("first")))
    now = ends.where("not leaf and v is not null").select("u", "v")
    for _ in range(max_rounds):
        loose = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        inner = now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
        if loose.unionByName(inner).isEmpty():
            tops = now.select(F.col("v").alias("top"), F.col("v").alias("component")).distinct()
            tops = tops.unionByName(now.select(F.col("u").alias("top"), F.col("v").alias("component")))
            keyed = ends.where("first").select(F.col("u").alias("node"), F.when(F.col("leaf"), F.col("v")).otherwise(F.col("u")).alias("top"))
            return keyed.join(tops, "top", "left").select("node", F.coalesce("component", "top").alias("component"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v")
        after = materialize(small.distinct())
        discard(now)
        now = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
