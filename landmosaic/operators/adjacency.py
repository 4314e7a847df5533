"""Patch graphs: contact and distance joins, box joins, degrees and signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmosaic.functions.columns import reproject_points
from landmosaic.grid import GridSpec
from landmosaic.operators.meetings import meetings
from landmosaic.operators.patches import stored_runs
from landmosaic.operators.spans import bin_width, overlapping, row_steps
from landmosaic.storage import materialize


def contacts(patch_cells: DataFrame) -> DataFrame:
    """``t, one, other, beside, shared``: runs of two patches that touch, with 1 if they lie in one row and the columns they share from row to row.

    Corners share none.
    """
    return meetings(stored_runs(patch_cells))


def adjacency(patch_cells: DataFrame) -> DataFrame:
    """``t, src, dst`` with ``src < dst``: patches that share an edge or a corner."""
    return contacts(patch_cells).select("t", F.least("one", "other").alias("src"), F.greatest("one", "other").alias("dst")).distinct()


def bordered_edges(patch_cells: DataFrame, grid: GridSpec) -> DataFrame:
    """``t, src, dst, border``: the edges of ``adjacency`` with the length that two patches run together, 0 at corners."""
    border = F.sum(F.col("beside") * float(abs(grid.e)) + F.col("shared") * float(abs(grid.a)))
    return contacts(patch_cells).groupBy("t", F.least("one", "other").alias("src"), F.greatest("one", "other").alias("dst")).agg(border.alias("border"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("t", "src", "dst").unionByName(edges.select("t", F.col("dst").alias("src"), F.col("src").alias("dst")))


def distance_edges(patch_cells: DataFrame, distance: float, grid: GridSpec) -> DataFrame:
    """``t, src, dst, distance`` of patches at most ``distance`` apart; touching ones have 0.

    The patches' runs meet once for each row step down, widened by what the step
    leaves of the distance, so the work grows with the radius times the runs in
    reach.  The distance of two cells is that of their squares, exactly and
    inclusively.
    """
    if distance < 0:
        raise ValueError("the distance must not be negative")
    runs = stored_runs(patch_cells)
    met = runs_within(runs, runs, distance, grid, forward=True).where("src <> dst")
    return met.groupBy("t", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("distance").alias("distance"))


def runs_within(one: DataFrame, other: DataFrame, distance: float, grid: GridSpec, forward: bool = False) -> DataFrame:
    """``t, src, dst, distance`` of every two runs of the two tables (t, patch_id, row, c0, c1) at most so far apart.

    With ``forward`` the second run is never above the first.
    """
    dx, dy = abs(grid.a), abs(grid.e)
    left = one.select("t", F.col("patch_id").alias("src"), "row", "c0", "c1", row_steps(distance, grid, forward).alias("step"))
    left = left.select("t", "src", (F.col("row") + F.col("step.dr")).alias("row"), F.abs("step.dr").alias("dr"), "c0", "c1", (F.col("c0") - F.col("step.w")).alias("l0"), (F.col("c1") + F.col("step.w")).alias("l1"))
    right = other.select("t", F.col("patch_id").alias("dst"), "row", F.col("c0").alias("r0"), F.col("c1").alias("r1"))
    met = overlapping(left, right, ["t", "row"], bin_width(distance, grid))
    across = F.greatest(F.greatest("c0", "r0") - F.least("c1", "r1") - 1, F.lit(0)) * dx
    return met.select("t", "src", "dst", F.sqrt(across**2 + (F.greatest(F.col("dr") - 1, F.lit(0)) * dy) ** 2).alias("distance"))


def degrees(patches: DataFrame, edges: DataFrame) -> DataFrame:
    """``t, patch_id, degree`` of every patch."""
    counted = symmetric(edges).groupBy("t", F.col("src").alias("patch_id")).agg(F.count("*").alias("degree"))
    return patches.select("t", "patch_id").join(counted, ["t", "patch_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def weak_nodes(patches: DataFrame, edges: DataFrame) -> DataFrame:
    """Patches without a neighbour or with just one."""
    kind = F.when(F.col("degree") == 0, "disconnected").otherwise("poorly connected")
    return degrees(patches, edges).where("degree <= 1").withColumn("kind", kind)


def triangle_corners(edges: DataFrame) -> DataFrame:
    """``t, patch_id``: each corner of each triangle.

    Edges point from the end of lower degree to the other, ties by id, so that no
    vertex has more than some ``sqrt(2 * edges)`` of them going out and a hub
    opens no wedges of its own.
    """
    ends = symmetric(edges).groupBy("t", "src").agg(F.count("*").alias("degree"))
    of = lambda key, name: ends.select("t", F.col("src").alias(key), F.col("degree").alias(name))
    ranked = edges.select("t", "src", "dst").join(of("src", "d1"), ["t", "src"]).join(of("dst", "d2"), ["t", "dst"])
    low = (F.col("d1") < F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("src") < F.col("dst")))
    pointed = materialize(ranked.select("t", F.when(low, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("v")))
    wedges = pointed.join(pointed.select("t", "u", F.col("v").alias("w")), ["t", "u"]).where("v < w")
    closing = pointed.select("t", F.least("u", "v").alias("v"), F.greatest("u", "v").alias("w"))
    return wedges.join(closing, ["t", "v", "w"]).select("t", F.explode(F.array("u", "v", "w")).alias("patch_id"))


def graph_signature(patches: DataFrame, edges: DataFrame) -> DataFrame:
    """``t, degree, triangles, nodes``: how many nodes have so many neighbours and triangles."""
    corners = triangle_corners(edges)
    triangles = corners.groupBy("t", "patch_id").agg(F.count("*").alias("triangles"))
    rows = degrees(patches, edges).join(triangles, ["t", "patch_id"], "left").withColumn("triangles", F.coalesce("triangles", F.lit(0).cast("long")))
    return rows.groupBy("t", "degree", "triangles").agg(F.count("*").alias("nodes"))


def same_graph(one: DataFrame, other: DataFrame) -> bool:
    """Whether two signatures agree, as a fast test of isomorphism."""
    keys = ["degree", "triangles", "nodes"]
    return one.select(keys).exceptAll(other.select(keys)).isEmpty() and other.select(keys).exceptAll(one.select(keys)).isEmpty()


def edge_lines(edges: DataFrame, patches: DataFrame, crs: str | None = None, target_crs: str | None = None) -> DataFrame:
    """``t, src, dst, x1, y1, x2, y2``: edges as lines between representative points, in ``target_crs`` if one is given."""
    points = patches.select("t", "patch_id", F.col("rep_x").alias("x"), F.col("rep_y").alias("y"))
    if target_crs and target_crs != crs:
        points = reproject_points(points, crs, target_crs)
    end = lambda key, x, y: points.select("t", F.col("patch_id").alias(key), F.col("x").alias(x), F.col("y").alias(y))
    return edges.select("t", "src", "dst").join(end("src", "x1", "y1"), ["t", "src"]).join(end("dst", "x2", "y2"), ["t", "dst"]).select("t", "src", "dst", "x1", "y1", "x2", "y2")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``t, nodes, edges``: the size of the graph of each slice."""
    size = lambda df, name: df.groupBy("t").agg(F.count("*").alias(name))
    return size(nodes.select("t", "patch_id").distinct(), "nodes").join(size(edges, "edges"), "t", "left").fillna(0, ["edges"])


def bbox_join(one: DataFrame, other: DataFrame, key: str | None = None) -> DataFrame:
    """``one_id, other_id`` of boxes (id, xmin, ymin, xmax, ymax) that meet, and have the same ``key`` if one is named.

    Each box lies in the squares, four at most, of the smallest power of two that
    its longer side does not exceed, and is also known in the squares above of
    the sizes that occur in the other table.  Two boxes meet in squares of the
    larger one's size, so a huge box costs the small ones nothing but a row.
    """
    size = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    least = min((x for df in (one, other) if (x := df.where(size > 0).agg(F.min(size)).first()[0])), default=1.0)
    names, keys = ("id", "xmin", "ymin", "xmax", "ymax"), [key] if key else []

    def levelled(df: DataFrame, p: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in names], F.ceil(F.log2(F.greatest(size, F.lit(least)))).cast("int").alias("own"))

    def squares(df: DataFrame, p: str) -> DataFrame:
        side = F.pow(F.lit(2.0), "level")
        span = lambda x: F.explode(F.sequence(F.floor(F.col(f"{p}_{x}min") / side), F.floor(F.col(f"{p}_{x}max") / side)))
        return df.select("*", span("x").alias("bx")).select("*", span("y").alias("by"))

    a, b = levelled(one, "one"), levelled(other, "other")
    levels = [sorted(r[0] for r in df.select("own").distinct().collect()) for df in (a, b)]  # powers of two

    def met(mine: DataFrame, p: str, theirs: DataFrame, q: str, known: list[int], equal: bool) -> DataFrame:
        """Boxes of ``mine`` at their own size with those of ``theirs`` that are smaller, or as large if ``equal``."""
        above = F.filter(F.array(*map(F.lit, known)).cast("array<int>"), lambda x: x >= F.col("own") if equal else x > F.col("own"))
        low = theirs.withColumn("level", F.explode(above)).drop("own")
        pairs = squares(mine.withColumnRenamed("own", "level"), p).join(squares(low, q), [*keys, "level", "bx", "by"])
        # a pair meets in several squares; it is counted in the first one both reach
        side = F.pow(F.lit(2.0), "level")
        first = (F.col("bx") == F.floor(F.greatest("one_xmin", "other_xmin") / side)) & (F.col("by") == F.floor(F.greatest("one_ymin", "other_ymin") / side))
        near = "one_xmin <= other_xmax and other_xmin <= one_xmax and one_ymin <= other_ymax and other_ymin <= one_ymax"
        return pairs.where(near).where(first).select(*keys, "one_id", "other_id")

    return met(a, "one", b, "other", levels[0], True).unionByName(met(b, "other", a, "one", levels[1], False))
