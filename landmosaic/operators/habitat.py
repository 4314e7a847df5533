"""Species habitats: distance graphs with barriers, components, reach."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmosaic.components import connected_components
from landmosaic.grid import GridSpec
from landmosaic.operators import outlines
from landmosaic.operators.adjacency import adjacency, distance_edges
from landmosaic.operators.outlines import block_distances, distinct_block_distances
from landmosaic.operators.patches import are_runs, as_cells, cell_count, patch_runs, patch_table
from landmosaic.operators.pyramid import Pyramid, all_distances, nearest_distances
from landmosaic.operators.spans import bin_width, merged_spans, met_walls, overlapping, widened, without
from landmosaic.storage import dealt, materialize

#: Components of a slice whose complete graph is worth a warning.
MANY_COMPONENTS = 1000


@dataclass
class Habitat:
    """Nodes of valid classes and the edges that a traveller of limited range can use."""

    name: str
    nodes: DataFrame
    edges: DataFrame
    valid_classes: list
    barrier_classes: list = field(default_factory=list)
    max_travel_distance: float = 0.0
    add_distance: bool = False


def reach(patch_cells: DataFrame, distance: float, grid: GridSpec) -> DataFrame:
    """``t, patch_id, row, col``: every cell within the distance of each patch (its own cells too).

    The patch's cells become spans of a row; each span is widened once for each
    row step, and cells are written out only after the spans of a row are joined,
    so the work grows with the radius, not with its square.
    """
    c0, c1 = ("c0", "c1") if are_runs(patch_cells) else ("col", "col")
    own = merged_spans(patch_cells.select("t", "patch_id", "row", F.col(c0).alias("c0"), F.col(c1).alias("c1")))
    return widened(own, distance, grid).select("t", "patch_id", "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def barrier_edges(patch_cells: DataFrame, valid: DataFrame, near: DataFrame, barrier_classes: list, distance: float, grid: GridSpec) -> DataFrame:
    """``t, src, dst``: those pairs ``near`` that are joined from either end around the barriers.

    The spans a source can reach, less the barriers, fall into fragments: spans
    of neighbouring rows that overlap hang together.  It gets to the targets that
    meet the fragment of its representative cell.  A target of a barrier class is
    never reached.  Only sources that have a pair and a barrier in reach are
    looked at; any other gets to all it is near.
    """
    barriers, key, width = list(barrier_classes), ["t", "patch_id"], bin_width(distance, grid)
    span = lambda df, p, *more: df.select("t", "row", *more, F.col("c0").alias(f"{p}0"), F.col("c1").alias(f"{p}1"))
    runs = materialize(patch_runs(patch_cells.where(F.col("class_label").isin(barriers))).select("t", "row", "c0", "c1"))
    pairs = near.select("t", "src", "dst")
    directed = pairs.unionByName(pairs.select("t", F.col("dst").alias("src"), F.col("src").alias("dst")))
    own = materialize(patch_runs(valid).join(directed.select("t", F.col("src").alias("patch_id")).distinct(), key, "left_semi"))
    around = materialize(widened(own.select(*key, "row", "c0", "c1"), distance, grid))
    walled = materialize(met_walls(around, runs, key, width))
    blocked = materialize(walled.select(*key).distinct())
    free = without(around.join(blocked, key, "left_semi"), runs, key, width, walled)
    # a source of a barrier class keeps its own cells: it is a node all the same
    kept = own.where(F.col("class_label").isin(barriers)).join(blocked, key, "left_semi").select(*key, "row", "c0", "c1")
    if not kept.isEmpty():  # else no two spans adjoin: walls stand between them
        free = merged_spans(free.unionByName(kept))
    free = materialize(free.withColumn("v", F.monotonically_increasing_id()))
    below = free.select(*key, (F.col("row") - 1).alias("row"), F.col("c0").alias("r0"), F.col("c1").alias("r1"), F.col("v").alias("dst"))
    links = overlapping(free.select(*key, "row", F.col("c0").alias("l0"), F.col("c1").alias("l1"), F.col("v").alias("src")), below, [*key, "row"], width)
    # a source's spans only meet one another: side by side they are settled before any round
    links = links.repartition(*key).sortWithinPartitions(*key)
    parts = connected_components(links.select("src", "dst"))
    free = materialize(free.join(parts, free["v"] == parts["node"], "left").select(*key, "row", "c0", "c1", F.coalesce("component", "v").alias("part")))
    row, col = grid_cell(grid)
    points = patch_table(valid.join(blocked, key, "left_semi"), grid).select(*key, row.alias("row"), col.alias("col"))
    home = free.join(points, [*key, "row"]).where("col between c0 and c1").select(*key, "part")
    region = span(free.join(home, [*key, "part"]).withColumnRenamed("patch_id", "one"), "l", "one")
    targets = patch_runs(valid.where(~F.col("class_label").isin(barriers))).withColumnRenamed("patch_id", "other")
    met = overlapping(region, span(targets, "r", "other"), ["t", "row"], width).where("one <> other").select("t", "one", "other")
    ends = targets.select("t", F.col("other").alias("dst")).distinct()
    open_pairs = directed.join(blocked.select("t", F.col("patch_id").alias("src")), ["t", "src"], "left_anti").join(ends, ["t", "dst"], "left_semi")
    found = met.unionByName(open_pairs.select("t", F.col("src").alias("one"), F.col("dst").alias("other")))
    return found.select("t", F.least("one", "other").alias("src"), F.greatest("one", "other").alias("dst")).distinct()


def grid_cell(grid: GridSpec):
    """Columns that give the cell of a patch's representative point."""
    det = grid.a * grid.e - grid.b * grid.d
    x, y = F.col("rep_x") - grid.c, F.col("rep_y") - grid.f
    return F.floor((grid.a * y - grid.d * x) / det).cast("long"), F.floor((grid.e * x - grid.b * y) / det).cast("long")


def add_habitat(patch_cells: DataFrame, grid: GridSpec, name: str, valid_classes: list, barrier_classes: list | None = None, max_travel_distance: float = 0.0, add_distance: bool = False) -> Habitat:
    """The habitat of all slices of a landscape at once."""
    if max_travel_distance < 0:
        raise ValueError("max_travel_distance must not be negative")
    valid = patch_cells.where(F.col("class_label").isin(list(valid_classes)))
    barriers = list(barrier_classes or [])
    if max_travel_distance == 0:
        edges = adjacency(valid).withColumn("distance", F.lit(0.0))
        if barriers:
            ends = valid.where(~F.col("class_label").isin(barriers)).select("t", "patch_id").distinct()
            near = edges.join(ends.select("t", F.col("patch_id").alias("src")), ["t", "src"], "left_semi")
            far = edges.join(ends.select("t", F.col("patch_id").alias("dst")), ["t", "dst"], "left_semi")
            edges = near.unionByName(far).distinct()
    else:
        edges = distance_edges(valid, max_travel_distance, grid)
        if barriers:
            edges = materialize(edges)
            edges = edges.join(barrier_edges(patch_cells, valid, edges, barriers, max_travel_distance, grid), ["t", "src", "dst"], "left_semi")
    nodes = valid.groupBy("t", "patch_id").agg(F.min("class_label").alias("class_label"), (cell_count(valid) * grid.cell_area).alias("area"))
    columns = ["t", "src", "dst"] + ["distance"] * add_distance
    return Habitat(name, nodes, edges.select(columns), list(valid_classes), barriers, max_travel_distance, add_distance)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``t, component_id, patch_id``; a component's id is its smallest patch id."""
    keyed = materialize(nodes.select("t", "patch_id").distinct().repartitionByRange("t", "patch_id").withColumn("v", F.monotonically_increasing_id()))
    end = lambda key, v: keyed.select("t", F.col("patch_id").alias(key), F.col("v").alias(v))
    pairs = edges.select("t", "src", "dst").join(dealt(end("src", "a")), ["t", "src"]).join(dealt(end("dst", "b")), ["t", "dst"])
    # ids go by place, and the upper bits of v tell the range: most of a component is settled where it lies, before any round
    found = connected_components(pairs.select("a", "b").repartition(F.shiftright("a", 33)), "a", "b")
    rows = keyed.join(dealt(found), keyed["v"] == found["node"], "left").select("t", "patch_id", F.coalesce("component", "v").alias("c"))
    least = rows.groupBy("t", "c").agg(F.min("patch_id").alias("component_id"))
    return rows.join(dealt(least), ["t", "c"]).select("t", "component_id", "patch_id")


def component_cells(members: DataFrame, patch_cells: DataFrame) -> DataFrame:
    """Cells of whole components, as patches of class -1."""
    cells = patch_cells.drop("class_label").join(dealt(members), ["t", "patch_id"]).withColumn("class_label", F.lit("-1"))
    return as_cells(cells.drop("patch_id").withColumnRenamed("component_id", "patch_id")).select("t", "patch_id", "row", "col", "class_label")


def component_table(members: DataFrame, patch_cells: DataFrame, grid: GridSpec) -> DataFrame:
    """The patch table of whole components: area, perimeter and bounds of the union of their patches, of class -1."""
    return patch_table(component_cells(members, patch_cells), grid).withColumnRenamed("patch_id", "component_id")


def component_reach(members: DataFrame, patch_cells: DataFrame, distance: float, grid: GridSpec) -> DataFrame:
    """``t, component_id, row, col``: every cell within the distance of each component."""
    return reach(component_cells(members, patch_cells), distance, grid).withColumnRenamed("patch_id", "component_id")


def component_runs(members: DataFrame, patch_cells: DataFrame) -> DataFrame:
    """``t, c, row, c0, c1``: the runs of whole components, cut where their patches end."""
    runs = patch_runs(patch_cells).select("t", "patch_id", "row", "c0", "c1").join(dealt(members), ["t", "patch_id"])
    return materialize(runs.select("t", F.col("component_id").alias("c"), "row", "c0", "c1"))


def component_pyramid(members: DataFrame, patch_cells: DataFrame) -> Pyramid:
    return Pyramid(component_cells(members, patch_cells).select("t", F.col("patch_id").alias("c"), "row", "col"))


def component_sets(members: DataFrame) -> DataFrame:
    """``t, c`` of the components, with a warning where a slice has more than ``MANY_COMPONENTS``."""
    sets = materialize(members.select("t", F.col("component_id").alias("c")).distinct())
    most = sets.groupBy("t").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if most and most > MANY_COMPONENTS:
        warnings.warn(f"distances of every two of {most} components are asked for", stacklevel=3)
    return sets


def sized_components(members: DataFrame, patch_cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The runs of the components; those of up to ``outlines.RUNS`` runs, and the larger ones (t, c, r0, n)."""
    runs = component_runs(members, patch_cells)
    sizes = materialize(runs.groupBy("t", "c").agg(F.min("row").alias("r0"), F.count("*").alias("n")))
    return runs, sizes.where(F.col("n") <= outlines.RUNS), sizes.where(F.col("n") > outlines.RUNS)


def component_distances(members: DataFrame, patch_cells: DataFrame, grid: GridSpec, tally: list[int] | None = None) -> DataFrame:
    """``t, src, dst, distance`` of every two components: the complete graph the contract asks for.

    The number of pairs is quadratic in the components by definition; beyond
    ``MANY_COMPONENTS`` in a slice a warning says so.  Components of up to
    ``outlines.RUNS`` runs meet in blocks, and no pair is ever stored.  What a
    pair with a larger one costs is bounded by branch and bound on pyramids of
    boxes; with ``tally``, which takes the pairs of boxes kept at each level, all
    pairs go that way.
    """
    sets = component_sets(members)
    side = (abs(grid.a), abs(grid.e))
    if tally is not None:
        return all_distances(component_pyramid(members, patch_cells), sets, *side, tally)
    runs, small, large = sized_components(members, patch_cells)
    near = block_distances(runs, small, *side)
    if large.isEmpty():
        return near
    return near.unionByName(all_distances(component_pyramid(members, patch_cells), sets, *side, some=large))


def distinct_distances(members: DataFrame, patch_cells: DataFrame, grid: GridSpec) -> DataFrame:
    """``t, distance``: the different distances of any two components of a slice, all that isolation takes."""
    sets, side = component_sets(members), (abs(grid.a), abs(grid.e))
    runs, small, large = sized_components(members, patch_cells)
    near = distinct_block_distances(runs, small, *side)
    if large.isEmpty():
        return near.distinct()
    far = all_distances(component_pyramid(members, patch_cells), sets, *side, some=large)
    return near.unionByName(far.select("t", "distance")).distinct()


def nearest_components(members: DataFrame, patch_cells: DataFrame, grid: GridSpec) -> DataFrame:
    """``t, component_id, distance`` to the nearest other component; none for the only one of a slice."""
    sets = materialize(members.select("t", F.col("component_id").alias("c")).distinct())
    near = nearest_distances(component_pyramid(members, patch_cells), sets, abs(grid.a), abs(grid.e))
    return near.select("t", F.col("src").alias("component_id"), "distance")


def apply_to_habitats(habitats: list[Habitat], fn: Callable[[Habitat], DataFrame]) -> DataFrame:
    """What ``fn`` gives for each habitat, in one table keyed by habitat."""
    if not callable(fn):
        raise ValueError("apply_to_habitats takes a function of a habitat")
    out = None
    for h in habitats:
        rows = fn(h).withColumn("habitat", F.lit(h.name))
        out = rows if out is None else out.unionByName(rows)
    return out

