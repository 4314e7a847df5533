"""Patches of a landscape: connected cells of one class.

Cells become runs first (maximal stretches of one class in a row), so the graph
whose components are the patches has runs, not cells, as vertices.  All keys
hold ``t``: a single slice is a timeline of one.  Operators on patches take cells
``t, patch_id, row, col, class_label`` or their runs, with ``c0, c1`` for ``col``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from landmosaic.components import FOREST_EDGES, connected_components, forest
from landmosaic.grid import GridSpec
from landmosaic.operators.meetings import BAND, meetings
from landmosaic.storage import materialize, stored

#: Vertex numbers hold slice, row and column in so many bits.
PLACE = 24
#: Columns of a bin in which runs meet.
BIN = 256


def runs(cells: DataFrame, width: int = 1 << PLACE) -> DataFrame:
    """``t, class_label, row, c0, c1, vertex`` of the runs, dealt out by bands of rows; slices are numbered by time.

    A row or column that the vertex number or the grid's width can't hold is an error.
    """
    w = Window.partitionBy("t", "band", "row").orderBy("col")
    fresh = F.coalesce((F.lag("col").over(w) != F.col("col") - 1) | (F.lag("class_label").over(w) != F.col("class_label")), F.lit(True))
    c0 = F.last(F.when(fresh, F.col("col")), ignorenulls=True).over(w)
    found = cells.select("t", "row", "col", "class_label", F.floor(F.col("row") / BAND).alias("band")).where("class_label is not null")
    found = found.repartition("t", "band").distinct()  # the one time that cells move
    found = found.withColumn("c0", c0).groupBy("t", "band", "class_label", "row", "c0").agg(F.max("col").alias("c1"))
    slices = cells.select("t").distinct().select("t", (F.row_number().over(Window.orderBy("t")) - 1).cast("long").alias("k"))
    fits = (F.col("row") >= 0) & (F.col("row") < 1 << PLACE) & (F.col("c0") >= 0) & (F.col("c1") < min(width, 1 << PLACE)) & (F.col("k") < 1 << (63 - 2 * PLACE))
    vertex = F.shiftleft("k", 2 * PLACE).bitwiseOR(F.shiftleft(F.col("row").cast("long"), PLACE)).bitwiseOR(F.col("c0").cast("long"))
    vertex = F.when(fits, vertex).otherwise(F.raise_error(F.lit(f"rows must lie in [0, 2^{PLACE}), columns in [0, {min(width, 1 << PLACE)}), the grid's width")))
    return found.join(F.broadcast(slices), "t").select("t", "class_label", "row", "c0", "c1", vertex.alias("vertex"))


def group_roots(vertex: np.ndarray, c1: np.ndarray, code: np.ndarray, reach: int) -> np.ndarray:
    """The smallest vertex that each run hangs together with, of runs in the order of their vertices; ``code`` tells their classes."""
    mask = (1 << PLACE) - 1
    line, c0 = vertex >> PLACE, vertex & mask
    below = (line + 1) << PLACE
    low = np.searchsorted((line << PLACE) + c1, below + np.maximum(c0 - reach, 0))
    high = np.searchsorted(vertex, below + np.minimum(c1 + reach, mask), side="right")
    n = np.where((line + 1) & mask, np.maximum(high - low, 0), 0)  # nothing lies below the last row
    one = np.repeat(np.arange(len(vertex)), n)
    other = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    same = code[one] == code[other]
    nodes, roots = forest(one[same], other[same])
    root = np.arange(len(vertex))
    root[nodes] = roots
    return vertex[root]


def rooted(one: DataFrame, reach: int) -> DataFrame:
    """The runs with ``root``, the smallest vertex of those they hang together with in their band.

    ``opens`` and ``closes`` tell the rows above and below which a patch may go
    on elsewhere, ``loose`` the runs whose root has a run there.  A band of more than ``FOREST_EDGES`` runs is cut between rows.
    """

    def labelled(held: pa.Table) -> Iterator[pa.RecordBatch]:
        vertex, c1 = (held.column(c).to_numpy().astype(np.int64) for c in ("vertex", "c1"))
        code = pc.dictionary_encode(held.column("class_label").combine_chunks()).indices.to_numpy(zero_copy_only=False)
        line = vertex >> PLACE
        opens, closes = (line % BAND == 0) | (line == line[0]), (line % BAND == BAND - 1) | (line == line[-1])
        root = group_roots(vertex, c1, code, reach)
        loose = np.isin(root, root[opens | closes])
        for name, values in (("root", root), ("opens", opens), ("closes", closes), ("loose", loose)):
            held = held.append_column(name, pa.array(values))
        yield from held.to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            parts.append(batch)
            n += batch.num_rows
            if n >= FOREST_EDGES:
                held = pa.Table.from_batches(parts).combine_chunks()
                line = held.column("vertex").to_numpy() >> PLACE
                if last := int(np.searchsorted(line, line[-1])):
                    yield from labelled(held.slice(0, last))
                parts = held.slice(last).to_batches()
                n = held.num_rows - last
        if n:
            yield from labelled(pa.Table.from_batches(parts))

    fields = StructType(one.schema.fields).add("root", "long").add("opens", "boolean").add("closes", "boolean").add("loose", "boolean")
    return one.sortWithinPartitions("vertex").mapInArrow(run, fields)


def touching_runs(upper: DataFrame, lower: DataFrame, reach: int) -> DataFrame:
    """``src, dst``: roots of runs of one class in neighbouring rows that overlap, or nearly so with ``reach`` 1."""
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / BIN), F.floor(high / BIN)))
    up = upper.select("t", "class_label", "row", F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("root").alias("src"), bins(F.col("c0") - reach, F.col("c1") + reach).alias("bin"))
    down = lower.select("t", "class_label", (F.col("row") - 1).alias("row"), F.col("c0").alias("b0"), F.col("c1").alias("b1"), F.col("root").alias("dst"), bins(F.col("c0"), F.col("c1")).alias("bin"))
    both = up.join(down, ["t", "class_label", "row", "bin"]).where((F.col("a0") <= F.col("b1") + reach) & (F.col("b0") <= F.col("a1") + reach))
    return both.select("src", "dst")


def label_runs(cells: DataFrame, grid: GridSpec, connectivity: int = 4) -> DataFrame:
    """``t, patch_id, class_label, row, c0, c1``: the runs of the patches; a patch's id is its smallest ``row * width + col``.

    Runs are labelled within bands where they lie; only what meets across the
    borders of bands goes through rounds of the distributed algorithm.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    reach = 0 if connectivity == 4 else 1
    one = materialize(rooted(runs(cells, grid.width), reach))
    found = connected_components(touching_runs(one.where("closes"), one.where("opens"), reach))
    mask = (1 << PLACE) - 1
    # what lies within its band has its patch already and needn't move
    settled = one.where("not loose").withColumn("component", F.col("root"))
    moved = one.where("loose").join(found, F.col("root") == F.col("node"), "left").select(*one.columns, F.coalesce("component", "root").alias("component"))
    root = F.col("component")
    patch = F.shiftright(root, PLACE).bitwiseAND(F.lit(mask)) * grid.width + root.bitwiseAND(F.lit(mask))
    return settled.unionByName(moved).select("t", patch.alias("patch_id"), "class_label", "row", "c0", "c1")


def run_cells(patch_runs: DataFrame) -> DataFrame:
    """``t, patch_id, row, col, class_label`` of runs."""
    return patch_runs.select("t", "patch_id", "row", F.explode(F.sequence("c0", "c1")).alias("col"), "class_label")


def label_patches(cells: DataFrame, grid: GridSpec, connectivity: int = 4) -> DataFrame:
    """``t, patch_id, row, col, class_label``; a patch's id is its smallest ``row * width + col``."""
    return run_cells(label_runs(cells, grid, connectivity))


def are_runs(patch_cells: DataFrame) -> bool:
    """Whether patches come as runs (c0, c1) already, and not as cells (col)."""
    return "c0" in patch_cells.columns


def cell_count(patch_cells: DataFrame) -> Column:
    """The aggregate that counts the cells of a table of cells or runs."""
    return F.sum(F.col("c1") - F.col("c0") + 1) if are_runs(patch_cells) else F.count("*")


def as_cells(patch_cells: DataFrame) -> DataFrame:
    """Cells of a table of cells or runs."""
    return run_cells(patch_cells) if are_runs(patch_cells) else patch_cells


def stored_runs(patch_cells: DataFrame) -> DataFrame:
    """The runs of the patches as a stored table; runs that are stored are taken as they are."""
    return stored(patch_cells if are_runs(patch_cells) else patch_runs(patch_cells))


def patch_runs(patch_cells: DataFrame) -> DataFrame:
    """``t, patch_id, class_label, row, c0, c1``: stretches of cells of one patch; those that come as runs are taken as they are."""
    if are_runs(patch_cells):
        return patch_cells
    w = Window.partitionBy("t", "row").orderBy("col")
    fresh = F.coalesce((F.lag("col").over(w) != F.col("col") - 1) | (F.lag("patch_id").over(w) != F.col("patch_id")), F.lit(True))
    c0 = F.last(F.when(fresh, F.col("col")), ignorenulls=True).over(w)
    return patch_cells.withColumn("c0", c0).groupBy("t", "patch_id", "row", "c0").agg(F.max("col").alias("c1"), F.min("class_label").alias("class_label"))


def inner_sides(one: DataFrame) -> DataFrame:
    """``t, patch_id, inner``: cells of a patch that stand above another of its cells."""
    return meetings(one, inside=True).groupBy("t", F.col("one").alias("patch_id")).agg(F.sum("shared").alias("inner"))


def patch_table(patch_cells: DataFrame, grid: GridSpec) -> DataFrame:
    """``t, patch_id, class_label, n_cells, area, perimeter, xmin, ymin, xmax, ymax, rep_x, rep_y``.

    Everything follows from the runs of a patch: sides from their ends and from
    what lies under them, the representative point, which is the centre of the
    patch's cell nearest its centroid, from the nearest cell of each run.  Sides
    are counted for axis-aligned grids.
    """
    one = stored_runs(patch_cells)
    n = F.col("c1") - F.col("c0") + 1
    agg = one.groupBy("t", "patch_id").agg(
        F.min("class_label").alias("class_label"), F.sum(n).alias("n_cells"), (2 * F.count("*")).alias("v"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("c0").alias("k0"), F.max("c1").alias("k1"),
        (F.sum(F.col("row") * n) / F.sum(n)).alias("row_mean"), (F.sum((F.col("c0") + F.col("c1")) * n) / 2 / F.sum(n)).alias("col_mean"),
    )
    near = one.join(agg.select("t", "patch_id", "row_mean", "col_mean"), ["t", "patch_id"])
    nearest = [F.greatest("c0", F.least("c1", f("col_mean").cast("long"))) for f in (F.floor, F.ceil)]
    off = lambda c: F.round((F.col("row") - F.col("row_mean")) ** 2 + (c - F.col("col_mean")) ** 2, 9)
    near = near.groupBy("t", "patch_id").agg(F.min(F.least(*[F.struct(off(c).alias("off"), F.col("row").alias("row"), c.alias("col")) for c in nearest])).alias("rep"))
    agg = agg.join(inner_sides(one), ["t", "patch_id"], "left").withColumn("h", 2 * (F.col("n_cells") - F.coalesce("inner", F.lit(0))))
    x = [grid.x(F.col(c) + i, F.col(r) + j) for c, i in (("k0", 0), ("k1", 1)) for r, j in (("r0", 0), ("r1", 1))]
    y = [grid.y(F.col(c) + i, F.col(r) + j) for c, i in (("k0", 0), ("k1", 1)) for r, j in (("r0", 0), ("r1", 1))]
    u, v = F.col("rep.col") + 0.5, F.col("rep.row") + 0.5
    return agg.join(near, ["t", "patch_id"]).select(
        "t", "patch_id", "class_label", "n_cells", (F.col("n_cells") * grid.cell_area).alias("area"), (F.col("h") * abs(grid.a) + F.col("v") * abs(grid.e)).alias("perimeter"),
        F.least(*x).alias("xmin"), F.least(*y).alias("ymin"), F.greatest(*x).alias("xmax"), F.greatest(*y).alias("ymax"), grid.x(u, v).alias("rep_x"), grid.y(u, v).alias("rep_y"),
    )


def patch_metrics(patches: DataFrame) -> DataFrame:
    """Adds perimeter_area_ratio, shape_index and fractal_dimension (null where ln area is 0)."""
    p, a = F.col("perimeter"), F.col("area")
    fractal = F.try_divide(2 * F.ln(0.25 * p), F.ln(a))
    return patches.withColumn("perimeter_area_ratio", F.try_divide(p, a)).withColumn("shape_index", F.try_divide(0.25 * p, F.sqrt(a))).withColumn("fractal_dimension", fractal)
