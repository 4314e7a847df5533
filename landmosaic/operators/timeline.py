"""Patches through time: node maps, dynamics, growth and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landmosaic.grid import GridSpec
from landmosaic.operators.patches import stored_runs
from landmosaic.operators.spans import overlapping

#: Row steps from a run to those it is in contact with, and how many columns beyond its ends count.
CONTACT = {"interior": ((0, 0),), "edge": ((0, 1), (-1, 0), (1, 0)), "corner": ((0, 1), (-1, 1), (1, 1))}


def stack_slices(slices: dict) -> DataFrame:
    """One table of several slices, with their time in ``t``."""
    if not isinstance(slices, dict) or not slices:
        raise NotImplementedError("a timeline is made of a dict from time to table")
    return reduce(DataFrame.unionByName, [df.withColumn("t", F.lit(t)) for t, df in sorted(slices.items())])


def slice_at(table: DataFrame, t) -> DataFrame:
    out = table.where(F.col("t") == t)
    if out.isEmpty():
        raise KeyError(t)
    return out


def times(table: DataFrame) -> DataFrame:
    """``t, previous_t, next_t`` of every slice."""
    w = Window.orderBy("t")
    return table.select("t").distinct().select("t", F.lag("t").over(w).alias("previous_t"), F.lead("t").over(w).alias("next_t"))


def previous_time(table: DataFrame, t):
    """The time of the slice before ``t``; the first slice has none, which is an error."""
    found = times(table).where(F.col("t") == t).first()
    if found is None:
        raise KeyError(t)
    if found.previous_t is None:
        raise UserWarning(f"{t} is the first slice, so nothing comes before it")
    return found.previous_t


def node_map(patch_cells: DataFrame, mode: str = "interior", grid: GridSpec | None = None) -> DataFrame:
    """``t0, t1, src_id, trg_id, overlap_area`` between every two neighbouring slices.

    Patches of one class are identified where they share a cell (interior), or
    also an edge, or also a corner; their runs meet, not their cells.
    """
    if mode not in CONTACT:
        raise ValueError(f"mode is one of {sorted(CONTACT)}")
    runs = stored_runs(patch_cells)
    old = runs.join(times(runs).where("next_t is not null").select("t", F.col("next_t").alias("t1")), "t")
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(w).alias("w")) for r, w in CONTACT[mode]]))
    old = old.select(F.col("t").alias("t0"), "t1", "class_label", F.col("patch_id").alias("src_id"), "row", "c0", "c1", steps.alias("step"))
    old = old.select("t0", "t1", "class_label", "src_id", (F.col("row") + F.col("step.dr")).alias("row"), "step.dr", "c0", "c1", (F.col("c0") - F.col("step.w")).alias("l0"), (F.col("c1") + F.col("step.w")).alias("l1"))
    new = runs.select(F.col("t").alias("t1"), "class_label", "row", F.col("patch_id").alias("trg_id"), F.col("c0").alias("r0"), F.col("c1").alias("r1"))
    met = overlapping(old, new, ["t1", "row", "class_label"])
    shared = F.when(F.col("dr") == 0, F.greatest(F.least("c1", "r1") - F.greatest("c0", "r0") + 1, F.lit(0))).otherwise(0)
    area = (grid or GridSpec()).cell_area
    return met.groupBy("t0", "t1", "src_id", "trg_id").agg((F.sum(shared) * area).alias("overlap_area"))


def identify_node(mapping: DataFrame, t0, src_id: int) -> DataFrame:
    return mapping.where((F.col("t0") == t0) & (F.col("src_id") == src_id)).select("trg_id")


def invert(mapping: DataFrame) -> DataFrame:
    return mapping.select(F.col("t1").alias("t0"), F.col("t0").alias("t1"), F.col("trg_id").alias("src_id"), F.col("src_id").alias("trg_id"), "overlap_area")


def mapping_lists(mapping: DataFrame, patches: DataFrame) -> DataFrame:
    """``t0, src_id, targets``: every source node with its sorted targets, an empty list for none."""
    lists = mapping.groupBy("t0", "src_id").agg(F.sort_array(F.collect_list("trg_id")).alias("targets"))
    nodes = patches.select(F.col("t").alias("t0"), F.col("patch_id").alias("src_id"))
    nodes = nodes.join(mapping.select("t0").distinct(), "t0", "left_semi")
    return nodes.join(lists, ["t0", "src_id"], "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<bigint>")))


def same_mapping(one: DataFrame, other: DataFrame) -> bool:
    keys = ["t0", "t1", "src_id", "trg_id"]
    return one.select(keys).exceptAll(other.select(keys)).isEmpty() and other.select(keys).exceptAll(one.select(keys)).isEmpty()


def dynamics(mapping: DataFrame, patches: DataFrame) -> DataFrame:
    """``t, patch_id, node_dynamic, relative_growth, absolute_growth`` of every patch but the first slice's.

    ``mapping`` is an interior node map.  Growth compares a patch with the whole
    areas of all its ancestors.
    """
    children = mapping.groupBy("t0", "src_id").agg(F.count("*").alias("children"))
    area = patches.select(F.col("t").alias("t0"), F.col("patch_id").alias("src_id"), F.col("area").alias("before"))
    back = mapping.join(children, ["t0", "src_id"]).join(area, ["t0", "src_id"])
    back = back.groupBy(F.col("t1").alias("t"), F.col("trg_id").alias("patch_id")).agg(F.count("*").alias("ancestors"), F.max("children").alias("children"), F.sum("before").alias("before"))
    later = patches.select("t", "patch_id", "area").join(times(patches).where("previous_t is not null").select("t"), "t", "left_semi")
    rows = later.join(back, ["t", "patch_id"], "left").fillna({"ancestors": 0, "before": 0.0})
    growth = F.try_divide(F.col("area") - F.col("before"), F.col("area") + F.col("before"))
    kind = (
        F.when(F.col("ancestors") == 0, "birth")
        .when((F.col("ancestors") == 1) & (F.col("children") > 1), "split")
        .when((F.col("ancestors") == 1) & (growth > 0), "grew")
        .when((F.col("ancestors") == 1) & (growth < 0), "shrank")
        .when(F.col("ancestors") == 1, "unchanged")
        .when(F.col("children") > 1, "complex")
        .otherwise("merged")
    )
    return rows.select("t", "patch_id", kind.alias("node_dynamic"), growth.alias("relative_growth"), (F.col("area") - F.col("before")).alias("absolute_growth"))


def dynamics_count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("t", "node_dynamic").agg(F.count("*").alias("n"))


def deaths(mapping: DataFrame, patches: DataFrame) -> DataFrame:
    """``t, patch_id`` of patches without a successor in the next slice."""
    open_ = patches.select("t", "patch_id").join(times(patches).where("next_t is not null").select("t"), "t", "left_semi")
    return open_.join(mapping.select(F.col("t0").alias("t"), F.col("src_id").alias("patch_id")).distinct(), ["t", "patch_id"], "left_anti")


def polygon_diff(mapping: DataFrame, patches: DataFrame) -> DataFrame:
    """``t0, src_id, removed_area, added_area`` between a patch and the union of its targets.

    Targets of one slice do not overlap, so areas settle it; a patch without
    targets loses all of itself and gains nothing.
    """
    target = patches.select(F.col("t").alias("t1"), F.col("patch_id").alias("trg_id"), F.col("area").alias("after"))
    sums = mapping.join(target, ["t1", "trg_id"]).groupBy("t0", "src_id").agg(F.sum("after").alias("after"), F.sum("overlap_area").alias("common"))
    nodes = patches.select(F.col("t").alias("t0"), F.col("patch_id").alias("src_id"), "area").join(times(patches).where("next_t is not null").select(F.col("t").alias("t0")), "t0", "left_semi")
    rows = nodes.join(sums, ["t0", "src_id"], "left").fillna(0.0, ["after", "common"])
    return rows.select("t0", "src_id", (F.col("area") - F.col("common")).alias("removed_area"), (F.col("after") - F.col("common")).alias("added_area"))


def polygon_diff_cells(mapping: DataFrame, patch_cells: DataFrame) -> DataFrame:
    """``t0, src_id, row, col, change``: the cells added to and removed from each patch."""
    src = patch_cells.select(F.col("t").alias("t0"), F.col("patch_id").alias("src_id"), "row", "col")
    src = src.join(times(patch_cells).where("next_t is not null").select(F.col("t").alias("t0")), "t0", "left_semi")
    trg = mapping.select("t0", "t1", "src_id", "trg_id").join(patch_cells.select(F.col("t").alias("t1"), F.col("patch_id").alias("trg_id"), "row", "col"), ["t1", "trg_id"])
    keys = ["t0", "src_id", "row", "col"]
    added = trg.select(keys).join(src, keys, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(src.join(trg.select(keys), keys, "left_anti").withColumn("change", F.lit("removed")))


def dynamics_table(rows: DataFrame, patches_with_metrics: DataFrame) -> DataFrame:
    """Dynamics beside the patch metrics."""
    return patches_with_metrics.join(rows, ["t", "patch_id"], "left")
