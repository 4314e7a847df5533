"""Changing a patch graph: merging, removing and adding nodes, dense numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landmosaic.operators.adjacency import adjacency
from landmosaic.operators.habitat import components
from landmosaic.operators.patches import are_runs
from landmosaic.operators.spans import merged_spans
from landmosaic.storage import materialize


def relabel(patch_cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cells or runs under the new patch ids (and classes) of ``mapping`` (t, patch_id, new_id, new_class); runs that adjoin under one id become one."""
    place = ["c0", "c1"] if are_runs(patch_cells) else ["col"]
    rows = patch_cells.join(mapping, ["t", "patch_id"], "left")
    rows = rows.select("t", F.coalesce("new_id", "patch_id").alias("patch_id"), "row", *place, F.coalesce("new_class", "class_label").alias("class_label"))
    return merged_spans(rows, "t", "patch_id", "class_label") if are_runs(patch_cells) else rows


def relabel_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    end = lambda key, new: mapping.select("t", F.col("patch_id").alias(key), F.col("new_id").alias(new))
    rows = edges.select("t", "src", "dst").join(end("src", "a"), ["t", "src"], "left").join(end("dst", "b"), ["t", "dst"], "left")
    rows = rows.select("t", F.coalesce("a", "src").alias("u"), F.coalesce("b", "dst").alias("v")).where("u <> v")
    return rows.select("t", F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct()


def merge_nodes(patch_cells: DataFrame, edges: DataFrame, t, node_list: list[int], class_label: str, final_index: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One node of ``class_label`` in place of those listed, with their neighbours; unknown ids are ignored.

    The new node's id is ``final_index``, or else one more than the largest.
    """
    here = patch_cells.where(F.col("t") == t)
    found = [r[0] for r in here.where(F.col("patch_id").isin(list(node_list))).select("patch_id").distinct().collect()]  # no more than the caller listed
    if not found:
        raise ValueError("none of these nodes exists")
    if final_index is None:
        final_index = here.agg(F.max("patch_id")).first()[0] + 1
    elif final_index not in found and not here.where(F.col("patch_id") == final_index).isEmpty():
        raise ValueError(f"node {final_index} exists already")
    gone = (F.col("t") == t) & F.col("patch_id").isin(found)
    mapping = patch_cells.where(gone).select("t", "patch_id").distinct().withColumn("new_id", F.lit(final_index).cast("long")).withColumn("new_class", F.lit(class_label))
    return relabel(patch_cells, mapping), relabel_edges(edges, mapping)


def unknown_classes(patches: DataFrame, class_list: list) -> DataFrame:
    """``class_label``: those of the list that no patch or cell has."""
    asked = patches.sparkSession.createDataFrame([(str(c),) for c in dict.fromkeys(class_list)], "class_label string")
    return asked.join(patches.select("class_label").distinct(), "class_label", "left_anti")


def require_classes(patches: DataFrame, class_list: list) -> list[str]:
    """The labels as strings, all of which must occur."""
    if missing := sorted(r[0] for r in unknown_classes(patches, class_list).collect()):  # no more than the caller listed
        raise ValueError(f"unknown classes: {missing}")
    return [str(c) for c in class_list]


def touching_groups(patches: DataFrame, edges: DataFrame, labels: list[str], new_name: str) -> DataFrame:
    """``t, patch_id, new_id, new_class`` of the patches of these classes and the new one; those that hang together get the smallest id among them."""
    inside = patches.where(F.col("class_label").isin([*labels, new_name])).select("t", "patch_id").distinct()
    end = lambda key: inside.select("t", F.col("patch_id").alias(key))
    groups = components(inside, edges.join(end("src"), ["t", "src"], "left_semi").join(end("dst"), ["t", "dst"], "left_semi"))
    return groups.select("t", "patch_id", F.col("component_id").alias("new_id"), F.lit(new_name).alias("new_class"))


def merge_classes(patch_cells: DataFrame, class_list: list, new_name: str, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes under one name, with touching patches of that name made one; cells (or runs, if those are given) and edges.

    A merged patch has the smallest id of its members.  ``edges`` are those of
    the patches as they are, computed where they are not given; the new ones
    follow from them.
    """
    labels = require_classes(patch_cells, class_list)
    known = materialize(adjacency(patch_cells)) if edges is None else edges
    mapping = materialize(touching_groups(patch_cells, known, labels, new_name))
    return relabel(patch_cells, mapping), relabel_edges(known, mapping)


def contract(patches: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patch table and edges after patches became others, from these tables alone.

    ``edges`` carry ``border``, the length two patches run together;
    ``mapping`` is (t, patch_id, new_id, new_class).  A perimeter is the sum of
    the members' less twice the borders inside; the representative point is that
    of the largest member.
    """
    names = materialize(mapping.select("t", "patch_id", "new_id", "new_class"))
    end = lambda key, new: names.select("t", F.col("patch_id").alias(key), F.col("new_id").alias(new))
    ends = edges.join(end("src", "a"), ["t", "src"], "left").join(end("dst", "b"), ["t", "dst"], "left")
    ends = materialize(ends.select("t", F.coalesce("a", "src").alias("u"), F.coalesce("b", "dst").alias("v"), "border"))
    inner = ends.where("u = v").groupBy("t", F.col("u").alias("id")).agg(F.sum("border").alias("inner"))
    rows = patches.join(names, ["t", "patch_id"], "left").withColumn("id", F.coalesce("new_id", "patch_id")).withColumn("label", F.coalesce("new_class", "class_label"))
    largest = F.max(F.struct("n_cells", (-F.col("patch_id")).alias("order"), "rep_x", "rep_y"))
    sums = [F.min("label").alias("class_label"), *[F.sum(c).alias(c) for c in ("n_cells", "area", "perimeter")], *[f(c).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]]
    merged = rows.groupBy("t", "id").agg(*sums, largest.alias("rep")).join(inner, ["t", "id"], "left")
    perimeter = F.col("perimeter") - 2 * F.coalesce("inner", F.lit(0.0))
    table = merged.select("t", F.col("id").alias("patch_id"), "class_label", "n_cells", "area", perimeter.alias("perimeter"), "xmin", "ymin", "xmax", "ymax", "rep.rep_x", "rep.rep_y")
    left = ends.where("u <> v").groupBy("t", F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).agg(F.sum("border").alias("border"))
    return table, left


def merge_classes_of_graph(patches: DataFrame, edges: DataFrame, class_list: list, new_name: str) -> tuple[DataFrame, DataFrame]:
    """``merge_classes`` by contraction of the graph: the patch table and edges (with ``border``) it leads to, without reading a cell."""
    labels = require_classes(patches, class_list)
    return contract(patches, edges, touching_groups(patches, edges, labels, new_name))


def remove_nodes(patch_cells: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the patches in ``gone`` (t, patch_id) and their edges."""
    end = lambda key: gone.select("t", F.col("patch_id").alias(key))
    return patch_cells.join(gone, ["t", "patch_id"], "left_anti"), edges.join(end("src"), ["t", "src"], "left_anti").join(end("dst"), ["t", "dst"], "left_anti")


def add_nodes(patches: DataFrame, edges: DataFrame, rows: DataFrame, neighbours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """With more rows of the patch table (columns they lack are null) and edges (t, src, dst)."""
    if not rows.select("t", "patch_id").join(patches.select("t", "patch_id"), ["t", "patch_id"], "left_semi").isEmpty():
        raise ValueError("a node of that id exists already")
    new = neighbours.where("src <> dst").select("t", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return patches.unionByName(rows, allowMissingColumns=True), edges.select("t", "src", "dst").unionByName(new).distinct()


def numbered(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """Adds ``name``, 0..n-1 within each ``by``, in the order given.

    Rows are dealt into ranges and counted; a range's first number is what the
    ranges before it hold, so no task ever sorts more than its range.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    sort = [c.alias(f"_order{i}") for i, c in enumerate(columns)]
    keyed = df.select("*", *sort).repartitionByRange(*by, *[f"_order{i}" for i in range(len(sort))])
    placed = materialize(keyed.withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    sizes = sizes.select(*by, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*[f"_order{i}" for i in range(len(sort))])) - 1
    out = placed.withColumn("_within", within).join(sizes, [*by, "_range"])
    return out.select(*df.columns, (F.col("_before") + F.col("_within")).alias(name))


def dense_ids(patches: DataFrame) -> DataFrame:
    """Adds ``node_index`` 0..n-1 of each slice, in the order of the ids."""
    return numbered(patches, ["t"], ["patch_id"], "node_index")
