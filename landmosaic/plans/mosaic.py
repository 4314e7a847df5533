"""Registered landscape queries and their SQL oracles.

Every query derives its landscape from the supplied tables (``fixtures``) and
runs over all of it; inexact numbers are rounded to six places on both sides.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmosaic.functions import columns
from landmosaic.grid import GridSpec, clip, masked, resample_nearest, sub_window, thumbnail, world_coordinates
from landmosaic.operators import adjacency, edits, habitat, metrics, patches, timeline, vector
from landmosaic.plans.fixtures import BLOCKS_SQL, COLUMNS_SQL, EDGES_SQL, GRID, PATCHES_SQL, RECTANGLES_SQL, REGION, TIMES, WIDTH, blocks, cells, cells_sql, groups_sql, labels_sql, many_sided, merged_sql, table, vector_patches
from landmosaic.storage import materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

BASE = f"WITH RECURSIVE {cells_sql()}, {labels_sql()}"
TURN = f"WITH RECURSIVE {cells_sql(True)}, {labels_sql()}"
FIRST = TIMES[0]
#: Classes of the habitat.
VALID = ["SMALL", "LARGE"]


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def labelled_runs(spark: SparkSession, sf_dir: str, rotating: bool = False) -> DataFrame:
    return materialize(patches.label_runs(cells(spark, sf_dir, rotating), GRID))


def labelled(spark: SparkSession, sf_dir: str, rotating: bool = False) -> DataFrame:
    return patches.run_cells(labelled_runs(spark, sf_dir, rotating))


def patch_rows(spark: SparkSession, sf_dir: str, rotating: bool = False) -> DataFrame:
    return patches.patch_metrics(patches.patch_table(labelled_runs(spark, sf_dir, rotating), GRID))


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" and c not in keep else F.col(c) for c, kind in df.dtypes])


# --- patches and metrics -------------------------------------------------------


@query(f"""{BASE}, {PATCHES_SQL}, near AS (SELECT pc.t, pc.patch_id, pc.row, pc.col, row_number() OVER (PARTITION BY pc.t, pc.patch_id ORDER BY round((pc.row - mr) * (pc.row - mr) + (pc.col - mc) * (pc.col - mc), 9), pc.row, pc.col) AS k FROM pc JOIN patches USING (t, patch_id))
SELECT t, patch_id, class_label, n_cells, area, perimeter, xmin, ymin, xmax, ymax, col * 30.0::DOUBLE + 15 AS rep_x, row * -30.0::DOUBLE - 15 AS rep_y FROM patches JOIN near USING (t, patch_id) WHERE k = 1""")
def patch_table(spark, sf_dir):
    return patches.patch_table(labelled_runs(spark, sf_dir), GRID)


@query(f"{BASE}, {PATCHES_SQL} SELECT t, patch_id, round(perimeter_area_ratio, 6) AS perimeter_area_ratio, round(shape_index, 6) AS shape_index, round(fractal_dimension, 6) AS fractal_dimension FROM ratios")
def patch_metrics(spark, sf_dir):
    return rounded(patch_rows(spark, sf_dir).select("t", "patch_id", "perimeter_area_ratio", "shape_index", "fractal_dimension"))


CLASS_SQL = f"""{BASE}, {PATCHES_SQL}, whole AS (SELECT t, sum(area) AS a FROM patches GROUP BY t),
cm AS (SELECT t, class_label, count(*) AS num_patches, round(avg(area), 6) AS avg_patch_area, sum(area) AS total_area, round(sum(area) / any_value(a), 6) AS proportion_of_landscape, round(count(*) / any_value(a), 6) AS patch_density,
  round(max(area) / any_value(a), 6) AS largest_patch_index, sum(perimeter) AS total_edge, round(sum(perimeter) / sum(area), 6) AS edge_density, round(0.25 * sum(perimeter) / sqrt(sum(area)), 6) AS shape_index, round(sum(area * area) / any_value(a), 6) AS effective_mesh_size
  FROM patches JOIN whole USING (t) GROUP BY t, class_label)"""


@query(f"{CLASS_SQL} SELECT * FROM cm")
def class_metrics(spark, sf_dir):
    return rounded(metrics.class_metrics(patch_rows(spark, sf_dir)))


@query(f"{CLASS_SQL} SELECT t, class_label, total_area, edge_density FROM cm WHERE class_label IN ('URBAN', 'SMALL')")
def class_metrics_subset(spark, sf_dir):
    return rounded(metrics.class_metrics(patch_rows(spark, sf_dir), ["URBAN", "SMALL"]).select("t", "class_label", "total_area", "edge_density"))


@query(f"""{BASE}, {PATCHES_SQL}, shares AS (SELECT t, sum(area) / sum(sum(area)) OVER (PARTITION BY t) AS p FROM patches GROUP BY t, class_label),
d AS (SELECT t, round(-sum(p * ln(p)), 6) AS shannon_diversity_index, round(1 - sum(p * p), 6) AS simpson_diversity_index FROM shares GROUP BY t)
SELECT t, count(*) AS num_patches, round(avg(area), 6) AS avg_patch_area, sum(area) AS total_area, round(1 / avg(area), 6) AS patch_density, round(max(area) / sum(area), 6) AS largest_patch_index, any_value(shannon_diversity_index) AS shannon_diversity_index, any_value(simpson_diversity_index) AS simpson_diversity_index FROM patches JOIN d USING (t) GROUP BY t""")
def landscape_metrics(spark, sf_dir):
    return rounded(metrics.landscape_metrics(patch_rows(spark, sf_dir)))


NAMES = ("area", "perimeter", "perimeter_area_ratio", "shape_index", "fractal_dimension")


@query(f"{BASE}, {PATCHES_SQL} SELECT t, class_label, {', '.join(f'round(avg({n}), 6) AS {n}' for n in NAMES)} FROM ratios GROUP BY t, class_label")
def patch_metric_mean(spark, sf_dir):
    return rounded(metrics.patch_aggregates(patch_rows(spark, sf_dir)))


@query(f"{BASE}, {PATCHES_SQL} SELECT t, class_label, {', '.join(f'round(stddev_samp({n}), 6) AS {n}' for n in NAMES)} FROM ratios GROUP BY t, class_label")
def patch_metric_std(spark, sf_dir):
    return rounded(metrics.patch_aggregates(patch_rows(spark, sf_dir), "std"))


@query(f"{BASE}, {PATCHES_SQL} SELECT t, class_label, CAST(floor(area / 4500) AS BIGINT) AS bucket, count(*) AS n FROM ratios GROUP BY ALL")
def metric_histogram(spark, sf_dir):
    return metrics.histogram(patch_rows(spark, sf_dir), "area", 4500.0)


@query(f"""{BASE.replace("FROM orders JOIN", "FROM (SELECT * FROM orders WHERE o_orderkey % 7 <> 0 OR year(o_orderdate) < 1998) JOIN")}, {PATCHES_SQL}, slots AS (SELECT * FROM (SELECT DISTINCT t FROM patches), (SELECT DISTINCT class_label FROM patches))
SELECT s.t, s.class_label, CAST(count(area) AS BIGINT) AS num_patches, coalesce(sum(area), 0) AS total_area, round(0.25 * sum(perimeter) / sqrt(sum(area)), 6) AS shape_index FROM slots s LEFT JOIN patches p ON p.t = s.t AND p.class_label = s.class_label GROUP BY s.t, s.class_label""")
def class_timeseries_dense(spark, sf_dir):
    gaps = table(spark, sf_dir, "orders").where((F.col("o_orderkey") % 7 == 0) & (F.year("o_orderdate") >= 1998)).select(F.floor(F.col("o_orderkey") / WIDTH).alias("row"), (F.col("o_orderkey") % WIDTH).alias("col"))
    rest = patches.label_runs(cells(spark, sf_dir).join(gaps, ["row", "col"], "left_anti"), GRID)
    return rounded(metrics.class_timeseries(patches.patch_table(materialize(rest), GRID), ["num_patches", "total_area", "shape_index"]))


@query(f"""{BASE}, {PATCHES_SQL} SELECT t, 'class' AS level, class_label, name, round(value, 6) AS value FROM (SELECT t, class_label, unnest(['num_patches', 'total_area', 'total_edge']) AS name, unnest([CAST(count(*) AS DOUBLE), sum(area), sum(perimeter)]) AS value FROM patches GROUP BY t, class_label)""")
def metrics_long(spark, sf_dir):
    wide = metrics.class_metrics(patch_rows(spark, sf_dir)).select("t", "class_label", "num_patches", "total_area", "total_edge")
    return rounded(metrics.metrics_long(wide, "class").select("t", "level", "class_label", "name", "value"))


@query(f"{BASE}, {EDGES_SQL}, {merged_sql('true', 'class_label')} SELECT t, patch_id, class_label, n_cells FROM mp")
def eight_connected(spark, sf_dir):
    one = patches.label_runs(cells(spark, sf_dir), GRID, 8)
    return one.groupBy("t", "patch_id").agg(F.min("class_label").alias("class_label"), patches.cell_count(one).alias("n_cells"))


# --- graphs ----------------------------------------------------------------------

GRAPH = f"{BASE}, {EDGES_SQL}, ends AS (SELECT t, src AS patch_id FROM edges UNION ALL SELECT t, dst FROM edges), deg AS (SELECT n.t, n.patch_id, count(e.patch_id) AS degree FROM (SELECT DISTINCT t, patch_id FROM pc) n LEFT JOIN ends e USING (t, patch_id) GROUP BY ALL)"


@query(f"{BASE}, {EDGES_SQL} SELECT * FROM edges")
def patch_adjacency(spark, sf_dir):
    return adjacency.adjacency(labelled_runs(spark, sf_dir))


def graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pc = labelled_runs(spark, sf_dir)
    return pc.select("t", "patch_id").distinct(), materialize(adjacency.adjacency(pc))


@query(f"{GRAPH} SELECT * FROM deg")
def degree(spark, sf_dir):
    return adjacency.degrees(*graph(spark, sf_dir))


@query(f"{GRAPH} SELECT *, CASE degree WHEN 0 THEN 'disconnected' ELSE 'poorly connected' END AS kind FROM deg WHERE degree <= 1")
def weak_nodes(spark, sf_dir):
    return adjacency.weak_nodes(*graph(spark, sf_dir))


@query(f"""{GRAPH}, tri AS (SELECT a.t, a.src AS u, a.dst AS v, b.dst AS w FROM edges a JOIN edges b ON b.t = a.t AND b.src = a.dst JOIN edges c ON c.t = a.t AND c.src = a.src AND c.dst = b.dst),
per AS (SELECT t, unnest([u, v, w]) AS patch_id FROM tri), cnt AS (SELECT t, patch_id, count(*) AS triangles FROM per GROUP BY ALL)
SELECT t, degree, coalesce(triangles, 0) AS triangles, count(*) AS nodes FROM deg LEFT JOIN cnt USING (t, patch_id) GROUP BY ALL""")
def graph_signature(spark, sf_dir):
    return adjacency.graph_signature(*graph(spark, sf_dir))


@query(f"""{BASE}, {EDGES_SQL}, {PATCHES_SQL}, near AS (SELECT pc.t, pc.patch_id, pc.row, pc.col, row_number() OVER (PARTITION BY pc.t, pc.patch_id ORDER BY round((pc.row - mr) * (pc.row - mr) + (pc.col - mc) * (pc.col - mc), 9), pc.row, pc.col) AS k FROM pc JOIN patches USING (t, patch_id)),
rep AS (SELECT t, patch_id, col * 30.0::DOUBLE + 15 AS x, row * -30.0::DOUBLE - 15 AS y FROM near WHERE k = 1)
SELECT e.t, src, dst, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM edges e JOIN rep a ON a.t = e.t AND a.patch_id = src JOIN rep b ON b.t = e.t AND b.patch_id = dst""")
def edge_lines(spark, sf_dir):
    pc = labelled_runs(spark, sf_dir)
    return adjacency.edge_lines(adjacency.adjacency(pc), patches.patch_table(pc, GRID))


# --- change through time -----------------------------------------------------------


def map_sql(offsets: str) -> str:
    return f"""{TURN}, off AS (SELECT unnest(range(-1, 2)) AS dr), offs AS (SELECT a.dr, b.dr AS dc FROM off a, off b WHERE {offsets}),
nm AS MATERIALIZED (SELECT a.t AS t0, b.t AS t1, a.patch_id AS src_id, b.patch_id AS trg_id, sum(CASE WHEN dr = 0 AND dc = 0 THEN 900.0::DOUBLE ELSE 0 END) AS overlap_area FROM pc a, offs, pc b WHERE b.t = a.t + 1 AND b.row = a.row + dr AND b.col = a.col + dc AND a.class_label = b.class_label GROUP BY ALL)"""


INTERIOR, EDGE, CORNER = map_sql("a.dr = 0 AND b.dr = 0"), map_sql("a.dr = 0 OR b.dr = 0"), map_sql("true")


@query(f"{INTERIOR} SELECT * FROM nm")
def node_map_interior(spark, sf_dir):
    return timeline.node_map(labelled_runs(spark, sf_dir, True), "interior", GRID)


@query(f"{EDGE} SELECT * FROM nm")
def node_map_edge(spark, sf_dir):
    return timeline.node_map(labelled_runs(spark, sf_dir, True), "edge", GRID)


@query(f"{CORNER} SELECT * FROM nm")
def node_map_corner(spark, sf_dir):
    return timeline.node_map(labelled_runs(spark, sf_dir, True), "corner", GRID)


@query(f"{INTERIOR} SELECT t1 AS t0, t0 AS t1, trg_id AS src_id, src_id AS trg_id, overlap_area FROM nm")
def node_map_inverse(spark, sf_dir):
    return timeline.invert(timeline.node_map(labelled_runs(spark, sf_dir, True), "interior", GRID))


CHANGE = f"""{INTERIOR}, sizes AS (SELECT t, patch_id, count(*) * 900.0::DOUBLE AS area FROM pc GROUP BY t, patch_id), kids AS (SELECT t0, src_id, count(*) AS children FROM nm GROUP BY ALL),
back AS (SELECT t1 AS t, trg_id AS patch_id, count(*) AS ancestors, max(children) AS children, sum(area) AS before FROM nm JOIN kids USING (t0, src_id) JOIN sizes ON sizes.t = t0 AND sizes.patch_id = src_id GROUP BY ALL),
g AS (SELECT s.t, s.patch_id, coalesce(ancestors, 0) AS n, children, (area - coalesce(before, 0)) / (area + coalesce(before, 0)) AS r, area - coalesce(before, 0) AS absolute_growth FROM sizes s LEFT JOIN back USING (t, patch_id) WHERE s.t > {FIRST}),
dyn AS (SELECT t, patch_id, CASE WHEN n = 0 THEN 'birth' WHEN n = 1 AND children > 1 THEN 'split' WHEN n = 1 AND r > 0 THEN 'grew' WHEN n = 1 AND r < 0 THEN 'shrank' WHEN n = 1 THEN 'unchanged' WHEN children > 1 THEN 'complex' ELSE 'merged' END AS node_dynamic, round(r, 6) AS relative_growth, absolute_growth FROM g)"""


def mapped(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pc = labelled_runs(spark, sf_dir, True)
    return materialize(timeline.node_map(pc, "interior", GRID)), pc.groupBy("t", "patch_id").agg((patches.cell_count(pc) * GRID.cell_area).alias("area"))


@query(f"{CHANGE} SELECT * FROM dyn")
def node_dynamics(spark, sf_dir):
    return rounded(timeline.dynamics(*mapped(spark, sf_dir)))


@query(f"{CHANGE} SELECT t, node_dynamic, count(*) AS n FROM dyn GROUP BY ALL")
def dynamics_count(spark, sf_dir):
    return timeline.dynamics_count(timeline.dynamics(*mapped(spark, sf_dir)))


@query(f"""{CHANGE} SELECT a.t AS t0, a.patch_id AS src_id, a.area - coalesce(sum(m.overlap_area), 0) AS removed_area, coalesce(sum(b.area), 0) - coalesce(sum(m.overlap_area), 0) AS added_area
FROM sizes a LEFT JOIN nm m ON m.t0 = a.t AND m.src_id = a.patch_id LEFT JOIN sizes b ON b.t = m.t1 AND b.patch_id = m.trg_id WHERE a.t < {TIMES[-1]} GROUP BY a.t, a.patch_id, a.area""")
def polygon_diff(spark, sf_dir):
    return timeline.polygon_diff(*mapped(spark, sf_dir))


@query(f"{CHANGE} SELECT t, patch_id FROM sizes s WHERE t < {TIMES[-1]} AND NOT EXISTS (SELECT 1 FROM nm WHERE nm.t0 = s.t AND nm.src_id = s.patch_id)")
def vanished_patches(spark, sf_dir):
    return timeline.deaths(*mapped(spark, sf_dir))


@query(f"WITH {cells_sql()} SELECT t, lag(t) OVER (ORDER BY t) AS previous_t, lead(t) OVER (ORDER BY t) AS next_t FROM (SELECT DISTINCT t FROM cells)")
def prior_slice(spark, sf_dir):
    return timeline.times(cells(spark, sf_dir))


# --- habitats ------------------------------------------------------------------------

def near_sql(base: str, distance: int = 60) -> str:
    """Pairs ``links`` of good patches up to ``distance`` units apart.

    Pairs of good cells at most a row and column more apart hold every such pair of patches.
    """
    return f"""{base}, good AS (SELECT * FROM pc WHERE class_label IN ('SMALL', 'LARGE')), k AS (SELECT unnest(range(-{distance // 30 + 1}, {distance // 30 + 2})) AS d),
links AS MATERIALIZED (SELECT t, src, dst, min(distance) AS distance FROM (SELECT a.t, a.patch_id AS src, b.patch_id AS dst, 30 * sqrt(CAST(greatest(abs(r.d) - 1, 0) ** 2 + greatest(abs(c.d) - 1, 0) ** 2 AS DOUBLE)) AS distance
  FROM good a, k r, k c, good b WHERE b.t = a.t AND b.row = a.row + r.d AND b.col = a.col + c.d AND a.patch_id < b.patch_id) WHERE distance <= {distance} GROUP BY ALL)"""


def members_sql(near: str) -> str:
    return f"""{near}, gn AS (SELECT DISTINCT t * 100000000 + patch_id AS id FROM good), ge AS (SELECT t * 100000000 + src AS a, t * 100000000 + dst AS b FROM links), {groups_sql('gn', 'ge', 'hc')},
comp AS MATERIALIZED (SELECT id // 100000000 AS t, lab % 100000000 AS component_id, id % 100000000 AS patch_id FROM hc_cc)"""


def isolation_sql(members: str) -> str:
    """Distances ``cd`` of every two components, over the cells that have an open side."""
    return f"""{members}, cc AS MATERIALIZED (SELECT g.t, g.row, g.col, component_id AS c FROM good g JOIN comp USING (t, patch_id)), steps AS (SELECT unnest([0, 0, 1, -1]) AS dr, unnest([1, -1, 0, 0]) AS dc),
inner_cells AS (SELECT a.t, a.row, a.col FROM cc a, steps, cc b WHERE b.t = a.t AND b.row = a.row + dr AND b.col = a.col + dc AND b.c = a.c GROUP BY ALL HAVING count(*) = 4), rim AS MATERIALIZED (SELECT * FROM cc ANTI JOIN inner_cells USING (t, row, col)),
cd AS MATERIALIZED (SELECT a.t, a.c AS src, b.c AS dst, 30 * sqrt(CAST(min(greatest(abs(a.row - b.row) - 1, 0) ** 2 + greatest(abs(a.col - b.col) - 1, 0) ** 2) AS DOUBLE)) AS distance FROM rim a JOIN rim b ON b.t = a.t AND b.c > a.c GROUP BY ALL)"""


def isolation_metrics_sql(isolation: str) -> str:
    return f"""{isolation}, sizes AS (SELECT t, c, count(*) * 900.0::DOUBLE AS area FROM cc GROUP BY ALL), iso AS (SELECT t, avg(CAST(CAST(d AS FLOAT) AS DOUBLE)) AS mean FROM (SELECT DISTINCT t, distance AS d FROM cd) GROUP BY t)
SELECT t, count(*) AS num_components, round(avg(area), 6) AS avg_component_area, round(CASE WHEN count(*) = 1 THEN 0 WHEN count(*) > 2 THEN any_value(mean) END, 4) AS avg_component_isolation FROM sizes LEFT JOIN iso USING (t) GROUP BY t"""


def nearest_sql(isolation: str) -> str:
    return f"{isolation} SELECT t, round(avg(d), 6) AS mean_nearest_component_distance FROM (SELECT t, c, min(distance) AS d FROM (SELECT t, src AS c, distance FROM cd UNION ALL SELECT t, dst, distance FROM cd) GROUP BY t, c) GROUP BY t"


#: Habitats of the landscape whose converted cells only spread, and of the one where they come and go.
WHOLE, ROTATING = near_sql(BASE), near_sql(TURN)
MEMBERS, ROTATING_MEMBERS = members_sql(WHOLE), members_sql(ROTATING)
ISOLATION, ROTATING_ISOLATION = isolation_sql(MEMBERS), isolation_sql(ROTATING_MEMBERS)
EDGE_COLUMNS = "SELECT t, src, dst, round(distance, 6) AS distance FROM"
REACH = "SELECT DISTINCT g.t, g.patch_id, g.row + r.d AS row, g.col + c.d AS col FROM good g, k r, k c WHERE greatest(abs(r.d) - 1, 0) ** 2 + greatest(abs(c.d) - 1, 0) ** 2"
#: Around each source the cells in reach and no wall; what hangs together with the representative cell leads to targets.
BARRIER = f"""{WHOLE}, {PATCHES_SQL}, wall AS (SELECT t, row, col FROM cells WHERE class_label = 'URBAN'), steps_on AS (SELECT unnest([0, 1]) AS dr, unnest([1, 0]) AS dc),
free AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY t, patch_id, row, col) AS id FROM ({REACH} <= 4) ANTI JOIN wall USING (t, row, col)),
fp AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM free a, steps_on, free b WHERE b.t = a.t AND b.patch_id = a.patch_id AND b.row = a.row + dr AND b.col = a.col + dc), {groups_sql('free', 'fp', 'fc')}, parts AS MATERIALIZED (SELECT * FROM free JOIN fc_cc USING (id)),
near AS (SELECT pc.t, pc.patch_id, pc.row, pc.col, row_number() OVER (PARTITION BY pc.t, pc.patch_id ORDER BY round((pc.row - mr) * (pc.row - mr) + (pc.col - mc) * (pc.col - mc), 9), pc.row, pc.col) AS k FROM pc JOIN patches USING (t, patch_id)),
home AS (SELECT t, patch_id, lab FROM parts JOIN near USING (t, patch_id, row, col) WHERE k = 1),
met AS (SELECT DISTINCT p.t, least(p.patch_id, g.patch_id) AS src, greatest(p.patch_id, g.patch_id) AS dst FROM parts p JOIN home USING (t, patch_id, lab) JOIN good g ON g.t = p.t AND g.row = p.row AND g.col = p.col WHERE g.patch_id <> p.patch_id)"""


def whole_habitat(pc: DataFrame, distance: float = 60.0, **options) -> habitat.Habitat:
    return habitat.add_habitat(pc, GRID, "small and large", VALID, max_travel_distance=distance, add_distance=True, **options)


def whole_members(pc: DataFrame) -> tuple[DataFrame, habitat.Habitat]:
    h = whole_habitat(pc)
    return materialize(habitat.components(h.nodes, h.edges)), h


def isolation(pc: DataFrame) -> DataFrame:
    return rounded(habitat.component_distances(whole_members(pc)[0], pc, GRID))


def isolation_metrics(pc: DataFrame) -> DataFrame:
    members, h = whole_members(pc)
    out = metrics.component_metrics(members, h.nodes, habitat.distinct_distances(members, pc, GRID))
    return rounded(out).withColumn("avg_component_isolation", F.round("avg_component_isolation", 4))


def nearest(pc: DataFrame) -> DataFrame:
    near = habitat.nearest_components(whole_members(pc)[0], pc, GRID)
    return rounded(near.groupBy("t").agg(F.avg("distance").alias("mean_nearest_component_distance")))


@query(f"{ROTATING} {EDGE_COLUMNS} links")
def habitat_edges(spark, sf_dir):
    return rounded(whole_habitat(labelled_runs(spark, sf_dir, True)).edges)


@query(f"{WHOLE} {EDGE_COLUMNS} links")
def landscape_habitat_edges(spark, sf_dir):
    return rounded(whole_habitat(labelled_runs(spark, sf_dir)).edges)


@query(f"{near_sql(BASE, 300)} {EDGE_COLUMNS} links")
def habitat_edges_far(spark, sf_dir):
    """Ten cells of travel distance."""
    return rounded(whole_habitat(labelled_runs(spark, sf_dir), 300.0).edges)


@query(f"{ROTATING} SELECT t, src, dst, distance FROM links WHERE distance = 0")
def habitat_touching(spark, sf_dir):
    return whole_habitat(labelled_runs(spark, sf_dir, True), 0.0).edges


@query(f"{WHOLE} SELECT t, src, dst, distance FROM links WHERE distance = 0")
def landscape_habitat_touching(spark, sf_dir):
    return whole_habitat(labelled_runs(spark, sf_dir), 0.0).edges


@query(f"{ROTATING_MEMBERS} SELECT t, component_id, patch_id FROM comp")
def habitat_components(spark, sf_dir):
    return whole_members(labelled_runs(spark, sf_dir, True))[0]


@query(f"{MEMBERS} SELECT t, component_id, patch_id FROM comp")
def landscape_habitat_components(spark, sf_dir):
    return whole_members(labelled_runs(spark, sf_dir))[0]


@query(f"{ROTATING_ISOLATION} {EDGE_COLUMNS} cd")
def component_distances(spark, sf_dir):
    return isolation(labelled_runs(spark, sf_dir, True))


@query(f"{ISOLATION} {EDGE_COLUMNS} cd")
def landscape_component_distances(spark, sf_dir):
    return isolation(labelled_runs(spark, sf_dir))


@query(isolation_metrics_sql(ROTATING_ISOLATION))
def habitat_metrics(spark, sf_dir):
    return isolation_metrics(labelled_runs(spark, sf_dir, True))


@query(isolation_metrics_sql(ISOLATION))
def landscape_habitat_metrics(spark, sf_dir):
    return isolation_metrics(labelled_runs(spark, sf_dir))


@query(nearest_sql(ROTATING_ISOLATION))
def component_nearest(spark, sf_dir):
    return nearest(labelled_runs(spark, sf_dir, True))


@query(nearest_sql(ISOLATION))
def landscape_component_nearest(spark, sf_dir):
    return nearest(labelled_runs(spark, sf_dir))


@query(f"{BARRIER} {EDGE_COLUMNS} links SEMI JOIN met USING (t, src, dst)")
def barrier_habitat(spark, sf_dir):
    return rounded(whole_habitat(labelled_runs(spark, sf_dir), barrier_classes=["URBAN"]).edges)


@query(f"{ROTATING} {REACH} <= 1")
def habitat_reach(spark, sf_dir):
    return habitat.reach(labelled_runs(spark, sf_dir, True).where(F.col("class_label").isin(VALID)), 30.0, GRID)


@query(f"{WHOLE} {REACH} <= 1")
def landscape_habitat_reach(spark, sf_dir):
    return habitat.reach(labelled_runs(spark, sf_dir).where(F.col("class_label").isin(VALID)), 30.0, GRID)


# --- edits -----------------------------------------------------------------------------

GREEN = ["SMALL", "LARGE", "MEDIUM"]


IN_GREEN = "class_label IN ('SMALL', 'LARGE', 'MEDIUM')"


@query(f"{BASE}, {EDGES_SQL}, {merged_sql(f'x.{IN_GREEN}', f"CASE WHEN {IN_GREEN} THEN 'GREEN' ELSE class_label END")} SELECT t, patch_id, class_label, n_cells FROM mp")
def merge_classes(spark, sf_dir):
    pc = labelled_runs(spark, sf_dir)
    merged, _ = edits.merge_classes(pc, GREEN, "GREEN", materialize(adjacency.adjacency(pc)))
    return merged.groupBy("t", "patch_id", "class_label").agg(patches.cell_count(merged).alias("n_cells"))


#: Cells after the merge as ``pc``, those before as ``p0``.
MERGED_SQL = f"""{BASE}, {EDGES_SQL}, {merged_sql(f'x.{IN_GREEN}', f"CASE WHEN {IN_GREEN} THEN 'GREEN' ELSE class_label END")}""".split(", mp AS")[0]
MERGED_SQL = re.sub(r"\bpc\b", "p0", MERGED_SQL)
MERGED_SQL += ", pc AS MATERIALIZED (SELECT p.t, p.row, p.col, new_label AS class_label, lab % 100000000 AS patch_id FROM p0 p JOIN q ON q.id = p.t * 100000000 + p.patch_id JOIN mg_cc ON mg_cc.id = q.id)"


def contracted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pc = labelled_runs(spark, sf_dir)
    return edits.merge_classes_of_graph(materialize(patches.patch_table(pc, GRID)), materialize(adjacency.bordered_edges(pc, GRID)), GREEN, "GREEN")


@query(f"{MERGED_SQL}, {PATCHES_SQL} SELECT t, patch_id, class_label, n_cells, area, perimeter, xmin, ymin, xmax, ymax FROM patches")
def contracted_patches(spark, sf_dir):
    return contracted(spark, sf_dir)[0].drop("rep_x", "rep_y")


@query(f"""{MERGED_SQL} SELECT a.t, least(a.patch_id, b.patch_id) AS src, greatest(a.patch_id, b.patch_id) AS dst, sum(CASE WHEN o.dr = 0 OR o.dc = 0 THEN 30.0::DOUBLE ELSE 0 END) AS border
FROM pc a, (SELECT unnest([0, 1, 1, 1]) AS dr, unnest([1, -1, 0, 1]) AS dc) o, pc b WHERE b.t = a.t AND b.row = a.row + o.dr AND b.col = a.col + o.dc AND a.patch_id <> b.patch_id GROUP BY ALL""")
def contracted_edges(spark, sf_dir):
    return contracted(spark, sf_dir)[1]


@query(f"""{BASE}, {EDGES_SQL}, top AS (SELECT max(patch_id) + 1 AS id FROM pc WHERE t = {FIRST}), gone AS (SELECT t, patch_id FROM pc WHERE t = {FIRST} AND patch_id IN (0, 1, 2, 150, 151, 300)),
r AS (SELECT e.t, CASE WHEN (e.t, src) IN (SELECT (t, patch_id) FROM gone) THEN id ELSE src END AS u, CASE WHEN (e.t, dst) IN (SELECT (t, patch_id) FROM gone) THEN id ELSE dst END AS v FROM edges e, top)
SELECT DISTINCT t, least(u, v) AS src, greatest(u, v) AS dst FROM r WHERE u <> v""")
def merge_nodes(spark, sf_dir):
    pc = labelled_runs(spark, sf_dir)
    return edits.merge_nodes(patches.run_cells(pc), adjacency.adjacency(pc), FIRST, [0, 1, 2, 150, 151, 300], "MERGED")[1]


@query(f"{BASE}, {EDGES_SQL} SELECT * FROM edges WHERE src % 5 <> 0 AND dst % 5 <> 0")
def remove_nodes(spark, sf_dir):
    pc = labelled_runs(spark, sf_dir)
    gone = pc.where(F.col("patch_id") % 5 == 0).select("t", "patch_id").distinct()
    return edits.remove_nodes(pc, adjacency.adjacency(pc), gone)[1]


# --- cells, windows, projections ----------------------------------------------------------


@query(f"WITH {cells_sql()}, h AS (SELECT max(row) AS m FROM cells) SELECT t, row, col, class_label FROM cells, h WHERE col >= 20 AND col < 70 AND m - row >= 2")
def window_cells(spark, sf_dir):
    rows = cells(spark, sf_dir)
    height = rows.agg(F.max("row")).first()[0] + 1
    return sub_window(rows, (20, 70), (2, None), height)


@query(f"WITH {cells_sql()}, h AS (SELECT max(row) + 1 AS n FROM cells), s AS (SELECT i, j, CAST(floor((i + 0.5) * n / 5) AS BIGINT) AS row, CAST(floor((j + 0.5) * {WIDTH} / 40) AS BIGINT) AS col FROM h, (SELECT unnest(range(5)) AS i), (SELECT unnest(range(40)) AS j)) SELECT t, i AS row, j AS col, class_label FROM cells JOIN s USING (row, col)")
def thumbnail_cells(spark, sf_dir):
    rows = cells(spark, sf_dir)
    return thumbnail(rows, (rows.agg(F.max("row")).first()[0] + 1, WIDTH), 5, 40).select("t", "row", "col", "class_label")


@query(f"WITH {cells_sql()} SELECT t, class_label, count(*) AS n FROM cells JOIN orders ON o_orderkey = row * {WIDTH} + col WHERE o_orderstatus <> 'P' GROUP BY ALL")
def masked_counts(spark, sf_dir):
    status = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / WIDTH).alias("row"), (F.col("o_orderkey") % WIDTH).alias("col"), "o_orderstatus")
    kept = masked(cells(spark, sf_dir).join(status, ["row", "col"]), F.col("o_orderstatus") != "P")
    return kept.groupBy("t", "class_label").agg(F.count("*").alias("n"))


@query(f"WITH {cells_sql()}, legend AS (SELECT DISTINCT p_type AS class_label, lower(p_type) || ' goods' AS label FROM part) SELECT t, class_label, label, count(*) AS n FROM cells LEFT JOIN legend USING (class_label) GROUP BY ALL")
def legend_join(spark, sf_dir):
    legend = table(spark, sf_dir, "part").select(F.col("p_type").alias("class_label"), F.concat(F.lower("p_type"), F.lit(" goods")).alias("label")).distinct()
    return columns.with_legend(cells(spark, sf_dir), legend).groupBy("t", "class_label", "label").agg(F.count("*").alias("n"))


@query(f"WITH {cells_sql()} SELECT t, CASE WHEN class_label IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'sized' WHEN class_label = 'URBAN' THEN 'built' END AS grp, contains(class_label, 'AN') AS named, count(*) AS n FROM cells GROUP BY ALL")
def class_group(spark, sf_dir):
    rows = cells(spark, sf_dir).select("t", columns.grouped_classes({"sized": GREEN, "built": ["URBAN"]}).alias("grp"), columns.label_contains("AN").alias("named"))
    return rows.groupBy("t", "grp", "named").agg(F.count("*").alias("n"))


@query(f"WITH {cells_sql()} SELECT class_label, CAST(dense_rank() OVER (ORDER BY class_label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT class_label FROM cells)")
def category_codes(spark, sf_dir):
    return columns.category_codes(cells(spark, sf_dir).select("class_label").distinct(), "class_label").select("class_label", F.col("code").cast("int").alias("code"))


@query(f"WITH {cells_sql()} SELECT t, row, col, class_label FROM cells WHERE (30 * col + 15 BETWEEN 300 AND 1500 AND -30 * row - 15 BETWEEN -1500 AND -900) OR (30 * col + 15 BETWEEN 300 AND 900 AND -30 * row - 15 BETWEEN -1500 AND -300)")
def clip_to_region(spark, sf_dir):
    # the region is a stated outline of six corners
    sides = [(*map(float, REGION[i]), *map(float, REGION[(i + 1) % len(REGION)])) for i in range(len(REGION))]
    return clip(cells(spark, sf_dir), GRID, spark.createDataFrame(sides, "x1 double, y1 double, x2 double, y2 double"))


def resampled_sql(factor: str, count: str) -> str:
    """Nearest cells of a target of ``factor`` times the cell size; ``count`` gives its rows (columns) from those of the source."""
    return f"""WITH {cells_sql()}, h AS (SELECT max(row) + 1 AS n FROM cells), w AS (SELECT {WIDTH} AS n), s AS (SELECT i AS nr, j AS nc, CAST(floor((i + 0.5) * {factor}) AS BIGINT) AS row, CAST(floor((j + 0.5) * {factor}) AS BIGINT) AS col FROM (SELECT unnest(range({count})) AS i FROM h), (SELECT unnest(range({count})) AS j FROM w))
SELECT t, nr AS row, nc AS col, class_label FROM cells JOIN s USING (row, col)"""


def whole_resampled(spark, sf_dir, size: float) -> DataFrame:
    """All target cells whose centre lies in the extent."""
    rows = cells(spark, sf_dir)
    height = rows.agg(F.max("row")).first()[0]
    shape = tuple(max(0, math.ceil(30.0 * n / size - 0.5)) for n in (height + 1 if height is not None else 0, WIDTH))
    return resample_nearest(rows, GRID, GridSpec(a=size, e=-size), shape).select("t", "row", "col", "class_label")


@query(resampled_sql("3 / 2", "(2 * n + 1) // 3"))
def resampled(spark, sf_dir):
    return whole_resampled(spark, sf_dir, 45.0)


@query(resampled_sql("4 / 3", "(3 * n + 1) // 4"))
def landscape_resampled(spark, sf_dir):
    return whole_resampled(spark, sf_dir, 40.0)


def degrees_sql() -> str:
    """Degrees ``lon``, ``lat`` of UTM zone 35 north by the inverse series, the latitude by five rounds from the conformal one."""
    n, e = "(f / (2 - f))", "sqrt(f * (2 - f))"
    back = [f"{n} / 2 - 2 * {n} ** 2 / 3 + 37 * {n} ** 3 / 96", f"{n} ** 2 / 48 + {n} ** 3 / 15", f"17 * {n} ** 3 / 480"]
    term = lambda one, two: " - ".join(f"({c}) * {one}({2 * j} * xi) * {two}({2 * j} * eta)" for j, c in enumerate(back, 1))
    rounds = ", ".join(f"r{i + 1} AS (SELECT * REPLACE (asin(tanh(psi + {e} * atanh({e} * sin(phi)))) AS phi) FROM r{i})" for i in range(5))
    return f"""placed AS (SELECT t, row, col, 700000 + 30 * (col + 0.5::DOUBLE) AS x, 5700000 - 30 * (row + 0.5::DOUBLE) AS y, 1 / 298.257223563::DOUBLE AS f FROM cells),
scaled AS (SELECT *, 0.9996::DOUBLE * 6378137 / (1 + {n}) * (1 + {n} ** 2 / 4 + {n} ** 4 / 64) AS radius FROM placed), pair AS (SELECT *, y / radius AS xi, (x - 500000) / radius AS eta FROM scaled),
uv AS (SELECT *, xi - {term('sin', 'cosh')} AS u, eta - {term('cos', 'sinh')} AS v FROM pair), r0 AS (SELECT *, asin(sin(u) / cosh(v)) AS phi, atanh(sin(u) / cosh(v)) AS psi FROM uv), {rounds}"""


@query(f"WITH {cells_sql()}, {degrees_sql()} SELECT t, row, col, round(degrees(atan2(sinh(v), cos(u))) + 27, 7) AS lon, round(degrees(phi), 7) AS lat FROM r5")
def reproject(spark, sf_dir):
    rows = world_coordinates(cells(spark, sf_dir), GridSpec(a=30.0, e=-30.0, c=700_000.0, f=5_700_000.0)).select("t", "row", "col", "x", "y")
    there = columns.reproject_points(rows, "EPSG:32635", "EPSG:4326").select("t", "row", "col", F.col("x").alias("lon"), F.col("y").alias("lat"))
    return there.select("t", "row", "col", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


#: The landscape where it lies in zone 35.
PLACED = GridSpec(a=30.0, e=-30.0, c=700_000.0, f=5_700_000.0, width=WIDTH, crs="EPSG:32635")


@query(f"""{BASE}, {EDGES_SQL}, {PATCHES_SQL}, near AS (SELECT pc.t, pc.patch_id, pc.row, pc.col, row_number() OVER (PARTITION BY pc.t, pc.patch_id ORDER BY round((pc.row - mr) * (pc.row - mr) + (pc.col - mc) * (pc.col - mc), 9), pc.row, pc.col) AS k FROM pc JOIN patches USING (t, patch_id)),
rep AS MATERIALIZED (SELECT t, patch_id, row, col FROM near WHERE k = 1), {degrees_sql().replace("FROM cells", "FROM rep")}, place AS MATERIALIZED (SELECT t, patch_id, round(degrees(atan2(sinh(v), cos(u))) + 27, 7) AS lon, round(degrees(phi), 7) AS lat FROM r5 JOIN rep USING (t, row, col))
SELECT e.t, src, dst, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2 FROM edges e JOIN place a ON a.t = e.t AND a.patch_id = src JOIN place b ON b.t = e.t AND b.patch_id = dst""")
def edge_lines_in_degrees(spark, sf_dir):
    pc = labelled_runs(spark, sf_dir)
    lines = adjacency.edge_lines(adjacency.adjacency(pc), patches.patch_table(pc, PLACED), PLACED.crs, "EPSG:4326")
    return lines.select("t", "src", "dst", *[F.round(c, 7).alias(n) for c, n in (("x1", "lon1"), ("y1", "lat1"), ("x2", "lon2"), ("y2", "lat2"))])


# --- polygons ----------------------------------------------------------------------------


@query(f"WITH {RECTANGLES_SQL} SELECT patch_id, class_label, round((xmax - xmin) * (ymax - ymin), 6) AS area, round(2 * (xmax - xmin + ymax - ymin), 6) AS perimeter, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax, round((xmin + xmax) / 2, 6) AS rep_x, round((ymin + ymax) / 2, 6) AS rep_y FROM v")
def vector_attributes(spark, sf_dir):
    return rounded(vector.vector_patches(vector_patches(spark, sf_dir)).select("patch_id", "class_label", "area", "perimeter", "xmin", "ymin", "xmax", "ymax", "rep_x", "rep_y"))


RELATED = f"WITH {RECTANGLES_SQL}, r AS (SELECT a.patch_id AS src, b.patch_id AS dst, a.class_label AS c1, b.class_label AS c2, greatest(greatest(a.xmin, b.xmin) - least(a.xmax, b.xmax), 0) AS dx, greatest(greatest(a.ymin, b.ymin) - least(a.ymax, b.ymax), 0) AS dy, greatest(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin), 0) * greatest(least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin), 0) AS overlap FROM v a JOIN v b ON a.patch_id < b.patch_id)"


@query(f"{RELATED} SELECT src, dst FROM r WHERE dx <= 1e-9 AND dy <= 1e-9")
def vector_adjacency(spark, sf_dir):
    return vector.vector_edges(materialize(vector.vector_patches(vector_patches(spark, sf_dir)))).select("src", "dst")


@query(f"{RELATED} SELECT src, dst, round(sqrt(dx * dx + dy * dy), 6) AS distance FROM r WHERE sqrt(dx * dx + dy * dy) <= 2.5 + 1e-9")
def vector_tolerance(spark, sf_dir):
    return rounded(vector.vector_edges(materialize(vector.vector_patches(vector_patches(spark, sf_dir))), 2.5))


@query(f"{RELATED} SELECT src AS one_id, dst AS other_id, round(overlap, 6) AS overlap FROM r WHERE overlap > 1e-6")
def vector_overlap(spark, sf_dir):
    rows = vector.relations(materialize(vector.vector_patches(vector_patches(spark, sf_dir))))
    return rounded(rows.where("contact = 'interior' and overlap > 1e-6").select("one_id", "other_id", "overlap"))


@query(f"{RELATED} SELECT src AS src_id, dst AS trg_id FROM r WHERE overlap > 1e-6 AND c1 = c2 UNION ALL SELECT dst, src FROM r WHERE overlap > 1e-6 AND c1 = c2 UNION ALL SELECT patch_id, patch_id FROM v")
def vector_identify(spark, sf_dir):
    rows = materialize(vector.vector_patches(vector_patches(spark, sf_dir)))
    return vector.identify(rows, rows)


@query(f"WITH {COLUMNS_SQL} SELECT id AS patch_id, round(sum(high - low), 6) AS area FROM pieces GROUP BY id")
def many_sided_areas(spark, sf_dir):
    return rounded(vector.vector_patches(many_sided(spark, sf_dir)).select("patch_id", "area"))


@query(f"WITH {COLUMNS_SQL} SELECT a.id AS one_id, b.id AS other_id, round(sum(least(a.high, b.high) - greatest(a.low, b.low)), 6) AS overlap FROM pieces a JOIN pieces b ON a.x = b.x AND a.id < b.id AND a.low < b.high AND b.low < a.high GROUP BY ALL")
def many_sided_overlap(spark, sf_dir):
    rows = vector.relations(materialize(vector.vector_patches(many_sided(spark, sf_dir))))
    return rounded(rows.where("contact = 'interior'").select("one_id", "other_id", "overlap"))


@query(f"""WITH {BLOCKS_SQL}, r AS (SELECT a.patch_id AS one_id, b.patch_id AS other_id, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin) AS dx, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin) AS dy FROM v a JOIN v b ON a.patch_id < b.patch_id)
SELECT one_id, other_id, CASE WHEN dx > 0 AND dy > 0 THEN 'interior' WHEN dx > 0 OR dy > 0 THEN 'edge' ELSE 'corner' END AS contact FROM r WHERE dx >= 0 AND dy >= 0""")
def vector_contact(spark, sf_dir):
    return vector.relations(materialize(vector.vector_patches(blocks(spark, sf_dir)))).select("one_id", "other_id", "contact")


def identified_sql(test: str) -> str:
    """Blocks of one class in the two tables of odd and even ids whose contact fits the test."""
    return f"""WITH {BLOCKS_SQL}, r AS (SELECT a.patch_id AS src_id, b.patch_id AS trg_id, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin) AS dx, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin) AS dy FROM v a JOIN v b ON a.class_label = b.class_label AND a.patch_id % 2 = 1 AND b.patch_id % 2 = 0)
SELECT src_id, trg_id FROM r WHERE dx >= 0 AND dy >= 0 AND {test}"""


def identified(spark, sf_dir, mode: str) -> DataFrame:
    rows = materialize(vector.vector_patches(blocks(spark, sf_dir)))
    return vector.identify(rows.where("patch_id % 2 = 1"), rows.where("patch_id % 2 = 0"), mode)


@query(identified_sql("(dx > 0 OR dy > 0)"))
def vector_identify_edge(spark, sf_dir):
    return identified(spark, sf_dir, "edge")


@query(identified_sql("true"))
def vector_identify_corner(spark, sf_dir):
    return identified(spark, sf_dir, "corner")


@query(f"WITH {BLOCKS_SQL}, n AS (SELECT patch_id AS block, row_number() OVER (ORDER BY class_label, xmin, ymin, xmax, ymax) - 1 AS patch_id FROM v), h AS (SELECT count(*) // 4 AS low, count(*) // 2 AS high FROM v) SELECT n.patch_id, block FROM n, h WHERE n.patch_id >= low AND n.patch_id < high")
def polygon_rows(spark, sf_dir):
    """The second quarter of the blocks in their own order, ids from their places."""
    rows = blocks(spark, sf_dir).withColumnRenamed("patch_id", "block")
    n = rows.count()
    return vector.vector_patches(rows, rows=(n // 4, n // 2)).select("patch_id", F.col("block").cast("long").alias("block"))
