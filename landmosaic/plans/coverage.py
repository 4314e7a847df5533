"""Registered queries for sources, sinks, accessors and small functions, with their SQL oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmosaic.functions import columns
from landmosaic.grid import GridSpec, window_lat_lon, world_coordinates
from landmosaic.landscape import Landscape
from landmosaic.operators import adjacency, edits, habitat, metrics, patches, timeline, vector
from landmosaic.plans.fixtures import EDGES_SQL, GRID, PATCHES_SQL, TIMES, WIDTH, cells, cells_sql, groups_sql, labels_sql, table, vector_patches
from landmosaic.plans.mosaic import BASE, CHANGE, CORNER, FIRST, INTERIOR, MEMBERS, QUERIES, VALID, WHOLE, labelled_runs, mapped, patch_rows, query, rounded, whole_habitat, whole_members
from landmosaic.sources import tables
from landmosaic.storage import materialize, shared_dir


def fresh_path(spark) -> str:
    return f"{shared_dir(spark)}/stored/{uuid.uuid4().hex}"


# --- sources and sinks -----------------------------------------------------------


@query("SELECT 0 AS t, CAST(c_custkey AS BIGINT) AS row, CAST(i AS BIGINT) AS col, v AS class_label FROM (SELECT c_custkey, unnest(range(3)) AS i, unnest([c_mktsegment, CASE WHEN c_nationkey % 3 > 0 THEN CAST(c_nationkey AS VARCHAR) END, 'x']) AS v FROM customer) WHERE v IS NOT NULL")
def raster_rows(spark, sf_dir):
    values = F.array("c_mktsegment", F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey").cast("string")), F.lit("x"))
    return tables.cells_from_rows(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), values.alias("values")))


@query(f"SELECT CAST(year(o_orderdate) AS BIGINT) AS t, CAST(o_orderkey // {WIDTH} AS BIGINT) AS row, CAST(o_orderkey % {WIDTH} AS BIGINT) AS col, o_orderstatus AS class_label FROM orders WHERE o_custkey % 3 = 1")
def raster_table(spark, sf_dir):
    pixels = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year"), F.floor(F.col("o_orderkey") / WIDTH).alias("line"), (F.col("o_orderkey") % WIDTH).alias("sample"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 3).alias("band"))
    return tables.cells_from_table(pixels, "line", "sample", "status", "year", band=1)


@query("SELECT r_name AS name, CAST(3 AS INTEGER) AS corners, CAST(r_regionkey AS DOUBLE) AS x, r_regionkey + 2.0::DOUBLE AS y FROM region WHERE contains(r_name, 'A')")
def region_geojson(spark, sf_dir):
    corner = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    k = F.col("r_regionkey")
    ring = F.array(corner(k, k), corner(k + 1, k), corner(k, k + 2))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    feature = F.struct(F.create_map(F.lit("name"), F.col("r_name")).alias("properties"), shape.alias("geometry"))
    path = fresh_path(spark)
    # a collection of few features is one document by its format
    table(spark, sf_dir, "region").agg(F.to_json(F.struct(F.collect_list(feature).alias("features")))).coalesce(1).write.text(path)
    found = tables.read_geojson(spark, path, contains="A")
    ring = F.col("geometry")[0][0]
    return found.select("name", F.size(ring).alias("corners"), F.array_min(F.transform(ring, lambda p: p["x"])).alias("x"), F.array_max(F.transform(ring, lambda p: p["y"])).alias("y"))


@query(f"WITH {cells_sql()}, legend AS (SELECT DISTINCT p_type AS class_label, lower(p_type) AS label FROM part) SELECT t, class_label, label, count(*) AS n FROM cells LEFT JOIN legend USING (class_label) GROUP BY ALL")
def legend_file(spark, sf_dir):
    path = fresh_path(spark)
    table(spark, sf_dir, "part").select("p_type", F.lower("p_type").alias("name")).distinct().write.option("sep", ";").option("header", True).csv(path)
    return columns.with_legend(cells(spark, sf_dir), tables.read_legend(spark, path, "p_type", "name")).groupBy("t", "class_label", "label").agg(F.count("*").alias("n"))


@query(f"""{BASE}, {EDGES_SQL}, {PATCHES_SQL} SELECT t, 'EPSG:32635' AS crs, 30.0::DOUBLE AS side, (SELECT count(*) FROM pc WHERE pc.t = p.t) AS cells, count(*) AS nodes, round(sum(perimeter), 6) AS perimeter, (SELECT count(*) FROM edges e WHERE e.t = p.t) AS edges FROM patches p GROUP BY t""")
def stored_landscape(spark, sf_dir):
    path = fresh_path(spark)
    Landscape.of_patch_cells(labelled_runs(spark, sf_dir), GRID).save(path)
    again = Landscape.load(spark, path)
    again.save(path, overwrite=True)  # over the very tables it reads
    stored = tables.read_landscape(spark, path)
    grid = tables.read_grid(spark, path)
    count = lambda df, name, *more: df.groupBy("t").agg(F.count("*").alias(name), *more)
    out = count(stored.cells, "cells").join(count(stored.nodes, "nodes", F.sum("perimeter").alias("perimeter")), "t").join(count(stored.edges, "edges"), "t")
    return rounded(out.select("t", F.lit(grid.crs).alias("crs"), F.lit(grid.a).alias("side"), "cells", "nodes", "perimeter", "edges"))


@query(f"{WHOLE} SELECT 'small and large' AS habitat, CAST(60 AS DOUBLE) AS most, t, src, dst, round(distance, 6) AS distance, (SELECT count(*) FROM good g WHERE g.t = l.t AND g.patch_id = l.src) * 900.0::DOUBLE AS area FROM links l")
def stored_habitat(spark, sf_dir):
    path = fresh_path(spark)
    tables.write_habitat(path, whole_habitat(labelled_runs(spark, sf_dir)))
    again = tables.read_habitat(spark, path)
    tables.write_habitat(path, again, overwrite=True)  # over the very tables it reads
    again = tables.read_habitat(spark, path)
    ends = again.nodes.select("t", F.col("patch_id").alias("src"), "area")
    rows = again.edges.join(ends, ["t", "src"])
    return rounded(rows.select(F.lit(again.name).alias("habitat"), F.lit(again.max_travel_distance).alias("most"), "t", "src", "dst", "distance", "area"))


@query(f"{BASE}, {PATCHES_SQL} SELECT t, patch_id, class_label, n_cells, perimeter FROM patches")
def stored_patches(spark, sf_dir):
    path = fresh_path(spark) + "/patches.parquet"
    tables.write_patches(patch_rows(spark, sf_dir), path)
    return spark.read.parquet(path).select("t", "patch_id", "class_label", "n_cells", "perimeter")


@query(f"WITH {cells_sql()} SELECT t, row, col, class_label FROM cells WHERE row >= 3 AND row < 8 AND col >= 12 AND col < 90 AND row % 2 + 1 = 2")
def lat_lon_window(spark, sf_dir):
    degrees = GridSpec(a=0.5, e=-0.5, c=-30.0, f=60.0, width=WIDTH, crs="EPSG:4326")
    banded = cells(spark, sf_dir).withColumn("band", F.col("row") % 2 + 1)
    return window_lat_lon(banded, degrees, (55.9, 58.4), (-23.9, 15.2), bands=[2]).drop("band")


@query(f"WITH {cells_sql()} SELECT t, class_label, count(*) AS n FROM cells WHERE t <> {TIMES[1]} GROUP BY ALL")
def stacked_slices(spark, sf_dir):
    rows = cells(spark, sf_dir)
    slices = {t: timeline.slice_at(rows, t).drop("t") for t in (TIMES[2], TIMES[0])}
    return timeline.stack_slices(slices).groupBy(F.col("t").cast("long").alias("t"), "class_label").agg(F.count("*").alias("n"))


# --- accessors and columns -----------------------------------------------------------


@query(f"WITH {cells_sql()} SELECT DISTINCT class_label FROM cells")
def class_list(spark, sf_dir):
    return columns.classes(cells(spark, sf_dir))


@query(f"""{BASE}, {PATCHES_SQL}, {EDGES_SQL} SELECT t, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, count(*) AS nodes, (SELECT count(*) FROM edges e WHERE e.t = p.t) AS edges, (SELECT count(DISTINCT patch_id) FROM pc WHERE pc.t = p.t AND class_label IN ('SMALL', 'LARGE')) AS habitat_nodes,
 (SELECT count(*) FROM edges e WHERE e.t = p.t AND src IN (SELECT patch_id FROM pc WHERE pc.t = p.t AND class_label IN ('SMALL', 'LARGE')) AND dst IN (SELECT patch_id FROM pc WHERE pc.t = p.t AND class_label IN ('SMALL', 'LARGE'))) AS habitat_edges FROM patches p GROUP BY t""")
def landscape_sizes(spark, sf_dir):
    land = Landscape.of_patch_cells(labelled_runs(spark, sf_dir), GRID)
    land.add_habitat("small and large", VALID)
    sizes = materialize(land.graph_sizes())
    own = sizes.where("habitat is null").drop("habitat")
    theirs = sizes.where("habitat is not null").select("t", F.col("nodes").alias("habitat_nodes"), F.col("edges").alias("habitat_edges"))
    return land.bounds.join(own, "t").join(theirs, "t")


@query("WITH r AS (SELECT o_orderkey, translate(right('000000000' || CAST(o_orderkey * 7919 AS VARCHAR), 9), '3456789', 'FF012FF') AS relation FROM orders) SELECT o_orderkey, relation, regexp_matches(relation, '^[012]..F.....$') AS one, regexp_matches(relation, '^.[012]...F..0$') AS other FROM r")
def relation_patterns(spark, sf_dir):
    text = F.concat(F.lit("000000000"), (F.col("o_orderkey") * 7919).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.translate(F.right(text, F.lit(9)), "3456789", "FF012FF").alias("relation"))
    return rows.select("o_orderkey", "relation", columns.match_relate(F.col("relation"), "T**F*****").alias("one"), columns.match_relate(F.col("relation"), "*T***F**0").alias("other"))


@query(f"{BASE}, {PATCHES_SQL} SELECT t, patch_id, round(area / 10000, 6) AS ha, round(perimeter / 1000, 6) AS km FROM patches")
def patch_units(spark, sf_dir):
    return rounded(patch_rows(spark, sf_dir).select("t", "patch_id", columns.hectares(F.col("area")).alias("ha"), columns.kilometres(F.col("perimeter")).alias("km")))


NUMBERS = "CASE node_dynamic " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in columns.DYNAMIC_NUMBERS.items()) + " END"


@query(f"{CHANGE} SELECT t, patch_id, CAST({NUMBERS} AS INTEGER) AS number FROM dyn")
def dynamic_numbers(spark, sf_dir):
    return timeline.dynamics(*mapped(spark, sf_dir)).select("t", "patch_id", columns.dynamic_number(F.col("node_dynamic")).cast("int").alias("number"))


def mercator_sql() -> str:
    """Degrees of UTM places of zone 35 by the series, in SQL."""
    radius, _, back, e = columns._series()
    u = "xi" + "".join(f" - {b!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(back, 1))
    v = "eta" + "".join(f" - {b!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(back, 1))
    phi = ["asin(sin(u) / cosh(v))"] + [f"asin(tanh(psi + {e!r} * atanh({e!r} * sin(p{k}))))" for k in range(5)]
    steps = "".join(f", s{k + 1} AS (SELECT *, {p} AS p{k + 1} FROM s{k})" for k, p in enumerate(phi[1:]))
    return f"""places AS (SELECT row, col, (700000 + 30 * (col + 0.5) - {columns.EAST}) / {columns.SCALE * radius!r}::DOUBLE AS eta, (5700000 - 30 * (row + 0.5)) / {columns.SCALE * radius!r}::DOUBLE AS xi FROM (SELECT DISTINCT row, col FROM cells)),
turned AS (SELECT *, CAST({u} AS DOUBLE) AS u, CAST({v} AS DOUBLE) AS v FROM places), s0 AS (SELECT *, {phi[0]} AS p0, atanh(sin(asin(sin(u) / cosh(v)))) AS psi FROM turned){steps}"""


@query(f"WITH {cells_sql()}, {mercator_sql()} SELECT row, col, round(degrees(atan2(sinh(v), cos(u))) + 27, 6) AS lon, round(degrees(p5), 6) AS lat FROM s5")
def cell_degrees(spark, sf_dir):
    places = cells(spark, sf_dir).select("row", "col").distinct()  # the slices share their places
    rows = world_coordinates(places, GridSpec(a=30.0, e=-30.0, c=700_000.0, f=5_700_000.0))
    there = columns.reproject_points(rows.select("row", "col", "x", "y"), "EPSG:32635", "EPSG:4326")
    return there.select("row", "col", F.round("x", 6).alias("lon"), F.round("y", 6).alias("lat"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS patch_id, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE round((5 + (u % 1200) / 100.0::DOUBLE) * (5 + ((u * 7) % 1200) / 100.0::DOUBLE), 4) END AS area FROM (SELECT *, CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS u FROM supplier)")
def empty_polygons(spark, sf_dir):
    rows = vector_patches(spark, sf_dir)
    rows = rows.withColumn("geometry", F.when(F.col("patch_id") % 3 > 0, F.col("geometry")).when(F.col("patch_id") % 2 > 0, F.slice("geometry", 1, 0)))
    return vector.vector_patches(rows).select("patch_id", F.round("area", 4).alias("area"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS patch_id, 5 + (s_suppkey % 7) AS side, true AS there FROM supplier")
def polygons_reprojected(spark, sf_dir):
    """Squares of some metres in UTM keep their place when turned to degrees and back, to a tenth of a millimetre."""
    k = F.col("s_suppkey")
    x, y, side = 400_000.0 + 40.0 * k, 5_600_000.0 - 30.0 * k, (5 + k % 7)
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    ring = F.array(point(x, y), point(x, y + side), point(x + side, y + side), point(x + side, y))
    rows = table(spark, sf_dir, "supplier").select(k.cast("long").alias("patch_id"), side.alias("side"), F.array(F.array(ring)).alias("geometry"))
    there = columns.reproject_geometry(rows, "EPSG:32635", "EPSG:4326")
    back = columns.reproject_geometry(there, "EPSG:4326", "EPSG:32635")
    off = F.zip_with(F.flatten(F.flatten(F.col("geometry"))), F.flatten(F.flatten(F.col("was"))), lambda p, q: F.greatest(F.abs(p["x"] - q["x"]), F.abs(p["y"] - q["y"])))
    both = back.join(rows.select("patch_id", F.col("geometry").alias("was")), "patch_id")
    return both.select("patch_id", "side", (F.array_max(off) < 1e-4).alias("there"))


# --- graphs through time ----------------------------------------------------------------


@query(f"{CORNER} SELECT trg_id FROM nm WHERE t0 = {FIRST} AND src_id = 0")
def identified_nodes(spark, sf_dir):
    return timeline.identify_node(timeline.node_map(labelled_runs(spark, sf_dir, True), "corner", GRID), FIRST, 0)


@query(f"{INTERIOR} SELECT n.t AS t0, n.patch_id AS src_id, coalesce(string_agg(CAST(trg_id AS VARCHAR), ',' ORDER BY trg_id), '') AS targets FROM (SELECT DISTINCT t, patch_id FROM pc WHERE t < {TIMES[-1]}) n LEFT JOIN nm ON nm.t0 = n.t AND nm.src_id = n.patch_id GROUP BY ALL")
def mapping_lists(spark, sf_dir):
    mapping, nodes = mapped(spark, sf_dir)
    return timeline.mapping_lists(mapping, nodes).select("t0", "src_id", F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"))


@query(f"""{INTERIOR}, s AS (SELECT t AS t0, patch_id AS src_id, row, col FROM pc WHERE t < {TIMES[-1]}), g AS (SELECT nm.t0, nm.src_id, pc.row, pc.col FROM nm JOIN pc ON pc.t = nm.t1 AND pc.patch_id = nm.trg_id)
SELECT t0, src_id, row, col, 'added' AS change FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM s) UNION ALL SELECT t0, src_id, row, col, 'removed' FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM g)""")
def polygon_diff_cells(spark, sf_dir):
    pc = labelled_runs(spark, sf_dir, True)
    return timeline.polygon_diff_cells(materialize(timeline.node_map(pc, "interior", GRID)), patches.run_cells(pc))


@query(f"{CHANGE} SELECT s.t, s.patch_id, s.area, d.node_dynamic, d.relative_growth, d.absolute_growth FROM sizes s LEFT JOIN dyn d ON d.t = s.t AND d.patch_id = s.patch_id")
def dynamics_table(spark, sf_dir):
    mapping, nodes = mapped(spark, sf_dir)
    return rounded(timeline.dynamics_table(timeline.dynamics(mapping, nodes), nodes))


@query(f"{BASE} SELECT t, patch_id, row_number() OVER (PARTITION BY t ORDER BY patch_id) - 1 AS node_index FROM (SELECT DISTINCT t, patch_id FROM pc)")
def dense_ids(spark, sf_dir):
    rows = edits.dense_ids(labelled_runs(spark, sf_dir).select("t", "patch_id").distinct())
    return rows.withColumn("node_index", F.col("node_index").cast("long"))


@query(f"WITH {cells_sql()} SELECT DISTINCT c AS class_label FROM (SELECT unnest(['URBAN', 'nowhere', 'SMALL', 'small']) AS c) WHERE c NOT IN (SELECT class_label FROM cells)")
def unknown_classes(spark, sf_dir):
    return edits.unknown_classes(cells(spark, sf_dir), ["URBAN", "nowhere", "SMALL", "small"])


@query(f"{WHOLE} SELECT h AS habitat, t, count(DISTINCT patch_id) AS nodes, (SELECT count(*) FROM links l WHERE l.t = g.t AND distance <= most) AS edges FROM good g, (SELECT unnest(['near', 'touching']) AS h, unnest([60, 0]) AS most) GROUP BY h, most, t")
def applied_to_habitats(spark, sf_dir):
    land = Landscape.of_patch_cells(labelled_runs(spark, sf_dir), GRID)
    land.add_habitat("near", VALID, max_travel_distance=60.0)
    land.add_habitat("touching", VALID)
    return habitat.apply_to_habitats(list(land.habitats.values()), lambda h: adjacency.graph_counts(h.nodes, h.edges))


@query(f"""{BASE}, {EDGES_SQL}, n AS (SELECT t, max(patch_id) + 1 AS id, min(patch_id) AS first FROM pc GROUP BY t)
SELECT t, src, dst FROM edges UNION SELECT t, first, id FROM n""")
def added_nodes(spark, sf_dir):
    pc = labelled_runs(spark, sf_dir)
    new = materialize(pc.groupBy("t").agg((F.max("patch_id") + 1).alias("patch_id"), F.min("patch_id").alias("first")))
    rows = new.select("t", "patch_id", F.lit("NEW").alias("class_label"))
    links = new.select("t", F.col("patch_id").alias("src"), F.col("first").alias("dst"))
    return edits.add_nodes(pc.groupBy("t", "patch_id").agg(F.min("class_label").alias("class_label"), patches.cell_count(pc).alias("n_cells")), adjacency.adjacency(pc), rows, links)[1]


# --- metrics --------------------------------------------------------------------------------


@query(f"""{BASE}, {PATCHES_SQL} SELECT t, 'num_patches' AS name, CAST(count(*) AS DOUBLE) AS value FROM patches GROUP BY t UNION ALL SELECT t, 'total_edge', sum(perimeter) FROM patches WHERE class_label = 'SMALL' GROUP BY t
UNION ALL SELECT t, 'avg_patch_area', round(avg(area), 6) FROM patches WHERE class_label = 'URBAN' GROUP BY t""")
def named_metrics(spark, sf_dir):
    rows = materialize(patch_rows(spark, sf_dir))
    one = lambda name, label=None: metrics.get_metric(name, rows, label).select("t", F.lit(name).alias("name"), "value")
    return rounded(one("num_patches").unionByName(one("total_edge", "SMALL")).unionByName(one("avg_patch_area", "URBAN")))


@query(f"""{BASE}, {PATCHES_SQL}, few AS (SELECT t, class_label, sum(area) AS one FROM patches WHERE n_cells <= 4 GROUP BY ALL), every AS (SELECT t, class_label, sum(area) AS other FROM patches GROUP BY ALL)
SELECT t, 'class' AS level, class_label, 'total_area' AS name, one, other, CAST(sign(one - other) AS INTEGER) AS "order" FROM few JOIN every USING (t, class_label)""")
def compared_metrics(spark, sf_dir):
    rows = materialize(patch_rows(spark, sf_dir))
    long_ = lambda df: metrics.metrics_long(metrics.class_metrics(df).select("t", "class_label", "total_area"), "class")
    return metrics.compare(long_(rows.where("n_cells <= 4")), long_(rows))


@query(f"""{BASE}, {PATCHES_SQL}, both_ AS (SELECT CAST(NULL AS VARCHAR) AS habitat, * FROM patches UNION ALL SELECT 'small and large', * FROM patches WHERE class_label IN ('SMALL', 'LARGE')),
w AS (SELECT habitat, t, 'landscape' AS level, CAST(NULL AS VARCHAR) AS class_label, count(*) AS n, sum(area) AS a FROM both_ GROUP BY habitat, t UNION ALL SELECT habitat, t, 'class', class_label, count(*), sum(area) FROM both_ GROUP BY habitat, t, class_label)
SELECT habitat, t, level, class_label, unnest(['num_patches', 'total_area']) AS name, unnest([CAST(n AS DOUBLE), a]) AS value FROM w""")
def graph_and_habitat_metrics(spark, sf_dir):
    land = Landscape.of_patch_cells(labelled_runs(spark, sf_dir), GRID)
    land.patches = materialize(land.patches)
    land.add_habitat("small and large", VALID)
    rows = land.metrics_of_graphs().where("level <> 'component' and name in ('num_patches', 'total_area')")
    return rows.select("habitat", "t", "level", "class_label", "name", "value")


@query(f"{BASE}, {PATCHES_SQL} SELECT t, class_label, CAST(count_if(n_cells = 1) AS DOUBLE) / count(*) AS single_share FROM patches GROUP BY ALL")
def own_metric(spark, sf_dir):
    metrics.register_metric("single_share", "class", lambda: F.avg((F.col("n_cells") == 1).cast("double")))
    try:
        return metrics.class_metrics(patch_rows(spark, sf_dir)).select("t", "class_label", "single_share")
    finally:
        metrics.forget_metric("single_share", "class")


@query(f"{BASE}, {PATCHES_SQL} SELECT t, class_label, round(max(area) - min(area), 6) AS area, round(max(perimeter) - min(perimeter), 6) AS perimeter FROM patches GROUP BY ALL")
def series_aggregator(spark, sf_dir):
    spread = metrics.of_series(lambda values: values.max() - values.min())
    return rounded(metrics.patch_aggregates(patch_rows(spark, sf_dir), spread).select("t", "class_label", "area", "perimeter"))


@query(f"{BASE}, {PATCHES_SQL} SELECT t, class_label, round(sqrt(avg(area * area)), 6) AS area, round(sqrt(avg(perimeter * perimeter)), 6) AS perimeter, round(median(area), 6) AS median_area FROM patches GROUP BY ALL")
def mergeable_aggregator(spark, sf_dir):
    """The root of the mean square, of one's own in mergeable parts, beside the exact median."""
    root = metrics.Mergeable(lambda x: [len(x), (x * x).sum()], lambda s: s.sum(axis=0), lambda s: (s[1] / s[0]) ** 0.5)
    rows = materialize(patch_rows(spark, sf_dir))
    median = metrics.patch_aggregates(rows, "median").select("t", "class_label", F.col("area").alias("median_area"))
    return rounded(metrics.mergeable_aggregates(rows, root).join(median, ["t", "class_label"]))


COMPONENT_SQL = f"""{BASE}, {EDGES_SQL}, {PATCHES_SQL}, nodes AS (SELECT t, patch_id, area, t * 100000000 + patch_id AS id FROM patches WHERE class_label IN ('SMALL', 'LARGE')),
pairs AS (SELECT x.id AS a, y.id AS b FROM edges e JOIN nodes x ON x.id = e.t * 100000000 + src JOIN nodes y ON y.id = e.t * 100000000 + dst),
{groups_sql('nodes', 'pairs', 'nc')}, sums AS (SELECT t, lab, sum(area) AS area FROM nodes JOIN nc_cc USING (id) GROUP BY ALL)"""


@query(f"{COMPONENT_SQL} SELECT 'small and large' AS habitat, t, unnest(['num_components', 'avg_component_area']) AS name, unnest([CAST(count(*) AS DOUBLE), round(avg(area), 6)]) AS value FROM sums GROUP BY t")
def habitat_component_level(spark, sf_dir):
    land = Landscape.of_patch_cells(labelled_runs(spark, sf_dir), GRID)
    land.patches, land.edges = materialize(land.patches), materialize(land.edges)
    land.add_habitat("small and large", VALID)
    return rounded(land.metrics_of_graphs().where("level = 'component' and habitat is not null").select("habitat", "t", "name", "value"))


@query(f"{BASE}, {PATCHES_SQL} SELECT s.t, s.c AS class_label, count(area) AS num_patches, coalesce(sum(area), 0) AS total_area FROM (SELECT * FROM (SELECT DISTINCT t FROM pc), (SELECT unnest(['URBAN', 'nowhere']) AS c)) s LEFT JOIN patches p ON p.t = s.t AND p.class_label = s.c GROUP BY s.t, s.c")
def absent_class_metrics(spark, sf_dir):
    return metrics.class_metrics(patch_rows(spark, sf_dir), ["URBAN", "nowhere"]).select("t", "class_label", "num_patches", "total_area")


# --- components of habitats --------------------------------------------------------------------

UNION_SQL = f"""{MEMBERS.replace("pc AS MATERIALIZED", "p0 AS MATERIALIZED").replace("FROM pc WHERE", "FROM p0 WHERE")}, pc AS MATERIALIZED (SELECT g.t, row, col, '-1' AS class_label, component_id AS patch_id FROM good g JOIN comp c ON c.t = g.t AND c.patch_id = g.patch_id)"""


@query(f"{UNION_SQL}, {PATCHES_SQL} SELECT t, patch_id AS component_id, class_label, n_cells, area, perimeter, xmin, ymin, xmax, ymax FROM patches")
def component_unions(spark, sf_dir):
    pc = labelled_runs(spark, sf_dir)
    return habitat.component_table(whole_members(pc)[0], pc, GRID).drop("rep_x", "rep_y")


@query(f"{UNION_SQL} SELECT DISTINCT p.t, p.patch_id AS component_id, p.row + r.d AS row, p.col + c.d AS col FROM pc p, k r, k c WHERE greatest(abs(r.d) - 1, 0) ** 2 + greatest(abs(c.d) - 1, 0) ** 2 <= 1")
def component_reach(spark, sf_dir):
    pc = labelled_runs(spark, sf_dir)
    return habitat.component_reach(whole_members(pc)[0], pc, 30.0, GRID)


@query(f"{BASE} SELECT t, patch_id, row, col FROM pc WHERE class_label = 'SMALL' AND t = {FIRST}")
def slice_of_landscape(spark, sf_dir) -> DataFrame:
    one = Landscape.of_patch_cells(labelled_runs(spark, sf_dir), GRID)[FIRST]
    return one.cells.where("class_label = 'SMALL'").select("t", "patch_id", "row", "col")


@query(f"WITH RECURSIVE {cells_sql()}, {labels_sql()} SELECT t, patch_id, count(*) AS n_cells FROM pc GROUP BY ALL")
def labelled_patches(spark, sf_dir):
    return patches.patch_table(labelled_runs(spark, sf_dir), GRID).select("t", "patch_id", "n_cells")
