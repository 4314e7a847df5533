"""Landscapes derived from the supplied tables, for queries and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmosaic.grid import GridSpec

WIDTH, TIMES = 150, (1996, 1997, 1998)
GRID = GridSpec(a=30.0, e=-30.0, width=WIDTH, crs="EPSG:32635")
#: Corners of the L-shaped region of interest.
REGION = ((300, -300), (300, -1500), (1500, -1500), (1500, -900), (900, -900), (900, -300))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str, rotating: bool = False) -> DataFrame:
    """Three slices of ``orders`` as a raster; converted cells only spread, or come and go if ``rotating``."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"))
    part = table(spark, sf_dir, "part").where("p_partkey < 200").select(F.col("p_partkey").alias("block"), F.col("p_type").alias("base"))
    row, col = F.floor(F.col("o_orderkey") / WIDTH), F.col("o_orderkey") % WIDTH
    rows = orders.select("year", row.alias("row"), col.alias("col"))
    rows = rows.withColumn("block", (F.floor(F.col("row") / 4) * 38 + F.floor(F.col("col") / 4)) % 200).join(part, "block")
    rows = rows.withColumn("t", F.explode(F.array(*[F.lit(t).cast("long") for t in TIMES])))
    changed = F.col("year").between(F.col("t") - 1, F.col("t")) if rotating else F.col("year") <= F.col("t")
    return rows.select("t", "row", "col", F.when(changed, "URBAN").otherwise(F.col("base")).alias("class_label"))


def cells_sql(rotating: bool = False) -> str:
    test = "year(o_orderdate) BETWEEN t - 1 AND t" if rotating else "year(o_orderdate) <= t"
    return f"""cells AS MATERIALIZED (SELECT t, o_orderkey // {WIDTH} AS row, o_orderkey % {WIDTH} AS col, t * 100000000 + o_orderkey AS id, CASE WHEN {test} THEN 'URBAN' ELSE p_type END AS class_label
  FROM orders JOIN part ON p_partkey = ((o_orderkey // {WIDTH} // 4) * 38 + (o_orderkey % {WIDTH}) // 4) % 200, (SELECT CAST(unnest([{', '.join(map(str, TIMES))}]) AS BIGINT) AS t))"""


def groups_sql(nodes: str, pairs: str, name: str) -> str:
    """Components ``id, lab`` of a graph by recursive propagation of the smallest id."""
    return f"""{name}_nb AS MATERIALIZED (SELECT a, b FROM {pairs} UNION ALL SELECT b, a FROM {pairs}),
{name}_cc(id, lab) USING KEY (id) AS (SELECT id, id FROM {nodes} UNION SELECT n.b, min(c.lab) FROM {name}_cc c JOIN {name}_nb n ON c.id = n.a JOIN recurring.{name}_cc r ON r.id = n.b WHERE c.lab < r.lab GROUP BY n.b)"""


def labels_sql(source: str = "cells", name: str = "pc") -> str:
    """Patch ids of the cells in ``source``."""
    steps = ["b.row = a.row AND b.col = a.col + 1", "b.row = a.row + 1 AND b.col = a.col"]
    pairs = " UNION ALL ".join(f"SELECT a.id AS a, b.id AS b FROM {source} a JOIN {source} b ON a.t = b.t AND a.class_label = b.class_label AND {s}" for s in steps)
    return f"""{name}_one AS MATERIALIZED ({pairs}), {groups_sql(source, name + "_one", name)},
{name} AS MATERIALIZED (SELECT t, row, col, class_label, lab % 100000000 AS patch_id FROM {source} JOIN {name}_cc USING (id))"""


def merged_sql(test: str, label: str) -> str:
    """Patches ``mp`` after patches of one (new) label that touch, corners too, became one."""
    return f"""q AS MATERIALIZED (SELECT DISTINCT t, t * 100000000 + patch_id AS id, class_label, {label} AS new_label FROM pc),
touch AS MATERIALIZED (SELECT e.t * 100000000 + src AS a, e.t * 100000000 + dst AS b FROM edges e JOIN q x ON x.id = e.t * 100000000 + src JOIN q y ON y.id = e.t * 100000000 + dst WHERE x.new_label = y.new_label AND {test}),
{groups_sql("q", "touch", "mg")}, mp AS (SELECT pc.t, lab % 100000000 AS patch_id, new_label AS class_label, count(*) AS n_cells FROM pc JOIN q ON q.id = pc.t * 100000000 + pc.patch_id JOIN mg_cc ON mg_cc.id = q.id GROUP BY ALL)"""


#: Patch table over cells named pc.
PATCHES_SQL = """sides AS (SELECT p.*, CASE WHEN l.patch_id IS NULL THEN 1 ELSE 0 END + CASE WHEN r.patch_id IS NULL THEN 1 ELSE 0 END + CASE WHEN u.patch_id IS NULL THEN 1 ELSE 0 END + CASE WHEN d.patch_id IS NULL THEN 1 ELSE 0 END AS open FROM pc p
  LEFT JOIN pc l ON l.t = p.t AND l.row = p.row AND l.col = p.col - 1 AND l.patch_id = p.patch_id LEFT JOIN pc r ON r.t = p.t AND r.row = p.row AND r.col = p.col + 1 AND r.patch_id = p.patch_id
  LEFT JOIN pc u ON u.t = p.t AND u.row = p.row - 1 AND u.col = p.col AND u.patch_id = p.patch_id LEFT JOIN pc d ON d.t = p.t AND d.row = p.row + 1 AND d.col = p.col AND d.patch_id = p.patch_id),
patches AS MATERIALIZED (SELECT t, patch_id, class_label, count(*) AS n_cells, count(*) * 900.0::DOUBLE AS area, CAST(sum(open) AS DOUBLE) * 30 AS perimeter, min(col) * 30.0::DOUBLE AS xmin, (max(row) + 1) * -30.0::DOUBLE AS ymin, (max(col) + 1) * 30.0::DOUBLE AS xmax, min(row) * -30.0::DOUBLE + 0 AS ymax, avg(row) AS mr, avg(col) AS mc FROM sides GROUP BY t, patch_id, class_label),
ratios AS MATERIALIZED (SELECT *, perimeter / area AS perimeter_area_ratio, 0.25 * perimeter / sqrt(area) AS shape_index, 2 * ln(0.25 * perimeter) / ln(area) AS fractal_dimension FROM patches)"""

EDGES_SQL = """edges AS MATERIALIZED (SELECT DISTINCT a.t, least(a.patch_id, b.patch_id) AS src, greatest(a.patch_id, b.patch_id) AS dst FROM pc a, (SELECT unnest([0, 1, 1, 1]) AS dr, unnest([1, -1, 0, 1]) AS dc) o, pc b WHERE b.t = a.t AND b.row = a.row + o.dr AND b.col = a.col + o.dc AND a.patch_id <> b.patch_id)"""


def vector_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles from ``supplier``."""
    u = F.round(F.abs("s_acctbal") * 100).cast("long")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", u.alias("u"))
    x0, y0 = (F.col("s_suppkey") % 10) * 10.0, F.floor(F.col("s_suppkey") / 10) * 10.0
    x1, y1 = x0 + 5 + (F.col("u") % 1200) / 100.0, y0 + 5 + ((F.col("u") * 7) % 1200) / 100.0
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(point(x0, y0), point(x0, y1), point(x1, y1), point(x1, y0))
    return rows.select(F.col("s_suppkey").cast("long").alias("patch_id"), (F.col("s_nationkey") % 4).cast("string").alias("class_label"), F.array(F.array(ring)).alias("geometry"))


RECTANGLES_SQL = """u AS (SELECT s_suppkey, s_nationkey, CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS u FROM supplier),
v AS (SELECT CAST(s_suppkey AS BIGINT) AS patch_id, CAST(s_nationkey % 4 AS VARCHAR) AS class_label, (s_suppkey % 10) * 10.0::DOUBLE AS xmin, (s_suppkey // 10) * 10.0::DOUBLE AS ymin,
  (s_suppkey % 10) * 10.0::DOUBLE + 5 + (u % 1200) / 100.0::DOUBLE AS xmax, (s_suppkey // 10) * 10.0::DOUBLE + 5 + ((u * 7) % 1200) / 100.0::DOUBLE AS ymax FROM u)"""

#: Columns of a many-sided polygon, each of its own height.
STEPS = 40


def many_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skylines from ``supplier``: some 80 sides in steps of one unit, with a hole of two to six columns."""
    n = F.col("n")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.round(F.abs("s_acctbal") * 100).cast("long").alias("n"), (F.col("s_nationkey") % 4).cast("string").alias("class_label"))
    x0, y0 = (F.col("id") % 10) * 25.0, F.floor(F.col("id") / 10) * 12.0
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    height = lambda i: 9 + (n + i * i * 7) % 11
    tops = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda i: F.array(point(x0 + i, y0 + height(i)), point(x0 + i + 1, y0 + height(i)))))
    outline = F.concat(F.array(point(x0, y0)), tops, F.array(point(x0 + STEPS, y0)))
    a, b = x0 + 5 + n % 20, x0 + 7 + n % 20 + n % 5
    hole = F.array(point(a, y0 + 2), point(b, y0 + 2), point(b, y0 + 6), point(a, y0 + 6))
    return rows.select(F.col("id").alias("patch_id"), "class_label", F.array(F.array(outline, hole)).alias("geometry"))


#: What the skylines hold of each unit column, as pieces of y.
COLUMNS_SQL = f"""u AS (SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS n FROM supplier),
c AS (SELECT id, n, i, (id % 10) * 25 + i AS x, (id // 10) * 12.0::DOUBLE AS y0, 9 + (n + i * i * 7) % 11 AS h, i >= 5 + n % 20 AND i < 7 + n % 20 + n % 5 AS open FROM u, (SELECT unnest(range({STEPS})) AS i)),
pieces AS MATERIALIZED (SELECT id, x, y0 AS low, y0 + CASE WHEN open THEN 2 ELSE h END AS high FROM c UNION ALL SELECT id, x, y0 + 6, y0 + h FROM c WHERE open)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of whole sides from ``supplier``, which overlap, share a border or meet in a corner, as it comes."""
    n = F.round(F.abs("s_acctbal") * 100).cast("long")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), n.alias("n"), (F.col("s_nationkey") % 4).cast("string").alias("class_label"))
    x0, y0 = (F.col("id") % 10) * 4, F.floor(F.col("id") / 10) * 4
    x1, y1 = x0 + 3 + F.col("n") % 3, y0 + 3 + F.floor(F.col("n") / 3) % 3
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(point(x0, y0), point(x0, y1), point(x1, y1), point(x1, y0))
    return rows.select(F.col("id").alias("patch_id"), "class_label", F.array(F.array(ring)).alias("geometry"))


BLOCKS_SQL = """u AS (SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS n, CAST(s_nationkey % 4 AS VARCHAR) AS class_label FROM supplier),
v AS (SELECT id AS patch_id, class_label, (id % 10) * 4 AS xmin, (id // 10) * 4 AS ymin, (id % 10) * 4 + 3 + n % 3 AS xmax, (id // 10) * 4 + 3 + (n // 3) % 3 AS ymax FROM u)"""
