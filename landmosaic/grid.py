"""Cell tables and their place in the world.

A landscape is a long table of cells ``t, row, col, class_label``; row 0 is the
top.  A ``GridSpec`` holds the affine placement that turns cells into world
coordinates; everything is Column expressions and filters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """``x = a col + b row + c``, ``y = d col + e row + f`` of a cell's upper left corner."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = -1.0
    f: float = 0.0
    width: int = 1 << 20
    crs: str = ""

    @property
    def cell_area(self) -> float:
        return abs(self.a * self.e - self.b * self.d)

    def x(self, col: Column, row: Column) -> Column:
        return self.a * col + self.b * row + self.c

    def y(self, col: Column, row: Column) -> Column:
        return self.d * col + self.e * row + self.f

    def cell(self, x: float, y: float) -> tuple[float, float]:
        """Fractional ``row, col`` of a place."""
        det = self.a * self.e - self.b * self.d
        dx, dy = x - self.c, y - self.f
        return (self.a * dy - self.d * dx) / det, (self.e * dx - self.b * dy) / det


def require_same_grid(one: GridSpec, other: GridSpec) -> None:
    if one != other:
        raise ValueError("the landscapes lie on different grids or CRS; resample one of them first")


def world_coordinates(cells: DataFrame, grid: GridSpec) -> DataFrame:
    """Adds the centre ``x, y`` of each cell."""
    row, col = F.col("row") + 0.5, F.col("col") + 0.5
    return cells.withColumn("x", grid.x(col, row)).withColumn("y", grid.y(col, row))


def masked(cells: DataFrame, keep: Column) -> DataFrame:
    return cells.where(keep)


def sub_window(cells: DataFrame, x: tuple[int | None, int | None], y: tuple[int | None, int | None], height: int) -> DataFrame:
    """Cells with ``x[0] <= col < x[1]`` and likewise for y from the lower left; None leaves a side open."""
    out = cells
    up = F.lit(height - 1) - F.col("row")
    for place, (low, high) in ((F.col("col"), x), (up, y)):
        out = out.where(place >= low) if low is not None else out
        out = out.where(place < high) if high is not None else out
    return out


def window_lat_lon(cells: DataFrame, grid: GridSpec, lat: tuple[float, float], lon: tuple[float, float], bands: list[int] | None = None) -> DataFrame:
    """Cells of a WGS84 grid inside the bounds, optionally of some bands only."""
    if grid.crs != "EPSG:4326":
        raise ValueError("the grid must be in WGS84 (EPSG:4326)")
    for name, (low, high), most in (("latitude", lat, 90), ("longitude", lon, 180)):
        if not (-most <= low <= most and -most <= high <= most):
            raise ValueError(f"{name} must lie in [-{most}, {most}]")
        if low >= high:
            raise ValueError(f"the smaller {name} must come first")
    corners = [grid.cell(u, v) for u in lon for v in lat]
    rows, cols = zip(*corners, strict=True)
    # the cells that hold the bounds, the later one left out
    out = cells.where((F.col("row") >= math.floor(min(rows))) & (F.col("row") < math.floor(max(rows))))
    out = out.where((F.col("col") >= math.floor(min(cols))) & (F.col("col") < math.floor(max(cols))))
    return out.where(F.col("band").isin(bands)) if bands else out


def thumbnail(cells: DataFrame, shape: tuple[int, int], height: int | None = None, width: int | None = None) -> DataFrame:
    """Nearest-neighbour downsampling to ``height x width``; a missing side follows from the aspect ratio."""
    rows, cols = shape
    if height is None and width is None:
        height = min(rows, 256)
    height = height or max(1, round(width * rows / cols))
    width = width or max(1, round(height * cols / rows))
    if height > rows or width > cols:
        raise ValueError("a thumbnail is not larger than its raster")
    # the sampled row of thumbnail row i is floor((i + 1/2) rows / height); only the first i that hits counts
    new = lambda at, n, m: F.ceil((at.cast("double") * n) / m - 0.5).cast("long")
    i, j = new(F.col("row"), height, rows), new(F.col("col"), width, cols)
    hit = lambda k, n, m, at: (k >= 0) & (k < n) & (F.floor((k + 0.5) * m / n) == at)
    out = cells.withColumn("i", i).withColumn("j", j)
    return out.where(hit(F.col("i"), height, rows, F.col("row")) & hit(F.col("j"), width, cols, F.col("col"))).withColumn("row", F.col("i")).withColumn("col", F.col("j")).drop("i", "j")


def resample_nearest(cells: DataFrame, grid: GridSpec, target: GridSpec, shape: tuple[int, int]) -> DataFrame:
    """Cells of ``target``, each with what the source cell under its centre holds."""
    spark = cells.sparkSession
    rows, cols = shape
    new = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("new_row"), (F.col("id") % cols).alias("new_col"))
    u, v = F.col("new_col") + 0.5, F.col("new_row") + 0.5
    x, y = target.x(u, v) - grid.c, target.y(u, v) - grid.f
    det = grid.a * grid.e - grid.b * grid.d
    new = new.withColumn("row", F.floor((grid.a * y - grid.d * x) / det).cast("long")).withColumn("col", F.floor((grid.e * x - grid.b * y) / det).cast("long"))
    return cells.join(new, ["row", "col"]).drop("row", "col").withColumnsRenamed({"new_row": "row", "new_col": "col"})


def clip(cells: DataFrame, grid: GridSpec, segments: DataFrame) -> DataFrame:
    """Cells whose centre lies inside a region, by counting crossings of a ray to the right.

    ``segments`` (x1, y1, x2, y2) are dealt out to the grid rows whose centre
    line they cross, so each cell meets only the few that matter to it.
    Needs an axis-aligned grid.
    """
    if grid.b or grid.d:
        raise ValueError("clip needs an axis-aligned grid")
    line = lambda y: (y - grid.f) / grid.e - 0.5
    s = segments.where("y1 <> y2").select("x1", "y1", "x2", "y2", F.least(line(F.col("y1")), line(F.col("y2"))).alias("low"), F.greatest(line(F.col("y1")), line(F.col("y2"))).alias("high"))
    s = s.select("*", F.ceil("low").cast("long").alias("r0"), (F.ceil("high") - 1).cast("long").alias("r1")).where("r0 <= r1")
    s = s.select("x1", "y1", "x2", "y2", F.explode(F.sequence("r0", "r1")).alias("row"))
    s = s.select("row", (F.col("x1") + (grid.y(F.lit(0.5), F.col("row") + 0.5) - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("cross"))
    crossings = s.groupBy("row").agg(F.array_sort(F.collect_list("cross")).alias("crossings"))
    x = grid.x(F.col("col") + 0.5, F.lit(0.0))
    inside = F.size(F.filter("crossings", lambda c: c > x)) % 2 == 1
    return cells.join(crossings, "row").where(inside).select(*cells.columns)
