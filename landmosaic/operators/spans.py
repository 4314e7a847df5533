"""Spans of columns within a row: widening, joining, meeting and subtracting.

A span is ``row, c0, c1`` of something named by other columns.  Spans of two
tables meet through bins of columns: each stands in every bin it covers, and a
pair counts in the first bin that both cover.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmosaic.grid import GridSpec
from landmosaic.storage import dealt

#: Columns of a bin at least.
BIN = 64


def half_widths(distance: float, grid: GridSpec) -> list[tuple[int, int]]:
    """For each row step, how many columns to either side the cells whose squares are at most ``distance`` away go."""
    dx, dy = abs(grid.a), abs(grid.e)
    rows, cols = math.floor(distance / dy) + 1, math.floor(distance / dx) + 1
    gap = lambda k, side: max(abs(k) - 1, 0) * side
    widest = lambda r: next((c for c in range(cols, -1, -1) if math.hypot(gap(r, dy), gap(c, dx)) <= distance), None)
    return [(r, w) for r in range(-rows, rows + 1) if (w := widest(r)) is not None]


def row_steps(distance: float, grid: GridSpec, forward: bool = False) -> Column:
    """One row for each row step: ``dr`` and the half width ``w``; only steps down, and along the row, if ``forward``."""
    return F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(w).alias("w")) for r, w in half_widths(distance, grid) if r >= 0 or not forward]))


def bin_width(distance: float, grid: GridSpec) -> int:
    """Columns of a bin that a span widened by the distance covers a few of."""
    return max(BIN, 2 * (math.floor(distance / abs(grid.a)) + 1))


def merged_spans(spans: DataFrame, *keys: str) -> DataFrame:
    """``keys, row, c0, c1``: the spans of each row, those that overlap or adjoin joined."""
    keys = keys or ("t", "patch_id")
    place = Window.partitionBy(*keys, "row").orderBy("c0", "c1")
    before = F.max("c1").over(place.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.withColumn("new", F.coalesce((F.col("c0") > before + 1).cast("int"), F.lit(0)))
    numbered = flagged.withColumn("span", F.sum("new").over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "row", "span").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("span")


def widened(spans: DataFrame, distance: float, grid: GridSpec, *keys: str) -> DataFrame:
    """The spans within the distance of what each key holds, joined within a row."""
    keys = keys or ("t", "patch_id")
    wide = spans.withColumn("step", row_steps(distance, grid))
    return merged_spans(wide.select(*keys, (F.col("row") + F.col("step.dr")).alias("row"), (F.col("c0") - F.col("step.w")).alias("c0"), (F.col("c1") + F.col("step.w")).alias("c1")), *keys)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """Pairs of ``left`` (with ``l0, l1``) and ``right`` (with ``r0, r1``) rows of equal keys whose spans have a column in common."""
    place = lambda c: F.floor(F.col(c) / width).cast("long")
    cut = lambda df, a, b: df.withColumn("bin", F.explode(F.sequence(place(a), place(b))))
    met = dealt(cut(left, "l0", "l1")).join(cut(right, "r0", "r1"), [*keys, "bin"]).where("l0 <= r1 and r0 <= l1")
    return met.where(F.col("bin") == F.greatest(place("l0"), place("r0"))).drop("bin")


def met_walls(spans: DataFrame, walls: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """``keys, row, l0, l1, r0, r1``: the spans (keys, row, c0, c1) and every wall (t, row, c0, c1) they meet; walls that overlap or adjoin are joined."""
    numbered = spans.select(*keys, "row", F.col("c0").alias("l0"), F.col("c1").alias("l1"))
    merged = merged_spans(walls.select("t", "row", "c0", "c1"), "t")
    met = overlapping(numbered, merged.select("t", "row", F.col("c0").alias("r0"), F.col("c1").alias("r1")), ["t", "row"], width)
    return met.select(*keys, "row", "l0", "l1", "r0", "r1")


def without(spans: DataFrame, walls: DataFrame, keys: list[str], width: int = BIN, met: DataFrame | None = None) -> DataFrame:
    """``keys, row, c0, c1``: what is left of the spans (keys, row, c0, c1) where no wall (t, row, c0, c1) stands.

    ``met`` is what ``met_walls`` gives for the spans, found where it isn't given.
    Each span ends at one more wall, so a span is a piece before each of its walls.
    """
    met = met_walls(spans, walls, keys, width) if met is None else met
    end = F.col("c1") + 1
    ends = spans.select(*keys, "row", F.col("c0").alias("l0"), F.col("c1").alias("l1"), end.alias("r0"), end.alias("r1"))
    before = F.lag("r1").over(Window.partitionBy(*keys, "row", "l0", "l1").orderBy("r0")) + 1
    pieces = met.unionByName(ends).select(*keys, "row", F.coalesce(before, "l0").alias("c0"), (F.col("r0") - 1).alias("c1"))
    return pieces.where("c0 <= c1")
