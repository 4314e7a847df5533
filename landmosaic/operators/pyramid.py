"""Least distances between sets of cells by branch and bound.

Every set (a component) is a pyramid of boxes: the cells in each square of side
``STEP ** level``, with their tight bounds, their number and the first and last
of them.  Two boxes are at least as far apart as their bounds, and no further
than two of their cells; where both are full, exactly as far as their bounds.
Pairs of boxes descend level by level, and only those go on that could still
hold a distance below the best one known for their sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmosaic.storage import dealt, materialize

#: A square's side in squares of the level below.
STEP = 4
#: Sets of a slice in one block of pairs.
BLOCK = 512
#: Boxes along the side of a square in which neighbours meet.
SIDE = 4
NODE = ("br", "bc", "n", "r0", "r1", "k0", "k1", "first", "last")


class Pyramid:
    """Boxes ``t, c, level, br, bc, n, r0, r1, k0, k1, first, last`` of sets ``t, c, row, col``."""

    def __init__(self, cells: DataFrame):
        most = cells.agg(F.max(F.greatest("row", "col"))).first()[0] or 0
        self.top = 0
        while STEP**self.top <= most:
            self.top += 1
        rows = cells.select("t", "c", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.explode(F.sequence(F.lit(0), F.lit(self.top))).alias("level"))
        side = F.pow(F.lit(float(STEP)), "level")
        place = F.struct("row", "col")
        boxes = rows.groupBy("t", "c", "level", F.floor(F.col("row") / side).alias("br"), F.floor(F.col("col") / side).alias("bc")).agg(
            F.count("*").alias("n"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("k0"), F.max("col").alias("k1"), F.min(place)["col"].alias("first"), F.max(place)["col"].alias("last"),
        )
        self.boxes = materialize(boxes.sortWithinPartitions("level"))

    def level(self, level: int, p: str, key: str, parents: bool = True) -> DataFrame:
        """The boxes of a level, with columns called after ``p`` and the set after ``key``; ``p_pr, p_pc`` are the box above."""
        rows = self.boxes.where(F.col("level") == level)
        above = [F.floor(F.col(c) / STEP).cast("long").alias(f"{p}_{n}") for c, n in (("br", "pr"), ("bc", "pc"))] if parents else []
        return rows.select("t", F.col("c").alias(key), *above, *[F.col(c).alias(f"{p}_{c}") for c in NODE])


def squared(rows: Column, cols: Column, dx: float, dy: float) -> Column:
    """Of the distance of cells so many rows and columns apart, between their squares."""
    gap = lambda d, side: (F.greatest(d - 1, F.lit(0)) * side) ** 2
    return gap(cols, dx) + gap(rows, dy)


def bounded(pairs: DataFrame, dx: float, dy: float) -> DataFrame:
    """Adds ``least`` and ``most``: bounds of the squared distance of boxes a and b."""
    c = F.col
    apart = lambda x: F.greatest(c(f"a_{x}0") - c(f"b_{x}1"), c(f"b_{x}0") - c(f"a_{x}1"), F.lit(0))
    least = squared(apart("r"), apart("k"), dx, dy)
    full = lambda p: c(f"{p}_n") == (c(f"{p}_r1") - c(f"{p}_r0") + 1) * (c(f"{p}_k1") - c(f"{p}_k0") + 1)
    ends = [("r0", "first"), ("r1", "last")]
    some = F.least(*[squared(F.abs(c(f"a_{r}") - c(f"b_{s}")), F.abs(c(f"a_{k}") - c(f"b_{m}")), dx, dy) for r, k in ends for s, m in ends])
    return pairs.withColumn("least", least).withColumn("most", F.when(full("a") & full("b"), F.col("least")).otherwise(some))


def best_of(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that could improve on the best known for their keys, and one that says what it is."""
    best = F.least(F.min("most").over(Window.partitionBy(*keys)), F.col("best"))
    kept = pairs.withColumn("best", best).where("least < best or most = best")
    return materialize(kept.select("t", "src", "dst", "a_br", "a_bc", "b_br", "b_bc", "least", "best"))


def descended(tree: Pyramid, pairs: DataFrame, level: int, keys: list[str], dx: float, dy: float, tally: list[int] | None = None) -> DataFrame:
    """``keys, distance``: the least distance for each key, from pairs of boxes at ``level`` down to single cells."""
    stages = [pairs]
    for below in range(level - 1, -1, -1):
        open_pairs = stages[-1].where("least < best").select("t", "src", "dst", *[F.col(f"{p}_b{x}").alias(f"{p}_p{x}") for p in "ab" for x in "rc"], "best")
        met = open_pairs.join(dealt(tree.level(below, "a", "src")), ["t", "src", "a_pr", "a_pc"]).join(dealt(tree.level(below, "b", "dst")), ["t", "dst", "b_pr", "b_pc"])
        stages.append(best_of(bounded(met, dx, dy).where("least < best"), keys))
        if tally is not None:
            tally.append(stages[-1].count())
        if stages[-1].where("least < best").isEmpty():
            break
    found = stages[0].select(*keys, "best")
    for stage in stages[1:]:
        found = found.unionByName(stage.select(*keys, "best"))
    return found.groupBy(*keys).agg(F.sqrt(F.min("best")).alias("distance"))


def all_distances(tree: Pyramid, sets: DataFrame, dx: float, dy: float, tally: list[int] | None = None, some: DataFrame | None = None) -> DataFrame:
    """``t, src, dst, distance`` of every two sets (t, c) of a slice, ``src < dst``; with ``some`` (t, c) one of the two is among those.

    That so many rows come out is what is asked for; the pairs start in blocks of ``BLOCK`` sets.
    """
    most = sets.groupBy("t").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-most // BLOCK))
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = tree.level(tree.top, "a", "src", parents=False).withColumn("i", own("src")).withColumn("j", each)
    right = tree.level(tree.top, "b", "dst", parents=False).withColumn("j", own("dst")).withColumn("i", each)
    if some is not None:
        named = lambda df, key, name: df.join(dealt(some.select("t", F.col("c").alias(key), F.lit(True).alias(name))), ["t", key], "left")
        left, right = named(left, "src", "one"), named(right, "dst", "other")
    met = dealt(left).join(right, ["t", "i", "j"]).where("src < dst")
    pairs = bounded(met if some is None else met.where("one or other"), dx, dy)
    pairs = materialize(pairs.select("t", "src", "dst", "a_br", "a_bc", "b_br", "b_bc", "least", F.col("most").alias("best")))
    return descended(tree, pairs, tree.top, ["t", "src", "dst"], dx, dy, tally)


def in_squares(boxes: DataFrame, p: str, reach: int) -> DataFrame:
    """The boxes with ``pr, pc`` of each square of ``SIDE`` boxes that one so many boxes away lies in: a few, not one for each neighbour."""
    place = lambda x: F.floor(x / SIDE)
    around = lambda c: F.explode(F.sequence(place(F.col(c) - reach), place(F.col(c) + reach)))
    return boxes.withColumn("pr", around(f"{p}_br")).withColumn("pc", around(f"{p}_bc"))


def nearest_distances(tree: Pyramid, sets: DataFrame, dx: float, dy: float) -> DataFrame:
    """``t, src, distance`` from each set (t, c) to the nearest other one of its slice; none for the only one.

    Sets meet those in the squares around, first in single cells, then in
    squares of the next level for those that found none so near, whose boxes
    descend again: what is found within a square's side is the nearest.
    """
    several = sets.groupBy("t").agg(F.count("*").alias("n")).where("n > 1")
    left = materialize(sets.join(several, "t", "left_semi").select("t", F.col("c").alias("src")))
    found = left.withColumn("distance", F.lit(0.0)).where("false")
    level = 0
    while not left.isEmpty():
        near = in_squares(tree.level(level, "a", "src", parents=False).join(dealt(left), ["t", "src"], "left_semi"), "a", 1)
        other = in_squares(tree.level(level, "b", "dst", parents=False), "b", 0)
        met = dealt(near).join(other, ["t", "pr", "pc"]).where("src <> dst and abs(a_br - b_br) <= 1 and abs(a_bc - b_bc) <= 1").withColumn("best", F.lit(float("inf")))
        got = materialize(descended(tree, best_of(bounded(met, dx, dy), ["t", "src"]), level, ["t", "src"], dx, dy))
        # cells that did not meet have at least a square's side between them
        sure = STEP**level * min(dx, dy) if level < tree.top else float("inf")
        got = got.where(F.col("distance") <= sure)
        found = found.unionByName(got)
        left = materialize(left.join(dealt(got), ["t", "src"], "left_anti"))
        level = min(level + 1, tree.top)
    return found
