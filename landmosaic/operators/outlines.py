"""Distances of every two sets of runs, block by block.

Sets lie in blocks by their first rows.  Blocks meet in pairs, and a pair gives
its distances as rows that nothing holds on to, so that what is stored grows
with the sets and not with their pairs.  Of sets that lie wholly above or below
one another only the runs that can be seen from there count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructType

from landmosaic.storage import dealt, materialize

#: Sets of a block, runs of a set that is held in one, cells of a matrix of runs, parts that blocks are dealt into to meet.
BLOCK, RUNS, MATRIX, PARTS = 128, 2048, 200_000, 16
#: Different distances that a task remembers.
HELD = 1 << 22
ARRAYS = ("c", "start", "row", "c0", "c1", "up", "down")
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def visible(c0: np.ndarray, c1: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which runs of a set show a column that those before them in the order leave open."""
    seen, base, covered = np.zeros(len(c0), bool), c0.min(), np.zeros(c1.max() - c0.min() + 1, bool)
    for i in order:
        span = covered[c0[i] - base : c1[i] - base + 1]
        seen[i] = not span.all()
        span[:] = True
    return seen


def packed(runs: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for each block: its sets ``c``, where their runs ``start``, and the runs, with those that show from above and below."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("c", "ascending"), ("row", "ascending"), ("c0", "ascending")])
        sets, row, c0, c1 = (table.column(n).to_numpy() for n in ("c", "row", "c0", "c1"))
        c, start = np.unique(sets, return_index=True)
        up, down = np.zeros(len(row), bool), np.zeros(len(row), bool)
        for a, b in zip(start, [*start[1:], len(row)], strict=True):
            up[a:b], down[a:b] = visible(c0[a:b], c1[a:b], range(b - a)), visible(c0[a:b], c1[a:b], range(b - a - 1, -1, -1))
        columns = [[x.tolist()] for x in (c, start, row, c0, c1, up, down)]
        one = table.slice(0, 1)
        return pa.Table.from_arrays([one.column("t"), one.column("block"), *[pa.array(x, pa.list_(pa.bool_() if n in ("up", "down") else pa.int64())) for n, x in zip(ARRAYS, columns, strict=True)]], ["t", "block", *ARRAYS])

    fields = StructType([runs.schema["t"]]).add("block", "long")
    for n in ARRAYS:
        fields = fields.add(n, ArrayType(BooleanType() if n in ("up", "down") else LongType()))
    return runs.join(dealt(blocks), ["t", "c"]).select("t", "block", "c", *[F.col(n).cast("long").alias(n) for n in ("row", "c0", "c1")]).groupBy("t", "block").applyInArrow(pack, fields)


def shown(block: dict, which: str, deep: float) -> dict:
    """The runs of a block that can be seen from above (up) or below (down), at most so many rows behind the first of their set."""
    edge = block["row"][block["start"] if which == "up" else block["end"] - 1]
    keep = block[which] & (np.abs(block["row"] - np.repeat(edge, block["end"] - block["start"])) <= deep)
    n = np.add.reduceat(keep.astype(np.int64), block["start"])  # every set shows some run of its first row
    return {"start": np.cumsum(n) - n, "end": np.cumsum(n), **{k: block[k][keep] for k in ("row", "c0", "c1")}}


def depth(a: dict, b: dict, dx: float, dy: float) -> float:
    """How many rows behind the first of its set a run may lie to count: beyond, the rows outweigh all the columns between two runs of the blocks."""
    gap = max(b["row"].min() - a["row"].max(), a["row"].min() - b["row"].max()) - 1
    if gap < 0:
        return np.inf
    wide = (max(a["c1"].max(), b["c1"].max()) - min(a["c0"].min(), b["c0"].min())) * dx / dy
    return np.hypot(gap, wide) - gap + 1


def least_of(a: dict, i: int, b: dict, low: int, high: int, dx: float, dy: float) -> np.ndarray:
    """Of each run ``low`` to ``high`` of b, the squared distance from set i of a."""
    size = max(1, MATRIX // (high - low))
    best = np.full(high - low, np.inf)
    for at in range(a["start"][i], a["end"][i], size):
        row, c0, c1 = (a[n][at : min(at + size, a["end"][i]), None] for n in ("row", "c0", "c1"))
        rows = np.maximum(np.abs(row - b["row"][low:high]) - 1, 0) * dy
        cols = np.maximum(np.maximum(c0 - b["c1"][low:high], b["c0"][low:high] - c1) - 1, 0) * dx
        best = np.minimum(best, (cols * cols + rows * rows).min(axis=0))
    return best


def squares(a: dict, b: dict, same: bool, dx: float, dy: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``a``, where the sets of ``b`` it is paired with begin, and its squared distances from them."""
    for x in (a, b):
        x["end"] = np.append(x["start"][1:], len(x["row"]))
    deep = depth(a, b, dx, dy)
    views = {which: (shown(a, which, deep), shown(b, which, deep)) for which in ("up", "down")}
    first, last = b["row"][b["start"]], b["row"][b["end"] - 1]  # runs lie by rows
    for i in range(len(a["c"])):
        at = i + 1 if same else 0
        low, high = a["row"][a["start"][i]], a["row"][a["end"][i] - 1]
        found = np.full(len(b["c"]), np.inf)
        for sets, mine, theirs in ((first > high, "down", "up"), (last < low, "up", "down")):
            if sets[at:].any():
                view = views[theirs][1]
                all_ = np.minimum.reduceat(least_of(views[mine][0], i, view, 0, len(view["row"]), dx, dy), view["start"])
                found[sets] = all_[sets]
        for j in np.flatnonzero((first <= high) & (last >= low)):
            if j >= at:
                found[j] = least_of(a, i, b, b["start"][j], b["end"][j], dx, dy).min()
        yield at, found[at:]


def block_pairs(runs: DataFrame, sets: DataFrame) -> DataFrame:
    """Every two blocks of a slice, side by side; blocks are dealt out by their place, so that a task holds pairs about equally far apart."""
    spark = runs.sparkSession
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)  # a row is a pair of blocks
    parts = max(1, -(-sets.count() // BLOCK))
    dealt = materialize(sets.repartitionByRange(parts, "t", "r0", "c").select("t", "c", F.spark_partition_id().cast("long").alias("block")))
    blocks = materialize(packed(runs, dealt).repartition(min(PARTS, 3 * parts)))
    blocks = blocks.repartitionByRange(min(PARTS, 3 * parts), "t", "block")
    names = ("block", *ARRAYS)
    one = blocks.select("t", *[F.col(n).alias(f"a_{n}") for n in names])
    other = blocks.select(F.col("t").alias("s"), *[F.col(n).alias(f"b_{n}") for n in names])
    return one.hint("shuffle_replicate_nl").join(other, (F.col("t") == F.col("s")) & (F.col("a_block") <= F.col("b_block"))).drop("s")


def read_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, dict, dict, bool]]:
    """Slice and arrays of the pairs of blocks, and whether it is a block with itself."""
    for batch in batches:
        for k in range(batch.num_rows):
            get = lambda n: batch.column(n)[k]  # noqa: B023, E731
            a, b = ({n: get(f"{p}_{n}").values.to_numpy(zero_copy_only=False) for n in ARRAYS} for p in "ab")
            yield get("t"), a, b, get("a_block").as_py() == get("b_block").as_py()


def block_distances(runs: DataFrame, sets: DataFrame, dx: float, dy: float) -> DataFrame:
    """``t, src, dst, distance`` of every two ``sets`` (t, c, r0) of a slice, ``src < dst``, from their ``runs`` (t, c, row, c0, c1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, a, b, same in read_pairs(batches):
            found = list(squares(a, b, same, dx, dy))
            one, other = np.repeat(a["c"], [len(d) for _, d in found]), np.concatenate([b["c"][at:] for at, _ in found])
            distance = np.sqrt(np.concatenate([d for _, d in found]))
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.repeat(t, len(one)), pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other)), pa.array(distance)], ["t", "src", "dst", "distance"])

    return block_pairs(runs, sets).mapInArrow(run, StructType([runs.schema["t"]]).add("src", "long").add("dst", "long").add("distance", "double"))


def distinct_block_distances(runs: DataFrame, sets: DataFrame, dx: float, dy: float) -> DataFrame:
    """``t, distance``: the different distances in ``block_distances``, each a few times at most however many pairs have it.

    A task gives out what it has met once, unless that is more than ``HELD``; the
    tasks of pairs about as far apart have some in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Scalar, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(values), 1 << 16):
                some = values[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.repeat(t, len(some)), pa.array(some)], ["t", "distance"])

        met: dict[pa.Scalar, list[np.ndarray]] = {}
        for t, a, b, same in read_pairs(batches):
            mine = met.setdefault(t, [np.empty(0)])
            mine.append(np.sqrt(np.concatenate([d for _, d in squares(a, b, same, dx, dy)])))
            if sum(map(len, mine[1:])) > max(len(mine[0]), HELD // 4):
                mine[:] = [np.unique(np.concatenate(mine))]
                if len(mine[0]) > HELD:
                    yield from out(t, mine[0])
                    mine[:] = [np.empty(0)]
        for t, mine in met.items():
            yield from out(t, np.unique(np.concatenate(mine)))

    return block_pairs(runs, sets).mapInArrow(run, StructType([runs.schema["t"]]).add("distance", "double"))
