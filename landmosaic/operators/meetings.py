"""Runs of patches that meet: side by side in a row, or from one row to the next.

Runs move once, to the bands of rows they lie in; the first row of a band also
goes to the band above, so whatever meets, meets within one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Rows of a band, and runs that a task holds at a time (more only if two rows have more).
BAND, HELD = 64, 500_000


def pairs_below(line: np.ndarray, follows: np.ndarray, c0: np.ndarray, c1: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of runs and of those in the next line that share a column, or nearly so with ``reach`` 1.

    Runs come by ``line`` and ``c0``; ``follows`` tells of each line whether the next one is the row below.
    """
    base = int(c0.min()) - reach
    width = int(c1.max()) - base + reach + 2
    if (int(line[-1]) + 2) * width >= 1 << 63:
        raise ValueError("the columns lie too far apart")
    place = lambda at, c: at * width + (c - base)
    low = np.searchsorted(np.maximum.accumulate(place(line, c1)), place(line + 1, c0 - reach))
    high = np.searchsorted(place(line, c0), place(line + 1, c1 + reach), side="right")
    n = np.where(follows[line], np.maximum(high - low, 0), 0)
    one = np.repeat(np.arange(len(line)), n)
    other = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    met = c1[other] >= c0[one] - reach
    return one[met], other[met]


def meetings(runs: DataFrame, inside: bool = False) -> DataFrame:
    """``t, one, other, beside, shared``: runs (t, patch_id, row, c0, c1) that touch, the upper or left one first.

    ``beside`` is 1 if they lie in one row, ``shared`` counts the columns they
    have in common from row to row, none at corners.  They are runs of two
    patches, or with ``inside`` runs of one patch that share a column.
    """

    def met(held: pa.Table, line: np.ndarray, starts: np.ndarray, upto: int) -> Iterator[pa.RecordBatch]:
        """What the runs before ``upto`` meet."""
        row, c0, c1, band, patch = (held.column(c).to_numpy() for c in ("row", "c0", "c1", "band", "patch_id"))
        at = slices(held, band)[starts]
        follows = np.append((at[1:] == at[:-1]) & (row[starts[1:]] == row[starts[:-1]] + 1), False)
        one, other = pairs_below(line, follows, c0, c1, 0 if inside else 1)
        keep = (one < upto) & ((patch[one] == patch[other]) == inside)
        one, other = one[keep], other[keep]
        shared = np.maximum(np.minimum(c1[one], c1[other]) - np.maximum(c0[one], c0[other]) + 1, 0)
        beside = np.zeros(len(one), np.int32)
        if not inside:
            left = np.flatnonzero((line[1:] == line[:-1]) & (c1[:-1] + 1 == c0[1:]) & (patch[1:] != patch[:-1]) & (row[:-1] // BAND == band[:-1]))
            left = left[left < upto]
            one, other = np.concatenate([one, left]), np.concatenate([other, left + 1])
            shared, beside = np.concatenate([shared, np.zeros(len(left), np.int64)]), np.concatenate([beside, np.ones(len(left), np.int32)])
        ids = held.column("patch_id")
        out = [held.column("t").take(pa.array(one)), ids.take(pa.array(one)), ids.take(pa.array(other)), pa.array(beside), pa.array(shared)]
        yield from pa.table(out, ["t", "one", "other", "beside", "shared"]).to_batches(max_chunksize=10_000)

    def slices(held: pa.Table, band: np.ndarray) -> np.ndarray:
        """A number for each slice and band, as they follow one another."""
        t = pc.dictionary_encode(held.column("t").combine_chunks(), null_encoding="encode").indices.to_numpy()
        return np.cumsum(np.append(False, (t[1:] != t[:-1]) | (band[1:] != band[:-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, most = [], 0, HELD
        for batch in batches:
            parts.append(batch)
            n += batch.num_rows
            if n >= most:
                held = pa.Table.from_batches(parts).combine_chunks()
                line, starts = lines(held)
                # the last line may go on, and what the line before it meets is not known before it ends
                if upto := int(starts[-2]) if len(starts) > 2 else 0:
                    last = int(starts[-1])
                    yield from met(held.slice(0, last), line[:last], starts[:-1], upto)
                parts, n = held.slice(upto).to_batches(), held.num_rows - upto
                most = max(HELD, 2 * n)
        if n:
            held = pa.Table.from_batches(parts).combine_chunks()
            yield from met(held, *lines(held), held.num_rows)

    def lines(held: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The line of each run, rows of slices and bands as they follow one another, and where each line starts."""
        at, row = slices(held, held.column("band").to_numpy()), held.column("row").to_numpy()
        new = np.append(True, (at[1:] != at[:-1]) | (row[1:] != row[:-1]))
        return np.cumsum(new) - 1, np.flatnonzero(new)

    bands = F.array_distinct(F.array(F.floor(F.col("row") / BAND), F.floor((F.col("row") - 1) / BAND)))
    dealt = runs.select("t", "patch_id", *[F.col(c).cast("long").alias(c) for c in ("row", "c0", "c1")], F.explode(bands).alias("band"))
    dealt = dealt.repartition("t", "band").sortWithinPartitions("t", "band", "row", "c0")
    ends = [StructField(c, runs.schema["patch_id"].dataType) for c in ("one", "other")]
    return dealt.mapInArrow(run, StructType([runs.schema["t"], *ends, StructField("beside", IntegerType()), StructField("shared", LongType())]))
