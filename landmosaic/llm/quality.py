"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a whole text are counts and shares of its bytes, words and
lines; language, source and id are no part of them.  Trees are grown level by
level on histograms of binned statistics and kept as flat arrays of complete
binary trees, which numpy walks for all rows and trees at once.

The trees are fitted on at most ``FIT_ROWS`` labelled rows, taken in hash order
of their id from those not held out; everything else reads every row.  Null and
empty texts have all-zero statistics and get a score like any other.  Without
labels every score is 0.5; with one class it is that class's smoothed share.
Repeated rows are scored alike; of different texts under one id the one with the
smallest statistics is learnt from.  Texts of any length are read whole; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmosaic.llm.html_extract import STOP_WORDS
from landmosaic.llm.textnum import LOWER, Words, distinct_runs, lean, shingles, text_parts

FIT_ROWS = 20_000
CUT = 0.3
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 120, 5, 64, 0.1, 5.0, 20
#: Labels with this remainder of crc32(doc_id) by FOLDS are held out.
FOLDS, HELD_OUT = 5, 0


def _lut(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


CLASSES = {
    "upper": _lut(lambda b: 65 <= b <= 90), "lower": _lut(lambda b: 97 <= b <= 122), "digit": _lut(lambda b: 48 <= b <= 57),
    "space": _lut(lambda b: b in b" \t"), "high": _lut(lambda b: b >= 128), "stop": _lut(lambda b: b in b".!?"),
    "comma": _lut(lambda b: b in b",;:"), "symbol": _lut(lambda b: b in b"#$%&*+=<>@^_~|\\/{}[]"), "shout": _lut(lambda b: b == 33),
    "line": _lut(lambda b: b == 10),
}
NOT_LETTER = ~(CLASSES["upper"] | CLASSES["lower"] | CLASSES["high"])
LINE_GAP = _lut(lambda b: b in b"\r\n")


def _stop_hashes() -> np.ndarray:
    words = sorted(STOP_WORDS)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.unique(Words(data, np.array([0, len(data)])).hash)


STOP_HASHES = _stop_hashes()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    total = np.maximum(size, 1)

    def most_of(row: np.ndarray, value: np.ndarray) -> np.ndarray:  # row is sorted
        top, head = np.zeros(n), np.flatnonzero(np.diff(row, prepend=-1))
        if len(head):
            top[row[head]] = np.maximum.reduceat(value, head)
        return top

    seen = np.bincount(np.repeat(np.arange(n) * 256, size) + data, minlength=n * 256).reshape(n, 256)
    out = [np.log1p(size)]
    out += [seen @ lut / total for lut in CLASSES.values()]
    low = LOWER[data]
    words = Words(low, offsets)
    count = np.diff(words.first)
    some = np.maximum(count, 1)
    by = lambda row, value: np.bincount(row, value, n)[:n]
    mean = by(words.row, words.size) / some
    out += [np.log1p(count), mean, np.sqrt(np.maximum(by(words.row, words.size.astype(float) ** 2) / some - mean**2, 0))]
    row, _, times = distinct_runs(words.row, words.hash)
    most = most_of(row, times)
    out += [np.log1p(most_of(words.row, words.size)), np.bincount(row, minlength=n) / some, most / some, by(row, times == 1) / some]
    row, value = shingles(words, 2)
    all_ = np.maximum(np.bincount(row, minlength=n), 1)
    row, _, times = distinct_runs(row, value)
    most = most_of(row, times)
    out += [np.bincount(row, minlength=n) / all_, most / all_]
    letters = Words(low, offsets, NOT_LETTER)
    some = np.maximum(np.diff(letters.first), 1)
    known = STOP_HASHES[np.minimum(np.searchsorted(STOP_HASHES, letters.hash), len(STOP_HASHES) - 1)] == letters.hash
    out += [by(letters.row, known) / some, by(letters.row, letters.size == 1) / some, by(letters.row, letters.size > 16) / some]
    lines = Words(data, offsets, LINE_GAP)
    some = np.maximum(np.diff(lines.first), 1)
    row, _, times = distinct_runs(lines.row, lines.hash)
    ends = data[lines.start + lines.size - 1] if len(lines.start) else np.zeros(0, np.uint8)
    out += [np.log1p(some), by(row, times > 1) / some, np.bincount(row, minlength=n) / some, by(lines.row, lines.size) / some, by(lines.row, CLASSES["stop"][ends]) / some]
    return np.column_stack(out)


@dataclass
class Forest:
    """Complete binary trees: node ``i`` has the children ``2 i + 1`` and ``2 i + 2``."""

    base: float
    feature: np.ndarray  # tree, inner node
    threshold: np.ndarray
    leaf: np.ndarray  # tree, leaf

    def score(self, x: np.ndarray, step: int = 4096) -> np.ndarray:
        out = np.empty(len(x))
        trees = np.arange(len(self.leaf))
        for at in range(0, len(x), step):
            part = x[at : at + step]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(trees)), np.int64)
            for _ in range(DEPTH if len(trees) else 0):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
            margin = self.base + (self.leaf[trees, node - (2**DEPTH - 1)].sum(axis=1) if len(trees) else 0)
            out[at : at + step] = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return out


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees of the logistic loss."""
    none = np.zeros((0, 2**DEPTH - 1))
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Forest(base, none.astype(np.int64), none, np.zeros((0, 2**DEPTH)))
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    margin = np.full(n, base)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            width, offset = 2**level, 2**level - 1
            local = node - offset
            gain = np.full((width, m, BINS), -np.inf)
            for j in range(m):
                key = local * BINS + binned[:, j]
                sums = [np.bincount(key, w, width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (g, h, None)]
                (gl, hl, nl), (gt, ht, nt) = sums, (s[:, -1:] for s in sums)
                fine = (nl >= LEAST) & (nt - nl >= LEAST)
                value = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[:, j] = np.where(fine, value, -np.inf)
            flat = gain.reshape(width, -1)
            top = flat.argmax(axis=1)
            good = flat[np.arange(width), top] > 1e-9
            cut_at = np.full(width, BINS)
            for k in np.flatnonzero(good):
                j, b = divmod(int(top[k]), BINS)
                if b < len(cuts[j]):
                    feature[offset + k], threshold[offset + k], cut_at[k] = j, cuts[j][b], b
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut_at[local])
        at = node - (2**DEPTH - 1)
        leaf = RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + RIDGE)
        margin += leaf[at]
        trees.append((feature, threshold, leaf))
    return Forest(base, *map(np.array, zip(*trees, strict=True)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def of_batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        parts = [statistics(data, offsets) for _, _, data, offsets in text_parts(batch.column(text))]
        yield batch, np.concatenate(parts) if parts else np.zeros((0, 0))


def train(docs: DataFrame, labels: DataFrame) -> Forest:
    """A forest from at most ``FIT_ROWS`` labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y"))
    known = known.where("id is not null and y in (0, 1)").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "id").select("text", "y", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in of_batches(batches, 0):
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    got = rows.mapInArrow(lean(run), "id long, y int, x array<double>").groupBy("id").agg(F.min("y"), F.min("x")).toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, 1)), np.zeros(0))
    order = np.argsort(got.column(0).to_numpy())
    return fit(np.array(got.column(2).to_pylist())[order], got.column(1).to_numpy()[order].astype(float))


def scored(docs: DataFrame, model: Forest, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of its text; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in of_batches(batches, at):
            score = shared.value.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, name])

    return docs.mapInArrow(lean(run), schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
