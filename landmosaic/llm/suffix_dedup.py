"""Removal of every byte string of a given length that occurs more than once.

A 200-byte string and its copy agree on the smallest hash of their 20-byte
grams, so strings are first dealt out by that *minimizer*: a document becomes
one row for each run of window starts with the same minimizer, with the hash of
the bytes those windows cover (a *snippet*).  Equal snippets are counted, not
compared; what is left are different snippets that share a minimizer.  Their
texts meet in one task, a bounded batch of minimizers at a time, and are
compared through a Burrows-Wheeler transform: starting from the whole suffix
range, intervals are extended backwards breadth first, which yields the common
prefixes of neighbouring suffixes by increasing value; it stops at the length
asked for.  Suffixes not told apart by then start the same string.

Minimizers that a sample shows to be frequent are salted, so that none of the
counts sends a frequent string to one task.  A minimizer with more than ``SPLIT`` different snippets is dealt out anew by its
whole windows, so no task ever holds an unbounded group.

Null texts are empty; texts shorter than the length lose nothing; very long
ones are scanned in overlapping segments.  Strings are
judged on the input: every occurrence goes, the first one too.  Rows with the
same doc_id are separate documents; repeated rows, with or without an id, are
copies of one another, and their snippets and ranges are kept once.  Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmosaic.llm.textnum import BYTE, free_name, lean, mix, text_parts
from landmosaic.storage import materialize

LENGTH, GRAM = 200, 20
#: Different snippets of one minimizer that one task compares.
SPLIT = 4096
#: A minimizer is hot that is met so often in a sample of so many texts; what is beyond the most frequent ones has a small share each.
SAMPLE, SEED, HOT_SEEN, HOT_KEYS = 1 / 64, 17, 64, 10_000
#: Salts of a hot minimizer.
SALTS = 4096
#: Bytes of snippets in one transform.
BATCH = 1 << 19
#: Bytes scanned at a time; window places take so many bits of a sort key.
BITS = 18
SEGMENT = 200_000

_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int) -> np.ndarray:
    out = np.full(1 << BITS, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of all substrings of a stretch of bytes from its prefix sums."""

    up = down = None

    def __init__(self, data: np.ndarray):
        if Rolling.up is None:
            Rolling.up, Rolling.down = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * Rolling.up[: len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * Rolling.down[start]


def minimizer_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """``row, first, last, place, minimizer, digest`` of the runs of windows with one minimizer."""
    sizes = np.diff(offsets)
    count = np.maximum(sizes - length + 1, 0)  # window starts of each row
    if not count.any():
        return None
    rolling = Rolling(data)
    grams = (rolling.sums[gram:] - rolling.sums[:-gram]) * Rolling.down[: len(data) - gram + 1]
    mask = np.uint64((1 << BITS) - 1)
    low = (grams * np.uint64(0xD6E8FEB86659FD93)) & ~mask
    low |= np.arange(len(low), dtype=np.uint64)
    width, step = length - gram + 1, 1
    while 2 * step <= width:  # smallest of `step` grams from each place on, leftmost if equal
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    row = np.repeat(np.arange(len(sizes)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + offsets[row]
    place = (low[start] & mask).astype(np.int64)
    head = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    last = np.append(head[1:], len(row)) - 1
    first, end = start[head], start[last]
    return row[head], first, end, place[head], grams[place[head]].view(np.int64), mix(rolling.of(first, end + length)).view(np.int64)


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key")


def runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``minimizer, digest, doc_id, text_key, run``; run packs first window, windows and the minimizer's place."""
    names = ["minimizer", "digest", "doc_id", "text_key", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for low, _, data, offsets in text_parts(batch.column(2), SEGMENT // 2):
                for at in range(0, max(1, len(data) - length + 1), SEGMENT):  # more than once only for huge texts
                    part = data[at : at + SEGMENT + length - 1]
                    got = minimizer_runs(part, np.clip(offsets - at, 0, len(part)), length, gram)
                    if got is None:
                        continue
                    row, first, last, place, minimizer, digest = got
                    begin = first + at - offsets[row]
                    packed = begin << 16 | (last - first) << 8 | (place - first)
                    rows = pa.array(low + row)
                    yield pa.RecordBatch.from_arrays([pa.array(minimizer), pa.array(digest), ids.take(rows), keys.take(rows), pa.array(packed)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= length)
    return rows.select("doc_id", text_key(), "text").mapInArrow(lean(run), "minimizer long, digest long, doc_id long, text_key long, run long")


def hot_minimizers(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``minimizer, hot`` of the most frequent minimizers in a sample of the texts, ``HOT_KEYS`` at most.

    They only decide which rows are spread over tasks.
    """
    seen = runs(docs.sample(SAMPLE, SEED), length, gram).groupBy("minimizer").count().where(F.col("count") >= HOT_SEEN)
    return materialize(seen.orderBy(F.col("count").desc(), "minimizer").limit(HOT_KEYS).select("minimizer", F.lit(True).alias("hot")))


def begin(run: Column) -> Column:
    return F.shiftright(run, 16)


def windows(run: Column) -> Column:
    """Windows of a run, less one."""
    return F.shiftright(run, 8).bitwiseAND(F.lit(255))


# --- the transform -------------------------------------------------------------


def sorted_rotations(symbols: np.ndarray, depth: int, top: int) -> np.ndarray:
    """Rotations of ``symbols`` in the order of at least their first ``depth`` symbols, by prefix doubling."""
    n, known = len(symbols), 7
    key = np.zeros(n, np.int64)
    for j in range(known):
        key = key * (top + 1) + np.roll(symbols, -j)
    while True:
        order = np.argsort(key)
        value = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, value[1:] != value[:-1]))
        if known >= depth:
            return order
        key = rank * n + np.roll(rank, -known)
        known *= 2


def told_apart(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Where neighbours in ``order`` have a common prefix shorter than ``depth``.

    Breadth-first backward extension: the intervals of round ``d`` are the
    strings of ``d`` symbols whose end in the order was found in that round; an
    end found first when extending them has a common prefix of exactly ``d``.
    """
    n = len(symbols)
    before = symbols[order - 1]
    step = np.empty(n, np.int32)
    step[np.argsort(before, kind="stable")] = np.arange(n)
    ends = np.zeros(n + 1, bool)
    ends[[0, n]] = True
    low, high = np.array([0], np.int32), np.array([n], np.int32)
    for _ in range(depth):
        size = high - low
        whose = np.repeat(np.arange(len(low), dtype=np.int32), size)
        at = np.arange(len(whose), dtype=np.int32) + np.repeat(low - (np.cumsum(size, dtype=np.int32) - size), size)
        to = step[at]
        if 16 * len(to) > n:  # many: put them in place instead of sorting
            by = np.full(n, -1, np.int32)
            by[to] = np.arange(len(to), dtype=np.int32)
            by = by[by >= 0]
        else:
            by = np.argsort(to)
        to, whose, symbol = to[by], whose[by], before[at[by]]
        head = np.flatnonzero((np.diff(to, prepend=-2) != 1) | (np.diff(whose, prepend=-1) != 0) | (np.diff(symbol, prepend=-1) != 0))
        first, end = to[head], to[np.append(head[1:], len(to)) - 1] + 1
        fresh = ~ends[end]
        low, high = first[fresh], end[fresh]
        if not len(low):
            break
        ends[high] = True
    return ends


def repeated_windows(texts: list[bytes], count: np.ndarray, weight: np.ndarray, length: int) -> list[np.ndarray]:
    """For each snippet, which of its first ``count`` window starts begin a string that occurs twice in all."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    used, code = np.unique(data, return_inverse=True)
    symbols = np.zeros(len(data) + len(texts), np.int16)
    owner = np.repeat(np.arange(len(texts)), sizes)
    symbols[np.arange(len(data)) + owner] = code + 1  # a 0 after each snippet
    order = sorted_rotations(symbols.astype(np.int64), length, int(len(used)) + 1)
    ends = told_apart(symbols, order, length)
    group = np.empty(len(symbols), np.int64)
    group[order] = np.cumsum(ends[:-1]) - 1
    start = np.cumsum(sizes + 1) - (sizes + 1)
    which = np.repeat(np.arange(len(texts)), count)
    places = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + start[which]
    total = np.bincount(group[places], weight[which])
    return np.split(total[group[places]] >= 2, np.cumsum(count)[:-1])


def spans(flags: np.ndarray) -> np.ndarray:
    """``first, last`` of each stretch of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1])


def compare_snippets(length: int, most: int):
    """Over snippets sorted by minimizer and digest: the repeated window starts of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = repeated_windows([r[4] for r in held], np.array([r[3] + 1 for r in held]), np.array([r[2] for r in held], float), length)
            out = [(r[0], r[1], int(a), int(b)) for r, flags in zip(held, found, strict=True) for a, b in spans(flags)]
            held.clear()
            columns = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["minimizer", "digest", "a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] == held[-1][:2]:  # once more from a repeated row
                    continue
                if size >= most and row[0] != held[-1][0]:
                    yield flush()
                    size = 0
                held.append(row)
                size += len(row[4])
        if held:
            yield flush()

    return run


# --- Spark ---------------------------------------------------------------------


def cut_snippets(length: int):
    """Snippets out of their documents' texts; those of split minimizers window by window."""

    names = ["minimizer", "digest", "m", "more", "bytes", "split"]
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.bool_()]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 6
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last = None
        for batch in batches:
            for doc, key, text, wanted in zip(*batch.columns, strict=True):
                if (doc.as_py(), key.as_py()) == last:  # a repeated row; the join brings them together
                    continue
                last = doc.as_py(), key.as_py()
                text = text.as_py().encode()
                for w in wanted.as_py():
                    at, more = w["run"] >> 16, w["run"] >> 8 & 255
                    piece = text[at : at + more + length]
                    if w["split"]:
                        for i in range(more + 1):
                            d = hashlib.blake2b(piece[i : i + length], digest_size=16).digest()
                            out.append((w["minimizer"], w["digest"], w["m"], i, d, True))
                    else:
                        out.append((w["minimizer"], w["digest"], w["m"], more, piece, False))
                    if len(out) >= 8192:
                        yield rows(out)
        yield rows(out)

    return run


def removed_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, split: int = SPLIT, batch: int = BATCH) -> DataFrame:
    """``doc_id, text_key, ranges``: bytes ``[a, b)`` of repeated strings, of documents that have some."""
    hot = hot_minimizers(docs, length, gram)
    # a hot minimizer occurs more than once anyhow, so its rows are spread by a salt
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("digest", "doc_id", "run"), F.lit(SALTS))).otherwise(0)
    marked = runs(docs, length, gram).join(F.broadcast(hot), "minimizer", "left").withColumn("hot", F.col("hot").isNotNull())
    count = F.count("*").over(Window.partitionBy("minimizer", salt))
    shared = materialize(marked.withColumn("n", count).where("hot or n > 1").drop("n"))
    kinds = shared.groupBy("minimizer", "digest", "hot").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "text_key", "run")).alias("one"))
    many = shared.where("hot").groupBy("minimizer", "digest").count().groupBy("minimizer").agg(F.count("*").alias("many"))
    salt = F.when(F.col("hot"), F.pmod("digest", F.lit(SALTS))).otherwise(0)
    count = F.count("*").over(Window.partitionBy("minimizer", salt))
    kinds = materialize(kinds.withColumn("kinds", count).join(F.broadcast(many), "minimizer", "left").withColumn("kinds", F.coalesce("many", "kinds")).drop("many", "hot"))
    shared = shared.drop("hot")
    wanted = kinds.where("kinds > 1").select("one.doc_id", "one.text_key", F.struct("minimizer", "digest", "m", "one.run", (F.col("kinds") > split).alias("split")).alias("w"))
    wanted = wanted.groupBy("doc_id", "text_key").agg(F.collect_list("w").alias("wanted"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= length)
    texts = texts.select("doc_id", text_key(), "text")
    pieces = texts.join(wanted, (texts["doc_id"].eqNullSafe(wanted["doc_id"])) & (texts["text_key"] == wanted["text_key"]))
    pieces = pieces.select(texts["doc_id"], texts["text_key"], "text", "wanted").mapInArrow(lean(cut_snippets(length)), "minimizer long, digest long, m long, more long, bytes binary, split boolean")
    pieces = materialize(pieces)
    near = pieces.where("not split").select("minimizer", "digest", "m", "more", "bytes").repartition("minimizer").sortWithinPartitions("minimizer", "digest")
    found = near.mapInArrow(lean(compare_snippets(length, batch)), "minimizer long, digest long, a long, b long")
    alone = pieces.where("split")
    # a repeated row may have brought a snippet twice, but then its strings repeat anyhow
    twice = alone.groupBy("bytes").agg(F.sum("m").alias("all")).where("all > 1").select("bytes")
    hot = alone.join(twice, "bytes").select("minimizer", "digest", F.col("more").alias("a"), F.col("more").alias("b"))
    same = kinds.where("m > 1 and kinds = 1").select("minimizer", "digest", F.lit(0).cast("long").alias("a"), windows(F.col("one.run")).cast("long").alias("b"))
    repeated = found.unionByName(hot).unionByName(same)
    ranges = shared.join(repeated, ["minimizer", "digest"]).select("doc_id", "text_key", F.struct((begin(F.col("run")) + F.col("a")).alias("a"), (begin(F.col("run")) + F.col("b") + length).alias("b")).alias("r"))
    return ranges.groupBy("doc_id", "text_key").agg(F.collect_set("r").alias("ranges"))  # a set, as repeated rows all bring theirs


def union_of(ranges: np.ndarray) -> np.ndarray:
    """Disjoint, non-touching ranges with the same bytes."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    top = np.maximum.accumulate(ranges[:, 1])
    head = np.flatnonzero(np.append(True, ranges[1:, 0] > top[:-1]))
    return np.column_stack([ranges[head, 0], top[np.append(head[1:], len(ranges)) - 1]])


def cut_texts(text_at: int, ranges_at: int, emit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ranges_at)
            first = lists.offsets.to_numpy()
            flat = lists.flatten()
            pairs = np.column_stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()]) if len(flat) else np.zeros((0, 2), np.int64)
            filled = lists.is_valid().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(np.where(filled, np.diff(first), 0))])
            texts = batch.column(text_at).cast(pa.binary())
            out = []
            for i, text in enumerate(texts):
                text = text.as_py() or b""
                cut = union_of(pairs[at[i] : at[i + 1]]) if at[i + 1] > at[i] else pairs[:0]
                keep = np.concatenate([[0], cut.ravel(), [len(text)]])
                kept = b"".join(text[a:b] for a, b in zip(keep[::2], keep[1::2], strict=True)) if len(cut) else text
                out.append((text, cut, kept))
            yield emit(batch, out)

    return run


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``ranges`` (null where nothing goes)."""
    key, doc, other_key, other_doc, found = (free_name(docs.columns, name) for name in ("key", "doc", "other_key", "other_doc", "ranges"))
    left = docs.withColumn(key, text_key()).withColumn(doc, F.col("doc_id").cast("long"))
    right = ranges.select(F.col("doc_id").alias(other_doc), F.col("text_key").alias(other_key), F.col("ranges").alias(found))
    joined = left.join(right, F.col(doc).eqNullSafe(F.col(other_doc)) & (F.col(key) == F.col(other_key)), "left")
    return joined.drop(key, doc, other_doc, other_key)


def remove_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def emit(batch, out):
        removed = [int((cut[:, 1] - cut[:, 0]).sum()) for _, cut, _ in out]
        hashes = [hashlib.sha256(kept).hexdigest() for _, _, kept in out]
        columns = [batch.column(0), pa.array([len(t) for t, _, _ in out], pa.int64()), pa.array(removed, pa.int64()), pa.array([len(c) for _, c, _ in out], pa.int64()), pa.array(hashes, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = with_ranges(rows, removed_ranges(docs, length, **options))
    return joined.mapInArrow(lean(cut_texts(1, 2, emit)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_documents(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``, and ``n_chars`` counted again.

    A cut inside a character takes the rest of that character too.
    """
    names = docs.columns
    at = names.index("text")

    def emit(batch, out):
        texts = [kept.decode("utf-8", "ignore") if len(cut) else kept.decode("utf-8") for _, cut, kept in out]
        columns = list(batch.columns[: len(names)])
        columns[at] = pa.array([t if len(cut) or old.is_valid else None for t, (_, cut, _), old in zip(texts, out, batch.column(at), strict=True)], pa.string())
        if "n_chars" in names:
            columns[names.index("n_chars")] = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays(columns, names)

    rows = docs.withColumn("n_chars", F.col("n_chars").cast("long")) if "n_chars" in names else docs
    joined = with_ranges(rows, removed_ranges(docs, length, **options))
    return joined.mapInArrow(lean(cut_texts(at, len(names), emit)), rows.schema)
