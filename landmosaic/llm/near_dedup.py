"""Near-duplicate groups by a chosen-path set similarity join.

A document is the set of hashes of its word shingles; equal sets are one
vertex, whatever the number of copies.  Every independent tree starts with all
sets in one root and branches on minwise tokens: a node picks about
``1 / threshold`` minwise functions from its own name, and a set goes to the
child named after its minimum.  Children with one set end; small ones compare
all their sets by signature; larger ones first take out the sets that resemble
most of the node, comparing each with all others once, and branch the rest.
Nodes too large for a task branch as Spark rounds.  What no branching can split
is compared with a few of its own sets first; once these have linked it to
groups, its blocks are compared in pairs, but no two blocks of one group, so a
group of near copies of any size costs in proportion.  Trees repeat until the
target recall.

Candidates are confirmed on the full sets, in two rounds.  The first takes a few
trees, and from a node of many resembling sets only its strongest pairs.  The
second asks every node for all pairs between groups not yet linked; a node
crowded with them, in whichever tree, gets the full sets of its members, which
one task then compares exactly, and hands over a spanning forest of their links;
where these sets are more than a task should hold, pairs of blocks of them are.
Crowded nodes of the same members are compared once.  Groups are the
connected components of the confirmed links.

Null, empty and blank texts have an empty set and are linked with nothing;
texts with fewer words than a shingle are one shingle of all their words.
Repeated rows are linked like copies.  Rows without an id are linked like any
other and kept, but are no group's smallest; a group of such rows alone has no
component_id.  Very long texts are shingled whole.  Only ``doc_id`` and ``text``
are read, whatever else there is; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmosaic.components import connected_components, forest
from landmosaic.llm.textnum import LOWER, Words, distinct_runs, lean, mix, shingles, text_parts
from landmosaic.storage import discard, materialize

FUNCTIONS, TREES, SEED = 128, 10, 11
#: How far below the threshold a signature may be, in standard errors.
SLACK = 5.0
#: Nodes up to this many sets are compared whole; beyond the other, no task holds them.
LEAF, LARGEST = 48, 4096
#: Levels of branching inside a task, and as Spark rounds.
DEPTH, ROUNDS = 10, 6
#: Pairs a set hands over from a node in the first round; the second hands over all.
PAIRS = 2
#: Trees of the first round.
EARLY = 2
#: A node is crowded by more likely pairs than these, and than so many for each set.
CROWD, CROWD_EACH = 64, 4
#: Shingles and sets compared at a time in a crowded node, and bytes of full sets that a task holds for one.
COLUMNS, ROWS = 1024, 512
CROWD_BYTES = 8 << 20
#: Sets of a node that nothing splits, against which all of it is compared first.
REPRESENTATIVES = 32

_rng = np.random.default_rng(SEED)
ODD64 = _rng.integers(1, 2**62, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD32 = _rng.integers(1, 2**30, FUNCTIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def chosen(name: int, threshold: float) -> np.ndarray:
    """The functions that the node ``name`` branches on: 1 / threshold of them on average, one at least."""
    rng = np.random.default_rng(name & (2**63 - 1))
    more = 1 / threshold
    n = int(more) + (rng.random() < more - int(more))
    return rng.choice(FUNCTIONS, max(1, n), replace=False)


def text_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``row, hash`` of the distinct shingles of each text, sorted."""
    row, value, _ = distinct_runs(*shingles(Words(LOWER[data], offsets), n))
    return row, value


def set_names(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit name of each row's set."""
    out = np.zeros(rows, np.uint64)
    head = np.flatnonzero(np.diff(row, prepend=-1))
    if len(head):
        out[row[head]] = mix(np.add.reduceat(mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), head))
    return out.view(np.int64)


def first_level(threshold: float) -> list[tuple[int, int]]:
    """Tree and function of every child of the roots."""
    return [(t, int(i)) for t in range(TREES) for i in chosen(t + 1, threshold)]


def sketch_rows(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """``doc_id, owner, n, name, keys, sig``: set size, set name, first-level nodes and signature of each document."""
    first = first_level(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_parts(batch.column(2)):
                rows = high - low
                row, value = text_sets(data, offsets, n)
                head = np.flatnonzero(np.diff(row, prepend=-1))
                at = row[head]
                size = np.bincount(row, minlength=rows)
                sig = np.zeros((rows, FUNCTIONS), np.uint16)
                keys = np.zeros((rows, len(first)), np.uint64)
                if len(head):
                    narrow = (value >> np.uint64(32)).astype(np.uint32)
                    for i in range(FUNCTIONS):
                        least = np.minimum.reduceat(narrow * ODD32[i], head)
                        sig[at, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
                    minima = {i: np.minimum.reduceat(value * ODD64[i], head) for i in {i for _, i in first}}
                    for k, (t, i) in enumerate(first):
                        keys[at, k] = mix(minima[i] ^ np.uint64((t * FUNCTIONS + i + 1) * 0x9E3779B97F4A7C15 % 2**64))
                key_lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * len(first) + 1, len(first)), pa.int32()), pa.array(keys.view(np.int64).ravel()))
                sigs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * FUNCTIONS), rows, [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, rows), batch.column(1).slice(low, rows), pa.array(size, pa.int64()), pa.array(set_names(row, value, rows)), key_lists, sigs], ["doc_id", "owner", "n", "name", "keys", "sig"])

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(doc_id.alias("doc_id"), owner_key(doc_id, text), text.alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, owner long, n long, name long, keys array<long>, sig binary")


# --- inside a task -----------------------------------------------------------


def resemblance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shares of equal minima, for each row of ``a`` and of ``b``."""
    out = np.empty((len(a), len(b)), np.float32)
    step = max(1, (1 << 21) // max(1, len(b) * FUNCTIONS))
    for i in range(0, len(a), step):
        out[i : i + step] = (a[i : i + step, None, :] == b[None, :, :]).mean(axis=2, dtype=np.float32)
    return out


class Node:
    """The sets of one node: names, sizes, signatures and the group each is in so far."""

    def __init__(self, name, size, sig, group, threshold, later=False):
        self.name, self.size, self.sig, self.group, self.threshold = name, size, sig, group, threshold
        self.floor = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / FUNCTIONS)
        self.pairs: list[np.ndarray] = []
        self.seen, self.most = 0, max(CROWD, CROWD_EACH * len(name)) if later else None

    @property
    def crowded(self) -> bool:
        return self.most is not None and self.seen > self.most

    def compare(self, left: np.ndarray, right: np.ndarray, same: bool) -> None:
        """Hand over the pairs that may be similar.

        The first round takes each set's strongest if they are many; the second
        takes all, up to where the node is crowded and left to the full sets.
        """
        step = max(1, (1 << 22) // max(1, len(right)))
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            likely = resemblance(self.sig[rows], self.sig[right])
            a, b = self.size[rows][:, None], self.size[right][None, :]
            likely[np.minimum(a, b) < self.threshold * np.maximum(a, b) * (1 - 1e-9)] = 0
            likely[self.group[rows][:, None] == self.group[right][None, :]] = 0
            if same:
                likely[rows[:, None] >= right[None, :]] = 0
            i, j = np.nonzero(likely >= self.floor)
            self.seen += len(i)
            if self.crowded:
                self.pairs.clear()
                return
            if self.most is None and len(i) > PAIRS * len(rows):
                i, j = self.strongest(likely, i, j, rows, right)
            self.pairs.append(np.column_stack([rows[i], right[j]]))

    def strongest(self, likely, i, j, rows, right):
        """Each set's best pairs, and that with the first set by name it resembles.

        Ties go to the smaller name, so that all nodes that hold the same sets
        choose the same pairs.
        """
        keep = []
        for one, other in ((i, right[j]), (j, rows[i])):
            for rank, most in ((-likely[i, j], PAIRS), (other, 1)):
                order = np.lexsort((other, rank, one))
                head = np.flatnonzero(np.diff(one[order], prepend=-1))
                nth = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
                keep.append(order[nth < most])
        keep = np.unique(np.concatenate(keep))
        return i[keep], j[keep]

    def branch(self, members: np.ndarray, name: int, depth: int) -> None:
        stack = [(members, name, depth)]
        while stack and not self.crowded:
            members, name, depth = stack.pop()
            if len(members) < 2:
                continue
            if len(members) <= LEAF or depth == 0:
                self.compare(members, members, True)
                continue
            sample = members[np.random.default_rng(name & (2**63 - 1)).choice(len(members), 16, replace=False)]
            alike = resemblance(self.sig[members], self.sig[sample]).mean(axis=1)
            dense = alike >= 0.6 * self.threshold
            if dense.any():  # compared with the whole node once, then out of it
                self.compare(members[dense], members[dense], True)
                self.compare(members[dense], members[~dense], False)
                members = members[~dense]
            for i in chosen(name, self.threshold) if len(members) > 1 else ():
                _, where, count = np.unique(self.sig[members, i], return_inverse=True, return_counts=True)
                order = np.argsort(where, kind="stable")
                ends = np.cumsum(count)
                for k in np.flatnonzero(count > 1):
                    child = members[order[ends[k] - count[k] : ends[k]]]
                    stack.append((child, child_name(name, int(i), int(self.sig[child[0], i])), depth - 1))


def child_name(name: int, i: int, value: int) -> int:
    return int(mix(np.array([name ^ ((i << 17 | value) + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)], np.uint64))[0] >> np.uint64(1))


def node_pairs(threshold: float, depth: int, later: bool):
    """Over rows sorted by node: candidate pairs, distinct within a batch of nodes, and the keys of crowded nodes with a name of their members."""

    none = np.zeros((0, 2), np.int64)

    def one(key: int, cols: list[np.ndarray]) -> tuple[np.ndarray, bool]:
        name, size, sig, group, side = cols
        node = Node(name, size, sig, group, threshold, later)
        every = np.arange(len(name))
        if (side >= 0).any():  # a pair of blocks of a node that no branching splits
            node.compare(every[side == 0], every[side == 1], False) if (side == 1).any() else node.compare(every, every, True)
        else:
            node.branch(every, key & (2**63 - 1), depth)
        if node.crowded:
            return none, True
        return np.sort(name[np.concatenate(node.pairs)], axis=1) if node.pairs else none, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        found: list[np.ndarray] = []
        crowded: list[tuple[int, int]] = []

        def flush(table: pa.Table) -> None:
            keys = table["key"].to_numpy()
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(len(keys), FUNCTIONS)
            cols = [table["name"].to_numpy(), table["n"].to_numpy(), sig, table["grp"].to_numpy(), table["side"].to_numpy()]
            head = np.append(np.flatnonzero(np.diff(keys, prepend=keys[0] ^ 1)), len(keys))
            for a, b in zip(head[:-1], head[1:], strict=True):
                if b - a > 1:
                    pairs, full = one(int(keys[a]), [c[a:b] for c in cols])
                    found.append(pairs)
                    if full:
                        same = set_names(np.zeros(b - a, np.int64), cols[0][a:b].view(np.uint64), 1)
                        crowded.append((int(keys[a]), int(same[0])))

        def out() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(found), axis=0) if found else none
            ends = [pa.array([*pairs[:, k].tolist(), *more], pa.int64()) for k, more in enumerate(([same for _, same in crowded], [None] * len(crowded)))]
            keys = pa.array([None] * len(pairs) + [key for key, _ in crowded], pa.int64())
            found.clear()
            crowded.clear()
            return pa.RecordBatch.from_arrays([*ends, keys], ["a", "b", "crowded"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            keys = held["key"].to_numpy()
            if keys[0] != keys[-1]:  # the last node may go on in the next batch
                cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
                flush(held.slice(0, cut))
                held = held.slice(cut)
                yield out()
        if held is not None:
            flush(held)
        yield out()

    return run


def exact_links(names: np.ndarray, members: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between full sets; between the two sides where there are two."""
    n, sizes = len(members), np.fromiter(map(len, members), np.int64, len(members))
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    _, column, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    again = count > 1
    kept = again[column]
    column, owner = (np.cumsum(again, dtype=np.int32) - 1)[column[kept]], owner[kept]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = [np.zeros((min(ROWS, n - at), n - at), np.float32) for at in range(0, n, ROWS)]  # the upper triangle, in stripes
    for low in range(0, int(again.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        held = np.zeros((n, COLUMNS), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        for k, stripe in enumerate(both):
            stripe += held[k * ROWS : (k + 1) * ROWS] @ held[k * ROWS :].T
    found = []
    for k, stripe in enumerate(both):
        at = k * ROWS
        common = stripe.astype(np.int64)
        linked = 100 * common >= percent * (sizes[at : at + len(stripe), None] + sizes[None, at:] - common)
        if (side == 1).any():
            linked &= side[at : at + len(stripe), None] != side[None, at:]
        i, j = np.nonzero(np.triu(linked, 1))
        found.append(np.column_stack(forest(i + at, j + at) if len(i) else (i, j)))
    i, j = np.concatenate(found).T
    one, root = forest(i, j) if len(i) else (i, j)
    return names[one], names[root]


def crowd_links(percent: int):
    """Over the full sets of crowded nodes, sorted by node: links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            a, b = exact_links(np.array([r[1] for r in held]), [np.frombuffer(r[2], np.uint64) for r in held], np.array([r[3] for r in held]), percent)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    return run


# --- Spark -------------------------------------------------------------------


def branch_rows(threshold: float):
    """Children of oversized nodes: the rows with the child's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sigs = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            out_name, out_key, out_tree = [], [], []
            for name, key, sig, tree in zip(names, batch.column(1).to_numpy(), sigs, batch.column(3).to_pylist(), strict=True):
                values = np.frombuffer(sig, np.uint16)
                for i in chosen(int(key) & (2**63 - 1), threshold):
                    out_name.append(name)
                    out_key.append(child_name(int(key) & (2**63 - 1), int(i), int(values[i])))
                    out_tree.append(tree)
            yield pa.RecordBatch.from_arrays([pa.array(out_name, pa.int64()), pa.array(out_key, pa.int64()), pa.array(out_tree, pa.int32())], ["name", "key", "tree"])

    return run


def tree_nodes(sets: DataFrame, threshold: float, largest: int) -> tuple[DataFrame, DataFrame | None]:
    """``name, key, tree, side``: the nodes of more than one set that each set stands in; and those that nothing splits."""
    trees = F.array(*[F.lit(t) for t, _ in first_level(threshold)])
    places = sets.select("name", F.posexplode("keys").alias("k", "key")).select("name", "key", F.get(trees, F.col("k")).alias("tree"))
    done = None
    for level in range(ROUNDS + 1):
        counted = places.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        places = materialize(places.join(counted, "key"))
        fits = places.where(F.col("members") <= largest).select("name", "key", "tree", F.lit(-1).alias("side"))
        done = fits if done is None else done.unionByName(fits)
        big = places.where(F.col("members") > largest)
        if big.isEmpty():
            return done, None
        if level < ROUNDS:
            rows = big.join(sets.select("name", "sig"), "name").select("name", "key", "sig", "tree")
            places = rows.mapInArrow(lean(branch_rows(threshold)), "name long, key long, tree int").distinct()
    return done, big


def beside_representatives(big: DataFrame, largest: int) -> DataFrame:
    """Blocks of the nodes that nothing splits, each beside a few sets of its node."""
    blocks = F.ceil(F.col("members") * 2 / largest).cast("int")
    own = big.select("name", "tree", "key", F.pmod(F.xxhash64("name"), blocks).alias("own"), F.lit(0).alias("side"))
    few = F.pmod(F.xxhash64("name", "key"), F.ceil(F.col("members") / REPRESENTATIVES)) == 0
    beside = big.where(few).select("name", "tree", "key", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))).alias("own"), F.lit(1).alias("side"))
    return own.unionByName(beside).select("name", F.xxhash64("key", "own").alias("key"), "tree", "side")


def between_groups(big: DataFrame, groups: DataFrame, largest: int) -> DataFrame:
    """Pairs of blocks of the nodes that nothing splits; a large group has blocks of its own, not compared with each other."""
    half = max(1, largest // 2)
    rows = big.join(groups, "name", "left").select("name", "key", "tree", F.coalesce("grp", "name").alias("grp"))
    size = rows.groupBy("key", "grp").agg(F.count("*").alias("n"))
    rows = rows.join(size, ["key", "grp"]).select("name", "key", "tree", F.when(F.col("n") > half, F.col("grp")).otherwise(0).alias("part"))
    parts = rows.groupBy("key", "part").agg(F.ceil(F.count("*") / half).alias("blocks"))
    rows = materialize(rows.join(parts, ["key", "part"]).withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks"))))
    parts = materialize(parts)
    other = parts.select("key", F.col("part").alias("part2"), F.col("blocks").alias("blocks2"))
    pairs = parts.join(other, "key").where("part < part2 or (part = part2 and part = 0)")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    pairs = pairs.withColumn("own", each("blocks")).withColumn("own2", each("blocks2")).where("part < part2 or own <= own2")
    pairs = pairs.withColumn("pair", F.xxhash64("key", "part", "own", "part2", "own2"))
    left = pairs.select("key", "part", "own", "pair", F.lit(0).alias("side"))
    right = pairs.where("part <> part2 or own <> own2").select("key", F.col("part2").alias("part"), F.col("own2").alias("own"), "pair", F.lit(1).alias("side"))
    return rows.join(left.unionByName(right), ["key", "part", "own"]).select("name", F.col("pair").alias("key"), "tree", "side")


def crowd_blocks(crowds: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """``key, name, side``: crowded nodes, those with more than ``most`` bytes of full sets as pairs of blocks."""
    rows = crowds.join(sets.select("name", (8 * F.col("n")).alias("bytes")), "name")
    total = rows.groupBy("key").agg(F.sum("bytes").alias("total"))
    blocks = F.when(F.col("total") <= most, 1).otherwise(F.ceil(2 * F.col("total") / most))
    rows = rows.join(total, "key").select("name", "key", blocks.cast("long").alias("blocks")).withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == low, 0).otherwise(1)
    return rows.select(F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high)).alias("key"), "name", side.alias("side"))


def candidates(nodes: DataFrame, sets: DataFrame, groups: DataFrame | None, threshold: float) -> DataFrame:
    """``a, b, crowded``: pairs of sets, or a name of the members and the key of a node crowded with pairs."""
    rows = nodes.join(sets.select("name", "n", "sig"), "name")
    rows = rows.join(groups, "name", "left").withColumn("grp", F.coalesce("grp", "name")) if groups is not None else rows.withColumn("grp", F.col("name"))
    rows = rows.select("name", "n", "sig", "grp", "side", "key").repartition("key").sortWithinPartitions("key", "name")
    return rows.mapInArrow(lean(node_pairs(threshold, DEPTH, groups is not None)), "a long, b long, crowded long").distinct()


def owner_key(doc_id: Column, text: Column) -> Column:
    """By what a set's text is found again; the set's name tells it from others of the same key."""
    return F.coalesce(doc_id, F.xxhash64(text)).alias("owner")


def full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``name, members`` of the sets in ``wanted`` (name, owner), from the texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(1).to_numpy()
            for low, high, data, offsets in text_parts(batch.column(0)):
                row, value = text_sets(data, offsets, n)
                names = set_names(row, value, high - low)
                first = np.searchsorted(row, np.arange(high - low + 1))
                same = np.flatnonzero(names == want[low:high])
                yield pa.RecordBatch.from_arrays([pa.array(names[same]), pa.array([value[first[r] : first[r + 1]].tobytes() for r in same], pa.binary())], ["name", "members"])

    texts = docs.select(owner_key(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.col("text").cast("string").alias("text"))
    return texts.join(wanted, "owner").select("text", "name").mapInArrow(lean(run), "name long, members binary").dropDuplicates(["name"])


def confirmed(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(y) < len(x):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    left = pairs.join(members.select(F.col("name").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(members.select(F.col("name").alias("b"), F.col("members").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85, largest: int = LARGEST, crowd_bytes: int = CROWD_BYTES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    threshold = percent / 100
    base = materialize(sketch_rows(docs, shingle, threshold))
    filled = base.where("n > 0")
    owners = filled.groupBy("name").agg(F.min("owner").alias("owner"))
    sets = materialize(filled.join(owners, ["name", "owner"], "left_semi").dropDuplicates(["name"]).select("name", "owner", "n", "keys", "sig"))
    fits, big = tree_nodes(sets, threshold, largest)
    fits = materialize(fits)
    early = fits if big is None else fits.unionByName(beside_representatives(big, largest))
    first = materialize(candidates(early.where(F.col("tree") < EARLY), sets, None, threshold).select("a", "b"))
    members = materialize(full_sets(docs, wanted(first, sets), shingle))
    links = materialize(confirmed(first, members, percent))
    groups = materialize(grouped(links))
    nodes = fits if big is None else materialize(fits.unionByName(between_groups(big, groups, largest)))
    asked = materialize(candidates(nodes, sets, groups, threshold))
    second = materialize(asked.where("crowded is null").select("a", "b").join(first, ["a", "b"], "left_anti"))
    once = asked.where("crowded is not null").groupBy("a").agg(F.min("crowded").alias("key"))
    crowds = materialize(crowd_blocks(nodes.join(once, "key", "left_semi").select("key", "name").distinct(), sets, crowd_bytes))
    if not (second.isEmpty() and crowds.isEmpty()):
        more = wanted(second.unionByName(crowds.select(F.col("name").alias("a"), F.col("name").alias("b"))), sets)
        members = members.unionByName(materialize(full_sets(docs, more.join(members.select("name"), "name", "left_anti"), shingle)))
        links = links.unionByName(confirmed(second, members, percent))
        inside = crowds.join(members, "name").select("key", "name", "members", "side").repartition("key").sortWithinPartitions("key")
        links = links.unionByName(inside.mapInArrow(lean(crowd_links(percent)), "a long, b long"))
        groups = materialize(grouped(links))
    discard(nodes)
    rows = base.select("doc_id", "n", "name").join(groups, "name", "left").withColumn("grp", F.coalesce("grp", "name"))
    least = rows.where("n > 0").groupBy("grp").agg(F.min("doc_id").alias("component_id"))
    linked = rows.where("n > 0").join(least, "grp").select("doc_id", "n", "component_id")
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def grouped(links: DataFrame) -> DataFrame:
    """``name, grp`` of every linked set."""
    return connected_components(links, "a", "b").select(F.col("node").alias("name"), F.col("component").alias("grp"))


def wanted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()
    return sets.select("name", "owner").join(ends, "name", "left_semi")


#: Every pair with a shingle in common, in SQL.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, t.b FROM reach r JOIN both_ways t ON t.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""
