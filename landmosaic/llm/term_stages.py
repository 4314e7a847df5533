"""Ranked lexical search by pipelined term partitioning.

Terms are owned by stages according to how rare they are.  The items of a bundle
travel through the stages, rarest terms first, and carry sparse accumulators:
documents with the integer score they have so far.  At a stage a bundle is
co-grouped with the postings of that stage's terms; contributions are added, and
documents are left behind that cannot reach the item's ``k`` best any more, as
what all later stages can add is known.  Documents are dealt into shards by
postings, so a group holds one bundle and one shard, however large the tables
are and however frequent a term is; a last ranking joins what the shards found.

A text is tokenised once.  Documents of one text are one entry with its number
of copies and its ``k`` smallest ids, so copies cost nothing and ties among them
are settled without carrying them along.

Terms are 64-bit hashes of their bytes.  Null texts have no term; an item without
terms, or none of whose terms occur, has no rows.  Rows under one id, or without
one, are separate items or documents; documents without an id come last among
equal scores.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmosaic.llm.textnum import LOWER, Words, distinct_runs, lean, text_parts
from landmosaic.storage import discard, materialize

K = 20
#: A stage owns the terms in at least this share of the documents, up to the share of the next.
SHARES = (0.0, 1 / 64, 1 / 16, 1 / 4)
#: Postings of a shard and items of a bundle, about.
SHARD, BUNDLE = 1 << 19, 256
#: Query terms that are sent to every task (16 MB at most); beyond that, postings meet them in a join.
VOCABULARY = 1 << 20
#: Bytes of a text that are split into terms at a time.
STRETCH = 1 << 20
#: Scores of a term are below its weight times this.
CEILING = 1_000_000
TOP = 2**63 - 1

BREAK = np.ones(256, bool)
BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


# --- terms ---------------------------------------------------------------------


def stretches(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``first row, bytes, offsets`` of many short texts or of a piece of a long one, which ends where no term is."""
    for row, _, data, offsets in text_parts(column, STRETCH):
        at = 0
        while len(data) - at > 2 * STRETCH:  # only a single text is that long
            gap = at + STRETCH
            while gap < len(data):
                found = np.flatnonzero(BREAK[data[gap : gap + STRETCH]])
                if len(found):
                    gap += int(found[0])
                    break
                gap += STRETCH
            gap = min(gap, len(data))
            yield row, data[at:gap], np.array([0, gap - at])
            at = gap
        yield row, data[at:], offsets if at == 0 else np.array([0, len(data) - at])


def counted_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``size`` of each row in terms, and ``row, term, count`` of its distinct terms, sorted."""
    size = np.zeros(len(column), np.int64)
    found = []
    for first, data, offsets in stretches(column):
        words = Words(LOWER[data], offsets, BREAK)
        np.add.at(size, words.row + first, 1)
        row, value, count = distinct_runs(words.row, words.hash)
        found.append((row + first, value.view(np.int64), count))
    row, term, count = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (size[:0], size[:0], size[:0])
    order = np.lexsort((term, row))
    row, term, count = row[order], term[order], count[order]
    head = np.flatnonzero((np.diff(row, prepend=-1) != 0) | np.append(True, term[1:] != term[:-1])[: len(row)])
    return size, row[head], term[head], np.add.reduceat(count, head) if len(head) else count


def term_lists(rows: DataFrame, keep: np.ndarray | None = None) -> DataFrame:
    """``id, key, n, terms, counts`` of rows ``id, key, text``: all terms counted in ``n``, those in ``keep`` (sorted) listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, row, term, count = counted_terms(batch.column(2))
            if keep is not None:
                at = np.minimum(np.searchsorted(keep, term), max(0, len(keep) - 1))
                known = keep[at] == term if len(keep) else np.zeros(len(term), bool)
                row, term, count = row[known], term[known], count[known]
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (term, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), *lists], ["id", "key", "n", "terms", "counts"])

    return rows.mapInArrow(lean(run), "id long, key binary, n long, terms array<long>, counts array<long>")


def keyed(table: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, key, text``; texts that are equal have one key of 128 bits."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select("id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")


def entries(rows: DataFrame, k: int) -> DataFrame:
    """``doc, ids, copies, n, terms, counts``: one entry for each text, with its ``k`` smallest ids."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.col("id").asc_nulls_last()))
    ids = rows.select("key", "id").withColumn("nth", nth).where(F.col("nth") <= k)
    ids = ids.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("nth", "id"))).alias("ids"))
    one = rows.groupBy("key").agg(F.min("doc").alias("doc"), F.count("*").alias("copies")).join(ids, "key")
    return rows.select("doc", "n", "terms", "counts").join(one.select("doc", F.col("ids.id").alias("ids"), "copies"), "doc")


# --- stages ----------------------------------------------------------------------


def stage_of(df: Column, n: int, shares: tuple[float, ...]) -> Column:
    return sum((F.when(df >= share * n, 1).otherwise(0) for share in shares[1:]), F.lit(0)).cast("int")


def dealt(docs: DataFrame, terms: DataFrame, known: dict[str, np.ndarray] | None, stages: int) -> DataFrame:
    """``doc, first_id, shard, m, stage, terms, counts``: the postings of a document by the stage that owns them."""
    about = ["doc", "first_id", "shard", "m"]
    if known is None:  # more query terms than a task should hold
        flat = docs.select(*about, F.explode(F.arrays_zip("terms", "counts")).alias("p")).select(*about, F.col("p.terms").alias("term"), F.col("p.counts").alias("count"))
        flat = flat.join(terms.select("term", "stage"), "term")
        lists = flat.groupBy(*about, "stage").agg(F.collect_list(F.struct("term", "count")).alias("p"))
        return lists.select(*about, "stage", F.col("p.term").alias("terms"), F.col("p.count").alias("counts"))
    names, stage = known["term"], known["stage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            ends = lists.offsets.to_numpy()
            term, count = lists.flatten().to_numpy(), batch.column(5).flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            at = np.minimum(np.searchsorted(names, term), max(0, len(names) - 1))
            owner = np.where(names[at] == term, stage[at], -1) if len(names) else np.full(len(term), -1)
            for s in range(stages):
                own = np.flatnonzero(owner == s)
                rows, size = np.unique(row[own], return_counts=True)
                cut = pa.array(np.append(0, np.cumsum(size)), pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(x[own])) for x in (term, count)]
                yield pa.RecordBatch.from_arrays([c.take(pa.array(rows)) for c in batch.columns[:4]] + [pa.array(np.full(len(rows), s), pa.int32()), *lists], [*about, "stage", "terms", "counts"])

    return docs.select(*about, "terms", "counts").mapInArrow(lean(run), "doc long, first_id long, shard int, m long, stage int, terms array<long>, counts array<long>")


def flat_list(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy()
    return ends - (ends[0] if len(ends) else 0), lists.flatten().to_numpy()


BUNDLED = "bundle int, shard int, item long, terms array<long>, stages array<int>, weights array<long>, docs array<long>, ids array<long>, scores array<long>"


def passed(stage: int, k: int, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Adds what the terms of ``stage`` give to the accumulators of a bundle, and leaves behind documents that can't be among the best ``k``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left
        ends, terms = flat_list(left["terms"])
        owner, weights = flat_list(left["stages"])[1], flat_list(left["weights"])[1]
        held, docs = flat_list(left["docs"])
        ids, scores = flat_list(left["ids"])[1], flat_list(left["scores"])[1]
        size, term = flat_list(right["terms"])
        every, place = np.unique(np.concatenate([docs, right["doc"].to_numpy()]), return_inverse=True)
        name = np.empty(len(every), np.int64)
        name[place] = np.concatenate([ids, right["first_id"].to_numpy()])
        where, doc = place[: len(docs)], np.repeat(place[len(docs) :], np.diff(size))
        tf = flat_list(right["counts"])[1]
        gives = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(right["m"].to_numpy(), np.diff(size)))
        order = np.argsort(term, kind="stable")
        term, doc, gives = term[order], doc[order], gives[order]
        mine = owner == stage
        low, high = np.searchsorted(term, terms, "left"), np.searchsorted(term, terms, "right")
        out = []
        for i in range(left.num_rows):
            total = np.zeros(len(every), np.int64)
            total[where[held[i] : held[i + 1]]] = scores[held[i] : held[i + 1]]
            for j in range(ends[i], ends[i + 1]):
                if mine[j] and low[j] < high[j]:
                    total[doc[low[j] : high[j]]] += weights[j] * gives[low[j] : high[j]]
            keep = np.flatnonzero(total)
            if len(keep) > k:
                kth = np.partition(total[keep], len(keep) - k)[len(keep) - k]
                later = weights[ends[i] : ends[i + 1]][owner[ends[i] : ends[i + 1]] > stage]
                keep = keep[total[keep].astype(float) + float(later.sum()) * CEILING >= float(kth)]
            if last:
                keep = keep[np.lexsort((every[keep], name[keep], -total[keep]))[:k]]
            out.append((every[keep], name[keep], total[keep]))
        cut = pa.array(np.append(0, np.cumsum([len(x[0]) for x in out])), pa.int32())
        lists = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate(x))) for x in zip(*out, strict=True)]
        return pa.table([left[c].combine_chunks() for c in left.column_names[:6]] + lists, left.column_names)

    return run


# --- the operator ------------------------------------------------------------------


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_col: str = "doc_id", item_col: str = "item_id", text: str = "text", shares: tuple[float, ...] = SHARES, shard: int = SHARD, bundle: int = BUNDLE, vocabulary: int = VOCABULARY) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item."""
    asked = materialize(term_lists(keyed(items, item_col, text)).drop("key").withColumn("item", F.monotonically_increasing_id()))
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    keep = None
    if wanted.count() <= vocabulary:
        keep = np.sort(np.array([r[0] for r in wanted.collect()], np.int64))  # no more than ``vocabulary``
    rows = materialize(term_lists(keyed(docs, doc_col, text), keep).withColumn("doc", F.monotonically_increasing_id()))
    texts = materialize(entries(rows, k))
    discard(rows)

    n, length = texts.where("n > 0").agg(F.sum("copies"), F.sum(F.col("n") * F.col("copies"))).first()
    n, length = n or 0, length or 1
    df = texts.select("copies", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("copies").alias("df"))
    df = df if keep is not None else df.join(wanted, "term", "left_semi")
    weight = F.floor(1000 * F.ln(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1))).cast("long")
    terms = materialize(df.select("term", stage_of(F.col("df"), n, shares).alias("stage"), weight.alias("weight"), "df"))
    known = None
    if keep is not None:
        found = sorted(terms.select("term", "stage").collect())  # no more than ``vocabulary``
        known = {"term": np.array([r[0] for r in found], np.int64), "stage": np.array([r[1] for r in found], np.int64)}

    shards = max(1, -(-(terms.agg(F.sum("df")).first()[0] or 0) // shard))
    bundles = max(1, -(-asked.count() // bundle))
    m = (100 - 25 + F.floor(F.expr(f"(25L * n * {n}L) div {length}L"))).cast("long")
    held = texts.where(F.size("terms") > 0).select("doc", F.coalesce(F.col("ids")[0], F.lit(TOP)).alias("first_id"), F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int").alias("shard"), m.alias("m"), "terms", "counts")
    postings = materialize(dealt(held, terms, known, len(shares)))

    weighed = asked.select("item", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("item", F.col("p.terms").alias("term"), F.col("p.counts").alias("q")).join(terms, "term")
    lists = weighed.groupBy("item").agg(F.collect_list(F.struct("term", "stage", (F.col("q") * F.col("weight")).alias("w"))).alias("p"))  # the terms of one item
    none = F.array().cast("array<long>")
    start = lists.select("item", F.col("p.term").alias("terms"), F.col("p.stage").alias("stages"), F.col("p.w").alias("weights"), none.alias("docs"), none.alias("ids"), none.alias("scores"))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    moving = start.select(F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int").alias("bundle"), each(shards).alias("shard"), "item", "terms", "stages", "weights", "docs", "ids", "scores")
    for stage in range(len(shares)):
        own = postings.where(F.col("stage") == stage).select(each(bundles).alias("bundle"), "shard", "doc", "first_id", "m", "terms", "counts")
        moving = moving.groupBy("bundle", "shard").cogroup(own.groupBy("bundle", "shard")).applyInArrow(passed(stage, k, stage == len(shares) - 1), BUNDLED)

    best = moving.select("item", F.explode(F.arrays_zip("docs", "ids", "scores")).alias("b")).select("item", F.col("b.docs").alias("doc"), F.col("b.ids").alias("first_id"), F.col("b.scores").alias("score"))
    nth = lambda *ties: F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), *ties))
    best = best.withColumn("nth", nth("first_id", "doc")).where(F.col("nth") <= k)
    each_id = best.join(texts.select("doc", "ids"), "doc").select("item", "score", F.explode("ids").alias("doc_id"))
    ranked = each_id.withColumn("rank", nth(F.col("doc_id").asc_nulls_last())).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", F.col("id").alias("item_id")), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: The same ranking in SQL.
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents), sizes AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d),
whole AS (SELECT CAST(count(*) FILTER (n > 0) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
i AS MATERIALIZED (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS w FROM benchmark), q AS MATERIALIZED (SELECT item, term, count(*) AS q FROM (SELECT item, unnest(w) AS term FROM i) GROUP BY ALL),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
weights AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term),
scored AS (SELECT item, r, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score FROM tf JOIN weights USING (term) JOIN q USING (term) JOIN sizes USING (r), whole GROUP BY ALL),
ranked AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN sizes USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN i USING (item) WHERE rank <= {K}
"""
