"""Benchmark decontamination by winnowing.

Of every window of ten words the smallest hash of its five-word grams is kept, a
hash once for the windows in a row that share it: a document's *fingerprints*.
Two windows of equal words keep the same hash, so a fingerprint join with the
benchmark's windows misses no shared span of ten words or more.  Hits are then
extended: the windows behind a matched fingerprint are compared word by word
with those of the items, and windows that follow or overlap one another make up
the spans of hit words.  An item of fewer than ten words is one window of its
own length, whose hash is looked up at every place.

Only DataFrame functions are used.  Texts go by a 128-bit hash, so copies of a
document are compared once; items that share the same windows are one set of
items, and documents that hold the same sets one combination, so a passage in
many documents and many items is never multiplied out before the result.

Null texts have no words; rows under one id, or without one, are separate
documents.  Items under one id are one item with the windows of all; an item
without an id gives hits but no entry in the list.  Very long texts are one row
and linear work.  Empty tables give documents without hits, or no rows.  Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmosaic.storage import materialize

#: Words of a window and of a gram.
SPAN, GRAM = 10, 5
#: A word once A-Z are in lower case; what else ASCII has parts words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: Fingerprints or keys of texts (16 bytes each) and windows (some 100 bytes each) that are sent to every task; above, the join shuffles.
FEW_PRINTS, FEW_WINDOWS = 200_000, 50_000


def words_of(text: Column) -> Column:
    """The words of a text: breaks become spaces, which is some five times faster than a pattern for words."""
    return F.array_remove(F.split(F.translate(text, UPPER + BREAKS, LOWER + " " * len(BREAKS)), " "), "")


def hashes(h: Column, n: int) -> Column:
    """Hash of the ``n`` word hashes from each place on; places with fewer left come out wrong."""
    return F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, n)]))


def smallest(g: Column, n: int) -> Column:
    """Smallest of the ``n`` numbers from each place on."""
    return F.transform(g, lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, n)])) if n > 1 else g


def heads(low: Column) -> Column:
    """Places where the kept hash changes."""
    marked = F.transform(low, lambda x, i: F.when((i == 0) | (F.get(low, i - 1) != x), i))
    return F.filter(marked, lambda i: i.isNotNull())


def prints(texts: DataFrame, short: list[int], span: int, gram: int) -> DataFrame:
    """``key, size, first, last, print``: fingerprints of texts (key, words) with the first and last window they stand for.

    ``short`` lists the lengths below ``span`` for which every place has one.
    """
    rows = texts.select("key", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    windows = lambda n: F.greatest(F.size("h") - n + 1, F.lit(0))
    kept = rows.select("key", hashes(F.col("h"), gram).alias("g"), windows(span).alias("n"))
    kept = kept.select("key", F.slice(smallest(F.col("g"), span - gram + 1), F.lit(1), F.col("n")).alias("low"), "n")
    kept = kept.select("key", "low", "n", heads(F.col("low")).alias("heads"))
    until = lambda i: F.coalesce(F.get("heads", i + 1), F.col("n")) - 1
    each = F.transform("heads", lambda x, i: F.struct(x.alias("first"), until(i).alias("last"), F.get("low", x).alias("print")))
    out = kept.select("key", F.inline(each)).select("key", F.lit(span).alias("size"), "first", "last", "print")
    for n in short:
        some = rows.select("key", F.posexplode(F.slice(hashes(F.col("h"), n), F.lit(1), windows(n))).alias("first", "print"))
        out = out.unionByName(some.select("key", F.lit(n).alias("size"), "first", F.col("first").alias("last"), "print"))
    return out


def window_texts(first: Column, last: Column, size: Column, words: str) -> Column:
    """Windows from ``first`` to ``last`` as structs of place, size and words."""
    return F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("at"), size.alias("size"), F.array_join(F.slice(words, i + 1, size), " ").alias("span")))


def item_windows(items: DataFrame, item_col: str, text: str, span: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``window, size, span`` and the items ``window, item`` they stand in."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(span))
    rows = rows.select("item", "words", size.alias("most")).select("item", F.inline(window_texts(F.lit(0), F.size("words") - F.col("most"), F.col("most"), "words")))
    rows = materialize(rows.select("item", "size", "span").distinct())
    windows = materialize(rows.select("size", "span").distinct().withColumn("window", F.monotonically_increasing_id()))
    return windows, materialize(rows.join(windows, ["size", "span"]).select("window", "item"))


def small(df: DataFrame, most: int) -> DataFrame:
    """A table of so few rows is sent to every task."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hit_windows(texts: DataFrame, windows: DataFrame, span: int, gram: int) -> DataFrame:
    """``key, at, size, window``: where windows of the items stand in texts (key, text)."""
    lengths = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most ``span``
    short = [n for n in lengths if n < span]
    split = windows.select(F.col("window").alias("key"), "size", F.split("span", " ").alias("words"))
    own = materialize(prints(split.where(F.col("size") == span), [], span, gram).unionByName(prints(split.where(F.col("size") < span), short, span, gram).where("first = 0")).select("size", "print").distinct())
    found = prints(texts.select("key", words_of(F.col("text")).alias("words")), short, span, gram)
    places = materialize(found.join(small(own, FEW_PRINTS), ["size", "print"]).select("key", "size", "first", "last").distinct())
    spots = places.groupBy("key").agg(F.collect_list(F.struct("size", "first", "last")).alias("spots"))  # the matches of one text
    # one text of each matched key: copies are gone before anything is dealt out by key
    matched = texts.join(small(places.select("key").distinct(), FEW_PRINTS), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    near = matched.join(spots, "key").select("key", words_of(F.col("text")).alias("words"), "spots")
    each = F.flatten(F.transform("spots", lambda s: window_texts(s["first"], s["last"], s["size"], "words")))  # one list, so that no row repeats the words
    spelt = near.select("key", F.inline(each)).select("key", "size", "at", "span").distinct()
    return spelt.join(small(windows, FEW_WINDOWS), ["size", "span"]).select("key", "at", "size", "window")


def hit_words(hits: DataFrame) -> DataFrame:
    """``key, n_hit``: words inside any of the windows found in a text."""
    before = F.max(F.col("at") + F.col("size")).over(Window.partitionBy("key").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1))
    places = hits.select("key", "at", "size").distinct().withColumn("before", F.coalesce(before, F.lit(0)))
    fresh = F.greatest(F.col("at") + F.col("size") - F.greatest("at", "before"), F.lit(0))
    return places.groupBy("key").agg(F.sum(fresh).cast("long").alias("n_hit"))


def hit_spans(hits: DataFrame) -> DataFrame:
    """``key, first, words``: the stretches of words that overlapping or adjoining windows make up."""
    order = Window.partitionBy("key").orderBy("at", "size")
    before = F.max(F.col("at") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    places = hits.select("key", "at", "size").distinct().withColumn("new", F.coalesce((F.col("at") > before).cast("int"), F.lit(0)))
    places = places.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return places.groupBy("key", "part").agg(F.min("at").alias("first"), (F.max(F.col("at") + F.col("size")) - F.min("at")).alias("words")).drop("part")


def set_name(member: Column) -> list[Column]:
    """A name of 128 bits for a set of distinct members, whatever their order."""
    return [F.bit_xor(F.xxhash64(member)).alias("n1"), F.bit_xor(F.xxhash64(F.lit(7), member)).alias("n2"), F.count("*").alias("n3")]


def item_lists(hits: DataFrame, members: DataFrame) -> DataFrame:
    """``key, n_items, items_sha256`` of the texts in which items stand."""
    name = ["n1", "n2", "n3"]
    members = members.where("item is not null")
    sets = materialize(members.groupBy("window").agg(*set_name(F.col("item"))))
    one = sets.groupBy(*name).agg(F.min("window").alias("window"), F.min("window").alias("set"))
    of_set = members.join(one.select("window", "set"), "window").select("set", "item")
    held = hits.select("key", "window").join(sets, "window").join(one.select(*name, "set"), name).select("key", "set").distinct()
    held = materialize(held)
    mixed = materialize(held.groupBy("key").agg(*set_name(F.col("set"))))
    kinds = mixed.groupBy(*name).agg(F.min("key").alias("key"))
    listed = held.join(kinds, "key").join(of_set, "set").select(*name, "item").distinct()
    ids = F.array_join(F.array_sort(F.collect_list("item")), ",")  # the digest is of one string
    listed = listed.groupBy(*name).agg(F.count("*").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"))
    return mixed.join(listed, name).select("key", "n_items", "items_sha256")


def keyed(docs: DataFrame, doc_col: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")


def contaminated_spans(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``doc_id, first, words``: the stretches of words of each document that stand in an item."""
    rows = keyed(docs, doc_col, text)
    windows, _ = item_windows(items, item_col, text, span)
    return rows.select("doc_id", "key").join(hit_spans(hit_windows(rows.select("key", "text"), windows, span, gram)), "key").drop("key")


def contamination(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    rows = keyed(docs, doc_col, text)
    windows, members = item_windows(items, item_col, text, span)
    hits = materialize(hit_windows(rows.select("key", "text"), windows, span, gram))
    found = materialize(hit_words(hits).join(item_lists(hits, members), "key", "left"))
    sized = rows.select("doc_id", "key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = F.sha2(F.lit("").cast("binary"), 256)
    return sized.join(found, "key", "left").select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + "'), '" + WORD + "')"
#: The same report in SQL.
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS MATERIALIZED (SELECT DISTINCT item, size, array_to_string(list_slice(w, pos + 1, pos + size), ' ') AS span FROM (SELECT item, w, least(len(w), {SPAN}) AS size, unnest(range(len(w) - least(len(w), {SPAN}) + 1)) AS pos FROM i WHERE len(w) > 0)),
dw AS (SELECT r, size, pos, array_to_string(list_slice(w, pos + 1, pos + size), ' ') AS span FROM (SELECT r, w, size, unnest(range(len(w) - size + 1)) AS pos FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
hits AS MATERIALIZED (SELECT r, dw.size, pos, item FROM dw JOIN iw USING (size, span)), places AS (SELECT DISTINCT r, unnest(range(pos, pos + size)) AS place FROM hits), counts AS (SELECT r, count(*) AS n_hit FROM places GROUP BY r),
lists AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN counts USING (r) LEFT JOIN lists USING (r)
"""
