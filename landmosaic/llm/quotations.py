"""Quotation linking: replies are tied to the messages they quote.

Each line of a message has a quote level, the number of leading ``>`` marks.
Its content, lower-cased and with runs of white space made one space, counts; blank
lines don't.  Neighbouring lines of one level are a passage.  Passages are hashed
whole and, where they have several lines, line by line; each quoted hash joins the
latest earlier message of its thread that wrote the same.  An original gets as
many votes as it has lines in passages found whole, or lines found one by one if
these are more.  A message's parent is the original with most votes among its least
nested quotes (ties to the later one).  Pointer jumping over the parents gives each
message its root and depth.  A conversation is the messages of one root; ``place``
counts them so that a reply follows what it replies to, and their text has no quotes.

Only DataFrame functions are used.  Equal hashes of a message are one row before
they meet, and the latest earlier writer is looked up by stretches of ``STRETCH``
messages, with what earlier stretches wrote carried over, so a line that everybody
writes or quotes cannot multiply or fill one task; places are counted alike.

Null texts are empty.  A message without a quoted line that an earlier message
wrote is a root.  Rows with the same thread and place are the same message said
again: each gets the shared result.  Rows without thread or place are dropped.
Bodies of any length are read whole; other columns are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmosaic.storage import discard, materialize

MARKS = r"^((?:> ?)*)"
ROUNDS = 40
#: Messages of a thread that one window looks at.
STRETCH = 1024


def level_of(line: Column) -> Column:
    return F.length(F.replace(F.regexp_extract(line, MARKS, 1), F.lit(" "), F.lit("")))


def content_of(line: Column) -> Column:
    bare = F.regexp_replace(line, MARKS, "")
    return F.trim(F.regexp_replace(F.lower(bare), r"[\x20\x09-\x0D]+", " "))


def lines_of(text: Column) -> Column:
    return F.split(text, "\r?\n")


def passages(messages: DataFrame) -> DataFrame:
    """``thread, seq, level, passage, whole, lines``: hashes in a message, lines of passages with that hash, and single lines."""
    marked = F.transform(lines_of(F.col("body")), lambda x: F.struct(level_of(x).alias("level"), content_of(x).alias("content")))
    rows = messages.select("thread", "seq", F.filter(marked, lambda x: x["content"] != "").alias("said"))
    level = lambda i: F.get("said", i)["level"]
    places = F.filter(F.sequence(F.lit(0), F.size("said") - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
    rows = rows.where(F.size("said") > 0).withColumn("starts", places)
    until = lambda k: F.coalesce(F.get("starts", k + 1), F.size("said"))
    runs = F.transform("starts", lambda i, k: F.struct(level(i).alias("level"), F.transform(F.slice("said", i + 1, until(k) - i), lambda x: x["content"]).alias("contents")))
    rows = rows.select("thread", "seq", F.explode(runs).alias("run")).select("thread", "seq", "run.*", F.size("run.contents").alias("n"))
    item = lambda text, whole, lines: F.struct(F.xxhash64(text).alias("passage"), whole.alias("whole"), lines.alias("lines"))
    one = F.array(item(F.array_join("contents", "\n"), F.col("n"), F.when(F.col("n") == 1, 1).otherwise(0)))
    more = F.when(F.col("n") > 1, F.transform("contents", lambda x: item(x, F.lit(0), F.lit(1)))).otherwise(F.slice(one, 1, 0))
    rows = rows.select("thread", "seq", "level", F.explode(F.concat(one, more)).alias("item")).select("thread", "seq", "level", "item.*")
    return rows.groupBy("thread", "seq", "level", "passage").agg(F.sum("whole").alias("whole"), F.sum("lines").alias("lines"))


def origins(found: DataFrame) -> DataFrame:
    """The quoted rows of ``passages`` with ``origin``, the latest earlier message of the thread that wrote the passage."""
    key = ["thread", "passage", "stretch"]
    rows = found.withColumn("stretch", F.floor(F.col("seq") / STRETCH)).withColumn("own", F.when(F.col("level") == 0, F.col("seq")))
    near = F.max("own").over(Window.partitionBy(*key).orderBy("seq").rangeBetween(Window.unboundedPreceding, -1))
    before = Window.partitionBy("thread", "passage").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    far = rows.groupBy(*key).agg(F.max("own").alias("own")).select(*key, F.max("own").over(before).alias("far")).where("far is not null")
    rows = rows.withColumn("near", near).where("level > 0").join(far, key, "left")
    return rows.select("thread", "seq", "level", "whole", "lines", F.coalesce("near", "far").alias("origin")).where("origin is not null")


def parents(messages: DataFrame) -> DataFrame:
    """``thread, seq, parent, hops, quoted``: the message replied to, how many quote levels up it is, and matched lines."""
    matched = origins(materialize(passages(messages)))
    votes = matched.groupBy("thread", "seq", "level", "origin").agg(F.sum("whole").alias("whole"), F.sum("lines").alias("lines"))
    best = votes.groupBy("thread", "seq").agg(F.max(F.struct((-F.col("level")).alias("up"), F.greatest("whole", "lines").alias("votes"), "origin")).alias("b"), F.sum("lines").alias("quoted"))
    return best.select("thread", "seq", F.col("b.origin").alias("parent"), (-F.col("b.up")).alias("hops"), "quoted")


def placed(heads: DataFrame) -> DataFrame:
    """Adds ``place`` to messages: their number, from 1, in the conversation of their root."""
    key = ["thread", "root", "stretch"]
    rows = heads.withColumn("stretch", F.floor(F.col("seq") / STRETCH))
    before = Window.partitionBy("thread", "root").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.sum("n").over(before).alias("earlier"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).join(earlier, key)
    return rows.withColumn("place", F.col("place") + F.coalesce("earlier", F.lit(0))).drop("stretch", "earlier")


def roots(links: DataFrame) -> DataFrame:
    """``thread, seq, root, depth`` of every message that has a parent, by pointer jumping."""
    now = materialize(links.select("thread", "seq", F.col("parent").alias("up"), F.col("hops").cast("long").alias("depth"), F.lit(True).alias("open")))
    for _ in range(ROUNDS):
        if now.where("open").isEmpty():
            return now.select("thread", "seq", F.col("up").alias("root"), "depth")
        above = now.select("thread", F.col("seq").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        moved = now.where("open").join(above, ["thread", "up"], "left")  # those that are at their root stay out of it
        moved = moved.select("thread", "seq", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("open"))
        after = materialize(moved.unionByName(now.where("not open")))
        discard(now)
        now = after
    raise RuntimeError("reply chains did not end")


def link_quotations(messages: DataFrame, thread: str, seq: str, body: str) -> DataFrame:
    """``thread, seq, parent, root, depth, place, quoted, text`` of every message.

    The rows of a conversation (one thread and root) by ``place`` are in reply order.
    """
    rows = messages.select(F.col(thread).alias("thread"), F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(body).cast("string"), F.lit("")).alias("body"))
    rows = rows.where("thread is not null and seq is not null")
    links = materialize(parents(rows.distinct()))
    found = links.join(roots(links), ["thread", "seq"]).select("thread", "seq", "parent", "root", "depth", "quoted")
    zero = F.lit(0).cast("long")
    heads = rows.select("thread", "seq").distinct().join(found, ["thread", "seq"], "left")
    heads = heads.select("thread", "seq", "parent", F.coalesce("root", "seq").alias("root"), F.coalesce("depth", zero).alias("depth"), F.coalesce("quoted", zero).alias("quoted"))
    own = F.array_join(F.filter(lines_of(F.col("body")), lambda x: level_of(x) == 0), "\n")
    out = rows.select("thread", "seq", F.trim(own).alias("text")).join(placed(materialize(heads)), ["thread", "seq"])
    return out.select("thread", "seq", "parent", "root", "depth", "place", "quoted", "text")


def quoting_messages(conversations: DataFrame) -> DataFrame:
    """Turns as mail: each quotes the turn before it and, one level deeper, the one before that."""
    turns = conversations.select("conv_id", "turn", "text")
    back = lambda n, name: turns.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(name))
    quoted = lambda name, mark: F.array_join(F.transform(F.split(F.col(name), "\n"), lambda x: F.concat(F.lit(mark), x)), "\n")
    rows = turns.join(back(1, "one"), ["conv_id", "turn"], "left").join(back(2, "two"), ["conv_id", "turn"], "left")
    return rows.select("conv_id", "turn", F.concat_ws("\n", quoted("two", "> > "), quoted("one", "> "), F.col("text")).alias("body"))


#: The same linking in SQL.
ORACLE = r"""
WITH RECURSIVE turns AS (SELECT conv_id, turn, text FROM conversations),
mail AS (SELECT t.conv_id AS thread, t.turn AS seq, concat_ws(chr(10), array_to_string(list_transform(string_split(b.text, chr(10)), lambda x: '> > ' || x), chr(10)),
    array_to_string(list_transform(string_split(a.text, chr(10)), lambda x: '> ' || x), chr(10)), t.text) AS body
  FROM turns t LEFT JOIN turns a ON a.conv_id = t.conv_id AND a.turn + 1 = t.turn LEFT JOIN turns b ON b.conv_id = t.conv_id AND b.turn + 2 = t.turn),
split AS (SELECT thread, seq, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM mail),
marked AS (SELECT thread, seq, pos, length(replace(regexp_extract(line, '^((?:> ?)*)', 1), ' ', '')) AS level, trim(regexp_replace(lower(regexp_replace(line, '^((?:> ?)*)', '')), '[\x20\x09-\x0D]+', ' ', 'g')) AS content FROM split),
numbered AS (SELECT *, row_number() OVER (PARTITION BY thread, seq ORDER BY pos) AS k FROM marked WHERE content <> ''),
lines AS MATERIALIZED (SELECT *, k - row_number() OVER (PARTITION BY thread, seq, level ORDER BY k) AS run FROM numbered),
runs AS MATERIALIZED (SELECT thread, seq, level, string_agg(content, chr(10) ORDER BY k) AS said, count(*) AS n FROM lines GROUP BY thread, seq, level, run),
items AS MATERIALIZED (SELECT thread, seq, level, said, sum(whole) AS whole, sum(one) AS one FROM (
  SELECT thread, seq, level, said, n AS whole, CASE WHEN n = 1 THEN 1 ELSE 0 END AS one FROM runs
  UNION ALL SELECT l.thread, l.seq, l.level, l.content, 0, 1 FROM lines l JOIN (SELECT thread, seq, level, run FROM lines GROUP BY ALL HAVING count(*) > 1) USING (thread, seq, level, run)) GROUP BY ALL),
matched AS (SELECT q.thread, q.seq, q.level, q.said, q.whole, q.one, max(o.seq) AS origin FROM items q JOIN items o ON o.thread = q.thread AND o.said = q.said AND o.level = 0 AND o.seq < q.seq WHERE q.level > 0 GROUP BY ALL),
votes AS (SELECT thread, seq, level, origin, greatest(sum(whole), sum(one)) AS n, sum(one) AS one FROM matched GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY thread, seq ORDER BY level, n DESC, origin DESC) AS k, sum(one) OVER (PARTITION BY thread, seq) AS quoted FROM votes),
links AS MATERIALIZED (SELECT thread, seq, origin AS parent, level AS hops, CAST(quoted AS BIGINT) AS quoted FROM ranked WHERE k = 1),
walk(thread, seq, up, depth) AS (SELECT thread, seq, parent, hops FROM links UNION ALL SELECT w.thread, w.seq, l.parent, w.depth + l.hops FROM walk w JOIN links l ON l.thread = w.thread AND l.seq = w.up),
tops AS (SELECT thread, seq, arg_max(up, depth) AS root, max(depth) AS depth FROM walk GROUP BY ALL)
SELECT m.thread, m.seq, l.parent, coalesce(t.root, m.seq) AS root, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth, dense_rank() OVER (PARTITION BY m.thread, coalesce(t.root, m.seq) ORDER BY m.seq) AS place, coalesce(l.quoted, 0) AS quoted,
  trim(array_to_string(list_filter(string_split(m.body, chr(10)), lambda x: NOT starts_with(x, '>')), chr(10))) AS text
FROM mail m LEFT JOIN links l USING (thread, seq) LEFT JOIN tops t USING (thread, seq)
"""
