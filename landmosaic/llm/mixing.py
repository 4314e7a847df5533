"""Mixing sources to target weights with a low-discrepancy schedule.

Each source is a stream of its documents in a hashed order, cut into blocks of
equally many words.  Slot ``i`` of the schedule has the golden-ratio point
``i * phi mod 1``; the point falls into one source's interval of the cumulative
slot weights.  The slots of a source are ranked, rank ``r`` takes block
``r mod blocks``, and the words that a document gives are the words it shares
with the blocks taken.  Only DataFrame functions are used, and every order and
running total is split: documents by hash prefix, slots by stretches of the
schedule, so that a source with most rows is spread over many tasks.

Null texts have size 0; null sources are one source, last in order; rows with
the same doc_id are separate documents.  Documents of size 0 take 0 words.  An
empty table gives an empty result.  Very long texts are one row whose words share
as many blocks as they fill.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landmosaic.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words taken in all, as a share of all words, and at most of one source.
SHARE, MOST = 1.5, 2
#: Words of a block, and blocks of a source at least (if it has so many words).
BLOCK_WORDS, LEAST_BLOCKS = 1024, 512
#: Points are multiples of the golden ratio in units of 2 ** -31.
UNITS, GOLDEN = 1 << 31, 1327217885
#: Slots are ranked in stretches of so many, and looked up in so many bins.
STRETCH, BINS = 65_536, 1024
#: Hexadecimal digits of the hash that split a source's order.
PREFIX = 4


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` with the number of words of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


def source_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row a source: its number, words, target, blocks and interval of points.

    The windows here order sources, never documents.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights)) + 1).cast("double")
    s = total.select("source", "source_size", nth.cast("long").alias("src"), weight.alias("w")).withColumn("cap", MOST * F.col("source_size").cast("double"))
    everything, fill = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    left = SHARE * F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(fill), F.lit(0.0))))
    s = s.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("w")))
    blocks = F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.least("source_size", F.lit(LEAST_BLOCKS))).cast("long")
    s = s.withColumn("blocks", blocks).withColumn("slots", F.when(F.col("blocks") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("all_slots", F.sum("slots").over(everything)).withColumn("upto", F.sum("slots").over(upto))
    point = lambda c: F.when(F.col("all_slots") > 0, F.floor(c * UNITS / F.col("all_slots"))).otherwise(0).cast("long")
    s = s.withColumn("high", F.when(F.max("src").over(everything) == F.col("src"), F.lit(UNITS)).otherwise(point(F.col("upto"))).cast("long"))
    return s.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("src")), F.lit(0)).cast("long"))


def schedule(plan: DataFrame, n_slots: int) -> DataFrame:
    """``slot, src, rank``: the source of each slot and its rank among that source's slots."""
    spark: SparkSession = plan.sparkSession
    width = UNITS // BINS
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), (F.col("id") % UNITS * GOLDEN % UNITS).alias("u"))
    slots = slots.withColumn("bin", F.floor(F.col("u") / width).cast("long"))
    bins = F.sequence(F.floor(F.col("low") / width).cast("long"), F.floor((F.col("high") - 1) / width).cast("long"))
    spans = plan.where("high > low").select("src", "blocks", "low", "high", F.explode(bins).alias("bin"))
    placed = slots.join(spans, "bin").where("u >= low and u < high").select("slot", "src", "blocks", F.floor(F.col("slot") / STRETCH).cast("long").alias("stretch"))
    counts = placed.groupBy("src", "stretch").agg(F.count("*").alias("n"))
    before = Window.partitionBy("src").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("src", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("src", "stretch").orderBy("slot")) - 1
    return placed.withColumn("within", within).join(counts, ["src", "stretch"]).select("slot", "src", "blocks", (F.col("before") + F.col("within")).alias("rank"))


def block_start(b: Column) -> Column:
    """First word of block ``b``: the first ``extra`` blocks have one word more than ``base``."""
    return b * F.col("base") + F.least(b, F.col("extra"))


def block_of(x: Column) -> Column:
    wide = F.col("extra") * (F.col("base") + 1)
    return F.when(x < wide, F.floor(x / (F.col("base") + 1))).otherwise(F.col("extra") + F.floor((x - wide) / F.col("base"))).cast("long")


def streams(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents with the stretch of words ``[at, at + size)`` they hold in their source's hashed order."""
    about = plan.select(F.col("source").alias("named"), "src", "source_size", "target", "blocks")
    rows = sizes.join(about, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    rows = rows.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("part", F.substring("order", 1, PREFIX))
    parts = rows.groupBy("src", "part").agg(F.sum("size").alias("n"))
    parts = parts.select("src", "part", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("src", "part").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("within", within).join(parts, ["src", "part"]).withColumn("at", F.col("before") + F.col("within")).drop("order", "part", "before", "within")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    sizes = materialize(sized(docs))
    plan = materialize(source_plan(sizes, weights))
    n_slots = plan.agg(F.ceil(F.max("all_slots"))).first()[0] or 0
    visits = schedule(plan, n_slots).where(F.col("rank") < MOST * F.col("blocks"))
    visits = visits.groupBy("src", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("times"))
    rows = streams(sizes, plan)
    words = rows.where("size > 0").withColumn("base", F.floor(F.col("source_size") / F.col("blocks"))).withColumn("extra", F.col("source_size") % F.col("blocks"))
    end = F.col("at") + F.col("size")
    pieces = words.withColumn("block", F.explode(F.sequence(block_of(F.col("at")), block_of(end - 1))))
    shared = F.least(end, block_start(F.col("block") + 1)) - F.greatest(F.col("at"), block_start(F.col("block")))
    pieces = pieces.withColumn("shared", shared).join(visits, ["src", "block"], "left")
    taken = pieces.groupBy("src", "at", "doc_id", "size", "source_size", "target").agg(F.sum(F.col("shared") * F.coalesce(F.col("times"), F.lit(0))).alias("taken"))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return taken.select(*columns).unionByName(rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*columns))


#: The same schedule in SQL.
ORACLE = f"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
total AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM total),
weighed AS (SELECT *, CAST([{', '.join(map(str, WEIGHTS))}][1 + src % {len(WEIGHTS)}] AS DOUBLE) AS w, {MOST} * CAST(source_size AS DOUBLE) AS cap FROM numbered),
levels AS (SELECT *, ({SHARE} * sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
  FROM weighed WINDOW f AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT *, least(cap, max(level) OVER () * w) AS target, CAST(greatest(ceil(source_size / {BLOCK_WORDS}), least(source_size, {LEAST_BLOCKS})) AS BIGINT) AS blocks FROM levels),
slotted AS (SELECT *, CASE WHEN blocks > 0 THEN target * blocks / source_size ELSE 0 END AS slots FROM targets),
summed AS (SELECT *, sum(slots) OVER () AS all_slots, sum(slots) OVER (ORDER BY src ROWS UNBOUNDED PRECEDING) AS upto FROM slotted),
highs AS (SELECT *, CASE WHEN src = max(src) OVER () THEN {UNITS} WHEN all_slots > 0 THEN CAST(floor(upto * {UNITS} / all_slots) AS BIGINT) ELSE 0 END AS high FROM summed),
plan AS (SELECT *, coalesce(lag(high) OVER (ORDER BY src), 0) AS low, source_size // greatest(blocks, 1) AS base, source_size % greatest(blocks, 1) AS extra FROM highs),
slots AS (SELECT slot, (slot % {UNITS}) * {GOLDEN} % {UNITS} AS u FROM (SELECT unnest(range(CAST((SELECT ceil(max(all_slots)) FROM plan) AS BIGINT))) AS slot)),
ranked AS (SELECT src, blocks, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank FROM slots JOIN plan ON u >= low AND u < high),
visits AS (SELECT src, rank % blocks AS block, count(*) AS times FROM ranked WHERE rank < {MOST} * blocks GROUP BY ALL),
ordered AS (SELECT doc_id, size, src, source_size, target, blocks, base, extra, coalesce(sum(size) OVER (PARTITION BY src ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM sizes JOIN plan ON sizes.source IS NOT DISTINCT FROM plan.source),
marked AS (SELECT *, CASE WHEN pos < extra * (base + 1) THEN pos // (base + 1) ELSE extra + (pos - extra * (base + 1)) // base END AS b0,
  CASE WHEN pos + size - 1 < extra * (base + 1) THEN (pos + size - 1) // (base + 1) ELSE extra + (pos + size - 1 - extra * (base + 1)) // base END AS b1 FROM ordered WHERE size > 0),
pieces AS (SELECT *, unnest(range(CAST(b0 AS BIGINT), CAST(b1 + 1 AS BIGINT))) AS block FROM marked),
taken AS (SELECT p.src, p.pos, p.doc_id, p.size, p.source_size, p.target, sum((least(pos + size, (p.block + 1) * base + least(p.block + 1, extra)) - greatest(pos, p.block * base + least(p.block, extra))) * coalesce(times, 0)) AS taken
  FROM pieces p LEFT JOIN visits v ON v.src = p.src AND v.block = p.block GROUP BY ALL)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM taken
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM ordered WHERE size = 0
"""
