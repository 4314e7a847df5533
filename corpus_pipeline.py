"""The corpus pipeline: quality, near duplicates, repeated passages, mixing, encoding.

Each stage takes the documents its predecessor kept and returns documents; the
last returns their encodings.  ``run`` writes every stage as Parquet in the
shared folder and reads it again as the next one's input.

Null and repeated ids are no key here: rows go by id and text together, so
documents without an id and different texts under one id pass every stage, and
only true copies of a row count as one.  Null and empty texts are scored, have no
near duplicates and stay once.  Very long texts pass whole, stretch by stretch where
a stage needs it; an empty table gives no rows.  Extra columns are kept, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmosaic.llm import mixing, near_dedup, piece_lattice, quality, suffix_dedup
from landmosaic.llm.textnum import free_name
from landmosaic.storage import materialize

#: Near duplicates here: words of a shingle and similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Bytes of a batch that a Python worker is sent; every stage sets this for the session, as five stages share an executor's memory.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject."""
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs.columns, "quality_score")
    return quality.scored(docs, model, name=name).where(F.col(name) >= quality.CUT).select(*docs.columns)


def with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of id and text, in a column of a new name; equal keys are copies of one row."""
    name = free_name(docs.columns, "row_key")
    return docs.withColumn(name, F.xxhash64("doc_id", "text")), name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, one without an id only where none has one."""
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    rows, key = with_key(docs)
    groups = near_dedup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), SHINGLE, PERCENT)
    groups = materialize(groups.groupBy("doc_id", "component_id").agg(F.count("*").alias("rows")).withColumnRenamed("doc_id", "key"))
    ids = rows.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("id")).distinct()
    first = F.min(F.struct(F.col("id").isNull(), "id", "key"))["key"]
    kept = materialize(groups.join(ids, "key").groupBy("component_id").agg(first.alias("key")).join(groups.select("key", "rows"), "key"))
    out = rows.join(kept.select(F.col("key").alias(key)), key, "left_semi")
    out = out if kept.where("rows > 1").isEmpty() else out.dropDuplicates([key])
    return out.select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that occur more than once; every document stays, with what is left."""
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    return suffix_dedup.cut_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole copies, the rest of a copy by rounding. Copies of a row share what it takes."""
    rows, key = with_key(docs)
    taken = mixing.mix_sources(rows.select(F.col(key).alias("doc_id"), "source", "text")).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    times = free_name(docs.columns, "times")
    wanted = taken.select(F.col("doc_id").alias(key), F.array_repeat(F.lit(0), copies).alias(times)).where(F.size(times) > 0)
    return rows.join(wanted, key).select(*docs.columns, F.explode(times).alias(key)).select(*docs.columns)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best segmentation of every document, in ids of the piece model."""
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    import public_tokenizers

    return piece_lattice.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mixing", source_mixing),
    ("piece_encoding", piece_encoding),
]

#: Boosted trees and lattices are beyond SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
