"""From raw documents to packed training sequences: STAGES in order, each stored before the next one reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import hamming_dedup, line_dedup, packing, quality, suffix_dedup
from codeloom.llm.base import ship
from codeloom.session import broadcast_rows, cut, scratch, spread

#: Bytes from which a repeated passage is cut: less than fifty words of any of the languages take.
PASSAGE = 200


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that are scored under 0.5. Document frequencies come from ``docs``, labels from the labelled
    rows that are not held out."""
    ship(spark)
    docs = spread(docs)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, column="_quality").where("_quality >= 0.5").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of runs of two lines or more. A document that loses all its lines has its whole text
    elsewhere and is dropped; one that was empty before stays."""
    ship(spark)
    had = F.coalesce(F.length("text"), F.lit(0)) > 0
    kept = line_dedup.cleaned(spread(docs).withColumn("_had", had))
    return kept.where("not _had or length(text) > 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every group of near-duplicates: the first by id (null last), text hash and position. Rows are told
    apart by position, so of repeated rows one stays, with or without an id, and a different text under a repeated id is a
    row of its own. Texts without words are near only to equal ones; empty and null texts stay."""
    ship(spark)
    # Stored, so that a row has one position in both reads.
    rows, _ = cut(spread(docs).withColumn("_row", F.monotonically_increasing_id()))
    with scratch(spark) as keep:
        gone, n = _near_copies(rows)
        keep(gone)
    return rows.join(F.broadcast(gone) if n <= broadcast_rows(spark) else gone, "_row", "left_anti").select(*docs.columns)


def _near_copies(rows: DataFrame) -> tuple[DataFrame, int]:
    """The ``_row`` of every row that goes, and their number."""
    hashed = F.unhex(F.md5(F.col("text").cast("binary")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash", "_row")
    named = rows.select("doc_id", "_row", hashed.alias("_hash"), (F.coalesce(F.length("text"), F.lit(0)) == 0).alias("_empty"))
    found = hamming_dedup.find(rows.select("_row", "text"), "_row").withColumnRenamed("doc_id", "_row")
    alone = F.col("n_shingles") == 0  # no words: its own component, grouped by its hash
    near = named.join(found, "_row").where("not _empty").withColumn("_place", place).select(
        "_row", "_place", F.when(~alone, F.col("component_id")).alias("_near"), F.when(alone, F.col("_hash")).alias("_same"))
    chosen = near.groupBy("_near", "_same").agg(F.min("_place")["_row"].alias("_row"))
    return cut(near.select("_row").join(chosen, "_row", "left_anti"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every byte string of PASSAGE bytes or more that stands elsewhere before; its first occurrence stays."""
    ship(spark)
    return suffix_dedup.cleaned(spread(docs), length=PASSAGE, keep_first=True)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(spread(docs), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Near-duplicates, voting and packing are not expressible in SQL; a test holds the rows of each later stage against brute
#: force on a small fixture, and those of the first against op3's scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs, _ = cut(stage(spark, docs, sf_dir))
    return docs
