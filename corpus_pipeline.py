"""The corpus pipeline: quality, near-duplicates, PII, mixing, packing. Each stage reads what its predecessor kept.

Stages take (spark, docs, sf_dir). All but the last return the columns of documents: rejected rows are gone, copies are one
document, entities are surrogates, and documents stand as often as the mix takes them. The last returns one row per piece of
a packed sequence. SQL can't express these stages (expectation-maximisation, keyed permutations, a tokenizer's ids);
tests/llm hold them against brute force. A stage's tables are removed once the next one's input is written.

Defined results: null and empty texts have the features of an empty text in the quality stage, are nobody's copies, have no entities, are never
taken by the mix where their size is 0 and its draw says no, and are packed as an end token. Rows with equal texts are copies whatever their
doc_ids, repeated and missing ones included; of a group of copies the least doc_id stays, rows without one after all others. Rows that repeat are
judged, replaced, mixed and packed each. Columns beyond doc_id, text and source pass through under their names. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.mixing import mix_emit
from tamis.llm.neardup import near_duplicates
from tamis.llm.packing import default_tokenizer, pack
from tamis.llm.store import made_since, materialise, remove
from tamis.llm.surrogates import key_of, with_surrogates
from tamis.llm.weak_labels import good_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of copies: that of the smallest doc_id, then of the smallest row key. Rows are linked and chosen by
    a key that is written once, so that repeated, missing and shared doc_ids don't matter."""
    rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    found = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), width=5, percent=80)
    linked = found.where("n_shingles > 0").select(F.col("doc_id").alias("__row"), "component_id")
    linked = materialise(linked.join(rows.select("__row", "doc_id"), "__row"), "near-linked")
    first = linked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first"))
    gone = linked.join(first.select("first.__row"), "__row", "left_anti").select("__row")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_surrogates(docs, key_of(spark))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_emit(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, default_tokenizer())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    used: list[str] = []
    for name, stage in STAGES[:-1]:
        mark = len(made_since(0))
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        *own, output = made_since(mark)
        remove(spark, [*used, *own])
        used = [output]
    return STAGES[-1][1](spark, docs, sf_dir)
