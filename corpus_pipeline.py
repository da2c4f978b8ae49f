"""A training corpus from documents, in five stages.

STAGES lists (name, function) in order; each function takes (spark, docs, sf_dir) and returns a
DataFrame, written as Parquet and read again as the next one's docs. All but the last return the
columns of documents. Empty inputs pass through; null texts are empty texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaflow.llm import mixing, near_dedup, packing, suffix_dedup, toxicity
from lumaflow.llm.common import discard, documents, stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(docs, labels, keep=COLUMNS[1:]).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class stays."""
    return near_dedup.keep_one(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated byte strings and repeated passages of 50 words go from the texts; a character that lost a byte goes whole. No document is dropped."""
    cut = suffix_dedup.dedup_suffixes(docs, with_text=True, keep=("lang", "source"), passages=True)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the one at a source's cut in part; those it doesn't take go."""
    mixed = mixing.mix_sources(docs, keep=("text", "lang", "source")).where("taken > 0")
    copies = mixed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(taken - 1) div size"))).alias("epoch"))
    left = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({mixing.WORD})")), F.lit(1), left.cast("int")), " ")
    text = F.when(left < F.col("size"), words).otherwise(F.col("text"))
    return copies.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("suffix_dedup", cut_repeats), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None  # the trained toxicity model and the packing have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir).select(*COLUMNS), None
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
