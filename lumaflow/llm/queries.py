"""The registered queries of the training-data operators and their DuckDB forms."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from lumaflow.llm import lattice_lm, mixing, near_dedup, packing, quality, suffix_dedup, telephony, token_counts, top_k, toxicity
from lumaflow.llm.common import documents


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup_suffixes(documents(spark, sf_dir))


def op2_token_counts(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_mix_sources(spark, sf_dir):
    return mixing.mix_sources(documents(spark, sf_dir))


def op4_lattice_lm(spark, sf_dir):
    return lattice_lm.lattice_scores(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), _labels(spark, sf_dir))


def op6_telephony(spark, sf_dir):
    return telephony.media_digest(telephony.store_audio(documents(spark, sf_dir), telephony.MIXED))


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_top_k(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k.top_k(rows.where(F.col("vec_id") % 20 == 0), rows)


def op9_order_minhash(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "is_first")


def op10_mil_quality(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir), _labels(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_token_counts, op3_mix_sources, op4_lattice_lm, op5_toxicity, op6_telephony, op7_best_fit_packing, op8_top_k, op9_order_minhash, op10_mil_quality)
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {"op1_suffix_dedup": suffix_dedup.ORACLE_SQL, "op3_mix_sources": mixing.ORACLE_SQL, "op8_top_k": top_k.ORACLE_SQL, "op9_order_minhash": near_dedup.ORACLE_SQL}
