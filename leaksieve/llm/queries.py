"""Registered queries of the corpus operators, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.llm import bag_minhash, conversation_repair, histogram_shards, line_edit_join, mpeg_audio, packing, preference_format, quality_crf, quality_mcd, raking, token_counts, toxicity, whitening
from leaksieve.llm.tables import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.mcd_quality(documents(spark, sf_dir))


def op2_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_digests(documents(spark, sf_dir))


def op4_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards.shard_documents(documents(spark, sf_dir))


def op5_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_edit_join.line_report(documents(spark, sf_dir))


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(documents(spark, sf_dir))


def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference_format.formatted(preference_format.branched(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return pairs.withColumns({c: preference_format.spans_text(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


def op8_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.calibrated(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.severity(docs, model)


def op11_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.document_quality(docs, model)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_robust_outliers,
        op2_pretoken_counts,
        op3_mpeg_audio,
        op4_histogram_sort,
        op5_line_edit_join,
        op6_bag_minhash,
        op7_preference_pairs,
        op8_raked_mixture,
        op9_best_fit_packing,
        op10_ordinal_toxicity,
        op11_bit_sliced_whitening,
        op12_conversation_repair,
        op13_line_crf_quality,
    )
}

SQL: dict[str, str] = {"op4_histogram_sort": histogram_shards.SQL, "op12_conversation_repair": conversation_repair.SQL, "op7_preference_pairs": preference_format.SQL, "op8_raked_mixture": raking.SQL}
