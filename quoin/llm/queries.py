"""The registered queries of the training-corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, html_extract, katz, langid, line_dedup, mixing, quality, sharding
from .common import fold, read
from .near_dedup import near_duplicates


def op1_crf_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("doc_id")
    scored = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold(ids, 4) != 2)
    return scored.select("doc_id", (fold(ids, 4) == 2).alias("held_out"), "score", "predicted", "n_lines")


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("doc_id")
    scored = katz.score_all(read(spark, sf_dir, "documents").select("doc_id", "text"), fold(ids, 7) != 2)
    return scored.withColumn("held_out", F.coalesce(fold(ids, 7) == 2, F.lit(False)))


def op3_nearest_url_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op4_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_set_similarity_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.report(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"), "n_chars", F.array_join("classes", ",").alias("classes"), "n_links")


def op6_minhash_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op7_rotated_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", "similarity")


def op9_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, fold(F.col("doc_id"), 5) != 0, ["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_crf_line_quality": op1_crf_line_quality,
    "op2_katz_backoff": op2_katz_backoff,
    "op3_nearest_url_differencing": op3_nearest_url_differencing,
    "op4_pareto_mixing": op4_pareto_mixing,
    "op5_set_similarity_line_dedup": op5_set_similarity_line_dedup,
    "op6_minhash_lsh_forest": op6_minhash_lsh_forest,
    "op7_rotated_one_bit_search": op7_rotated_one_bit_search,
    "op8_simhash_decontamination": op8_simhash_decontamination,
    "op9_minimax_sharding": op9_minimax_sharding,
    "op10_hyperdimensional_langid": op10_hyperdimensional_langid,
}
ORACLES: dict[str, str] = {"op4_pareto_mixing": mixing.SQL, "op8_simhash_decontamination": decontam.SQL}
