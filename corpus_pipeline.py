"""A training-corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. A row whose doc_id is null is told apart by a hash
of its text, above all ids that are given, so that it never represents a group that
holds a document with an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm import decontam, langid, mixing, near_dedup, sharding
from quoin.llm.common import fold, read, release, table, without, written

KEY = "__key"
#: Least Jaccard similarity, in per cent, of near-duplicates.
NEAR = 80
_HALF = 1 << 62


def keyed(docs: DataFrame) -> DataFrame:
    hashed = F.xxhash64("text").bitwiseAND(F.lit(_HALF - 1)) + F.lit(_HALF)
    return docs.withColumn(KEY, F.coalesce(F.col("doc_id").cast("long"), hashed))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that resemble no language: without text, without letters, or with no positive cosine.

    Null, empty and letterless texts go; a null lang is not learnt from but its row is
    judged. Repeated rows are judged alike. An empty table stays empty.
    """
    names = ("__lang", "__score")
    found = langid.identify(docs, fold(F.col("doc_id"), 5) != 0, docs.columns, names=names)
    return found.where("__lang != 'und' and __score > 0").drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest doc_id stays.

    Rows that repeat a doc_id and its text are copies, of which the smallest row stays;
    rows that share a doc_id but not the text stay or go together. Texts without words
    have no near-duplicates and stay. An empty table stays empty.
    """
    rows = keyed(docs)
    found = table(near_dedup.near_duplicates(rows.select(F.col(KEY).alias("doc_id"), "text"), percent=NEAR), "near")
    counts = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    special = table(counts.where("n > 1 or not kept").select(F.col("doc_id").alias(KEY), "n", "kept"), "special")
    single = without(rows, KEY, special)
    whole = F.struct(*docs.columns)
    repeated = rows.join(special.where("kept"), KEY, "left_semi").groupBy(KEY, "text").agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return single.select(*docs.columns).unionByName(repeated.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Null and empty texts hold none and stay, as does everything without a benchmark.
    Rows that share a doc_id go together. An empty table stays empty.
    """
    rows = keyed(docs)
    found = decontam.contaminated(rows.select(F.col(KEY).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    held = table(found.select(F.col("doc_id").alias(KEY)).distinct(), "held")
    return without(rows, KEY, held).drop(KEY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; documents that it takes no word of go.

    Null and empty texts have no words and go. A null source is a source. Rows that
    repeat a doc_id are taken or left together. An empty table stays empty.
    """
    own = docs.columns
    rows = docs.select(*(F.col(f"`{c}`").alias(c if c in ("doc_id", "text", "source") else f"__{c}") for c in own))
    mixed = mixing.mix(rows).where("taken > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return mixed.select(*(F.col(c if c in ("doc_id", "text", "source") else f"`__{c}`").alias(c) for c in own))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard and their place in it.

    Rows with equal texts, null ones too, share a shard; ties in a shard are placed by
    doc_id. An empty table gives none.
    """
    return sharding.shard(docs)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: Language ID, near-duplicates and sharding are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row, each written and read again; what a stage leaves besides is deleted."""
    docs, start = read(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
        release(spark, start, keep=1)
    return docs
