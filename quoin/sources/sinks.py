"""Writers: JSON records, bundles of result tables, HTML by page, append-only checkpoints, score caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_bundle(tables: dict[str, DataFrame], folder: str, run: str) -> None:
    """One Parquet table for each artifact, a partition for each run; a rerun replaces its own partition only."""
    for name, rows in tables.items():
        out = rows.withColumn("run", F.lit(run)).write.option("partitionOverwriteMode", "dynamic").partitionBy("run")
        out.mode("overwrite").parquet(f"{folder}/{name}")


def write_pages(pages: DataFrame, folder: str, key: str = "page_id") -> None:
    """Text files of HTML, a folder for each page."""
    pages.select(key, F.col("html").alias("value")).write.mode("overwrite").partitionBy(key).text(folder)


def append_checkpoint(rows: DataFrame, folder: str, identity: dict[str, str]) -> None:
    """Append finished rows with the identity (image, structure, prompt hashes, model, count) they hold for."""
    rows.withColumns({k: F.lit(v) for k, v in identity.items()}).write.mode("append").parquet(folder)


def score_cache(scores: DataFrame, path: str) -> None:
    """method and a JSON map of sample to score."""
    maps = scores.groupBy("method").agg(F.map_from_entries(F.collect_list(F.struct(F.col("sample").cast("string"), "score"))).alias("scores"))
    maps.write.mode("overwrite").json(path)
