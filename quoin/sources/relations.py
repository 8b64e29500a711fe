"""The engine's relations, read from the driver's tables or from the formats the workload uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_WIDTH, PAGE_HEIGHT = 1200, 900


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, element_id, l, t, r, b, uied_class: the boxes of every page, 13 at most in the driver's tables."""
    rows = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    left = (F.col("l_partkey") * 7 + F.col("l_linenumber") * 131) % 1000
    top = (F.col("l_suppkey") * 13 + F.col("l_linenumber") * 97) % 780
    kind = F.when(F.col("l_returnflag") == "R", "Text").when(F.col("l_returnflag") == "N", "Compo").otherwise("Block")
    return rows.select(
        F.col("l_orderkey").alias("page_id"),
        (F.row_number().over(order) - 1).cast("int").alias("element_id"),
        left.cast("int").alias("l"),
        top.cast("int").alias("t"),
        (left + 20 + F.col("l_quantity").cast("int") * 3).cast("int").alias("r"),
        (top + 12 + (F.col("l_partkey") % 9) * 12).cast("int").alias("b"),
        kind.alias("uied_class"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, direction, position, start, end, source: a separator line for every page."""
    rows = read(spark, sf_dir, "orders")
    vertical = F.col("o_orderstatus") == "O"
    return rows.select(
        F.col("o_orderkey").alias("page_id"),
        F.when(vertical, "vertical").otherwise("horizontal").alias("direction"),
        F.when(vertical, (F.col("o_custkey") * 17) % 1000 + 50).otherwise((F.col("o_custkey") * 13) % 700 + 50).cast("int").alias("position"),
        F.lit(0).alias("start"),
        F.when(vertical, F.lit(PAGE_HEIGHT)).otherwise(F.lit(PAGE_WIDTH)).alias("end"),
        F.when(F.col("o_orderkey") % 2 == 0, "lsd").otherwise("whitespace").alias("source"),
    )


def nodes(boxes: DataFrame) -> DataFrame:
    """A layout node table: a root for every page and its elements as children, in element order."""
    root = boxes.groupBy("page_id").agg(*(F.min(c).alias(c) for c in "lt"), *(F.max(c).alias(c) for c in "rb"))
    root = root.select("page_id", F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("ordinal"), "l", "t", "r", "b", F.lit("column").alias("layout_type"))
    leaves = boxes.select("page_id", (F.col("element_id") + 1).alias("node_id"), F.lit(0).alias("parent_id"), F.col("element_id").alias("ordinal"), "l", "t", "r", "b", F.lit("atomic").alias("layout_type"))
    return root.unionByName(leaves)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method, sample, score: one score for each method and sample."""
    rows = read(spark, sf_dir, "events")
    return rows.groupBy(F.col("event_type").alias("method"), F.col("user_id").alias("sample")).agg(F.round(F.avg("value"), 6).alias("score"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation records: record_id, segmenter, status, elapsed, leaf_count."""
    rows = read(spark, sf_dir, "events")
    return rows.select(
        F.col("event_id").alias("record_id"),
        F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("segmenter"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.col("value").alias("elapsed"),
        F.from_json("props", "struct<k: int>")["k"].alias("leaf_count"),
    )


BOX = T.StructType([T.StructField(c, T.IntegerType()) for c in ("column_min", "row_min", "column_max", "row_max")])
ARTIFACT = T.StructType(
    [
        T.StructField("img_shape", T.ArrayType(T.IntegerType())),
        T.StructField(
            "compos",
            T.ArrayType(
                T.StructType(
                    [T.StructField("id", T.IntegerType()), T.StructField("class", T.StringType()), T.StructField("text_content", T.StringType()), T.StructField("position", BOX), *BOX.fields]
                )
            ),
        ),
    ]
)


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Detector payloads, one JSON file a page: page, image_height, image_width, compos. Malformed files fail."""
    rows = spark.read.schema(ARTIFACT).option("multiLine", True).option("mode", "FAILFAST").json(folder)
    page = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)\.json$", 1)
    return rows.select(page.alias("page"), F.col("img_shape")[0].alias("image_height"), F.col("img_shape")[1].alias("image_width"), "compos")


def invalid_artifacts(rows: DataFrame) -> DataFrame:
    """Payloads without a positive shape or without a list of components."""
    shaped = (F.col("image_height") > 0) & (F.col("image_width") > 0)
    return rows.where(~F.coalesce(shaped, F.lit(False)) | F.col("compos").isNull())


def components(rows: DataFrame) -> DataFrame:
    """One row for each component, with nested or flat coordinates."""
    one = rows.select("page", "image_height", "image_width", F.explode("compos").alias("c"))
    place = {short: F.coalesce(F.col(f"c.position.{name}"), F.col(f"c.{name}")).alias(short) for short, name in zip("ltrb", BOX.names, strict=True)}
    return one.select("page", "image_height", "image_width", F.col("c.id").alias("element_id"), F.col("c.class").alias("uied_class"), F.col("c.text_content").alias("text"), *place.values())


def html_folder(spark: SparkSession, folder: str, suffix: str = ".html", exclude: tuple[str, ...] = ()) -> DataFrame:
    """page, html of every file with the suffix whose name holds none of exclude."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter=f"*{suffix}").select(F.col("_metadata.file_name").alias("page"), F.col("value").alias("html"))
    for part in exclude:
        rows = rows.where(~F.col("page").contains(part))
    return rows


def url_list(spark: SparkSession, path: str, most: int, column: str = "url") -> DataFrame:
    """The first most URLs of a CSV file with a header, by line."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(column).withColumn("line", F.monotonically_increasing_id()).orderBy("line").limit(most).drop("line")


def url_shard(spark: SparkSession, path: str) -> DataFrame:
    """Distinct URLs of a JSON-lines shard."""
    return spark.read.json(path).select("url").distinct()


def score_maps(rows: DataFrame, column: str) -> DataFrame:
    """method, sample, score from JSON text of the form {method: {sample: score}}."""
    maps = rows.select(F.explode(F.from_json(column, "map<string, map<string, double>>")).alias("method", "by_sample"))
    return maps.select("method", F.explode("by_sample").alias("sample", "score"))


def if_same_identity(saved: DataFrame, now: DataFrame, key: list[str], identity: list[str]) -> DataFrame:
    """Saved rows whose identity columns equal the current ones; others count as absent."""
    return saved.join(now.select(*key, *identity).distinct(), [*key, *identity], "left_semi")


def data_url_bytes(value):
    """The bytes of a base64 data URL."""
    return F.unbase64(F.element_at(F.split(value, ","), -1))
