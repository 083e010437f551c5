"""Model tables derived from the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, tp, t, x, y): one track per user, points in time order, t in minutes since its first point."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").withColumn("tp", F.row_number().over(order) - 1)
    minutes = (F.unix_micros(F.col("ts").cast("timestamp")) - F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id"))) / 6e7
    return rows.select(F.col("user_id").alias("track"), "tp", minutes.alias("t"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tp, pt, x, y, score): one frame per day; a point's number is its event's, so that no row waits for another."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    rows = read(spark, sf_dir, "events").withColumn("tp", day)
    return rows.select("tp", F.col("event_id").alias("pt"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), (F.col("value") / 500).alias("score"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cond, stage, score): line items with their flag, status and price."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cond"), F.col("l_linestatus").alias("stage"), F.col("l_extendedprice").alias("score"), F.col("l_quantity").alias("quantity"))


def scored_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(truth, score): labelled documents, scored by their length."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return labels.join(docs.select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("truth"), F.col("n_chars").cast("double").alias("score"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pt, x, y, label): first two components of the vectors."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pt"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, sel_class, x0, y0, x1, y1): boxes, corners in any order."""
    k = F.get_json_object("props", "$.k").cast("double")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("sel_class"), F.floor("value").cast("double").alias("x0"), k.alias("y0"), F.floor(F.col("value") / 10).cast("double").alias("x1"), F.lit(50.0).alias("y1"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, row, col, value): every part is a pixel; a hundred parts make an image of ten by ten."""
    key = F.col("p_partkey")
    image = F.concat(F.lit("I"), F.floor(key / 100).cast("string"))
    return read(spark, sf_dir, "part").select(image.alias("image"), (F.floor(key / 10) % 10).cast("int").alias("row"), (key % 10).cast("int").alias("col"), F.col("p_size").cast("double").alias("value"))
