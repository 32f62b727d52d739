"""Append-only logs of reviews and runs, as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.operators.review import decision_counts, latest

REVIEW = "request_id string, decision string, overall_probability double, overall_confidence double, label int, notes string, ts timestamp"


def append_reviews(rows: DataFrame, path: str) -> DataFrame:
    """Appends reviews, stamped now where they have no time, and returns the log's decision counts."""
    stamped = rows.withColumn("ts", F.coalesce(F.col("ts"), F.current_timestamp())) if "ts" in rows.columns else rows.withColumn("ts", F.current_timestamp())
    stamped.write.mode("append").parquet(path)
    return decision_counts(rows.sparkSession.read.schema(REVIEW).parquet(path))


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    """The newest runs; ``total`` counts all of them."""
    return latest(spark.read.parquet(path), most)
