"""Scoring documents as they arrive, and counting decisions by day (beyond the reference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.config import EngineConfig
from textloom.plans import pipeline

DOCUMENT = "doc_id bigint, text string"


def new_documents(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).parquet(path)


def score_stream(documents: DataFrame, out: str, checkpoint: str, cfg: EngineConfig = EngineConfig()) -> StreamingQuery:
    """Appends one scored row a document to ``out``; every batch runs the batch pipeline."""

    def batch(rows: DataFrame, number: int) -> None:
        pipeline.detect(rows, cfg=cfg).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_decisions(log: DataFrame, late: str = "2 days") -> DataFrame:
    """Decisions by day of a streamed review log; rows later than ``late`` behind are left out."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "decision").agg(F.count("*").alias("n"))
