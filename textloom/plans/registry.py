"""Where queries register, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.plans import pipeline
from textloom.tables import spread, table

END = {"end": "end_offset"}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(statement: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return register


def documents(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, text`` of every document; only a table below the bound of ``spread`` is shuffled."""
    return spread(table(spark, root, "documents").select("doc_id", "text"), "doc_id")


def clean(spark: SparkSession, root: str) -> DataFrame:
    return pipeline.prepared(documents(spark, root))


def rounded(c: str, name: str | None = None) -> Column:
    return F.round(F.col(c), 6).alias(name or c)


def review_log(spark: SparkSession, root: str) -> DataFrame:
    """The review log, exact duplicate rows once."""
    return table(spark, root, "review_log").distinct()
