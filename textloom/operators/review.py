"""Calibration, review metrics and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.aggregate import base_decision
from textloom.operators.score import logistic, logit


def calibration(rows: DataFrame) -> DataFrame:
    """One row ``a, b`` from ``probability, label``: slope by the distance of the classes' means, offset by their sizes.

    Without rows of one class it is 1 and 0; null and other labels don't count.
    """
    one, zero = F.col("label") == 1, F.col("label") == 0
    sums = rows.where("probability is not null").agg(F.avg(F.when(one, F.col("probability"))).alias("m1"), F.avg(F.when(zero, F.col("probability"))).alias("m0"), F.count_if(one).alias("n1"), F.count_if(zero).alias("n0"))
    both = (F.col("n1") > 0) & (F.col("n0") > 0)
    a = F.greatest(F.lit(0.5), F.least(F.lit(3.0), F.abs(F.col("m1") - F.col("m0")) * 6))
    return sums.select(F.when(both, a).otherwise(1.0).alias("a"), F.when(both, F.log((F.col("n1") + 1) / (F.col("n0") + 1))).otherwise(0.0).alias("b"))


def calibrated(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """``rows`` with ``calibrated`` and the decision on it; the one-row fit is broadcast."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), logistic(F.col("a") * logit(F.col("probability")) + F.col("b"))))
    out = rows.crossJoin(F.broadcast(fitted)).withColumn("calibrated", p)
    return out.withColumn("decision", base_decision(F.col("calibrated"), 0.65, 0.85)).drop("a", "b")


def decision_counts(log: DataFrame) -> DataFrame:
    """Rows of each decision, and all."""
    n = lambda d: F.count_if(F.col("decision") == d).alias(d)
    return log.agg(F.count("*").alias("total"), n("pass"), n("review"), n("flag"))


def metrics(log: DataFrame) -> DataFrame:
    """Confusion counts and rates over rows labelled 0 or 1 and decided pass or flag."""
    rows = log.where(F.col("label").isin(0, 1) & F.col("decision").isin("pass", "flag"))
    n = lambda d, y: F.count_if((F.col("decision") == d) & (F.col("label") == y))
    sums = rows.agg(n("flag", 1).alias("tp"), n("pass", 0).alias("tn"), n("flag", 0).alias("fp"), n("pass", 1).alias("fn"))
    share = lambda a, b: a / F.greatest(F.lit(1), b)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = sums.withColumns({"accuracy": share(tp + tn, tp + tn + fp + fn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn)})
    f1: Column = 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-6), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1)


def latest(history: DataFrame, most: int = 100) -> DataFrame:
    """The newest ``most`` rows by ``ts``, then ``request_id``, with ``total`` counting all."""
    total = history.agg(F.count("*").alias("total"))
    return history.orderBy(F.desc_nulls_last("ts"), "request_id").limit(most).crossJoin(F.broadcast(total))
