"""Structured nodes of a text: headings with their meta lines, list items and paragraphs (character offsets)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from textloom.functions.text import trimmed
from textloom.operators.classify import heading_level, heading_line, heading_meta, list_line


def structured_nodes(docs: DataFrame) -> DataFrame:
    """``doc_id, node_index, kind, start, end, text, level, meta_count`` of normalised texts.

    A heading takes the meta lines right after it.  Whether a line is taken depends
    on those before it: within a run of lines that could be meta lines it is taken
    if the run follows a heading, or if a line before it in the run is a heading
    itself; that line is then the head.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "raw")).withColumn("t", trimmed(F.col("raw")))
    order = W.partitionBy("doc_id").orderBy("i")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    lines = lines.withColumns({"start": F.coalesce(F.sum(F.length("t") + 1).over(before), F.lit(0)), "meta": heading_meta(F.col("t")), "head": heading_line(F.col("t"))})
    # a run is a line that can't be meta and the possible meta lines right after it
    lines = lines.withColumn("run", F.sum(F.when(F.col("meta"), 0).otherwise(1)).over(order))
    within = W.partitionBy("doc_id", "run").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    taken = F.col("meta") & F.coalesce(F.max("head").over(within), F.lit(False))
    lines = lines.withColumn("taken", taken).where(F.length("t") > 0)
    lines = lines.withColumn("node", F.sum(F.when(F.col("taken"), 0).otherwise(1)).over(order) - 1)
    nodes = lines.groupBy("doc_id", "node").agg(
        F.min_by("t", "i").alias("first"), F.min("start").alias("start"), F.max(F.col("start") + F.length("t")).alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "\n").alias("text"), (F.count("*") - 1).alias("meta_count"),
    )
    first = F.col("first")
    kind = F.when(heading_line(first), "heading").when(list_line(first), "list_item").otherwise("paragraph")
    return nodes.select("doc_id", F.col("node").cast("int").alias("node_index"), kind.alias("kind"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "text", F.when(kind == "heading", heading_level(first)).alias("level"), "meta_count")


def format_summary(nodes: DataFrame) -> DataFrame:
    """Nodes of each kind, one row a document."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return nodes.groupBy("doc_id").agg(n("heading").alias("headings"), n("paragraph").alias("paragraphs"), n("list_item").alias("list_items"))
