"""Interval joins: paragraph against sentence segments, and segments against structured nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.functions.text import byte_slice

RANGE = 4096


def overlaps(left: DataFrame, right: DataFrame, width: int = RANGE) -> DataFrame:
    """Pairs of ``left`` and ``right`` rows (``doc_id, start, end``, distinct other names) of a document that overlap, with ``overlap``.

    Both sides are put into bins of ``width`` bytes, so a document of many
    segments costs its pairs only and spreads over tasks; a pair is kept in the bin where it begins.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(F.greatest(b - 1, a) / width)))
    x = left.withColumn("bin", bins(F.col("start"), F.col("end"))).withColumnsRenamed({"start": "l_start", "end": "l_end"})
    y = right.withColumn("bin", bins(F.col("start"), F.col("end"))).withColumnsRenamed({"start": "r_start", "end": "r_end"})
    begin, finish = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    pairs = x.join(y, ["doc_id", "bin"]).withColumns({"overlap": finish - begin, "from": begin})
    return pairs.where((F.col("overlap") > 0) & (F.floor(F.col("from") / width) == F.col("bin"))).drop("bin")


def rounded(x: Column) -> Column:
    """To four digits, halves up."""
    return F.floor(x * 10000 + 0.5) / 10000


def matched(paragraphs: DataFrame, sentences: DataFrame) -> DataFrame:
    """Pairs of segments that cover more than half of each other.

    ``doc_id, paragraph_id, sentence_id, paragraph_probability, sentence_probability, overlap, from, agree, diff``.
    """
    p = paragraphs.select("doc_id", "start", "end", F.col("chunk_id").alias("paragraph_id"), F.col("raw_probability").alias("paragraph_probability"))
    s = sentences.select("doc_id", "start", "end", F.col("chunk_id").alias("sentence_id"), F.col("raw_probability").alias("sentence_probability"))
    both = overlaps(p, s)
    much = (F.col("overlap") / (F.col("l_end") - F.col("l_start")) > 0.5) & (F.col("overlap") / (F.col("r_end") - F.col("r_start")) > 0.5)
    agree = (F.col("paragraph_probability") > 0.5) == (F.col("sentence_probability") > 0.5)
    return both.where(much).withColumns({"agree": agree, "diff": F.abs(F.col("paragraph_probability") - F.col("sentence_probability"))}).drop("l_start", "l_end", "r_start", "r_end")


def divergent(pairs: DataFrame, docs: DataFrame, threshold: float = 0.20, preview: int = 100) -> DataFrame:
    """Pairs whose probabilities differ by more than ``threshold``, with the overlapping text's first bytes."""
    far = pairs.where(F.col("diff") > threshold).join(docs.select("doc_id", "text"), "doc_id")
    cut = byte_slice(F.col("text"), F.col("from"), F.col("from") + F.col("overlap"), preview)
    shown = F.when(F.col("overlap") > preview, F.concat(cut, F.lit("..."))).otherwise(cut)
    return far.select("doc_id", "paragraph_id", "sentence_id", rounded(F.col("paragraph_probability")).alias("paragraph_probability"), rounded(F.col("sentence_probability")).alias("sentence_probability"), rounded(F.col("diff")).alias("diff"), "overlap", shown.alias("preview"))


def agreement(pairs: DataFrame, threshold: float = 0.20) -> DataFrame:
    """``doc_id, agreed, far``: the share of a document's pairs on the same side of 0.5, and how many differ by more than ``threshold``."""
    return pairs.groupBy("doc_id").agg(F.avg(F.col("agree").cast("double")).alias("agreed"), F.count_if(F.col("diff") > threshold).alias("far"))


def comparison(docs: DataFrame, paragraphs: DataFrame, sentences: DataFrame, threshold: float = 0.20) -> DataFrame:
    """``doc_id, probability_diff, consistency_score, divergent_count``; 0, 1 and 0 where a side is empty."""
    mean = lambda side, name: side.groupBy("doc_id").agg(F.avg("raw_probability").alias(name))
    agreed = agreement(matched(paragraphs, sentences), threshold)
    rows = docs.select("doc_id").join(mean(paragraphs, "p"), "doc_id", "left").join(mean(sentences, "s"), "doc_id", "left").join(agreed, "doc_id", "left")
    return rows.select(
        "doc_id", F.coalesce(rounded(F.abs(F.col("p") - F.col("s"))), F.lit(0.0)).alias("probability_diff"),
        F.coalesce(rounded(F.col("agreed")), F.lit(1.0)).alias("consistency_score"), F.coalesce("far", F.lit(0)).alias("divergent_count"),
    )


def mapped(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Segments and the nodes they cover by a fifth or more: ``doc_id, chunk_id, node_index, kind, overlap, coverage``."""
    s = segments.select("doc_id", "start", "end", "chunk_id")
    n = nodes.select("doc_id", "start", "end", "node_index", "kind")
    coverage = F.col("overlap") / F.greatest(F.lit(1), F.col("r_end") - F.col("r_start"))
    return overlaps(s, n).withColumn("coverage", coverage).where(F.col("coverage") >= 0.2).select("doc_id", "chunk_id", "node_index", "kind", "overlap", F.bround("coverage", 4).alias("coverage"))


def unmapped(segments: DataFrame, nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """``doc_id, side, id`` of segments and nodes without a hit."""
    s = segments.join(hits, ["doc_id", "chunk_id"], "left_anti").select("doc_id", F.lit("segment").alias("side"), F.col("chunk_id").cast("bigint").alias("id"))
    n = nodes.join(hits, ["doc_id", "node_index"], "left_anti").select("doc_id", F.lit("node").alias("side"), F.col("node_index").cast("bigint").alias("id"))
    return s.unionByName(n)


def primary_nodes(hits: DataFrame) -> DataFrame:
    """The node that stands for each segment: of its text nodes, else of all, the one covered most."""
    body = F.col("kind").isin("paragraph", "list_item").cast("int")
    order = W.partitionBy("doc_id", "chunk_id").orderBy(F.desc(body), F.desc("coverage"), F.desc("overlap"), "node_index")
    return hits.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def mismatched(hits: DataFrame) -> DataFrame:
    """Segments with several hits, or whose best one is covered by less than 0.8."""
    rows = hits.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("hits"), F.max("coverage").alias("best"))
    return rows.where((F.col("hits") >= 2) | (F.col("best") < 0.8))


def headings_have_bodies(hits: DataFrame) -> DataFrame:
    """``doc_id, ok``: whether every mapped heading shares a segment with a text node."""
    body = F.col("kind").isin("paragraph", "list_item")
    chunk = hits.groupBy("doc_id", "chunk_id").agg(F.bool_or(body).alias("has_body"))
    headings = hits.where("kind = 'heading'").join(chunk, ["doc_id", "chunk_id"]).groupBy("doc_id", "node_index").agg(F.bool_or("has_body").alias("good"))
    return hits.select("doc_id").distinct().join(headings.groupBy("doc_id").agg(F.bool_and("good").alias("good")), "doc_id", "left").select("doc_id", F.coalesce("good", F.lit(True)).alias("ok"))


def highlighted(segments: DataFrame, far: DataFrame, side: str = "paragraph_id") -> DataFrame:
    """``segments`` with ``divergent``: whether they are in one of the pairs of ``divergent``."""
    ids = far.select("doc_id", F.col(side).alias("chunk_id")).distinct().withColumn("_far", F.lit(True))
    return segments.join(ids, ["doc_id", "chunk_id"], "left").withColumn("divergent", F.coalesce("_far", F.lit(False))).drop("_far")


def originals(segments: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, chunk_id, original``: each segment's slice of its document."""
    rows = segments.select("doc_id", "chunk_id", "start", "end").join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id")
    return rows.select("doc_id", "chunk_id", byte_slice(F.col("_text"), F.col("start"), F.col("end")).alias("original"))


def badges(hits: DataFrame, most: int = 3) -> DataFrame:
    """``doc_id, chunk_id, nodes``: the nodes shown with a segment, those covered most first."""
    item = F.struct((-F.col("coverage")).alias("c"), (-F.col("overlap")).alias("o"), "node_index")
    return hits.groupBy("doc_id", "chunk_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["node_index"]), 1, most).alias("nodes"))


def in_order(segments: DataFrame, most: int | None = None) -> DataFrame:
    """``segments`` by document and place, for output only; ``most`` keeps the first so many of each document."""
    kept = segments if most is None else segments.where(F.col("chunk_id") < most)
    return kept.orderBy("doc_id", "chunk_id")
