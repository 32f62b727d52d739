"""The queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from textloom.checkpoints import cut
from textloom.llm import byte_bpe, chunking, encoding_repair, language_id, lookalike, mixture, sentences, structure, subjects
from textloom.tables import spread, table


def _texts(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """The named columns and ``text`` of a table, over all cores; the first column is its key."""
    return spread(table(spark, root, name).select(*columns, "text"), columns[0])


def _blocks(spark: SparkSession, root: str) -> DataFrame:
    """Text blocks, exact duplicate rows once."""
    return table(spark, root, "text_blocks").where("block_id is not null").dropDuplicates(["block_id"])


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents and blocks that are lists, tables or junk."""
    docs = structure.kinds(_texts(spark, root, "documents", "doc_id"), "doc_id", article=True)
    blocks = structure.kinds(_texts(spark, root, "text_blocks", "block_id"), "block_id")
    both = docs.select(F.lit("documents").alias("origin"), "*").unionByName(blocks.select(F.lit("text_blocks").alias("origin"), "*"))
    return both.where(F.col("kind").isin("list", "table", "junk") & F.col("item_id").isNotNull()).distinct()


def p1_statistics(spark: SparkSession, root: str) -> DataFrame:
    """Statistics of every document and block."""
    docs = structure.text_statistics(_texts(spark, root, "documents", "doc_id"), "doc_id", article=True)
    blocks = structure.text_statistics(_blocks(spark, root), "block_id")
    return docs.select(F.lit("documents").alias("origin"), "*").unionByName(blocks.select(F.lit("text_blocks").alias("origin"), "*"))


def p1_filter_summary(spark: SparkSession, root: str) -> DataFrame:
    """Blocks of each request, and how many of them are filtered for being no prose."""
    blocks = _blocks(spark, root).select("block_id", "request_id")
    kinds = structure.kinds(table(spark, root, "text_blocks"), "block_id").dropDuplicates(["item_id"]).withColumnRenamed("item_id", "block_id")
    filtered = F.col("kind").isNull() | (F.col("kind") != "prose")
    return blocks.join(kinds, "block_id").groupBy("request_id").agg(
        F.count("*").alias("total_paragraphs"), F.count_if(~filtered).alias("body_count"), F.count_if(filtered).alias("filtered_count")
    )


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Sentence starts of the requests that the old splitter's table holds."""
    asked = table(spark, root, "sentence_results").select("request_id").distinct()
    requests = sentences.one_row(table(spark, root, "detect_requests").select("request_id", "text").join(asked, "request_id", "left_semi"))
    return sentences.split_sentences(requests).select("request_id", "start")


def p2_sentences(spark: SparkSession, root: str) -> DataFrame:
    """Sentences of every request."""
    return sentences.split_sentences(sentences.one_row(table(spark, root, "detect_requests").select("request_id", "text")))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of requests whose texts look the same but differ."""
    return lookalike.pairs(table(spark, root, "detect_requests"))


def p3_canonical(spark: SparkSession, root: str) -> DataFrame:
    """The canonical member of every request in a class of look-alikes."""
    return lookalike.canonical(table(spark, root, "detect_requests")).select("request_id", "strict_id", "loose_id")


def p4_languages(spark: SparkSession, root: str) -> DataFrame:
    """Language and confidence of every request and document, and of each stretch of mixed ones."""
    asked = _texts(spark, root, "detect_requests", "request_id", "language").where("request_id is not null").select(F.col("request_id").alias("item_id"), F.col("language").alias("label"), "text")
    docs = _texts(spark, root, "documents", "doc_id", "lang").select(F.col("doc_id").cast("string").alias("item_id"), F.col("lang").alias("label"), "text")
    model = language_id.fit(language_id.sample(asked, "label"))
    pairs = encoding_repair.fit_pairs(asked)
    # rows of one request carry one text: its results, not its texts, are shuffled to count it once
    of_requests = language_id.request_languages(asked, model, pairs).dropDuplicates(["item_id", "segment"])
    of_docs = language_id.document_languages(docs, model)
    return of_docs.select(F.lit("documents").alias("origin"), "*").unionByName(of_requests.select(F.lit("detect_requests").alias("origin"), "*"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Main language of items whose label is missing or wrong, and the stretches of mixed requests; those of documents aren't asked for."""
    rows = p4_languages(spark, root).where("lang is not null and (segment = 0 or origin = 'detect_requests')")
    named = language_id.label_of(F.col("label"))
    return rows.where((F.col("segment") > 0) | named.isNull() | (named != F.col("lang"))).select("origin", "item_id", "segment", "lang")


def _p5_pieces(spark: SparkSession, root: str) -> DataFrame:
    return chunking.split_blocks(table(spark, root, "text_blocks"), table(spark, root, "detect_requests"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Blocks that had to be cut."""
    return _p5_pieces(spark, root).where("piece = 0").select("block_id")


def p5_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of the blocks that had to be cut."""
    return _p5_pieces(spark, root)


def _p6_lines(spark: SparkSession, root: str) -> DataFrame:
    requests = sentences.one_row(table(spark, root, "detect_requests").select("request_id", "client_id", "genre", "text"))
    texts = table(spark, root, "detect_requests").select("text")
    pairs = encoding_repair.fit_pairs(texts)
    found = cut(encoding_repair.evidence(encoding_repair.records_of(requests), pairs))
    return encoding_repair.posteriors(found)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Requests with wrongly decoded text."""
    return encoding_repair.garbled_lines(_p6_lines(spark, root)).select("request_id").distinct()


def p6_repaired(spark: SparkSession, root: str) -> DataFrame:
    """Requests with wrongly decoded text, restored as far as possible."""
    rows = _p6_lines(spark, root)
    lines = rows.join(encoding_repair.garbled_lines(rows), ["request_id", "line"])
    requests = sentences.one_row(table(spark, root, "detect_requests").select("request_id", "text"))
    return encoding_repair.restored(requests, lines)


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document."""
    return byte_bpe.encode_corpus(_texts(spark, root, "documents", "doc_id"))


def _p8(spark: SparkSession, root: str) -> tuple[DataFrame, list[tuple]]:
    sized = cut(mixture.sizes(_texts(spark, root, "documents", "doc_id", "source")))
    return sized, mixture.plan(sized, table(spark, root, "source_targets"))


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    """The mixture: each document used, and how many times."""
    sized, planned = _p8(spark, root)
    return mixture.mix(spark, sized, planned)


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """The share of each source in the mixture, as wanted and as reached."""
    sized, planned = _p8(spark, root)
    return mixture.shares(spark, mixture.mix(spark, sized, planned), planned)


def p9_subjects(spark: SparkSession, root: str) -> DataFrame:
    """Subjects of every document, with their shares and probabilities."""
    docs = table(spark, root, "documents")
    rows, names = subjects.sample(docs, table(spark, root, "subject_labels"), table(spark, root, "subject_catalog"))
    return subjects.subjects_of(_texts(spark, root, "documents", "doc_id", "title", "source"), subjects.fit(rows, names))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Subjects of every document."""
    return p9_subjects(spark, root).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, root: str) -> DataFrame:
    """The corpus by subject: documents, and characters shared out by the subjects' shares."""
    found = p9_subjects(spark, root)
    sizes = table(spark, root, "documents").select("doc_id", F.length("text").alias("chars"))
    return found.join(sizes, "doc_id").groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.sum(F.col("chars") * F.col("share"))).cast("bigint").alias("chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p1_found, p1_statistics, p1_filter_summary, p2_found, p2_sentences, p3_found, p3_canonical, p4_found, p4_languages, p5_found, p5_pieces, p6_found, p6_repaired, p7_ids, p8_mix, p8_shares, p9_found, p9_subjects, p9_composition]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """Only where SQL is another way to the whole result."""
    return {"p5_found": P5_FOUND}


P5_FOUND = """
with l as (
  select request_id, min(struct_pack(a := received_at, b := case when chunking.chunk_size_tokens >= 1 then chunking.chunk_size_tokens else 1500 end)).b as size_limit
  from detect_requests where request_id is not null group by 1
)
select distinct b.block_id
from text_blocks b left join l on l.request_id = b.request_id
where len(regexp_extract_all(b.text, '[A-Za-z0-9_]+|[\\x{4e00}-\\x{9fff}]')) > coalesce(l.size_limit, 1500)
"""
