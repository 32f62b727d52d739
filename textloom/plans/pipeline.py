"""The engine's pipelines over all documents (``doc_id, text``, perhaps ``language``).

All are lazy but ``detect_dual``, which writes the numbers of its segments once
while the plan is built, since several branches read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.checkpoints import cut
from textloom.config import EngineConfig
from textloom.functions.text import language, normalized, tokens
from textloom.operators import aggregate, classify, compare, features, score, split


def prepared(docs: DataFrame) -> DataFrame:
    """``doc_id, text, language``: normalised texts; a language that isn't given is told from the text.  Nothing is shuffled."""
    clean = docs.withColumn("text", normalized(F.col("text")))
    own = F.col("language") if "language" in docs.columns else F.lit(None).cast("string")
    return clean.select("doc_id", "text", F.coalesce(own, language(F.col("text"))).alias("language"))


def _items(mode: str, cfg: EngineConfig) -> Column:
    """array<struct<start,end,text>> of a text's segments."""
    text = F.col("text")
    if mode == "paragraph":
        found = split.line_array(text) if cfg.lines_as_paragraphs else split.paragraph_array(text)
    else:
        found = split.sentence_block_array(split.sentence_array(text), cfg.sentence_target, cfg.sentence_most)
    return F.transform(found, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["text"].alias("text")))


def kept_paragraphs(text: Column) -> Column:
    """array<struct<start,end,text>>: the paragraphs that no rule of the content filter takes out."""
    return F.filter(split.paragraph_array(text), lambda b: classify.is_body(b["text"]))


def scored_blocks(blocks: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Blocks (``language, start, end, text`` and keys) with features, scores and decisions."""
    if cfg.use_stylometry:
        rows = features.stylometry(blocks)
    else:
        rows = blocks.withColumn("token_counts", features.counts_of(tokens(F.col("text")))).withColumns({c: F.lit(0.0) for c in features.FEATURES})
    rows = features.perplexity(rows) if cfg.use_perplexity else rows.withColumn("ppl", F.lit(None).cast("double"))
    academic = F.col("academic") if "academic" in blocks.columns else cfg.academic
    scored = score.scored(rows.drop("tokens", "token_counts"), "language", academic, cfg.noise)
    return aggregate.segment_decision(aggregate.evidenceless(scored), cfg.sensitivity)


def segments(docs: DataFrame, mode: str = "paragraph", cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Scored segments of ``prepared`` documents, by paragraphs or packed sentences; an ``academic`` column of ``docs`` counts for its segments."""
    keys = ["doc_id", "language", *(["academic"] if "academic" in docs.columns else [])]
    blocks = docs.select(*keys, F.posexplode(_items(mode, cfg)).alias("chunk_id", "b")).select(*keys, "chunk_id", "b.start", "b.end", "b.text")
    return scored_blocks(blocks, cfg)


def filtered_segments(docs: DataFrame, mode: str = "paragraph", cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """As ``segments``, of the paragraphs that the content filter keeps: detection as it runs with the filter on.

    Segments are numbered anew; sentences never cross what was filtered out.  A
    document of which nothing is kept has no segments.
    """
    keys = ["doc_id", "language", *(["academic"] if "academic" in docs.columns else [])]
    kept = docs.select(*keys, "text", kept_paragraphs(F.col("text")).alias("p"))
    items = F.col("p")
    if mode == "sentence":
        items = split.span_block_array(F.col("text"), split.paragraph_sentences(F.col("text"), items), cfg.sentence_target, cfg.sentence_most)
    blocks = kept.select(*keys, F.posexplode(items).alias("chunk_id", "b")).select(*keys, "chunk_id", "b.start", "b.end", "b.text")
    return scored_blocks(blocks, cfg)


def detect(docs: DataFrame, mode: str = "paragraph", cfg: EngineConfig = EngineConfig(), filtered: bool = False) -> DataFrame:
    """One row a document: its aggregate and decision."""
    clean = prepared(docs)
    found = (filtered_segments if filtered else segments)(clean, mode, cfg)
    return aggregate.with_empty(docs, aggregate.aggregated(found, cfg.sensitivity))


NUMBERS = ["doc_id", "mode", "chunk_id", "start", "end", "raw_probability", "confidence", "uncertainty", "supports_flag"]


def both_views(docs: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """NUMBERS of the segments of both views of ``prepared`` documents, written once, then shuffled so that all of a document lie together.

    Each text is read once and gives the segments of both views; only their numbers are shuffled.
    """
    tagged = lambda mode: F.transform(_items(mode, cfg), lambda b, i: F.struct(F.lit(mode).alias("mode"), i.alias("chunk_id"), b.alias("b")))
    none = F.expr("cast(array() as array<struct<mode:string,chunk_id:int,b:struct<start:int,end:int,text:string>>>)")
    both = F.concat(F.coalesce(tagged("paragraph"), none), F.coalesce(tagged("sentence"), none))
    rows = docs.select("doc_id", "language", F.explode(both).alias("x")).select("doc_id", "language", "x.mode", "x.chunk_id", "x.b.start", "x.b.end", "x.b.text")
    return cut(scored_blocks(rows, cfg).select(*NUMBERS)).repartition("doc_id")


def detect_dual(docs: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Both views of every document, their comparison and fusion: the flagship query.

    The numbers lie together by document: the branches below share one shuffle of them.
    """
    numbers = both_views(prepared(docs), cfg)
    rows = aggregate.aggregated(numbers, cfg.sensitivity, ("doc_id", "mode"))
    plain = numbers.groupBy("doc_id").agg(*[F.avg(F.when(F.col("mode") == m, F.col(c))).alias(f"{m}_mean_{c}") for m in ("paragraph", "sentence") for c in ("raw_probability", "uncertainty")])
    names = ["segments", "overall_probability", "overall_confidence", "supported", "decision"]
    views = rows.groupBy("doc_id").agg(*[F.max(F.when(F.col("mode") == m, F.col(c))).alias(f"{m}_{c}") for m in ("paragraph", "sentence") for c in names])
    view = lambda m: numbers.where(F.col("mode") == m)
    pairs = compare.agreement(compare.matched(view("paragraph"), view("sentence")))
    found = views.join(plain, "doc_id").join(pairs, "doc_id", "left")
    joined = docs.select("doc_id").join(found, "doc_id", "left")
    blank = {f"{m}_{c}": F.coalesce(F.col(f"{m}_{c}"), F.lit(v)) for m in ("paragraph", "sentence") for c, v in zip(names, (0, 0.0, 0.0, False, "pass"), strict=True)}
    out = joined.withColumns(blank).withColumns({
        "probability_diff": F.coalesce(compare.rounded(F.abs(F.col("paragraph_mean_raw_probability") - F.col("sentence_mean_raw_probability"))), F.lit(0.0)),
        "consistency_score": F.coalesce(compare.rounded(F.col("agreed")), F.lit(1.0)), "divergent_count": F.coalesce("far", F.lit(0)),
    })
    return aggregate.fused_views(out, cfg.sensitivity).drop("agreed", "far", *[c for c in found.columns if "_mean_" in c])
