"""Cutting block sequences to budgets, merging them, and sampling blocks for a document's profile.

Offsets here are characters where a function is one of the archived
implementation (``token_chunks``, ``split_long``, ``node_blocks``), else bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.functions.text import SPACE, TOKEN, let, shortened, token_estimate, trimmed
from textloom.operators.split import exploded, legacy_paragraph_array

SPANS = "array<struct<start:int,end:int>>"
#: Chunk sizes in tokens by sensitivity (fixed values).
CHUNK_TOKENS = {"low": 800, "medium": 550, "high": 360}
_TOKEN = re.compile(TOKEN)
_AFTER_STOP = re.compile("(?<=[。！？?!])\\s+")


def chunk_budget(chunk_tokens: int | None = None, sensitivity: str = "medium") -> int:
    """Tokens a chunk may have: at least 120, at most 600 (900 at low sensitivity); high sensitivity lowers it to its own size."""
    own = CHUNK_TOKENS.get(sensitivity, CHUNK_TOKENS["medium"])
    size = max(120, chunk_tokens or own)
    return min(min(size, own) if sensitivity == "high" else size, 900 if sensitivity == "low" else 600)


def profile_sample(docs: DataFrame, blocks: DataFrame, budget: int = 6000, fallback: int = 4000) -> DataFrame:
    """``doc_id, sample``: the whole text within the budget; else its first three, last two and some middle blocks, as many as fit; else its first characters."""
    part = W.partitionBy("doc_id")
    n, i, step = F.col("n"), F.col("block_index"), F.greatest(F.floor((F.col("n") - 5) / 4), F.lit(1))
    middle = (n > 6) & (i >= 3) & (i < n - 2) & ((i - 3) % step == 0)
    chosen = blocks.withColumn("n", F.count("*").over(part)).where((i < 3) | (i >= n - 2) | middle).withColumn("k", token_estimate(F.col("text")))
    fits = chosen.withColumn("upto", F.sum("k").over(part.orderBy("block_index"))).where(F.col("upto") <= budget)
    joined = fits.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda x: x["text"]), "\n\n").alias("joined"))
    rows = docs.where("text is not null").select("doc_id", "text").join(joined, "doc_id", "left")
    return rows.select("doc_id", F.when(token_estimate(F.col("text")) <= budget, F.col("text")).otherwise(F.coalesce("joined", shortened(F.col("text"), fallback))).alias("sample"))


def short_title(text: Column) -> Column:
    """Whether a block may be a title: under 20 characters other than white space, and no stop anywhere; a blank one is."""
    n = F.length(F.regexp_replace(text, f"[{SPACE}]+", ""))
    return (n == 0) | ((n < 20) & ~text.rlike("[。.！!？?]"))


def merge_titles(docs: DataFrame, blocks: Column) -> DataFrame:
    """``doc_id, block_index, start, end, text``: a document's ``blocks`` with runs of short titles joined to the block after them, or at the end to the one before.

    The text is the slice of the document.  A single block, and blocks that are all titles, stay as they are.
    """
    def merged(raw: Column, blocks: Column) -> Column:
        titles = F.transform(blocks, lambda b: short_title(b["text"]))
        n = F.size(blocks)

        def joined(titles: Column) -> Column:
            # a block opens where the one before is no title; titles at the end go with the last block
            last = F.array_max(F.transform(titles, lambda t, i: F.when(~t, i + 1).otherwise(0)))
            opens = F.filter(F.sequence(F.lit(1), n), lambda i: (i <= last) & ((i == 1) | ~F.element_at(titles, F.greatest(i - 1, F.lit(1)))))
            spans = let(opens, lambda o: F.transform(o, lambda i, k: F.struct(i.alias("first"), F.coalesce(F.get(o, k + 1) - 1, n).alias("last"))))

            def block(r: Column) -> Column:
                a, b = F.element_at(blocks, r["first"])["start"], F.element_at(blocks, r["last"])["end"]
                return F.struct(a.alias("start"), b.alias("end"), F.decode(F.substring(raw, a + 1, b - a), "UTF-8").alias("text"))

            return F.when((n > 1) & (last > 0), F.transform(spans, block)).otherwise(blocks)

        return let(titles, joined)

    found = let(F.encode("text", "UTF-8"), lambda raw: let(blocks, lambda b: merged(raw, b)))
    return exploded(docs, F.when(F.size(blocks) > 0, found))


def _spans(rows: list[list[tuple[int, int]] | None]) -> pd.Series:
    return pd.Series([None if r is None else [{"start": a, "end": b} for a, b in r] for r in rows], dtype=object)


def chunk_spans(text: str, blocks: list[tuple[int, int]], chunk_tokens: int) -> list[tuple[int, int]]:
    """Spans of consecutive chunks over ``blocks`` (spans in characters).

    A block that fills the chunk up is cut in proportion to its characters, and what
    is left of it counted anew; the work grows with the text's length only.
    """
    ends = [m.end() for m in _TOKEN.finditer(text)]
    starts = [m.start() for m in _TOKEN.finditer(text)]

    def size(a: int, b: int) -> int:
        """Tokens of a slice, 1 at least; one that is cut counts in both slices."""
        return max(1, bisect_right(starts, b - 1) - bisect_right(ends, a)) if b > a else 1

    out: list[tuple[int, int]] = []
    held, begin, end = 0, None, None
    for first, last in blocks:
        at, tokens = first, size(first, last)
        begin = first if begin is None else begin
        while held + tokens >= chunk_tokens and at < last:
            rate = max(1.0, (last - at) / tokens)
            end = at + max(1, min(last - at, round(rate * max(1, chunk_tokens - held))))
            out.append((begin, end))
            begin = at = end
            tokens, held = size(at, last), 0
        end = last
        held += tokens
    if begin is not None and end > begin:
        out.append((begin, end))
    return out or [(0, len(text))]


def token_chunks(docs: DataFrame, chunk_tokens: int = 600, blocks: Column | None = None) -> DataFrame:
    """``doc_id, chunk_id, start, end, text``: chunks of about ``chunk_tokens`` tokens over each document's blocks, slices of its text.

    ``blocks``: array of spans in characters, by default the archived
    implementation's paragraphs.  Where a cut falls depends on all before it, so
    Python walks over one document at a time; nothing is shuffled.  A null text has no chunks.
    """
    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, text, spans in frame.itertuples(index=False):
                if text is not None:
                    found = chunk_spans(text, [(s["start"], s["end"]) for s in (spans if spans is not None else [])], chunk_tokens)
                    out += [(doc, i, a, b, text[a:b]) for i, (a, b) in enumerate(found)]
            yield pd.DataFrame(out, columns=["doc_id", "chunk_id", "start", "end", "text"])

    own = legacy_paragraph_array(F.col("text")) if blocks is None else blocks
    rows = docs.select("doc_id", "text", F.transform(own, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))).alias("b"))
    return rows.mapInPandas(walk, "doc_id bigint, chunk_id int, start int, end int, text string")


def _sliced(rows: DataFrame, index: str, offset: Column | None = None) -> DataFrame:
    """One row a span of ``s`` (in characters) with its slice of ``text``; ``offset`` is added to the spans put out."""
    found = rows.select("*", F.posexplode("s").alias(index, "x"))
    shift = F.lit(0) if offset is None else offset
    text = F.substring("text", F.col("x.start") + 1, F.col("x.end") - F.col("x.start"))
    return found.select("doc_id", index, *[c for c in ("chunk_id",) if index != c and c in rows.columns], (F.col("x.start") + shift).alias("start"), (F.col("x.end") + shift).alias("end"), text.alias("text"))


def long_spans(text: str, target: int, most: int) -> list[tuple[int, int]]:
    """Spans of a long segment's parts, cut between its sentences."""
    pieces, at = [], 0
    for s in (x.strip() for x in _AFTER_STOP.split(text)):
        if s:
            begin = text.index(s, at)
            at = begin + len(s)
            pieces.append((begin, at, max(1, len(_TOKEN.findall(s)))))
    out, begin, end, held = [], 0, 0, 0
    for a, b, n in pieces or [(0, len(text), max(1, len(_TOKEN.findall(text))))]:
        if ((held >= target and held + n > int(target * 1.1)) or held + n > most) and end > begin:
            out.append((begin, end))
            begin, held = a, 0
        held, end = held + n, b
    return [*out, (begin, end)] if end > begin else out


def split_long(segments: DataFrame, target: int = 600) -> DataFrame:
    """``doc_id, chunk_id, part, start, end, text``: segments above the hard limit (in tokens) cut between sentences into parts near the target.

    ``segments``: ``doc_id, chunk_id, start, text``, offsets in characters.  Only texts above the limit reach Python.
    """
    goal = max(180, target)
    most = int(goal * 1.5)

    def walk(texts: pd.Series) -> pd.Series:
        return _spans([None if t is None else long_spans(t, goal, most) for t in texts])

    cut = F.pandas_udf(walk, SPANS).asNondeterministic()

    long = token_estimate(F.col("text")) > most
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))
    rows = segments.select("doc_id", "chunk_id", F.col("start").alias("_at"), "text").withColumn("_cut", cut(F.when(long, F.col("text"))))
    return _sliced(rows.withColumn("s", F.coalesce("_cut", F.when(F.length("text") > 0, whole))), "part", F.col("_at"))


def node_blocks(nodes: DataFrame, least: int = 200, align: bool = True, headings: bool = False, attach: bool = False) -> DataFrame:
    """``doc_id, block_index, label, need_detect, merged, start, end, text`` from structured nodes (offsets in characters).

    Headings are left out, or put in as blocks that aren't scored (``headings``), or
    joined to the node after them (``attach``).  With ``align`` a node joins the block
    before it while both together stay under ``least`` characters.
    """
    item = F.struct("node_index", F.col("kind").alias("label"), "start", "end", "text")
    rows = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("nodes"))
    kind = "struct<label:string,need_detect:boolean,merged:boolean,start:int,end:int,text:string>"
    blank = F.expr(f"named_struct('done', cast(array() as array<{kind}>), 'body', cast(null as {kind}), 'head', cast(null as struct<start:int,text:string>))")
    named = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])

    def step(s: Column, x: Column) -> Column:
        heading = x["label"] == "heading"
        flush = F.when(s["body"].isNotNull(), F.array_append(s["done"], s["body"])).otherwise(s["done"])
        head = named(label=F.lit("heading"), need_detect=F.lit(False), merged=F.lit(False), start=x["start"], end=x["end"], text=x["text"])
        own_head = named(start=x["start"], text=x["text"]) if attach else F.expr("cast(null as struct<start:int,text:string>)")
        start = F.coalesce(F.least(x["start"], s["head"]["start"]), x["start"])
        text = F.when(s["head"].isNotNull(), F.concat_ws("\n", s["head"]["text"], F.when(F.length(x["text"]) > 0, x["text"]))).otherwise(x["text"])
        label = F.when(x["label"] == "paragraph", "body").otherwise(x["label"])
        block = named(label=label, need_detect=F.lit(True), merged=F.lit(False), start=start, end=x["end"], text=text)
        joins = F.coalesce(F.lit(align) & ((x["end"] - s["body"]["start"]) < least), F.lit(False))
        grown = named(label=s["body"]["label"], need_detect=F.lit(True), merged=F.lit(True), start=s["body"]["start"], end=x["end"], text=trimmed(F.concat(s["body"]["text"], F.lit("\n"), text)))
        none = F.expr("cast(null as struct<start:int,text:string>)")
        on_heading = named(done=F.array_append(s["done"], head) if headings else s["done"], body=s["body"], head=own_head)
        on_body = named(done=F.when(joins, s["done"]).otherwise(flush), body=F.when(joins, grown).otherwise(block), head=none)
        return F.when(heading, on_heading).otherwise(on_body)

    end = lambda s: F.when(s["body"].isNotNull(), F.array_append(s["done"], s["body"])).otherwise(s["done"])
    found = F.aggregate("nodes", blank, step, end)
    # headings stand where they begin, so an open block never moves behind one
    ordered = F.array_sort(found, lambda a, b: (a["start"] - b["start"]).cast("int"))
    whole = F.array(named(label=F.lit("body"), need_detect=F.lit(True), merged=F.lit(False), start=F.lit(0), end=F.length(F.array_join(F.transform("nodes", lambda n: n["text"]), "")), text=F.array_join(F.transform("nodes", lambda n: n["text"]), "")))
    return exploded(rows, let(ordered, lambda x: F.when(F.size(x) > 0, x).otherwise(whole)))


def planned_merge(docs: DataFrame, blocks: Column, plan: Column) -> DataFrame:
    """``doc_id, chunk_id, start, end, text``: ``blocks`` (spans in characters, of a document's body) merged as an outside plan says.

    ``plan``: array<struct<paragraph_start,paragraph_end>>.  A plan that doesn't cover
    every block once and in order is rejected, and so is one for a single block; such documents have no row.
    """
    def spans(blocks: Column, plan: Column) -> Column:
        n = F.size(blocks)
        ok = F.forall(F.sequence(F.lit(0), F.size(plan) - 1), lambda i: (
            F.coalesce(F.get(plan, i)["paragraph_start"] == F.when(i == 0, 0).otherwise(F.get(plan, F.greatest(i - 1, F.lit(0)))["paragraph_end"] + 1), F.lit(False))
            & F.coalesce((F.get(plan, i)["paragraph_end"] >= F.get(plan, i)["paragraph_start"]) & (F.get(plan, i)["paragraph_end"] < n), F.lit(False))
        ))
        all_ = F.get(plan, F.size(plan) - 1)["paragraph_end"] == n - 1
        merged = F.transform(plan, lambda p: F.struct(F.get(blocks, p["paragraph_start"])["start"].alias("start"), F.get(blocks, p["paragraph_end"])["end"].alias("end")))
        return F.when((n > 1) & (F.size(plan) > 0), F.when(ok & all_, merged))

    return _sliced(docs.select("doc_id", "text", let(blocks, lambda b: let(plan, lambda p: spans(b, p))).alias("s")), "chunk_id")


def resplit_flat(first: DataFrame, second: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """The scored segments of each document: those of ``first``, or of ``second`` (cut at half the size) where the first are few or flat and the second spread more.

    Both need ``doc_id, chunk_id, raw_probability`` and the same columns.  At high sensitivity the first ones stay.
    """
    if sensitivity == "high":
        return first
    sums = lambda rows, n, sd: rows.groupBy("doc_id").agg(F.count("*").alias(n), F.stddev_pop("raw_probability").alias(sd))
    choice = sums(first, "n0", "sd0").join(sums(second, "n1", "sd1"), "doc_id")
    flat = (F.col("n0") < 6) | (F.col("sd0") < 0.06)
    better = F.col("sd1") >= F.greatest(F.col("sd0") * 1.2, F.lit(0.06))
    switched = choice.where(flat & better).select("doc_id")
    return first.join(switched, "doc_id", "left_anti").unionByName(second.join(switched, "doc_id", "left_semi"))
