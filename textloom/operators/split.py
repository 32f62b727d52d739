"""Splitting texts into paragraphs, sentences and blocks.

Everything is an array expression over one row's text, so no split needs a
shuffle.  Offsets are UTF-8 bytes, 0-based, ends exclusive.  Input rows have
``doc_id`` and ``text``; other columns are kept by the array forms.  Null and
blank texts have no sentences and no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.functions.text import SPACE, SPACE_IN_LINE, let, trimmed

#: Marks of places to cut at; the first that a text lacks is used.  A text that holds all of them is cut at the last one, too.
_MARKS = ["\u0000", "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3", "\ufdd4"]
_QUOTES = "\"“”'‘’"
#: Items whose running sums are appended one by one; longer arrays are taken in parts of so many, so the work grows with their length only.
_PART = 128


def mark_for(text: Column) -> Column:
    """A character that ``text`` doesn't hold."""
    out = F.lit(_MARKS[-1])
    for mark in reversed(_MARKS[:-1]):
        out = F.when(~text.contains(mark), mark).otherwise(out)
    return out


def _pieces(text: Column, pattern: str) -> Column:
    """A text cut after each match of ``pattern``, which stays with the piece before it."""
    return let(mark_for(text), lambda mark: F.split(F.regexp_replace(text, F.lit(f"({pattern})"), F.concat(F.lit("$1"), mark)), mark))


def _parts(items: Column) -> Column:
    """An array's consecutive parts, _PART items each."""
    def cut(items: Column) -> Column:
        n = F.size(items)
        some = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _PART).cast("int")), lambda k: F.slice(items, k * _PART + 1, F.lit(_PART)))
        return F.when(n > 0, some).otherwise(F.filter(F.array(items), lambda x: F.size(x) > 0))

    return let(items, cut)


def _running(sizes: Column) -> Column:
    """Sums of an array's items before each place, and of all."""
    def grow(sums: Column, x: Column) -> Column:
        return F.array_append(sums, F.element_at(sums, -1) + x)

    def joined(parts: Column) -> Column:
        starts = F.aggregate(parts, F.array(F.lit(0)), lambda sums, p: grow(sums, F.element_at(p, -1)))
        moved = let(starts, lambda at: F.transform(parts, lambda p, k: F.transform(F.slice(p, F.lit(2), F.size(p) - 1), lambda x: x + F.get(at, k))))
        return F.concat(F.array(F.lit(0)), F.flatten(moved))

    return let(F.transform(_parts(sizes), lambda p: F.aggregate(p, F.array(F.lit(0)), grow)), joined)


def _located(pieces: Column, chars: bool = False) -> Column:
    """Raw pieces of a text, trimmed, with their spans in bytes (or ``chars``); blank ones dropped.

    ``start`` and ``end`` span the whole piece, ``left`` is where its text begins.
    """
    size = F.length if chars else F.octet_length

    def spans(pieces: Column, sums: Column) -> Column:
        return F.transform(
            pieces,
            lambda p, i: F.struct(
                F.get(sums, i).alias("start"), F.get(sums, i + 1).alias("end"),
                (F.get(sums, i) + size(p) - size(F.regexp_replace(p, f"\\A[{SPACE}]+", ""))).cast("int").alias("left"),
                trimmed(p).alias("text"),
            ),
        )

    found = let(pieces, lambda ps: let(_running(F.transform(ps, lambda p: size(p).cast("int"))), lambda sums: spans(ps, sums)))
    return F.filter(found, lambda s: F.length(s["text"]) > 0)


def sentence_pieces(text: Column) -> Column:
    """array<string>: a text cut into its sentences, white space and blank pieces kept; see ``sentence_array``."""
    parts = F.split(text, f"(?<=[{_QUOTES}])")
    # a full stop at the very end of a part has no digit after it: the next character of the text is a quotation mark
    stop = F.lit("((?:[。！？!?]|(?<![0-9])\\.|\\.(?![0-9]))[ \\t]*)")

    def cut(mark: Column) -> Column:
        with_mark = F.concat(F.lit("$1"), mark)
        return F.split(F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.regexp_replace(p, stop, with_mark)).otherwise(p)), ""), mark)

    return let(mark_for(text), cut)


def sentence_array(text: Column, chars: bool = False) -> Column:
    """array<struct<start,end,left,text>> of the sentences, spans in bytes (or ``chars``).

    A quotation mark of any kind toggles whether the scan is in a quotation, where
    nothing splits; a full stop between digits doesn't split; blanks and tabs after a
    stop belong to the sentence before.
    """
    return _located(sentence_pieces(text), chars)


def simple_sentences(text: Column) -> Column:
    """array<string>: split after ``。！？?!`` and white space."""
    return F.filter(F.transform(F.split(text, f"(?<=[。！？?!])[{SPACE}]+"), trimmed), lambda s: F.length(s) > 0)


def _texts_only(found: Column, chars: bool) -> Column:
    """``_located`` pieces as array<struct<start,end,text>> with the spans of the trimmed texts."""
    size = F.length if chars else F.octet_length
    return F.transform(found, lambda s: F.struct(s["left"].alias("start"), (s["left"] + size(s["text"])).cast("int").alias("end"), s["text"].alias("text")))


def paragraph_array(text: Column, chars: bool = False) -> Column:
    """array<struct<start,end,text>> of the paragraphs; the spans are those of the trimmed texts, in bytes (or ``chars``).  A text without any is one block."""
    found = _texts_only(_located(_pieces(text, f"\\n[{SPACE}]*\\n"), chars), chars)
    size = F.length(text) if chars else F.octet_length(text)
    whole = F.array(F.struct(F.lit(0).alias("start"), size.cast("int").alias("end"), text.alias("text")))
    return F.when(text.isNotNull(), let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(whole)))


def line_array(text: Column) -> Column:
    """As ``paragraph_array`` with every line that isn't blank as a paragraph (beyond the reference)."""
    return _texts_only(_located(_pieces(text, "\\n")), False)


def legacy_paragraph_array(text: Column) -> Column:
    """array<struct<start,end,text>> of the archived implementation's paragraphs, in characters.

    A paragraph begins with its first line that isn't blank and ends where the
    blank line after it begins, so it holds its last line's end.  A text without
    any is one block; an empty text has none.
    """
    blank = f"(?<=\\n)(?:[{SPACE_IN_LINE}]*(?:\\n|\\z))+"
    first = F.length(text) - F.length(F.regexp_replace(text, f"\\A(?:[{SPACE_IN_LINE}]*\\n)+", ""))
    rest = F.regexp_replace(text, f"\\A(?:[{SPACE_IN_LINE}]*\\n)+", "")

    def cut(mark: Column) -> Column:
        return F.split(F.regexp_replace(rest, F.lit(f"({blank})"), F.concat(mark, F.lit("$1"), mark)), mark)

    def spans(pieces: Column) -> Column:
        at = _running(F.transform(pieces, lambda p: F.length(p)))
        return let(at, lambda sums: F.transform(pieces, lambda p, i: F.struct((first + F.get(sums, i)).cast("int").alias("start"), (first + F.get(sums, i + 1)).cast("int").alias("end"), trimmed(p).alias("text"))))

    # the odd pieces are blank lines
    found = F.filter(let(let(mark_for(text), cut), spans), lambda s, i: (i % 2 == 0) & (F.length(s["text"]) > 0))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).cast("int").alias("end"), text.alias("text")))
    return F.when(F.length(text) > 0, let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(whole)))


def pack(sizes: Column, target: int, most: int, breaks: Column | None = None) -> Column:
    """Block numbers of items packed greedily in order.

    An item above ``most`` stands alone; others join the open block while it stays
    within ``target``.  ``breaks``: array<boolean>, whether a block has to end before an item.
    """
    none, nones = F.expr("cast(array() as array<int>)"), F.expr("cast(array() as array<array<int>>)")
    state = lambda b, c, o, ids: F.struct(b.alias("b"), c.alias("c"), o.alias("o"), ids.alias("ids"))
    if breaks is None:
        items = F.transform(sizes, lambda n: F.struct(n.alias("n"), F.lit(False).alias("cut")))
    else:
        items = F.zip_with(sizes, breaks, lambda n, c: F.struct(n.alias("n"), c.alias("cut")))

    def step(s: Column, x: Column) -> Column:
        alone = x["n"] > most
        joins = s["o"] & ~alone & ~x["cut"] & ((s["c"] + x["n"] <= target) | (s["c"] == 0))
        b = F.when(joins, s["b"]).otherwise(s["b"] + 1)
        c = F.when(alone, F.lit(0)).when(joins, s["c"] + x["n"]).otherwise(x["n"])
        return state(b, c, ~alone, F.array_append(s["ids"], b))

    def part(s: Column, items: Column) -> Column:
        done = F.aggregate(items, state(s["b"], s["c"], s["o"], none), step)
        return let(done, lambda d: state(d["b"], d["c"], d["o"], F.array_append(s["ids"], d["ids"])))

    return F.aggregate(_parts(items), state(F.lit(-1), F.lit(0), F.lit(False), nones), part, lambda s: F.flatten(s["ids"]))


def grouped(ids: Column) -> Column:
    """array<struct<first,count>> of the runs of equal block numbers; ``first`` is 1-based."""
    def runs(ids: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(1), F.size(ids)), lambda i: (i == 1) | (F.element_at(ids, i) != F.element_at(ids, F.greatest(i - 1, F.lit(1)))))
        found = let(firsts, lambda f: F.transform(f, lambda x, k: F.struct(x.alias("first"), (F.coalesce(F.get(f, k + 1), F.size(ids) + 1) - x).alias("count"))))
        return F.when(F.size(ids) > 0, found).otherwise(F.expr("cast(array() as array<struct<first:int,count:int>>)"))

    return let(ids, runs)


def packed_array(items: Column, target: int, most: int, between: str, count: str) -> Column:
    """array<struct<start,end,text,``count``>> of packed pieces of text, their texts joined by ``between``."""
    def blocks(items: Column) -> Column:
        def block(r: Column) -> Column:
            part = F.slice(items, r["first"], r["count"])
            return F.struct(
                F.element_at(items, r["first"])["start"].alias("start"), F.element_at(items, r["first"] + r["count"] - 1)["end"].alias("end"),
                F.array_join(F.transform(part, lambda s: s["text"]), between).alias("text"), r["count"].alias(count),
            )

        return F.transform(grouped(pack(F.transform(items, lambda s: F.length(s["text"])), target, most)), block)

    return let(items, blocks)


def sentence_block_array(sentences: Column, target: int = 200, most: int = 300) -> Column:
    """array<struct<start,end,text,sentence_count>> of packed sentences."""
    return packed_array(sentences, target, most, " ", "sentence_count")


def span_block_array(text: Column, spans: Column, target: int = 200, most: int = 300) -> Column:
    """array<struct<start,end,text,sentence_count>> of packed spans (``start, end`` in bytes, ``cut``: whether a block ends before).

    Sizes and texts are slices of the original text, white space kept; empty spans count nothing.
    """
    def blocks(raw: Column, spans: Column) -> Column:
        inside = lambda a, b: F.decode(F.substring(raw, a + 1, F.greatest(F.lit(0), b - a)), "UTF-8")

        def block(spans: Column, r: Column) -> Column:
            a, b = F.element_at(spans, r["first"])["start"], F.element_at(spans, r["first"] + r["count"] - 1)["end"]
            return F.struct(a.alias("start"), b.alias("end"), inside(a, b).alias("text"), r["count"].alias("sentence_count"))

        sized = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["cut"].alias("cut"), F.length(inside(s["start"], s["end"])).alias("n")))
        some = F.filter(sized, lambda s: s["n"] > 0)
        return let(some, lambda x: F.transform(grouped(pack(F.transform(x, lambda s: s["n"]), target, most, F.transform(x, lambda s: s["cut"]))), lambda r: block(x, r)))

    return let(F.encode(text, "UTF-8"), lambda raw: let(spans, lambda s: blocks(raw, s)))


def exploded(docs: DataFrame, items: Column, index: str = "block_index") -> DataFrame:
    """One row an item: ``doc_id``, ``index`` from 0, and the item's fields."""
    return docs.select("doc_id", F.posexplode(items).alias(index, "item")).select("doc_id", index, "item.*")


def sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, sent_index, start, end, text``."""
    return exploded(docs, sentence_array(F.col("text")), "sent_index").drop("left")


def paragraph_blocks(docs: DataFrame, lines: bool = False) -> DataFrame:
    """``doc_id, block_index, start, end, text, label, need_detect, merge_with_prev``."""
    items = (line_array if lines else paragraph_array)(F.col("text"))
    return exploded(docs, items).withColumns({"label": F.lit("body"), "need_detect": F.lit(True), "merge_with_prev": F.lit(False)})


def sentence_blocks(docs: DataFrame, target: int = 200, most: int = 300) -> DataFrame:
    """``doc_id, block_index, start, end, text, sentence_count``."""
    with_sentences = docs.select("doc_id", sentence_array(F.col("text")).alias("s"))
    return exploded(with_sentences, sentence_block_array(F.col("s"), target, most))


def paragraph_packs(docs: DataFrame, target: int = 500, most: int = 1000) -> DataFrame:
    """``doc_id, block_index, start, end, text, paragraph_count``: paragraphs packed as the segmentation service does."""
    with_paragraphs = docs.select("doc_id", paragraph_array(F.col("text")).alias("p"))
    return exploded(with_paragraphs, packed_array(F.col("p"), target, most, "\n\n", "paragraph_count"))


def legacy_paragraph_blocks(docs: DataFrame) -> DataFrame:
    """``doc_id, block_index, start, end, text``, offsets in characters."""
    return exploded(docs, legacy_paragraph_array(F.col("text")))


def paragraph_sentences(text: Column, paragraphs: Column) -> Column:
    """array<struct<start,end,cut>>: sentences of each of ``paragraphs`` (spans in bytes, with their texts); none crosses a paragraph.

    ``cut`` marks the first sentence of a paragraph whose gap to the one before holds text.
    """
    def of(raw: Column, paragraphs: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(paragraphs, F.greatest(i - 1, F.lit(0)))["end"])
            between = F.decode(F.substring(raw, before + 1, F.greatest(F.lit(0), p["start"] - before)), "UTF-8")
            broken = F.coalesce(between.rlike(f"[^{SPACE}]"), F.lit(False))
            found = sentence_array(p["text"])
            return F.transform(found, lambda s, k: F.struct((s["start"] + p["start"]).alias("start"), (s["end"] + p["start"]).alias("end"), ((k == 0) & broken).alias("cut")))

        return F.flatten(F.transform(paragraphs, one))

    return let(F.encode(text, "UTF-8"), lambda raw: let(paragraphs, lambda ps: of(raw, ps)))


def sentence_blocks_in(kept: DataFrame, target: int = 200, most: int = 300) -> DataFrame:
    """Sentence blocks within kept paragraphs (``doc_id, text`` of the document, ``paragraphs`` array of kept spans with their texts).

    Sentences never cross a paragraph; a block never crosses a gap that holds text.
    """
    spans = kept.select("doc_id", "text", paragraph_sentences(F.col("text"), F.col("paragraphs")).alias("s"))
    return exploded(spans, span_block_array(F.col("text"), F.col("s"), target, most))


def sentence_blocks_smart(docs: DataFrame, spans: str | None = None, merges: str | None = None, target: int = 200, most: int = 300) -> DataFrame:
    """Sentence blocks by the best splitter at hand.

    ``spans``: a column of spans from a segmentation service (array<struct<start,end>>, bytes); where it is
    null or empty the rules here split.  ``merges``: a column of sentence numbers that a judge wants joined
    with the next one.  Texts without any sentence have no block.
    """
    local = F.transform(sentence_array(F.col("text")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    found = local if spans is None else F.when(F.size(spans) > 0, F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))).otherwise(local)
    if merges is not None:
        found = merge_spans(found, F.coalesce(F.col(merges), F.expr("cast(array() as array<int>)")))
    rows = docs.select("doc_id", "text", F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(False).alias("cut"))).alias("s"))
    return exploded(rows, span_block_array(F.col("text"), F.col("s"), target, most))


def merge_spans(spans: Column, marked: Column) -> Column:
    """Spans merged with their next one wherever their 0-based place is in ``marked``, chaining."""
    def merged(spans: Column) -> Column:
        opens = F.transform(spans, lambda s, i: F.when((i > 0) & F.array_contains(marked, i - 1), 0).otherwise(1))
        ids = F.slice(_running(opens), F.lit(2), F.size(spans))
        return F.transform(grouped(ids), lambda r: F.struct(F.element_at(spans, r["first"])["start"].alias("start"), F.element_at(spans, r["first"] + r["count"] - 1)["end"].alias("end")))

    return let(spans, merged)


def detectable(blocks: DataFrame) -> DataFrame:
    """The blocks of each document that are to be scored (``need_detect``); all of them where none is."""
    any_ = F.max(F.coalesce("need_detect", F.lit(False))).over(W.partitionBy("doc_id"))
    return blocks.withColumn("_any", any_).where(F.coalesce("need_detect", F.lit(False)) | ~F.col("_any")).drop("_any")
