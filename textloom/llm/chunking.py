"""Cutting oversized blocks at natural boundaries (problem 5).

Method: recursive bisection.  A span longer than the limit minus the overlap is
cut at the strongest boundary near its middle, and both halves are treated the
same way; at the end every piece but the first takes the overlap in front.

Sizes are counted in tokens: runs of ``A-Z a-z 0-9 _`` and single characters
U+4E00-U+9FFF.  Only rows above their limit reach Python.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from textloom.checkpoints import cut as checkpoint

TOKEN = "[A-Za-z0-9_]+|[一-鿿]"
DEFAULT_LIMIT = 1500
#: Oversized blocks, of twenty bytes each, up to which they are broadcast.
FEW = 1_000_000
_TOKEN = re.compile(TOKEN)
#: Boundaries from strongest to weakest; a cut comes after the match.
_BOUNDARIES = [
    (5, re.compile(r"\r?\n[ \t\r]*\n\s*")),
    (4, re.compile(r"\r?\n[ \t]*")),
    (3, re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？।؟]+[”’」』）]*\s*")),
    (2, re.compile(r"[,;:]\s+|[，；：、،]\s*")),
    (1, re.compile(r"\s+")),
]


def size_of(text: Column) -> Column:
    """Size of a text in tokens; null for a null text."""
    return F.regexp_count(text, F.lit(TOKEN))


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces of ``text`` as (start, end, tokens), in characters.

    No piece has more than ``limit`` tokens; neighbours share ``overlap`` tokens,
    or half the limit where the overlap reaches the limit.  A text within the
    limit is one piece, an empty one none.
    """
    if not text:
        return []
    spans = [m.span() for m in _TOKEN.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [(0, len(text), n)]
    if overlap >= limit:
        overlap = limit // 2
    core = limit - overlap
    place, strength = _gaps(text, spans)
    ends, todo = [], [(0, n)]
    while todo:
        low, high = todo.pop()
        if high - low <= core:
            ends.append(high)
            continue
        at = _middle(strength, low, high)
        todo += [(at, high), (low, at)]
    out, first = [], 0
    for last in ends:
        begin = max(0, first - overlap) if first else 0
        start = 0 if begin == 0 else place[begin] if begin == first else spans[begin][0]
        out.append((start, len(text) if last == n else place[last], last - begin))
        first = last
    return out


def _gaps(text: str, spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """For each gap before token k: where to cut, and how strong a boundary it holds."""
    n = len(spans)
    place = [s for s, _ in spans]
    strength = [0] * n
    stops = [e for _, e in spans]
    for level, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            k = bisect_right(stops, m.start())
            if 0 < k < n and m.end() <= spans[k][0] and level > strength[k]:
                strength[k], place[k] = level, m.end()
    return place, strength


def _middle(strength: list[int], low: int, high: int) -> int:
    """The gap to cut at: the strongest in the middle half, the one nearest to the middle among equals."""
    mid, reach = (low + high) // 2, (high - low) // 4
    begin, end = max(low + 1, mid - reach), min(high - 1, mid + reach)
    return max(range(begin, end + 1), key=lambda k: (strength[k], -abs(k - mid), -k))


def limits(requests: DataFrame) -> DataFrame:
    """``request_id, size_limit, overlap`` once a request.

    A limit that is null or below 1 is 1500; an overlap that is null or negative is 0.
    Of several rows of a request the earliest holds, then the smallest values.
    """
    size, overlap = F.col("chunking.chunk_size_tokens"), F.col("chunking.overlap_tokens")
    chosen = F.min(F.struct("received_at", F.when(size >= 1, size).otherwise(DEFAULT_LIMIT).alias("size_limit"), F.when(overlap >= 0, overlap).otherwise(0).alias("overlap")))
    return requests.groupBy("request_id").agg(chosen.alias("c")).select("request_id", "c.size_limit", "c.overlap")


def oversized(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """``block_id, size_limit, overlap`` of the blocks above their request's limit, once each.

    Only sizes are shuffled, never texts.  Blocks of unknown requests take the default limit.
    """
    sizes = blocks.select("block_id", "request_id", size_of(F.col("text")).alias("size")).where("size > 1")
    joined = sizes.join(limits(requests), "request_id", "left")
    limit = F.coalesce("size_limit", F.lit(DEFAULT_LIMIT))
    return (
        joined.where(F.col("size") > limit)
        .groupBy("block_id")
        .agg(F.min(limit).alias("size_limit"), F.min(F.coalesce("overlap", F.lit(0))).alias("overlap"))
    )


def split_blocks(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """Pieces of every oversized block: ``block_id, piece, start, end_offset, tokens, text``.

    Offsets are UTF-8 bytes within the block's text.  Exact duplicate blocks give
    their pieces once; null and blank texts are never oversized.
    """
    # found first and counted: few enough are sent to where the texts are, which then aren't shuffled
    over = checkpoint(oversized(blocks, requests))
    over = F.broadcast(over) if over.count() <= FEW else over
    texts = blocks.select("block_id", "text").join(over, "block_id").dropDuplicates(["block_id"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, text, limit, overlap in frame.itertuples(index=False):
                at = [0, 0]
                for piece, (start, end, tokens) in enumerate(cut(text, limit, overlap)):
                    at = [at[0] + len(text[at[1] : start].encode()) if start >= at[1] else len(text[:start].encode()), start]
                    inside = text[start:end]
                    rows.append((key, piece, at[0], at[0] + len(inside.encode()), tokens, inside))
            yield pd.DataFrame(rows, columns=["block_id", "piece", "start", "end_offset", "tokens", "text"])

    return texts.select("block_id", "text", "size_limit", "overlap").mapInPandas(
        run, "block_id bigint, piece int, start int, end_offset int, tokens int, text string"
    )
