"""One form for texts that look the same (problem 3).

Method: look-alike characters are mapped in SQL, texts are grouped by the mapped
value under an accent-sensitive Unicode collation, the smallest id of each class
is its canonical member and is joined back to all members.

Comparing whole texts under a collation is dear, so only texts that can have a
partner get there: those whose *outline* (the mapped text without marks, hashed)
occurs with another spelling.  The outline is coarser than the collation, so no
pair is lost.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.checkpoints import cut

#: Letters of other scripts that are drawn like Latin ones (fixed values).
LOOKALIKE = {
    "аАеЕоОрРсСхХуіІјЈѕЅһԁԛԝВНКМТԌ": "aAeEoOpPcCxXyiIjJsShdqwBHKMTG",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναρ": "ABEZHIKMNOPTYXovap",
    "ёЁїЇ": "ëËïÏ",
    "օոսհցզյՏՕԼՍ": "onuhgqjSOLU",
}
#: Characters that do not show (fixed values).
HIDDEN = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
QUOTES = {"“”„‟«»″": '"', "‘’‚‛′‹›": "'"}
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
COLLATION = "UNICODE"
#: Members of a class that one task pairs with all others.
PART = 500


@lru_cache(1)
def _single() -> tuple[str, str]:
    """The mapping of single characters: width forms, spaces, look-alikes, then the hidden ones, which map to nothing."""
    mapped = {c: v for k, vs in LOOKALIKE.items() for c, v in zip(k, vs, strict=True)}
    fonts = (c for c in range(0x2100, 0x1EF00) if unicodedata.decomposition(chr(c)).startswith("<font>"))  # letters in another style
    for code in [*range(0xFF01, 0xFFEF), *range(0x2000, 0x200B), 0xA0, 0x202F, 0x205F, 0x3000, *fonts]:
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and plain != chr(code):
            mapped[chr(code)] = mapped.get(plain, plain)
    hidden = HIDDEN + "".join(map(chr, range(0xFE00, 0xFE10)))
    return "".join(mapped) + hidden, "".join(mapped.values())


@lru_cache(1)
def _several() -> list[tuple[str, str]]:
    """Single characters that look like several: the ligatures, and the three dots."""
    return [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in [*range(0xFB00, 0xFB07), 0x2026]]


@lru_cache(1)
def _bare() -> tuple[str, str]:
    """Every character with a canonical decomposition, and the first character of it; then what follows a first one in decomposed Hangul, which maps to nothing."""
    pairs = {c: d[0] for c in map(chr, [*range(0xC0, 0xD800), *range(0xF900, 0x30000)]) if (d := unicodedata.normalize("NFD", c)) != c}
    following = "".join(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    return "".join(pairs) + following, "".join(pairs.values())


def visible(text: Column, punctuation: bool = False) -> Column:
    """``text`` with look-alikes mapped; with ``punctuation`` quotation marks and dashes as well.

    Line ends become ``\\n``; blanks at the ends of lines and of the text go.
    Null stays null.
    """
    out = F.translate(text, *_single())
    out = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), _several(), out)
    if punctuation:
        out = folded(out)
    out = F.regexp_replace(out, r"[ \t]*(?:\r\n?|\n)", "\n")
    return F.regexp_replace(out, r"\A\s+|\s+\z", "")


def folded(text: Column) -> Column:
    """``text`` with typographic quotation marks and dashes made plain."""
    return F.translate(text, "".join(QUOTES) + DASHES, "".join(v * len(k) for k, v in QUOTES.items()) + "-" * len(DASHES))


def outline(text: Column) -> Column:
    """A hash that is equal for all texts which may look the same.

    Canonically equal texts have the same first characters of their decompositions
    once all marks are gone, so it is coarser than the collation.
    """
    bare = F.translate(folded(visible(text)), *_bare())
    return F.xxhash64(F.regexp_replace(bare, r"[\p{M}\p{Cntrl}\p{Cf}\s]+", ""))


def spelled(text: Column) -> Column:
    """What stands for a text's exact characters: two hashes, 128 bits together."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def hashed(requests: DataFrame) -> DataFrame:
    """``request_id, fold, spelling, outline`` of the non-blank texts, once a request.

    ``fold`` is false only where ``normalize_punctuation`` is false; of several rows
    of a request a false one holds.
    """
    fold = F.coalesce(F.col("preprocess_options.normalize_punctuation"), F.lit(True))
    rows = requests.where(F.col("text").rlike(r"\S") & F.col("request_id").isNotNull())
    return (
        rows.select("request_id", fold.alias("fold"), spelled(F.col("text")).alias("spelling"), outline(F.col("text")).alias("outline"))
        .groupBy("request_id")
        .agg(F.min("fold").alias("fold"), F.min(F.struct("spelling", "outline")).alias("s"))
        .select("request_id", "fold", "s.*")
    )


def candidates(requests: DataFrame) -> DataFrame:
    """Rows of ``hashed`` whose outline has several spellings."""
    rows = cut(hashed(requests))  # a few numbers a request, asked for again and again below
    several = rows.groupBy("outline").agg(F.min("spelling").alias("low"), F.max("spelling").alias("high")).where("low <> high").select("outline")
    return rows.join(several, "outline", "left_semi")


def canonical(requests: DataFrame) -> DataFrame:
    """Members of the look-alike classes: ``request_id, spelling, fold, strict_id, loose_id``.

    ``strict_id`` is the smallest request id among texts that look the same with
    their punctuation as it is, ``loose_id`` among those that do once quotation
    marks and dashes are plain.  Texts without any possible partner have no row.
    """
    member = cut(candidates(requests))
    texts = (
        requests.where(F.col("request_id").isNotNull()).select("request_id", "text")
        .join(member, "request_id")
        .where(spelled(F.col("text")) == F.col("spelling"))
        .groupBy("spelling")
        .agg(F.min("text").alias("text"))
    )
    keyed = texts.select(
        "spelling",
        F.collate(visible(F.col("text")), COLLATION).alias("strict"),
        F.collate(visible(F.col("text"), punctuation=True), COLLATION).alias("loose"),
    )
    first = member.groupBy("spelling").agg(F.min("request_id").alias("first"))
    classes = keyed.join(first, "spelling").select(
        "spelling",
        F.min("first").over(W.partitionBy("strict")).alias("strict_id"),
        F.min("first").over(W.partitionBy("loose")).alias("loose_id"),
    )
    return member.join(classes, "spelling").select("request_id", "spelling", "fold", "strict_id", "loose_id")


def pairs(requests: DataFrame) -> DataFrame:
    """``request_id_a, request_id_b``: requests whose texts look the same but differ, the smaller id first.

    Copies of one text make no pair with each other.  ``canonical`` holds the same
    links with one row a request, for uses that need no pairs.
    """
    rows = canonical(requests)
    # a large class is cut into parts on one side, so that no task holds all of its pairs
    sizes = rows.groupBy("loose_id").agg(F.min("spelling").alias("low"), F.max("spelling").alias("high"), F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("low <> high")
    rows = rows.join(sizes.select("loose_id", "parts"), "loose_id")
    a = rows.withColumn("part", F.pmod(F.xxhash64("request_id"), "parts").cast("int")).alias("a")
    b = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    same = (F.col("a.strict_id") == F.col("b.strict_id")) | (F.col("a.fold") & F.col("b.fold"))
    found = a.join(b, (F.col("a.loose_id") == F.col("b.loose_id")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.request_id") < F.col("b.request_id")) & (F.col("a.spelling") != F.col("b.spelling")) & same)
    return found.select(F.col("a.request_id").alias("request_id_a"), F.col("b.request_id").alias("request_id_b"))
