"""Stylometric features of a text, as expressions over its token array.

Counting needs no shuffle: equal tokens are neighbours in the sorted array, and
the lengths of the runs are their counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.text import legacy_tokens, let, tokens, trimmed
from textloom.operators.split import sentence_pieces, simple_sentences

#: Function words that count for the ratio, and those of the archived implementation (fixed values; a word of two characters never equals a token).
FUNCTION_WORDS = ["的", "之", "一", "是", "了", "在", "有", "和", "与", "这", "对", "也", "为", "而", "并且"]
LEGACY_FUNCTION_WORDS = [*FUNCTION_WORDS, "小", "大"]
FEATURES = ["ttr", "avg_sentence_len", "function_word_ratio", "punctuation_ratio", "repeat_ratio", "ngram_repeat_rate"]


def counts_of(items: Column) -> Column:
    """How often each distinct item of an array occurs."""
    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, F.greatest(i - 1, F.lit(0)))))
        counts = let(firsts, lambda f: F.transform(f, lambda x, k: F.coalesce(F.get(f, k + 1), n) - x))
        return F.when(n > 0, counts).otherwise(F.expr("cast(array() as array<int>)"))

    return let(F.sort_array(items), runs)


def ngram_repeat_rate(items: Column, n: int = 3) -> Column:
    """Share of n-grams that occurred before; 0 with fewer than n + 1 items."""
    def rate(items: Column) -> Column:
        total = F.size(items) - n + 1
        grams = F.transform(F.sequence(F.lit(1), total), lambda i: F.array_join(F.slice(items, i, n), "\u0000"))
        return F.when(F.size(items) < n + 1, F.lit(0.0)).otherwise((total - F.size(F.array_distinct(grams))) / total)

    return let(items, rate)


def mean_length(parts: Column, otherwise: Column) -> Column:
    """Mean length of an array's strings, or ``otherwise`` of an empty array."""
    return let(parts, lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0), lambda a, s: a + F.length(s)) / F.size(x)).otherwise(otherwise.cast("double")))


def stylometry(blocks: DataFrame) -> DataFrame:
    """``blocks`` with FEATURES, ``tokens`` and ``token_counts``.  Texts without tokens get zeros."""
    with_tokens = blocks.withColumn("tokens", tokens(F.col("text")))
    with_counts = with_tokens.withColumn("token_counts", counts_of(F.col("tokens")))
    n = F.size("tokens")
    mean = mean_length(F.filter(F.transform(sentence_pieces(F.col("text")), trimmed), lambda s: F.length(s) > 0), F.length("text"))
    some = lambda c: F.when(n > 0, c).otherwise(F.lit(0.0))
    return with_counts.withColumns({
        "ttr": some(F.size("token_counts") / n),
        "avg_sentence_len": some(mean),
        "function_word_ratio": some(F.size(F.filter("tokens", lambda t: t.isin(FUNCTION_WORDS))) / n),
        "punctuation_ratio": some(F.regexp_count("text", F.lit("[，。！？.!?]")) / F.length("text")),
        "repeat_ratio": some(F.size(F.filter("token_counts", lambda c: c >= 3)) / F.size("token_counts")),
        "ngram_repeat_rate": some(ngram_repeat_rate(F.col("tokens"))),
    })


def stylometry_legacy(blocks: DataFrame) -> DataFrame:
    """The features of the archived implementation: Unicode tokens, simple sentences, rounded values."""
    t = blocks.withColumn("tokens", legacy_tokens(F.col("text"))).withColumn("token_counts", counts_of(F.col("tokens")))
    n = F.size("tokens")
    some = lambda c, digits: F.when(n > 0, F.bround(c, digits)).otherwise(F.lit(0.0))
    return t.withColumns({
        "ttr": some(F.size("token_counts") / n, 4),
        "avg_sentence_len": some(mean_length(simple_sentences(F.col("text")), F.length("text")), 2),
        "function_word_ratio": some(F.size(F.filter("tokens", lambda x: x.isin(LEGACY_FUNCTION_WORDS))) / n, 4),
        "punctuation_ratio": some(F.regexp_count("text", F.lit("[，。！？.!?]")) / F.length("text"), 4),
        "repeat_ratio": some(F.size(F.filter("token_counts", lambda c: c >= 3)) / F.size("token_counts"), 4),
        "ngram_repeat_rate": some(ngram_repeat_rate(F.col("tokens")), 4),
    })


def entropy(token_counts: Column) -> Column:
    """Entropy of a count array, in nats."""
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    return let(total(token_counts), lambda n: F.aggregate(token_counts, F.lit(0.0), lambda a, c: a - (c / n) * F.log(c / n + 1e-12)))


def perplexity(blocks: DataFrame) -> DataFrame:
    """``blocks`` (with ``token_counts``) and ``ppl``: the unigram estimate within 20 to 300; 120 without tokens."""
    n = F.aggregate("token_counts", F.lit(0), lambda a, c: a + c)
    scaled = 20.0 + F.least((F.exp(entropy(F.col("token_counts"))) - 1.0) * 22.5, F.lit(280.0))
    base = 120.0 - F.size("token_counts") / n * 60.0 + F.length("text") / 500
    value = F.greatest(F.lit(20.0), F.least(F.lit(300.0), 0.5 * scaled + 0.5 * base))
    return blocks.withColumn("ppl", F.when(n > 0, F.floor(value * 100 + 0.5) / 100).otherwise(F.lit(120.0)))


def readability(blocks: DataFrame) -> DataFrame:
    """``fluency, clarity, cohesion`` within 0.1 to 0.99, and ``suggestions`` for those below 0.6."""
    held = lambda c: F.greatest(F.lit(0.1), F.least(F.lit(0.99), c))
    scored = blocks.withColumns({
        "fluency": held(1 - 0.8 * F.col("repeat_ratio")), "clarity": held(1 - F.col("avg_sentence_len") / 240), "cohesion": held(1 - F.col("ngram_repeat_rate")),
    })
    hints = F.array(*[F.when(F.col(c) < 0.6, F.lit(c)) for c in ("fluency", "clarity", "cohesion")])
    return scored.withColumn("suggestions", F.filter(hints, lambda h: h.isNotNull()))
