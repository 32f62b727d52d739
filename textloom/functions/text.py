"""Column functions on text: normal form, tokens, language, previews, formats.

All are null for a null text unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Unicode white space, for use within a character class (a fixed value).
SPACE = "\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACE_IN_LINE = "\\t\\u000b-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The same as a string of all its characters.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
TOKEN = "[A-Za-z0-9_]+|[一-鿿]"
STOPS = "。！？.!?"
ALPHA = "\\p{IsAlphabetic}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often lambdas in ``use`` refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(text: Column) -> Column:
    """``text`` without Unicode white space at its ends."""
    return F.btrim(text, F.lit(SPACES))


def normalized(text: Column) -> Column:
    """One form of quotes, dashes, spaces and line ends; every line trimmed, blank lines kept."""
    # what most texts don't need is told by cheap tests, and only blanks that change are matched
    out = F.when(text.rlike("[“”‘’—\u3000\u00a0]"), F.translate(text, "“”‘’—\u3000\u00a0", "\"\"''-  ")).otherwise(text)
    out = F.when(out.contains("\r"), F.regexp_replace(out, "\\r\\n?", "\n")).otherwise(out)
    out = F.regexp_replace(out, "[\\t\\f\\u000b][ \\t\\f\\u000b]*+| [ \\t\\f\\u000b]++", " ")
    return trimmed(F.array_join(F.transform(F.split(out, "\n"), trimmed), "\n"))


def tokens(text: Column) -> Column:
    """Runs of ASCII word characters, and single ideographs."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def legacy_tokens(text: Column) -> Column:
    """Runs of Unicode word characters."""
    return F.regexp_extract_all(text, F.lit("(?U)\\w+"), F.lit(0))


def token_estimate(text: Column) -> Column:
    """Number of tokens, 1 at least, also for a null text."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)))


def language(text: Column) -> Column:
    """zh if more than 0.3 of the characters other than white space are ideographs, else en; en for a null text."""
    shown = F.length(F.regexp_replace(text, f"[{SPACE}]+", ""))
    han = F.regexp_count(text, F.lit("[一-鿿]"))
    return F.when((shown > 0) & (han / shown > 0.3), "zh").otherwise("en")


def is_cjk(code: Column) -> Column:
    """Whether a language code is Chinese, Japanese or Korean; false for null."""
    return F.coalesce(F.lower(F.trim(code)).rlike("^(zh|ja|ko)"), F.lit(False))


def shortened(text: Column, most: int) -> Column:
    """The first ``most`` characters, with three dots if that cuts any."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def preview(text: Column, most: int) -> Column:
    """``shortened`` on one line."""
    return F.translate(shortened(text, most), "\n", " ")


def tail(text: Column, most: int) -> Column:
    """The last ``most`` characters, after three dots if that cuts any."""
    return F.when(F.length(text) > most, F.concat(F.lit("..."), F.right(text, F.lit(most)))).otherwise(text)


def byte_slice(text: Column, start: Column, end: Column, most: int | None = None) -> Column:
    """Bytes ``start`` to ``end`` of a text, at most ``most``; the start moves on to a whole character, then the end back to one.

    Empty where nothing is left, where ``start`` is negative or ``end`` isn't beyond it.
    """
    raw = F.encode(text, "UTF-8")
    size = F.length(raw)

    def continues(at: Column) -> Column:
        """Whether the byte at ``at`` goes on with a character."""
        return F.hex(F.substring(raw, at + 1, F.lit(1))).rlike("^[89AB]")

    def ahead(at: Column) -> Column:
        return at + F.when(continues(at), F.when(continues(at + 1), F.when(continues(at + 2), 3).otherwise(2)).otherwise(1)).otherwise(0)

    def back(at: Column) -> Column:
        return at - F.when(continues(at), F.when(continues(at - 1), F.when(continues(at - 2), 3).otherwise(2)).otherwise(1)).otherwise(0)

    limit = F.least(end, size)
    first = F.least(ahead(F.least(F.greatest(start, F.lit(0)), size)), limit)
    last = back(limit if most is None else F.least(first + most, limit))
    cut = F.decode(F.substring(raw, first + 1, F.greatest(F.lit(0), last - first)), "UTF-8")
    return F.when((start < 0) | (end <= start), F.when(text.isNotNull(), "")).otherwise(cut)


def byte_offset(text: Column, chars: Column) -> Column:
    """The byte offset of a character offset."""
    return F.octet_length(F.left(text, chars)).cast("int")


def block_summary(order: Column, label: Column, text: Column) -> Column:
    """A one-line description of a block."""
    flat = trimmed(F.regexp_replace(text, f"[{SPACE}]+", " "))
    return F.format_string("[%d] label=%s len=%d text=%s", order, label, F.length(text), shortened(flat, 240))


def percent(p: Column) -> Column:
    return F.format_string("%.1f%%", p * 100)


def signed(x: Column) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), F.format_string("%.2f", x))


def colour(p: Column, panel: bool = True) -> Column:
    """low, medium or high, by the bounds of the results panel or of the list."""
    low, high = (0.30, 0.70) if panel else (0.65, 0.85)
    return (F.when(p <= low, "low").when(p < high, "medium") if panel else F.when(p < low, "low").when(p < high, "medium")).otherwise("high")


def provider_of(spec: Column) -> Column:
    """struct(provider, model) of a ``provider:model`` specification, split at the first colon."""
    return F.struct(F.split(spec, ":", 2)[0].alias("provider"), F.split(spec, ":", 2)[1].alias("model"))


def stopped(text: Column) -> Column:
    """Whether the last character other than white space ends a sentence."""
    return text.rlike(f"[{STOPS}][{SPACE}]*\\z")
