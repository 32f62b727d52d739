"""Statistics of paragraphs and documents, and what they are: prose, list, table or junk (problem 1).

Method: a text is taken apart into runs of lines of one shape.  Each run,
whatever its shape, gets basic counts and the Jensen-Shannon divergences of its
function-word and its character-class distribution from the prose profile of the
language nearest to it, and is assigned the nearest structural profile in the
space of all of them; machine output, word salad and symbols are told from prose
by the divergences alone.  A text is of the kind that
more than half of its characters belong to, otherwise prose.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.prose import FUNCTION_WORDS, UNSPACED, body, less

KINDS = ("prose", "list", "table", "junk")
#: Share of character classes in prose: letters, digits, spaces, sentence marks, others (fixed values).
CLASSES = (0.80, 0.01, 0.15, 0.025, 0.015)
CLASSES_UNSPACED = (0.90, 0.01, 0.005, 0.08, 0.005)

#: Structural profiles in the space of _POINT (fixed values, rounded from medians of runs of each kind).
PROFILES: list[tuple[str, tuple[float, ...]]] = [
    ("prose", (0.0, 0.0, 0.0, 0.08, 0.01, 0.0, 0.0, 1.0)),
    ("prose", (0.0, 0.0, 0.0, 0.20, 0.10, 0.2, 0.1, 1.0)),
    ("list", (1.0, 0.0, 0.0, 0.33, 0.05, 0.1, 0.1, 0.3)),
    ("list", (1.0, 0.0, 0.0, 0.33, 0.05, 0.1, 1.0, 0.3)),
    ("list", (0.0, 0.0, 1.0, 0.60, 0.05, 0.05, 0.2, 0.3)),
    ("list", (0.0, 0.0, 1.0, 0.33, 0.05, 0.05, 1.0, 0.3)),
    ("table", (0.0, 1.0, 0.0, 0.10, 0.12, 0.1, 0.0, 0.1)),
    ("table", (0.0, 1.0, 0.0, 0.50, 0.25, 0.1, 0.0, 0.1)),
    ("table", (0.0, 1.0, 0.0, 0.80, 0.36, 0.15, 0.0, 0.1)),
    ("list", (0.0, 1.0, 0.0, 0.10, 0.02, 0.05, 0.0, 0.1)),
    ("list", (0.0, 1.0, 0.0, 0.50, 0.03, 0.05, 0.0, 0.1)),
    ("junk", (0.0, 1.0, 0.0, 0.72, 0.25, 0.38, 0.0, 0.3)),
    ("junk", (0.0, 0.0, 0.0, 0.65, 0.34, 0.1, 0.0, 0.0)),
    ("junk", (0.0, 0.0, 0.0, 0.60, 0.11, 0.1, 0.0, 0.0)),
    ("junk", (0.0, 0.0, 0.0, 0.60, 0.22, 0.38, 0.0, 0.5)),
    ("junk", (0.0, 0.0, 0.0, 1.0, 0.10, 0.05, 0.0, 0.0)),
    ("junk", (0.0, 0.0, 0.0, 1.0, 0.50, 0.5, 0.1, 0.3)),
    ("junk", (0.0, 0.0, 0.0, 1.0, 0.10, 0.05, 1.0, 0.0)),
    ("junk", (0.0, 0.0, 1.0, 0.80, 0.34, 0.1, 0.0, 0.0)),
    ("junk", (1.0, 0.0, 0.0, 1.0, 0.10, 0.1, 1.0, 0.0)),
    ("junk", (0.0, 0.0, 1.0, 1.0, 0.10, 0.05, 1.0, 0.0)),
]
#: Coordinates of a run: shares of marked lines, of lines in columns and of short lines without a stop; divergence
#: of its function words (as a part of a text's without any) and of its character classes; symbols; repetition;
#: sentence ends (1 where there are as many as in prose).  And their weights.
_POINT = ("marked", "columns", "short", "words", "classes", "symbols", "repetition", "ends")
WEIGHTS = (1.5, 1.5, 1.2, 2.0, 4.0, 1.5, 1.5, 0.6)
#: Words a sentence of prose has at most, as a rule.
LONG_SENTENCE = 40
#: Occurrences a cell of function words must be expected to have.
LEAST_EXPECTED = 5
#: Words below which the function words of a run say little.
FEW_WORDS = 12

_LINE_END = re.compile(r"\r\n?")
_LEADERS = re.compile(r"(?:\.\s?){4,}|…{2,}")
_TOKENS = re.compile(r"[^\W_]+(?:[\u0300-\u036f\u0900-\u0903\u093a-\u094f\u0610-\u061a\u064b-\u065f]+[^\W_]*)*")
_JOINED = re.compile(r"[\u0300-\u036f\u0900-\u0903\u093a-\u094f\u0610-\u061a\u064b-\u065f]")
_WORD = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f\u0900-\u0903\u093a-\u094f\u0610-\u061a\u064b-\u065f]+[^\W\d_]*)*")
_TOKEN = re.compile(r"[A-Za-z0-9_]+|[一-鿿]")
_STOPS = ".!?。！？…।؟．"
_STOP = re.compile(r"[.!?。！？…।؟．][\"'”’»」』）)\]]*\s*$")
_SENTENCE = re.compile(r"[.!?。！？…।؟．]+(?=\s|$|[^\x00-\x7f])")
_ENDS = re.compile(r"[.!?。！？…।؟．](?<=[\w)\]}”»’\"'].)[.!?。！？…।؟．]*(?=\s|$|[^\x00-\x7f])")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿฀-๿]")
_MARKED = re.compile(
    r"\s*(?:\\(?:bib)?item\b|@\w+\{|[^\w\s\"'“«„(¿¡$\\<{#%!?.,;:)\]}|]\s+\S|o\s+\S|\[[ xX✓]\]\s|\[\d{1,3}\]\s|\(?\d{1,3}[.)]\s+\S|\(?[a-zA-Z]\)\s+\S|\(?[ivx]{1,4}[.)]\s+\S"
    r"|\d+(?:\.\d+)+\s+\S.*\s\d{1,4}\s*$|\\(?:contentsline|tableofcontents)\b)"
)
_LEADER = re.compile(r"(?:\.\s?){4,}\s*\d*\s*$")
_RULE = re.compile(r"^(?=.*[-=─═])(?=.*[+|¦┼:])[\s+|¦=:─-╿-]{4,}$|^\s*\\(?:hline|toprule|midrule|bottomrule|cline)\b")
_PUNCTUATION = re.compile("[.,;:!?。，、！？；：'\"’“”।]")
_DIGITS = re.compile("[0-9０-９]")
_SPACE = re.compile(r"\s+")
_SYMBOL = re.compile(r"[!-%'-*:-@\[-^`{}~]")
_HIDDEN = re.compile("[\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff]")
#: Three and more separators in a row without a space after them.
_FIELDS = re.compile(r"^[^\s,;]*[,;][^\s,;]*[,;]\S*$|[^\s;]*;[^\s;]*;[^\s;]*;|[^\s,]*,(?=\S)[^\s,]*,[^\s,]*,|(?:[^;\n]{0,24};(?! )){3}")
_WIDE_GAP = re.compile(r"\S(?: {2,}|\t+)(?=\S)")
_NEUTRAL = re.compile(r"^\s*\\(?:begin|end|section|subsection|subsubsection|paragraph|chapter|label|includegraphics|centering|maketitle|title|author|caption|vspace|hspace|noindent|newpage|clearpage|bibliography|bibliographystyle|appendix|input|include)\b\*?")
_ENVIRONMENT = re.compile(r"\\(begin|end)\{(\w+)\*?\}")
_LISTS = frozenset(["itemize", "enumerate", "description", "thebibliography"])
_TABLES = frozenset(["tabular", "tabularx", "longtable", "array", "tabu"])
_FORMULA = re.compile(r"\$[^$]{1,300}\$|\\[A-Za-z]+\*?|[{}\[\]]")
_BLANK = re.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)\s*")

_LANGUAGES_OF: dict[str, list[str]] = {}
for _language, _words in FUNCTION_WORDS.items():
    if _language not in UNSPACED:
        for _w in _words:
            _LANGUAGES_OF.setdefault(_w, []).append(_language)


def divergence(cells: Iterable[tuple[float, float]]) -> float:
    """Jensen-Shannon divergence, base 2, of a distribution p from q; ``cells``: (p, q) where p isn't 0, q summing to 1 over all cells."""
    total = 1.0
    for a, b in cells:
        m = (a + b) / 2
        total += a * math.log2(a / m) - b
        if b:
            total += b * math.log2(b / m)
    return max(0.0, total / 2)


class Run(NamedTuple):
    kind: str
    chars: int
    divergence: float
    language: str


@lru_cache(maxsize=4096)
def _cells(language: str, size: int) -> tuple[dict[str, int], list[float], float]:
    """(cell of each function word, expected share of each cell and of all other words last, divergence of a text without function words).

    Words rarer than five in ``size`` share cells, since their own counts would be chance.
    """
    place, shares = {}, [0.0]
    for w, q in sorted(FUNCTION_WORDS[language].items(), key=lambda x: -x[1]):
        if shares[-1] * size >= LEAST_EXPECTED:
            shares.append(0.0)
        place[w] = len(shares) - 1
        shares[-1] += q
    if len(shares) > 1 and shares[-1] * size < LEAST_EXPECTED:
        last = shares.pop()
        shares[-1] += last
        place = {w: min(k, len(shares) - 1) for w, k in place.items()}
    shares.append(1 - sum(shares))
    return place, shares, divergence([(1.0, shares[-1])])


def _function_words(text: str, words: list[str], unspaced: bool) -> tuple[str, float, float, float]:
    """(nearest language, divergence from its function-word profile, share of function words, divergence of a text without any).

    The nearest language is the one of least divergence.  Where no function word
    occurs there is none, and the divergence is that of the language it is largest for.
    """
    n = max(1, sum(not c.isspace() for c in text) if unspaced else len(words))
    size = 1 << n.bit_length() - 1
    found: dict[str, Counter] = {}
    if unspaced:
        for language in UNSPACED:
            counts = Counter({w: k for w in FUNCTION_WORDS[language] if (k := text.count(w))})
            if counts:
                found[language] = counts
    else:
        for w, k in Counter(filter(_LANGUAGES_OF.__contains__, words)).items():
            for language in _LANGUAGES_OF[w]:
                found.setdefault(language, Counter())[w] = k
    if not found:
        none = max(_cells(language, size)[2] for language in FUNCTION_WORDS if (language in UNSPACED) == unspaced)
        return "", none, 0.0, none
    best = ("", 2.0, 0.0, 1.0)
    for language, counts in found.items():
        place, shares, none = _cells(language, size)
        own: dict[int, float] = {}
        for w, k in counts.items():
            own[place[w]] = own.get(place[w], 0.0) + k / n
        share = sum(own.values())
        part = max(1.0, share)
        cells = [(x / part, shares[k]) for k, x in own.items()]
        if share < 1.0:
            cells.append((1.0 - share, shares[-1]))
        d = divergence(cells)
        if d < best[1]:
            best = (language, d, min(1.0, share), none)
    return best


def _line(line: str, environment: str) -> str:
    """Shape of a line: marked, columns, neutral, short (a few words without a stop) or plain."""
    if environment:
        if environment in _TABLES:
            return "columns"
        return "neutral" if _NEUTRAL.match(line) else "marked"
    bare = line.strip()
    tight = bare.count(",") - bare.count(", ") if "," in bare else 0
    worded, delimited = bare[:2].isalpha(), "|" in bare or ";" in bare or "&" in bare or "\t" in bare or "¦" in bare
    if worded and bare[-1] in _STOPS and tight < 2 and not delimited:
        return "plain"
    if bare[0] == "\\" and _NEUTRAL.match(bare):
        return "neutral"
    # a rule begins with no letter, a marked line with one letter or a small Roman number at most
    if not worded and _RULE.match(bare):
        return "columns"
    if (tight > 1 or delimited) and (
        bare[0] in "|¦" or bare.count(" | ") + bare.count(" ¦ ") > (1 if len(bare) > 60 else 0) or bare.count("\t") > 1 or bare.count(" & ") > 1
        or (tight > 1 or bare.count(";") > 1) and _FIELDS.search(bare)
    ) and _symbols(bare) < 0.4:
        return "columns"
    if (not worded or bare[0] in "ivx") and _MARKED.match(line) or (".." in bare or ". ." in bare) and _LEADER.search(bare[-60:]) or _listed(bare):
        return "marked"
    if "   " in bare and len(_WIDE_GAP.findall(bare)) > 1:
        return "columns"
    if len(bare) < 46 and not any(c in bare for c in _STOPS):
        return "short"
    return "plain"


def _symbols(line: str) -> float:
    """Share of the characters other than space that are no letters, digits or separators."""
    packed = _SPACE.sub("", line)
    return len(_SYMBOL.findall(packed)) / max(1, len(packed))


def _listed(line: str) -> bool:
    """Whether a line is an enumeration: many short items between commas or semicolons, and no sentence."""
    n = max(map(line.count, ";,、；，·/|"))
    if n < 5 or len(line) / (n + 1) > 34 or any(c in line[:-1] for c in _STOPS):
        return False
    return len(line) / (n + 1) < 12 or not _UNSPACED.search(line)


def lines_of(text: str) -> list[str]:
    """Lines of a text, by carriage returns and line feeds only: other separators are part of wrongly decoded text."""
    return (_LINE_END.sub("\n", text) if "\r" in text else text).split("\n")


def _runs(text: str) -> Iterator[tuple[str, list[str]]]:
    """Runs of lines of one shape; blank lines end a run of plain lines.

    Lines of few words are a list where at least four of them come together and
    are as short as a wrapped paragraph's lines are not; else they go with the plain ones.
    """
    shape, lines, environment = "", [], ""
    few: list[str] = []

    def settle() -> list[tuple[str, list[str]]]:
        """What the pending short lines turn out to be."""
        nonlocal shape, lines, few
        out = []
        if few:
            mean = sum(map(len, few)) / len(few)
            if len(few) > 3 and mean < (16 if _UNSPACED.search(few[0]) else 33):
                if lines:
                    out.append((shape, lines))
                out.append(("short", few))
                shape, lines = "", []
            elif shape in ("plain", ""):
                shape, lines = "plain", lines + few
            else:
                out.append((shape, lines))
                shape, lines = "plain", few
            few = []
        return out

    for line in lines_of(text):
        if not line or line.isspace():
            yield from settle()
            if shape == "plain":
                yield shape, lines
                shape, lines = "", []
            continue
        if "\\begin{" in line or "\\end{" in line:
            for what, name in _ENVIRONMENT.findall(line):
                if name in _LISTS or name in _TABLES:
                    environment = name if what == "begin" else ""
        now = _line(line, environment)
        if now == "short":
            few.append(line)
            continue
        yield from settle()
        if now != shape:
            if lines:
                yield shape, lines
            shape, lines = now, []
        lines.append(line)
    yield from settle()
    if lines:
        yield shape, lines


_ASCII_WORDS = bytes(c if c < 128 and chr(c).isalnum() else 32 for c in range(256))
_ASCII_LETTERS, _ASCII_DIGITS, _ASCII_MARKS, _ASCII_SPACES = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"", b" \n"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """What the characters of the first plane are: letters and digits (1), marks within words (2), sentence marks (4), digits (8)."""
    chars = list(map(chr, range(1 << 16)))
    out = np.array([c.isalnum() for c in chars], np.uint8)
    for value, pattern in ((2, _JOINED), (4, _PUNCTUATION), (8, _DIGITS)):
        out[[m.start() for m in pattern.finditer("".join(chars))]] |= value
    return out


def _counted_at_once(text: str, unspaced: bool) -> tuple[list[str], int, int, int, int] | None:
    """``_counted`` of a longer text by a table of characters; null where it has marks within words or characters beyond the first plane."""
    lower = text.lower()
    codes = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) != len(text) or codes.max() > 0xFFFF:
        return None
    classes = _classes().take(codes)
    of_class = np.bincount(classes, minlength=16)
    if of_class[2] and not unspaced:
        return None
    marks, digits, spaces = int(of_class[4]), int(of_class[9]), text.count(" ") + text.count("\n")
    if unspaced:
        return [], len(text) - marks - digits - spaces, digits, spaces, marks
    words = np.where(classes & 1, codes, np.uint32(32)).tobytes().decode("utf-32-le").split()
    return words, int(of_class[1] + of_class[3]), digits, spaces, marks


def _counted(text: str, unspaced: bool) -> tuple[list[str], int, int, int, int]:
    """(words, letters, digits, blanks, marks) of a text; no words where they aren't spaced.  Letters beside digits are no word of their own."""
    if text.isascii():
        raw = text.encode("ascii")
        n = len(raw)
        without = lambda chars: n - len(raw.translate(None, chars))
        return raw.lower().translate(_ASCII_WORDS).decode("ascii").split(), without(_ASCII_LETTERS), without(_ASCII_DIGITS), without(_ASCII_SPACES), without(_ASCII_MARKS)
    if len(text) > 300 and (found := _counted_at_once(text, unspaced)):
        return found
    words = [] if unspaced else _TOKENS.findall(text.lower())
    marks, digits, spaces = len(_PUNCTUATION.findall(text)), len(_DIGITS.findall(text)), text.count(" ") + text.count("\n")
    return words, len(text) - marks - digits - spaces if unspaced else sum(map(len, words)) - digits, digits, spaces, marks


def _assign(shape: str, lines: list[str]) -> Run:
    """The structural profile nearest to a run of lines."""
    chars = sum(map(len, lines))
    if shape == "neutral":
        return Run("heading", chars, 0.0, "")
    text = "\n".join(lines)
    if shape == "plain":
        if "\\" in text or "$" in text:
            text = _FORMULA.sub(" ", text)
        if len(text) < 60 and len(lines) < 3 and len(text.split()) < 12 and not _repeated(text) and _symbols(text) < 0.4:
            return Run("heading", chars, 0.0, "")
    elif ".." in text or "…" in text or ". ." in text:
        text = _LEADERS.sub(" ", text)  # layout
    unspaced = not text.isascii() and 3 * len(_UNSPACED.findall(text)) > len(text)
    n = max(1, len(text))
    words, letters, digits, spaces, marks = _counted(text, unspaced)
    language, d, _, none = _function_words(text, words, unspaced)
    other = max(0, n - letters - marks - digits - spaces)
    total = letters + digits + spaces + marks + other or 1
    classes = divergence((k / total, q) for k, q in zip((letters, digits, spaces, marks, other), CLASSES_UNSPACED if unspaced else CLASSES, strict=True) if k)
    symbols = min(1.0, (other + max(0, marks - 0.12 * n)) / n)
    repetition = _repeated(text)
    apart, size = min(1.0, d / none), letters // 2 if unspaced else len(words)
    # where all else is that of prose, its sentence ends decide nothing
    ends = 1.0 if shape == "plain" and apart < 0.3 and classes < 0.05 and symbols < 0.1 and repetition < 0.1 else min(1.0, len(_ENDS.findall(text)) * LONG_SENTENCE / max(1, size))
    if shape in ("plain", "short"):
        # a few words say little, and a wrongly decoded text counts as what it was
        if shape == "plain" and size < FEW_WORDS and repetition < 0.5 and symbols < 0.3:
            apart, classes = apart * size / FEW_WORDS, min(classes, 0.1)
        if repetition < 0.6 and len(text.encode("ascii", "ignore")) < 0.85 * n:
            apart, classes, symbols, ends = min(apart, 0.2), min(classes, 0.1), min(symbols, 0.2), 1.0
    return Run(_nearest((float(shape == "marked"), float(shape == "columns"), float(shape == "short"), apart, classes, symbols, repetition, ends)), chars, d, language)


#: A profile's distance is its constant less the sum of the point's coordinates times its slopes, up to what all profiles share.
_LINEAR = [(kind, sum(w * x * x for w, x in zip(WEIGHTS, at, strict=True)), tuple(2 * w * x for w, x in zip(WEIGHTS, at, strict=True))) for kind, at in PROFILES]


def _nearest(point: tuple[float, ...]) -> str:
    """The kind of the profile at the least weighted squared distance."""
    a, b, c, d, e, f, g, h = point
    best, least = "prose", math.inf
    for kind, constant, (p, q, r, s, t, u, v, w) in _LINEAR:
        far = constant - a * p - b * q - c * r - d * s - e * t - f * u - g * v - h * w
        if far < least:
            best, least = kind, far
    return best


def _repeated(text: str) -> float:
    """How much of a text is mere repetition, 0 to 1: few distinct runs of five words, or of eight characters where there are no words."""
    tokens = text.split()
    n = len(text)
    if len(tokens) >= 24 and n < 40 * len(tokens):
        total, runs = len(tokens) - 4, zip(tokens, tokens[1:], tokens[2:], tokens[3:], tokens[4:])
    elif n >= 40:
        total, runs = n - 7, (text[i : i + 8] for i in range(n - 7))
    else:
        return 0.0
    distinct = set(islice(runs, total * 2 // 5))
    if len(distinct) / total >= 0.30:
        return 0.0  # whatever the others are
    distinct.update(runs)
    return max(0.0, min(1.0, (0.30 - len(distinct) / total) / 0.15))


def kind_of(text: str | None, article: bool = False) -> str | None:
    """prose, list, table or junk; null for a null or blank text."""
    if not text or text.isspace():
        return None
    return _decide([_assign(*run) for run in _runs(_shown(text, article))])


def is_junk(text: str, article: bool = False) -> bool:
    """Whether ``kind_of`` a text is junk; ends once half of the text is known to be something else."""
    shown = _shown(text, article)
    rest, runs = len(shown), []
    for run in _runs(shown):
        runs.append(_assign(*run))
        if runs[-1].kind != "junk":
            rest -= 2 * runs[-1].chars
            if rest <= 0:
                return False
    return _decide(runs) == "junk"


def _shown(text: str, article: bool, at: list[int] | None = None) -> str:
    """What a reader sees of a text: no preamble, comments and characters that don't show; ``at`` is kept as by ``less``."""
    return less(_HIDDEN, body(text, at) if article else text, at)


def _decide(runs: list[Run]) -> str:
    share: Counter = Counter()
    for run in runs:
        share[run.kind] += run.chars
    total = sum(share.values()) or 1
    kind, most = max(((k, share[k]) for k in KINDS[1:]), key=lambda x: x[1])
    return kind if 2 * most > total else "prose"


STATS = pa.schema([
    ("words", pa.int32()), ("mean_word_len", pa.float64()), ("ttr", pa.float64()), ("avg_sentence_len", pa.float64()), ("punctuation_ratio", pa.float64()),
    ("symbol_ratio", pa.float64()), ("function_word_ratio", pa.float64()), ("repeat_ratio", pa.float64()), ("stopped_lines", pa.float64()), ("divergence", pa.float64()), ("kind", pa.string()),
])


def statistics(text: str | None, article: bool = False) -> tuple:
    """The row of STATS for a text; counts 0, ratios null and kind null for a null or blank text."""
    if not text or text.isspace():
        return (0, *[None] * 10)
    inside = _shown(text, article)
    runs = [_assign(*run) for run in _runs(inside)]
    tokens = _TOKEN.findall(inside)
    words = _WORD.findall(inside.lower())
    n, k = len(inside) or 1, len(tokens)
    counts = Counter(tokens)
    lines = [x for x in lines_of(inside) if x.strip()]
    sentences = max(1, len(_SENTENCE.findall(inside)))
    marks = sum(map(inside.count, "，。！？.!?"))
    measured = [r for r in runs if r.kind != "heading"]
    unspaced = 3 * len(_UNSPACED.findall(inside)) > n
    alnum = sum(map(len, words))
    return (
        len(words), alnum / len(words) if words else None, len(counts) / k if k else None, len(inside.strip()) / sentences, marks / n,
        max(0.0, 1 - (alnum + inside.count(" ") + inside.count("\n") + marks + sum(map(inside.count, "0123456789"))) / n),
        _function_words(inside, words, unspaced)[2], sum(c >= 3 for c in counts.values()) / len(counts) if counts else None,
        sum(bool(_STOP.search(x)) for x in lines) / len(lines) if lines else None,
        sum(r.divergence * r.chars for r in measured) / sum(r.chars for r in measured) if measured else None, _decide(runs),
    )


def kinds(items: DataFrame, id_column: str, text_column: str = "text", article: bool = False) -> DataFrame:
    """``item_id, kind`` of every row; blank and null texts have a null kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = pa.array([kind_of(t, article) for t in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), found], names=["item_id", "kind"])

    return items.select(F.col(id_column).cast("bigint").alias("item_id"), text_column).mapInArrow(run, "item_id bigint, kind string")


def text_statistics(items: DataFrame, id_column: str, text_column: str = "text", article: bool = False) -> DataFrame:
    """``item_id`` and the columns of STATS, one row for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = list(zip(*(statistics(t, article) for t in part.column(1).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(rows, STATS, strict=True))], names=["item_id", *STATS.names])

    columns = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'string' if f.type == pa.string() else 'double'}" for f in STATS)
    return items.select(F.col(id_column).cast("bigint").alias("item_id"), text_column).mapInArrow(run, f"item_id bigint, {columns}")
