"""Language of documents and requests, and of every stretch of mixed texts (problem 4).

Method: hyperdimensional profiles.  Every letter has a random vector of +1 and
-1; an n-gram's vector binds (multiplies) the vectors of its letters, each
permuted by its place; a text's vector bundles (adds) those of its n-grams.
Texts are compared with one prototype per language by cosine.

A text's dot product with a prototype is the sum of its n-grams' dot products,
so a fitted model keeps those per n-gram and never builds a text's vector; its
length is that of independent n-gram vectors.  Prototypes are fitted on a
bounded sample of labelled texts, whose wrong labels are corrected by
reassigning each to the prototype nearest to it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.llm import encoding_repair, sentences, structure
from textloom.llm.prose import FUNCTION_WORDS, body

LANGUAGES = tuple(FUNCTION_WORDS)
DIMENSIONS = 2048
SLOTS = 22
#: Codes and names of each language as labels spell them (fixed values).
SPELLINGS = {
    "en": "eng english englisch anglais inglés", "zh": "zho chi cmn chinese mandarin 中文 汉语 漢語 chinesisch", "de": "deu ger german deutsch allemand alemán",
    "fr": "fra fre french français francais französisch", "es": "spa spanish español espanol castellano spanisch", "pt": "por portuguese português portugues",
    "ru": "rus russian русский russisch", "ja": "jpn jp japanese 日本語 japanisch", "ar": "ara arabic العربية arabisch", "hi": "hin hindi हिन्दी हिंदी", "th": "tha thai ไทย",
}
#: Labels that name no single language (fixed values).
NO_LANGUAGE = ["", "??", "?", "-", "auto", "mul", "mis", "und", "zxx", "unknown", "n/a", "na", "none", "null", "other"]

#: Commands, formulas and addresses; an equals sign stands for the word before it, which goes too (``_markup``).
#: Each begins with one of four characters, so that a search skips all others.
_COMMANDS = re.compile(r"\\(?:cite\w*|ref|eqref|label|includegraphics|input|include|bibitem|begin|end|url|href|usepackage)\*?(?:\[[^\]]*\])*(?:\{[^{}]*\})*|\$\$?[^$]{0,400}\$\$?|\\[A-Za-z]+\*?|https?:\S+|=")


class Grams(NamedTuple):
    """Places in the model of a text's letters, then of its triples; where each is in the text; the text's size."""

    at: np.ndarray
    where: np.ndarray
    size: int


class Whole(NamedTuple):
    """Cosines of a text with each prototype; the share of its letter triples that are known; how varied its n-grams are."""

    cosines: np.ndarray
    known: float
    varied: float


class Model(NamedTuple):
    """Known n-grams and their dot products with each prototype."""

    number: np.ndarray  # the number of each code point; 0 for those that are no known letter
    keys: np.ndarray
    slots: np.ndarray
    scores: np.ndarray  # one row per key, after a row of zeros
    letters: np.ndarray  # the place of each letter, by its number

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """Places in ``keys``, plus 1, of n-grams; 0 for those unknown."""
        slot = _slot(keys)
        at = self.slots.take(slot)
        odd = self.keys.take(at) != keys
        todo = np.flatnonzero(odd & (at > 0))
        at[odd] = 0
        step = 1
        while len(todo):  # n-grams of one slot lie in the free ones after it
            next_ = self.slots[(slot[todo] + step) & ((1 << SLOTS) - 1)]
            hit = self.keys[next_] == keys[todo]
            at[todo[hit]] = next_[hit]
            todo = todo[~hit & (next_ > 0)]
            step += 1
        return at

    def grams(self, text: str) -> Grams:
        """A text's letters and letter triples, found once for both uses below."""
        number, place, size = _numbers(text, self.number)
        inner = number[1:-1]
        letter = np.flatnonzero(inner > 0)
        at = np.concatenate((self.letters.take(inner.take(letter)), self._found(_triples(number).take(letter))))
        return Grams(at, place.take(letter) + 1, size)

    def whole(self, grams: Grams) -> Whole:
        """A text against every prototype."""
        at, half = grams.at, len(grams.where)
        if not half:
            return Whole(np.zeros(len(LANGUAGES)), 0.0, 0.0)
        counts = np.bincount(at, minlength=1)
        unknown = int(counts[0])
        place = np.flatnonzero(counts > 0)
        n = counts.take(place).astype(np.float32)
        # unknown n-grams count as distinct ones
        length = math.sqrt((float((n.astype(np.float64) ** 2).sum()) - unknown**2 + unknown) * DIMENSIONS)
        triples = int(np.count_nonzero(at[half:]))
        return Whole(n @ self.scores.take(place, axis=0) / length, triples / half, (len(place) + unknown) / half)

    def strengths(self, grams: Grams, bounds: np.ndarray, exact: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece of a text: its cosine with each prototype, its n-grams taken as distinct, times the root of its size; and its letters.

        ``bounds`` are the letters before each piece and after the last one; sums are of type ``exact``.
        """
        half, n = len(grams.where), np.diff(bounds)
        scores = self.scores.take(grams.at[:half], axis=0)
        scores += self.scores.take(grams.at[half:], axis=0)
        out, some = np.zeros((len(n), len(LANGUAGES))), np.flatnonzero(n)
        if len(some):
            m = n[some]
            out[some] = np.add.reduceat(scores, bounds[:-1][some], axis=0, dtype=exact) * (np.sqrt(np.minimum(m, 400)) / np.sqrt(2.0 * m * DIMENSIONS))[:, None]
        return out, n


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _numbers(text: str, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of a text's letters with 0 for any run of others, framed by 0; the place of each; the text's size."""
    lower = text.lower()
    number = numbers.take(_codes(lower if len(lower) == len(text) else text))  # lower case of a few letters is longer
    known = number > 0
    keep = known.copy()
    keep[:1] = True
    keep[1:] |= known[:-1]
    place = np.flatnonzero(keep)
    framed = np.zeros(len(place) + 2, np.int64)
    framed[1:-1] = number.take(place)
    return framed, place, len(number)


def _triples(number: np.ndarray) -> np.ndarray:
    out = number[:-2] << 16
    out |= number[1:-1]
    out <<= 16
    out |= number[2:]
    out |= 1 << 50
    return out


def _keys(text: str, numbers: np.ndarray) -> np.ndarray:
    """Keys of a text's letters and letter triples; what is no known letter counts as one space."""
    number, _, _ = _numbers(text, numbers)
    inner = number[1:-1]
    return np.concatenate((inner[inner > 0], _triples(number)[inner > 0]))


def _slot(keys: np.ndarray) -> np.ndarray:
    out = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out >>= np.uint64(64 - SLOTS)
    return out.view(np.int64)


def _letter_vectors(letters: np.ndarray, seed: int) -> np.ndarray:
    """A random vector of +1 and -1 for each letter, the same wherever it is made."""
    out = np.empty((len(letters) + 1, DIMENSIONS), np.int8)
    out[0] = np.random.default_rng([seed, 0]).integers(0, 2, DIMENSIONS) * 2 - 1
    for i, code in enumerate(letters.tolist()):
        out[i + 1] = np.random.default_rng([seed, code]).integers(0, 2, DIMENSIONS) * 2 - 1
    return out


def fit(texts: list[tuple[str, str]], seed: int = 7, rounds: int = 3, grams_kept: int = 120_000) -> Model:
    """A model from (language, text) pairs, some of them mislabelled.

    The function words of each language stand in for languages without a text.
    ``grams_kept`` bounds the model to the commonest n-grams of the sample.
    """
    own = [(language, " ".join(words)) for language, words in FUNCTION_WORDS.items()]
    rows = [x for x in own + texts if x[1]]
    everything = "\n".join(t for _, t in rows).lower()
    letters = np.array(sorted(ord(c) for c in set(everything) if c.isalpha() or "\u0900" <= c <= "\u0e7f" and not c.isspace() and not c.isdigit())[: (1 << 16) - 2], np.int64)
    numbers = np.zeros(0x110000, np.uint16)
    numbers[letters] = np.arange(1, len(letters) + 1)
    counted: list[tuple[np.ndarray, np.ndarray]] = [np.unique(_keys(t, numbers), return_counts=True) for _, t in rows]
    keys, n = np.unique(np.concatenate([k for k, _ in counted]), return_counts=True)
    if len(keys) > grams_kept:
        keys = np.sort(keys[np.argsort(-n, kind="stable")[:grams_kept]])
    index = []
    for k, c in counted:
        at = np.searchsorted(keys, k)
        at[at == len(keys)] = 0
        good = keys[at] == k
        weight = c[good] / math.sqrt(float((c**2).sum()))
        index.append((at[good], weight.astype(np.float32)))
    vectors = _letter_vectors(letters, seed)

    def grams(low: int, high: int) -> np.ndarray:
        """Vectors of the n-grams ``low`` to ``high``: letters permuted by place and bound."""
        part = keys[low:high]
        last = vectors[part & 0xFFFF]
        triple = (part >> 50) > 0
        bound = np.roll(vectors[(part >> 32) & 0xFFFF], 2, axis=1) * np.roll(vectors[(part >> 16) & 0xFFFF], 1, axis=1) * last
        return np.where(triple[:, None], bound, last).astype(np.float32)

    language = np.array([LANGUAGES.index(x) for x, _ in rows])
    # the words alone decide first, so that scripts can't be mixed up by labels
    shares = np.zeros((len(LANGUAGES), len(keys)), np.float32)
    for step in range(rounds):
        shares[:] = 0
        size = np.zeros(len(LANGUAGES))
        for (at, weight), k in zip(index, language, strict=True):
            shares[k, at] += weight
            size[k] += 1
        prototypes = np.zeros((len(LANGUAGES), DIMENSIONS), np.float32)
        for low in range(0, len(keys), 4096):
            prototypes += shares[:, low : low + 4096] @ grams(low, low + 4096)
        prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True) + 1e-9
        scores = np.concatenate([grams(low, low + 4096) @ prototypes.T for low in range(0, len(keys), 4096)])
        if step < rounds - 1:
            nearest = np.array([int((weight[:, None] * scores[at]).sum(axis=0).argmax()) if len(at) else k for (at, weight), k in zip(index, language, strict=True)])
            language[len(own) :] = nearest[len(own) :]
    table = np.zeros(1 << SLOTS, np.int32)
    place, todo = _slot(keys), np.arange(len(keys))
    while len(todo):
        free = todo[table[place[todo]] == 0]
        _, first = np.unique(place[free], return_index=True)
        table[place[free[first]]] = free[first] + 1
        todo = todo[table[place[todo]] != todo + 1]
        place[todo] = (place[todo] + 1) & ((1 << SLOTS) - 1)
    single = np.zeros(len(letters) + 1, table.dtype)
    alone = np.flatnonzero(keys >> 50 == 0)
    single[keys[alone]] = alone + 1
    return Model(numbers, np.concatenate(([-1], keys)), table, np.concatenate((np.zeros((1, len(LANGUAGES)), np.float32), scores.astype(np.float32))), single)


def label_of(label: Column) -> Column:
    """The two-letter code a label names; null where it names none.  Other languages keep the first part of their label."""
    first = F.split(F.lower(F.trim(label)), "[-_ ]")[0]
    known = {s: code for code, names in SPELLINGS.items() for s in [code, *names.split()]}
    mapped = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    whole = F.lower(F.trim(label))
    return F.when(whole.isin(NO_LANGUAGE) | first.isin(NO_LANGUAGE), F.lit(None)).otherwise(F.coalesce(mapped[first], first))


def sample(items: DataFrame, label: str, per_language: int = 250, text: str = "text", key: str = "item_id") -> list[tuple[str, str]]:
    """At most ``per_language`` labelled texts of each language, the same ones in every run.

    The bound is the fit's only; ids are chosen first, so texts aren't shuffled.
    """
    named = items.select(F.col(key).alias("key"), label_of(F.col(label)).alias("lang")).where(F.col("lang").isin(*LANGUAGES)).dropDuplicates(["key"])
    order = W.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    chosen = named.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("key", "lang")
    rows = items.select(F.col(key).alias("key"), text).join(F.broadcast(chosen), "key").select("key", "lang", text).where(F.length(text) > 40)
    return sorted((r.lang, r[text]) for r in rows.dropDuplicates(["key"]).collect())


def running_text(text: str, article: bool = False) -> str:
    """The running text of an item: no preamble, comments, markup, lists, tables or machine output."""
    shown = structure._shown(text, article)
    plain = "\n".join("\n".join(lines) for shape, lines in structure._runs(shown) if shape == "plain" and not _machine(lines))
    return _without_markup(plain)


def _machine(lines: list[str]) -> bool:
    """Whether a run of plain lines is junk; only those with fewer letters or blanks than prose are looked at closely."""
    text = "\n".join(lines)
    if not text.isascii() or len(text) < 60:
        return False
    raw = text.encode("ascii")
    letters, blanks = (len(raw) - len(raw.translate(None, chars)) for chars in (structure._ASCII_LETTERS, structure._ASCII_SPACES))
    return (letters < 0.72 * len(raw) or blanks < 0.08 * len(raw)) and structure._assign("plain", lines).kind == "junk"


def _markup(text: str) -> list[tuple[int, int]]:
    """Where commands, formulas, addresses and names before an equals sign are in a text."""
    out, last = [], 0
    for m in _COMMANDS.finditer(text):
        a, b = m.span()
        if text[a] == "=":
            end = a
            while a > last and (text[a - 1].isalnum() or text[a - 1] == "_"):
                a -= 1
            # no name, or only the rest of a word that has lost its beginning
            if a == end or a and (text[a - 1].isalnum() or text[a - 1] == "_"):
                continue
        out.append((a, b))
        last = b
    return out


def _without_markup(text: str) -> str:
    """Each piece of markup as one space."""
    if "\\" not in text and "$" not in text and "=" not in text:
        return text
    at, parts = 0, []
    for a, b in _markup(text):
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    return " ".join(parts)


def _blanked(text: str) -> str:
    """Markup as spaces, so that all else keeps its place."""
    at, parts = 0, []
    for a, b in _markup(text):
        piece = text[a:b]
        parts += (text[at:a], _WITHIN_LINE.sub(" ", piece) if "\n" in piece or "\r" in piece else " " * (b - a))
        at = b
    parts.append(text[at:])
    return "".join(parts)


def _sound(text: str) -> str:
    """The prose runs of a text, without junk; the text itself if it has nothing else than those and blank lines."""
    runs = [(lines, shape == "plain" and structure._assign(shape, lines).kind in ("prose", "heading")) for shape, lines in structure._runs(text)]
    return text if all(good for _, good in runs) else "\n".join("\n".join(lines) for lines, good in runs if good)


LEAST = 0.15  # cosine below which a text is in no known language
CHANGE = 1.5  # cost of a change of language between sentences


def _sure(cosines: np.ndarray, scale: float) -> float:
    first, second = np.partition(cosines, -2)[[-1, -2]]
    return 1 / (1 + math.exp(-scale * float(first - second)))


def main_language(text: str, model: Model, grams: Grams | None = None) -> tuple[str | None, float]:
    """(language, confidence) of running text; null and 0 where there is none.

    Where unknown or repeated letters hint at junk, only the prose runs count.
    """
    if not text or text.isspace():
        return None, 0.0
    whole = model.whole(grams or model.grams(text))
    if whole.known < 0.75 or whole.varied < 0.1 and len(text) > 300:
        sound = _sound(text)
        if not sound or sound.isspace():
            return None, 0.0
        if sound is not text:
            whole = model.whole(model.grams(sound))
    if whole.cosines.max() < LEAST:
        return None, 0.0
    return LANGUAGES[int(whole.cosines.argmax())], _sure(whole.cosines, 25.0)


_WITHIN_LINE = re.compile(r"[^\r\n]")
_WHOLE_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
_ROUGH = re.compile(r"[.!?。！？।…؟．\n](?:(?<=\n)\n*|(?<!\n)[.!?。！？।…؟．]*\s*)")
_ROUGH_THAI = re.compile(_ROUGH.pattern + r"|(?<=[฀-๿]) +")
_THAI = re.compile("[฀-๿]")


def mixed(text: str, model: Model, main: str, grams: Grams) -> bool:
    """Whether a text may hold sentences in another language than ``main``: some piece between stops is clearly nearer to it."""
    half, bounds = len(grams.where), [0]  # letters before each bound
    rough = _ROUGH_THAI if not text.isascii() and _THAI.search(text) else _ROUGH
    for n in np.searchsorted(grams.where, [m.end() for m in rough.finditer(text)], "right").tolist():
        if n - bounds[-1] > 9:
            bounds.append(n)
    if half > bounds[-1]:
        bounds.append(half)
    if len(bounds) < 3:
        return False
    for exact in (np.float32, np.float64):
        parts, letters = model.strengths(grams, np.array(bounds), exact)
        over = float((parts.max(axis=1) - parts[:, LANGUAGES.index(main)]).max()) - 0.7
        if abs(over) > 4e-6 * float(letters.max()) ** 1.5:  # more than what short sums may be off by
            break
    return over > 0


def _other_lines(text: str, article: bool = False) -> list[tuple[int, int]]:
    """Where the lines of lists, tables and junk are in a text, in characters; in articles those that are no running text or headings."""
    other: set[str] = set()
    for shape, lines in structure._runs(text):
        if shape != "neutral" and ((shape != "plain" or _machine(lines)) if article else structure._assign(shape, lines).kind in ("list", "table", "junk")):
            other.update(lines)
    out = []
    if other:
        for m in _WHOLE_LINE.finditer(text):
            if m[0].rstrip("\r\n") in other:
                out.append(m.span())
    return out


def stretches(text: str, model: Model, other: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str, float, int]]:
    """Maximal runs of whole sentences in one language: (start, end, language, confidence, letters), offsets in UTF-8 bytes.

    The sequence of languages is the likeliest under a cost for each change, so
    short headings and names follow their neighbours.  Lists, tables and junk have no say;
    ``other`` tells where they are, if that is known.
    """
    found = sentences.sentences(text)
    if not found:
        return []
    inside = np.zeros(len(text) + 1, np.int32)
    for a, b in _other_lines(text) if other is None else other:
        inside[a + 1 : b + 1] = 1
    inside = np.cumsum(inside)
    begins, at = [], 0
    for _, _, s in found:
        begins.append(text.index(s, at))
        at = begins[-1] + len(s)
    begin, size = np.array(begins), np.array([len(s) for _, _, s in found])
    grams = model.grams(text)
    # between sentences there are no letters
    scores, letters = model.strengths(grams, np.append(np.searchsorted(grams.where, begin, "right"), len(grams.where)))
    mute = (2 * (inside[begin + size] - inside[begin]) > size) | (letters < 2) | (scores.max(axis=1) < LEAST * np.sqrt(letters))
    scores[mute] = 0
    sizes = np.where(mute, 0, letters).tolist()
    if not any(sizes):
        return []
    total, *rows = scores.tolist()
    back = []  # each sentence's totals, and the least that stays in its language
    for row in rows:
        least = max(total) - CHANGE
        back.append((total, least))
        total = [(x if x >= least else least) + y for x, y in zip(total, row, strict=True)]
    path = [total.index(max(total))]
    for total, least in reversed(back):
        path.append(path[-1] if total[path[-1]] >= least else total.index(max(total)))
    path.reverse()
    out: list[tuple[int, int, str, float, int]] = []
    second, most = np.partition(scores, -2, axis=1)[:, -2:].T
    for (a, b, _), k, size, first, lead in zip(found, path, sizes, scores.argmax(axis=1).tolist(), (most - second).tolist(), strict=True):
        if not size:
            if out:
                out[-1] = (out[-1][0], b, *out[-1][2:])
            continue
        sure = 1 / (1 + math.exp(-4.0 * lead)) if first == k else 0.5
        if out and out[-1][2] == LANGUAGES[k]:
            out[-1] = (out[-1][0], b, out[-1][2], max(out[-1][3], sure), out[-1][4] + size)
        else:
            out.append((a, b, LANGUAGES[k], sure, size))
    return out


def _places(text: str) -> np.ndarray:
    """Where each character of a text begins in its UTF-8 bytes, and where the last one ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate(([0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))))


def article_stretches(text: str, model: Model) -> list[tuple[int, int, str, float, int]]:
    """``stretches`` of what an article shows: preamble, comments and markup have no say.  Offsets are those of the whole text."""
    at = list(range(len(text)))
    shown = structure._shown(text, True, at)
    plain = _blanked(shown)
    found, inside, whole = stretches(plain, model, _other_lines(shown, True)), _places(plain), _places(text)
    spans = np.searchsorted(inside, [x[:2] for x in found]).tolist()
    return [(int(whole[at[a]]), int(whole[at[b - 1] + 1]), *rest) for (a, b), (_, _, *rest) in zip(spans, found, strict=True)]


RESULT = "item_id string, label string, segment int, lang string, confidence double, start int, end_offset int"
_SCHEMA = pa.schema([("item_id", pa.string()), ("label", pa.string()), ("segment", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("start", pa.int32()), ("end_offset", pa.int32())])


def document_languages(docs: DataFrame, model: Model) -> DataFrame:
    """``item_id, label, segment, lang, confidence, start, end_offset``: segment 0 of every article, over its whole text,
    and segments 1, 2, ... of articles in several languages.

    ``docs``: ``item_id, label, text``; the label is handed on.
    Articles without running text, and blank and null ones, have a null language and confidence 0.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows: list[tuple] = []
                for key, label, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    rows += [(key, label, *rest) for rest in _segments(text, known.value, article=True)]
                yield _batch(rows)

    return docs.select("item_id", "label", "text").mapInArrow(run, RESULT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _SCHEMA]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def request_languages(requests: DataFrame, model: Model, pairs: encoding_repair.PairCounts) -> DataFrame:
    """As ``document_languages``, and segments 1, 2, ... of requests in several languages.

    Texts in a wrong encoding (told with the pair model ``pairs``) have a null language.
    """
    known = requests.sparkSession.sparkContext.broadcast((model, pairs._replace(rest=None)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, counts = known.value
        odd = encoding_repair.PairModel(counts)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows: list[tuple] = []
                for key, label, text, counted in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    odd.rest = dict(counted or ())
                    rows += [(key, label, *rest) for rest in _segments(text, fitted, odd)]
                yield _batch(rows)

    return encoding_repair.with_rest(requests, "item_id", pairs).select("item_id", "label", "text", "rest").mapInArrow(run, RESULT)


def garbled(text: str, odd: encoding_repair.PairModel) -> bool:
    """Whether some line of a text was decoded with a wrong encoding."""
    if text.isascii():
        return False
    if "\ufffd" in text:
        return True
    if not encoding_repair.may_be_suspect(text):
        return False
    return any(x[1] > -encoding_repair.PRIOR for _, line in encoding_repair._parts(text) for x in encoding_repair.mend(line, odd)[:1])


def _segments(text: str | None, model: Model, odd: encoding_repair.PairModel | None = None, article: bool = False) -> list[tuple]:
    """(segment, language, confidence, start, end) of a text, and of its stretches where it is in several languages."""
    size = len((text or "").encode("utf-8", "surrogatepass"))
    if not text or text.isspace() or odd is not None and garbled(text, odd):
        return [(0, None, 0.0, 0, size)]
    running = running_text(text, article)
    grams = model.grams(running)
    lang, sure = main_language(running, model, grams)
    if lang is None:
        return [(0, None, 0.0, 0, size)]
    if not mixed(running, model, lang, grams):
        return [(0, lang, sure, 0, size)]
    parts = article_stretches(text, model) if article else stretches(text, model)
    letters: dict[str, int] = {}
    for _, _, k, _, n in parts:
        letters[k] = letters.get(k, 0) + n
    if len(letters) < 2:
        return [(0, lang, sure, 0, size)]
    main = max(letters, key=lambda x: (letters[x], x))
    share = letters[main] / sum(letters.values())
    return [(0, main, share * max(x[3] for x in parts if x[2] == main), 0, size), *((i, k, c, a, b) for i, (a, b, k, c, _) in enumerate(parts, 1))]
