"""Finding and restoring text that was decoded with the wrong encoding (problem 6).

Method: each line of a record has a latent *encoding chain*: none, or (written
in A, read as B), once or twice.  A model of character pairs, counted over all
texts, says how likely a line is as it stands and with each possible chain
undone.  Expectation-maximization estimates how often each chain occurs among
all lines of each source and field, with the whole corpus as a prior, so that
weak evidence in a record is pooled with its neighbours' and evidence against a
whole source counts as well; the posterior decides on each line.  It works on
counts by source, field, chain and strength of evidence, a small table however
many the lines.

Chains are tried on lines that show a cheap sign (``PairModel.suspects``): trying
them on every line costs many times as much.
"""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from operator import concat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from textloom.checkpoints import cut
from textloom.functions.text import let
from textloom.operators.split import mark_for

#: Encodings that texts are written in, and those they are wrongly read as (fixed values).
WRITTEN = ["utf-8", "cp1252", "cp1251", "koi8_r", "cp866", "cp850", "gb18030", "big5", "shift_jis", "euc_jp", "cp1256", "cp874", "mac_roman"]
READ = ["latin_1", "cp1252", "cp1251", "koi8_r", "cp437", "cp850", "cp866", "mac_roman", "gb18030", "shift_jis", "euc_jp", "big5", "cp1250", "cp1256", "cp874"]
_WIDE = ("gb18030", "big5", "shift_jis", "euc_jp")
NONE, LOST = "none", "lost"
#: Natural logarithm of the odds of a chain before any evidence, where expectation-maximization starts; per further step the same again.
PRIOR = -6.0
#: Gains up to this are none: the same pairs added up in another order.
ROUNDING = 1e-6
_PIECES = re.compile(r"\S+")
_LINES = re.compile(r"(\r\n|\r|\n)")
#: Runs without letters of the scripts that are never a single-byte misreading.
_NARROW = re.compile("[^\u0590-\u0e7f\u2e80-\ud7ff\uf900-\ufdff\ufe30-\ufeff\uff01-\uffdc]+")
_HIGH = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+[\x00-\x7f]?")
_REPLACED = re.compile("\ufffd")
#: Letters of Cyrillic and Latin that are drawn alike (fixed values), so that mixed words are no sign of a wrong encoding.
_ALIKE = ("аАеЕоОрРсСхХуУіІјЈѕЅһВНКМТвнкмтгпиΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναρικτυ", "aAeEoOpPcCxXyYiIjJsShBHKMTBHKMTrnuABEZHIKMNOPTYXovapiktu")
_TO_LATIN = str.maketrans(*_ALIKE)
_TO_CYRILLIC = str.maketrans("aAeEoOpPcCxXyYBHKMTiIsSjJ", "аАеЕоОрРсСхХуУВНКМТіІѕЅјЈ")
#: Letters and symbols for ``_SIGN`` and ``_MIXED``.
_LOWER, _UPPER, _ODD, _ACCENTED = "a-zà-öø-ÿ", "À-ÖØ-ÞŠŒŽŸ", "ЂЃђѓЄєЉЊЌЋЏЎљњќћџўҐґ", "À-ÖØ-öø-ÿ"
_ALONE, _CAPITAL, _KANA = "\x80-\x9f\ufffd\u2500-\u25ff\ue000-\uf8ff" + _ODD, "А-ЯЀ-Џ", "ｦ-ﾟ€"
_INNER = "‚ƒ„…†‡ˆ‰‹‘“”•–—˜™›œž"
_AFTER_ACCENT = "\xa1-\xac\xae-\xbf×÷€’šŒŠŽŸ" + _INNER
_AFTER_LETTER = "¡-§©-ª¬®-¶¸-¹¼-¿×÷√∂∑∏∫≈∆◊ˇ˘˙˚˛˝≤≥≠∞"
_OTHER = "бджзйлфцчшщъыьэюяБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯΓΔΘΛΞΠΣΦΨΩβδεζθλμξπσφψω"
#: What a wrongly decoded line shows and a sound one hardly does: stray controls
#: and frames, symbols stuck to letters, capitals within words.  The class that
#: begins it holds the character each sign ends at or turns on, rare in most texts,
#: so that a search skips all others.
_SIGN = re.compile(
    f"[{_ALONE}\xa0\xad{_AFTER_ACCENT}{_AFTER_LETTER}{_ACCENTED}{_UPPER}{_INNER}{_CAPITAL}{_KANA}]"
    f"(?:(?<=[{_ALONE}])|(?<=[{_ACCENTED}][{_AFTER_ACCENT}])|(?<=Ã[\xa0\xad])"
    f"|(?<=[^\\W\\d_][{_AFTER_LETTER}])"
    f"|(?<=[{_ACCENTED}]{{3}})"
    f"|(?<=[{_LOWER}][{_UPPER}])|(?<=[{_LOWER}][{_INNER}])(?=[{_LOWER}])"
    f"|(?<=[а-џ][{_CAPITAL}])"
    f"|(?<=[一-鿿][{_KANA}])|(?<=[{_KANA}])(?=[一-鿿]))"
)
#: The same of mixed scripts, for lines that have Latin letters.
_MIXED = re.compile(f"[{_OTHER}άέήίόύώ](?:(?<=[A-Za-z].)|(?<=[{_OTHER}])(?=[A-Za-z]))")
_LATIN = re.compile("[A-Za-z]")
_HAN = re.compile("[一-鿿가-힣]{4,}")


def _controls(error: UnicodeError) -> tuple[bytes, int]:
    """Bytes without a character in a code page were passed through as controls."""
    lacking = error.object[error.start : error.end]
    if all("\x80" <= c <= "\x9f" for c in lacking):
        return lacking.encode("latin_1"), error.end
    raise error


codecs.register_error("textloom.controls", _controls)


def _as_bytes(text: str, read: str) -> bytes | None:
    """The bytes that ``read`` turned into ``text``; null where it can't have."""
    try:
        return text.encode(read, "textloom.controls" if read in ("cp1252", "cp1250", "cp1251") else "strict")
    except UnicodeEncodeError:
        return None


class PairCounts(NamedTuple):
    """How often pairs of characters occur, and each character as the first and as the second of any pair."""

    pairs: dict[str, int]
    first: dict[str, int]
    char: dict[str, int]
    rest: DataFrame | None = None  # ``pair, n`` of all other pairs, where there are more than are held

    @classmethod
    def of(cls, pairs: dict[str, int]) -> PairCounts:
        first: Counter = Counter()
        char: Counter = Counter()
        for pair, n in pairs.items():
            first[pair[0]] += n
            char[pair[1]] += n
        return cls(pairs, first, char)


class _Runs(dict):
    """Values of short runs of characters, which come back in many texts: kept once worked out, up to a number that bounds memory."""

    KEPT, SHORT = 200_000, 8

    def __init__(self, value: Callable[[str], float]):
        super().__init__()
        self.value = value

    def __missing__(self, run: str) -> float:
        value = self.value(run)
        if len(self) < self.KEPT:
            self[run] = value
        return value


def _shows_sign(text: str) -> bool:
    """Whether a text shows what wrongly decoded ones do."""
    return bool(_SIGN.search(text) or _LATIN.search(text) and _MIXED.search(text))


def may_be_suspect(text: str) -> bool:
    """False where no line of a text can be one of ``PairModel.suspects``."""
    return _shows_sign(text) or bool(_HAN.search(text))


class PairModel:
    """Logarithms of P(second | first) of character pairs with a character beyond ASCII."""

    def __init__(self, counts: PairCounts | dict[str, int]):
        self.pairs, self.first, self.char, _ = counts if isinstance(counts, PairCounts) else PairCounts.of(counts)
        self.rest: dict[str, int] = {}  # of the pairs that aren't held, those of the record at hand (``with_rest``)
        self.total = sum(self.char.values()) + 1
        self.rare = max(1, self.total * 1e-7)
        self.common = {pair for pair, n in self.pairs.items() if n > self.rare}
        self.known: dict[str, float] = {}
        self.runs = _Runs(self.of_run)
        self.told: dict[str, list[tuple[str, float, str]]] = {}

    def of_pair(self, pair: str) -> float:
        value = self.known.get(pair)
        if value is None:
            # a character's own share stands in for the pairs it lacks
            share = (self.char.get(pair[1], 0) + 0.0001) / self.total
            value = math.log(((self.pairs.get(pair) or self.rest.get(pair, 0)) + 50 * share) / (self.first.get(pair[0], 0) + 50))
            self.known[pair] = value
        return value

    def lost(self, line: str) -> float:
        """What the replacement characters of a line say for a loss: the less of them the corpus holds, the more each of them."""
        share = (self.char.get("\ufffd", 0) + 1) / self.total
        return -math.log(share) * len(_REPLACED.findall(line))

    def suspects(self, line: str) -> bool:
        """Whether a line is worth an explanation: it shows a sign, or most of its ideographs are rare neighbours."""
        if _shows_sign(line):
            return True
        rare, most, common, rest = 0, self.rare, self.common, self.rest
        runs = _HAN.findall(line)
        for run in runs:
            if rest:
                rare += sum(pair not in common and rest.get(pair, 0) <= most for pair in map(concat, run, run[1:]))
            else:
                rare += len(run) - 1 - sum(map(common.__contains__, map(concat, run, run[1:])))
        return 2 * rare > sum(map(len, runs)) > 0

    def of_run(self, run: str) -> float:
        """The sum over the pairs of a run."""
        total, of_pair, known = 0.0, self.of_pair, self.known
        for pair in map(concat, run, run[1:]):
            total += known[pair] if pair in known else of_pair(pair)
        return total

    def of(self, text: str, least: float = -math.inf) -> float:
        """The logarithm of a text's probability; where that isn't above ``least``, any number that isn't.

        No pair adds to it, so a sum that has come down to ``least`` needs no more of the text.
        """
        total, value = 0.0, self.runs.__getitem__
        for found in _HIGH.finditer(text):
            run = found[0]
            if len(run) <= _Runs.SHORT:
                total += value(run)
                if total <= least:
                    break
                continue
            for at in range(0, len(run) - 1, 32):
                total += self.of_run(run[at : at + 33])
                if total <= least:
                    return total
        return total


class _Asking(PairModel):
    """Collects the pairs, beyond those held, that explaining a line may look up."""

    def __init__(self, counts: PairCounts):
        super().__init__(counts)
        self.asked: set[str] = set()

    def _ask(self, runs: list[str]) -> None:
        self.asked.update(pair for run in runs for pair in map(str.__add__, run, run[1:]) if pair not in self.pairs)

    def of(self, text: str, least: float = -math.inf) -> float:
        self._ask(_HIGH.findall(text))
        return 0.0

    def suspects(self, line: str) -> bool:
        self._ask(_HAN.findall(line))
        return super().suspects(line)  # pairs that aren't held pass for rare, so no line is missed


def undo(text: str, written: str, read: str) -> str | None:
    """``text`` as it was before its ``written`` bytes were read as ``read``; null if it can't have been."""
    raw = _as_bytes(text, read)
    if raw is None:
        return None
    try:
        out = raw.decode(written)
    except UnicodeDecodeError:
        return None
    return None if out == text else out


def explanations(line: str, model: PairModel, depth: int = 2) -> list[tuple[str, float, str]]:
    """(chain, gain, original): the chains that may lie behind ``line``, and how much likelier each makes it."""
    now = model.of(line)
    for alike in (_TO_LATIN, _TO_CYRILLIC):
        now = max(now, model.of(line.translate(alike), now))
    least, out, seen = now + ROUNDING, [], {}
    for read in READ:
        raw = _as_bytes(line, read)
        if raw is None or raw in seen:
            continue
        seen[raw] = read
        for written in WRITTEN:
            if written == read:
                continue
            try:
                was = raw.decode(written)
            except UnicodeDecodeError:
                continue
            if was == line:
                continue
            again = depth > 1 and not was.isascii() and written == "utf-8"
            value = model.of(was, -math.inf if again else least)
            gain = value - now
            if again:
                for chain, more, first in explanations(was, model, depth - 1):
                    if more > 3:
                        out.append((f"{written}>{read}+{chain}", gain + more, first))
            if value > least:
                out.append((f"{written}>{read}", gain, was))
    return out


def _parts(text: str) -> Iterator[tuple[int, str]]:
    """Lines with characters beyond ASCII, and their place in the text's lines."""
    for i, line in enumerate(_LINES.split(text)):
        if i % 2 == 0 and line and not line.isascii():
            yield i, line


def mend(line: str, model: PairModel) -> list[tuple[str, float, str]]:
    """Chains of a line; where none fits the whole line, chains of its words, all others kept."""
    if not model.suspects(line):
        return []
    whole = [x for x in explanations(line, model) if x[1] > ROUNDING]
    if whole:
        return sorted(whole, key=lambda x: (-x[1], x[0]))
    mended: dict[str, tuple[float, dict[str, str]]] = {}
    for piece in {x for pattern in (_PIECES, _NARROW) for x in pattern.findall(line)}:
        if piece.isascii() or not _shows_sign(piece):
            continue
        if piece not in model.told:
            model.told[piece] = explanations(piece, model)
        for chain, gain, was in model.told[piece]:
            # a short piece is turned into two-byte characters by chance
            if gain > (20 if chain.startswith(_WIDE) else 4):
                total, pieces = mended.setdefault(chain, (0.0, {}))
                pieces[piece] = was
                mended[chain] = (total + gain, pieces)
    out = []
    for chain, (gain, pieces) in sorted(mended.items(), key=lambda x: (-x[1][0], x[0])):
        was = line
        for piece in sorted(pieces, key=len, reverse=True):
            was = was.replace(piece, pieces[piece])
        out.append((chain, gain, was))
    return out


def count_pairs(texts: DataFrame, column: str = "text") -> DataFrame:
    """``pair, n``: how often each pair of characters occurs that has one beyond ASCII, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                _add_pairs("\n".join(t for t in batch.column(0).slice(at, 2048).to_pylist() if t), counts)
            if len(counts) > 500_000:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    return texts.select(column).mapInArrow(run, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _add_pairs(text: str, counts: Counter) -> None:
    """Adds the pairs of a text to ``counts``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(codes) < 2:
        return
    high = codes > 0x7F
    pairs = (codes[:-1] << 21 | codes[1:])[high[:-1] | high[1:]]
    found, n = np.unique(pairs, return_counts=True)
    for pair, k in zip(found.tolist(), n.tolist(), strict=True):
        a, b = pair >> 21, pair & 0x1FFFFF
        if not (0xD800 <= a < 0xE000 or 0xD800 <= b < 0xE000):
            counts[chr(a) + chr(b)] += k


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pair", "n"])


def fit_pairs(texts: DataFrame, column: str = "text", pairs_kept: int = 300_000) -> PairCounts:
    """The pairs of ``count_pairs``, and every character's counts over all pairs, of which there are no more than characters.

    ``pairs_kept`` bounds what is broadcast, the commonest pairs; the counts of all
    others stay in the table ``rest``, from which ``with_rest`` fetches them.
    """
    counted = cut(count_pairs(texts, column).where("pair is not null"))
    rows = counted.orderBy(F.desc("n"), "pair").limit(pairs_kept + 1).collect()
    rest = None
    if len(rows) > pairs_kept:
        least = rows.pop()
        rest = counted.where((F.col("n") < least.n) | (F.col("n") == least.n) & (F.col("pair") >= least.pair))
    single = lambda place: {r.c: r.n for r in counted.groupBy(F.substring("pair", place, 1).alias("c")).agg(F.sum("n").alias("n")).collect()}
    return PairCounts({r.pair: r.n for r in rows}, single(1), single(2), rest)


def with_rest(records: DataFrame, key: str, pairs: PairCounts) -> DataFrame:
    """``records`` with ``rest``: the counts of the pairs that explaining a record's ``text`` may look up and that aren't held.

    Only where ``pairs`` doesn't hold all are the lines' pairs sent to the counts and back.
    """
    if pairs.rest is None:
        return records.withColumn("rest", F.lit(None).cast("map<string,bigint>"))
    known = records.sparkSession.sparkContext.broadcast(pairs._replace(rest=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, asked = _Asking(known.value), [], []
        for batch in batches:
            for k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                model.asked.clear()
                model.told.clear()
                for _, line in _parts(text or ""):
                    mend(line, model)
                keys += [k] * len(model.asked)
                asked += model.asked
                if len(keys) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(asked, pa.string())], names=[key, "pair"])
                    keys, asked = [], []
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(asked, pa.string())], names=[key, "pair"])

    found = records.select(key, "text").mapInArrow(run, f"{key} string, pair string").join(pairs.rest, "pair")
    return records.join(found.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("pair", "n"))).alias("rest")), key, "left")


EVIDENCE = pa.schema([
    ("source", pa.string()), ("field", pa.string()), ("request_id", pa.string()), ("line", pa.int32()), ("chain", pa.string()),
    ("gain", pa.float64()), ("share", pa.float64()), ("total", pa.float64()), ("original", pa.string()),
])
#: Gains beyond this say no more.
SURE = 60.0


def evidence(records: DataFrame, pairs: PairCounts) -> DataFrame:
    """``source, field, request_id, line, chain, gain, share, total, original``: every possible chain of every line.

    ``records``: ``request_id, source, field, text``.  ``total`` is what all chains
    of a line say together, ``share`` a chain's part of it.  Lines with replacement
    characters may be of chain ``lost``.  Rows of chain ``none`` count all lines with
    a character beyond ASCII, ``line`` of them, of a source and field.
    """
    known = records.sparkSession.sparkContext.broadcast(pairs._replace(rest=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PairModel(known.value)
        for batch in batches:
            out: list[tuple] = []
            lines: Counter = Counter()
            for rid, source, field, text, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not text or text.isascii():
                    continue
                model.rest = dict(rest or ())
                for i, line in _parts(text):
                    lines[source, field] += 1
                    found = mend(line, model)
                    if _REPLACED.search(line):
                        found = [*found, (LOST, model.lost(line), line)]
                    if found:
                        gains = [min(SURE, g) for _, g, _ in found]
                        most = max(gains)
                        parts = [math.exp(g - most) for g in gains]
                        whole = sum(parts)
                        out.extend((source, field, rid, i, chain, g, p / whole, most + math.log(whole), was) for (chain, _, was), g, p in zip(found, gains, parts, strict=True))
            out.extend((source, field, None, n, NONE, 0.0, 0.0, 0.0, None) for (source, field), n in lines.items())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(EVIDENCE), EVIDENCE, strict=True)], schema=EVIDENCE)

    return with_rest(records, "request_id", pairs).select("request_id", "source", "field", "text", "rest").mapInArrow(
        run, "source string, field string, request_id string, line int, chain string, gain double, share double, total double, original string"
    )


def odds_of(found: DataFrame, rounds: int = 4, weight: float = 20.0) -> DataFrame:
    """``source, field, chain, odds``: the logarithm of each chain's odds in a source and field, by expectation-maximization.

    A chain's share is its expected number of lines over all lines there, with its
    share in the corpus worth ``weight`` lines, so it may rise or fall.  Only counts
    by source, field, chain and strength of evidence take part.
    """
    sizes = found.where(F.col("chain") == NONE).groupBy("source", "field").agg(F.sum("line").alias("lines"))
    steps = F.size(F.split("chain", r"\+"))
    cells = found.where(F.col("chain") != NONE).groupBy("source", "field", "chain", F.round("total").alias("strength")).agg(F.sum("share").alias("weight"))
    current = cut(cells.join(sizes, ["source", "field"]).withColumn("odds", PRIOR * steps))
    size = F.broadcast(cut(sizes.agg((F.sum("lines") + 1).alias("size"))))  # one row
    for _ in range(rounds):
        expected = current.withColumn("e", F.col("weight") / (1 + F.exp(-(F.col("strength") + F.col("odds")))))
        local = expected.groupBy("source", "field", "chain").agg(F.sum("e").alias("mine"))
        everywhere = expected.groupBy("chain").agg(F.sum("e").alias("all"))
        shares = local.join(everywhere, "chain")
        current = cut(
            current.drop("odds").join(shares, ["source", "field", "chain"]).crossJoin(size)
            .withColumn("s", (F.col("mine") + weight * F.col("all") / F.col("size") + 1e-9) / (F.col("lines") + weight))
            .withColumn("odds", F.log(F.col("s") / F.greatest(1 - F.col("s"), F.lit(1e-3)))).drop("mine", "all", "size", "s")
        )
    return current.groupBy("source", "field", "chain").agg(F.max("odds").alias("odds"))


def posteriors(found: DataFrame, rounds: int = 4, weight: float = 20.0) -> DataFrame:
    """The rows of ``found`` that are chains of lines, with the ``posterior`` of each: the chains of a line and ``none`` add up to 1."""
    rows = found.where(F.col("chain") != NONE).join(odds_of(found, rounds, weight), ["source", "field", "chain"])
    strength = F.exp(F.least(F.col("gain") + F.col("odds"), F.lit(SURE)))
    return rows.withColumn("posterior", strength / (1 + F.sum(strength).over(W.partitionBy("request_id", "line"))))


def garbled_lines(rows: DataFrame) -> DataFrame:
    """``request_id, line`` of lines more likely garbled than not, whichever of their chains it was."""
    return rows.groupBy("request_id", "line").agg(F.sum("posterior").alias("p")).where("p >= 0.5").select("request_id", "line")


def records_of(requests: DataFrame) -> DataFrame:
    """``request_id, source, field, text`` once a request; the source is the client, the field the genre."""
    return requests.where("request_id is not null").select(
        "request_id", F.coalesce("client_id", F.lit("")).alias("source"), F.coalesce("genre", F.lit("")).alias("field"), "text"
    )


def restored(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """``request_id, text, chains, lost``: the text of each request in ``lines`` with its best originals put in.

    ``lost`` tells that some of it can't be restored.  A request's own lines bound
    what is gathered for it.
    """
    best = lines.withColumn("k", F.row_number().over(W.partitionBy("request_id", "line").orderBy(F.desc("posterior"), "chain"))).where("k = 1")
    by_request = best.groupBy("request_id").agg(
        F.map_from_entries(F.collect_list(F.struct("line", "original"))).alias("originals"),
        F.array_sort(F.collect_set("chain")).alias("chains"),
    )
    # the even items are lines, the odd ones the line ends between them
    parts = let(mark_for(F.col("text")), lambda mark: F.split(F.regexp_replace("text", F.lit("(\r\n|\r|\n)"), F.concat(mark, F.lit("$1"), mark)), mark))
    text = F.array_join(F.transform(parts, lambda part, i: F.coalesce(F.element_at("originals", i), part)), "")
    return requests.join(by_request, "request_id").select("request_id", text.alias("text"), "chains", F.array_contains("chains", LOST).alias("lost"))
