"""Sentences of texts in many languages and scripts (problem 2).

Method: a semi-Markov model.  Every place where a sentence might end is a
candidate; dynamic programming chooses whole spans between candidates, scoring
each span's length, its opening word, its closing word and the balance of the
quotation marks and brackets in it, jointly.

The end of a paragraph (a blank line) always ends a sentence, other line breaks
never do.  Offsets are UTF-8 bytes of the original text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words with a full stop that always go on (fixed values).
GOES_ON = frozenset(
    "dr dra prof profa mr mrs ms mme mlle st sr sra srta fig figs sec secs no nos nr núm num vol vols p pp pág págs pag cf vs e.g i.e approx ca eq eqs ch ed eds ref refs "
    "jan feb mar apr jun jul aug sep sept oct nov dec abb tab bd bzw vgl z.b d.h u.a evtl ggf inkl s hr fr ex ej c.-à-d av art chap m "
    "рис стр табл см проф гл гг ул им акад т.е т.к ср напр डॉ प्रो पृ सं श्री د أ ดร พ.ศ ค.ศ น.ส".split()
)
#: Words with a full stop that end a sentence only before a likely opening (fixed values).
MAY_END = frozenset("al etc usw p.m a.m u.s co inc ltd corp др пр г т.д т.п т п д e.a b.c k.a o.ä h b c d u a.d".split())
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jahrhundert auflage kapitel".split())
#: Words that open sentences (fixed values).
OPENINGS = frozenset(
    "the a an in on at as by it we for to no few during with over after our this that there if when however neither der die das ein eine wir im am es nach für trotz laut wie zum weder "
    "le la les un une il elle nous on en pour selon après comme malgré à ni el los las una se por según en como no nadie hemos o os as um uma não nem por à segundo como depois apesar "
    "мы в на по после ни как судя трудно это он она они если".split()
)
#: Words after dots or a quotation that carry a sentence on (fixed values).
CARRIES_ON = frozenset(
    "and but or asked wrote said replied und aber oder schrieb fragte sagte et mais ou puis écrit demande demanda répondit dit y pero o escribió preguntó dijo e mas escreveu perguntou disse "
    "и но а или писал писала спросил спросила сказал ثم لكن و और लेकिन पर लिखा पूछा कहा".split()
)
_GO_ON_CJK = re.compile(r"但是|但|而且|而|不过|然而|他问|她问|他说|她说|他写|问道|说道|と|って|という|の|は[^、]|が")
_CONJUNCTION_END = re.compile(r"(?:[がけどらし、，,]|て|久)$")

_PARAGRAPH = re.compile(r"(?:\r\n?|\n)(?:[^\S\r\n]*(?:\r\n?|\n))+")
_CLOSERS = "\"'”’»›」』）)\\]】〉》"


def _pattern(closers: str) -> re.Pattern:
    """Stops with the closing marks after them, and spaces between Thai words."""
    return re.compile(
        rf"(?P<stop>[.!?…。！？｡．؟।॥‽]+)(?P<shut>(?:[ \u00a0\u202f]?»|[{closers}])*)(?P<gap>\s*)(?=\S)"
        r"|(?<=[฀-๿])(?P<thai>[ \u00a0\u202f\n]+)(?=[฀-๿A-Z«“\"(])"
    )


_CANDIDATE, _CANDIDATE_LOW = _pattern(_CLOSERS), _pattern(_CLOSERS + "“")
_MARK = re.compile(r"[“”„«»‹›「」『』（）()\[\]【】《》\"]")
_PAIR = {"”": "“„", "»": "«", "›": "‹", "」": "「", "』": "『", "）": "（", ")": "(", "]": "[", "】": "【", "》": "《"}
_ROUND = "(（[【"
_WORD = re.compile(r"[^\W\d_]+")
_BEFORE = re.compile(r"[^\s(（\[“”„«\"'‘—–-]+$|c\.-à-d$", re.IGNORECASE)
_TAIL = re.compile(r"[.!?)»”’]")
_SPACELESS = re.compile("[぀-ヿ㐀-鿿！-￯]")
LONGEST = 40  # candidates a sentence may pass over, those within quotations and brackets not counted


def _enclosed(text: str) -> list[tuple[int, int]]:
    """Matched pairs of quotation marks and brackets, as (place of the opening, place of the closing)."""
    stack: list[tuple[str, int]] = []
    out = []
    for m in _MARK.finditer(text):
        c, at = m[0], m.start()
        if c == '"' or c == "“" and any(x == "„" for x, _ in stack):
            opener = '"' if c == '"' else "„"
        else:
            opener = _PAIR.get(c)
        if opener is None or c == '"' and not any(x == '"' for x, _ in stack):
            stack.append((c, at))
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in opener:
                out.append((stack[k][1], at))
                del stack[k:]
                break
    return sorted(out)


def _closing(text: str, stop: str, at: int, shouted: bool, nxt: str) -> float:
    """What the words before a stop say about a sentence ending there."""
    dots = len(stop) > 2 and set(stop) <= set(".…") or "…" in stop
    if dots:
        return -5.0 if _CONJUNCTION_END.search(text[max(0, at - 3) : at]) else 1.5
    if stop[-1] not in ".．":
        return 3.5
    m = _BEFORE.search(text, max(0, at - 16), at)
    word = (m[0] if m else "").lower().rstrip(".")
    if not word:
        return 2.0
    tail = _TAIL.split(word)[-1]  # the last sentence may lack its space: "plan.No. 4"
    if word in GOES_ON or tail in GOES_ON:
        return -9.0
    if word in MAY_END or tail in MAY_END:
        return -2.5
    if word.isdigit():
        if not text[: m.start()].strip():
            return -9.0  # the number of a heading or an entry
        if nxt.lower() in MONTHS:
            return -9.0
    if len(word) == 1 and word.isalpha() and not _SPACELESS.match(word):
        return -3.5
    return 2.5


def _opening(text: str, at: int, stop: str, cased: bool, shouted: bool) -> float:
    """What the text from ``at`` on says about a sentence starting there."""
    while at < len(text) and text[at] in "\"'“„«‘(（[「『¿¡   —–":
        at += 1
    if at >= len(text):
        return 0.0
    c = text[at]
    m = _WORD.match(text, at)
    word = m[0].lower() if m else ""
    dots = "…" in stop or stop.startswith("...")
    if _SPACELESS.match(c):
        if _GO_ON_CJK.match(text, at) and (dots or text[at - 1] in _CLOSERS):
            return -6.0
        return 0.5
    if word in CARRIES_ON and (dots or text[at - 1] in _CLOSERS or (text[at - 1].isspace() and text[max(0, at - 2)] in _CLOSERS)):
        return -8.0
    if c.islower() and cased:
        return -9.0
    if c.isdigit():
        return -1.0
    if word in OPENINGS:
        return 2.5
    if c.isupper() and not shouted:
        return 1.0
    if c in ",;:،，；：、)）」”»":
        return -9.0
    return 0.0


def _thai(text: str, start: int, end: int) -> float | None:
    """Score of a space between Thai words; null where a number or a date goes on."""
    if text.startswith(("พ.ศ", "ค.ศ", "น."), end) or text[end].isdigit():
        return None
    before = text[max(0, start - 12) : start]
    if re.search(r"(?:และ|หรือ|กับ|ของ|ที่|ว่า|โดย|จาก|ใน|ถึง|เป็น|ปี|คือ|ๆ)$", before) and not before.endswith("หรือ"):
        return -1.5
    return 2.5


def _candidates(text: str) -> list[tuple[int, float, tuple[int, int] | None, bool]]:
    """Places where a sentence may start after another: (place, score, pair closed just before, with its stop inside; whether it is within a pair)."""
    upper = sum(map(str.isupper, text))
    cased = upper > 0
    # most texts have small letters enough at their beginning
    shouted = cased and all(upper > 4 * sum(map(str.islower, part)) for part in (text[: upper + 64], text)) and upper > 0.8 * sum(map(str.isalpha, text))
    pairs = _enclosed(text) if _MARK.search(text) else []
    starts = [a for a, _ in pairs]
    furthest = list(accumulate((b for _, b in pairs), max))  # of all pairs that begin so early, the last end
    closed = {b: (a, b) for a, b in pairs}
    out: list[tuple[int, float, tuple[int, int] | None, bool]] = []
    for m in (_CANDIDATE_LOW if "„" in text else _CANDIDATE).finditer(text):
        if m["thai"] is not None:
            at, score, pair = m.end(), _thai(text, m.start("thai"), m.end()), None
            if score is None:
                continue
        else:
            stop, gap, at = m["stop"], m["gap"], m.end()
            place = m.start("stop")
            nxt = text[at]
            if nxt in ",;:،，；：、":
                continue
            full = stop[-1] in "。！？｡．।॥" or "…" in stop and _SPACELESS.match(text[place - 1 : place] or "x")
            if not gap and not full and not m["shut"]:
                before, after = text[place - 1 : place], text[at : at + 2]
                if _SPACELESS.match(nxt) and (_SPACELESS.match(before) or stop[-1] in "!?"):
                    pass
                elif stop[0] in "!?؟" and len(after) > 1 and nxt.isalpha():
                    pass
                elif not (before.isalpha() and not before.isupper() and text[place - 2 : place - 1].isalpha() and nxt.isupper() and (after[1:].islower() or after[1:].isspace()) or before in ")]" and nxt.isupper()):
                    continue
            elif not gap and not full and not (nxt.isupper() or _SPACELESS.match(nxt) or nxt in "“«„\"(「¿¡" or not nxt.isascii()):
                continue
            if stop == "．" and text[place - 1 : place].isdigit() and nxt.isdigit():
                continue
            word = _WORD.match(text, at)
            score = _closing(text, stop, place, shouted, word[0] if word else "")
            if shouted and score < 2 and score > -5:
                score -= 1
            score += _opening(text, at, stop, cased, shouted)
            pair = None
            if m["shut"]:
                last = m.end("shut") - 1
                pair = closed.get(last)
        # a place inside a pair would leave its sentences unbalanced
        k = bisect_left(starts, at)
        within = k > 0 and furthest[k - 1] >= at
        out.append((at, score - 12.0 if within else score, pair, within))
    return out


def spans(text: str) -> list[tuple[int, int]]:
    """Sentences of one paragraph as (start, end) in characters, without surrounding space."""
    n = len(text.rstrip())
    first = len(text) - len(text.lstrip())
    if first >= n:
        return []
    found = [c for c in _candidates(text) if first < c[0] < n]
    if not found:
        return [(first, n)]
    places = [first, *(c[0] for c in found), n]
    last = len(places) - 1
    best, back = [0.0] + [-math.inf] * last, [0] * (last + 1)
    outside = [0]  # places outside of all pairs, so that a quotation is passed over however much it holds
    for j in range(1, last + 1):
        at, score, pair, within = found[j - 1] if j < last else (n, 0.0, None, False)
        near = max(0, j - LONGEST)
        for i in [*range(j - 1, near - 1, -1), *(i for i in reversed(outside[-LONGEST:]) if i < near)]:
            value = best[i] + score + _length(at - places[i])
            if pair is not None:
                # a stop inside brackets or quotation marks ends the sentence if they enclose all of it, or follow a colon
                whole = pair[0] == places[i]
                if text[pair[0]] in _ROUND:
                    value += 1.0 if whole else -8.0
                elif not whole and text[: pair[0]].rstrip()[-1:] not in (":", "：", ",", "،", "、"):
                    value -= 1.0
            if value > best[j]:
                best[j], back[j] = value, i
        if not within:
            outside.append(j)
    out, j = [], last
    while j:
        i = back[j]
        out.append((places[i], places[i] + len(text[places[i] : places[j]].rstrip())))
        j = i
    return out[::-1]


def _length(chars: int) -> float:
    """Logarithm of a span length's likelihood, up to a constant: very short and very long spans are rare."""
    return -3.0 if chars < 4 else -0.8 if chars < 12 else 0.0 if chars < 600 else -0.5


def sentences(text: str | None) -> list[tuple[int, int, str]]:
    """Sentences of a text as (start, end, text); offsets are UTF-8 bytes.  None of a null or blank text."""
    out: list[tuple[int, int, str]] = []
    if not text or text.isspace():
        return out
    ascii_only, begin, byte, at = text.isascii(), 0, 0, 0
    for stop in [*((m.start(), m.end()) for m in _PARAGRAPH.finditer(text)), (len(text), len(text))]:
        paragraph = text[begin : stop[0]]
        for a, b in spans(paragraph):
            sentence = paragraph[a:b]
            if ascii_only:
                out.append((begin + a, begin + b, sentence))
            else:
                byte += len(text[at : begin + a].encode("utf-8", "surrogatepass"))
                end = byte + len(sentence.encode("utf-8", "surrogatepass"))
                out.append((byte, end, sentence))
                byte, at = end, begin + b
        begin = stop[1]
    return out


def split_sentences(requests: DataFrame, id_column: str = "request_id", text_column: str = "text") -> DataFrame:
    """``id_column, sent_index, start, end_offset, text`` of every sentence, each row's text once.

    Rows with the same id are expected to be one (see ``one_row``); null and blank
    texts have no sentences.
    """
    schema = pa.schema([("key", pa.string()), ("sent_index", pa.int32()), ("start", pa.int32()), ("end_offset", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                columns: tuple[list, ...] = ([], [], [], [], [])
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for i, (start, end, inside) in enumerate(sentences(text)):
                        for column, value in zip(columns, (key, i, start, end, inside), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    chosen = requests.select(F.col(id_column).cast("string").alias("key"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(run, "key string, sent_index int, start int, end_offset int, text string").withColumnRenamed("key", id_column)


def one_row(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """One row a key, dropping null keys; rows of a key carry the same text, so any serves."""
    return requests.where(F.col(key).isNotNull()).dropDuplicates([key])
