"""What running prose looks like in each language, and the markup around it in articles."""

from __future__ import annotations

import re

#: Common function words and their share of a text's words in prose (fixed values, rounded from general usage).
FUNCTION_WORDS: dict[str, dict[str, float]] = {
    "en": {"the": 0.07, "of": 0.035, "and": 0.03, "to": 0.025, "a": 0.022, "in": 0.02, "is": 0.012, "that": 0.011, "with": 0.008, "was": 0.009, "for": 0.009, "it": 0.009, "as": 0.008, "by": 0.006, "not": 0.006, "we": 0.005, "from": 0.005, "be": 0.006, "are": 0.005, "or": 0.004, "has": 0.004, "been": 0.003, "than": 0.002, "our": 0.003},
    "de": {"die": 0.035, "der": 0.034, "und": 0.028, "in": 0.018, "das": 0.014, "den": 0.011, "von": 0.011, "zu": 0.011, "ist": 0.01, "nicht": 0.009, "mit": 0.009, "ein": 0.008, "eine": 0.008, "für": 0.008, "auf": 0.008, "als": 0.007, "sich": 0.008, "im": 0.008, "es": 0.007, "wurde": 0.004, "wird": 0.004, "einer": 0.004, "uns": 0.002, "zum": 0.003},
    "fr": {"de": 0.05, "la": 0.03, "le": 0.026, "les": 0.021, "et": 0.023, "des": 0.017, "en": 0.014, "à": 0.017, "un": 0.011, "une": 0.011, "du": 0.012, "est": 0.009, "que": 0.011, "dans": 0.009, "qui": 0.008, "pour": 0.008, "ne": 0.006, "pas": 0.006, "sur": 0.006, "par": 0.006, "plus": 0.004, "ni": 0.002, "nous": 0.003, "l": 0.02, "d": 0.015},
    "es": {"de": 0.055, "la": 0.035, "el": 0.028, "en": 0.025, "que": 0.025, "y": 0.024, "los": 0.014, "las": 0.01, "se": 0.012, "del": 0.012, "un": 0.01, "una": 0.009, "con": 0.009, "por": 0.009, "no": 0.009, "para": 0.007, "es": 0.007, "al": 0.005, "lo": 0.004, "más": 0.004, "como": 0.004, "su": 0.005, "ni": 0.002, "a": 0.016},
    "pt": {"de": 0.045, "a": 0.03, "o": 0.03, "que": 0.022, "e": 0.024, "do": 0.017, "da": 0.017, "em": 0.013, "um": 0.01, "uma": 0.009, "os": 0.01, "as": 0.007, "não": 0.008, "com": 0.008, "para": 0.008, "por": 0.006, "no": 0.008, "na": 0.008, "se": 0.007, "mais": 0.005, "dos": 0.006, "ao": 0.004, "é": 0.006, "muito": 0.002},
    "ru": {"и": 0.035, "в": 0.032, "не": 0.018, "на": 0.017, "с": 0.011, "что": 0.012, "по": 0.007, "к": 0.006, "из": 0.005, "как": 0.006, "это": 0.005, "от": 0.005, "за": 0.005, "для": 0.004, "чем": 0.002, "но": 0.005, "до": 0.003, "ни": 0.003, "мы": 0.003, "при": 0.003, "же": 0.003, "во": 0.002, "о": 0.004, "у": 0.003},
    "ar": {"في": 0.03, "من": 0.028, "على": 0.015, "أن": 0.013, "إلى": 0.011, "لا": 0.008, "ما": 0.007, "هذا": 0.005, "كل": 0.004, "مع": 0.004, "هل": 0.002, "أو": 0.003, "عن": 0.006, "التي": 0.006, "كان": 0.005, "ولا": 0.002, "ثم": 0.002, "هنا": 0.001, "دون": 0.002, "قبل": 0.002},
    "hi": {"के": 0.03, "में": 0.025, "की": 0.022, "है": 0.025, "से": 0.015, "को": 0.015, "और": 0.015, "का": 0.015, "पर": 0.01, "ने": 0.008, "यह": 0.007, "कि": 0.008, "नहीं": 0.006, "भी": 0.006, "एक": 0.007, "हैं": 0.008, "जो": 0.004, "इस": 0.006, "गया": 0.004, "न": 0.003, "हमने": 0.001, "क्या": 0.002},
    "zh": {"的": 0.05, "在": 0.02, "是": 0.02, "不": 0.018, "了": 0.014, "和": 0.014, "这": 0.012, "有": 0.012, "与": 0.008, "我": 0.008, "把": 0.004, "也": 0.005, "对": 0.006, "为": 0.006, "以": 0.006, "于": 0.005, "都": 0.006, "能": 0.005, "同": 0.003, "很": 0.003},
    "ja": {"の": 0.05, "は": 0.03, "を": 0.028, "に": 0.03, "が": 0.024, "た": 0.026, "と": 0.026, "で": 0.02, "し": 0.025, "い": 0.03, "も": 0.012, "る": 0.03, "て": 0.024, "な": 0.022, "れ": 0.012, "か": 0.012, "さ": 0.008, "う": 0.012, "り": 0.012, "よ": 0.006},
    "th": {"การ": 0.02, "ที่": 0.02, "และ": 0.01, "ใน": 0.01, "ไม่": 0.008, "ได้": 0.01, "เป็น": 0.006, "ของ": 0.006, "ว่า": 0.005, "มี": 0.006, "กับ": 0.005, "จะ": 0.004, "ให้": 0.004, "โดย": 0.004, "แล้ว": 0.003, "ถูก": 0.002, "ยัง": 0.003, "แต่": 0.002, "นี้": 0.004, "ทั้ง": 0.002},
}
#: Languages whose function words are counted as strings, for want of spaces.
UNSPACED = ("zh", "ja", "th")

_BODY = re.compile(r"\\begin\{document\}")
_END = re.compile(r"\\end\{document\}")
_COMMENT = re.compile(r"%(?<!\\%)[^\r\n]*")  # begins with its rare character, so that a search skips all others
_COMMENT_BLOCK = re.compile(r"\\begin\{comment\}.*?(?:\\end\{comment\}|\Z)|\\iffalse\b.*?(?:\\fi\b|\Z)", re.DOTALL)
_PREAMBLE = re.compile(r"\\(?:documentclass|usepackage|newcommand|renewcommand|providecommand|def|let|input|include|title|author|date|maketitle|bibliographystyle|bibliography|newtheorem|setlength)\b")
_PREAMBLE_LINE = re.compile(r"(?m)^[ \t]*" + _PREAMBLE.pattern + r"[^\r\n]*")


def less(pattern: re.Pattern, text: str, at: list[int] | None = None) -> str:
    """``text`` without what ``pattern`` matches; ``at``, where its characters come from, loses the same ones."""
    if at is not None:
        kept, last = [], 0
        for m in pattern.finditer(text):
            kept += at[last : m.start()]
            last = m.end()
        at[:] = kept + at[last:]
    return pattern.sub("", text)


def body(text: str, at: list[int] | None = None) -> str:
    """An article without its preamble and comments; any other text as it is, less comments.

    A comment's own line break stays, so lines keep their places in paragraphs.
    ``at`` is kept as by ``less``.
    """
    if "\\" not in text:
        return text
    m = _BODY.search(text)
    if m:
        end = _END.search(text, m.end())
        inside = slice(m.end(), end.start() if end else len(text))
        text = text[inside]
        if at is not None:
            at[:] = at[inside]
    if "%" in text:
        text = less(_COMMENT, text, at)
    if "comment}" in text or "\\iffalse" in text:
        text = less(_COMMENT_BLOCK, text, at)
    return less(_PREAMBLE_LINE, text, at) if _PREAMBLE.search(text) else text
