"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 7).

Method: a tokenization automaton.  Reading the merges in rank order, every rule
(u, v) -> w is one *merge gadget*: the state entered by u is replaced by a copy
that has lost its v arc, and every state that had a u arc gets a w arc to the
state entered by v.  After the last rule the automaton accepts exactly the token
sequences the merges would produce, so the arc labels of its only path that
spells a word are the word's tokens.

All u arcs lead to one state at any time, so a state needs no arc table: it is a
link to the state it was copied from plus the one arc it lost.  ``has_arc``
follows those links; answers are kept in a transition table that fills up as
words come in.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ROOT = 0
#: What ``\\s`` stands for in the vocabulary's pattern (a fixed value).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _ranges(initial: str, most: int) -> str:
    """A character class of all code points up to ``most`` whose general category begins with ``initial``."""
    out, start = [], None
    for code in range(most + 2):
        inside = code <= most and unicodedata.category(chr(code))[0] == initial
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"{chr(start)}-{chr(code - 1)}")
            start = None
    return "".join(out)


@lru_cache(2)
def _splitter(most: int) -> re.Pattern:
    """The vocabulary's pre-splitting pattern for texts of code points up to ``most``.

    Spelt with explicit classes: those below U+10000 become bitmaps in ``re``, far
    faster than the lists of ranges that the others need.  The contractions
    come after letters and numbers, which can't begin with an apostrophe.
    """
    letters, numbers = _ranges("L", most), _ranges("N", most)
    return re.compile(
        rf" ?[{letters}]+| ?[{numbers}]+|'(?:s|t|re|ve|m|ll|d)"
        rf"| ?[^{_SPACE}{letters}{numbers}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


def split(text: str) -> list[str]:
    """The words that are encoded on their own."""
    wide = len(text.encode("utf-16-le", "surrogatepass")) != 2 * len(text)
    return _splitter(sys.maxunicode if wide else 0xFFFF).findall(text)


class TokenAutomaton:
    """The automaton of one rank file (``token-in-base64 rank`` lines)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.text = {i: token for token, i in ranks.items()}
        order = sorted(ranks.items(), key=lambda x: x[1])
        self.lengths = {}
        for token in ranks:
            self.lengths.setdefault(token[-2:], set()).add(len(token))
        # a one-byte token may end any longer suffix, so its length joins every list
        self.lengths = {k: sorted(v | {1}, reverse=True) for k, v in self.lengths.items()}
        # a state: the state it was copied from, the arc it lost, its birth
        self.parent, self.lost, self.born = [-1], [-1], [-1]
        self.enters: dict[int, int] = {}
        self.pair: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        self._arcs: dict[tuple[int, int], bool] = {}
        for token, i in order:
            if len(token) == 1:
                self.enters[i] = ROOT
                self.made[i] = -1
        time = 0
        for token, i in order:
            if len(token) > 1:
                self._gadget(token, i, time)
                time += 1
        self._arcs = {}
        self._words: dict[str, tuple[int, ...]] = {}

    def _gadget(self, token: bytes, new: int, time: int) -> None:
        """One rule; its two sides are the only split the automaton built so far accepts."""
        path = self._path(token)
        if len(path) != 2:
            return
        left, right = path
        state, after = self.enters[left], self.enters[right]
        self.parent.append(state)
        self.lost.append(right)
        self.born.append(time)
        self.enters[left] = len(self.parent) - 1
        self.pair[new] = (left, right)
        self.made[new] = time
        self.enters[new] = after

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc labelled ``token``."""
        key = (state, token)
        known = self._arcs.get(key)
        if known is None:
            made, s, known = self.made[token], state, True
            left, right = self.pair.get(token, (-1, -2))
            while self.born[s] >= made and s != ROOT:
                # a rule of twice the same token: its own copy had lost the arc that the new one follows
                if self.lost[s] == token or left == right and self.born[s] == made:
                    known = False
                    break
                s = self.parent[s]
            if known and left >= 0:
                known = self.has_arc(s, left)
            self._arcs[key] = known
        return known

    def _path(self, word: bytes) -> list[int]:
        """Labels of the path that spells ``word``."""
        ids, enters, lengths = self.ids, self.enters, self.lengths
        n, single = len(word), [1]
        last = [-1] * (n + 1)
        for end in range(1, n + 1):
            for length in lengths.get(word[max(0, end - 2) : end], single):
                begin = end - length
                if begin < 0:
                    continue
                token = ids.get(word[begin:end])
                if token is None or token not in enters:
                    continue
                if begin == 0:
                    if self.has_arc(ROOT, token):
                        last[end] = token
                        break
                elif last[begin] >= 0 and self.has_arc(enters[last[begin]], token):
                    last[end] = token
                    break
        out, end = [], n
        while end:
            token = last[end]
            out.append(token)
            end -= len(self.text[token])
        out.reverse()
        return out

    def encode_word(self, word: str) -> tuple[int, ...]:
        return tuple(self._path(word.encode("utf-8", "surrogatepass")))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for an empty or null text."""
        if not text:
            return []
        known = self._words
        words = split(text)
        for word in set(words).difference(known):
            known[word] = self.encode_word(word)
        return list(chain.from_iterable(map(known.__getitem__, words)))

    def trim(self, keep: int) -> None:
        """Empties the word table when it outgrows ``keep`` words; results don't depend on it."""
        if len(self._words) > keep:
            self._words = {}
            self._arcs = {}

    def decode(self, ids: list[int]) -> str:
        """The text of a path: its arc labels, emitted in order."""
        return b"".join(self.text[i] for i in ids).decode("utf-8", "replace")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def automaton(path: str) -> TokenAutomaton:
    """The automaton of a rank file; compiled once in each Python worker."""
    return TokenAutomaton(read_ranks(path))


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed package of public tokenizers keeps ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_corpus(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    ranks_path: str | None = None, words_kept: int = 400_000, also: list[str] | None = None,
) -> DataFrame:
    """Token ids of every row: ``id_column``, the columns named in ``also``, ``ids``.

    Empty and null texts get an empty list; a null id is kept.  Repeated rows
    are encoded once each, other columns are dropped.  ``words_kept`` bounds a
    worker's memory only: the word table is emptied when it is full.
    """
    path = ranks_path or vocabulary_path()
    more = also or []
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = automaton(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [tokens.encode(t) for t in part.column(1).to_pylist()]
                ends = np.zeros(len(rows) + 1, dtype=np.int32)
                np.cumsum([len(r) for r in rows], out=ends[1:])
                flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=ends[-1])
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                kept = [part.column(i) for i in (0, *range(2, part.num_columns))]
                yield pa.RecordBatch.from_arrays([*kept, ids], names=["key", *more, "ids"])
                tokens.trim(words_kept)

    chosen = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text"), *more)
    others = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in more)
    return chosen.mapInArrow(run, f"key {kind}, {others}ids array<int>").withColumnRenamed("key", id_column)
