"""Subjects of documents (problem 9).

Method: classifier chains.  A table of subject terms is learnt from hand-labelled
documents; a document's features are the shares its terms give to the subjects,
its source and its structure.  One calibrated logistic model per subject, each
with the decisions before it as further features, models which subjects occur
together; a beam search decodes the likeliest combination.

The fit takes a bounded sample of labelled documents.  Hand labels can be wrong
and second subjects missing, so terms are relearnt from the shares of the round
before, and the chain's models are fitted with the labels' rates of error by
expectation-maximization: each learns where a share makes a subject from labels
as they are, none of which is changed by hand.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm import structure
from textloom.llm.mixture import source_name
from textloom.llm.prose import body

_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile("[\u3400-\u9fff]+")
_SKIPPED = re.compile(r"\\(?:cite\w*|ref|eqref|label|begin|end|usepackage|bibitem|includegraphics|input|include)\*?(?:\[[^\]]*\])*(?:\{[^{}]*\})*|\$[^$]{0,400}\$")
_COMMAND = re.compile(r"\\[A-Za-z]+\*?")
_ACCENT = re.compile(r"\\([\"'`^~])\{?\\?([A-Za-z])\}?|\\c\{([A-Za-z])\}|\{?\\ss\}?")
_MARKS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303"}
_MACRO = re.compile(r"\\(?:def|newcommand|renewcommand|providecommand)\*?\{?\\([A-Za-z]+)\}?\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}")
STRUCTURE = ("\\item", "\\bibitem", " & ", "|", "\t", "\\section", "@article", "\n")
#: Where the pieces of a subject's response to its own share begin, and how long each is.
STEP = 0.1
STEPS = np.arange(0.05, 0.65, STEP)


def plain(text: str, inside: str | None = None) -> str:
    """A document's body (``inside``, where it is known) with its own macros put in, accents composed and other markup gone."""
    inside = body(text) if inside is None else inside
    if "\\" in inside:
        macros = {name: value for name, value in _MACRO.findall(text) if "#" not in value}
        if macros:
            used = re.compile(r"\\(" + "|".join(sorted(macros, key=len, reverse=True)) + r")(?![A-Za-z])(?:\{\})?")
            inside = used.sub(lambda m: macros[m[1]], inside)
        inside = _ACCENT.sub(lambda m: unicodedata.normalize("NFC", m[2] + _MARKS[m[1]]) if m[1] else m[3] if m[3] else "ß", inside)
        inside = _COMMAND.sub(" ", _SKIPPED.sub(" ", inside))
    return inside


def terms(text: str) -> list[str]:
    """Words in lower case; pairs of neighbouring ideographs where there are no spaces."""
    words = _WORD.findall(text.lower())
    if text.isascii():
        return words
    out = []
    for w in words:
        if _HAN.match(w):
            out.extend(map(str.__add__, w, w[1:]))
        else:
            out.append(w)
    return out


class Model(NamedTuple):
    subjects: list[str]
    term_subject: dict[str, int]
    sources: list[str]
    weights: list[np.ndarray]  # one row a link of the chain
    scale: list[float]  # calibration of each link

    def features(self, text: str, title: str | None, source: str | None, inside: str | None = None) -> tuple[np.ndarray, float]:
        """(features, number of subject terms)."""
        get = self.term_subject.get
        found = Counter(map(get, terms(plain(text, inside))))
        found.update(map(get, terms(title or "")))
        found.pop(None, None)
        counts = np.zeros(len(self.subjects))
        for k, n in found.items():
            counts[k] = n
        return self._vector(counts, text, source), float(counts.sum())

    def _vector(self, counts: np.ndarray, text: str, source: str | None) -> np.ndarray:
        total = counts.sum()
        shares = counts / total if total else counts
        origin = np.array([float(source == s) for s in self.sources])
        shape = np.log1p([text.count(s) for s in STRUCTURE]) / 8
        steps = np.clip((shares[:, None] - STEPS) / STEP, 0.0, 1.0)
        return np.concatenate((shares, [math.log1p(total) / 8, 1.0], origin, shape, steps.ravel()))

    def decode(self, features: np.ndarray, width: int = 6) -> list[tuple[int, float]]:
        """The likeliest combination of subjects, by beam search over the chain: (subject, its probability there)."""
        n = len(self.subjects)
        beam: list[tuple[float, tuple[int, ...], tuple[float, ...]]] = [(0.0, (), ())]
        for k in range(n):
            grown = []
            for score, past, sure in beam:
                p = self._link(k, features, past)
                grown.append((score + math.log(p), (*past, 1), (*sure, p)))
                grown.append((score + math.log(1 - p), (*past, 0), (*sure, p)))
            beam = sorted(grown, key=lambda x: (-x[0], x[1]))[:width]
        some = next((b for b in beam if any(b[1])), None)
        if some is None:  # a document with subject terms is about something
            k = int(features[:n].argmax())
            return [(k, float(beam[0][2][k]))]
        return [(k, some[2][k]) for k in range(n) if some[1][k]]

    def _link(self, k: int, features: np.ndarray, past: tuple[int, ...]) -> float:
        z = float(self.weights[k] @ np.concatenate((features, past))) * self.scale[k]
        return min(1 - 1e-6, max(1e-6, 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 40, start: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge logistic regression on targets from 0 to 1, by Newton's method."""
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _denoised(x: np.ndarray, y: np.ndarray, main: np.ndarray, rounds: int = 20, ridge: float = 4.0) -> tuple[np.ndarray, np.ndarray, tuple[float, float, float]]:
    """(weights, probabilities that a row truly has the subject, (rate of false labels, rates of missing ones for main and for further subjects)).

    Hand labels are noisy observations of the truth, and annotators more often leave
    out a subject that isn't the ``main`` one.  Expectation-maximization fits the
    truth's logistic model and the rates of error together.
    """
    truth, false, first, further = y.astype(float), 0.02, 0.05, 0.4
    w = None
    for _ in range(rounds):
        w = _logistic(x, truth, ridge, steps=8, start=w)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        missing = np.where(main, first, further)
        yes, no = p * np.where(y > 0, 1 - missing, missing), (1 - p) * np.where(y > 0, false, 1 - false)
        truth = yes / (yes + no)
        rate = lambda missed, of: float(np.clip((missed.sum() + 0.5) / (of.sum() + 2), 1e-3, 0.6))
        false = rate((1 - truth) * y, 1 - truth)
        first, further = rate((truth * (1 - y))[main], truth[main]), rate((truth * (1 - y))[~main], truth[~main])
    return w, truth, (false, first, further)


def fit(rows: list[tuple], subjects: list[str], rounds: int = 4, seen_in: int = 4) -> Model:
    """A model from (subjects of a document, its term counts, text shape features, source) rows; see ``sample``."""
    n, m = len(subjects), len(rows)
    if not rows or not subjects:
        return Model(subjects, {}, [], [], [])
    place = {s: k for k, s in enumerate(subjects)}
    labels = np.zeros((m, n))
    for i, (named, *_) in enumerate(rows):
        for s in named:
            labels[i, place[s]] = 1
    frequency: Counter = Counter()
    for _, counts, *_ in rows:
        frequency.update(counts.keys())
    known = sorted(t for t, k in frequency.items() if k >= min(seen_in, max(1, m // 50)))
    at = {t: k for k, t in enumerate(known)}
    own = [(np.array([at[t] for t in counts if t in at], int), np.array([k for t, k in counts.items() if t in at], float)) for _, counts, *_ in rows]
    belief = labels / np.maximum(1, labels.sum(axis=1, keepdims=True))
    best, sure = np.zeros(len(known), int), np.zeros(len(known), bool)
    for _ in range(rounds):
        table = np.full((len(known), n), 0.02)
        for (place_, count), b in zip(own, belief, strict=True):
            table[place_] += np.minimum(count, 3)[:, None] * b
        odds = table / belief.sum(axis=0).clip(1)  # as if all subjects were labelled equally often
        odds /= odds.sum(axis=1, keepdims=True)
        best, sure = odds.argmax(axis=1), odds.max(axis=1) > 0.45
        shares = np.zeros((m, n))
        for i, (place_, count) in enumerate(own):
            good = sure[place_]
            shares[i] = np.bincount(best[place_[good]], count[good], minlength=n)
        total = shares.sum(axis=1, keepdims=True)
        shares = np.divide(shares, total, out=np.zeros_like(shares), where=total > 0)
        agreed = shares * labels
        trusted = np.where(agreed.sum(axis=1, keepdims=True) > 0.2, agreed, shares)
        size = trusted.sum(axis=1, keepdims=True)
        belief = np.divide(trusted, size, out=labels / np.maximum(1, labels.sum(axis=1, keepdims=True)), where=size > 0)
    model = Model(subjects, {t: int(best[k]) for k, t in enumerate(known) if sure[k]}, sorted({r[3] for r in rows if r[3]}), [], [])
    x = []
    for (_, counts, shape, source) in rows:
        c = np.zeros(n)
        for t, k in counts.items():
            if t in model.term_subject:
                c[model.term_subject[t]] += k
        v = model._vector(c, "", source)
        first = n + 2 + len(model.sources)
        v[first : first + len(STRUCTURE)] = shape
        x.append(v)
    x = np.array(x) if x else np.zeros((0, 1))
    held = np.arange(m) % 4 == 3
    past, largest = np.zeros((m, 0)), x[:, :n].argmax(axis=1) if m else np.zeros(0, int)
    for k in range(n):
        # of the steps only the subject's own
        wide = x.shape[1] - n * len(STEPS)
        own_ = np.r_[:wide, wide + k * len(STEPS) : wide + (k + 1) * len(STEPS), x.shape[1] : x.shape[1] + k]
        inputs, main = np.concatenate((x, past), axis=1)[:, own_], largest == k
        w, truth, _ = _denoised(inputs, labels[:, k], main)
        model.weights.append(np.zeros(x.shape[1] + k))
        model.weights[k][own_] = w
        # the scale makes the hand labels of rows that a second model hasn't seen likeliest, their errors allowed for
        other, _, (false, first, further) = _denoised(inputs[~held], labels[~held, k], main[~held])
        grid, z, missing = np.linspace(0.3, 4.0, 38), inputs[held] @ other, np.where(main, first, further)[held]
        seen = [false + (1 - missing - false) / (1 + np.exp(-np.clip(z * g, -30, 30))) for g in grid]
        loss = [-np.log(np.where(labels[held, k] > 0, p, 1 - p)).sum() for p in seen]
        model.scale.append(float(grid[int(np.argmin(loss))]))
        past = np.concatenate((past, truth[:, None]), axis=1)
    return model


def sample(docs: DataFrame, labels: DataFrame, catalog: DataFrame, bound: int = 3000) -> tuple[list[tuple], list[str]]:
    """Rows for ``fit`` from at most ``bound`` labelled documents, and the subjects of the catalogue.

    The same documents are chosen in every run, by a hash of their ids.  Labels in
    any spelling of a catalogue subject count, others don't.
    """
    subjects = sorted(r.s for r in catalog.select(F.lower(F.trim("subject")).alias("s")).where("s is not null").distinct().collect())
    named = labels.select("doc_id", F.lower(F.trim("subject")).alias("s")).where(F.col("s").isin(*subjects) & F.col("doc_id").isNotNull())
    chosen = named.groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("named")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words, counts, shapes, origins = [], [], [], [], []
            for key, text, title, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text and not text.isspace():
                    found = Counter(terms(plain(text)))
                    found.update(terms(title or ""))
                    keys.append(key)
                    words.append(list(found))
                    counts.append(list(found.values()))
                    shapes.append([math.log1p(text.count(s)) / 8 for s in STRUCTURE])
                    origins.append(source)
            columns = [pa.array(keys, pa.int64()), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32())), pa.array(shapes, pa.list_(pa.float64())), pa.array(origins, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "words", "counts", "shape", "source"])

    # the chosen ids are bounded by the sample
    ids = F.broadcast(chosen)
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "title", source_name(F.col("source")).alias("source")).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    counted = wanted.mapInArrow(run, "doc_id bigint, words array<string>, counts array<int>, shape array<double>, source string")
    rows = sorted(counted.join(ids, "doc_id").collect(), key=lambda r: r.doc_id)  # sorting in Spark would read the texts twice
    return [(r.named, dict(zip(r.words, r.counts, strict=True)), r["shape"], r.source) for r in rows], subjects


def subjects_of(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, subject, share, probability``: one row for each subject of each document.

    Blank and null texts, junk, and texts without a subject term have no row.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("subject", pa.string()), ("share", pa.float64()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = known.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                rows = []
                for key, text, title, source in zip(*(c.to_pylist() for c in batch.slice(start, 1024).columns), strict=True):
                    if not text or text.isspace():
                        continue
                    inside = body(text)
                    features, n = fitted.features(text, title, source, inside)
                    if not n or structure.is_junk(inside):
                        continue
                    rows += [(key, fitted.subjects[k], float(features[k]), p) for k, p in fitted.decode(features)]
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "title", source_name(F.col("source")).alias("source"))
    return chosen.mapInArrow(run, "doc_id bigint, subject string, share double, probability double")
