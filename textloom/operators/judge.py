"""Fusing outside judgments into local scores.

Judgments come in as a table (``doc_id, chunk_id, response_json``); nothing here
calls a network.  A response that can't be parsed counts as no judgment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.functions.text import let, preview, trimmed
from textloom.operators.classify import CATEGORIES
from textloom.operators.score import held, logistic, scored, scored_short

RESPONSE = "probability double, confidence double, uncertainty double, signals array<struct<id:string,score:double,evidence:string>>, reasoning string, _corrupt_record string"
#: Weight of each kind of evidence (fixed values).
EVIDENCE = {
    "template_like": 1.0,
    "low_specificity": 0.9,
    "uniform_structure": 0.8,
    "high_repetition": 0.9,
    "weak_human_trace": 0.7,
    "logical_leaps": 0.7,
    "human_detail": 1.0,
    "stylistic_variance": 0.7,
}
#: How much academic writing takes from a weight (fixed values).
ACADEMIC = {"template_like": 0.6, "uniform_structure": 0.6, "high_repetition": 0.4, "weak_human_trace": 0.65, "low_specificity": 0.25}
CONTENT, HUMAN = ["low_specificity", "logical_leaps"], ["human_detail", "stylistic_variance"]
STRUCTURAL = ["template_like", "uniform_structure", "high_repetition", "weak_human_trace"]
_SIGNALS = "array<struct<id:string,score:double,evidence:string>>"


def within(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``x`` held between two bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def json_of(response: Column) -> Column:
    """From the first opening brace to the last closing one; the trimmed text where there is none."""
    found = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    return F.when(found == "", F.trim(response)).otherwise(found)


def first_json(response: Column) -> Column:
    """The first balanced JSON object of a text that begins with one; null for any other text.

    Braces within strings don't count.  Strings are blanked out first, so that what
    is left can be scanned for the place where as many braces are closed as opened.
    """
    bare = F.regexp_replace(response, r"\A[ \t\n\x0c\r]+", "")
    # strings become dots of the same length; an unfinished one runs to the end
    shown = F.array_join(
        F.transform(F.regexp_extract_all(bare, F.lit(r'(?s)[^"]+|"(?:[^"\\]|\\.)*+(?:"|\z)'), F.lit(0)), lambda x: F.when(x.startswith('"'), F.repeat(F.lit("."), F.length(x))).otherwise(x)), ""
    )
    braces = F.filter(F.transform(F.split(shown, ""), lambda c, i: F.struct(i.alias("i"), F.when(c == "{", 1).when(c == "}", -1).otherwise(0).alias("d"))), lambda x: x["d"] != 0)

    def closing(braces: Column) -> Column:
        state = lambda depth, at: F.struct(depth.alias("depth"), at.alias("at"))
        step = lambda s, x: F.when(s["at"] >= 0, s).otherwise(state(s["depth"] + x["d"], F.when(s["depth"] + x["d"] == 0, x["i"]).otherwise(F.lit(-1))))
        return F.aggregate(braces, state(F.lit(0), F.lit(-1)), step, lambda s: s["at"])

    return let(closing(braces), lambda at: F.when(bare.startswith("{") & (at >= 0), F.left(bare, at + 1)))


def judged(judgments: DataFrame) -> DataFrame:
    """``doc_id, chunk_id, llm_probability, llm_confidence, llm_uncertainty, evidence``: parsed responses, one a segment (the least text).

    What can't be parsed has null values, so a failure can be told from a segment that wasn't asked about.
    """
    parsed = judgments.groupBy("doc_id", "chunk_id").agg(F.min("response_json").alias("r")).withColumn("j", F.from_json(json_of(F.col("r")), RESPONSE))
    good = F.col("j").isNotNull() & F.col("j._corrupt_record").isNull()
    only = lambda c: F.when(good, c)
    sound = lambda name, missing: F.nanvl(F.coalesce(F.col(f"j.{name}"), F.lit(missing)), F.lit(missing))
    return parsed.select(
        "doc_id", "chunk_id", only(within(sound("probability", 0.0))).alias("llm_probability"), only(within(sound("confidence", 0.6))).alias("llm_confidence"),
        only(within(F.col("j.uncertainty"))).alias("llm_uncertainty"), only(evidence(F.coalesce("j.signals", F.expr(f"cast(array() as {_SIGNALS})")))).alias("evidence"),
    )


def evidence(signals: Column, academic: Column | float = 0.0) -> Column:
    """Signals of known kinds that say what they rest on, scores within 1 either way, with weights; strongest first, in their order among equals."""
    strength = academic if isinstance(academic, Column) else F.lit(academic)
    weights = F.create_map(*[x for k, w in EVIDENCE.items() for x in (F.lit(k), F.lit(w))])
    taken = F.create_map(*[x for k in EVIDENCE for x in (F.lit(k), F.lit(ACADEMIC.get(k, 0.0)))])
    score = lambda s: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(s["score"], F.lit(0.0)), F.lit(0.0))))
    clean = F.transform(signals, lambda s, i: F.struct(i.alias("i"), F.lower(trimmed(s["id"])).alias("id"), score(s).alias("score"), trimmed(s["evidence"]).alias("evidence")))
    known = F.filter(clean, lambda s: s["id"].isin(list(EVIDENCE)) & (F.length(s["evidence"]) > 0))
    weighed = F.transform(
        known,
        lambda s: F.struct((-F.abs(s["score"])).alias("order"), s["i"].alias("i"), s["id"].alias("id"), s["score"].alias("score"), (weights[s["id"]] * (1 - taken[s["id"]] * strength)).alias("weight"), s["evidence"].alias("evidence")),
    )
    return F.array_sort(weighed)


def strength(items: Column, names: list[str], sign: int = 1) -> Column:
    """The strongest score among evidence of these kinds, 0 at least."""
    return F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform(F.filter(items, lambda s: s["id"].isin(names)), lambda s: s["score"] * sign)), F.lit(0.0)))


def fused(segments: DataFrame, judgments: DataFrame, academic: Column | float = 0.0) -> DataFrame:
    """``segments`` with judgments worked into ``fused_probability, fused_confidence, fused_uncertainty`` and the evidence strengths.

    ``academic``: how academic the document is, a number or a column of ``judgments``
    and ``segments``.  Segments nobody was asked about keep their local scores; those
    whose answer can't be read keep them too, with an uncertainty of 0.5 at least.
    ``notes`` tells of a failure and of a structural doubt.
    """
    strength_of = academic if isinstance(academic, Column) else F.lit(academic)
    rows = segments.drop("content_strength", "human_strength", "structural_strength").join(judged(judgments).withColumn("_asked", F.lit(True)), ["doc_id", "chunk_id"], "left")
    taken = F.create_map(*[x for k in EVIDENCE for x in (F.lit(k), F.lit(ACADEMIC.get(k, 0.0)))])
    rows = rows.withColumn("evidence", F.transform("evidence", lambda s: s.withField("weight", s["weight"] * (1 - taken[s["id"]] * strength_of))))
    has, ev = F.col("llm_probability").isNotNull(), F.col("evidence")
    some = has & (F.size(ev) > 0)
    total = F.aggregate(ev, F.lit(0.0), lambda a, s: a + s["weight"] * s["score"])
    rows = rows.withColumns({
        "content_strength": F.when(some, strength(ev, CONTENT)).otherwise(0.0), "human_strength": F.when(some, strength(ev, HUMAN, -1)).otherwise(0.0),
        "structural_strength": F.when(some, strength(ev, STRUCTURAL)).otherwise(0.0), "_e": F.when(some, logistic(within(total, -3.0, 3.0))),
    })
    llm, e = F.col("llm_probability"), F.col("_e")
    mix = 0.20 + 0.40 * F.abs(llm - e)
    sure = F.col("llm_confidence") * (1 - F.coalesce("llm_uncertainty", F.lit(0.0)))
    rows = rows.withColumns({"_a": F.when(e.isNotNull(), within(llm * (1 - mix) + e * mix)).otherwise(llm), "_c": F.when(e.isNotNull(), sure * (0.6 + 0.4 * (1 - F.abs(llm - e)))).otherwise(sure)})
    local, size = F.col("raw_probability"), F.least(F.length("text") / 1200, F.lit(1.0))
    conflict = F.greatest(F.abs(F.col("_a") - local), F.coalesce(0.8 * F.abs(F.col("_a") - e), F.lit(0.0)))
    rows = rows.withColumns({"_k": conflict, "_w": within(0.27 + 0.45 * F.col("_c") + 0.15 * size - 0.75 * conflict, 0.15, 0.62)})
    p = F.col("_w") * F.col("_a") + (1 - F.col("_w")) * local
    confidence = (0.55 * F.col("_c") + 0.45 * F.col("confidence")) * (1 - 0.35 * F.col("_k"))
    doubt = within(F.coalesce("llm_uncertainty", 1 - F.col("_c")))
    doubt = F.when(e.isNull(), F.greatest(doubt, F.lit(0.5))).otherwise(within(doubt + 0.35 * F.abs(F.col("_a") - e)))
    structural = (F.col("structural_strength") > 0.45) & (F.col("content_strength") < 0.2) & (strength_of > 0)
    doubt = F.when(structural, within(doubt + 0.12 * strength_of)).otherwise(doubt)
    failed = F.coalesce("_asked", F.lit(False)) & ~has
    notes = F.array(F.when(failed, "llm_failed_local_only"), F.when(has & structural, "academic_structure_uncertainty_boost"))
    return rows.withColumns({
        "fused_probability": F.when(has, within(p)).otherwise(local),
        "fused_confidence": F.when(has, within(confidence)).otherwise(F.col("confidence")),
        "fused_uncertainty": F.when(has, doubt).when(failed, F.greatest(F.col("uncertainty"), F.lit(0.5))).otherwise(F.col("uncertainty")),
        "notes": F.filter(notes, lambda n: n.isNotNull()),
    }).drop("_e", "_a", "_c", "_k", "_w", "_asked")


def judged_tiers(sentences: DataFrame, judgments: DataFrame, language: str = "language") -> DataFrame:
    """Sentences scored by tier: ``sentences`` (with features, ``tier, chunk_id``) and ``fused_probability, fused_confidence, fused_uncertainty, notes``.

    Short sentences get the short-text score with confidence 0.5, and so do longer
    ones that nobody was asked about.  Where all attempts failed (an answer that
    can't be read) the confidence is 0.4.
    """
    short = scored_short(sentences, language).withColumnRenamed("raw_probability", "_short").select("doc_id", "chunk_id", "_short")
    rows = fused(scored(sentences, language).join(short, ["doc_id", "chunk_id"]), judgments)
    local = F.col("tier") == "local"
    failed = ~local & F.array_contains("notes", "llm_failed_local_only")
    alone = local | F.col("llm_probability").isNull()
    sure = F.when(failed, 0.4).otherwise(0.5)
    return rows.withColumns({
        "fused_probability": F.when(alone, F.col("_short")).otherwise(F.col("fused_probability")),
        "fused_confidence": F.when(alone, sure).otherwise(F.col("fused_confidence")),
        "fused_uncertainty": F.when(alone, within(1 - sure, 0.05, 0.9)).otherwise(F.col("fused_uncertainty")),
        "notes": F.when(local, F.array(F.lit("local_stylometry_only"))).when(failed, F.array(F.lit("retry_exhausted_local_fallback")))
        .when(alone, F.array(F.lit("no_judge_local_only"))).otherwise(F.col("notes")),
    }).drop("_short")


def judge_with(segments: DataFrame, judge: Callable[[str], str], attempts: int = 3) -> DataFrame:
    """A judgments table made by calling ``judge`` on each segment's ``prompt``; a call that fails ``attempts`` times gives a null response."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = []
            for text in frame["prompt"]:
                answer = None
                for _ in range(attempts):
                    try:
                        answer = judge(text)
                        break
                    except Exception:  # noqa: BLE001 - whatever a judge raises is a failed attempt
                        continue
                answers.append(answer)
            yield frame[["doc_id", "chunk_id"]].assign(response_json=answers)

    return segments.select("doc_id", F.col("chunk_id").cast("int").alias("chunk_id"), "prompt").mapInPandas(run, "doc_id bigint, chunk_id int, response_json string")


def adaptively_fused(segments: DataFrame) -> DataFrame:
    """``segments`` (with ``llm_probability``, null where there is no judgment) and ``fused_probability``, weighted by whose probabilities vary more in the document.

    Only judged segments count for the variances; several judgments of a document that are all alike are rejected.
    """
    part = W.partitionBy("doc_id")
    llm, local = F.col("llm_probability"), F.col("raw_probability")
    n = F.count(llm).over(part)
    spread_llm, spread_local = F.var_pop(llm).over(part), F.var_pop(F.when(llm.isNotNull(), local)).over(part)
    w = within(0.30 + 0.25 * spread_llm / F.greatest(spread_llm + spread_local, F.lit(1e-9)), 0.20, 0.55)
    good = llm.isNotNull() & ((n == 1) | (spread_llm >= 1e-4))
    return segments.withColumn("fused_probability", F.when(good, held(w * llm + (1 - w) * local)).otherwise(local))


def answer_text(response: Column) -> Column:
    """The answer in a provider's JSON: the first output text that isn't blank, else the first choice's message, else the JSON object in its reasoning.

    A response that is a JSON string holding the object, perhaps with lines after it, is opened first.
    """
    opened = F.coalesce(F.from_json(F.concat(F.lit('{"s":'), F.trim(response), F.lit("}")), "s string")["s"], response)
    whole = F.when(F.trim(response).startswith('"'), F.coalesce(first_json(opened), opened)).otherwise(response)
    shown = lambda c: F.when(F.length(trimmed(c)) > 0, c)
    outputs = F.from_json(F.get_json_object(whole, "$.output[0].content"), "array<struct<text:string>>")
    first_output = F.get(F.filter(F.transform(outputs, lambda x: shown(x["text"])), lambda t: t.isNotNull()), F.lit(0))
    reasoning = F.coalesce(F.get_json_object(whole, "$.choices[0].message.reasoning_content"), F.get_json_object(whole, "$.reasoning_content"))
    found = F.regexp_extract(reasoning, r"\{.*\}", 0)
    return F.coalesce(
        first_output, shown(F.get_json_object(whole, "$.choices[0].message.content")), shown(F.get_json_object(whole, "$.content[0].text")),
        shown(F.get_json_object(whole, "$.candidates[0].content.parts[0].text")), F.when(found != "", found),
    )


def classes_of(answers: DataFrame) -> DataFrame:
    """``doc_id, block_index, category, confidence`` from a classifier's responses (``doc_id, response``); an unknown category is body, a response that can't be read has no row."""
    item = "paragraphs array<struct<index:int,category:string,confidence:double>>"
    rows = answers.select("doc_id", F.explode(F.from_json(json_of(F.col("response")), item)["paragraphs"]).alias("x")).where("x.index is not null")
    known = F.when(F.col("x.category").isin(CATEGORIES), F.col("x.category")).otherwise("body")
    return rows.select("doc_id", F.col("x.index").alias("block_index"), known.alias("category"), F.col("x.confidence").alias("confidence"))


def provider_for(wanted: str | None, keys: Mapping[str, str], order: Sequence[str] = ("openai", "gemini", "glm", "deepseek", "anthropic")) -> tuple[str, str | None] | None:
    """(provider, model) to ask: the wanted ``provider:model`` if it has a key, else the first in ``order`` that has one; null if none has."""
    name, _, model = (wanted or "").partition(":")
    if keys.get(name.strip().lower(), "").strip():
        return name.strip().lower(), model.strip() or None
    return next(((p, None) for p in order if keys.get(p, "").strip()), None)


def merge_answer(response: Column, allowed: Column) -> Column:
    """The boundaries a refiner wants merged, of those it was asked about."""
    wanted = F.from_json(json_of(response), "mergeIndices array<int>")["mergeIndices"]
    return F.array_sort(F.array_intersect(F.coalesce(wanted, F.expr("cast(array() as array<int>)")), allowed))


def prompt(segments: DataFrame) -> DataFrame:
    """``segments`` with the prompt a judge gets: the text between its neighbours (``previous_text``, ``next_text``)."""
    return segments.withColumn("prompt", F.concat_ws("\n", F.concat(F.lit("Before: "), F.coalesce("previous_text", F.lit(""))), F.concat(F.lit("Text: "), F.col("text")), F.concat(F.lit("After: "), F.coalesce("next_text", F.lit("")))))


def batch_prompt(segments: DataFrame, most: int = 200) -> DataFrame:
    """``doc_id, prompt``: one prompt a document that lists the previews of its segments in order."""
    line = F.format_string("[%d] %s", F.col("chunk_id"), preview(F.col("text"), most))
    return segments.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", line.alias("t")))), lambda x: x["t"]), "\n").alias("prompt"))


def profile_prompt(profiles: DataFrame) -> DataFrame:
    """``profiles`` with ``profile_text``: what a judge is told about a document, at most six of its ``conventions``."""
    some = lambda c, form: F.when(F.length(trimmed(F.col(c))) > 0, F.concat(F.lit(form), trimmed(F.col(c))))
    kept = F.filter(F.slice(F.coalesce("conventions", F.expr("cast(array() as array<string>)")), 1, 6), lambda x: F.length(trimmed(x)) > 0)
    told = F.concat(F.array(some("category", "Field: "), some("discipline", "Discipline: "), some("subfield", "Subfield: "), some("paper_type", "Type: "), some("summary", "Summary: ")), F.transform(kept, lambda x: F.concat(F.lit("- "), trimmed(x))))
    return profiles.withColumn("profile_text", F.array_join(told, "\n"))
