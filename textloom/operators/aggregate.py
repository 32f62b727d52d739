"""Aggregation of segments to documents, decisions, and order statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.config import MARGIN, profile
from textloom.functions.text import let
from textloom.operators.score import held, logit, safe_logistic


def base_decision(p: Column, low: float, high: float, margin: float = MARGIN) -> Column:
    return F.when(p < low - margin, "pass").when(p < high - margin, "review").otherwise("flag")


def _reviewed(base: Column, uncertainty: Column, to_review: Column, g: dict[str, float]) -> Column:
    return F.when((base == "pass") & (uncertainty >= g["review_uncertainty"]), "review").when((base == "flag") & to_review, "review").otherwise(base)


def segment_decision(segments: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """``segments`` with ``decision`` and ``supports_flag``; needs ``raw_probability, uncertainty, content_strength, human_strength``.

    Missing evidence counts as strength 0.
    """
    g = profile(sensitivity)
    content, human = F.coalesce("content_strength", F.lit(0.0)), F.coalesce("human_strength", F.lit(0.0))
    p, u = F.col("raw_probability"), F.col("uncertainty")
    lacking = F.lit(g["content_min"] > 0) & (content < g["content_min"])
    decision = _reviewed(base_decision(p, g["review"], g["flag"]), u, (u > g["flag_uncertainty"]) | lacking | (human >= g["human_max"]), g)
    supports = (p >= g["flag"] - MARGIN) & (u <= g["flag_uncertainty"]) & ~lacking & (human < g["human_max"])
    return segments.withColumns({"decision": decision, "supports_flag": supports})


def evidenceless(segments: DataFrame) -> DataFrame:
    """``segments`` with the strengths of evidence that no judge gave."""
    return segments.withColumns({"content_strength": F.lit(0.0), "human_strength": F.lit(0.0), "structural_strength": F.lit(0.0)})


def overall_decision(p: Column, uncertainty: Column, supported: Column, sensitivity: str = "medium") -> Column:
    """Decision on a document; a flag needs a segment that supports it."""
    g = profile(sensitivity)
    return _reviewed(base_decision(p, g["review"], g["flag"]), uncertainty, (uncertainty > g["flag_uncertainty"]) | ~F.coalesce(supported, F.lit(False)), g)


def aggregated(segments: DataFrame, sensitivity: str = "medium", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a key: ``segments, overall_probability, overall_confidence, overall_uncertainty, quality_score, trimmed_probability, supported, decision``.

    Weights grow with the root of the byte length and the confidence; a tenth of
    the segments at either end is trimmed where there are five or more.  The
    trimming needs a rank within the key, which shares the shuffle of the sums.
    """
    weight = F.sqrt(F.greatest(F.col("end") - F.col("start"), F.lit(50))) * F.greatest(F.col("confidence"), F.lit(0.3))
    part = W.partitionBy(*keys)
    ranked = segments.withColumns({
        "_w": weight, "_n": F.count("*").over(part), "_k": F.row_number().over(part.orderBy("raw_probability", "chunk_id")),
    })
    cut = F.ceil(F.col("_n") * 0.1)
    inner = (F.col("_n") >= 5) & (F.col("_k") > cut) & (F.col("_k") <= F.col("_n") - cut)
    total = F.greatest(F.sum("_w"), F.lit(1.0))
    mean = lambda c: F.sum(F.col(c) * F.col("_w")) / total
    sums = ranked.groupBy(*keys).agg(
        F.count("*").alias("segments"), mean("raw_probability").alias("weighted"), mean("confidence").alias("overall_confidence"),
        mean("uncertainty").alias("overall_uncertainty"), F.avg(F.when(inner, F.col("raw_probability"))).alias("inner"), F.bool_or("supports_flag").alias("supported"),
    )
    trimmed = F.coalesce("inner", "weighted")
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * F.col("weighted") + 0.3 * trimmed))
    out = sums.withColumns({"overall_probability": p, "trimmed_probability": trimmed, "quality_score": 0.5 + (F.col("overall_confidence") - 0.5) * 0.6})
    return out.withColumn("decision", overall_decision(F.col("overall_probability"), F.col("overall_uncertainty"), F.col("supported"), sensitivity)).drop("inner")


def with_empty(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` of ``aggregated`` and a row for each document without segments: probability and confidence 0, pass."""
    joined = docs.select("doc_id").join(rows, "doc_id", "left")
    blank = {"segments": F.lit(0), "overall_probability": F.lit(0.0), "overall_confidence": F.lit(0.0), "overall_uncertainty": F.lit(0.0), "decision": F.lit("pass"), "supported": F.lit(False)}
    return joined.withColumns({c: F.coalesce(c, v) for c, v in blank.items()})


def aggregated_legacy(segments: DataFrame) -> DataFrame:
    """The archived implementation's aggregate: weights are lengths of at least 50."""
    w = F.greatest(F.lit(50), F.col("end") - F.col("start"))
    mean = lambda c: F.sum(F.col(c) * w) / F.greatest(F.sum(w), F.lit(1))
    rows = segments.groupBy("doc_id").agg(mean("raw_probability").alias("overall_probability"), mean("confidence").alias("overall_confidence"))
    grammar = F.floor(F.col("overall_confidence") * 10).cast("int") % 5 + 1
    return rows.withColumns({
        "quality_score": 0.5 + (F.col("overall_confidence") - 0.5) * 0.6,
        "dimension_scores": F.create_map(F.lit("grammarAccuracy"), grammar, F.lit("contentRelevance"), F.lit(4), F.lit("logicalCoherence"), F.lit(4), F.lit("originality"), F.lit(3)),
        "decision": base_decision(F.col("overall_probability"), 0.65, 0.85),
    })


def fused_views(rows: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """``rows`` with ``fused_probability, fused_confidence, fused_uncertainty, fused_decision``.

    0.6 of the paragraph view and 0.4 of the sentence view, or the paragraph view
    alone where the other's probability is 0.  Needs each view's ``overall_probability``
    and ``overall_confidence``, ``paragraph_supported`` and ``paragraph_mean_uncertainty``,
    the plain mean over paragraph segments.
    """
    some = F.col("sentence_overall_probability") > 0
    mix = lambda c: F.when(some, 0.6 * F.col(f"paragraph_{c}") + 0.4 * F.col(f"sentence_{c}")).otherwise(F.col(f"paragraph_{c}"))
    out = rows.withColumns({
        "fused_probability": mix("overall_probability"), "fused_confidence": mix("overall_confidence"), "fused_uncertainty": F.coalesce("paragraph_mean_uncertainty", F.lit(0.0)),
    })
    return out.withColumn("fused_decision", overall_decision(F.col("fused_probability"), F.col("fused_uncertainty"), F.col("paragraph_supported"), sensitivity))


#: Strength of the sharpening by sensitivity in the archived implementation (fixed values).
GAMMA = {"low": 1.10, "medium": 1.45, "high": 1.75}


def _total(values: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + f(x))


def _spread(ps: Column) -> Column:
    """struct(m, iqr, mean, sd) of a document's probabilities; quantiles are items of the sorted ones, not interpolated."""
    def of(o: Column) -> Column:
        n = F.size(o)
        at = lambda share: F.get(o, F.floor(n * share).cast("int"))
        mean = _total(o, lambda x: x) / n
        sd = let(mean, lambda m: F.sqrt(_total(o, lambda x: (x - m) * (x - m)) / n))
        return F.struct(at(0.5).alias("m"), F.greatest(at(0.75) - at(0.25), F.lit(1e-6)).alias("iqr"), mean.alias("mean"), sd.alias("sd"))

    return let(F.array_sort(ps), of)


def _shifted(logits: Column, mean: Column, steps: int) -> Column:
    """Probabilities of ``logits``, all moved alike so that their mean is ``mean``; the move is found by halving."""
    def half(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        over = _total(logits, lambda x: safe_logistic(x + mid)) / F.size(logits) > mean
        return F.struct(F.when(over, s["lo"]).otherwise(mid).alias("lo"), F.when(over, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(-6.0).alias("lo"), F.lit(6.0).alias("hi"))
    shift = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, half, lambda s: (s["lo"] + s["hi"]) / 2)
    return let(shift, lambda c: F.transform(logits, lambda x: safe_logistic(x + c)))


def _sharpen(segments: DataFrame, final: Callable[[Column, Column], Column]) -> DataFrame:
    """``segments`` and the fields that ``final`` gives each item of a document's ordered ``chunk_id, p, c``, from the items and their spread."""
    item = F.struct(F.col("chunk_id"), F.col("raw_probability").alias("p"), F.col("confidence").alias("c"))
    docs = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    found = let(F.col("items"), lambda xs: let(_spread(F.transform(xs, lambda x: x["p"])), lambda q: final(xs, q)))
    return segments.join(docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*"), ["doc_id", "chunk_id"])


def _drawn(xs: Column, q: Column, gamma: float, steps: int) -> Column:
    """Probabilities drawn apart around the median, their mean kept; items of little confidence take a fifth of the change."""
    g = F.least(gamma * (1 + F.greatest(F.lit(0.0), (0.06 - q["sd"]) * 10)), F.lit(2.5))
    surer = lambda x: 0.6 + 0.4 * F.greatest(F.lit(0.3), F.least(F.lit(0.92), x["c"]))
    logits = F.transform(xs, lambda x: logit(x["p"]) + g * ((x["p"] - q["m"]) / (q["iqr"] / 1.349)) * surer(x))
    new = let(logits, lambda ls: _shifted(ls, q["mean"], steps))
    return F.zip_with(xs, new, lambda x, p: held(F.when(x["c"] < 0.5, 0.8 * x["p"] + 0.2 * p).otherwise(p)))


def sharpened(segments: DataFrame, gamma: float = 1.45, steps: int = 28) -> DataFrame:
    """``segments`` with ``sharpened``: probabilities drawn apart around the document's median, their mean kept.

    Documents with fewer than four segments are unchanged.  One array a document
    holds its probabilities and confidences.
    """
    def final(xs: Column, q: Column) -> Column:
        new = F.when(F.size(xs) < 4, F.transform(xs, lambda x: x["p"])).otherwise(_drawn(xs, q, gamma, steps))
        return F.zip_with(xs, new, lambda x, p: F.struct(x["chunk_id"].alias("chunk_id"), p.alias("sharpened")))

    return _sharpen(segments, final)


def sharpened_legacy(segments: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """``segments`` with ``sharpened`` and ``tags`` as in the archived implementation.

    The strength depends on the sensitivity; probabilities at least 0.15 from the
    median before are tagged; where all are still close together a second, stronger
    pass follows, without regard to confidence.
    """
    gamma = GAMMA.get((sensitivity or "medium").lower(), GAMMA["medium"])

    def final(xs: Column, q: Column) -> Column:
        def second(first: Column) -> Column:
            def boosted(r: Column) -> Column:
                logits = F.transform(first, lambda p: logit(p) + min(3.0, gamma * 1.6) * ((p - r["m"]) / (r["iqr"] / 1.349)))
                again = let(logits, lambda ls: F.transform(_shifted(ls, r["mean"], 22), held))
                flat = (r["sd"] < 0.05) & (F.size(xs) > 3)
                tags = lambda p: F.array(F.when((F.size(xs) > 3) & (F.abs(p - q["m"]) >= 0.15), "contrastSharpening"), F.when(flat, "contrastSharpening(boost)"))
                return F.transform(xs, lambda x, i: F.struct(
                    x["chunk_id"].alias("chunk_id"), F.when(flat, F.get(again, i)).otherwise(F.get(first, i)).alias("sharpened"),
                    F.filter(tags(F.get(first, i)), lambda t: t.isNotNull()).alias("tags"),
                ))

            return let(_spread(first), boosted)

        return let(F.when(F.size(xs) < 4, F.transform(xs, lambda x: x["p"])).otherwise(_drawn(xs, q, gamma, 28)), second)

    return _sharpen(segments, final)


def nearest_rank(values: Column, share: float = 0.95) -> Column:
    """The item at the rounded place ``share`` of an array's sorted items; halves round to even."""
    return F.get(F.array_sort(values), F.bround(share * (F.size(values) - 1)).cast("int"))


def batch_summary(items: DataFrame, keys: tuple[str, ...] = (), digits: tuple[int, ...] = (5, 10)) -> DataFrame:
    """``count, fail_count, average, p95`` of a batch's ``probability``, a null one being a failure.

    The exact 95th value is found by narrowing down: counts by cells of 1e-5 say in
    which of them it lies, then counts by smaller cells within it; at last only the
    distinct values of one cell of 1e-10 are ranked, of which there are about a million at most.
    """
    named = items.withColumn("_all", F.lit(1))
    by = ["_all", *keys]
    counts = named.groupBy(*by).agg(F.count("*").alias("count"), F.count_if(F.col("probability").isNull()).alias("fail_count"), F.avg("probability").alias("average"))
    values = named.where("probability is not null").groupBy(*by, "probability").agg(F.count("*").alias("c"))
    part = W.partitionBy(*by)
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in by]
    sized = values.groupBy(*by).agg(F.sum("c").alias("total"))
    inside = values.alias("a").join(sized.alias("b"), same("a", "b")).select("a.*", F.bround(0.95 * (F.col("b.total") - 1)).cast("bigint").alias("place"))
    for d in digits:
        celled = inside.withColumn("cell", F.floor(F.col("probability") * 10**d))
        cells = celled.groupBy(*by, "cell").agg(F.sum("c").alias("n"), F.first("place").alias("place")).withColumn("upto", F.sum("n").over(part.orderBy("cell")))
        home = cells.where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("n") <= F.col("place"))).select(*by, "cell", (F.col("place") - (F.col("upto") - F.col("n"))).alias("place"))
        inside = celled.drop("place").alias("a").join(home.alias("b"), [*same("a", "b"), F.col("a.cell") == F.col("b.cell")]).select("a.*", "b.place").drop("cell")
    ranked = inside.withColumn("upto", F.sum("c").over(part.orderBy("probability")))
    p95 = ranked.where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("c") <= F.col("place"))).select(*by, F.col("probability").alias("p95"))
    return counts.alias("a").join(p95.alias("b"), same("a", "b"), "left").select("a.*", "b.p95").drop("_all")


def multi_round(docs: DataFrame, rounds: int = 3) -> DataFrame:
    """``docs`` (with ``cohesion``) and the mean and population variance of their simulated rounds."""
    one = lambda i: F.struct(
        (i + 1).alias("round"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.45 + 0.3 * (1 - F.col("cohesion")) + F.sin(i + 1) * 0.03)).alias("probability"),
        F.least(F.lit(0.95), 0.6 + 0.05 * i).alias("confidence"),
    )
    with_rounds = docs.withColumn("details", F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), one))
    mean = lambda f: F.aggregate("details", F.lit(0.0), lambda s, x: s + x[f]) / rounds
    out = with_rounds.withColumns({"rounds": F.lit(rounds), "avg_probability": mean("probability"), "avg_confidence": mean("confidence")})
    spread = F.aggregate("details", F.lit(0.0), lambda s, x: s + (x["probability"] - F.col("avg_probability")) * (x["probability"] - F.col("avg_probability"))) / rounds
    return out.withColumn("variance", spread)


def respread(segments: DataFrame) -> DataFrame:
    """``segments`` with the probabilities of flat documents spread by the rank of their sentence lengths."""
    part = W.partitionBy("doc_id")
    n, k = F.count("*").over(part), F.row_number().over(part.orderBy("avg_sentence_len", "chunk_id")) - 1
    flat = F.var_pop("raw_probability").over(part) < 0.02
    return segments.withColumn("spread", F.when(flat & (n > 1), 0.10 + 0.80 * k / (n - 1)).otherwise(F.col("raw_probability")))


def cost_summary(docs: DataFrame, tokens: Column) -> DataFrame:
    """Token counts over all documents."""
    return docs.agg(F.count("*").alias("documents"), F.sum(tokens).alias("tokens"), F.max(tokens).alias("most_tokens"))


def provider_summary(judgments: DataFrame, providers: Column) -> DataFrame:
    """``provider, requested, success`` over a batch: how often each was asked, and how often its answer could be read (``ok``)."""
    return judgments.select(F.explode(F.array_distinct(providers)).alias("provider"), "ok").groupBy("provider").agg(F.count("*").alias("requested"), F.count_if("ok").alias("success"))


def latency_summary(calls: DataFrame) -> DataFrame:
    """Calls of each provider: ``total, success, failed, min_ms, avg_ms, max_ms`` from ``provider, ms, ok``."""
    return calls.groupBy("provider").agg(
        F.count("*").alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"),
        F.min("ms").alias("min_ms"), F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms"),
    )
