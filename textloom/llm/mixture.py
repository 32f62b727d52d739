"""Mixing sources to target weights under caps on repetition (problem 8).

Method: capped water-filling.  Every source is to have its share of the wanted
size; a source that would need more epochs than it may have is clamped there,
and what it lacks goes to the others in proportion to their weights, until no
cap is broken.  A source's epochs are then a whole number of copies of all its
documents, and one more copy of a seeded part of them.

The part is cut by a hash of the id at a threshold found from sums over hash
buckets, in two levels, so no source is ever sorted or gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.llm import byte_bpe

BUCKETS = 4096


def source_name(source: Column) -> Column:
    """One spelling of a source: trimmed and in lower case."""
    return F.lower(F.trim(source))


def sizes(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """``doc_id, source, tokens`` of every document; empty and null texts have 0 tokens, sources are in one spelling."""
    ids = byte_bpe.encode_corpus(docs, ranks_path=ranks_path, also=["source"])
    return ids.select("doc_id", source_name(F.col("source")).alias("source"), F.size("ids").cast("bigint").alias("tokens"))


def fill(have: dict[str, int], targets: dict[str, tuple[float, int]], wanted: float | None = None) -> dict[str, float]:
    """Tokens to take from each source.

    ``have``: tokens of each source; ``targets``: share and most epochs; ``wanted``:
    the mixture's size, by default that of all sources with a target.  Sources
    without documents or without a target get none.  Where even all caps together
    fall short of ``wanted``, every source is used up to its cap.
    """
    cap = {s: have[s] * max(0, m) for s, (w, m) in targets.items() if have.get(s, 0) > 0 and w > 0}
    left = float(sum(have[s] for s in cap) if wanted is None else wanted)
    take = {}
    open_ = {s for s in cap if cap[s] > 0}
    while open_:
        weight = sum(targets[s][0] for s in open_)
        over = sorted(s for s in open_ if left * targets[s][0] / weight > cap[s])
        if not over:
            take |= {s: left * targets[s][0] / weight for s in open_}
            break
        for s in over:
            take[s] = float(cap[s])
            left -= cap[s]
            open_.discard(s)
    return take


def _bucket(seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BUCKETS * BUCKETS))


def plan(sized: DataFrame, targets: DataFrame, wanted: float | None = None, seed: int = 11) -> list[tuple]:
    """(source, target share, most epochs, tokens, wanted tokens, whole copies, threshold) of each source with a target.

    ``sized``: ``doc_id, source, tokens``.  What reaches the driver is one row a
    source and at most BUCKETS rows a source and level; the table of targets bounds them.
    """
    goal = {r.name: (r.target_share, r.max_repeats) for r in targets.select(source_name(F.col("source")).alias("name"), "target_share", "max_repeats").where("name is not null").collect()}
    known = sized.where(F.col("source").isin(*goal)) if goal else sized.where("false")
    high = known.groupBy("source", F.floor(_bucket(seed) / BUCKETS).cast("int").alias("b")).agg(F.sum("tokens").alias("tokens")).collect()
    have: dict[str, int] = {}
    first: dict[str, dict[int, int]] = {}
    for r in high:
        have[r.source] = have.get(r.source, 0) + r.tokens
        first.setdefault(r.source, {})[r.b] = r.tokens
    take = fill(have, goal, wanted)
    whole, rest, edge = {}, {}, {}
    for s, n in take.items():
        whole[s] = int(n // have[s])
        rest[s] = n - whole[s] * have[s]
        for b in range(BUCKETS):
            inside = first[s].get(b, 0)
            if inside > rest[s]:
                break
            rest[s] -= inside
        edge[s] = b
    inner: dict[str, dict[int, int]] = {}
    if edge:
        at = F.create_map(*[F.lit(x) for pair in edge.items() for x in pair])
        for r in (
            known.where(F.floor(_bucket(seed) / BUCKETS).cast("int") == at[F.col("source")])
            .groupBy("source", F.pmod(_bucket(seed), F.lit(BUCKETS)).cast("int").alias("b")).agg(F.sum("tokens").alias("tokens")).collect()
        ):
            inner.setdefault(r.source, {})[r.b] = r.tokens
    out = []
    for s, (share, most) in sorted(goal.items()):
        limit = 0
        if s in take:
            for b in range(BUCKETS):
                inside = inner.get(s, {}).get(b, 0)
                # the document at the edge is taken if that comes nearer
                if inside > 2 * rest[s]:
                    break
                rest[s] -= inside
            else:
                b = BUCKETS
            limit = edge[s] * BUCKETS + b
        if s in take and whole[s] >= most:
            limit = 0
        out.append((s, share, most, have.get(s, 0), take.get(s, 0.0), whole.get(s, 0), limit))
    return out


PLAN = "source string, target_share double, max_repeats int, tokens bigint, wanted double, whole int, threshold bigint"


def mix(spark: SparkSession, sized: DataFrame, planned: list[tuple], seed: int = 11) -> DataFrame:
    """``doc_id, source, tokens, copies`` of the documents used at least once."""
    plans = F.broadcast(spark.createDataFrame(planned, PLAN).select("source", "whole", "threshold"))
    copies = F.col("whole") + (_bucket(seed) < F.col("threshold")).cast("int")
    return sized.join(plans, "source").select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def shares(spark: SparkSession, mixed: DataFrame, planned: list[tuple]) -> DataFrame:
    """What each source contributes: one row a target, with its share as wanted and as reached, epochs, and whether its cap holds it back."""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    rows = F.broadcast(spark.createDataFrame(planned, PLAN)).join(used, "source", "left")
    n = F.coalesce("mixed_tokens", F.lit(0)).cast("bigint")
    total = used.agg(F.sum("mixed_tokens").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "tokens", n.alias("mixed_tokens"),
        F.coalesce(n / F.col("total"), F.lit(0.0)).alias("actual_share"),
        F.when(F.col("tokens") > 0, n / F.col("tokens")).otherwise(0.0).alias("epochs"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        (F.col("wanted") >= F.col("tokens") * F.col("max_repeats")).alias("capped"),
    )
