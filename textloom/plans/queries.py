"""The engine's queries, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.checkpoints import cut
from textloom.config import SENSITIVITY, EngineConfig
from textloom.functions import text as T
from textloom.operators import aggregate, chunk, classify, compare, features, review, score, split
from textloom.plans import pipeline, sql
from textloom.plans.registry import END, QUERIES, SQL, clean as _clean, documents as _docs, query, review_log as _log, rounded as _r
from textloom.tables import spread, table

@query(f"select doc_id, {sql.normal('text')} as text from documents")
def normalize_text(spark: SparkSession, root: str) -> DataFrame:
    return _clean(spark, root).select("doc_id", "text")


@query(f"with {sql.DOCS} select doc_id, greatest(1, coalesce(len({sql.TOKENS.format('text')}), 0)) as tokens, coalesce(len(list_distinct({sql.TOKENS.format('text')})), 0) as distinct_tokens from docs")
def token_stats(spark: SparkSession, root: str) -> DataFrame:
    t = F.size(F.array_distinct(T.tokens(F.col("text"))))
    return _clean(spark, root).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), F.when(F.col("text").isNull(), 0).otherwise(t).alias("distinct_tokens"))


@query(f"with {sql.DOCS} select doc_id, {sql.LANGUAGE} as language, coalesce(regexp_matches(lower(trim(lang)), '^(zh|ja|ko)'), false) as labelled_cjk from docs join (select doc_id, lang from documents) using (doc_id)")
def detect_language(spark: SparkSession, root: str) -> DataFrame:
    docs = spread(table(spark, root, "documents").select("doc_id", "text", "lang"), "doc_id").withColumn("text", T.normalized(F.col("text")))
    return docs.select("doc_id", T.language(F.col("text")).alias("language"), T.is_cjk(F.col("lang")).alias("labelled_cjk"))


@query(f"with {sql.DOCS}, {sql.sentences('docs', 'doc_id')} select doc_id, sent_index, start::bigint as start, end_offset::bigint as end_offset, text from sent")
def sentence_split(spark: SparkSession, root: str) -> DataFrame:
    return split.sentences(_clean(spark, root)).withColumnsRenamed(END)


@query(f"with {sql.DOCS}, {sql.PARAGRAPHS} select doc_id, block_index, start::bigint as start, end_offset::bigint as end_offset, text, 'body' as label from blocks")
def paragraph_blocks(spark: SparkSession, root: str) -> DataFrame:
    return split.paragraph_blocks(_clean(spark, root)).drop("need_detect", "merge_with_prev").withColumnsRenamed(END)


@query(f"with recursive {sql.DOCS}, {sql.sentences('docs', 'doc_id')}, {sql.PACK} select doc_id, block_index, start::bigint as start, end_offset::bigint as end_offset, text, sentence_count from packed")
def sentence_blocks(spark: SparkSession, root: str) -> DataFrame:
    return split.sentence_blocks(_clean(spark, root)).withColumnsRenamed(END)


_FEATURES = f"with {sql.DOCS}, {sql.PARAGRAPHS}, {sql.features('blocks', 'doc_id, block_index')}"


@query(f"{_FEATURES} select doc_id, block_index, " + ", ".join(f"round({c}, 6) as {c}" for c in features.FEATURES) + " from feat")
def stylometry(spark: SparkSession, root: str) -> DataFrame:
    return features.stylometry(split.paragraph_blocks(_clean(spark, root))).select("doc_id", "block_index", *map(_r, features.FEATURES))


@query(f"{_FEATURES} select doc_id, block_index, ppl from feat")
def perplexity(spark: SparkSession, root: str) -> DataFrame:
    return features.perplexity(features.stylometry(split.paragraph_blocks(_clean(spark, root)))).select("doc_id", "block_index", "ppl")


_HELD = lambda c: f"greatest(0.1, least(0.99, {c}))"
_SIX = lambda c: f"floor({c} * 1e6 + 0.5::double) / 1e6 as {c}"
_READABLE = f"fluency as (select doc_id, block_index, {_HELD('1 - 0.8 * repeat_ratio')} as fluency, {_HELD('1 - avg_sentence_len / 240')} as clarity, {_HELD('1 - ngram_repeat_rate')} as cohesion from feat)"


@query(f"{_FEATURES}, {_READABLE} select doc_id, block_index, {_SIX('fluency')}, {_SIX('clarity')}, {_SIX('cohesion')}, (fluency < 0.6)::int + (clarity < 0.6)::int + (cohesion < 0.6)::int as suggestions from fluency")
def readability(spark: SparkSession, root: str) -> DataFrame:
    rows = features.readability(features.stylometry(split.paragraph_blocks(_clean(spark, root))))
    six = lambda c: (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)
    return rows.select("doc_id", "block_index", six("fluency"), six("clarity"), six("cohesion"), F.size("suggestions").alias("suggestions"))


@query(
    f"{_FEATURES}, {_READABLE}, x as (select doc_id, block_index, cohesion, i, greatest(0, least(1, 0.45 + 0.3 * (1 - cohesion) + sin(i + 1) * 0.03)) as p, least(0.95, 0.6 + 0.05 * i) as c from fluency, (select unnest([0, 1, 2]) as i)) "
    "select doc_id, block_index, round(avg(p), 6) as avg_probability, round(avg(c), 6) as avg_confidence, round(var_pop(p), 6) as variance from x group by 1, 2"
)
def multi_round(spark: SparkSession, root: str) -> DataFrame:
    rows = features.readability(features.stylometry(split.paragraph_blocks(_clean(spark, root))))
    return aggregate.multi_round(rows).select("doc_id", "block_index", _r("avg_probability"), _r("avg_confidence"), _r("variance"))


_LANG = f"lang as (select doc_id, {sql.LANGUAGE} = 'zh' as cjk from docs)"
_SEGMENTS = f"{_FEATURES}, {_LANG}, seg_in as (select f.*, b.start, b.end_offset, l.cjk from feat f join blocks b using (doc_id, block_index) join lang l using (doc_id)), {sql.scored('seg_in')}"


@query(f"{_SEGMENTS} select doc_id, block_index as chunk_id, round(p, 6) as raw_probability, round(confidence, 6) as confidence, round(uncertainty, 6) as uncertainty from seg")
def score_segments(spark: SparkSession, root: str) -> DataFrame:
    return pipeline.segments(_clean(spark, root)).select("doc_id", "chunk_id", _r("raw_probability"), _r("confidence"), _r("uncertainty"))


_AGGREGATE = "round(coalesce(overall_p, 0), 6) as overall_probability, round(coalesce(conf, 0), 6) as overall_confidence, round(coalesce(unc, 0), 6) as overall_uncertainty, coalesce(segments, 0) as segments"


@query(f"{_SEGMENTS}, {sql.aggregated('seg')} select d.doc_id, {_AGGREGATE}, case when overall_p is null then 'pass' else {sql.overall('overall_p', 'unc', 'supported', 'medium')} end as decision from documents d left join agg using (doc_id)")
def aggregate_document(spark: SparkSession, root: str) -> DataFrame:
    return pipeline.detect(_docs(spark, root)).select("doc_id", _r("overall_probability"), _r("overall_confidence"), _r("overall_uncertainty"), "segments", "decision")


@query(
    f"{_SEGMENTS}, " + ", ".join(sql.aggregated("seg", f"agg_{s}", s) for s in SENSITIVITY) + " "
    + " union all ".join(f"select doc_id, '{s}' as sensitivity, {sql.overall('overall_p', 'unc', 'supported', s)} as decision from agg_{s}" for s in SENSITIVITY)
)
def sensitivity_sweep(spark: SparkSession, root: str) -> DataFrame:
    keep = ["doc_id", "chunk_id", "start", "end", "raw_probability", "confidence", "uncertainty", "content_strength", "human_strength"]
    base = cut(pipeline.segments(_clean(spark, root)).select(*keep))
    parts = [aggregate.aggregated(aggregate.segment_decision(base, s), s).select("doc_id", F.lit(s).alias("sensitivity"), "decision") for s in SENSITIVITY]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SENT_SEG = f"{sql.sentences('docs', 'doc_id')}, {sql.PACK}, {sql.features('packed', 'doc_id, block_index', 'sf')}, sseg_in as (select f.*, b.start, b.end_offset, l.cjk from sf f join packed b using (doc_id, block_index) join lang l using (doc_id)), {sql.scored('sseg_in', 'sseg')}"
_DUAL = f"with recursive {_SEGMENTS[5:]}, {_SENT_SEG}, {sql.aggregated('seg', 'pa')}, {sql.aggregated('sseg', 'sa')}, " """
crossed as (select a.doc_id, a.block_index as pid, b.block_index as sid, a.p as pp, b.p as sp, greatest(a.start, b.start) as f, least(a.end_offset, b.end_offset) - greatest(a.start, b.start) as o, a.end_offset - a.start as al, b.end_offset - b.start as bl
  from seg a join sseg b on a.doc_id = b.doc_id and a.start < b.end_offset and b.start < a.end_offset),
pairs as (select *, abs(pp - sp) as diff from crossed where o > 0 and o / al > 0.5 and o / bl > 0.5)"""


@query(
    f"""{_DUAL}, cmp as (select doc_id, avg(((pp > 0.5) = (sp > 0.5))::int) as agree, count(*) filter (diff > 0.2) as d from pairs group by 1),
 fu as (select d.doc_id, pa.overall_p as a, sa.overall_p as b, pa.conf as ac, sa.conf as bc, pa.mean_unc as u, pa.mean_p as mp, sa.mean_p as ms, pa.segments as np, sa.segments as ns, c.agree, c.d from documents d left join pa using (doc_id) left join sa using (doc_id) left join cmp c using (doc_id)),
 fz as (select *, case when coalesce(b, 0) > 0 then 0.6 * coalesce(a, 0) + 0.4 * b else coalesce(a, 0) end as fp, case when coalesce(b, 0) > 0 then 0.6 * coalesce(ac, 0) + 0.4 * bc else coalesce(ac, 0) end as fc, coalesce(u, 0) as fu from fu)
 select doc_id, coalesce(np, 0) as paragraph_segments, coalesce(ns, 0) as sentence_segments, round(coalesce(a, 0), 6) as paragraph_overall_probability, round(coalesce(b, 0), 6) as sentence_overall_probability,
  round(coalesce(floor(abs(mp - ms) * 10000 + 0.5) / 10000, 0), 6) as probability_diff, round(coalesce(floor(agree * 10000 + 0.5) / 10000, 1), 6) as consistency_score, coalesce(d, 0) as divergent_count,
  round(fp, 6) as fused_probability, round(fc, 6) as fused_confidence, {sql.overall('fp', 'fu', 'false', 'medium')} as fused_decision from fz"""
)
def dual_mode(spark: SparkSession, root: str) -> DataFrame:
    """The flagship: paragraph and sentence views, compared and fused."""
    rows = pipeline.detect_dual(_docs(spark, root))
    names = ["paragraph_overall_probability", "sentence_overall_probability", "probability_diff", "consistency_score", "fused_probability", "fused_confidence"]
    return rows.select("doc_id", "paragraph_segments", "sentence_segments", "divergent_count", "fused_decision", *map(_r, names))


@query(f"{_DUAL} select doc_id, pid as paragraph_id, sid as sentence_id, floor(diff * 10000 + 0.5) / 10000 as diff, o::bigint as overlap from pairs where diff > 0.2")
def divergent_regions(spark: SparkSession, root: str) -> DataFrame:
    docs = _clean(spark, root)
    numbers = pipeline.both_views(docs)
    pairs = compare.matched(*(numbers.where(F.col("mode") == m) for m in ("paragraph", "sentence")))
    far = compare.divergent(pairs, docs)
    return far.select("doc_id", "paragraph_id", "sentence_id", "diff", "overlap")


_STEP = """greatest(0.02, least(0.98, s4 + case when ttr < 0.58 then 0.18 when ttr > 0.80 then -0.16 when ttr > 0.75 then -0.10 else 0 end + case when repeat_ratio > 0.30 then 0.16 when repeat_ratio > 0.20 then 0.10 else 0 end
 + case when ngram_repeat_rate > 0.20 then 0.18 when ngram_repeat_rate > 0.12 then 0.10 else 0 end + case when avg_sentence_len > 140 then 0.06 when avg_sentence_len > 100 then 0.03 when avg_sentence_len < 40 then -0.03 else 0 end
 + case when ppl < 70 then 0.18 when ppl < 90 then 0.12 when ppl > 220 then -0.12 when ppl > 180 then -0.08 else 0 end))"""


@query(
    f"""{_FEATURES}, a1 as (select f.*, b.start, b.end_offset, case when ttr < 0.55 and ppl < 90 and (repeat_ratio > 0.18 or ngram_repeat_rate > 0.12) then greatest(0.5, 0.72 + least(0.18, 0.12 * greatest(0, (0.55 - ttr) / 0.05))) else 0.5 end as s1 from feat f join blocks b using (doc_id, block_index)),
 a2 as (select *, case when ttr >= 0.72 and ppl >= 180 and repeat_ratio <= 0.15 and avg_sentence_len >= 28 then least(s1, 0.38) else s1 end as s2 from a1),
 a3 as (select *, case when ttr < 0.62 or repeat_ratio > 0.18 or ngram_repeat_rate > 0.10 then greatest(s2, 0.60) else s2 end as s3 from a2),
 a4 as (select *, case when ttr > 0.78 and avg_sentence_len > 35 and repeat_ratio < 0.12 then least(s3, 0.40) else s3 end as s4 from a3),
 a5 as (select doc_id, {_STEP} as p, greatest(50, end_offset - start) as w, least(0.55 + least(chars / 1800, 0.35), 0.95) as c from a4),
 a6 as (select doc_id, sum(p * w) / sum(w) as p, sum(c * w) / sum(w) as c from a5 group by 1)
 select doc_id, round(p, 6) as overall_probability, round(c, 6) as overall_confidence, {sql.base('p', 0.65, 0.85)} as decision from a6"""
)
def legacy_score(spark: SparkSession, root: str) -> DataFrame:
    rows = features.perplexity(features.stylometry(split.paragraph_blocks(_clean(spark, root))))
    return aggregate.aggregated_legacy(score.scored_legacy(rows)).select("doc_id", _r("overall_probability"), _r("overall_confidence"), "decision")


_T = "t as (select doc_id, block_index, text as raw, {0} as t from blocks)".format(sql.trim("text"))
_ENDS = "regexp_matches(t, '[。！？.!?]$')"
_RULES = f"""{_T}, r as (select doc_id, block_index, t, length(t) as n, {_ENDS} as stopped, len(regexp_extract_all(t, '[0-9]')) / greatest(length(t), 1) as digits, {sql.letters('t')} / greatest(length(t), 1) as letters from t),
cls as (select doc_id, block_index, case
 when n = 0 or regexp_matches(t, '^(图|表|Figure|Fig\\.|Table)[{sql.WS}]*\\p{{Nd}}+') or digits > 0.6 or (n < 25 and not stopped and digits > 0.3) or (letters < 0.1 and n < 50) then 'noise'
 when lower(t) in ('目录', 'contents', 'table of contents') or regexp_matches(t, '[.·-]{{3,}}[{sql.WS}]*\\p{{Nd}}+[{sql.WS}]*$') or (n < 80 and regexp_matches(t, '^\\p{{Nd}}+\\.?\\p{{Nd}}*\\.?\\p{{Nd}}*[{sql.WS}]+[^\\n]+[{sql.WS}]+\\p{{Nd}}+$')) then 'toc'
 when lower(t) in ('参考文献', 'references', 'bibliography', 'works cited') or regexp_matches(t, '^\\[\\p{{Nd}}+\\]') or (regexp_matches(t, '^[A-Z\\x{{4e00}}-\\x{{9fff}}][a-z\\x{{4e00}}-\\x{{9fff}}]*[,，]?[{sql.WS}]*[^\\n]+[(\\[]?\\p{{Nd}}{{4}}[)\\]]?') and not contains(t, 'http')
   and regexp_matches(t, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(19|20)\\p{{Nd}}{{2}}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') and (contains(t, 'Vol.') or contains(t, 'pp.') or contains(t, 'doi:') or contains(t, 'ISBN') or n < 200)) then 'reference'
 when n <= 60 and not stopped and (regexp_matches(t, '^(\\p{{Nd}}+\\.?\\p{{Nd}}*\\.?\\p{{Nd}}*[{sql.WS}]|第[一二三四五六七八九十百千]+[章节部分条款]|Chapter[{sql.WS}]+\\p{{Nd}}+|Section[{sql.WS}]+\\p{{Nd}}+|Part[{sql.WS}]+\\p{{Nd}}+)') or (n <= 30 and letters > 0.7)) then 'title'
 when n > 100 and stopped then 'body' end as category from r)"""


@query(f"with {sql.DOCS}, {sql.PARAGRAPHS}, {_RULES} select doc_id, block_index, category from cls")
def classify_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    return classify.classified(split.paragraph_blocks(_clean(spark, root))).select("doc_id", "block_index", "category")


@query(f"with {sql.DOCS}, {sql.PARAGRAPHS}, {_RULES} select doc_id, count(*) as total_paragraphs, count(*) filter (coalesce(category, 'body') = 'body') as body_count, count(*) filter (category <> 'body') as filtered_count, count(*) filter (category <> 'body') as filtered_by_rule, 0::bigint as filtered_by_llm from cls group by 1")
def filter_summary(spark: SparkSession, root: str) -> DataFrame:
    return classify.filter_summary(classify.settled(classify.classified(split.paragraph_blocks(_clean(spark, root)))))


@query("with l as (select distinct * from review_log), v as (select decision, overall_probability as p, row_number() over (partition by decision order by overall_probability) - 1 as k, count(*) over (partition by decision) as n from l where overall_probability is not null), q as (select decision, p as p95 from v where k = round_even(0.95 * (n - 1), 0)::bigint) select l.decision, count(*) as count, count(*) filter (overall_probability is null) as fail_count, round(avg(overall_probability), 6) as average, round(any_value(q.p95), 6) as p95 from l left join q on q.decision is not distinct from l.decision group by 1")
def batch_summary(spark: SparkSession, root: str) -> DataFrame:
    rows = aggregate.batch_summary(_log(spark, root).withColumnRenamed("overall_probability", "probability"), ("decision",))
    return rows.select("decision", "count", "fail_count", _r("average"), _r("p95"))


_CAL = "l as (select distinct * from review_log), s as (select avg(overall_probability) filter (label = 1) as m1, avg(overall_probability) filter (label = 0) as m0, count(*) filter (label = 1) as n1, count(*) filter (label = 0) as n0 from l where overall_probability is not null), cal as (select case when n1 > 0 and n0 > 0 then greatest(0.5, least(3, abs(m1 - m0) * 6)) else 1 end as a, case when n1 > 0 and n0 > 0 then ln((n1 + 1) / (n0 + 1)) else 0 end as b from s)"


@query(f"with {_CAL} select round(a, 6) as a, round(b, 6) as b from cal")
def calibrate(spark: SparkSession, root: str) -> DataFrame:
    return review.calibration(_log(spark, root).withColumnRenamed("overall_probability", "probability")).select(_r("a"), _r("b"))


@query(f"with {_CAL}, c as (select request_id, ts, 1 / (1 + exp(-(a * ln(greatest(1e-6, least(1 - 1e-6, overall_probability)) / (1 - greatest(1e-6, least(1 - 1e-6, overall_probability)))) + b))) as c from l, cal) select request_id, ts, round(c, 6) as calibrated, {sql.base('c', 0.65, 0.85)} as decision from c where c is not null")
def apply_calibration(spark: SparkSession, root: str) -> DataFrame:
    log = _log(spark, root).withColumnRenamed("overall_probability", "probability")
    return review.calibrated(log, review.calibration(log)).where("calibrated is not null").select("request_id", "ts", _r("calibrated"), "decision")


@query("with l as (select distinct * from review_log where label in (0, 1) and decision in ('pass', 'flag')), s as (select count(*) filter (decision = 'flag' and label = 1) as tp, count(*) filter (decision = 'pass' and label = 0) as tn, count(*) filter (decision = 'flag' and label = 0) as fp, count(*) filter (decision = 'pass' and label = 1) as fn from l), m as (select *, (tp + tn) / greatest(1, tp + tn + fp + fn) as accuracy, tp / greatest(1, tp + fp) as precision_, tp / greatest(1, tp + fn) as recall_ from s) select tp, tn, fp, fn, round(accuracy, 6) as accuracy, round(precision_, 6) as precision, round(recall_, 6) as recall, round(2 * precision_ * recall_ / greatest(1e-6, precision_ + recall_), 6) as f1 from m")
def review_metrics(spark: SparkSession, root: str) -> DataFrame:
    return review.metrics(_log(spark, root)).select("tp", "tn", "fp", "fn", _r("accuracy"), _r("precision"), _r("recall"), _r("f1"))


@query("with l as (select distinct * from review_log) select count(*) as total, count(*) filter (decision = 'pass') as pass, count(*) filter (decision = 'review') as review, count(*) filter (decision = 'flag') as flag from l")
def review_counts(spark: SparkSession, root: str) -> DataFrame:
    return review.decision_counts(_log(spark, root))


@query("with l as (select request_id, max(ts) as ts from review_log group by 1) select request_id, ts, (select count(*) from l) as total from l order by ts desc nulls last, request_id limit 100")
def history_latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest hundred: the limit is the feature."""
    return review.latest(_log(spark, root).groupBy("request_id").agg(F.max("ts").alias("ts")))


@query(f"with {sql.DOCS}, {sql.PARAGRAPHS} select doc_id, block_index, left(lag(text) over (partition by doc_id order by block_index), 600) as previous_text, left(lead(text) over (partition by doc_id order by block_index), 600) as next_text from blocks")
def neighbor_context(spark: SparkSession, root: str) -> DataFrame:
    return classify.neighbours(split.paragraph_blocks(_clean(spark, root))).select("doc_id", "block_index", "previous_text", "next_text")


_EST = f"greatest(1, len({sql.TOKENS.format('text')}))"


@query(
    f"with {sql.DOCS}, {sql.PARAGRAPHS}, n as (select *, count(*) over (partition by doc_id) as n, {_EST} as k from blocks), c as (select *, sum(k) over (partition by doc_id order by block_index) as upto from n where block_index < 3 or block_index >= n - 2 or (n > 6 and block_index >= 3 and block_index < n - 2 and (block_index - 3) % greatest((n - 5) // 4, 1) = 0)), "
    f"j as (select doc_id, string_agg(text, chr(10) || chr(10) order by block_index) as j from c where upto <= 6000 group by 1) select doc_id, case when {_EST} <= 6000 then text else coalesce(j, case when length(text) > 4000 then left(text, 4000) || '...' else text end) end as sample from docs left join j using (doc_id) where text is not null"
)
def profile_sample(spark: SparkSession, root: str) -> DataFrame:
    clean = _clean(spark, root)
    return chunk.profile_sample(clean, split.paragraph_blocks(clean))


@query(f"with {sql.DOCS}, {sql.sentences('docs', 'doc_id')} select doc_id, sent_index, case when length(text) < 50 then 'local' when length(text) < 300 then 'llm' else 'reasoner' end as tier, row_number() over (partition by doc_id order by sent_index) - 1 as chunk_id from sent where length(text) >= 10")
def sentence_tiers(spark: SparkSession, root: str) -> DataFrame:
    return classify.sentence_tiers(split.sentences(_clean(spark, root))).select("doc_id", "sent_index", "tier", "chunk_id")


_ABBR = "|".join(x.replace(".", "\\.") for x in classify.ABBREVIATIONS)


@query(
    f"with {sql.DOCS}, {sql.sentences('docs', 'doc_id')}, w as (select doc_id, sent_index, text as l, lead(text) over (partition by doc_id order by sent_index) as r from sent), "
    f"""d as (select * from w where r is not null and (not regexp_matches(l, '[。！？.!?…]$') or len(regexp_extract_all(l, '[{sql._Q}]')) % 2 = 1 or len(regexp_extract_all(r, '[{sql._Q}]')) % 2 = 1 or len(regexp_extract_all(l, '\\(')) > len(regexp_extract_all(l, '\\)'))
 or (l like '%.' and (regexp_matches(lower(l), '({_ABBR})$') or regexp_matches(l, '[A-Z]\\.$') or regexp_matches(r, '^[a-z]')))))
 select doc_id, sent_index, l as left_text, r as right_text from (select *, row_number() over (partition by doc_id order by sent_index) as k from d) where k <= 240"""
)
def boundary_candidates(spark: SparkSession, root: str) -> DataFrame:
    return classify.boundary_candidates(split.sentences(_clean(spark, root)))


@query(f"with {sql.DOCS} select count(*) as documents, sum({_EST})::bigint as tokens, max({_EST})::bigint as most_tokens from docs where text is not null")
def cost_summary(spark: SparkSession, root: str) -> DataFrame:
    return aggregate.cost_summary(_clean(spark, root).where("text is not null"), T.token_estimate(F.col("text")).cast("bigint"))


@query(f"{_SEGMENTS} select doc_id, block_index as id, printf('%.1f%%', floor(p * 1000 + 0.5) / 10) as raw_probability, case when p <= 0.3 then 'low' when p < 0.7 then 'medium' else 'high' end as colour from seg")
def segment_report(spark: SparkSession, root: str) -> DataFrame:
    p = F.col("raw_probability")
    shown = T.percent(F.floor(p * 1000 + 0.5) / 1000)
    return pipeline.segments(_clean(spark, root)).select("doc_id", F.col("chunk_id").alias("id"), shown.alias("raw_probability"), T.colour(p).alias("colour"))


def entry(spark: SparkSession, root: str = "/root/testdata/sf0.001") -> DataFrame:
    return dual_mode(spark, root)


__all__ = ["QUERIES", "SQL", "EngineConfig", "entry", "query"]
