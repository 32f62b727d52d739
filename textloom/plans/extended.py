"""Further queries: judgments, chunks, structured nodes, profiles, the content filter, and the archived implementation's variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.checkpoints import cut
from textloom.functions import text as T
from textloom.operators import aggregate, chunk, classify, compare, features, judge, nodes, profile, score, split
from textloom.plans import pipeline, queries as base, sql
from textloom.plans.queries import entry
from textloom.plans.registry import END, QUERIES, SQL, clean, documents, query, rounded as r
from textloom.sources import files
from textloom.tables import table

_BLOCKS = f"{sql.DOCS}, {sql.PARAGRAPHS}"
_SEGMENTS = base._SEGMENTS
_SIX = lambda c, name=None: f"round({c}, 6) as {name or c}"
_KEY = lambda c: f"(doc_id * 7 + {c} * 3)"


def _k(c: str):
    return F.col("doc_id") * 7 + F.col(c) * 3


# judgments

_IDS = list(judge.EVIDENCE)


def _judgments(segments: DataFrame) -> DataFrame:
    """A table of judgments made up from the keys, as an outside judge would leave it.

    Some segments have none, some an answer that can't be read, some one without
    confidence or signals, some values out of range; ids are spelled unevenly, some
    are unknown, and some signals say nothing they rest on.
    """
    k = _k("chunk_id")
    ids = F.array(*map(F.lit, _IDS))
    item = lambda name, n, told: F.concat(F.lit('{"id":"'), name, F.lit('","score":'), F.format_string("%.2f", n / 100.0), F.lit(',"evidence":"'), told, F.lit('"}'))
    one = F.get(ids, (k % 8).cast("int"))
    spelled = F.when(k % 5 == 0, F.concat(F.lit(" "), F.upper(one), F.lit(" "))).otherwise(one)
    signals = F.concat(
        F.lit("["), item(spelled, (k % 41 - 20) * 8, F.lit("seen")), F.lit(","), item(F.get(ids, ((k + 3) % 8).cast("int")), (k % 31 - 15) * 5, F.lit("x")), F.lit(","),
        item(F.get(ids, ((k + 5) % 8).cast("int")), (k % 13 - 6) * 10, F.when(k % 2 == 0, " ").otherwise("why")), F.lit(","), item(F.lit("other"), F.lit(90), F.lit("y")), F.lit("]"),
    )
    number = lambda n: F.format_string("%.2f", n / 100.0)
    full = lambda p, c, u: F.concat(F.lit('So: {"probability":'), p, F.lit(',"confidence":'), c, F.lit(',"uncertainty":'), u, F.lit(',"signals":'), signals, F.lit("} done"))
    text = (
        F.when(k % 12 == 1, "no judgment {at all").when(k % 12 == 2, F.concat(F.lit('{"probability":'), number(k % 100), F.lit("}")))
        .when(k % 12 == 3, full(F.lit("1.7"), F.lit("-0.5"), F.lit("1.5"))).otherwise(full(number(k % 100), number(50 + k % 40), F.when(k % 3 == 0, "null").otherwise(number(k % 60))))
    )
    return segments.where(k % 12 != 0).select("doc_id", "chunk_id", text.alias("response_json"))


_LIST = lambda items: "[" + ", ".join(str(x) for x in items) + "]"
_W, _TAKEN = _LIST(judge.EVIDENCE.values()), _LIST(judge.ACADEMIC.get(k, 0.0) for k in _IDS)
_STRONGEST = lambda ids, sign="": f"coalesce(list_max([x.s * {sign}1 for x in sig if x.i in ({ids})]), 0)"
_JUDGED = f"""{_SEGMENTS}, j as (select *, {_KEY('block_index')} as k, case doc_id % 3 when 0 then 0.0 when 1 then 0.6 else 1.0 end as academic from seg),
 j0 as (select *, k % 12 = 1 as failed, k % 12 > 1 as has, k % 12 = 2 as bare, k % 12 = 3 as wild from j),
 j1 as (select *, case when wild then 1.0 else (k % 100) / 100 end as llm, case when wild then 0.0 when bare then 0.6 else (50 + k % 40) / 100 end as c0,
   case when wild then 1.0 when bare or k % 3 = 0 then null else (k % 60) / 100 end as u0,
   case when not has or bare then [] else list_filter([{{'i': k % 8, 's': greatest(-1, least(1, (k % 41 - 20) * 8 / 100)), 'told': true}},
     {{'i': (k + 3) % 8, 's': greatest(-1, least(1, (k % 31 - 15) * 5 / 100)), 'told': true}}, {{'i': (k + 5) % 8, 's': (k % 13 - 6) * 10 / 100, 'told': k % 2 <> 0}}], lambda x: x.told) end as sig from j0),
 j2 as (select *, case when len(sig) > 0 then 1 / (1 + exp(-greatest(-3, least(3, list_sum([x.s * {_W}[x.i + 1] * (1 - {_TAKEN}[x.i + 1] * academic) for x in sig]))))) end as e,
   greatest(0, {_STRONGEST('1, 5')}) as content, greatest(0, {_STRONGEST('0, 2, 3, 4')}) as structural, greatest(0, {_STRONGEST('6, 7', '-')}) as against from j1),
 j3 as (select *, case when e is null then llm else llm * (1 - (0.2 + 0.4 * abs(llm - e))) + e * (0.2 + 0.4 * abs(llm - e)) end as a,
   c0 * (1 - coalesce(u0, 0)) * case when e is null then 1 else 0.6 + 0.4 * (1 - abs(llm - e)) end as c from j2),
 j4 as (select *, greatest(abs(a - p), coalesce(0.8 * abs(a - e), 0)) as kf, structural > 0.45 and content < 0.2 and academic > 0 as doubt,
   case when e is null then greatest(0.5, coalesce(u0, 1 - c)) else least(1, coalesce(u0, 1 - c) + 0.35 * abs(a - e)) end as u from j3),
 j5 as (select *, greatest(0.15, least(0.62, 0.27 + 0.45 * c + 0.15 * least(chars / 1200, 1) - 0.75 * kf)) as w from j4)"""


@query(f"""{_JUDGED} select doc_id, block_index as chunk_id, round(case when has then w * a + (1 - w) * p else p end, 6) as fused_probability,
 round(case when has then (0.55 * c + 0.45 * confidence) * (1 - 0.35 * kf) else confidence end, 6) as fused_confidence,
 round(case when has then case when doubt then least(1, u + 0.12 * academic) else u end when failed then greatest(uncertainty, 0.5) else uncertainty end, 6) as fused_uncertainty,
 round(case when has then content else 0 end, 6) as content_strength, round(case when has then against else 0 end, 6) as human_strength, round(case when has then structural else 0 end, 6) as structural_strength,
 case when failed then 'llm_failed_local_only' when has and doubt then 'academic_structure_uncertainty_boost' else '' end as notes from j5""")  # fmt: skip
def evidence_fusion(spark: SparkSession, root: str) -> DataFrame:
    academic = F.when(F.col("doc_id") % 3 == 0, 0.0).when(F.col("doc_id") % 3 == 1, 0.6).otherwise(1.0)
    segments = pipeline.segments(clean(spark, root))
    rows = judge.fused(segments, _judgments(segments.select("doc_id", "chunk_id")), academic)
    names = ["fused_probability", "fused_confidence", "fused_uncertainty", "content_strength", "human_strength", "structural_strength"]
    return rows.select("doc_id", "chunk_id", *map(r, names), F.array_join("notes", ",").alias("notes"))


@query(f"{_JUDGED} select doc_id, block_index as chunk_id, n.id as id, round(n.s, 6) as score, round(n.w, 6) as weight from (select doc_id, block_index, unnest([{{'id': {[*_IDS]}[x.i + 1], 's': x.s, 'w': {_W}[x.i + 1]}} for x in sig]) as n from j1 where has)")
def evidence_list(spark: SparkSession, root: str) -> DataFrame:
    """The signals that count, with their weights outside academic writing."""
    found = judge.judged(_judgments(split.paragraph_blocks(clean(spark, root)).withColumnRenamed("block_index", "chunk_id").select("doc_id", "chunk_id")))
    return found.select("doc_id", "chunk_id", F.explode("evidence").alias("x")).select("doc_id", "chunk_id", "x.id", r("x.score", "score"), r("x.weight", "weight"))


@query(f"""{_SEGMENTS}, j as (select doc_id, block_index, p, case when {_KEY('block_index')} % 4 = 0 then null when doc_id % 5 = 0 then 0.5 else ({_KEY('block_index')} % 100) / 100 end as llm from seg),
 g as (select doc_id, count(llm) as n, var_pop(llm) as vl, var_pop(p) filter (llm is not null) as vp from j group by 1),
 w as (select *, greatest(0.2, least(0.55, 0.3 + 0.25 * vl / greatest(1e-9, vl + vp))) as w, n > 1 and vl < 1e-4 as constant from g)
 select doc_id, block_index as chunk_id, round(case when llm is null or constant then p else greatest(0.02, least(0.98, p * (1 - w) + llm * w)) end, 6) as fused_probability from j join w using (doc_id)""")  # fmt: skip
def adaptive_fusion(spark: SparkSession, root: str) -> DataFrame:
    k = _k("chunk_id")
    llm = F.when(k % 4 == 0, None).when(F.col("doc_id") % 5 == 0, 0.5).otherwise((k % 100) / 100)
    segments = pipeline.segments(clean(spark, root)).withColumn("llm_probability", llm)
    return judge.adaptively_fused(segments).select("doc_id", "chunk_id", r("fused_probability"))


# chunks

_LEGACY = """lb as (
  select doc_id, row_number() over (partition by doc_id order by i) as k, s as bs, e as be from (
    select doc_id, i, sum(length(x)) over (partition by doc_id order by i) - length(x) as s, sum(length(x)) over (partition by doc_id order by i) as e, x
    from (select doc_id, unnest(xs) as x, generate_subscripts(xs, 1) as i from (select doc_id, string_split(regexp_replace(text, '(\\n)(\\n+)', '\\1' || chr(1) || '\\2' || chr(1), 'g'), chr(1)) as xs from docs where text is not null)))
  where i % 2 = 1 and length(x) > 0)"""
_N = lambda x: f"len({sql.TOKENS.format(x)})"


@query(f"with {sql.DOCS}, {_LEGACY} select doc_id, (k - 1)::int as block_index, bs::int as start, be::int as end_offset, {sql.trim('substr(text, (bs + 1)::bigint, (be - bs)::bigint)')} as text from lb join docs using (doc_id)")
def legacy_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    return split.legacy_paragraph_blocks(clean(spark, root)).withColumnsRenamed(END)


@query(f"""with recursive {sql.DOCS}, {_LEGACY}, walk as (
  select doc_id, 0 as step, 1::bigint as k, null::bigint as cur, 0::bigint as acc, bs::bigint as beg, null::bigint as es, null::bigint as ee from lb where k = 1
  union all
  select doc_id, step + 1, case when cutting then k else k + 1 end, case when cutting then stop end, case when cutting then 0 else acc + bt end, case when cutting then stop else beg end, case when cutting then beg end, case when cutting then stop end
  from (select *, pos + greatest(1, least(be - pos, round_even(greatest(1.0::double, (be - pos) / bt) * greatest(1, 600 - acc), 0)::bigint)) as stop, acc + bt >= 600 and pos < be as cutting
    from (select *, greatest(1, {_N('substr(text, pos + 1, be - pos)')}) as bt
      from (select w.*, coalesce(w.cur, b.bs)::bigint as pos, b.be::bigint as be, d.text from walk w join lb b using (doc_id, k) join docs d using (doc_id)))))
 , ends as (select doc_id, max_by(beg, step) as beg, max(k) as k from walk group by 1),
 found as (select doc_id, es, ee from walk where es is not null union all select doc_id, beg, be::bigint from ends join (select doc_id, max(be) as be from lb group by 1) using (doc_id) where be > beg
  union all select doc_id, 0, 0 from docs where text = '')
 select doc_id, (row_number() over (partition by doc_id order by es, ee) - 1)::int as chunk_id, es::int as start, ee::int as end_offset, substr(text, es + 1, ee - es) as text from found join docs using (doc_id)""")  # fmt: skip
def token_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunk.token_chunks(clean(spark, root)).withColumnsRenamed(END)


@query(f"""with recursive {_BLOCKS}, sl as (select doc_id, block_index as chunk_id, char_start, text, greatest(1, {_N('text')}) > 270 as long from blocks),
 sp as (select doc_id, chunk_id, unnest(xs) as x, generate_subscripts(xs, 1) as i from (select doc_id, chunk_id, string_split(regexp_replace(text, '([。！？?!])([{sql.WS}]+)', '\\1' || chr(1) || '\\2' || chr(1), 'g'), chr(1)) as xs from sl where long)),
 so as (select *, sum(length(x)) over (partition by doc_id, chunk_id order by i) - length(x) as a from sp),
 sn as (select doc_id, chunk_id, row_number() over (partition by doc_id, chunk_id order by i) as k, a::bigint as a, (a + length(x))::bigint as b, greatest(1, {_N('x')}) as n from so where i % 2 = 1 and length(x) > 0),
 fold as (
  select doc_id, chunk_id, 0::bigint as k, 0::bigint as beg, 0::bigint as fin, 0::bigint as held, null::bigint as es, null::bigint as ee from sl where long
  union all
  select doc_id, chunk_id, k, case when closing then a else beg end, b, case when closing then n else held + n end, case when closing then beg end, case when closing then fin end
  from (select n.*, f.beg, f.fin, f.held, ((f.held >= 180 and f.held + n.n > 198) or f.held + n.n > 270) and f.fin > f.beg as closing from fold f join sn n on n.doc_id = f.doc_id and n.chunk_id = f.chunk_id and n.k = f.k + 1)
 ), found as (select doc_id, chunk_id, es, ee from fold where es is not null
  union all select doc_id, chunk_id, max_by(beg, k), max_by(fin, k) from fold group by 1, 2 having max_by(fin, k) > max_by(beg, k)
  union all select doc_id, chunk_id, 0, length(text) from sl where not long and length(text) > 0)
 select doc_id, chunk_id::int as chunk_id, (row_number() over (partition by doc_id, chunk_id order by es) - 1)::int as part, (es + char_start)::int as start, (ee + char_start)::int as end_offset, substr(text, es + 1, ee - es) as text from found join sl using (doc_id, chunk_id)""")  # fmt: skip
def split_long(spark: SparkSession, root: str) -> DataFrame:
    blocks = split.exploded(clean(spark, root), split.paragraph_array(F.col("text"), chars=True), "chunk_id")
    return chunk.split_long(blocks, 180).withColumnsRenamed(END)


_TITLE = f"(length(regexp_replace(text, '[{sql.WS}]+', '', 'g')) = 0 or (length(regexp_replace(text, '[{sql.WS}]+', '', 'g')) < 20 and not regexp_matches(text, '[。.！!？?]')))"


@query(f"""with {_BLOCKS}, m1 as (select *, {_TITLE} as title, count(*) over (partition by doc_id) as n from blocks),
 m2 as (select *, max(case when not title then block_index end) over (partition by doc_id) as last_body, coalesce(lag(title) over (partition by doc_id order by block_index), false) as after_title from m1),
 m3 as (select *, case when n = 1 or last_body is null then block_index else sum(case when not after_title and block_index <= last_body then 1 else 0 end) over (partition by doc_id order by block_index) end as home from m2),
 m4 as (select doc_id, home, min(start) as start, max(end_offset) as end_offset, min(char_start) as cs, max(char_start + length(text)) as ce from m3 group by 1, 2)
 select doc_id, (row_number() over (partition by doc_id order by home) - 1)::int as block_index, start::int as start, end_offset::int as end_offset, substr(text, (cs + 1)::bigint, (ce - cs)::bigint) as text from m4 join docs using (doc_id)""")  # fmt: skip
def merged_titles(spark: SparkSession, root: str) -> DataFrame:
    return chunk.merge_titles(clean(spark, root), split.paragraph_array(F.col("text"))).withColumnsRenamed(END)


_PACKS = sql.PACK.replace("sent_index as k", "block_index as k").replace("from sent)", "from blocks)").replace("> 300", "> 1000").replace("<= 300", "<= 1000").replace("<= 200", "<= 500").replace("' ' order", "chr(10) || chr(10) order")


@query(f"with recursive {_BLOCKS}, {_PACKS} select doc_id, block_index::int as block_index, start::int as start, end_offset::int as end_offset, text, sentence_count as paragraph_count from packed")
def paragraph_packs(spark: SparkSession, root: str) -> DataFrame:
    return split.paragraph_packs(clean(spark, root)).withColumnsRenamed(END)


# sharpening and spreading

_SHARP = f"""with recursive {_SEGMENTS[5:]}, d1 as (select doc_id, list(p order by block_index) as ps, list(confidence order by block_index) as cs, list(block_index order by block_index) as ids, list_sort(list(p)) as o, count(*) as n from seg group by 1),
 d2 as (select *, o[(n // 2 + 1)::int] as m, greatest(1e-6, o[(3 * n // 4 + 1)::int] - o[(n // 4 + 1)::int]) as iqr, list_avg(ps) as mean, list_aggregate(ps, 'stddev_pop') as sd from d1),
 d3 as (select *, [ln(greatest(1e-6, least(1 - 1e-6, x)) / (1 - greatest(1e-6, least(1 - 1e-6, x)))) + least(1.45 * (1 + greatest(0, (0.06 - sd) * 10)), 2.5) * ((x - m) / (iqr / 1.349)) * (0.6 + 0.4 * greatest(0.3, least(0.92, cs[i]))) for x, i in ps] as ls from d2),
 half as (select doc_id, 0 as step, -6.0::double as lo, 6.0::double as hi from d3
  union all select doc_id, step + 1, case when list_avg([case when l - (lo + hi) / 2 > 40 then 1 when l - (lo + hi) / 2 < -40 then 0 else 1 / (1 + exp((lo + hi) / 2 - l)) end for l in ls]) > mean then (lo + hi) / 2 else lo end,
   case when list_avg([case when l - (lo + hi) / 2 > 40 then 1 when l - (lo + hi) / 2 < -40 then 0 else 1 / (1 + exp((lo + hi) / 2 - l)) end for l in ls]) > mean then hi else (lo + hi) / 2 end
  from half join d3 using (doc_id) where step < 28),
 d4 as (select d3.*, (lo + hi) / 2 as c from d3 join half using (doc_id) where step = 28),
 d5 as (select doc_id, n, unnest(ids) as chunk_id, unnest(ps) as p, unnest(cs) as conf, unnest([1 / (1 + exp(greatest(-40, least(40, c - l)))) for l in ls]) as q from d4)"""


@query(f"{_SHARP} select doc_id, chunk_id::int as chunk_id, round(p, 6) as raw_probability, round(case when n < 4 then p else greatest(0.02, least(0.98, case when conf < 0.5 then 0.8 * p + 0.2 * q else q end)) end, 5) as sharpened from d5")
def contrast_sharpen(spark: SparkSession, root: str) -> DataFrame:
    rows = aggregate.sharpened(pipeline.segments(clean(spark, root)))
    return rows.select("doc_id", "chunk_id", r("raw_probability"), F.round("sharpened", 5).alias("sharpened"))


@query()
def legacy_sharpen(spark: SparkSession, root: str) -> DataFrame:
    rows = aggregate.sharpened_legacy(pipeline.segments(clean(spark, root)))
    return rows.select("doc_id", "chunk_id", F.round("sharpened", 5).alias("sharpened"), F.array_join("tags", ",").alias("tags"))


@query(f"""{_SEGMENTS}, f as (select doc_id, block_index, p, count(*) over w as n, row_number() over (partition by doc_id order by avg_sentence_len, block_index) - 1 as k, var_pop(p) over w as v from seg window w as (partition by doc_id))
 select doc_id, block_index as chunk_id, round(case when v < 0.02 and n > 1 then 0.10 + 0.80 * k / (n - 1) else p end, 6) as spread from f""")  # fmt: skip
def flat_respread(spark: SparkSession, root: str) -> DataFrame:
    return aggregate.respread(pipeline.segments(clean(spark, root))).select("doc_id", "chunk_id", r("spread"))


# structured nodes

_D = r"\p{Nd}"
_HEAD = f"""(length(t) > 0 and (starts_with(t, '#') or regexp_matches(t, '[:：]$') or regexp_matches(t, '^第[0-9一二三四五六七八九十百千]+[章节部分]') or regexp_matches(t, '^(Chapter|CHAPTER)[{sql.WS}]+{_D}+($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')
 or regexp_matches(t, '^([IVXLCM]+\\.|{_D}+(\\.{_D}+)*[.,、])[{sql.WS}]*[^{sql.WS}]+') or (length(t) <= 30 and not regexp_matches(t, '[。！？.!?]$'))))"""
_META = f"""(length(t) > 0 and length(t) <= 40 and (regexp_matches(t, '：$') or contains(t, '副标题') or contains(t, 'Subheading') or contains(t, 'Subtitle') or contains(t, '编号') or contains(t, 'No.') or contains(t, 'NO.') or contains(t, '序号')
 or regexp_matches(t, '^{_D}{{4}}[-/年]{_D}{{1,2}}') or regexp_matches(t, '^[A-Z]{{2,}}$')))"""
_ITEM = f"(regexp_matches(t, '^[-•*]') or (regexp_matches(t, '^{_D}+[.)][{sql.WS}]+[^{sql.WS}]') and (length(t) > 30 or regexp_matches(t, '[。！？.!?]$'))))"
_LEVEL = f"""case when starts_with(t, '###') then 3 when starts_with(t, '##') then 2 when starts_with(t, '#') then 1 when regexp_matches(t, '^第[一二三四五六七八九十百千]+章') then 1 when regexp_matches(t, '^第[一二三四五六七八九十百千]+节') then 2
 when regexp_matches(t, '^{_D}+\\.{_D}+\\.') then 3 when regexp_matches(t, '^{_D}+\\.[{sql.WS}]*[^{sql.WS}]+') then 1 end"""
_NODES = f"""ln as (select doc_id, i, {sql.trim('x')} as t from (select doc_id, unnest(xs) as x, generate_subscripts(xs, 1) as i from (select doc_id, string_split(text, chr(10)) as xs from docs where text is not null))),
 lo as (select *, sum(length(t) + 1) over (partition by doc_id order by i) - length(t) - 1 as s, {_HEAD} as head, {_META} as meta from ln),
 sc as (select doc_id, i, head as open, false as taken from lo where i = 1
  union all select l.doc_id, l.i, (l.meta and s.open) or l.head, l.meta and s.open from sc s join lo l on l.doc_id = s.doc_id and l.i = s.i + 1),
 nb as (select lo.*, taken, sum(case when taken then 0 else 1 end) over (partition by lo.doc_id order by lo.i) as node from lo join sc using (doc_id, i) where length(t) > 0),
 ns as (select doc_id, node, min_by(t, i) as t, min(s) as start, max(s + length(t)) as end_offset, string_agg(t, chr(10) order by i) as text, count(*) - 1 as meta_count from nb group by 1, 2),
 nodes as (select doc_id, (row_number() over (partition by doc_id order by node) - 1)::int as node_index, case when {_HEAD} then 'heading' when {_ITEM} then 'list_item' else 'paragraph' end as kind, start::int as start, end_offset::int as end_offset, text,
  case when {_HEAD} then {_LEVEL} end as level, meta_count from ns)"""


def _nodes(spark: SparkSession, root: str) -> DataFrame:
    return nodes.structured_nodes(clean(spark, root))


@query(f"with recursive {sql.DOCS}, {_NODES} select * from nodes")
def structured_nodes(spark: SparkSession, root: str) -> DataFrame:
    return _nodes(spark, root).withColumnsRenamed(END)


@query(f"with recursive {sql.DOCS}, {_NODES} select doc_id, count(*) filter (kind = 'heading') as headings, count(*) filter (kind = 'paragraph') as paragraphs, count(*) filter (kind = 'list_item') as list_items from nodes group by 1")
def format_summary(spark: SparkSession, root: str) -> DataFrame:
    return nodes.format_summary(_nodes(spark, root))


@query(f"""with recursive {sql.DOCS}, {_NODES}, g as (select doc_id, max(node_index) + 1 as n from nodes group by 1), nw as (
  select doc_id, 0::bigint as k, 0::bigint as b, null::bigint as body, 0::bigint as s0, null::varchar as kind0 from g
  union all select w.doc_id, w.k + 1, case when n.kind = 'heading' or joined then w.b else w.b + 1 end, case when n.kind = 'heading' then w.body when joined then w.body else w.b + 1 end, case when n.kind = 'heading' or joined then w.s0 else n.start end, n.kind
  from (select w.*, n.kind as k0, w.body is not null and n.end_offset - w.s0 < 200 as joined from nw w join nodes n on n.doc_id = w.doc_id and n.node_index = w.k) w join nodes n on n.doc_id = w.doc_id and n.node_index = w.k)
 , bl as (select n.doc_id, w.b, n.node_index, n.kind, n.start, n.end_offset, n.text from nodes n join nw w on w.doc_id = n.doc_id and w.k = n.node_index + 1 where n.kind <> 'heading')
 select doc_id, (b - 1)::int as block_index, case when min_by(kind, node_index) = 'paragraph' then 'body' else min_by(kind, node_index) end as label, count(*) > 1 as merged, min(start)::int as start, max(end_offset)::int as end_offset, string_agg(text, chr(10) order by node_index) as text from bl group by 1, 2
 union all select doc_id, 0, 'body', false, 0, length(string_agg(text, '' order by node_index))::int, string_agg(text, '' order by node_index) from nodes group by 1 having count(*) filter (kind <> 'heading') = 0""")  # fmt: skip
def node_blocks(spark: SparkSession, root: str) -> DataFrame:
    return chunk.node_blocks(_nodes(spark, root)).drop("need_detect").withColumnsRenamed(END)


def _char_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Paragraphs with offsets in characters, as nodes have them."""
    return split.exploded(clean(spark, root), split.paragraph_array(F.col("text"), chars=True), "chunk_id").select("doc_id", "chunk_id", "start", "end")


_HITS = f"""with recursive {_BLOCKS}, {_NODES}, sg as (select doc_id, block_index as chunk_id, char_start as s, char_start + length(text) as e from blocks),
 hits as (select *, o / greatest(1, nl) as exact, round_even(o / greatest(1, nl), 4) as coverage from (select sg.doc_id, chunk_id, node_index, kind, least(e, end_offset) - greatest(s, start) as o, end_offset - start as nl from sg join nodes n on n.doc_id = sg.doc_id and s < end_offset and start < e) where o > 0 and o / greatest(1, nl) >= 0.2)"""


def _hits(spark: SparkSession, root: str) -> DataFrame:
    return compare.mapped(_char_blocks(spark, root), _nodes(spark, root))


@query(f"{_HITS}, h as (select *, row_number() over (partition by doc_id, chunk_id order by (kind in ('paragraph', 'list_item'))::int desc, coverage desc, o desc, node_index) as k from hits) select doc_id, chunk_id, node_index, kind, o::bigint as overlap, round(coverage, 4) as coverage from h where k = 1")
def node_mapping(spark: SparkSession, root: str) -> DataFrame:
    return compare.primary_nodes(_hits(spark, root))


@query(f"{_HITS} select doc_id, 'segment' as side, chunk_id::bigint as id from sg where not exists (select 1 from hits h where h.doc_id = sg.doc_id and h.chunk_id = sg.chunk_id) union all select doc_id, 'node', node_index::bigint from nodes n where not exists (select 1 from hits h where h.doc_id = n.doc_id and h.node_index = n.node_index)")
def unmapped_nodes(spark: SparkSession, root: str) -> DataFrame:
    segments, found = cut(_char_blocks(spark, root)), cut(_nodes(spark, root).drop("text"))
    return compare.unmapped(segments, found, compare.mapped(segments, found))


@query(f"{_HITS} select doc_id, chunk_id, count(*) as hits, round(max(coverage), 4) as best from hits group by 1, 2 having count(*) >= 2 or max(coverage) < 0.8")
def mismatched_nodes(spark: SparkSession, root: str) -> DataFrame:
    return compare.mismatched(_hits(spark, root))


@query(f"{_HITS} select h.doc_id, not bool_or(h.kind = 'heading' and not exists (select 1 from hits a join hits b on a.doc_id = b.doc_id and a.chunk_id = b.chunk_id where a.doc_id = h.doc_id and a.node_index = h.node_index and b.kind <> 'heading')) as ok from hits h group by 1")
def heading_bodies(spark: SparkSession, root: str) -> DataFrame:
    return compare.headings_have_bodies(_hits(spark, root))


@query(f"{_HITS} select doc_id, chunk_id, array_to_string(list(node_index order by coverage desc, o desc, node_index)[1:3], ',') as nodes from hits group by 1, 2")
def node_badges(spark: SparkSession, root: str) -> DataFrame:
    return compare.badges(_hits(spark, root)).select("doc_id", "chunk_id", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"))


# the content filter in detection

_KEPT = f"{base._RULES}, kept as (select b.*, row_number() over (partition by doc_id order by block_index) - 1 as chunk_id from blocks b join cls using (doc_id, block_index) where coalesce(category, 'body') = 'body')"
_FILTERED = f"with {_BLOCKS}, {_KEPT}, {sql.features('kept', 'doc_id, chunk_id', 'kf')}, {base._LANG}, kin as (select f.*, k.chunk_id as block_index, k.start, k.end_offset, l.cjk from kf f join kept k using (doc_id, chunk_id) join lang l using (doc_id)), {sql.scored('kin')}"


@query(f"{_FILTERED}, {sql.aggregated('seg')} select d.doc_id, round(coalesce(overall_p, 0), 6) as overall_probability, round(coalesce(conf, 0), 6) as overall_confidence, coalesce(segments, 0) as segments, case when overall_p is null then 'pass' else {sql.overall('overall_p', 'unc', 'supported', 'medium')} end as decision from documents d left join agg using (doc_id)")
def filtered_detection(spark: SparkSession, root: str) -> DataFrame:
    """Detection of what the content filter keeps."""
    rows = pipeline.detect(documents(spark, root), filtered=True)
    return rows.select("doc_id", r("overall_probability"), r("overall_confidence"), "segments", "decision")


_SPANS = f"""{sql.sentences('kept', 'doc_id, chunk_id', 'ks')},
 gap as (select doc_id, chunk_id, start as at, case when lag(block_index) over (partition by doc_id order by chunk_id) <> block_index - 1 then 1 else 0 end as broken from kept),
 sized as (select s.doc_id, row_number() over (partition by s.doc_id order by s.chunk_id, s.sent_index) - 1 as k, s.start + g.at as start, s.end_offset + g.at as end_offset, length(r.raw) as n, s.sent_index = 0 and g.broken = 1 as brk, r.raw
   from ks s join gap g using (doc_id, chunk_id) join ks_d r on r.doc_id = s.doc_id and r.chunk_id = s.chunk_id and r.e = s.end_offset and length(r.raw) > 0),
 walk as (select doc_id, k, case when n > 300 then 1 else 0 end as b, case when n > 300 then 0 else n end as c, n <= 300 as o, 0 as blk from sized where k = 0
  union all
  select s.doc_id, s.k, case when s.n > 300 then w.b + w.o::int + 1 when w.o and not s.brk and (w.c + s.n <= 200 or w.c = 0) then w.b else w.b + w.o::int end,
   case when s.n > 300 then 0 when w.o and not s.brk and (w.c + s.n <= 200 or w.c = 0) then w.c + s.n else s.n end, s.n <= 300,
   case when s.n > 300 then w.b + w.o::int when w.o and not s.brk and (w.c + s.n <= 200 or w.c = 0) then w.b else w.b + w.o::int end
  from walk w join sized s on s.doc_id = w.doc_id and s.k = w.k + 1)"""


@query(f"with recursive {_BLOCKS}, {_KEPT}, {_SPANS} select doc_id, (dense_rank() over (partition by doc_id order by blk) - 1)::int as block_index, min(start)::int as start, max(end_offset)::int as end_offset, count(*)::int as sentence_count from sized join walk using (doc_id, k) group by doc_id, blk")
def filtered_sentences(spark: SparkSession, root: str) -> DataFrame:
    """Sentence blocks within the paragraphs that the content filter keeps."""
    kept = clean(spark, root).select("doc_id", "text", pipeline.kept_paragraphs(F.col("text")).alias("paragraphs"))
    return split.sentence_blocks_in(kept).drop("text").withColumnsRenamed(END)


@query(f"with {_BLOCKS}, {base._RULES} select doc_id, block_index, category from cls where category <> 'body'")
def non_body_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    rows = classify.non_body(classify.classified(split.paragraph_blocks(clean(spark, root))))
    return rows.select("doc_id", "block_index", "category")


@query(f"""with {_BLOCKS}, {base._RULES}, a as (select doc_id, block_index, {_KEY('block_index')} as k, category from cls), s as (select *, case when category is not null then 'rule' when k % 4 = 0 or k % 4 = 3 then 'fallback' else 'llm' end as way,
 case when category is not null then category when k % 4 = 1 then (['body', 'title', 'toc', 'reference', 'auxiliary', 'odd'])[(k % 6) + 1] else 'body' end as c from a)
 select doc_id, block_index, case when c = 'odd' then 'body' else c end as category, way as "by" from s""")  # fmt: skip
def settled_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    """Classes by rule, else by an outside classifier's responses, some of them broken, some silent, else body."""
    classes = classify.classified(split.paragraph_blocks(clean(spark, root)))
    k = _k("block_index")
    named = F.get(F.array(*map(F.lit, ["body", "title", "toc", "reference", "auxiliary", "odd"])), (k % 6).cast("int"))
    item = lambda c: F.concat(F.lit('ok {"paragraphs":[{"index":'), F.col("block_index").cast("string"), F.lit(',"category":"'), c, F.lit('","confidence":0.8}]}'))
    answers = classes.select("doc_id", F.when(k % 4 == 1, item(named)).when(k % 4 == 2, item(F.lit("body"))).when(k % 4 == 3, "{broken").alias("response")).where("response is not null")
    return classify.settled(classes, judge.classes_of(answers)).select("doc_id", "block_index", "category", "by")


# profiles

_TOLD = ["理学", "计算机论文", "Applied physics", "商科", "文科", "", "law and society", "unknown thing", "工科", "学术报告", "艺术学", "医科"]
_DISCIPLINES = ["物理学", "软件工程", None, "会计学", "社会学", "History", "", "设计学", "农业经济", "Clinical medicine"]


def _profiles(spark: SparkSession, root: str) -> DataFrame:
    pick = lambda items, n: F.get(F.array(*[F.lit(x).cast("string") for x in items]), (F.col("doc_id") % n).cast("int"))
    told, discipline = pick(_TOLD, len(_TOLD)), pick(_DISCIPLINES, len(_DISCIPLINES))
    return clean(spark, root).select("doc_id", told.alias("told"), discipline.alias("discipline"), pick([None, "paper", "  "], 3).alias("paper_type"))


_PICK = lambda items: "([" + ", ".join("null" if x is None else f"'{x}'" for x in items) + f"])[doc_id % {len(items)} + 1]"
_FIELD = lambda c: "case " + " ".join(
    f"when {' or '.join([f'contains({c}, {w!r})' for w in own] + [f'contains(lower({c}), {w!r})' for w in lower])} then '{name}'" for name, own, lower in profile.WORDS
) + " end"
_NAMED = "case " + " ".join(f"when contains(told, '{c}') then '{c}'" for c in profile.CATEGORIES) + " when contains(told, '理科') then '理学' when contains(told, '工科') then '工学' when contains(told, '医科') then '医学' when contains(told, '农科') then '农学' " + f"""
 when contains(told, '商科') or contains(told, '经管') then case when {_FIELD('discipline')} in ('经济学', '管理学') then {_FIELD('discipline')} else '管理学' end when contains(told, '文科') then '文学' else coalesce({_FIELD('told')}, {_FIELD('discipline')}, '交叉学科') end"""
_PROFILED = f"""pr as (select doc_id, {_PICK(_TOLD)} as told, {_PICK(_DISCIPLINES)} as discipline, {_PICK([None, 'paper', '  '])} as paper_type from documents),
 pn as (select *, {_NAMED} as category, regexp_matches(lower(told), '{'|'.join(profile.PAPER_TYPES)}') as names_type from pr)"""


@query(f"with {_PROFILED} select doc_id, category, names_type from pn")
def domain_normalised(spark: SparkSession, root: str) -> DataFrame:
    rows = _profiles(spark, root)
    return rows.select("doc_id", profile.field_of(F.col("told"), F.col("discipline")).alias("category"), profile.names_paper_type(F.col("told")).alias("names_type"))


_CATALOGUE = [("理学", "物理学"), ("理学", "数学"), ("工学", "软件工程"), ("管理学", "会计学"), ("法学", "社会学"), ("艺术学", "设计学"), ("交叉学科", "设计学"), ("交叉学科", None), ("文学", None), ("农学", "农业经济")]
_CAT_SQL = "cat(c, d) as (values " + ", ".join(f"('{c}', {'null' if d is None else repr(d)})" for c, d in _CATALOGUE) + ")"
_VALID = f"""{_PROFILED}, {_CAT_SQL}, v1 as (select *, case when category in (select c from cat) then category else '交叉学科' end as c1, trim(coalesce(discipline, '')) as d1 from pn),
 v2 as (select *, exists (select 1 from cat where c = c1 and d = d1) as own, (select min(c) from cat where d = d1) as home from v1),
 v3 as (select doc_id, case when not own and c1 = '交叉学科' and home is not null then home else c1 end as category, own or (c1 = '交叉学科' and home is not null) as ok, discipline, paper_type from v2),
 v4 as (select *, case when ok then 'valid' else 'partial' end as validity, case when coalesce(regexp_matches(paper_type, 'paper'), false) or length(trim(coalesce(discipline, ''))) > 0 then case when ok then 1.0 else 0.6 end else 0.0 end as academic from v3)"""


@query(f"with {_VALID} select doc_id, category, validity, academic from v4")
def profile_validity(spark: SparkSession, root: str) -> DataFrame:
    return _validated(spark, root).select("doc_id", "category", "validity", "academic")


def _validated(spark: SparkSession, root: str) -> DataFrame:
    catalogue = spark.createDataFrame(_CATALOGUE, "category string, discipline string")
    rows = _profiles(spark, root).withColumn("category", profile.field_of(F.col("told"), F.col("discipline")))
    known = profile.validated(rows, catalogue)
    strength = profile.academic_strength(F.col("category"), F.col("discipline"), F.lit(None).cast("string"), F.col("paper_type"), F.col("validity"))
    return known.withColumn("academic", strength)


# scores of short and academic texts, archived features

@query(f"{base._FEATURES}, {base._LANG}, {sql.academic_scored('feat', 'doc_id', 'block_index')} select doc_id, block_index as chunk_id, round(case doc_id % 3 when 0 then p0 when 1 then p6 else p1 end, 6) as raw_probability, round(anchors, 6) as anchors from ac")
def academic_score(spark: SparkSession, root: str) -> DataFrame:
    """Scores with academic strengths of 0, 0.6 and 1."""
    academic = F.when(F.col("doc_id") % 3 == 0, 0.0).when(F.col("doc_id") % 3 == 1, 0.6).otherwise(1.0)
    rows = pipeline.segments(clean(spark, root).withColumn("academic", academic))
    return rows.select("doc_id", "chunk_id", r("raw_probability"), F.round(score.academic_anchors(F.col("text")), 6).alias("anchors"))


@query(f"{base._FEATURES}, {base._LANG}, sh as (select doc_id, block_index, {sql.short_logit()} as z from feat join lang using (doc_id)) select doc_id, block_index as chunk_id, round(greatest(0.02, least(0.98, 1 / (1 + exp(-z)))), 6) as raw_probability from sh")
def short_score(spark: SparkSession, root: str) -> DataFrame:
    docs = clean(spark, root)
    blocks = split.exploded(docs, split.paragraph_array(F.col("text"))).withColumnRenamed("block_index", "chunk_id")
    rows = score.scored_short(features.stylometry(blocks).join(docs.select("doc_id", "language"), "doc_id"))
    return rows.select("doc_id", "chunk_id", r("raw_probability"))


_OLD_WORDS = ", ".join(f"'{w}'" for w in features.LEGACY_FUNCTION_WORDS)


@query(f"""with {_BLOCKS}, o1 as (select doc_id, block_index, text, regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{24B6}}-\\x{{24E9}}\\x{{200c}}\\x{{200d}}]+') as ts, list_filter(list_transform(string_split(regexp_replace(text, '([。！？?!])[{sql.WS}]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {sql.trim('x')}), lambda x: length(x) > 0) as ss from blocks),
 o2 as (select *, len(ts) as n from o1), o3 as (select doc_id, block_index, count(*) as v, count(*) filter (c >= 3) as rep from (select doc_id, block_index, t, count(*) as c from (select doc_id, block_index, unnest(ts) as t from o2) group by all) group by 1, 2)
 select doc_id, block_index, case when n > 0 then round_even(v / n, 4) else 0 end as ttr, case when n > 0 then round_even(len(list_filter(ts, lambda x: x in ({_OLD_WORDS}))) / n, 4) else 0 end as function_word_ratio, case when n > 0 then round_even(rep / v, 4) else 0 end as repeat_ratio
 from o2 left join o3 using (doc_id, block_index)""")  # fmt: skip
def legacy_stylometry(spark: SparkSession, root: str) -> DataFrame:
    rows = features.stylometry_legacy(split.paragraph_blocks(clean(spark, root)))
    return rows.select("doc_id", "block_index", "ttr", "function_word_ratio", "repeat_ratio")


# texts and formats

@query(f"""with {sql.DOCS}, n as (select doc_id, replace(case when length(text) > 24 then left(text, 24) || '...' else text end, chr(10), ' ') as head, case when length(text) > 24 then '...' || right(text, 24) else text end as tail from docs) select * from n""")
def previews(spark: SparkSession, root: str) -> DataFrame:
    return clean(spark, root).select("doc_id", T.preview(F.col("text"), 24).alias("head"), T.tail(F.col("text"), 24).alias("tail"))


@query(f"""with {sql.DOCS}, c as (select doc_id, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i from docs where text is not null), p as (select *, sum(strlen(c)) over (partition by doc_id order by i) as e from c)
 select d.doc_id, coalesce(string_agg(c, '' order by i) filter (e - strlen(c) >= 7 and e <= 61), '') as slice, coalesce(string_agg(c, '' order by i) filter (e - strlen(c) >= s and e <= s + 20 and e <= 61), '') as preview
 from docs d left join p using (doc_id) left join (select doc_id, min(e - strlen(c)) as s from p where e - strlen(c) >= 7 group by 1) using (doc_id) where text is not null group by 1""")  # fmt: skip
def byte_slices(spark: SparkSession, root: str) -> DataFrame:
    text = F.col("text")
    at = (F.lit(7), F.lit(61))
    return clean(spark, root).where("text is not null").select("doc_id", T.byte_slice(text, *at).alias("slice"), T.byte_slice(text, *at, 20).alias("preview"))


@query(f"with {_BLOCKS} select doc_id, block_index, printf('[%d] label=body len=%d text=%s', block_index, length(text), case when length(f) > 240 then left(f, 240) || '...' else f end) as summary from (select *, {sql.trim(f'''regexp_replace(text, '[{sql.WS}]+', ' ', 'g')''')} as f from blocks)")
def block_summaries(spark: SparkSession, root: str) -> DataFrame:
    rows = split.paragraph_blocks(clean(spark, root))
    return rows.select("doc_id", "block_index", T.block_summary(F.col("block_index"), F.col("label"), F.col("text")).alias("summary"))


@query(f"{_SEGMENTS} select doc_id, block_index as chunk_id, case when p < 0.62 then 'pass' else 'review' end as decision, false as supports_flag from seg")
def segment_decisions(spark: SparkSession, root: str) -> DataFrame:
    """Decisions on segments without any evidence: none can be a flag at medium sensitivity."""
    return pipeline.segments(clean(spark, root)).select("doc_id", "chunk_id", "decision", "supports_flag")


@query(f"with {_BLOCKS} select doc_id, block_index as chunk_id, text as original from blocks")
def segment_originals(spark: SparkSession, root: str) -> DataFrame:
    docs = clean(spark, root)
    return compare.originals(split.paragraph_blocks(docs).withColumnRenamed("block_index", "chunk_id"), docs)


@query(f"{base._DUAL} select doc_id, block_index as chunk_id, exists (select 1 from pairs p where p.doc_id = seg.doc_id and p.pid = seg.block_index and p.diff > 0.2) as divergent from seg")
def divergent_highlight(spark: SparkSession, root: str) -> DataFrame:
    numbers = pipeline.both_views(clean(spark, root))
    p, s = (numbers.where(F.col("mode") == m) for m in ("paragraph", "sentence"))
    far = compare.matched(p, s).where(F.col("diff") > 0.2)
    return compare.highlighted(p.select("doc_id", "chunk_id"), far)


@query("""with r as (select request_id, min(text) as t from detect_requests where text is not null group by 1), k as (select request_id, t, length(t) % 5 as k from r)
 select request_id, case k when 0 then 'ok' when 1 then 'ok' when 2 then '{"a":1}' when 3 then 'in a string' end as answer, '{"a":"}"}' as first_object from k""")  # fmt: skip
def response_answers(spark: SparkSession, root: str) -> DataFrame:
    """Answers out of providers' responses of several shapes, and the first balanced object of a text."""
    rows = table(spark, root, "detect_requests").where("text is not null").groupBy("request_id").agg((F.min("text")).alias("t"))
    shapes = [
        '{"output":[{"content":[{"text":" "},{"text":"ok"}]}]}', '{"output":[],"choices":[{"message":{"content":"ok"}}]}', '{"choices":[{"message":{"content":null,"reasoning_content":"so {\\"a\\":1} it is"}}]}',
        '"{\\"choices\\":[{\\"message\\":{\\"content\\":\\"in a string\\"}}]}\\nevent: error"', "{}",
    ]
    shape = F.get(F.array(*map(F.lit, shapes)), (F.length("t") % 5).cast("int"))
    return rows.select("request_id", judge.answer_text(shape).alias("answer"), judge.first_json(F.lit(' {"a":"}"} {"b":2}')).alias("first_object"))


@query(f"with {sql.DOCS}, {sql.sentences('docs', 'doc_id')}, m as (select *, sum(case when sent_index > 0 and (sent_index - 1) % 3 = 0 and (sent_index - 1) < 40 then 0 else 1 end) over (partition by doc_id order by sent_index) as g from sent) select doc_id, (g - 1)::int as span_index, min(start)::int as start, max(end_offset)::int as end_offset from m group by doc_id, g")
def merged_sentences(spark: SparkSession, root: str) -> DataFrame:
    """Sentences joined as a refiner's response says: it names places it wasn't asked about, which don't count."""
    asked = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda x: x)
    wanted = judge.merge_answer(F.lit('Sure: {"mergeIndices": [' + ", ".join(str(i) for i in range(0, 60, 3)) + "]}"), asked)
    spans = F.transform(split.sentence_array(F.col("text")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return split.exploded(clean(spark, root), split.merge_spans(spans, wanted), "span_index").withColumnsRenamed(END)


@query(f"{_SEGMENTS} select block_index as chunkId, round(p, 6) as probability, round(confidence, 6) as confidence, round(ttr, 6) as ttr, round(avg_sentence_len, 6) as avgSentenceLen, ppl from seg")
def legacy_rows(spark: SparkSession, root: str) -> DataFrame:
    """What the archived implementation writes as a table of segments."""
    rows = files.legacy_rows(pipeline.segments(clean(spark, root)))
    return rows.select("chunkId", r("probability"), r("confidence"), r("ttr"), r("avgSentenceLen"), "ppl")


@query("""with b as (select distinct block_id, ttr from stylometry_metrics where ttr is not null and not isnan(ttr)) select block_id, ttr between 0.4 and 0.6 as conflict from b""")
def consistency_conflicts(spark: SparkSession, root: str) -> DataFrame:
    """Explanations of a block's diversity that contradict each other; made up from the old metrics."""
    rows = table(spark, root, "stylometry_metrics").where("ttr is not null and not isnan(ttr)").select("block_id", "ttr").distinct()
    told = F.array(F.format_string("ttr=%.2f", F.col("ttr")), F.when(F.col("ttr") >= 0.4, "多样性高"), F.when(F.col("ttr") <= 0.6, "多样性低"))
    return rows.select("block_id", classify.conflicting(F.filter(told, lambda x: x.isNotNull())).alias("conflict"))


@query("select event_type as provider, count(*) as total, count(*) filter (value >= 20) as success, count(*) filter (value < 20) as failed, round(min(value), 6) as min_ms, round(avg(value), 6) as avg_ms, round(max(value), 6) as max_ms from events where value is not null group by 1")
def latency_summary(spark: SparkSession, root: str) -> DataFrame:
    """Calls by provider; the events stand in for calls."""
    calls = table(spark, root, "events").where("value is not null").select(F.col("event_type").alias("provider"), F.col("value").alias("ms"), (F.col("value") >= 20).alias("ok"))
    return aggregate.latency_summary(calls).select("provider", "total", "success", "failed", r("min_ms"), r("avg_ms"), r("max_ms"))


_PROVIDED = "(select request_id, min(received_at) as received_at from detect_requests where request_id is not null group by 1)"


@query(f"with q as (select distinct request_id, unnest(list_distinct(providers)) as p from detect_requests join {_PROVIDED} using (request_id, received_at)) select string_split(p, ':')[1] as provider, count(*) as requested, count(*) filter (length(request_id) > 0 and substr(request_id, -1) <> '0') as success from q where p is not null group by 1")
def provider_summary(spark: SparkSession, root: str) -> DataFrame:
    """How often each provider was asked, and how often its answer could be read (made up from the ids)."""
    asked = table(spark, root, "detect_requests").where("request_id is not null")
    first = asked.groupBy("request_id").agg(F.min("received_at").alias("received_at"))
    rows = asked.join(first, ["request_id", "received_at"]).select("request_id", F.explode(F.array_distinct("providers")).alias("p")).where("p is not null").distinct()
    ok = ~F.col("request_id").endswith("0")
    return aggregate.provider_summary(rows.select(F.array(T.provider_of(F.col("p"))["provider"]).alias("names"), ok.alias("ok")), F.col("names"))


@query("with d as (select request_id, min(decision) as decision, min(overall_probability) as p, min(overall_confidence) as c from review_log where request_id is not null group by 1) select request_id as id, round(p, 6) as probability, round(c, 6) as confidence from d")
def batch_rows(spark: SparkSession, root: str) -> DataFrame:
    """What the archived implementation writes as a table of a batch."""
    rows = table(spark, root, "review_log").where("request_id is not null").groupBy(F.col("request_id").alias("doc_id")).agg(F.min("overall_probability").alias("overall_probability"), F.min("overall_confidence").alias("overall_confidence"))
    return files.batch_rows(rows).select("id", r("probability"), r("confidence"))


@query(f"{_SEGMENTS} select doc_id, block_index as chunk_id, round(p, 6) as raw_probability from seg where block_index < 3")
def first_segments(spark: SparkSession, root: str) -> DataFrame:
    """The first three segments of each document, in order: the limit is the feature."""
    return compare.in_order(pipeline.segments(clean(spark, root)), 3).select("doc_id", "chunk_id", r("raw_probability"))


@query(f"with b as (select distinct block_id, request_id, block_index, coalesce(need_detect, false) as n from text_blocks), a as (select *, bool_or(n) over (partition by request_id) as any_n from b where request_id is not null) select block_id from a where n or not any_n")
def detectable_blocks(spark: SparkSession, root: str) -> DataFrame:
    """The requests' blocks that are to be scored."""
    rows = table(spark, root, "text_blocks").where("request_id is not null").select("block_id", F.col("request_id").alias("doc_id"), "block_index", F.coalesce("need_detect", F.lit(False)).alias("need_detect")).distinct()
    return split.detectable(rows).select("block_id")


__all__ = ["QUERIES", "SQL", "entry"]
