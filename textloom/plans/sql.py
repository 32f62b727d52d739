"""The queries' equivalents in plain SQL (DuckDB's dialect), for checking results; written apart from the operators."""

from __future__ import annotations

from textloom.config import MARGIN, SENSITIVITY

WS = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_LINE = WS.replace(r"\n", "")
TOKENS = r"regexp_extract_all({0}, '[A-Za-z0-9_]+|[\x{{4e00}}-\x{{9fff}}]')"
ALPHA = r"\p{L}\p{Nl}\p{Other_Alphabetic}"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def normal(x: str) -> str:
    x = f"translate({x}, '“”‘’—' || chr(12288) || chr(160), '\"\"''''-  ')"
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[ \\t\\f\\x0b]+', ' ', 'g')"
    x = f"regexp_replace({x}, '[{WS_LINE}]+\\n', chr(10), 'g')"
    x = f"regexp_replace({x}, '\\n[{WS_LINE}]+', chr(10), 'g')"
    return trim(x)


DOCS = f"docs as (select doc_id, {normal('text')} as text from documents)"
PARAGRAPHS = f"""
raw_p as (select doc_id, string_split(regexp_replace(text, '(\\n[{WS}]*\\n)', '\\1' || chr(1), 'g'), chr(1)) as ps from docs where text is not null),
pos_p as (select doc_id, unnest(ps) as p, generate_subscripts(ps, 1) as i from raw_p),
off_p as (select doc_id, i, p, sum(strlen(p)) over (partition by doc_id order by i) - strlen(p) as s, sum(length(p)) over (partition by doc_id order by i) - length(p) as c from pos_p),
tri_p as (select doc_id, i, s + strlen(p) - strlen(regexp_replace(p, '^[{WS}]+', '')) as start, c + length(p) - length(regexp_replace(p, '^[{WS}]+', '')) as char_start, {trim('p')} as text from off_p),
some_p as (select doc_id, row_number() over (partition by doc_id order by i) - 1 as block_index, start, start + strlen(text) as end_offset, text, char_start from tri_p where length(text) > 0),
blocks as (
  select doc_id, block_index, start, end_offset, text, char_start from some_p
  union all select doc_id, 0, 0, strlen(text), text, 0 from docs where text is not null and doc_id not in (select doc_id from some_p)
)"""
_Q = "\"“”''‘’"


def sentences(source: str, keys: str, name: str = "sent") -> str:
    """CTEs that end in ``name``: keys, sent_index, start, end_offset, text of the sentences of ``source``."""
    mark = "replace(regexp_replace(regexp_replace(regexp_replace(x, '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([。！？.!?][ \\t]*)', '\\1' || chr(2), 'g'), chr(1), '.')"
    return f"""
{name}_a as (select {keys}, list_transform(regexp_extract_all(text, '[^{_Q}]*[{_Q}]|[^{_Q}]+'), lambda x, i: case when i % 2 = 1 then {mark} else x end) as ps from {source} where text is not null),
{name}_b as (select {keys}, string_split(array_to_string(ps, ''), chr(2)) as ss from {name}_a),
{name}_c as (select {keys}, unnest(ss) as raw, generate_subscripts(ss, 1) as i from {name}_b),
{name}_d as (select {keys}, i, raw, sum(strlen(raw)) over (partition by {keys} order by i) as e from {name}_c),
{name} as (select {keys}, row_number() over (partition by {keys} order by i) - 1 as sent_index, e - strlen(raw) as start, e as end_offset, {trim('raw')} as text from {name}_d where length({trim('raw')}) > 0)"""


def features(source: str, keys: str, name: str = "feat") -> str:
    """CTEs that end in ``name``: keys and the features of ``source``'s texts."""
    words = "'的','之','一','是','了','在','有','和','与','这','对','也','为','而','并且'"
    tok = TOKENS.format("text")
    return f"""
{name}_t as (select {keys}, text, {tok} as toks from {source}),
{name}_u as (select {keys}, unnest(toks) as t from {name}_t),
{name}_c as (select {keys}, t, count(*) as c from {name}_u group by all),
{name}_n as (select {keys}, sum(c) as n from {name}_c group by all),
{name}_g as (select {keys}, sum(c)::bigint as n, count(*) as v, count(*) filter (c >= 3) as r, coalesce(sum(c) filter (t in ({words})), 0) as fw,
  -sum(c / n * ln(c / n + 1e-12)) as h from {name}_c join {name}_n using ({keys}) group by all),
{sentences(source, keys, name + '_s')},
{name}_l as (select {keys}, avg(length(text)) as m from {name}_s group by all),
{name} as (
  select t.{keys.replace(', ', ', t.')}, t.text, length(t.text) as chars, coalesce(g.n, 0) as n, g.v, g.h,
    coalesce(g.v / g.n, 0) as ttr, case when g.n is null then 0 else coalesce(l.m, length(t.text)) end as avg_sentence_len, coalesce(g.fw / g.n, 0) as function_word_ratio,
    case when g.n is null then 0 else len(regexp_extract_all(t.text, '[，。！？.!?]')) / length(t.text) end as punctuation_ratio, coalesce(g.r / g.v, 0) as repeat_ratio,
    case when coalesce(g.n, 0) < 4 then 0 else 1 - len(list_distinct(list_transform(range(1, g.n - 1), lambda i: toks[i] || chr(1) || toks[i + 1] || chr(1) || toks[i + 2]))) / (g.n - 2) end as ngram_repeat_rate,
    case when g.n is null then 120 else floor(greatest(20, least(300, 0.5::double * (20 + least((exp(g.h) - 1) * 22.5::double, 280)) + 0.5::double * (120 - g.v / g.n * 60 + length(t.text) / 500))) * 100 + 0.5::double) / 100 end as ppl
  from {name}_t t left join {name}_g g using ({keys}) left join {name}_l l using ({keys})
)"""


LANGUAGE = f"case when length(regexp_replace(text, '[{WS}]+', '', 'g')) > 0 and len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]')) / length(regexp_replace(text, '[{WS}]+', '', 'g')) > 0.3 then 'zh' else 'en' end"


def scored(source: str, name: str = "seg") -> str:
    """A CTE ``name``: ``source``'s columns with p, confidence, uncertainty; needs ``cjk`` among them."""
    low = lambda x, c, k: f"(1 / (1 + exp(({x} - {c}) / {k})))"
    high = lambda x, c, k: f"(1 - {low(x, c, k)})"
    two = lambda a, b: f"(case when cjk then {a} else {b} end)"
    z = f"""
 1.2 * {low('ttr', two(.46, .58), .08)} * {two(.85, 1.0)} - 0.9 * {high('ttr', two(.70, .78), .06)}
 + {high('repeat_ratio', two(.26, .18), two(.07, .06))} * {two(.75, 1.0)} + 1.1 * {high('ngram_repeat_rate', two(.14, .10), two(.05, .04))} * {two(.75, 1.0)}
 + 0.3 * {low('avg_sentence_len', two(22.0, 35.0), two(8.0, 10.0))} * {two(.85, 1.0)} + 0.4 * {high('avg_sentence_len', two(90.0, 120.0), two(22.0, 25.0))} * {two(.85, 1.0)}
 + {low('ppl', two(75.0, 85.0), two(18.0, 20.0))} * {two(.85, 1.0)} - 0.6 * {high('ppl', two(180.0, 200.0), two(28.0, 30.0))}"""
    machine = f"{low('ttr', .55, .05)} * {low('ppl', 90, 15)} * ({high('repeat_ratio', .15, .04)} + {high('ngram_repeat_rate', .10, .03)}) / 2"
    human = f"{high('ttr', .70, .05)} * {high('ppl', 170, 25)} * {low('repeat_ratio', .15, .04)} * {high('avg_sentence_len', 25, 8)}"
    return f"""
{name}_z as (select *, {z} as z, {machine} as machine, {human} as human from {source}),
{name} as (select *, greatest(0.02, least(0.98, 1 / (1 + exp(-(z + case when machine > 0.3 then machine * 1.5 * {two(.9, 1.0)} else 0 end - case when human > 0.3 then human * 1.2 else 0 end))))) as p,
  least(0.55 + least(chars / 1800, 0.35), 0.95) as confidence, greatest(0.05, least(0.9, 1 - least(0.55 + least(chars / 1800, 0.35), 0.95))) as uncertainty from {name}_z)"""


def base(p: str, low: float, high: float) -> str:
    return f"case when {p} < {low - MARGIN!r} then 'pass' when {p} < {high - MARGIN!r} then 'review' else 'flag' end"


def overall(p: str, u: str, supported: str, sensitivity: str) -> str:
    g = SENSITIVITY[sensitivity]
    return f"case when {base(p, g['review'], g['flag'])} = 'pass' and {u} >= {g['review_uncertainty']} then 'review' when {base(p, g['review'], g['flag'])} = 'flag' and ({u} > {g['flag_uncertainty']} or not {supported}) then 'review' else {base(p, g['review'], g['flag'])} end"


def aggregated(source: str, name: str = "agg", sensitivity: str = "medium") -> str:
    """CTEs that end in ``name``: one row a document with segments."""
    g = SENSITIVITY[sensitivity]
    supports = "false" if g["content_min"] > 0 else f"(p >= {g['flag'] - MARGIN!r} and uncertainty <= {g['flag_uncertainty']})"
    return f"""
{name}_r as (select *, sqrt(greatest(end_offset - start, 50)) * greatest(confidence, 0.3) as w, count(*) over (partition by doc_id) as m, row_number() over (partition by doc_id order by p, block_index) as k, {supports} as supports from {source}),
{name}_s as (select doc_id, count(*) as segments, sum(p * w) / greatest(sum(w), 1) as weighted, sum(confidence * w) / greatest(sum(w), 1) as conf, sum(uncertainty * w) / greatest(sum(w), 1) as unc, avg(uncertainty) as mean_unc, avg(p) as mean_p,
  avg(case when m >= 5 and k > ceil(m * 0.1) and k <= m - ceil(m * 0.1) then p end) as inner_mean, bool_or(supports) as supported from {name}_r group by doc_id),
{name} as (select *, coalesce(inner_mean, weighted) as trimmed, greatest(0, least(1, 0.7 * weighted + 0.3 * coalesce(inner_mean, weighted))) as overall_p from {name}_s)"""


def letters(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[{ALPHA}\\x{{4e01}}-\\x{{10ffff}}]'))".replace(r"\p{Other_Alphabetic}", r"\p{Mn}\p{Mc}")


PACK = """
sized as (select doc_id, sent_index as k, start, end_offset, text, length(text) as n from sent),
walk as (
  select doc_id, k, case when n > 300 then 1 else 0 end as b, case when n > 300 then 0 else n end as c, n <= 300 as o, 0 as blk from sized where k = 0
  union all
  select s.doc_id, s.k,
    case when s.n > 300 then w.b + w.o::int + 1 when w.c + s.n <= 200 or w.c = 0 then w.b else w.b + 1 end,
    case when s.n > 300 then 0 when w.c + s.n <= 200 or w.c = 0 then w.c + s.n else s.n end, s.n <= 300,
    case when s.n > 300 then w.b + w.o::int when w.c + s.n <= 200 or w.c = 0 then w.b else w.b + 1 end
  from walk w join sized s on s.doc_id = w.doc_id and s.k = w.k + 1
),
packed as (select s.doc_id, w.blk as block_index, min(s.start) as start, max(s.end_offset) as end_offset, string_agg(s.text, ' ' order by s.k) as text, count(*) as sentence_count from sized s join walk w using (doc_id, k) group by 1, 2)"""


def _low(x: str, c: float, k: float) -> str:
    return f"(1 / (1 + exp(({x} - {c}) / {k})))"


def _two(a: object, b: object) -> str:
    return f"(case when cjk then {a} else {b} end)"


def short_logit() -> str:
    """Log odds of the short-text score outside academic writing."""
    low = _low
    high = lambda x, c, k: f"(1 - {low(x, c, k)})"
    return f"""1.0 * {low('ttr', _two(.46, .58), .08)} * {_two(.85, 1.0)} - 0.7 * {high('ttr', _two(.70, .78), .06)} + 0.8 * {high('repeat_ratio', _two(.26, .18), _two(.07, .06))} * {_two(.75, 1.0)}
 + 0.9 * {high('ngram_repeat_rate', _two(.14, .10), _two(.05, .04))} * {_two(.75, 1.0)} + 0.25 * {low('avg_sentence_len', _two(22.0, 35.0), _two(8.0, 10.0))} * {_two(.85, 1.0)} + 0.3 * {high('avg_sentence_len', _two(90.0, 120.0), _two(22.0, 25.0))} * {_two(.85, 1.0)}"""


_CITED = r"(\[[0-9]{1,3}\])|(\([A-Za-z][A-Za-z" + WS + r".-]+,[" + WS + r"]*[0-9]{4}[a-z]?\))"
_SECTIONS = "(?m)^(摘要|引言|绪论|方法|结果|讨论|结论|致谢|参考文献|Abstract|Introduction|Methods?|Results?|Discussion|Conclusion|Acknowledg(e)?ments?|References?)"
_FIGURES = r"(?i)(图[" + WS + r"]?[0-9]+|表[" + WS + r"]?[0-9]+|figure[" + WS + r"]?[0-9]+|table[" + WS + r"]?[0-9]+|equation[" + WS + r"]?\(?[0-9]+\)?)"


def academic_scored(source: str, *keys: str) -> str:
    """A CTE ``ac``: ``p0, p6, p1``, the score at academic strengths 0, 0.6 and 1, and ``anchors``; needs ``lang``."""
    low = _low
    high = lambda x, c, k: f"(1 - {low(x, c, k)})"
    machine = f"{low('ttr', .55, .05)} * {low('ppl', 90, 15)} * ({high('repeat_ratio', .15, .04)} + {high('ngram_repeat_rate', .10, .03)}) / 2"
    human = f"{high('ttr', .70, .05)} * {high('ppl', 170, 25)} * {low('repeat_ratio', .15, .04)} * {high('avg_sentence_len', 25, 8)}"

    def p(a: float) -> str:
        z = f"""1.2 * {low('ttr', _two(.46, .58), .08)} * {_two(.85, 1.0)} * (1 - 0.3 * {a}) - 0.9 * {high('ttr', _two(.70, .78), .06)}
 + {high('repeat_ratio', _two(.26, .18), _two(.07, .06))} * {_two(.75, 1.0)} * (1 - 0.4 * {a}) + 1.1 * {high('ngram_repeat_rate', _two(.14, .10), _two(.05, .04))} * {_two(.75, 1.0)} * (1 - 0.4 * {a})
 + 0.3 * {low('avg_sentence_len', _two(22.0, 35.0), _two(8.0, 10.0))} * {_two(.85, 1.0)} + 0.4 * {high('avg_sentence_len', _two(90.0, 120.0), _two(22.0, 25.0))} * {_two(.85, 1.0)}
 + {low('ppl', _two(75.0, 85.0), _two(18.0, 20.0))} * {_two(.85, 1.0)} * (1 - 0.4 * {a}) - 0.6 * {high('ppl', _two(180.0, 200.0), _two(28.0, 30.0))}
 + case when machine > 0.3 then machine * 1.5 * {_two(.9, 1.0)} * (1 - 0.35 * {a}) else 0 end - case when human > 0.3 then human * 1.2 else 0 end - 0.45 * {a} * anchors"""
        return f"greatest(0.02, least(0.98, 1 / (1 + exp(-({z})))))"

    anchors = f"""least(1.0, case when regexp_matches(text, '{_CITED}') or contains(text, 'et al.') or contains(text, 'DOI') or contains(text, 'doi') then 0.4 else 0 end + case when regexp_matches(text, '{_SECTIONS}') then 0.3 else 0 end + case when regexp_matches(text, '{_FIGURES}') then 0.3 else 0 end)"""
    return f"ac0 as (select *, {machine} as machine, {human} as human, {anchors}::double as anchors from {source} join lang using (doc_id)), ac as (select {', '.join(keys)}, anchors, {p(0.0)} as p0, {p(0.6)} as p6, {p(1.0)} as p1 from ac0)"
