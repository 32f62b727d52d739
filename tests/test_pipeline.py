"""Rules, scores, aggregation, joins and fusion on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from textloom.config import EngineConfig
from textloom.operators import aggregate, chunk, classify, compare, judge, nodes, profile, review, score, split
from textloom.plans import pipeline
from textloom.sources import files, logs
from textloom.sources.settings import Settings, clean_key, endpoint
from textloom.streaming import score as streaming

SEGMENT = "doc_id bigint, chunk_id int, start int, end int, raw_probability double, confidence double, uncertainty double, supports_flag boolean"


def segments(spark, rows):
    return spark.createDataFrame(rows, SEGMENT)


def test_rules(spark):
    cases = {
        "第一章 绪论": "title", "1.1 研究背景": "title", "Chapter 1 Introduction": "title", "摘要": "title", "目录": "toc", "Contents": "toc", "1.1 Introduction.....5": "toc", "第一章 绪论 --- 1": "toc",
        "参考文献": "reference", "[1] Smith, J. (2020). Title. Journal.": "reference", "Figure 3": "noise", "12345 678": "noise", "": "noise", "A body of sixty and more characters with a full stop at its end.": None, "x" * 120 + ".": "body",
    }
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(cases)], "doc_id bigint, block_index int, text string")
    assert {r.text: r.category for r in classify.classified(rows).collect()} == cases
    summary = classify.filter_summary(classify.settled(classify.classified(rows))).first()
    assert summary.total_paragraphs == summary.body_count + summary.filtered_count


def test_trimmed_mean_and_empty_documents(spark):
    rows = [(1, i, 0, 400, p, 0.8, 0.2, False) for i, p in enumerate([0.1, 0.2, 0.3, 0.4, 0.95])]
    docs = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    got = {r.doc_id: r for r in aggregate.with_empty(docs, aggregate.aggregated(segments(spark, rows))).collect()}
    assert got[1].trimmed_probability == pytest.approx(0.3)
    assert got[1].overall_probability == pytest.approx(0.7 * 0.39 + 0.3 * 0.3)
    assert (got[2].overall_probability, got[2].decision) == (0.0, "pass")


def test_a_flag_needs_evidence(spark):
    row = spark.createDataFrame([(0.9, 0.2)], "raw_probability double, uncertainty double")
    assert aggregate.segment_decision(row.withColumns({"content_strength": F.lit(0.0), "human_strength": F.lit(0.0)})).first().decision == "review"
    assert aggregate.segment_decision(row.withColumns({"content_strength": F.lit(0.8), "human_strength": F.lit(0.0)})).first().decision == "flag"


def test_comparison(spark):
    docs = spark.createDataFrame([(1, "x" * 300), (2, "中" * 200), (3, None)], "doc_id bigint, text string")
    p = segments(spark, [(1, 0, 0, 100, 0.6, 0.8, 0.2, False), (1, 1, 100, 200, 0.4, 0.8, 0.2, False), (2, 0, 0, 600, 0.10, 0.8, 0.2, False)])
    s = segments(spark, [(1, 0, 0, 50, 0.65, 0.8, 0.2, False), (1, 1, 50, 100, 0.58, 0.8, 0.2, False), (1, 2, 100, 200, 0.42, 0.8, 0.2, False), (2, 0, 0, 600, 0.90, 0.8, 0.2, False)])
    got = {r.doc_id: (r.probability_diff, r.consistency_score, r.divergent_count) for r in compare.comparison(docs, p, s).collect()}
    assert got == {1: (0.05, 1.0, 0), 2: (0.8, 0.0, 1), 3: (0.0, 1.0, 0)}
    assert compare.divergent(compare.matched(p, s), docs).first().preview == "中" * 33 + "..."
    assert [r.chunk_id for r in compare.highlighted(p, compare.divergent(compare.matched(p, s), docs)).where("divergent").collect()] == [0]


def test_overlaps_count_once_across_bins(spark):
    left = spark.createDataFrame([(1, 0, 100, "a")], "doc_id bigint, start int, end int, l string")
    right = spark.createDataFrame([(1, 10, 90, "b"), (1, 100, 120, "c")], "doc_id bigint, start int, end int, r string")
    assert [(r.r, r.overlap) for r in compare.overlaps(left, right, width=16).collect()] == [("b", 80)]


def test_sharpening_keeps_the_mean(spark):
    ps = [0.3, 0.42, 0.5, 0.58, 0.7]
    got = aggregate.sharpened(segments(spark, [(1, i, 0, 100, p, 0.8, 0.2, False) for i, p in enumerate(ps)] + [(2, 0, 0, 9, 0.4, 0.8, 0.2, False)])).orderBy("doc_id", "chunk_id").collect()
    new = [r.sharpened for r in got if r.doc_id == 1]
    assert sum(new) / 5 == pytest.approx(0.5, abs=1e-3) and new[0] < 0.3 and new[-1] > 0.7
    assert got[-1].sharpened == 0.4


@pytest.mark.parametrize("n", [1, 2, 11, 31])
def test_p95_is_a_rounded_rank(spark, n):
    items = spark.createDataFrame([(float(i),) for i in range(n)], "probability double")
    assert aggregate.batch_summary(items).first().p95 == round(0.95 * (n - 1))


def test_calibration_and_metrics(spark):
    fit = review.calibration(spark.createDataFrame([(0.21, 0), (0.87, 1), (None, 1)], "probability double, label int")).first()
    assert (fit.a, fit.b) == (pytest.approx(3.0), 0.0)
    only = review.calibration(spark.createDataFrame([(0.2, 0)], "probability double, label int")).first()
    assert (only.a, only.b) == (1.0, 0.0)
    log = spark.createDataFrame([("flag", 1), ("flag", 0), ("pass", 0), ("pass", 1), ("review", 1), ("pass", None)], "decision string, label int")
    m = review.metrics(log).first()
    assert (m.tp, m.tn, m.fp, m.fn, m.accuracy, m.f1) == (1, 1, 1, 1, 0.5, pytest.approx(0.5))


def test_nodes_and_mapping(spark):
    text = "# A\nNo. 7\n正文一\n- item\nA paragraph that is long enough to be one, with a stop."
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = nodes.structured_nodes(docs).orderBy("node_index").collect()
    assert [(n.kind, n.meta_count, n.level) for n in got] == [("heading", 1, 1), ("heading", 0, None), ("heading", 0, None), ("paragraph", 0, None)]
    assert all(n.text == text[n.start : n.end] for n in got)
    seg = spark.createDataFrame([(1, 0, 0, len(text)), (1, 1, 900, 950)], "doc_id bigint, chunk_id int, start int, end int")
    hits = compare.mapped(seg, nodes.structured_nodes(docs))
    assert compare.primary_nodes(hits).first().node_index == 3
    assert [(r.side, r.id) for r in compare.unmapped(seg, nodes.structured_nodes(docs), hits).collect()] == [("segment", 1)]
    assert compare.headings_have_bodies(hits).first().ok


def test_judgments(spark):
    seg = pipeline.segments(pipeline.prepared(spark.createDataFrame([(i, f"A text of one sentence, number {i}.") for i in range(1, 6)], "doc_id bigint, text string")))
    answers = [
        (1, 0, 'so: {"probability": 1.9, "signals": [{"id": " Template_Like ", "score": 1.7, "evidence": "seen"}, {"id": "unknown", "score": 1, "evidence": "seen"}, {"id": "logical_leaps", "score": 1, "evidence": " "}]} end'),
        (2, 0, "no json at all"), (4, 0, '{"probability": 0.9, "confidence": "high"}'), (5, 0, "{}"),
    ]
    table = spark.createDataFrame(answers, "doc_id bigint, chunk_id int, response_json string")
    parsed = {r.doc_id: r for r in judge.judged(table).collect()}
    assert [(e.id, e.score, e.weight) for e in parsed[1].evidence] == [("template_like", 1.0, 1.0)] and parsed[1].llm_probability == 1.0 and parsed[1].llm_confidence == 0.6
    assert parsed[2].llm_probability is None and parsed[4].llm_probability is None and parsed[5].llm_probability == 0.0
    got = {r.doc_id: r for r in judge.fused(seg, table).collect()}
    assert got[1].fused_probability > got[1].raw_probability and got[2].fused_probability == got[2].raw_probability
    assert got[2].fused_uncertainty >= 0.5 and got[2].notes == ["llm_failed_local_only"] and got[3].fused_uncertainty == got[3].uncertainty and got[3].notes == []
    academic = judge.fused(seg, table, 1.0).where("doc_id = 1").first()
    assert academic.evidence[0].weight == pytest.approx(0.4) and academic.notes == ["academic_structure_uncertainty_boost"]


def test_tiers(spark):
    docs = pipeline.prepared(spark.createDataFrame([(1, "Short one here. " + "A sentence of more than fifty characters, which a judge is asked about. " * 3)], "doc_id bigint, text string"))
    from textloom.operators import features

    rows = classify.sentence_tiers(split.sentences(docs)).join(docs.select("doc_id", "language"), "doc_id")
    rows = features.perplexity(features.stylometry(rows)).drop("tokens", "token_counts")
    table = spark.createDataFrame([(1, 1, '{"probability": 0.9}'), (1, 2, "broken")], "doc_id bigint, chunk_id int, response_json string")
    got = {r.chunk_id: r for r in judge.judged_tiers(rows, table).collect()}
    assert [got[i].fused_confidence for i in (0, 2, 3)] == [0.5, 0.4, 0.5] and got[2].fused_uncertainty == 0.6
    assert [got[i].notes[0] for i in (0, 2, 3)] == ["local_stylometry_only", "retry_exhausted_local_fallback", "no_judge_local_only"] and got[1].notes == []


def test_a_judge_that_fails_is_asked_again(spark):
    def judge_(text):
        if "bad" in text:
            raise ValueError(text)
        return '{"probability": 0.5}'

    rows = spark.createDataFrame([(1, 0, "good"), (1, 1, "bad")], "doc_id bigint, chunk_id int, prompt string")
    assert {r.chunk_id: r.response_json for r in judge.judge_with(rows, judge_).collect()} == {0: '{"probability": 0.5}', 1: None}
    assert judge.provider_for("glm:x", {"glm": "k"}) == ("glm", "x") and judge.provider_for("glm", {"openai": "k"}) == ("openai", None) and judge.provider_for(None, {}) is None


def test_adaptive_fusion(spark):
    rows = [(1, 0, 0.9, 0.5), (2, 0, 0.5, 0.4), (2, 1, 0.5, 0.6), (3, 0, 0.1, 0.4), (3, 1, None, 0.9), (3, 2, 0.9, 0.6)]
    got = {(r.doc_id, r.chunk_id): r.fused_probability for r in judge.adaptively_fused(spark.createDataFrame(rows, "doc_id bigint, chunk_id int, llm_probability double, raw_probability double")).collect()}
    assert got[1, 0] == pytest.approx(0.3 * 0.9 + 0.7 * 0.5) and got[2, 0] == 0.4 and got[3, 1] == 0.9
    w = 0.3 + 0.25 * 0.16 / 0.17
    assert got[3, 0] == pytest.approx(w * 0.1 + (1 - w) * 0.4)


def test_first_balanced_object(spark):
    cases = {' {"a":"}"} {"b":1}': '{"a":"}"}', '{"a":{"b":"\\"}"}}x': '{"a":{"b":"\\"}"}}', "x{}": None, "{": None, "": None}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", judge.first_json(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases


def test_profiles(spark):
    docs = spark.createDataFrame([(i, "long enough " * 30) for i in range(4)] + [(9, "short")], "doc_id bigint, text string")
    answers = [(0, '{"category": "论文", "discipline": "物理学", "summary": "s"}'), (1, '{"category": "x", "summary": " "}'), (2, "none"), (3, '{"category": "odd", "subfield": "law", "summary": "s"}'), (9, '{"category": "理学", "summary": "s"}')]
    known = spark.createDataFrame([("理学", "物理学"), ("交叉学科", None), ("法学", None)], "category string, discipline string")
    got = {r.doc_id: (r.category, r.paper_type, r.validity, r.academic) for r in profile.profiles_of(docs, spark.createDataFrame(answers, "doc_id bigint, response string"), known).collect()}
    assert got == {0: ("理学", "论文", "valid", 1.0), 3: ("法学", None, "partial", 0.6)}


def test_pipeline_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "One. Two. " * 400), (5, "标题\n\n正文。" * 5)], "doc_id bigint, text string").withColumn("score", F.lit(1))
    rows = {r.doc_id: r for r in pipeline.detect_dual(docs).collect()}
    assert set(rows) == {1, 2, 3, 4, 5} and rows[1].paragraph_segments == 0
    assert all(0 <= r.consistency_score <= 1 for r in rows.values())
    scored = pipeline.segments(pipeline.prepared(docs), cfg=EngineConfig(use_stylometry=False, use_perplexity=False)).collect()
    assert scored and all(0.02 <= r.raw_probability <= 0.98 and not math.isnan(r.raw_probability) for r in scored)
    assert pipeline.detect(docs.limit(0)).count() == 0


def test_chunks_are_slices(spark):
    text = "\n\n".join(f"word{i} 中文 " * 50 + "." for i in range(20))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "one")], "doc_id bigint, text string")
    rows = chunk.token_chunks(docs, 120).orderBy("doc_id", "chunk_id").collect()
    mine = [r for r in rows if r.doc_id == 1]
    assert len(mine) > 5 and all(r.text == text[r.start : r.end] for r in mine) and "".join(r.text for r in mine) == text
    assert [(r.doc_id, r.text) for r in rows if r.doc_id > 1] == [(2, ""), (4, "one")]
    assert chunk.chunk_budget() == 550 and chunk.chunk_budget(2000) == 600 and chunk.chunk_budget(500, "high") == 360 and chunk.chunk_budget(50) == 120


def test_long_segments(spark):
    text = "这是一句很短的话！ " * 90 + "end"
    rows = chunk.split_long(spark.createDataFrame([(1, 0, 7, text), (1, 1, 0, "short")], "doc_id bigint, chunk_id int, start int, text string"), 180).orderBy("chunk_id", "part").collect()
    assert len(rows) > 3 and all(r.text == text[r.start - 7 : r.end - 7] for r in rows if r.chunk_id == 0) and rows[-1].text == "short"
    assert all(sum("一" <= c <= "鿿" for c in r.text) <= 270 for r in rows)


def test_titles_are_merged(spark):
    texts = {1: "My Title\n\nThis is the body paragraph.", 2: "Only\n\nTitles", 3: "A body stands here, with a stop.\n\nEnd", 4: "One", 5: "标题\n\n副题\n\n正文在这里。"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {}
    for r in chunk.merge_titles(docs, split.paragraph_array(F.col("text"))).orderBy("doc_id", "block_index").collect():
        assert r.text.encode() == texts[r.doc_id].encode()[r.start : r.end]
        got.setdefault(r.doc_id, []).append(r.text)
    assert {k: len(v) for k, v in got.items()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1}


def test_plans_of_merges(spark):
    docs = spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")
    spans = F.array(*[F.struct(F.lit(2 * i).alias("start"), F.lit(2 * i + 2).alias("end")) for i in range(3)])
    plan = lambda *pairs: F.array(*[F.struct(F.lit(a).alias("paragraph_start"), F.lit(b).alias("paragraph_end")) for a, b in pairs])
    merge = lambda *pairs: [r.text for r in chunk.planned_merge(docs, spans, plan(*pairs)).orderBy("chunk_id").collect()]
    assert merge((0, 1), (2, 2)) == ["abcd", "ef"] and merge((0, 0), (2, 2)) == [] and merge((0, 1)) == [] and merge((0, 3)) == [] and merge((0, 0), (1, 0), (1, 2)) == []


def test_flat_documents_are_cut_again(spark):
    rows = lambda ps: spark.createDataFrame([(d, i, p) for d, v in ps.items() for i, p in enumerate(v)], "doc_id bigint, chunk_id int, raw_probability double")
    first, second = rows({1: [0.5, 0.51], 2: [0.1, 0.9] * 4}), rows({1: [0.2, 0.8, 0.4], 2: [0.1, 0.9] * 8})
    assert {r.doc_id: r["count"] for r in chunk.resplit_flat(first, second).groupBy("doc_id").count().collect()} == {1: 3, 2: 8}
    assert chunk.resplit_flat(first, second, "high") is first


def test_node_blocks(spark):
    nodes_ = [(1, 0, "heading", 0, 3, "# A"), (1, 1, "paragraph", 4, 9, "short"), (1, 2, "list_item", 10, 12, "- b"), (1, 3, "paragraph", 20, 400, "long" * 95), (2, 0, "heading", 0, 3, "# A")]
    rows = spark.createDataFrame(nodes_, "doc_id bigint, node_index int, kind string, start int, end int, text string")
    show = lambda **o: [(r.label, r.merged, r.start, r.end) for r in chunk.node_blocks(rows, **o).where("doc_id = 1").orderBy("block_index").collect()]
    assert show() == [("body", True, 4, 12), ("body", False, 20, 400)]
    assert show(headings=True, attach=True) == [("heading", False, 0, 3), ("body", True, 0, 12), ("body", False, 20, 400)]
    assert len(show(align=False)) == 3 and chunk.node_blocks(rows).where("doc_id = 2").first().text == "# A"


def test_noise_is_the_reference_hash():
    import subprocess
    import sys

    data = [b"", b"a", b"12345678", "中文 text".encode() + b"\xff" + (42).to_bytes(8, "little")]
    # with a key of zeros the interpreter's own hash is the same function
    told = subprocess.run([sys.executable, "-c", f"import sys; assert sys.hash_info.algorithm == 'siphash13'; print([hash(x) % 2**64 for x in {data[1:]!r}])"], env={"PYTHONHASHSEED": "0"}, capture_output=True, text=True, check=True).stdout
    assert [score.siphash13(x) for x in data[1:]] == eval(told)


def test_filtered_detection(spark):
    body = "This paragraph says something at length, so that it is longer than a hundred characters and ends with a stop. " * 2
    docs = spark.createDataFrame([(1, f"目录.....1\n\n{body}\n\n参考文献\n\n{body}"), (2, "目录"), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pipeline.detect(docs, filtered=True).collect()}
    assert (got[1].segments, got[2].segments, got[3].segments) == (2, 0, 0)
    sentences = pipeline.filtered_segments(pipeline.prepared(docs), "sentence").collect()
    assert sentences and all("目录" not in r.text and "参考文献" not in r.text for r in sentences)


def test_files(spark, tmp_path):
    import zipfile

    body = "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body><w:p><w:r><w:t>%s</w:t></w:r></w:p><w:tbl><w:p><w:t>cell</w:t></w:p></w:tbl></w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body % ("A long paragraph. " * 10))
    (tmp_path / "b.txt").write_bytes("中文".encode("gbk"))
    (tmp_path / "c.docx").write_bytes(b"broken")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert rows["b.txt"].text == "中文" and "cell" not in rows["a.docx"].text and rows["c.docx"].error
    reviews = spark.createDataFrame([("r", "flag", 0.8, 0.7, 1, "")], "request_id string, decision string, overall_probability double, overall_confidence double, label int, notes string")
    assert logs.append_reviews(reviews, str(tmp_path / "log")).first().flag == 1


def test_reports(spark):
    import json

    docs = spark.createDataFrame([(1, 0.5, "review"), (2, 0.0, "pass")], "doc_id bigint, overall_probability double, decision string")
    found = spark.createDataFrame([(1, 1, 0.4), (1, 0, 0.6)], "doc_id bigint, chunk_id int, raw_probability double")
    got = {r.doc_id: json.loads(r.report) for r in files.reports(docs, found, docs.select("doc_id", "decision")).collect()}
    assert [s["chunk_id"] for s in got[1]["segments"]] == [0, 1] and got[1]["aggregation"]["decision"] == "review" and got[1]["dualDetection"] == {"decision": "review"}
    assert got[2]["segments"] == []


def test_what_is_scored_and_shown(spark):
    rows = [(1, 0, True), (1, 1, False), (2, 0, False), (2, 1, None)]
    blocks = spark.createDataFrame(rows, "doc_id bigint, block_index int, need_detect boolean")
    assert sorted((r.doc_id, r.block_index) for r in split.detectable(blocks).collect()) == [(1, 0), (2, 0), (2, 1)]
    shown = compare.in_order(spark.createDataFrame([(2, 0), (1, 1), (1, 0)], "doc_id bigint, chunk_id int"), 1).collect()
    assert [(r.doc_id, r.chunk_id) for r in shown] == [(1, 0), (2, 0)]


def test_settings(tmp_path):
    s = Settings(str(tmp_path / "s.json"), keep=2)
    for i in range(4):
        s.set("a.b", i)
    assert s.get("a.b") == 3 and len(s.versions()) == 2 and s.rollback() and s.get("a.b") == 2
    assert s.delete("a.b") and s.get("a.b", "none") == "none"
    assert [s.backup() for _ in range(12)] and len(list(tmp_path.glob("*.bak"))) == 10 and Settings(str(tmp_path / "none.json")).backup() is None
    assert clean_key(' "Bearer k" ') == "k" and endpoint("http://h/", "/v1/messages") == "http://h/v1/messages"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "One sentence. And two.")], streaming.DOCUMENT).write.parquet(str(tmp_path / "in"))
    q = streaming.score_stream(streaming.new_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
