"""Normal form, tokens, splitting and packing, against small brute-force versions and fixed cases."""

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import split


def one(spark, column, text):
    return spark.createDataFrame([(1, text)], "doc_id bigint, text string").select(column(F.col("text")).alias("x")).first().x


def scan(text):
    """Sentences by a plain scan."""
    out, begin, quoted, i = [], 0, False, 0
    data = text
    while i < len(data):
        c = data[i]
        i += 1
        if c in "\"“”'‘’":
            quoted = not quoted
            continue
        if quoted or c not in "。！？.!?":
            continue
        if c == "." and i - 2 >= 0 and i < len(data) and data[i - 2] in "0123456789" and data[i] in "0123456789":
            continue
        while i < len(data) and data[i] in " \t":
            i += 1
        out.append((begin, i))
        begin = i
    out.append((begin, len(data)))
    return [(len(data[:a].encode()), len(data[:b].encode()), data[a:b].strip()) for a, b in out if data[a:b].strip()]


def test_normalized(spark):
    assert one(spark, T.normalized, "Hello“World”—x　y\r\n\r\n\t a \t b ") == 'Hello"World"-x y\n\na b'
    assert one(spark, T.normalized, None) is None
    assert one(spark, T.normalized, "") == ""


def test_tokens(spark):
    for text, n in [("Hello World", 2), ("你好世界", 4), ("Hello 你好", 3), ("", 1), (None, 1)]:
        assert one(spark, T.token_estimate, text) == n


def test_language_needs_more_than_three_tenths(spark):
    assert one(spark, T.language, "一一一aaaaaaa") == "en"
    assert one(spark, T.language, "一一一一aaaaaaa") == "zh"
    assert one(spark, T.language, None) == "en"


def test_sentences_fixed(spark):
    got = one(spark, split.sentence_array, "Hello... w")
    assert [s.text for s in got] == ["Hello.", ".", ".", "w"]
    assert len(one(spark, split.sentence_array, "价格是1.5元。数量是2.3个。")) == 2
    assert one(spark, split.sentence_array, " \n ") == []
    assert one(spark, split.sentence_array, None) is None


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab中。.!? \"'\t\n09", max_size=40), min_size=12, max_size=12))
def test_sentences_equal_a_scan(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").select("text", split.sentence_array(F.col("text")).alias("s")).collect()
    for r in rows:
        assert [(s.start, s.end, s.text) for s in r.s] == scan(r.text)


def test_paragraphs(spark):
    got = one(spark, split.paragraph_array, "First 中.\n \n\n  Second.\n")
    assert [(p.start, p.end, p.text) for p in got] == [(0, 10, "First 中."), (16, 23, "Second.")]
    assert len(one(spark, split.paragraph_array, "")) == 1


def test_packing(spark):
    text = ("一" * 25 + ".") * 10
    rows = split.sentence_blocks(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).orderBy("block_index").collect()
    assert [r.sentence_count for r in rows] == [7, 3]


def test_merge_spans(spark):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(a + 10).alias("end")) for a in (0, 10, 20, 30)])
    got = spark.range(1).select(split.merge_spans(spans, F.array(F.lit(1), F.lit(2))).alias("x")).first().x
    assert [(s.start, s.end) for s in got] == [(0, 10), (10, 40)]


def test_blocks_stay_within_kept_paragraphs(spark):
    text = "标题\n\n这是第一段。这里还有一句。\n\n目录.....1\n\n第二段开始。"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string").withColumn("paragraphs", F.filter(split.paragraph_array(F.col("text")), lambda p: p["text"].rlike("段")))
    rows = split.sentence_blocks_in(docs).collect()
    assert len(rows) == 2 and all("目录" not in r.text for r in rows)


def test_byte_slice_moves_to_characters(spark):
    cut = lambda a, b, most=None: one(spark, lambda c: T.byte_slice(c, F.lit(a), F.lit(b), most), "中" * 200)
    assert cut(1, 100) == "中" * 32 and cut(0, 100) == "中" * 33 and cut(3, 600, 100) == "中" * 33 and cut(1, 2) == "" and cut(-1, 9) == "" and cut(9, 9) == "" and cut(900, 999) == ""
    assert one(spark, lambda c: T.byte_slice(c, F.lit(1), F.lit(7)), "a🙂é") == "🙂é" and one(spark, lambda c: T.byte_slice(c, F.lit(2), F.lit(7)), "a🙂é") == "é"


def test_any_character_may_be_in_a_text(spark):
    text = "One\u0000. Two\ufdd0! Three.\n\nFour\u0000 five"
    got = one(spark, split.sentence_array, text)
    assert [s.text for s in got] == ["One\u0000.", "Two\ufdd0!", "Three.", "Four\u0000 five"]
    assert [p.text for p in one(spark, split.paragraph_array, text)] == ["One\u0000. Two\ufdd0! Three.", "Four\u0000 five"]


def test_long_documents_are_split_in_order(spark):
    text = "".join(f"Sentence {i}. " for i in range(1000))
    got = one(spark, split.sentence_array, text)
    assert len(got) == 1000 and all(text.encode()[s.start : s.end].decode().strip() == s.text for s in got)
    packed = one(spark, lambda c: split.sentence_block_array(split.sentence_array(c), 100, 300), text)
    want, size = [], 0
    for s in got:
        if not want or size + len(s.text) > 100:
            want.append(0)
            size = 0
        want[-1] += 1
        size += len(s.text)
    assert [b.sentence_count for b in packed] == want


def test_legacy_paragraphs(spark):
    text = "\n \nA\nb\n  \n\nc中\nd"
    got = one(spark, split.legacy_paragraph_array, text)
    assert [(p.start, p.end, text[p.start : p.end]) for p in got] == [(3, 7, "A\nb\n"), (11, 15, "c中\nd")]
    assert one(spark, split.legacy_paragraph_array, "") is None and len(one(spark, split.legacy_paragraph_array, " ")) == 1


def test_smart_blocks(spark):
    rows = [(1, "One here. Two there. Three.", None, [0]), (2, "One here. Two there.", [(0, 20)], None), (3, " ", [], None), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans array<struct<start:int,end:int>>, merges array<int>")
    got = [(r.doc_id, r.text, r.sentence_count) for r in split.sentence_blocks_smart(docs, "spans", "merges", 12, 15).orderBy("doc_id", "block_index").collect()]
    assert got == [(1, "One here. Two there. ", 1), (1, "Three.", 1), (2, "One here. Two there.", 1)]
    assert split.paragraph_packs(docs, 500, 1000).where("doc_id = 1").first().paragraph_count == 1
