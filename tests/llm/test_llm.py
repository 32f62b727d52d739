"""Operators of the llm subpackage: fixed cases, brute force, round trips, and edge cases."""

import os
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("textloom.llm.queries")

from textloom.llm import byte_bpe, chunking, encoding_repair, language_id, lookalike, mixture, sentences, structure, subjects  # noqa: E402
from textloom.llm.prose import body  # noqa: E402

PROSE = {
    "en": "The results of the trial show that the method is not as good as it was in the first year. We do not know why it has been so.",
    "de": "Die Ergebnisse der Studie zeigen, dass das Verfahren nicht so gut ist wie im ersten Jahr. Wir wissen nicht, warum es so ist.",
    "fr": "Les résultats de l'étude montrent que la méthode n'est pas aussi bonne que dans la première année. Nous ne savons pas pourquoi.",
    "es": "Los resultados del estudio muestran que el método no es tan bueno como en el primer año. No se sabe por qué es así.",
    "ru": "Результаты работы показывают, что метод не так хорош, как это было в первый год. Мы не знаем, почему это так.",
    "zh": "研究的结果表明，这个方法不如第一年的好。我们不知道这是为什么。",
    "ja": "研究の結果は、この方法が最初の年ほど良くないことを示している。その理由は分からない。",
}


# 1
@pytest.mark.parametrize("text,kind", [
    (PROSE["en"], "prose"), (PROSE["zh"], "prose"), (None, None), (" \n", None), ("Results", "prose"),
    ("\n".join(f"- item number {i}" for i in range(9)), "list"), ("\n".join(f"1.{i} The method ........ {i}" for i in range(9)), "list"), ("\n".join(f"[{i}] Smith, J. (1999). A title. J. Stud. 4, 5-9." for i in range(1, 9)), "list"),
    ("\n".join(f"a{i}\t{i}\t3.5\tn/a" for i in range(9)), "table"), ("\n".join(f"| a | {i} | 2 |" for i in range(9)), "table"), ("\n".join(f"a{i},4,5.5,,2" for i in range(9)), "table"),
    ("\n".join(f"0000{i}0  4e 04 51 6d c1 c1 9b 5c c8 32 30" for i in range(9)), "junk"), ("menu home " * 60, "junk"), ("ha" * 200, "junk"), ("xqz wrtk bvnm qwrt pkjh zxcv " * 1 + "bnrt qpld mnbv gtrw kjhz plkm", "junk"), ("l1~;|:' ~ij !|`.,; " * 20, "junk"),
])
def test_kinds(text, kind):
    assert structure.kind_of(text) == kind


def test_article_body():
    text = "\\documentclass{article}\n\\title{T}\n\\begin{document}\nShown. % hidden\n\\begin{comment}gone\\end{comment}\n\\end{document}\nafter"
    assert "hidden" not in body(text) and "gone" not in body(text) and "after" not in body(text) and "Shown." in body(text)
    listing = "\\begin{document}\nOne line.\n\\begin{itemize}\n" + "\\item a thing\n" * 30 + "\\end{itemize}\n\\end{document}"
    assert structure.kind_of(listing, article=True) == "list"


# 2
@pytest.mark.parametrize("text,starts", [
    ("We saw Dr. Smith at 5 p.m. today. It rained.", 2), ("As Fig. 91 shows, it reached 28.31 mm. At first it was small.", 2), ("“Nothing holds. It has failed,” wrote Ann about it. Then he left.", 2),
    ("我们等了很久……但是没有变化。“有用吗？”他问道，然后去看。第七版（见第7页。）和旧版。", 3), ("「安定しない。やり直すしかない。」とAnnは書いた。本当に新しいのか？", 2), ("यह सही है। फिर क्या हुआ?", 2),
    ("Laut Abb. 15 liegt es bei ca. 9.000,5 Einheiten. Am 7. Mai war es so.", 2), ("draft.The revised plan held.", 2), ("A heading\n\nA sentence over\ntwo lines.", 2), ("", 0), (" \n ", 0), (None, 0),
])
def test_sentence_counts(text, starts):
    found = sentences.sentences(text)
    assert len(found) == starts
    raw = (text or "").encode()
    assert all(raw[a:b].decode() == s for a, b, s in found)


def test_sentences_cover_all_text():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab中。.!? \"“”()\n1") for _ in range(60))
        joined = "".join(s for _, _, s in sentences.sentences(text))
        assert "".join(joined.split()) == "".join(text.split())


# 3
def test_pairs_against_brute_force(spark):
    base = ["Café “one” — it's", "Hello world", "файл готов"]
    variants = ["Cafe\u0301 “one” — it's", "Ｈｅｌｌｏ world", "Hello\u00a0wor\u200bld", "Hellо world", 'Café "one" - it\'s', "Cafe “one” — it's", "фaйл готов", "Hello world", "Hello  world", None, " "]
    texts = base + variants
    rows = [(f"r{i:02d}", t, i % 4 != 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "request_id string, text string, f boolean").select("request_id", "text", F.struct(F.col("f").alias("normalize_punctuation")).alias("preprocess_options"), F.lit(1).alias("spelling"))
    got = {(r.request_id_a, r.request_id_b) for r in lookalike.pairs(df).collect()}
    mapped = {ord(c): v for k, vs in lookalike.LOOKALIKE.items() for c, v in zip(k, vs, strict=True)} | dict.fromkeys(map(ord, lookalike.HIDDEN))
    plain = {ord(c): v for k, v in lookalike.QUOTES.items() for c in k} | {ord(c): "-" for c in lookalike.DASHES}

    def key(text, fold):
        out = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", text).translate(mapped))
        return unicodedata.normalize("NFC", out.translate(plain) if fold else out)

    want = {(a, b) for a, t, f in rows for b, u, g in rows if a < b and t and u and t.strip() and u.strip() and t != u and (key(t, 0) == key(u, 0) or (f and g and key(t, 1) == key(u, 1)))}
    assert got == want and len(want) > 6


# 4
def test_languages():
    model = language_id.fit([(k, v) for k, v in PROSE.items()])
    assert {k: language_id.main_language(v, model)[0] for k, v in PROSE.items()} == {k: k for k in PROSE}
    mixed = f"{PROSE['en']} {PROSE['fr']}\n\n{PROSE['zh']} {PROSE['en']}"
    assert [x[2] for x in language_id.stretches(mixed, model)] == ["en", "fr", "zh", "en"]
    assert language_id.main_language("", model) == (None, 0.0) and language_id.main_language("123 {} !!", model)[0] is None


def test_labels(spark):
    labels = ["EN", "en_US", "Deutsch", " zh-Hans ", "日本語", "??", "mul", "", None, "it"]
    got = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "i int, v string").orderBy("i").select(language_id.label_of(F.col("v")).alias("x")).collect()]
    assert got == ["en", "en", "de", "zh", "ja", None, None, None, None, "it"]


# 5
@pytest.mark.parametrize("limit,overlap", [(10, 0), (10, 3), (7, 7), (1, 0), (50, 49)])
def test_pieces(limit, overlap):
    rng = random.Random(limit)
    text = "".join(rng.choice(["word ", "中", "x. ", "\n\n", ", ", "ไทย"]) for _ in range(400))
    spans = [m.span() for m in chunking._TOKEN.finditer(text)]
    pieces = chunking.cut(text, limit, overlap)
    inside = [[k for k, (s, e) in enumerate(spans) if a <= s and e <= b] for a, b, _ in pieces]
    assert all(len(x) == n <= limit for x, (_, _, n) in zip(inside, pieces, strict=True))
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and sorted({k for x in inside for k in x}) == list(range(len(spans)))
    kept = overlap if overlap < limit else limit // 2
    assert all(len(set(a) & set(b)) == min(kept, a[-1] + 1) for a, b in zip(inside, inside[1:]))
    assert chunking.cut("", 5, 1) == [] and len(chunking.cut("a b", 5, 1)) == 1


# 6
@pytest.mark.parametrize("written,read,text", [
    ("utf-8", "latin_1", "La muestra pequeña y la mayoría de los años"), ("utf-8", "cp1252", "Die größere Prüfung läuft für uns über Jahre"), ("cp1251", "latin_1", "После короткой паузы метод меняется"),
    ("koi8_r", "cp1251", "После короткой паузы метод меняется"), ("gb18030", "latin_1", "研究的结果表明这个方法不如第一年的好"), ("shift_jis", "cp1252", "研究の結果はこの方法が良くないことを示している"),
])
def test_round_trip_of_encodings(written, read, text):
    pairs: dict = {}
    for t in [*PROSE.values(), text] * 40:
        for r in encoding_repair._HIGH.findall(t):
            for p in zip(r, r[1:]):
                pairs["".join(p)] = pairs.get("".join(p), 0) + 1
    model = encoding_repair.PairModel(pairs)
    raw = text.encode(written)
    garbled = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in raw)
    found = encoding_repair.mend(garbled, model)
    assert found and found[0][2] == text
    assert all(not [x for x in encoding_repair.mend(t, model) if x[1] > -encoding_repair.PRIOR] for t in PROSE.values())


# 7
def test_tokens_round_trip_and_equal_a_public_encoder():
    tiktoken, tokens = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = byte_bpe.vocabulary_path()
    ranks = byte_bpe.read_ranks(path)
    other = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine, rng = byte_bpe.automaton(path), random.Random(5)
    texts = [*PROSE.values(), "", "aaaa}}}}}}----======\n\n\n  x", "don't we'll 12½ ⅷ ไทย हिन्दी 𝒳𝒴 🙂", "<|endoftext|>"] + ["".join(chr(rng.choice([*range(32, 127), *range(0x400, 0x450), 0x4E00, 0x200B, 0x1F600, 10])) for _ in range(80)) for _ in range(60)]
    for t in texts:
        ids = machine.encode(t)
        assert ids == other.encode_ordinary(t) and machine.decode(ids) == t
    assert machine.encode(None) == []


# 8
def test_water_filling():
    targets = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 9), "gone": (0.1, 3)}
    take = mixture.fill({"a": 100, "b": 100, "c": 800, "other": 50}, targets)
    assert take["a"] == 100 and take["b"] == 200 and sum(take.values()) == pytest.approx(1000)
    assert mixture.fill({}, targets) == {} and mixture.fill({"a": 10}, {"a": (1.0, 0)}) == {}


def test_mix_reaches_its_shares(spark):
    rng = random.Random(1)
    sized = spark.createDataFrame([(i, rng.choice("aaaab"), rng.randint(1, 50)) for i in range(3000)], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([(" A", 0.5, 1), ("b", 0.5, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    planned = mixture.plan(sized, targets)
    rows = {r.source: r for r in mixture.shares(spark, mixture.mix(spark, sized, planned), planned).collect()}
    assert rows["a"].actual_share == pytest.approx(0.5, abs=0.002) and rows["b"].most_copies <= 3 and rows["none"].mixed_tokens == 0


# 9
def test_subject_accuracy_on_held_out_documents():
    rng = random.Random(2)
    words = {s: [f"{s}{i}" for i in range(40)] for s in ("law", "sport", "physics")}

    def doc(about):
        out = [w for s in about for w in rng.choices(words[s], k=60 // len(about))]
        return out + rng.choices([w for v in words.values() for w in v], k=3) + ["the"] * 40

    rows, truth = [], []
    for i in range(400):
        about = rng.sample(sorted(words), 1 if i % 4 else 2)
        counts = {}
        for w in doc(about):
            counts[w] = counts.get(w, 0) + 1
        given = [rng.choice(sorted(words))] if rng.random() < 0.1 else about[:1] if rng.random() < 0.4 else about
        rows.append((sorted(given), counts, [0.0] * len(subjects.STRUCTURE), "src"))
        truth.append(set(about))
    model = subjects.fit(rows[:300], sorted(words))
    good = 0
    for (_, counts, _, _), want in zip(rows[300:], truth[300:], strict=True):
        text = " ".join(" ".join([w.rstrip("0123456789") for w in [k]] * n) for k, n in counts.items())
        c = np.zeros(3)
        for w, n in counts.items():
            if w in model.term_subject:
                c[model.term_subject[w]] += n
        good += {model.subjects[k] for k, _ in model.decode(model._vector(c, text, "src"))} == want
    assert good >= 92


# all
def _tables(spark, root, rows):
    source = "/root/testdata/sf0.001"
    for name in sorted(os.listdir(source)):
        spark.read.parquet(f"{source}/{name}").limit(rows).withColumn("key", F.lit("clash")).write.parquet(f"{root}/{name}")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables' schemas")
@pytest.mark.parametrize("rows", [0, 40])
def test_queries_on_empty_and_small_tables(spark, tmp_path, rows):
    _tables(spark, str(tmp_path), rows)
    for name, f in llm.queries().items():
        n = f(spark, str(tmp_path)).count()
        assert rows or n == (9 if name == "p8_shares" and rows else 0), name
