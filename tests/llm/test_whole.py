"""Cases that shortcuts of the training-data operators missed."""

import re
import time
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("textloom.llm.queries")

from textloom.llm import structure, subjects  # noqa: E402


# 1
@pytest.mark.parametrize("text", ["Home\nLogin\n" * 30, "- home\n- login\n" * 30, "~ ~ ~ ~ ~ ~ ~ ~ ~ ~\n" * 12])
def test_repeated_lines_of_any_shape_are_junk(text):
    assert structure.kind_of(text) == "junk"


def test_divergence_of_runs_of_every_shape():
    near, far = (structure._assign("marked", [f"- {x}" for x in lines]) for lines in ([f"notes of {x} were found to be older than the main plan" for x in ("Ann", "Bob", "Eve", "Joe")], [f"xqz wrtk {x} bvnm qwrt" for x in "abcde"]))
    assert near.language and far.divergence > near.divergence
    # of the same shape and repetition: only the divergence tells them apart
    assert structure.kind_of("- a thing\n" * 30) == "list" and structure.kind_of("- xqz wrtk\n" * 30) == "junk"


# 9
def test_junk_with_many_subject_terms_has_no_subject(spark):
    model = subjects.Model(["law"], {"home": 0}, [], [np.zeros(len(subjects.STRUCTURE) + 3 + len(subjects.STEPS))], [1.0])
    texts = ["home next " * 100, "The owner of the home is not in the home, as it was the home of a friend. " * 2]
    docs = spark.createDataFrame([(i, t, "", None) for i, t in enumerate(texts)], "doc_id bigint, text string, title string, source string")
    assert [(r.doc_id, r.subject) for r in subjects.subjects_of(docs, model).collect()] == [(1, "law")]


# 1
@pytest.mark.parametrize("text,kind", [
    ("[11:29:56.465] dbg 0x60beb0 rc=-8\n[15:26:11.630] WARN 0x58c28f rc=0\n" * 4, "junk"), ("(./kelnor.aux)\nOverfull \\hbox (tambran pt) at 130--130\n! fennor l.346\n] [245] (/tmp/fenzen.fd\n" * 3, "junk"),
    ("7s7KIUBfIm30GmewF8G0ek2qIDqhIohi3VodwO1a\nUPm6Lyavdyi0PXPH7R/M9bhFMndesF2lU3uVdOIv", "junk"), ("j|; ~ ' `|,|!; :i;i~ !~rmm, , l r|m:n ,lln,nn lIji! |`~I !~;'i" * 4, "junk"),
    ("the open question | the northern site | the collected notes | the outer boundary | the control series", "list"), ("1.1 旧方法 ......... 3\n1.2 误差范围 ........... 7\n1.3 年度报告 ....... 11\n1.4 试点项目 ........ 15", "list"),
    ("¦ 旧方法46 ¦ 82.90 ¦ 59.00 ¦\n" * 5, "table"), ("Ø§Ù\x86ØªØ¸Ø±Ù\x86Ø§ Ø«Ù\x85 Ø¹Ø§Ø¯Øª Ø§Ù\x84Ù\x85Ø³Ø\xad Ø§Ù\x84Ø«Ø§Ù\x86Ù\x8a Ù\x85Ø¹ Ø§Ù\x84Ù\x85Ù\x86Ø·Ù\x82Ø©.", "prose"),
])
def test_divergences_tell_junk_from_prose(text, kind):
    assert structure.kind_of(text) == kind


def test_constant_divergences_change_kinds(monkeypatch):
    texts = ["00000000 8c 8e 4e 95 2e ce b9 90 f4 8f 5f d2 d9 39\n" * 6, "The plan was not as good as it had been in the first year, and we do not know why that is so."]
    assert [structure.kind_of(t) for t in texts] == ["junk", "prose"]
    structure._cells.cache_clear()
    monkeypatch.setattr(structure, "divergence", lambda cells: 0.02)
    structure._cells.cache_clear()
    monkeypatch.setattr(structure, "_function_words", lambda *a: ("", 0.0, 0.0, 1.0))
    assert structure.kind_of(texts[0]) != "junk"
    structure._cells.cache_clear()


def _planted_subjects(seed, n):
    """Documents of one or two of four subjects, with shares that vary, passing mentions, wrong labels and missing second ones."""
    rng = np.random.default_rng(seed)
    names, rows, truth = ["a", "b", "c", "d"], [], []
    for _ in range(n):
        main, second = rng.permutation(4)[:2]
        share = np.zeros(4)
        share[main] = 1.0
        two = rng.random() < 0.35
        mention = rng.uniform(0.3, 0.5) if two else rng.uniform(0.0, 0.15)
        share[main], share[second] = 1 - mention, mention
        about = {names[main], names[second]} if two else {names[main]}
        counts = {}
        for k, p in enumerate(share):
            for w in rng.integers(0, 30, int(round(80 * p))):
                counts[f"{names[k]}{w}"] = counts.get(f"{names[k]}{w}", 0) + 1
        given = set(about)
        if two and rng.random() < 0.4:
            given.discard(names[second])
        if rng.random() < 0.06:
            given = {names[rng.integers(4)]}
        rows.append((sorted(given), counts, [0.0] * len(subjects.STRUCTURE), "s"))
        truth.append(about)
    return names, rows, truth


def test_chain_learns_from_noisy_labels_and_is_calibrated():
    names, rows, truth = _planted_subjects(4, 2400)
    model = subjects.fit(rows[:1600], names)
    found, wrong, missed, sure = 0, 0, 0, []
    for (_, counts, _, source), want in zip(rows[1600:], truth[1600:], strict=True):
        c = np.zeros(4)
        for w, k in counts.items():
            if w in model.term_subject:
                c[model.term_subject[w]] += k
        got = {names[k]: p for k, p in model.decode(model._vector(c, "", source))}
        found, wrong, missed = found + len(want & set(got)), wrong + len(set(got) - want), missed + len(want - set(got))
        sure += [(p, s in want) for s, p in got.items()]
    assert found / (found + wrong) > 0.97 and found / (found + missed) > 0.97
    ps, hits = np.array([p for p, _ in sure]), np.array([h for _, h in sure])
    assert abs(ps.mean() - hits.mean()) < 0.12  # the probabilities say how often they are right, on the low side


# 6
def test_shares_may_fall_and_rise(spark):
    from textloom.llm import encoding_repair as repair

    schema = "source string, field string, request_id string, line int, chain string, gain double, share double, total double, original string"
    none = [("good", "f", None, 4000, "none", 0.0, 0.0, 0.0, None), ("bad", "f", None, 40, "none", 0.0, 0.0, 0.0, None)]
    weak = [(s, "f", f"{s}-{i}", 0, "a>b", 5.0, 1.0, 5.0, "x") for s, n in (("good", 2), ("bad", 12)) for i in range(n)]
    sure = [("bad", "f", f"sure-{i}", 0, "a>b", 30.0, 1.0, 30.0, "x") for i in range(8)]
    rows = repair.posteriors(spark.createDataFrame(none + weak + sure, schema)).collect()
    got = {r.request_id: r.posterior for r in rows}
    # the same weak evidence: pooled with a source's sure lines it counts, in a sound source it doesn't; a fixed prior of -6 finds neither
    assert got["bad-0"] > 0.9 and got["good-0"] < 0.1 and got["sure-0"] > 0.99
    several = [("s", "f", None, 3, "none", 0.0, 0.0, 0.0, None), ("s", "f", "r", 0, "a>b", 8.0, 0.5, 8.7, "x"), ("s", "f", "r", 0, "c>b", 8.0, 0.5, 8.7, "x")]
    split = repair.posteriors(spark.createDataFrame(several, schema))
    assert max(r.posterior for r in split.collect()) < 0.5 and repair.garbled_lines(split).count() == 1
    assert repair.posteriors(spark.createDataFrame([], schema)).count() == 0


def test_restored_lines(spark):
    from textloom.llm import encoding_repair as repair

    text = "sound \x00 line\r\ngarbled\rlast"
    lines = spark.createDataFrame([("r", 2, "a>b", 0.9, "mended")], "request_id string, line int, chain string, posterior double, original string")
    row = repair.restored(spark.createDataFrame([("r", text)], "request_id string, text string"), lines).first()
    assert row.text == "sound \x00 line\r\nmended\rlast" and row.chains == ["a>b"] and not row.lost


def test_pairs_beyond_those_held_count_in_full(spark):
    from textloom.llm import encoding_repair as repair, language_id

    ru, zh, de = "Результаты работы показывают, что метод не так хорош.", "研究的结果表明这个方法不如第一年的好", "Die Prüfung der größeren Gärten führt zu schönen Erträgen."
    garbled = [ru.encode("utf-8").decode("latin_1"), ru.encode("cp1251").decode("koi8_r"), de.encode("utf-8").decode("cp1252"), zh.encode("gb18030").decode("big5", "replace"), f"{de} {'größer'.encode().decode('cp1252')}"]
    rows = [(f"{k}{i}", "s", "f", t) for i in range(9) for k, t in (("ru", ru), ("zh", zh), ("de", de))] + [(f"x{i}", "s", "f", t) for i, t in enumerate(garbled)] + [("n", "s", "f", None), ("a", "s", "f", "plain")]
    records = spark.createDataFrame(rows, "request_id string, source string, field string, text string")
    whole, few = repair.fit_pairs(records), repair.fit_pairs(records, pairs_kept=5)
    assert whole.rest is None and len(few.pairs) == 5 and few.rest.count() == len(whole.pairs) - 5
    want, got = ({(r.request_id, r.line, r.chain, r.gain, r.original) for r in repair.evidence(records, x).where("request_id is not null").collect()} for x in (whole, few))
    assert want == got and {"x0", "x1", "x2"} <= {x[0] for x in got}
    model = language_id.fit([("ru", ru), ("zh", zh), ("de", de)])
    asked = records.selectExpr("request_id as item_id", "null as label", "text")
    want, got = (sorted(language_id.request_languages(asked, model, x).collect(), key=str) for x in (whole, few))
    assert want == got


def test_worse_chains_are_dropped_at_their_first_pairs():
    from textloom.llm import encoding_repair as repair

    line = "├" + "".join(chr(0x4E00 + 7 * i) for i in range(2000))
    model = repair.PairModel({a + b: 40 for a, b in zip(line, line[1:])})
    assert not repair.mend(line, model) and len(model.known) < 2 * len(line)  # the line's own pairs and the first few of each chain


class _ToTheEnd:
    """A pair model that adds up every text to its end."""

    def __init__(self, model):
        self.model = model

    def __getattr__(self, name):
        return getattr(self.model, name)

    def of(self, text, least=None):
        return self.model.of(text)


def test_dropping_chains_changes_no_explanation():
    from textloom.llm import encoding_repair as repair

    texts = [
        "Результаты работы показывают, что метод не так хорош.", "研究的结果表明这个方法不如第一年的好", "Die Prüfung der größeren Gärten führt zu schönen Erträgen.", "La muestra pequeña y la mayoría de los años",
        "研究の結果はこの方法が良くないことを示している", "على الرغم من ذلك", "ผลการวิจัย", "naïve “quotes” – fine",
    ]
    pairs = Counter(a + b for t in texts * 30 for a, b in zip(t, t[1:]) if max(a, b) > "\x7f")
    model, n = repair.PairModel(pairs), 0
    for text in texts:
        for written in repair.WRITTEN:
            for read in repair.READ:
                line = text.encode(written, "ignore").decode(read, "replace")
                want = repair.mend(line, _ToTheEnd(repair.PairModel(pairs)))
                assert repair.mend(line, model) == want
                n += bool(want)
    assert n > 100
    # the same pairs in another place are no gain, whatever the order they are added up in
    half = "a pequeña y la mayoría de los año a peque¤a y la mayor¡a de los a¤o"
    assert all(gain > 1 for _, gain, _ in repair.mend(half, model)) and repair.mend(half, model)[0][2].count("pequeña") == 2


@pytest.mark.parametrize("sign", ["\x85", "\ufffd", "é©", "Ã\xad", "ж¤", "éàü", "aÉ", "a„a", "жЖ", "aж", "жa", "aά", "中ｱ", "€中"])
def test_signs_of_wrong_decoding(sign):
    from textloom.llm import encoding_repair as repair

    model = repair.PairModel({})
    assert model.suspects(sign) and model.suspects(f"Ein Satz (при) {sign} 研究 “so”.")
    assert not model.suspects("Ein größerer Satz – при Этом, „so“ und 研究の结果 5 € für 3 × 4 °C, άa.")


# 3
def test_outlines_are_coarser_than_the_collation(spark):
    import unicodedata

    from pyspark.sql import functions as F
    from textloom.llm import lookalike

    same = [("한국어", unicodedata.normalize("NFD", "한국어")), ("豈", unicodedata.normalize("NFC", "豈")), ("𝐀𝑏", "Ab"), ("օ", "o"), *((unicodedata.normalize("NFC", t), unicodedata.normalize("NFD", t)) for t in ("\u1ec7x", "\u0915\u093cy", "\u30ac"))]
    rows = [(f"r{2 * i + k}", t) for i, pair in enumerate(same) for k, t in enumerate(pair)] + [("x1", "한국이"), ("x2", "Ac")]
    df = spark.createDataFrame(rows, "request_id string, text string").withColumn("preprocess_options", F.struct(F.lit(True).alias("normalize_punctuation")))
    pairs = {(r.request_id_a, r.request_id_b) for r in lookalike.pairs(df).collect()}
    want = {tuple(sorted((f"r{2 * i}", f"r{2 * i + 1}"))) for i, (x, y) in enumerate(same) if x != y}
    assert want <= pairs and not any("x" in a + b for a, b in pairs)


def test_large_classes_keep_their_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F
    from textloom.llm import lookalike

    monkeypatch.setattr(lookalike, "PART", 3)
    rows = [(f"r{i:02d}", "Hello world" if i % 2 else "Ｈello world") for i in range(20)]
    df = spark.createDataFrame(rows, "request_id string, text string").withColumn("preprocess_options", F.struct(F.lit(True).alias("normalize_punctuation")))
    found = lookalike.pairs(df).collect()
    assert len(found) == len({(r.request_id_a, r.request_id_b) for r in found}) == 100


# 2
def test_a_quotation_of_any_length_stays_with_its_sentence():
    from textloom.llm import sentences

    quoted = "„" + "Ein Satz steht hier. " * 300 + "Ende.“ sagte sie."
    assert [s for _, _, s in sentences.sentences(f"{quoted} Dann ging es weiter.")] == [quoted, "Dann ging es weiter."]
    # the case of a script is told from the whole paragraph
    mixed = "研究的结果表明这个方法不好。" * 60 + "Это был план др. и других авторов. Потом он вышел."
    assert len(sentences.sentences(mixed)) == 62


# 4
def test_articles_in_several_languages_have_their_stretches(spark):
    from textloom.llm import language_id

    en = "The results of the trial show that the method is not as good as it was in the first year. We do not know why it has been so."
    de = "Die Ergebnisse der Studie zeigen, dass das Verfahren für große Gärten nicht so gut ist wie im ersten Jahr. Wir wissen nicht, warum es so ist."
    fr = "Les résultats de l'étude montrent que la méthode n'est pas aussi bonne que dans la première année. Nous ne savons pas pourquoi."
    model = language_id.fit([("en", en), ("de", de), ("fr", fr)])
    head = f"\\documentclass{{article}}\n% {fr}\n\\title{{Über}}\n\\begin{{document}}\n\\begin{{abstract}}\n"
    text = f"{head}{en}\n% {fr}\n\\end{{abstract}}\n\n{de.replace('große', 'gro\u00adße')} {de}\n\\begin{{comment}}\n{fr}\n\\end{{comment}}\n\n{de}\n\\end{{document}}\n% {fr}\n"
    docs = spark.createDataFrame([("1", "xx", text), ("2", "xx", f"{head}{en}\n\\end{{document}}\n"), ("3", "xx", None)], "item_id string, label string, text string")
    rows = {(r.item_id, r.segment): r for r in language_id.document_languages(docs, model).collect()}
    assert {k: r.lang for k, r in rows.items()} == {("1", 0): "de", ("1", 1): "en", ("1", 2): "de", ("2", 0): "en", ("3", 0): None}
    raw = text.encode()
    assert (rows["1", 0].start, rows["1", 0].end_offset) == (0, len(raw)) and all(0 < r.confidence <= 1 for r in rows.values() if r.lang)
    assert raw[rows["1", 1].start : rows["1", 1].end_offset].decode() == en
    second = raw[rows["1", 2].start : rows["1", 2].end_offset].decode()
    assert second.startswith("Die Ergebnisse") and second.endswith("warum es so ist.") and text.index(second) > text.index("\\end{abstract}") and "end{document}" not in second


def test_places_of_what_an_article_shows():
    from textloom.llm import structure
    from textloom.llm.prose import body

    text = "\\usepackage{x}\r\n% é\n\\begin{document}ä % weg 語\n\\iffalse 語 \\fi 語\u200b語\r\n\\input{x}\n\U0001d400 5\\% z\n\\end{document} q"
    for article in (False, True):
        at = list(range(len(text)))
        shown = structure._shown(text, article, at)
        assert shown == structure._shown(text, article) == "".join(text[i] for i in at)
    assert body(text) and "語" in body(text) and "weg" not in body(text)


def test_grams_of_one_slot_are_all_found(monkeypatch):
    from textloom.llm import language_id

    monkeypatch.setattr(language_id, "SLOTS", 10)
    model = language_id.fit([("en", "The plan was not as good as it had been in the first year of the trial.")], grams_kept=3000)
    keys = model.keys[1:]
    assert len(keys) > 500 and (model._found(keys) == np.arange(1, len(keys) + 1)).all()
    assert not model._found(keys + (1 << 52)).any()


def test_long_prose_is_counted_once(monkeypatch):
    from textloom.llm import language_id

    shares = language_id.FUNCTION_WORDS["en"]
    words = [*shares, *"plan trial year method garden result study winter plant table number water house north summer market letter river paper story".split()]
    odds = [*shares.values(), *[(1 - sum(shares.values())) / 20] * 20]
    pick = np.random.default_rng(3).choice(len(words), (200, 15), p=odds)
    text = " ".join(" ".join(words[i] for i in row).capitalize() + "." for row in pick)
    model = language_id.fit([("en", text)])
    assert model.whole(model.grams(text)).varied < 0.1 and language_id._sound(text) is text
    # a text with other runs, or blank lines only, besides
    noise = "x7#k!q0$z@9^w*3&v5~j8;" * 40
    assert language_id._sound(f"{text}\n\n{noise}") == text and language_id._sound(f"{text}\n \n{text}") == f"{text}\n \n{text}"
    calls, grams = [], language_id.Model.grams
    monkeypatch.setattr(language_id.Model, "grams", lambda self, t: calls.append(t) or grams(self, t))
    assert language_id.main_language(text, model)[0] == "en" and calls == [text]
    assert language_id.main_language(f"{text}\n\n{noise}", model) == language_id.main_language(text, model) and text in calls[2:]


#: The same markup in one pattern, tried at every place.
_MARKUP = re.compile(r"\\(?:cite\w*|ref|eqref|label|includegraphics|input|include|bibitem|begin|end|url|href|usepackage)\*?(?:\[[^\]]*\])*(?:\{[^{}]*\})*|\$\$?[^$]{0,400}\$\$?|\\[A-Za-z]+\*?|\b\w+=|https?:\S+")


def test_markup_is_found_by_its_rare_characters():
    from textloom.llm import language_id

    bits = ["a", "é_1", "\\cite[x=1]{y}", "\\ref", "\\alpha", "1=", "=", "$", "$$", "x=$y$z=", "https://a.b?x=1 ", "xhttp:=", "http=", " ", "\n", "{", "}", "[", "²=", "\u0301="]
    rng = np.random.default_rng(5)
    for size in [2, 3, 5, 9, 30] * 400:
        text = "".join(bits[i] for i in rng.integers(0, len(bits), size))
        assert language_id._without_markup(text) == _MARKUP.sub(" ", text)
        assert language_id._blanked(text) == _MARKUP.sub(lambda m: re.sub(r"[^\r\n]", " ", m[0]), text)
    text = "Die Ergebnisse der Studie zeigen, dass es nicht so gut ist wie im ersten Jahr. " * 3000 + "x=1"

    def cost(f):
        spent = []
        for _ in range(5):
            start = time.process_time()
            f(text)
            spent.append(time.process_time() - start)
        return min(spent)

    assert cost(language_id._without_markup) < 0.67 * cost(lambda t: _MARKUP.sub(" ", t))


def test_shortcuts_of_counts_change_none():
    from textloom.llm import encoding_repair as repair, language_id

    prose = ["Größere Gärten, „so“ 12 über 3; und é!", "研究の結果は、この方法が良くない。１２", "The plan (no. 4) was: “good”?", "यह योजना अच्छी ऽ नहीं है।", "Это был план др. и других", "\U0001d400 x"]
    for a in prose:
        for b in prose:
            text = f"{a} {b}\n" * 12
            words = structure._TOKENS.findall(text.lower())
            digits, marks, blanks = len(structure._DIGITS.findall(text)), len(structure._PUNCTUATION.findall(text)), text.count(" ") + text.count("\n")
            assert structure._counted(text, False) == (words, sum(map(len, words)) - digits, digits, blanks, marks) or text.isascii()
            assert text.isascii() or structure._counted(text, True) == ([], len(text) - marks - digits - blanks, digits, blanks, marks)
            assert repair.may_be_suspect(text) or not any(repair.PairModel({}).suspects(x) for x in text.split("\n"))
    model = language_id.fit([("de", prose[0]), ("ja", prose[1]), ("en", prose[2]), ("hi", prose[3]), ("ru", prose[4])])
    numbers = np.arange(len(model.letters))
    assert (model.letters[1:] == model._found(numbers[1:])).all() and model.letters[0] == 0 and model.letters.any()
    for tokens, rest in ((40, 0), (12, 28), (11, 29), (13, 400)):  # few distinct runs of words, early or late
        text = " ".join([f"w{i}" for i in range(tokens)] + ["so"] * rest)
        for t in (text, text[::-1]):
            parts = t.split()
            rate = len({tuple(parts[i : i + 5]) for i in range(len(parts) - 4)}) / (len(parts) - 4)
            assert structure._repeated(t) == max(0.0, min(1.0, (0.30 - rate) / 0.15))
    # pieces of two languages, as near to the limit as may be: short sums decide nothing that exact ones wouldn't
    grams, some = model.grams(" ".join(prose) * 20), [0, 40, 90, 400, 700]
    short, exact = (model.strengths(grams, np.array(some), x)[0] for x in (np.float32, np.float64))
    assert (abs(short - exact) < 2e-6 * np.diff(some)[:, None] ** 1.5).all()
