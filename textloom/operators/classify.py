"""Rule classes of paragraphs and lines, and the summaries of the content filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.functions.text import ALPHA, SPACE, STOPS, stopped, trimmed

_END = f"[{SPACE}]*\\z"
_DIGIT = "\\p{Nd}"
#: Classes of paragraphs, abbreviations, and words that mark a line after a heading as its own (fixed values, as are the patterns below).
CATEGORIES = ["body", "title", "toc", "reference", "noise", "auxiliary"]
ABBREVIATIONS = ["e.g.", "i.e.", "etc.", "vs.", "mr.", "mrs.", "ms.", "dr.", "prof.", "fig.", "eq.", "no.", "inc.", "ltd."]
META_KEYWORDS = ["副标题", "Subheading", "Subtitle", "编号", "No.", "NO.", "序号"]


def _letters(t: Column) -> Column:
    """Letters, and all characters above the first ideograph."""
    return F.length(t) - F.length(F.regexp_replace(t, f"[{ALPHA}\\x{{4E01}}-\\x{{10FFFF}}]", ""))


def is_noise(t: Column) -> Column:
    """Captions, figures and symbols; ``t`` is trimmed, an empty one is noise."""
    n = F.length(t)
    digits = F.regexp_count(t, F.lit("[0-9]")) / F.greatest(n, F.lit(1))
    return (
        (n == 0) | t.rlike(f"\\A(图|表|Figure|Fig\\.|Table)[{SPACE}]*{_DIGIT}+") | (digits > 0.6)
        | ((n < 25) & ~stopped(t) & (digits > 0.3)) | ((_letters(t) / F.greatest(n, F.lit(1)) < 0.1) & (n < 50))
    )


def is_contents(t: Column) -> Column:
    """Headings and lines of a table of contents."""
    line = f"\\A{_DIGIT}+\\.?{_DIGIT}*\\.?{_DIGIT}*[{SPACE}]+[^\\n]+[{SPACE}]+{_DIGIT}+\\z"
    return F.lower(t).isin("目录", "contents", "table of contents") | t.rlike(f"[.·-]{{3,}}[{SPACE}]*{_DIGIT}+[{SPACE}]*\\z") | (t.rlike(line) & (F.length(t) < 80))


def is_reference(t: Column) -> Column:
    """Headings and entries of a bibliography."""
    author = f"\\A[A-Z一-鿿][a-z一-鿿]*[,，]?[{SPACE}]*[^\\n]+[(\\[]?{_DIGIT}{{4}}[)\\]]?"
    year = t.rlike("(?U)\\b(19|20)\\d{2}\\b")
    marks = t.contains("Vol.") | t.contains("pp.") | t.contains("doi:") | t.contains("ISBN")
    return (
        F.lower(t).isin("参考文献", "references", "bibliography", "works cited") | t.rlike(f"\\A\\[{_DIGIT}+\\]")
        | (t.rlike(author) & ~t.contains("http") & year & (marks | (F.length(t) < 200)))
    )


def is_title(t: Column) -> Column:
    n = F.length(t)
    numbered = f"\\A({_DIGIT}+\\.?{_DIGIT}*\\.?{_DIGIT}*[{SPACE}]|第[一二三四五六七八九十百千]+[章节部分条款]|Chapter[{SPACE}]+{_DIGIT}+|Section[{SPACE}]+{_DIGIT}+|Part[{SPACE}]+{_DIGIT}+)"
    return (n <= 60) & ~stopped(t) & (t.rlike(numbered) | ((n <= 30) & (_letters(t) / F.greatest(n, F.lit(1)) > 0.7)))


#: Class, confidence and reason of each rule, in order.
RULES = [("noise", 0.9, is_noise), ("toc", 0.95, is_contents), ("reference", 0.9, is_reference), ("title", 0.85, is_title)]


def is_body(text: Column) -> Column:
    """Whether no rule takes a paragraph out: what the rules aren't sure of stays."""
    t = trimmed(text)
    out = ~RULES[0][2](t)
    for _, _, rule in RULES[1:]:
        out = out & ~rule(t)
    return out


def classified(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``category, class_confidence, reason``; null where no rule is sure."""
    t = trimmed(F.col("text"))
    body = (F.length(t) > 100) & stopped(t)
    category = confidence = reason = None
    for name, sure, rule in [*RULES, ("body", 0.9, lambda _: body)]:
        hit = rule(t)
        if category is None:
            category, confidence, reason = F.when(hit, name), F.when(hit, sure), F.when(hit, f"{name}_pattern")
        else:
            category, confidence, reason = category.when(hit, name), confidence.when(hit, sure), reason.when(hit, f"{name}_pattern")
    return blocks.withColumns({"category": category, "class_confidence": confidence, "reason": reason})


def settled(classes: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Classes of all paragraphs: the rules', else those in ``answers`` (``doc_id, block_index, category, confidence``), else body.

    A repeated answer counts once, the least category holding; an unknown category is body.
    """
    sure = classes.withColumn("by", F.when(F.col("category").isNotNull(), "rule"))
    if answers is None:
        return sure.withColumns({
            "by": F.coalesce("by", F.lit("fallback")), "reason": F.coalesce("reason", F.lit("llm_fallback")),
            "category": F.coalesce("category", F.lit("body")), "class_confidence": F.coalesce("class_confidence", F.lit(0.5)),
        })
    known = F.when(F.col("category").isin(CATEGORIES), F.col("category")).otherwise("body")
    one = answers.groupBy("doc_id", "block_index").agg(F.min(F.struct(known.alias("c"), F.coalesce("confidence", F.lit(0.5)).alias("s"))).alias("a"))
    joined = sure.join(one, ["doc_id", "block_index"], "left")
    return joined.select(
        *[c for c in sure.columns if c not in ("category", "class_confidence", "reason", "by")],
        F.coalesce("category", "a.c", F.lit("body")).alias("category"), F.coalesce("class_confidence", "a.s", F.lit(0.5)).alias("class_confidence"),
        F.coalesce("reason", F.when(F.col("a").isNotNull(), "llm"), F.lit("llm_missing_default")).alias("reason"),
        F.coalesce("by", F.when(F.col("a").isNotNull(), "llm"), F.lit("fallback")).alias("by"),
    )


def filter_summary(classes: DataFrame) -> DataFrame:
    """Counts of paragraphs kept and filtered, one row a document; ``classes`` as from ``settled``."""
    other = F.col("category") != "body"
    return classes.groupBy("doc_id").agg(
        F.count("*").alias("total_paragraphs"), F.count_if(~other).alias("body_count"), F.count_if(other).alias("filtered_count"),
        F.count_if(other & (F.col("by") == "rule")).alias("filtered_by_rule"), F.count_if(other & (F.col("by") == "llm")).alias("filtered_by_llm"),
    )


def boundary_candidates(sentences: DataFrame, most: int = 240) -> DataFrame:
    """Doubtful boundaries between a document's sentences, the first ``most`` of each (the refiner's budget).

    ``doc_id, sent_index, left_text, right_text``.
    """
    order = W.partitionBy("doc_id").orderBy("sent_index")
    pairs = sentences.withColumn("right_text", F.lead("text").over(order)).where("right_text is not null").withColumnRenamed("text", "left_text")
    left, right = F.col("left_text"), F.col("right_text")
    quotes = "[\"“”'‘’]"
    odd = lambda c: F.regexp_count(c, F.lit(quotes)) % 2 == 1
    open_ = F.regexp_count(left, F.lit("\\(")) > F.regexp_count(left, F.lit("\\)"))
    short = "|".join(x.replace(".", "\\.") for x in ABBREVIATIONS)
    dotted = left.endswith(".") & (F.lower(left).rlike(f"({short})\\z") | left.rlike("[A-Z]\\.\\z") | right.rlike("\\A[a-z]"))
    doubtful = ~left.rlike(f"[{STOPS}…]\\z") | odd(left) | odd(right) | open_ | dotted
    chosen = pairs.where(doubtful).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    return chosen.select("doc_id", "sent_index", "left_text", "right_text")


def sentence_tiers(sentences: DataFrame) -> DataFrame:
    """Which judge a sentence goes to by its length; the shortest are dropped and take no ``chunk_id``."""
    n = F.length("text")
    tier = F.when(n < 50, "local").when(n < 300, "llm").otherwise("reasoner")
    order = W.partitionBy("doc_id").orderBy("sent_index")
    return sentences.where(n >= 10).withColumns({"tier": tier, "chunk_id": (F.row_number().over(order) - 1)})


def neighbours(blocks: DataFrame, most: int = 600) -> DataFrame:
    """``blocks`` with the shortened texts of the block before and after."""
    order = W.partitionBy("doc_id").orderBy("block_index")
    short = F.left("text", F.lit(most))  # cut before the shuffle
    return blocks.withColumns({"previous_text": F.lag(short).over(order), "next_text": F.lead(short).over(order)})


def heading_line(t: Column) -> Column:
    """Whether a trimmed line is a heading of a structured text."""
    return (
        t.startswith("#") | t.rlike("[:：]\\z") | t.rlike("\\A第[0-9一二三四五六七八九十百千]+[章节部分]") | t.rlike("(?U)\\A(?:Chapter|CHAPTER)\\s+\\d+\\b")
        | t.rlike("(?U)\\A(?:[IVXLCM]+\\.|\\d+(?:\\.\\d+)*[.,、])\\s*\\S+") | ((F.length(t) <= 30) & ~t.rlike(f"[{STOPS}]\\z"))
    ) & (F.length(t) > 0)


def list_line(t: Column) -> Column:
    return t.rlike("\\A[-•*]") | (t.rlike("(?U)\\A\\d+[.)]\\s+\\S") & ((F.length(t) > 30) | t.rlike(f"[{STOPS}]\\z")))


def heading_meta(t: Column) -> Column:
    """Whether a line after a heading belongs to it."""
    named = "|".join(x.replace(".", "\\.") for x in META_KEYWORDS)
    return (F.length(t) > 0) & (F.length(t) <= 40) & (t.rlike("(: |：)\\z") | t.rlike(named) | t.rlike("(?U)\\A\\d{4}[-/年]\\d{1,2}") | t.rlike("\\A[A-Z]{2,}\\z"))


def heading_level(t: Column) -> Column:
    return (
        F.when(t.startswith("###"), 3).when(t.startswith("##"), 2).when(t.startswith("#"), 1)
        .when(t.rlike("\\A第[一二三四五六七八九十百千]+章"), 1).when(t.rlike("\\A第[一二三四五六七八九十百千]+节"), 2)
        .when(t.rlike("(?U)\\A\\d+\\.\\d+\\."), 3).when(t.rlike("(?U)\\A\\d+\\.\\s*\\S+"), 1)
    )


def conflicting(explanations: Column) -> Column:
    """Whether the explanations of a segment's diversity contradict each other."""
    told = F.array_join(explanations, " ")
    return told.contains("ttr") & told.contains("多样性高") & told.contains("多样性低")


def non_body(classes: DataFrame) -> DataFrame:
    """The paragraphs that aren't body."""
    return classes.where(F.col("category") != "body")
