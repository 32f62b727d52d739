"""Profiles of documents: their field of study, how far it can be trusted, and how academic they are.

Profiles come in as a table, as judgments do (``category, discipline, subfield,
paper_type, summary, conventions``); nothing here calls a network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.text import trimmed
from textloom.operators.judge import json_of

#: Fields of study, in the order in which they are tried (fixed values).
CATEGORIES = ["哲学", "经济学", "法学", "教育学", "文学", "历史学", "理学", "工学", "农学", "医学", "军事学", "管理学", "艺术学", "交叉学科"]
#: Words of each field's disciplines as they stand, and in lower case, in the order in which they are tried (fixed values).
WORDS: list[tuple[str, list[str], list[str]]] = [
    ("哲学", ["哲学"], ["philosophy"]),
    ("经济学", ["经济", "金融", "会计", "财政"], ["economics", "finance"]),
    ("法学", ["法学", "法律", "司法", "公安", "政治", "社会"], ["law", "politic", "sociology"]),
    ("教育学", ["教育"], ["education"]),
    ("文学", ["文学", "语言", "新闻", "传播"], ["literature", "linguistics", "journalism", "communication"]),
    ("历史学", ["历史", "考古"], ["history"]),
    ("理学", ["数学", "物理", "化学", "生物", "地理", "天文", "地球"], ["science", "mathematics", "physics", "chemistry", "biology", "geology", "astronomy"]),
    ("工学", ["工程", "工学", "计算机", "信息", "电子", "通信", "材料", "机械", "土木", "建筑", "环境", "化工", "软件"], ["engineering", "computer", "information", "software"]),
    ("农学", ["农", "林", "畜", "兽", "水产"], ["agriculture", "forestry", "veterinary"]),
    ("医学", ["医学", "临床", "护理", "药学", "口腔", "中医", "公共卫生"], ["medicine", "clinical", "nursing", "pharmacy"]),
    ("军事学", ["军事"], ["military", "defense"]),
    ("管理学", ["管理", "工商", "公共管理", "图书", "档案", "信息管理"], ["management", "business", "administration"]),
    ("艺术学", ["艺术", "美术", "音乐", "戏剧", "舞蹈", "设计"], ["art", "design", "music", "drama"]),
    ("交叉学科", ["交叉"], ["interdisciplinary"]),
]
#: Groups of fields as schools name them (fixed values).
GROUPS = [("理科", "理学"), ("工科", "工学"), ("医科", "医学"), ("农科", "农学")]
#: Words that tell a kind of paper, and an academic one (fixed values).
PAPER_TYPES = ["论文", "综述", "实验", "报告", "作业", "课程", "说明文", "调查", "调研", "毕业设计", "thesis", "paper", "report", "survey"]
ACADEMIC_TYPES = ["论文", "综述", "研究", "实验", "报告", "期刊", "学位", "thesis", "paper", "research", "journal"]
MIXED = "交叉学科"
RESPONSE = "category string, discipline string, subfield string, paperType string, summary string, conventions array<string>, _corrupt_record string"


def _holds(text: Column, words: list[str]) -> Column:
    """Whether any of the words occurs in a text; false for null."""
    return F.coalesce(text.rlike("|".join(words)), F.lit(False))


def field_of_discipline(discipline: Column) -> Column:
    """The field a discipline's name tells; null where none of its words occur."""
    out = None
    for field, own, lower in WORDS:
        hit = _holds(discipline, own) | _holds(F.lower(discipline), lower)
        out = F.when(hit, field) if out is None else out.when(hit, field)
    return out


def field_of(value: Column, discipline: Column) -> Column:
    """The field of study that free text names, with the discipline as a hint; the mixed field where neither tells one."""
    told, hint = trimmed(F.coalesce(value, F.lit(""))), field_of_discipline(discipline)
    out = F.when(told == "", F.coalesce(hint, F.lit(MIXED)))
    for name in CATEGORIES:
        out = out.when(told.contains(name), name)
    for group, name in GROUPS:
        out = out.when(told.contains(group), name)
    out = out.when(_holds(told, ["商科", "经管"]), F.when(hint.isin("经济学", "管理学"), hint).otherwise("管理学")).when(told.contains("文科"), "文学")
    return out.otherwise(F.coalesce(field_of_discipline(told), hint, F.lit(MIXED)))


def names_paper_type(value: Column) -> Column:
    """Whether a text names a kind of paper instead of a field."""
    return _holds(F.lower(value), PAPER_TYPES)


def validated(profiles: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """``profiles`` with their ``category`` set right by the catalogue, and ``validity``: valid, partial or invalid.

    ``catalogue``: ``category, discipline`` rows; without one only the fields are
    known and nothing is better than partial.  A category that isn't known becomes
    the mixed field, and its discipline's field where the catalogue has the discipline.
    A discipline of several fields belongs to the first by name.
    """
    known = trimmed(F.coalesce("category", F.lit("")))
    discipline = trimmed(F.col("discipline"))
    if catalogue is None:
        category = F.when(known.isin(CATEGORIES), known).otherwise(MIXED)
        return profiles.withColumns({"category": category, "validity": F.lit("partial")})
    rows = catalogue.select(trimmed(F.col("category")).alias("c"), trimmed(F.col("discipline")).alias("d")).where("length(c) > 0").distinct()
    fields = rows.select("c").distinct().agg(F.collect_set("c").alias("_fields"))  # a catalogue has tens of fields
    home = rows.where("length(d) > 0").groupBy("d").agg(F.min("c").alias("_home"), F.collect_set("c").alias("_of"))
    out = profiles.crossJoin(fields).withColumns({"_d": discipline, "_c": F.when(F.array_contains("_fields", known), known).otherwise(MIXED)})
    out = out.join(home, F.col("_d") == F.col("d"), "left")
    own = F.coalesce(F.array_contains("_of", F.col("_c")), F.lit(False))
    moved = ~own & (F.col("_c") == MIXED) & F.col("_home").isNotNull()
    out = out.withColumns({"category": F.when(moved, F.col("_home")).otherwise(F.col("_c")), "_ok": own | moved})
    validity = F.when(~F.array_contains("_fields", F.col("category")), "invalid").when(F.col("_ok"), "valid").otherwise("partial")
    return out.withColumn("validity", validity).drop("_fields", "_d", "_c", "d", "_home", "_of", "_ok")


def academic_strength(category: Column, discipline: Column, subfield: Column, paper_type: Column, validity: Column) -> Column:
    """0 to 1: how far a document counts as academic writing; a validity that isn't known counts as partial."""
    some = lambda c: F.coalesce(F.length(trimmed(c)) > 0, F.lit(False))
    academic = _holds(F.lower(paper_type), ACADEMIC_TYPES) | (trimmed(category).isin(CATEGORIES) & (some(discipline) | some(subfield)))
    strength = F.when(validity == "valid", 1.0).when(validity == "invalid", 0.0).otherwise(0.6)
    return F.when(F.coalesce(academic, F.lit(False)), strength).otherwise(0.0)


def profiles_of(docs: DataFrame, responses: DataFrame, catalogue: DataFrame | None = None, least: int = 200) -> DataFrame:
    """``doc_id, category, discipline, subfield, paper_type, summary, conventions, validity, academic`` from a profiler's responses (``doc_id, response``).

    Documents of fewer than ``least`` characters, responses that can't be read and
    those without a summary have no row; of several responses the least text holds.
    """
    one = responses.groupBy("doc_id").agg(F.min("response").alias("r"))
    rows = docs.where(F.length("text") >= least).select("doc_id").join(one, "doc_id").withColumn("j", F.from_json(json_of(F.col("r")), RESPONSE))
    some = lambda c: F.when(F.length(trimmed(c)) > 0, trimmed(c))
    rows = rows.where("j is not null and j._corrupt_record is null").select(
        "doc_id", trimmed(F.col("j.category")).alias("told"), some(F.col("j.discipline")).alias("discipline"), some(F.col("j.subfield")).alias("subfield"), some(F.col("j.paperType")).alias("paper_type"),
        some(F.col("j.summary")).alias("summary"), F.filter(F.transform(F.coalesce("j.conventions", F.expr("cast(array() as array<string>)")), trimmed), lambda c: F.length(c) > 0).alias("conventions"),
    ).where("summary is not null")
    rows = rows.withColumns({
        "category": field_of(F.col("told"), F.coalesce("discipline", "subfield")), "paper_type": F.coalesce("paper_type", F.when(names_paper_type(F.col("told")), F.col("told"))),
    }).drop("told")
    out = validated(rows, catalogue)
    return out.withColumn("academic", academic_strength(*[F.col(c) for c in ("category", "discipline", "subfield", "paper_type", "validity")]))
