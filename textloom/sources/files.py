"""Reading documents from files, and writing results.

Text, Word and (where a library is installed) PDF files become ``path, text``;
a file that can't be read gets a null text and an ``error``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions.text import percent

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Parts of a Word file that hold no running text, and the pattern of captions below (fixed values).
_SKIPPED = {_W + x for x in ("tbl", "drawing", "pict", "object", "txbxContent")}


def decode(data: bytes) -> str:
    """UTF-8, else GBK, else Latin-1."""
    for encoding in ("utf-8", "gbk", "latin-1"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "ignore")


def docx_paragraphs(data: bytes) -> list[str]:
    """Paragraph texts of a Word file's body, without tables and drawings."""

    def words(node: ElementTree.Element) -> Iterator[str]:
        for child in node:
            if child.tag in _SKIPPED:
                continue
            if child.tag == _W + "t":
                yield child.text or ""
            else:
                yield from words(child)
            if child.tag == _W + "p":
                yield "\n"

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return [p.strip() for p in "".join(words(root)).split("\n") if p.strip()]


def is_layout(paragraph: str) -> bool:
    """Captions, figures and symbols that aren't text of a document."""
    n = len(paragraph)
    digits = sum("0" <= c <= "9" for c in paragraph) / n
    stop = paragraph[-1] in "。！？.!?"
    return bool(re.match(r"(图|表|Figure|Fig\.|Table)\s*\d+", paragraph)) or digits > 0.6 or (n < 25 and not stop and digits > 0.3) or (n < 50 and sum(map(str.isalpha, paragraph)) / n < 0.1)


def docx_text(data: bytes, least: int = 100) -> str:
    """A Word file's text in blocks of at least ``least`` characters, blank lines between."""
    blocks, held = [], ""
    for p in docx_paragraphs(data):
        if is_layout(p):
            continue
        held = f"{held}\n{p}" if held else p
        if len(held) >= least:
            blocks.append(held)
            held = ""
    if held:
        blocks.append(held)
    return "\n\n".join(blocks)


def pdf_text(data: bytes) -> str:
    try:
        import pypdf
    except ImportError as e:
        raise ValueError("no PDF library is installed") from e
    pages = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages]
    return "\n".join(x.strip() for x in "\n".join(pages).split("\n") if x.strip())


def extract(name: str, data: bytes) -> str:
    """A file's text, by its extension; unknown ones are read as UTF-8, broken bytes left out."""
    kind = name.lower().rsplit(".", 1)[-1]
    if kind in ("txt", "md"):
        return decode(data)
    if kind == "docx":
        return docx_text(data)
    if kind == "pdf":
        return pdf_text(data)
    return data.decode("utf-8", "ignore")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, text, error`` of every file under ``path``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, data in frame.itertuples(index=False):
                try:
                    rows.append((name, extract(name, bytes(data)), None))
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((name, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def reports(documents: DataFrame, segments: DataFrame, dual: DataFrame | None = None) -> DataFrame:
    """``doc_id, report``: one JSON object a document with its ``aggregation``, its ``segments`` in order and, where given, its ``dualDetection``.

    ``documents`` and ``dual`` have one row a document; a document without segments has an empty list.
    """
    packed = lambda rows, name: rows.select("doc_id", F.struct(*[c for c in rows.columns if c != "doc_id"]).alias(name))
    item = F.struct("chunk_id", *[c for c in segments.columns if c not in ("doc_id", "chunk_id")])
    lists = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("segments"))
    rows = packed(documents, "aggregation").join(lists, "doc_id", "left")
    parts = ["aggregation", F.coalesce("segments", F.from_json(F.lit("[]"), lists.schema["segments"].dataType)).alias("segments")]
    if dual is not None:
        rows = rows.join(packed(dual, "dualDetection"), "doc_id", "left")
        parts.append("dualDetection")
    return rows.select("doc_id", F.to_json(F.struct(*parts)).alias("report"))


def batch_rows(documents: DataFrame) -> DataFrame:
    """What the archived implementation writes as a table of a batch."""
    return documents.select(F.col("doc_id").alias("id"), F.col("overall_probability").alias("probability"), F.col("overall_confidence").alias("confidence"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def segment_rows(segments: DataFrame) -> DataFrame:
    """Segments as the report shows them, probabilities in percent."""
    p = lambda c: percent(F.col(c)).alias(c)
    return segments.select("doc_id", F.col("chunk_id").alias("id"), p("raw_probability"), p("confidence"), p("uncertainty"), "decision")


def legacy_rows(segments: DataFrame) -> DataFrame:
    return segments.select(F.col("chunk_id").alias("chunkId"), F.col("raw_probability").alias("probability"), "confidence", "ttr", F.col("avg_sentence_len").alias("avgSentenceLen"), "ppl")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
