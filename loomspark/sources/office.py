"""DOCX, PPTX and PDF files to pages of Markdown, read by Spark and parsed in tasks.

The parsers give plain rows of what a file holds (paragraphs, cells); what becomes of them
is decided by column expressions.  PDF needs a library the caller has installed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pytext import strip
from ..operators.package import found_table, linked, overlaps
from .parts import docx_items, pptx_items

ITEMS = "path string, page int, ord int, kind string, style string, level int, text string, rows array<array<string>>, box struct<x0:double,y0:double,x1:double,y1:double>, uri string, error string"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content and n_bytes of every file; Spark leaves empty files out, `contextdocs` has them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.col("length").alias("n_bytes"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of plain text or Markdown files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def pdf_items(content: bytes) -> Iterator[dict]:
    """By page: text blocks in reading order, links and tables, in the library's own geometry, as
    a caller's environment has it."""
    import fitz  # not a dependency: the row says so where it is missing

    box = lambda r: dict(zip(("x0", "y0", "x1", "y1"), map(float, r[:4]), strict=True))
    with fitz.open(stream=content, filetype="pdf") as doc:
        for n, page in enumerate(doc, 1):
            wide = page.rect.width
            side = lambda b, wide=wide: 0 if b[2] - b[0] > 0.7 * wide else int(b[0] > 0.45 * wide)
            for b in sorted((b for b in page.get_text("blocks") if b[6] == 0), key=lambda b: (side(b), b[1])):
                yield {"page": n, "kind": "block", "text": b[4], "box": box(b)}
            for link in page.get_links():
                if link.get("kind") == fitz.LINK_URI and "uri" in link:
                    yield {"page": n, "kind": "link", "text": page.get_text("text", clip=fitz.Rect(link["from"])), "uri": link["uri"], "box": box(link["from"])}
            for t in page.find_tables():
                yield {"page": n, "kind": "found_table", "rows": t.extract()}


_READERS = {".docx": docx_items, ".pptx": pptx_items, ".pdf": pdf_items}


def items_of(path: str, content: bytes) -> list[dict]:
    """What a file holds; one that can't be read has one item with its error."""
    reader = _READERS.get("." + path.rpartition(".")[2].lower())
    try:
        if reader is None:
            raise ValueError("no local reader for this file type")
        return [dict(r, path=path, ord=k) for k, r in enumerate(reader(content))]
    except Exception as e:  # the row fails, not the job
        return [{"path": path, "page": 1, "ord": 0, "error": f"{type(e).__name__}: {e}"}]


def items(files: DataFrame) -> DataFrame:
    """What the files hold, a row for each item."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ITEMS.split(", ")]
        for f in frames:
            for path, content in zip(f.path, f.content, strict=True):
                yield pd.DataFrame(items_of(path, bytes(content))).reindex(columns=names).astype({"page": "Int32", "ord": "Int32", "level": "Int32"}).replace({float("nan"): None})

    return files.select("path", "content").mapInPandas(parse, ITEMS)


def _shown(kind: Column, style: Column, level: Column, text: Column, rows: Column) -> Column:
    t, s = strip(text), F.lower(F.coalesce(style, F.lit("")))
    marks = F.lit("")
    for name, mark in reversed((("heading 1", "# "), ("heading 2", "## "), ("heading 3", "### "), ("list bullet", "- "), ("list number", "1. "))):
        marks = F.when(F.contains(s, F.lit(name)), mark).otherwise(marks)
    table = found_table(rows)["markdown_representation"]
    indent = F.when(level > 0, F.concat(F.expr("repeat('  ', level)"), F.lit("- "), t)).otherwise(t)
    full = (
        F.when(kind == "slide", F.concat(F.lit("## Slide "), t)).when(kind == "title", F.concat(F.lit("### "), t)).when(kind == "bullet", indent)
        .when(kind == "notes", F.concat(F.lit("\n> **Speaker Notes:** "), t)).when(kind == "paragraph", F.concat(marks, t)).otherwise(t)
    )
    return F.when(kind == "table", table).when(t != "", full)


def pages(found: DataFrame) -> DataFrame:
    """doc_id (the path), page_number, text_content, tables, raw_size_bytes and error of every
    page.  Links go into the blocks that they lie on; tables that were found on a page beside
    its text stay apart from it, those of a Word file are in both."""
    some = lambda test, *fields: F.array_sort(F.collect_list(F.when(test, F.struct(*fields))))
    kind = F.col("kind")
    shown = found.withColumn("shown", _shown(kind, F.col("style"), F.col("level"), F.col("text"), F.col("rows")))
    listed = shown.groupBy("path", "page").agg(
        some(F.col("shown").isNotNull() & ~kind.isin("link", "found_table"), "ord", "shown", "box").alias("s"),
        some(kind == "link", "ord", "text", "uri", "box").alias("l"),
        some(kind.isin("table", "found_table") & (F.size("rows") > 0), "ord", "rows").alias("t"), F.max("error").alias("error"),
    )
    texts = F.transform("s", lambda s: linked(s["shown"], F.filter("l", lambda x: F.coalesce(overlaps(s["box"], x["box"]), F.lit(False)))))
    tables = F.transform("t", lambda t: found_table(t["rows"]))
    out = listed.select(F.col("path").alias("doc_id"), F.col("page").alias("page_number"), F.array_join(texts, "\n\n").alias("text_content"), tables.alias("tables"), "error")
    return out.withColumn("raw_size_bytes", F.octet_length("text_content").cast("long"))
