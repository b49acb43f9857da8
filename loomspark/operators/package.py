"""From files or pages to context packages: one row for each document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pytext import WS, let, strip, text
from ..functions.tokens import count_tokens, savings
from .chunk import MAX_WORDS, with_chunks
from .compress import compressed
from .entities import entities
from .external import Limits, called

# File types by suffix; images need a reader that the caller brings.
LOCAL_FORMATS, IMAGE_FORMATS = (".pdf", ".docx", ".pptx"), (".png", ".jpg", ".jpeg", ".webp")
PAGE_JOIN = "\n\n---\n\n"


@dataclass(frozen=True)
class Options:
    use_ai: bool = False
    chunk_size: int = MAX_WORDS
    target_model: str = "gpt-4"
    extract_entities: bool = True
    deduplicate_boilerplate: bool = True


#: The short demonstration settings.
DEMO = Options(chunk_size=100)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))


def dispatch(df: DataFrame, path: str = "path", n_bytes: str = "n_bytes", options: Options = Options()) -> DataFrame:
    """Adds file_type, reader (local, ai or null), status and error; no row is dropped."""
    kind = suffix(F.col(path))
    known = kind.isin(*LOCAL_FORMATS, *IMAGE_FORMATS)
    ai = F.lit(options.use_ai) | kind.isin(*IMAGE_FORMATS)
    bad, empty = ~known, known & (F.col(n_bytes) == 0)
    formats = ", ".join((*LOCAL_FORMATS, *IMAGE_FORMATS))
    error = F.when(bad, F.concat(F.lit("Unsupported format: '"), kind, F.lit(f"'. Supported formats: {formats}"))).when(empty, "Uploaded file is empty.")
    return df.withColumns({
        "file_type": kind, "reader": F.when(bad | empty, F.lit(None).cast("string")).when(ai, "ai").otherwise("local"),
        "status": F.when(bad | empty, 400).otherwise(200), "error": error,
    })


def joined_pages(pages: DataFrame, key: str = "doc_id", separator: str = PAGE_JOIN) -> DataFrame:
    """(key, markdown): the texts of a document's pages in order of page_number."""
    listed = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text_content", F.lit("")).alias("t")))).alias("p"))
    return listed.select(key, F.array_join(F.transform("p", lambda p: p["t"]), separator).alias("markdown"))


def gfm_table(headers: Column, rows: Column) -> Column:
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.transform(headers, lambda _: F.lit("---"))
    return F.trim(F.array_join(F.concat(F.array(line(headers), line(rule)), F.transform(rows, line)), "\n"))


def block_column(x0: Column, x1: Column, page_width: Column) -> Column:
    """0: the left column or full width; 1: the right one."""
    return F.when(x1 - x0 > page_width * 0.7, 0).when(x0 > page_width * 0.45, 1).otherwise(0)


def linked(t: Column, links: Column) -> Column:
    """The text with the first mention of each link's text (array of struct: text, uri) made a
    Markdown link, white space in it matched loosely; a link that is there already is not repeated."""

    def one(so_far: Column, link: Column) -> Column:
        label = strip(text(link["text"]))
        mark = F.concat(F.lit("["), label, F.lit("]("), link["uri"], F.lit(")"))
        loose = F.array_join(F.transform(F.split(label, f"{WS}+", -1), lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), f"{WS}+")
        mention = F.coalesce(F.when(F.contains(so_far, label), label).otherwise(F.regexp_substr(so_far, loose)), F.lit(""))

        def put(m: Column) -> Column:
            at = F.instr(so_far, m)
            return F.concat(F.substring(so_far, F.lit(1), at - 1), mark, F.substring(so_far, at + F.length(m), F.length(so_far)))

        nothing = (label == "") | F.coalesce(F.contains(so_far, mark), F.lit(True))
        return F.when(nothing, so_far).otherwise(let(mention, lambda m: F.when(m == "", so_far).otherwise(put(m))))

    return F.aggregate(links, t, one)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes (x0, y0, x1, y1) have an area in common."""
    side = lambda low, high: F.least(a[high], b[high]) > F.greatest(a[low], b[low])
    return side("x0", "x1") & side("y0", "y1")


def pages_of_blocks(blocks: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_number, text_content): text blocks in reading order, joined by a blank line.

    `links` (doc_id, page_number, link_no, x0, y0, x1, y1, text, uri) go into the blocks that
    they lie on, in order of link_no; blocks need y1 for that.
    """
    key, box = ["doc_id", "page_number"], ["x0", "y0", "x1", "y1"]
    place = F.struct(block_column(F.col("x0"), F.col("x1"), F.col("page_width")).alias("column"), "y0", "block_no", strip(text(F.col("text"))).alias("t"), *(["x0", "x1", "y1"] if links is not None else []))
    listed = blocks.where("block_type = 0").groupBy(*key).agg(F.array_sort(F.collect_list(place)).alias("b"))
    shown = F.transform("b", lambda b: b["t"])
    if links is not None:
        on_page = links.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("link_no", *box, "text", "uri"))).alias("l"))
        none = F.array().cast(on_page.schema["l"].dataType)
        listed = listed.join(on_page, key, "left").withColumn("l", F.coalesce("l", none))
        shown = F.transform("b", lambda b: linked(b["t"], F.filter("l", lambda x: overlaps(b, x))))
    return listed.select(*key, F.array_join(F.filter(shown, lambda t: t != ""), "\n\n").alias("text_content"))


def found_table(rows: Column) -> Column:
    """headers, rows and markdown_representation of a table found on a page: its first row is
    the header, line ends become blanks, null is an empty cell."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.replace(strip(text(c)), F.lit("\n"), F.lit(" "))))

    def parts(cells: Column) -> Column:
        head, body = F.get(cells, 0), F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))
        return F.struct(head.alias("headers"), body.alias("rows"), gfm_table(head, body).alias("markdown_representation"))

    return F.when(F.size(rows) > 0, let(clean, parts))


def normalize(df: DataFrame, name: str = "document_name", markdown: str = "markdown_raw", raw_bytes: str = "raw_bytes", options: Options = Options(), exact: bool = False) -> DataFrame:
    """Adds metadata, full_markdown, chunks, entities and metrics to documents' Markdown."""
    out = df.withColumn("full_markdown", compressed(F.col(markdown), options.deduplicate_boilerplate))
    out = with_chunks(out, "full_markdown", options.chunk_size)
    none = F.array().cast("array<struct<name:string,category:string,context:string>>")
    out = out.withColumn("entities", entities(F.col("full_markdown")) if options.extract_entities else none)
    raw = F.floor(F.col(raw_bytes) / 2).cast("long")
    out = out.withColumn("_tokens", count_tokens(F.col("full_markdown"), options.target_model))  # words are counted once
    m = savings(raw, F.col("_tokens"), options.target_model, exact)
    metrics = F.struct(m["raw_tokens"].alias("raw_tokens_estimate"), m["markdown_tokens"].alias("compressed_tokens"), m["tokens_saved"].alias("tokens_saved"), m["savings_percentage"].alias("savings_percentage"), m["dollars_saved"].alias("dollars_saved"))
    meta = F.create_map(F.lit("file_type"), suffix(F.col(name)), F.lit("use_ai_ocr"), F.lit(str(options.use_ai)), F.lit("target_model"), F.lit(options.target_model))
    return out.withColumns({"metadata": meta, "metrics": metrics}).drop("_tokens")


def with_reader(files: DataFrame, read: Callable[[bytes, str], str], limits: Limits = Limits()) -> DataFrame:
    """Adds markdown_raw by a callable of the caller's, such as an OCR service, for rows that
    `dispatch` gave to the "ai" reader, and for no other.  What it raises becomes the row's error:
    status 400 for a ValueError, else 500.  markdown_raw of other rows stays as it is."""
    before = F.col("markdown_raw") if "markdown_raw" in files.columns else F.lit(None).cast("string")
    done = called(files, F.col("reader") == "ai", ["content", "path"], lambda: lambda content, path: read(bytes(content), path), "_r", limits)
    mine = F.col("_r").isNotNull()
    return done.withColumns({
        "markdown_raw": F.when(mine, F.col("_r.value")).otherwise(before), "status": F.when(mine, F.col("_r.status")).otherwise(F.col("status")),
        "error": F.when(mine, F.col("_r.error")).otherwise(F.col("error")),
    }).drop("_r")


def engine_info(spark: SparkSession) -> DataFrame:
    formats = F.array(*[F.lit(f) for f in (*LOCAL_FORMATS, *IMAGE_FORMATS)])
    return spark.range(1).select(F.lit("healthy").alias("status"), F.lit("loomspark").alias("engine"), formats.alias("supported_formats"))
