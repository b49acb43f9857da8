"""`contextdocs` reads office files as pages and `contextmd` writes one named Markdown file for each
document, as data sources of Spark; `loom_pages` is the table function of the same parsers.

    sources.register(spark)
    spark.read.format("contextdocs").load("/in").where("suffix = '.docx'")
    select f.path, p.* from files f, lateral loom_pages(f.content, f.path) p

Files are listed once, on the driver, and dealt to partitions by their bytes; conditions on `suffix`,
and `like '%.docx'` on doc_id, choose among the listed files before any is opened.  Folders may be in any
store that pyarrow's file systems reach from driver and executors.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringEndsWith, WriterCommitMessage
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .office import items_of

_TABLE = StructType().add("headers", ArrayType(StringType())).add("rows", ArrayType(ArrayType(StringType()))).add("markdown_representation", StringType())
PAGES = (
    StructType().add("doc_id", StringType()).add("suffix", StringType()).add("page_number", IntegerType()).add("text_content", StringType())
    .add("tables", ArrayType(_TABLE)).add("error", StringType()).add("raw_size_bytes", LongType())
)
#: Bytes of files that a partition reads at most; a larger file has one of its own.
MOST_BYTES = 128 << 20

_MARKS = (("heading 1", "# "), ("heading 2", "## "), ("heading 3", "### "), ("list bullet", "- "), ("list number", "1. "))


def suffix_of(path: str) -> str:
    found = re.search(r"[^/\\](\.[^./\\]+)$", path)
    return found[1].lower() if found else ""


def _table(rows: list[list[str | None]]) -> dict:
    clean = [[(c or "").strip().replace("\n", " ") for c in r] for r in rows]
    line = lambda cells: f"| {' | '.join(cells)} |"
    shown = "\n".join([line(clean[0]), line(["---"] * len(clean[0])), *map(line, clean[1:])])
    return {"headers": clean[0], "rows": clean[1:], "markdown_representation": shown.strip(" ")}


def _shown(item: dict) -> str | None:
    kind, text = item["kind"], (item.get("text") or "").strip()
    if kind == "table":
        return _table(item["rows"])["markdown_representation"]
    if not text or kind in ("link", "found_table"):
        return None
    if kind == "paragraph":
        style = (item.get("style") or "").lower()
        return next((mark for name, mark in _MARKS if name in style), "") + text
    if kind == "bullet":
        level = item.get("level") or 0
        return f"{'  ' * level}- {text}" if level > 0 else text
    return {"slide": "## Slide ", "title": "### ", "notes": "\n> **Speaker Notes:** "}.get(kind, "") + text


def _linked(text: str, links: list[dict]) -> str:
    for link in links:
        label = (link["text"] or "").strip()
        mark = f"[{label}]({link['uri']})"
        if label and mark not in text:
            mention = label if label in text else (re.search(r"\s+".join(map(re.escape, label.split())), text) or [""])[0]
            text = text.replace(mention, mark, 1) if mention else text
    return text


def _meet(a: dict | None, b: dict | None) -> bool:
    side = lambda low, high: min(a[high], b[high]) > max(a[low], b[low])
    return bool(a and b) and side("x0", "x1") and side("y0", "y1")


def pages_of(path: str, content: bytes) -> Iterator[dict]:
    """The pages of a file, as dictionaries of PAGES; one with an error where it can't be read."""
    by_page: dict[int, list[dict]] = {}
    for item in items_of(path, content):
        by_page.setdefault(item["page"], []).append(item)
    for number, found in by_page.items():
        errors = [i["error"] for i in found if i.get("error")]
        found = [i for i in found if "kind" in i]
        links = [i for i in found if i["kind"] == "link"]
        texts = [_linked(s, [x for x in links if _meet(i.get("box"), x["box"])]) for i in found if (s := _shown(i)) is not None]
        tables = [_table(i["rows"]) for i in found if i["kind"] in ("table", "found_table") and i["rows"]]
        text = "\n\n".join(texts)
        yield {"doc_id": path, "suffix": suffix_of(path), "page_number": number, "text_content": text, "tables": tables, "error": max(errors, default=None), "raw_size_bytes": len(text.encode())}


class Files(InputPartition):
    """Files that one task reads."""

    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class PagesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.most = int(options.get("maxpartitionbytes", options.get("maxPartitionBytes", MOST_BYTES)))
        self.wanted: list[tuple[str, tuple[str, ...]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes conditions that the name of a file decides."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("suffix",) and isinstance(f, EqualTo):
                self.wanted.append(("is", (str(f.value),)))
            elif column == ("suffix",) and isinstance(f, In):
                self.wanted.append(("is", tuple(map(str, f.value))))
            elif column == ("doc_id",) and isinstance(f, StringEndsWith):
                self.wanted.append(("ends", (str(f.value),)))
            else:
                yield f

    def _chosen(self, path: str) -> bool:
        return all(suffix_of(path) in values if how == "is" else path.endswith(values) for how, values in self.wanted)

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        hidden = lambda p: any(part[:1] in ("_", ".") for part in p[len(root) :].split("/"))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path) and self._chosen(f.path))
        out, held, size = [], [], 0
        for path, n in files:
            if held and size + n > self.most:
                out.append(Files(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[Row]:
        store, root = fs.FileSystem.from_uri(self.root)
        before = "file:" if store.type_name == "local" else self.root[: self.root.index(root)]
        for path in partition.paths:
            with store.open_input_stream(path) as file:
                content = file.read()
            for page in pages_of(before + path, content):
                tables = [Row(**t) for t in page.pop("tables")]
                yield Row(**{k: page[k] for k in ("doc_id", "suffix", "page_number", "text_content")}, tables=tables, error=page["error"], raw_size_bytes=page["raw_size_bytes"])


class ContextDocs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "contextdocs"

    def schema(self) -> StructType:
        return PAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagesReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    """A task's folder below the staging folder, and its files."""

    folder: str
    files: int


class MarkdownWriter(DataSourceWriter):
    """Rows of (file_name, text) to files of these names.

    A task writes to a folder of its own attempt below `_temporary/<job>`; the commit moves each
    task's folder to its place by one rename and then writes `_SUCCESS`, and an abort removes what the
    job has staged.  A task that dies, or a job that does, leaves no file in place."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.root, self.overwrite = options["path"], overwrite
        self.job = uuid.uuid4().hex[:12]

    def _staged(self) -> tuple[fs.FileSystem, str, str]:
        store, root = fs.FileSystem.from_uri(self.root)
        return store, root, f"{root}/_temporary/{self.job}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, _, staged = self._staged()
        context = TaskContext.get()
        folder = f"part-{context.partitionId():05d}-{self.job}"
        attempt = f"{staged}/{context.taskAttemptId()}/{folder}"
        n = 0
        for row in iterator:
            if not n:
                store.create_dir(attempt, recursive=True)
            with store.open_output_stream(f"{attempt}/{row.file_name}") as out:
                out.write((row.text or "").encode())
            n += 1
        return Written(f"{context.taskAttemptId()}/{folder}" if n else "", n)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        store, root, staged = self._staged()
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.type == fs.FileType.Directory and old.base_name.startswith("part-"):
                    store.delete_dir(old.path)
        for m in messages:
            if m is not None and m.folder:
                store.move(f"{staged}/{m.folder}", f"{root}/{m.folder.rpartition('/')[2]}")
        self._cleared(store, root, staged)
        store.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        self._cleared(*self._staged())

    @staticmethod
    def _cleared(store: fs.FileSystem, root: str, staged: str) -> None:
        for folder, others in ((staged, False), (f"{root}/_temporary", True)):
            found = store.get_file_info(folder).type == fs.FileType.Directory
            if found and not (others and store.get_file_info(fs.FileSelector(folder))):
                store.delete_dir(folder)


class ContextMarkdown(DataSource):
    @classmethod
    def name(cls) -> str:
        return "contextmd"

    def schema(self) -> str:
        return "file_name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if schema.names != ["file_name", "text"]:
            raise ValueError("contextmd writes the columns file_name and text")
        return MarkdownWriter(dict(self.options), overwrite)


class Pages:
    """loom_pages(content, path): the pages of a file by the reader for the path's suffix; with
    `with_tables => true` their tables, too."""

    @staticmethod
    def analyze(content: AnalyzeArgument, path: AnalyzeArgument, with_tables: AnalyzeArgument | None = None) -> AnalyzeResult:
        names = ["page_number", "text_content", *(["tables"] if with_tables is not None and with_tables.value else []), "error", "raw_size_bytes"]
        return AnalyzeResult(StructType([PAGES[n] for n in names]))

    def eval(self, content: bytes, path: str, with_tables: bool | None = None) -> Iterator[tuple]:
        for page in pages_of(path or "", bytes(content or b"")):
            tables = ([tuple(t.values()) for t in page["tables"]],) if with_tables else ()
            yield (page["page_number"], page["text_content"], *tables, page["error"], page["raw_size_bytes"])


def register(spark: SparkSession) -> None:
    """Makes the formats and the table function known to the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContextDocs)
    spark.dataSource.register(ContextMarkdown)
    spark.udtf.register("loom_pages", udtf(Pages))
