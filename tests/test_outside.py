"""Files and services outside of Spark: packages and their parts, data sources, external calls."""

from __future__ import annotations

import io
import json
import os
import zipfile

import pytest
from loomspark.operators import package, prompt
from loomspark.operators.external import Limits, called
from loomspark.sources import datasource, office, parts, sinks
from pyspark.sql import functions as F

W, A, P = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in files.items():
            z.writestr(name, xml)
    return out.getvalue()


def rels(*found: tuple[str, str, str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{R}/{kind}" Target="{target}"/>' for i, kind, target in found) + "</Relationships>"


def slide(*shapes: str) -> str:
    return f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{"".join(shapes)}</p:spTree></p:cSld></p:sld>'


def shape(text: str, ph: str = "") -> str:
    return f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>{text}</p:txBody></p:sp>"


def par(text: str, level: int = 0) -> str:
    return f'<a:p><a:pPr lvl="{level}"/><a:r><a:t>{text}</a:t></a:r></a:p>'


TITLE, BODY = '<p:ph type="title"/>', '<p:ph type="body" idx="1"/>'


def deck(order: list[int], folder: str = "ppt/slides", **more: str) -> bytes:
    """Slides 1, 3 and 7, listed in the order given; their file names mean nothing."""
    slides = {k: slide(shape(par(f"Head {k}"), TITLE), shape(par("top") + par("below", 1), BODY)) for k in (1, 3, 7)}
    listed = "".join(f'<p:sldId id="{256 + k}" r:id="rId{k}"/>' for k in order)
    files = {f"{folder}/slide{k}.xml": xml for k, xml in slides.items()}
    return zipped({
        "_rels/.rels": rels(("rId1", "officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst>{listed}</p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(*((f"rId{k}", "slide", f"/{folder}/slide{k}.xml") for k in (1, 3, 7))), **files, **more,
    })


def test_slides_come_in_the_order_of_the_presentation():
    titles = lambda content: [(i["page"], i["text"]) for i in parts.pptx_items(content) if i["kind"] == "title"]
    assert titles(deck([1, 3, 7])) == [(1, "Head 1"), (2, "Head 3"), (3, "Head 7")]
    assert titles(deck([7, 1, 3])) == [(1, "Head 7"), (2, "Head 1"), (3, "Head 3")]
    assert titles(deck([3], folder="ppt/other")) == [(1, "Head 3")] and titles(deck([])) == []
    with pytest.raises(ValueError, match="rId9"):
        titles(deck([1, 9]))
    bare = zipped({"ppt/slides/slide10.xml": slide(shape(par("ten"), TITLE)), "ppt/slides/slide2.xml": slide(shape(par("two"), TITLE))})
    assert titles(bare) == [(1, "two"), (2, "ten")]


def test_notes_breaks_fields_and_groups_of_a_slide():
    broken = "<a:p><a:r><a:t>one</a:t></a:r><a:br/><a:fld><a:t>2</a:t></a:fld></a:p>"
    group = f"<p:grpSp>{shape(par('in a group'))}</p:grpSp>"
    note = slide(shape(par("no"), '<p:ph type="sldNum" idx="5"/>'), shape(par("say it") + par("twice"), BODY))
    content = zipped({
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId r:id="a"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("a", "slide", "slides/x.xml")), "ppt/slides/x.xml": slide(group, shape(broken), shape(par("Head"), '<p:ph type="ctrTitle"/>')),
        "ppt/slides/_rels/x.xml.rels": rels(("n", "notesSlide", "../notes/first.xml")), "ppt/notes/first.xml": note,
    })
    assert [(i["kind"], i["text"]) for i in parts.pptx_items(content)] == [("slide", "1"), ("title", "Head"), ("bullet", "one\v2"), ("notes", "say it\ntwice")]


def word(body: str, **more: str) -> bytes:
    return zipped({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>', **more})


def wp(inner: str, style: str = "") -> str:
    return f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}{inner}</w:p>"


def run(text: str) -> str:
    return f"<w:r><w:t>{text}</w:t></w:r>"


def test_tabs_breaks_and_links_of_a_word_file():
    runs = "<w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t><w:br w:type='page'/><w:noBreakHyphen/><w:cr/></w:r>"
    body = wp(runs + f"<w:hyperlink>{run('link')}</w:hyperlink><w:del><w:r><w:delText>gone</w:delText></w:r></w:del>")
    assert [i["text"] for i in parts.docx_items(word(body)) if i["kind"] == "paragraph"] == ["a\tb\nc-\nlink"]


def test_merged_cells_and_a_main_part_of_another_name():
    cell = lambda t, pr="": f"<w:tc>{f'<w:tcPr>{pr}</w:tcPr>' if pr else ''}{wp(run(t))}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('wide', '<w:gridSpan w:val=%s2%s/>' % (chr(34), chr(34)))}{cell('x', '<w:vMerge w:val=%srestart%s/>' % (chr(34), chr(34)))}</w:tr><w:tr>{cell('a')}{cell('b')}{cell('', '<w:vMerge/>')}</w:tr></w:tbl>"
    content = zipped({
        "_rels/.rels": rels(("r1", "officeDocument", "/doc/main.xml")), "doc/main.xml": f'<w:document xmlns:w="{W}"><w:body>{wp(run("T"), "S1")}{table}</w:body></w:document>',
        "doc/_rels/main.xml.rels": rels(("s", "styles", "look.xml")), "doc/look.xml": f'<w:styles xmlns:w="{W}"><w:style w:styleId="S1"><w:name w:val="Heading 2"/></w:style></w:styles>',
    })
    items = list(parts.docx_items(content))
    assert items[1]["style"] == "Heading 2" and items[2]["rows"] == [["wide", "wide", "x"], ["a", "b", "x"]]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "sub").mkdir()
    table = "<w:tbl><w:tr><w:tc>" + wp(run("k")) + "</w:tc></w:tr><w:tr><w:tc>" + wp(run("v")) + "</w:tc></w:tr></w:tbl>"
    styles = f'<w:styles xmlns:w="{W}"><w:style w:styleId="H"><w:name w:val="heading 1"/></w:style><w:style w:styleId="L"><w:name w:val="List Bullet"/></w:style></w:styles>'
    content = {
        "a.docx": word(wp(run("Title "), "H") + table + wp(run("item"), "L") + wp("") + wp(run("tab\there")), **{"word/styles.xml": styles}),
        "empty.docx": word(""), "sub/deck.PPTX": deck([7, 1]), "bad.docx": b"no zip", "c.pdf": b"%PDF", "note.txt": b"text", "none": b" ", "lost.pptx": deck([1, 9]),
    }
    for name, data in content.items():
        (root / name).write_bytes(data)
    return str(root)


COLUMNS = ["doc_id", "page_number", "text_content", "tables", "error", "raw_size_bytes"]


def rows(df) -> list:
    return sorted(map(repr, df.select(COLUMNS).collect()))


def test_no_file_is_lost(spark, files):
    found = {(r.doc_id.rpartition("/")[2], r.page_number): r for r in office.pages(office.items(office.read_files(spark, files))).collect()}
    assert found["a.docx", 1].text_content == "# Title\n\n- item\n\ntab\there\n\n| k |\n| --- |\n| v |"
    assert [t.rows for t in found["a.docx", 1].tables] == [[["v"]]] and found["empty.docx", 1].text_content == "" and found["empty.docx", 1].error is None
    assert found["deck.PPTX", 1].text_content == "## Slide 1\n\n### Head 7\n\ntop\n\n  - below" and found["deck.PPTX", 2].text_content.startswith("## Slide 2\n\n### Head 1")
    assert "rId9" in found["lost.pptx", 1].error and len({d for d, _ in found}) == 8


def test_source_equals_the_dataframe(spark, files):
    datasource.register(spark)
    read = spark.read.format("contextdocs").load(files)
    assert rows(read) == rows(office.pages(office.items(office.read_files(spark, files))))
    assert {r.suffix for r in read.select("suffix").collect()} == {".docx", ".pptx", ".pdf", ".txt", ""}
    assert spark.read.format("contextdocs").load(f"{files}/a.docx").count() == 1


def test_source_plans_by_bytes_and_by_suffix(spark, files, tmp_path):
    datasource.register(spark)
    small = spark.read.format("contextdocs").option("maxPartitionBytes", 1).load(files)
    assert small.rdd.getNumPartitions() == 8 and spark.read.format("contextdocs").load(files).rdd.getNumPartitions() == 1
    docx = small.where("suffix = '.docx'")
    assert docx.rdd.getNumPartitions() == 3 and docx.count() == 3
    assert small.where("suffix in ('.pptx', '.pdf') and doc_id like '%.pdf'").rdd.getNumPartitions() == 1
    assert small.where("suffix = '.docx' and error is null").count() == 2
    assert spark.read.format("contextdocs").load(str(tmp_path)).count() == 0


def test_table_function_equals_the_dataframe(spark, files):
    datasource.register(spark)
    office.read_files(spark, files).createOrReplaceTempView("loom_files")
    got = spark.sql("select f.path as doc_id, p.* from loom_files f, lateral loom_pages(f.content, f.path, with_tables => true) p")
    assert rows(got) == rows(office.pages(office.items(office.read_files(spark, files))))
    assert spark.sql("select p.* from loom_files f, lateral loom_pages(f.content, f.path) p").columns == ["page_number", "text_content", "error", "raw_size_bytes"]


def test_python_pages_put_links_where_columns_put_them(spark, monkeypatch):
    box = {"x0": 0.0, "y0": 0.0, "x1": 9.0, "y1": 9.0}
    found = [{"page": 1, "kind": "block", "text": "See our\nsite, our site.\n", "box": box}, {"page": 1, "kind": "link", "text": "our site", "uri": "https://a", "box": box}]
    found += [{"page": 1, "kind": "link", "text": "See  our", "uri": "https://b", "box": box}, {"page": 1, "kind": "link", "text": "far", "uri": "https://c", "box": {k: v + 50 for k, v in box.items()}}]
    monkeypatch.setitem(office._READERS, ".pdf", lambda content: iter(found))
    [page] = datasource.pages_of("x.pdf", b"")
    items = spark.createDataFrame([json.loads(json.dumps({**i, "path": "x.pdf", "ord": k})) for k, i in enumerate(found)], office.ITEMS)
    assert page["text_content"] == office.pages(items).first().text_content == "[See  our](https://b)\nsite, [our site](https://a)."


def written(root) -> dict[str, str]:
    return {p.name: p.read_text() for p in root.rglob("*.md")}


def test_sink_writes_one_named_file_for_each_document(spark, tmp_path):
    names = [("a/b.docx", "x"), ("..", "dots"), ("same", "one"), ("same", "two"), ("same", "two"), (None, "no name"), ("", None), ("plus + blank", "p"), ("n" * 300, "long"), ("é:?*", "odd")]
    sinks.write_markdown_files(spark.createDataFrame(names, "document_name string, full_markdown string").repartition(3), f"{tmp_path}/md")
    got = written(tmp_path / "md")
    assert got["a%2Fb.docx.md"] == "x" and got["...md"] == "dots" and got["plus %2B blank.md"] == "p" and got["%C3%A9%3A%3F*.md"] == "odd"
    assert sorted(v for k, v in got.items() if k.startswith("same~")) == ["one", "two"] and "same.md" not in got
    assert sorted(v for k, v in got.items() if k.startswith("untitled~")) == ["", "no name"] and [v for k, v in got.items() if k.startswith("nnn")] == ["long"]
    assert not (tmp_path / "md" / "_temporary").exists() and (tmp_path / "md" / "_SUCCESS").exists()
    assert all(p.name.startswith("part-") for p in (tmp_path / "md").iterdir() if p.is_dir())
    one = spark.createDataFrame([("z", "1")], "document_name string, full_markdown string")
    sinks.write_markdown_files(one, f"{tmp_path}/md")
    assert len(written(tmp_path / "md")) == len(got) + 1
    sinks.write_markdown_files(one, f"{tmp_path}/md", mode="overwrite")
    assert written(tmp_path / "md") == {"z.md": "1"}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    datasource.register(spark)

    def dies(frames):
        for f in frames:
            yield f
        if (f.file_name == "last.md").any():
            os._exit(1)

    rows = spark.createDataFrame([(f"{k}.md", "x") for k in range(5)] + [("last.md", "x")], "file_name string, text string").repartition(2)
    with pytest.raises(Exception):
        rows.mapInPandas(dies, rows.schema).write.format("contextmd").mode("append").save(f"{tmp_path}/md")
    assert not list((tmp_path / "md").rglob("*")) if (tmp_path / "md").exists() else True


def test_only_due_rows_are_called(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def connect():
        (log / f"client-{os.urandom(6).hex()}").touch()

        def call(content, path):
            (log / f"call-{path.rpartition('/')[2]}-{os.urandom(6).hex()}").touch()
            if path.endswith("q.png"):
                raise ValueError("unreadable")
            if path.endswith("slow.png") and len(list(log.glob("call-slow.png-*"))) < 2:
                raise TimeoutError("busy")
            if path.endswith("down.webp"):
                raise OSError("no answer")
            return bytes(content).decode() * 2

        return call

    paths = ["p.png", "q.png", "slow.png", "down.webp", "x.exe", "d.docx", "e.pdf", "empty.png"]
    df = spark.createDataFrame([(f"/a/{p}", bytearray(b"" if p == "empty.png" else b"hi"), 0 if p == "empty.png" else 2) for p in paths], "path string, content binary, n_bytes long").repartition(2)
    got = called(package.dispatch(df), F.col("reader") == "ai", ["content", "path"], connect, limits=Limits(tries=2, wait=0.0))
    rows = {r.path[3:]: r.result for r in got.collect()}
    assert tuple(rows["p.png"]) == ("hihi", None, 200, 1) and tuple(rows["q.png"]) == (None, "unreadable", 400, 1)
    assert tuple(rows["slow.png"]) == ("hihi", None, 200, 2) and tuple(rows["down.webp"]) == (None, "no answer", 500, 2)
    assert all(rows[p] is None for p in ("x.exe", "d.docx", "e.pdf", "empty.png"))
    calls = [p.name.split("-")[1] for p in log.glob("call-*")]
    assert sorted(calls) == ["down.webp", "down.webp", "p.png", "q.png", "slow.png", "slow.png"] and 1 <= len(list(log.glob("client-*"))) <= 2


def test_a_reader_keeps_the_markdown_of_other_rows(spark):
    df = spark.createDataFrame([("/a/p.png", bytearray(b"hi"), 2, None), ("/a/d.docx", bytearray(b"hi"), 2, "local text")], "path string, content binary, n_bytes long, markdown_raw string")
    rows = {r.path: (r.markdown_raw, r.status, r.error) for r in package.with_reader(package.dispatch(df), lambda content, path: content.decode()).collect()}
    assert rows == {"/a/p.png": ("hi", 200, None), "/a/d.docx": ("local text", 200, None)}


def test_a_service_rewrites_prompts_that_are_not_blank(spark):
    def service(text):
        if "Fail" in text:
            raise RuntimeError("down")
        return None if "nothing" in text else "  " if "Blank" in text else f"\n New: {text} \n\n"

    df = spark.createDataFrame([("please do it",), ("fail now",), ("say nothing",), ("blank it",), (" ",), (None,)], "prompt string")
    got = {r.prompt: (r.optimized, r.techniques[-1:]) for r in prompt.optimize_prompts(df, service=service, limits=Limits(tries=1)).collect()}
    label = [prompt.rules.REWRITTEN]
    assert got["please do it"] == ("New: Do it", label) and got[" "] == ("", []) and got[None] == ("", [])
    assert got["fail now"][0] == "Fail now" and got["say nothing"][0] == "Say nothing" and got["blank it"][0] == "Blank it"
    assert all(got[p][1] != label for p in ("fail now", "say nothing", "blank it"))


def test_a_column_rewrite_is_stripped(spark):
    df = spark.createDataFrame([("do it",)], "prompt string")
    assert prompt.optimize(df, rewrite=lambda c: F.concat(F.lit("  New "), c, F.lit("\n\n"))).first().optimized == "New Do it"


def test_blocks_are_stripped_of_all_white_space(spark):
    blocks = [(1, 1, 0, 10.0, 10.0, 90.0, 20.0, "first block\n", 0, 600.0), (1, 1, 1, 10.0, 30.0, 90.0, 40.0, "\n", 0, 600.0), (1, 1, 2, 10.0, 50.0, 90.0, 60.0, "\tlast\n", 0, 600.0), (1, 1, 3, 10.0, 70.0, 90.0, 80.0, None, 0, 600.0)]
    df = spark.createDataFrame(blocks, "doc_id long, page_number int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, block_type int, page_width double")
    assert package.pages_of_blocks(df).first().text_content == "first block\n\nlast"
