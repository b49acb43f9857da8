"""Required cases with their literal results, files and streams."""

from __future__ import annotations

import html
import io
import json
import re
import time
import zipfile

import pytest
from loomspark.functions import sql, tokens
from loomspark.functions.pytext import first_wins, running_sum, runs
from loomspark.operators import chunk, compress, entities, package, prompt
from loomspark.sources import office, sinks, web
from loomspark.streaming import stream
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def one(spark):
    """The value of a column expression over a text."""

    def value(expression, text):
        return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("v")).first().v

    return value


def optimized(spark, text):
    return prompt.optimize_prompts(spark.createDataFrame([(text,)], "prompt string")).first()


@pytest.mark.parametrize("text", ["", None])
def test_no_text_has_no_tokens(one, text):
    assert one(tokens.count_tokens, text) == 0


def test_tokens_by_family(one):
    text = " ".join(["word"] * 100)
    plain, claude, gemini = (one(lambda c, m=m: tokens.count_tokens(c, m), text) for m in ("gpt-4", "claude-3", "gemini-2"))
    assert (plain, claude, gemini) == (130, 136, 140)
    assert one(lambda c: tokens.count_tokens(c, "gpt-4o"), "one") == 0
    assert one(tokens.count_tokens, "       ") == 1


def test_true_tokens(one):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    text = "Some words, and <|endoftext|> too."
    plain = Tokenizer.from_file(path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    values = [one(lambda c: tokens.true_tokens(c, path("byte_bpe_50k.json")), t) for t in (text, "", None)]
    assert values == [len(plain.encode(text, add_special_tokens=False).ids), 0, 0]


def test_savings(spark):
    def of(raw, new, model, exact=False):
        s = tokens.savings(F.col("raw"), F.col("new"), model, exact)
        return spark.createDataFrame([(raw, new)], "raw long, new long").select(*[c.alias(n) for n, c in s.items()]).first()

    assert tuple(of(0, 5, "gpt-4")) == (0, 5, 0, 0.0, 0.0)
    assert of(1000, 400, "gpt-4").dollars_saved == 0.018 and of(1000, 400, "gpt-4o").dollars_saved == 0.0015
    assert of(1000, 400, "gpt-4").savings_percentage == 60.0 and of(10, 40, "gpt-4").tokens_saved == 0
    assert of(32, 31, "gpt-4", exact=True).savings_percentage == round(1 / 32 * 100, 2) == 3.12


def test_boilerplate_lines_go(one):
    text = "Report body stays here.\nPage 4 of 20\nCopyright © 2026 Acme\nMore body."
    assert one(compress.strip_bloat, text) == "Report body stays here.\nMore body."


def test_long_lines_stay_once(one):
    line = "This long paragraph of more than fifty characters comes twice in the same document, word by word."
    assert one(compress.strip_bloat, f"{line}\nshort\n{line}\nshort") == f"{line}\nshort\nshort"


def test_running_header_goes_and_headings_stay(one):
    pages = "\n\n---\n\n".join(f"ACME Quarterly\n# Part {k}\nBody text number {k}" for k in range(3))
    cleaned = one(compress.strip_bloat, pages)
    assert "ACME" not in cleaned and all(f"# Part {k}" in cleaned for k in range(3))


def test_syntax(one):
    assert one(compress.compress_syntax, "#  Heading  Spacing \n\nBody   text    with    excessive   spacing.") == "# Heading Spacing\n\nBody text with excessive spacing."


def test_deduplication_can_be_left_out(one):
    text = "Page 4 of 20\nbody   text"
    assert one(lambda c: compress.compressed(c, False), text) == "Page 4 of 20\nbody text" and one(compress.compressed, text) == "body text"


def test_chunks_say_where_they_are(spark):
    df = spark.createDataFrame([("# A\n\none two three four five six seven\n\n## B\n\neight nine ten eleven twelve thirteen fourteen",)], "m string")
    chunks = chunk.with_chunks(df, "m", 10).first().chunks
    assert len(chunks) >= 2 and chunks[0].startswith("# [Context: A]\n") and "# [Context: A > B]\n" in chunks[-1]


def test_a_longer_sentence_stands_alone(spark):
    long = " ".join(["w"] * 12) + "."
    df = spark.createDataFrame([(f"a b. {long} c d.",)], "m string")
    assert chunk.with_chunks(df, "m", 5).first().chunks == ["a b.", long, "c d."]


PARAGRAPH = "Acme Systems of London pays $5 million for Python work; write to ann@acme.example or call +1 555 123 4567 by 12 June 2026."


def test_every_kind_of_entity(spark):
    found = {(e.category, e.name) for e in spark.createDataFrame([(PARAGRAPH,)], "t string").select(F.explode(entities.entities(F.col("t"))).alias("e")).select("e.*").collect()}
    want = {("Organization", "Acme Systems"), ("Date", "2026-06-12"), ("Technology", "Python"), ("Email", "ann@acme.example"), ("Phone", "+1 555 123 4567"), ("Location", "London"), ("Monetary", "$5 million")}
    assert found == want


def test_entities_of_one_name_come_once_with_their_sentence(spark):
    text = "First. Mail ann@acme.example or bob@acme.example now. ANN@acme.example again, tell us."
    rows = entities.exploded(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").collect()
    assert [(r.category, r.name) for r in rows] == [("Email", "ann@acme.example"), ("Email", "bob@acme.example"), ("Location", "us")]
    assert rows[0].context == "Mail ann@acme.example or bob@acme."


@pytest.mark.parametrize("text, iso", [("99 june 2026", "2026-06-99"), (" 3 Sept 2020", " 3 Sept 2020"), ("2026-06-12", "2026-06-12"), ("1 sep 2020", "2020-09-01"), (None, "")])
def test_iso_dates(one, text, iso):
    assert one(entities.iso_date, text) == iso


@pytest.mark.parametrize(
    "stage, text, result",
    [
        (prompt.compress_phrases, "In order to fix this bug", "To fix this bug"),
        (prompt.strip_qualifiers, "There are a lot of issues", "There are many issues"),
        (prompt.dedup_instructions, "Keep every answer short.\n# Title\nkeep  every answer SHORT.\n# Title", "Keep every answer short.\n# Title\n# Title"),
        (prompt.structure_markdown, "Requirements:\n  1) First step", "## Requirements\n1. First step"),
        (prompt.normalize_whitespace, "Hello   world   test", "Hello world test"),
        (prompt.normalize_whitespace, "a\n \n \n \nb", "a\n\n\n\nb"),
    ],
)
def test_stages(one, stage, text, result):
    assert one(stage, text) == result


def test_fillers_go(spark):
    text = "Could you please kindly just help me basically fix this"
    assert len(optimized(spark, text).optimized) < len(text)


@pytest.mark.parametrize("text", ["", "  \n\t ", None])
def test_blank_prompts(spark, text):
    r = optimized(spark, text)
    assert (r.optimized, r.techniques, r.status, r.error) == ("", [], 400, "Prompt text cannot be empty.")


def test_first_letter_is_upper_case(spark):
    assert optimized(spark, "Please write a test").optimized[0].isupper()


def test_a_rewrite_of_the_callers_adds_its_label(spark):
    df = spark.createDataFrame([("please do it now",), ("",)], "prompt string")
    rows = prompt.optimize_prompts(df, rewrite=lambda c: F.concat(F.lit("New: "), c)).collect()
    assert rows[0].optimized.startswith("New: ") and rows[0].techniques[-1] == prompt.rules.REWRITTEN
    assert rows[1].optimized == "" and rows[1].techniques == []


def test_dispatch(spark):
    df = spark.createDataFrame([("/a/x.exe", 5), ("/a/y.PDF", 0), ("/a/z.Docx", 5), ("/a/p.png", 5), ("/a/none", 1)], "path string, n_bytes long")
    rows = {r.path: (r.reader, r.status) for r in package.dispatch(df).collect()}
    assert rows == {"/a/x.exe": (None, 400), "/a/y.PDF": (None, 400), "/a/z.Docx": ("local", 200), "/a/p.png": ("ai", 200), "/a/none": (None, 400)}
    assert {r.reader for r in package.dispatch(df, options=package.Options(use_ai=True)).where("status = 200").collect()} == {"ai"}


def test_a_reader_of_the_callers_and_its_errors(spark):
    df = package.dispatch(spark.createDataFrame([("/a/p.png", bytearray(b"hi"), 2), ("/a/q.png", bytearray(b"no"), 2)], "path string, content binary, n_bytes long"))

    def read(content, path):
        if content == b"no":
            raise ValueError("unreadable")
        return content.decode() * 2

    rows = {r.path: (r.markdown_raw, r.status, r.error) for r in package.with_reader(df, read).collect()}
    assert rows == {"/a/p.png": ("hihi", 200, None), "/a/q.png": (None, 400, "unreadable")}


def test_health_and_demo(spark):
    r = package.engine_info(spark).first()
    assert r.status == "healthy" and len(r.supported_formats) == 7 and package.DEMO.chunk_size == 100


def test_links_go_into_their_blocks(spark):
    blocks = [(1, 1, 0, 310.0, 10.0, 590.0, 60.0, "Right side\ntext", 0, 600.0), (1, 1, 1, 10.0, 10.0, 280.0, 60.0, "See our\nsite here, our site.", 0, 600.0), (1, 1, 2, 10.0, 70.0, 280.0, 90.0, "image", 1, 600.0)]
    df = spark.createDataFrame(blocks, "doc_id long, page_number int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, block_type int, page_width double")
    links = [(1, 1, 0, 20.0, 20.0, 90.0, 40.0, "our site", "https://a.example/x"), (1, 1, 1, 20.0, 20.0, 90.0, 40.0, "See  our", "https://b.example/(1)"), (1, 1, 2, 320.0, 20.0, 330.0, 30.0, "absent", "https://c.example")]
    near = spark.createDataFrame(links, "doc_id long, page_number int, link_no int, x0 double, y0 double, x1 double, y1 double, text string, uri string")
    out = package.pages_of_blocks(df, near).first().text_content
    assert out == "[See  our](https://b.example/(1))\nsite here, [our site](https://a.example/x).\n\nRight side\ntext"
    assert package.pages_of_blocks(df).first().text_content.startswith("See our\nsite here, our site.")


def test_found_tables(spark):
    df = spark.createDataFrame([([["a\nb", None], ["1", " x "]],), ([],)], "rows array<array<string>>")
    first, none = df.select(package.found_table(F.col("rows")).alias("t")).collect()
    assert first.t.headers == ["a b", ""] and first.t.rows == [["1", "x"]] and none.t is None
    assert first.t.markdown_representation == "| a b |  |\n| --- | --- |\n| 1 | x |"


W, A, P = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"


def zipped(**files: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in files.items():
            z.writestr(name, xml)
    return out.getvalue()


def docx() -> bytes:
    p = lambda t, s=None: f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = "<w:tbl>" + "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in (("k", "v"), ("1", "2"))) + "</w:tbl>"
    body = p("Title", "H1") + table + p("item", "LB") + p("first", "LN") + p("second", "LN") + p("  ") + p("plain")
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("H1", "heading 1"), ("LB", "List Bullet"), ("LN", "List Number")))
    return zipped(**{"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>', "word/styles.xml": f'<w:styles xmlns:w="{W}">{styles}</w:styles>'})


def pptx() -> bytes:
    p = lambda t, lvl=0: f'<a:p><a:pPr lvl="{lvl}"/><a:r><a:t>{t}</a:t></a:r></a:p>'
    shape = lambda kind, body: f"<p:sp><p:nvSpPr><p:nvPr>{f'<p:ph type={chr(34)}{kind}{chr(34)}/>' if kind else ''}</p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>"
    root = lambda inner: f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>'
    rels = '<Relationships><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/notesSlide" Target="../notesSlides/notesSlide1.xml"/></Relationships>'
    return zipped(**{"ppt/slides/slide1.xml": root(shape("", p("top") + p("below", 1)) + shape("title", p("Head"))), "ppt/slides/_rels/slide1.xml.rels": rels, "ppt/notesSlides/notesSlide1.xml": root(shape("body", p("say it"))), "ppt/slides/slide2.xml": root(shape("", p("end")))})


def test_office_files(spark, tmp_path):
    for name, content in (("a.docx", docx()), ("b.pptx", pptx()), ("bad.docx", b"no zip"), ("c.pdf", b"%PDF")):
        (tmp_path / name).write_bytes(content)
    rows = {(r.doc_id.rpartition("/")[2], r.page_number): r for r in office.pages(office.items(office.read_files(spark, str(tmp_path)))).collect()}
    assert rows["a.docx", 1].text_content == "# Title\n\n- item\n\n1. first\n\n1. second\n\nplain\n\n| k | v |\n| --- | --- |\n| 1 | 2 |"
    assert rows["b.pptx", 1].text_content == "## Slide 1\n\n### Head\n\ntop\n\n  - below\n\n\n> **Speaker Notes:** say it" and rows["b.pptx", 2].text_content == "## Slide 2\n\nend"
    assert "BadZipFile" in rows["bad.docx", 1].error and rows["c.pdf", 1].error


def test_text_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x\n\ny\n")
    assert office.read_texts(spark, str(tmp_path)).first().text == "# x\n\ny\n"


@pytest.mark.parametrize(
    "url, html, markdown",
    [
        ("https://x.example", "<title> T </title><h2>Head</h2><script>no</script><p>one <b>two</b></p><p> </p><ul><li>a<li>b</ul>", "## Head\n\none two\n\na\n\nb"),
        ("https://www.youtube.com/watch?v=1", "<title>Clip</title><p>no</p><div id='description-inner'>about <div>it</div> all</div><p>no</p>", "YouTube Video Page: Clip\n\nDescription:\nabout\nit\nall"),
        ("https://github.com/a/b", "<title>Repo</title><div aria-labelledby='folders-and-files'>x</div><table class='wide files'><tr><td>f.py</td></tr></table>", "GitHub Repository Context: Repo\n\nFile Listings:\nf.py"),
        (None, None, ""),
        ("https://[", "<p>x", "x"),
        (None, "<title>a\n  b</title><p>one\n     two</p><p> a <b> b</b>  c\u00a0\u00a0d </p>", "one two\n\na b c\u00a0\u00a0d"),
        (None, "<p>a<br>b <br/> c</p><h1> Big\n<i>head</i> </h1>", "a\nb\nc\n\n# Big head"),
        (None, "<ul><li>one<div>two</div>three</li><li><p>four</p><p>five</p></li></ul>", "one\ntwo\nthree\n\nfour\n\nfive\n\nfour\n\nfive"),
        (None, "<table>\n <tr>\n <th>k</th> <th> v </th>\n</tr> <tr><td>1</td><td></td><td>2</td></tr></table>", "k\tv\n1\t\t2"),
        (None, "<li>x<pre>  two\n   lines</pre>y</li>", "x\n  two\n   lines\ny"),
        (None, "<p>a<script>var x</script> b<style>p{}</style>c</p><p>\n</p>", "a bc"),
    ],
)
def test_web_pages(spark, url, html, markdown):
    df = spark.createDataFrame([(url, html)], "url string, html string")
    assert web.html_to_markdown(df).first().markdown == markdown


def test_web_pages_row_for_row(spark):
    """Every page of the smallest table, against patterns over its source."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = web.html_to_markdown(pages).collect()
    assert rows
    for r in rows:
        source = re.sub(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", "", r.html or "")
        want = []
        for tag, inner in re.findall(r"(?is)<(h1|p|li)\b[^>]*>(.*?)(?=</?(?:h1|p|li|ul|div|nav|article|footer|body)\b|\Z)", source):
            lines = re.split(r"(?i)<(?:br|/?div|/?tr)\b[^>]*>", inner)
            text = "\n".join(html.unescape(re.sub(r"[ \t\n\r\f]+", " ", re.sub(r"<[^>]*>", "", x))).strip(" ") for x in lines).strip()
            want += [f"{'#' * int(tag[1])} {text}"] if tag[0] in "hH" else [text] if text else []
        assert r.markdown == "\n\n".join(want)


def test_sinks(spark, tmp_path):
    rows = package.normalize(spark.createDataFrame([("a.docx", "# A\n\nbody text", 40), ("b.docx", "# B\n\nother\n\ntext", 60)], "document_name string, markdown_raw string, raw_bytes long"))
    sinks.write_json(rows, f"{tmp_path}/json")
    assert {json.loads(r.value)["document_name"] for r in spark.read.text(f"{tmp_path}/json").collect()} == {"a.docx", "b.docx"}
    sinks.write_markdown(rows, f"{tmp_path}/md")
    assert {r.document_name: r.value for r in spark.read.text(f"{tmp_path}/md", wholetext=True).collect()} == {"a.docx": "# A\n\nbody text\n", "b.docx": "# B\n\nother\n\ntext\n"}
    assert sinks.scorecard(rows).first().raw == "50"


def test_sql_functions_equal_their_columns(spark):
    sql.register(spark)
    texts = ["", None, "a b c d", "a b c d", "  　", "one", " ".join(["w"] * 77), "x​y", "a\x1cb"]
    df = spark.createDataFrame([(t, m) for t in texts for m in ("gpt-4", "gpt-4o", "o1-mini", "claude-3", "Gemini", "other")], "t string, m string")
    pairs = {"loom_word_count(t)": F.coalesce(tokens.word_count(F.col("t")), F.lit(0)).cast("long"), "loom_tokens(t, m)": tokens.count_tokens(F.col("t"), F.col("m")), "loom_tokens(t)": tokens.count_tokens(F.col("t")), "loom_price(m)": tokens.price(F.col("m"))}
    for call, column in pairs.items():
        assert df.select(F.expr(call).alias("a"), column.alias("b")).where("not a <=> b").count() == 0, call


def test_sql_operators_equal_their_columns(spark):
    sql.register(spark)
    texts = [
        "", None, "  \u3000", "please do it, in order to finish", "Could you please kindly just help me basically fix this", "éa  very\u00a0important\tpoint", "ſhall I? Kindly Kindly  go",
        "Keep every answer short.\n# Title\nkeep  every\u2003answer SHORT.\n# Title\n\n\n\nshort\nshort", "Requirements:\u00a0\n  1) First step\n٣. Arabic digit\n# Not: a label:", "ßtraße stays\x1c",
        "#  Heading \u2003 Spacing \n\n \u00a0 -   item\n  3.   x\n\u2028## a", "12 June 2026", " 3 SEP\u00a02020 ", "3 Sept 2020", "2026-06-12 ", "99 june 2026", "٣ june 2026", "there is no need to 'quote' \\\\ it",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pairs = {"loom_compress_syntax(t)": compress.compress_syntax(F.col("t")), "loom_iso_date(t)": entities.iso_date(F.col("t"))}
    names = ("strip_filler", "compress_phrases", "strip_qualifiers", "simplify_passive", "dedup_instructions", "structure_markdown", "normalize_ws")
    pairs |= {f"loom_{n}(t)": stage(F.coalesce("t", F.lit(""))) for n, stage in zip(names, prompt.STAGES, strict=True)}
    for call, column in pairs.items():
        assert df.select("t", F.expr(call).alias("a"), column.alias("b")).where("not a <=> b").collect() == [], call
    whole = prompt.optimize(df, "t").select("t", "optimized", F.expr("loom_optimize(if(trim(coalesce(t, '')) = '', '', t))").alias("a"))
    assert whole.where("not a <=> optimized").collect() == []
    numbers = spark.createDataFrame([(r, k, m) for r in (None, 0, 7, 32, 1000) for k in (0, 31, 400) for m in ("gpt-4", "gpt-4o", "claude", "x")], "raw long, kept long, m string")
    s = tokens.savings(F.col("raw"), F.col("kept"), F.col("m"))
    for field in ("tokens_saved", "savings_percentage", "dollars_saved"):
        assert numbers.where("raw is not null").select("*", F.expr(f"loom_savings(raw, kept, m).{field}").alias("a"), s[field].alias("b")).where("not a <=> b").collect() == []


def test_repeats_in_a_very_long_document_take_linear_time(spark):
    """100,000 lines, half of them repeats: compared pair by pair these took minutes."""
    lines = [f"instruction number {k % 50_000} of many, spelled out" for k in range(100_000)]
    df = spark.createDataFrame([("\n".join(lines),)], "t string")
    start = time.perf_counter()
    assert df.select(prompt.dedup_instructions(F.col("t")).alias("v")).first().v == "\n".join(lines[:50_000])
    assert len(df.select(compress.strip_bloat(F.col("t")).alias("v")).first().v.split("\n")) == 100_000
    assert time.perf_counter() - start < 60


def test_first_wins_by_brute_force(spark):
    items = ["b", "a", "B", None, "a", "c", "", "b", "A", "", None]
    got = spark.createDataFrame([(items,), ([],)], "x array<string>").select(first_wins(F.col("x"), F.lower, lambda x: x != "").alias("v")).collect()
    assert [r.v for r in got] == [["b", "a", None, "c", "", "", None], []]
    keys = spark.createDataFrame([(items,)], "x array<string>").select(runs(F.col("x")).alias("r")).first().r
    assert {(r.k, r.i, r.n) for r in keys} == {("", 6, 2), ("A", 8, 1), ("B", 2, 1), ("a", 1, 2), ("b", 0, 2), ("c", 5, 1)}
    sums = spark.createDataFrame([([3, 1, 4, 1, 5, 9, 2],), ([],), ([7],)], "x array<int>").select(running_sum(F.col("x")).alias("v")).collect()
    assert [r.v for r in sums] == [[3, 4, 8, 9, 14, 23, 25], [], [7]]


def test_paths_of_very_many_headings(spark):
    text = "\n\n".join(f"{'#' * (1 + (k * 7 + k // 5) % 6)} {'' if k % 11 == 0 else f'h{k}'}" for k in range(150))
    df = spark.createDataFrame([(1, text), (2, "# A\n\n### C\n\n## B\n\n### D\n\n# "), (3, "no heading"), (4, None)], "k int, t string")
    rows = sorted(chunk.breadcrumbs_of(df, "k", "t").collect())
    assert rows == sorted(chunk.breadcrumbs(df, "k", "t").collect()) and [r.path for r in rows if r.k == 2] == ["A", "A > C", "A > B", "A > B > D"]
    long = spark.createDataFrame([(1, "\n\n".join(f"{'#' * (1 + k % 3)} h{k}" for k in range(20_000)))], "k int, t string")
    assert chunk.breadcrumbs_of(long, "k", "t").where("ord = 19999").first().path == "h19998 > h19999"


def test_streams_give_what_batches_give(spark, tmp_path):
    prompts = spark.createDataFrame([(k, f"Please kindly review item {k}. In order to finish, test it.") for k in range(20)], "prompt_id long, prompt string")
    prompts.repartition(4).write.parquet(f"{tmp_path}/in")
    live = stream.optimize_stream(stream.read_parquet_stream(spark, f"{tmp_path}/in", prompts.schema, 1))
    stream.write_stream(live, f"{tmp_path}/out", f"{tmp_path}/state").start().awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").exceptAll(prompt.optimize_prompts(prompts)).count() == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20


def test_an_array_is_computed_once_before_it_is_exploded(spark):
    """The chain of rewrites is in the plan as often as without counting."""
    from loomspark.plans import catalogue

    rules = [catalogue.queries()[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") for n in ("optimize_prompts", "technique_counts")]
    assert rules[1] <= rules[0]
