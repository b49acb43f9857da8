"""Literal expectations, written apart from the engine's tables: every rule, rate and price, and entities by Python's own patterns."""

from __future__ import annotations

import json
import re

import pytest
from loomspark.functions import tokens
from loomspark.operators import chunk, entities, package, prompt, rules
from loomspark.plans import catalogue
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

FILLERS = {
    "please go": "go", "could you go": "go", "could you please go": "go", "Can you go": "go", "can you please go": "go", "would you go": "go", "would you please be able to go": "go",
    "I would like you to go": "go", "i want you to go": "go", "I need you to go": "go", "I was wondering if you could go": "go", "Kindly go": "go", "just go": "go", "basically go": "go",
    "actually go": "go", "literally go": "go", "simply go": "go", "obviously go": "go", "of course go": "go", "pleased to go": "pleased to go", "adjust it": "adjust it",
}
PHRASES = {
    "In order to x": "To x", "due to the fact that x": "Because x", "for the purpose of x": "To x", "In the event that x": "If x", "at this point in time x": "Now x", "at the present time x": "Now x",
    "in the near future x": "Soon x", "on a daily basis x": "Daily x", "it is important to note that x": "Note: x", "It should be noted that x": "Note: x", "it is worth mentioning that x": "Note: x",
    "as a matter of fact x": "In fact x", "for the sake of x": "For x", "with regard to x": "Regarding x", "with respect to x": "Regarding x", "in regard to x": "Regarding x", "in terms of x": "Regarding x",
    "as well as x": "and x", "each and every x": "Every x", "first and foremost x": "First x", "all of the x": "All x", "a large number of x": "Many x", "a majority of x": "Most x",
    "has the ability to x": "Can x", "is able to x": "Can x", "make sure that x": "Ensure x", "make sure to x": "Ensure x", "take into consideration x": "Consider x", "take into account x": "Consider x",
    "IN ORDER TO x": "IN ORDER TO x",
}
QUALIFIERS = {
    "very important": "important", "EXTREMELY  important": "critical", "extremely critical": "critical", "very much": "greatly", "very good": "excellent", "very bad": "poor", "very big": "large",
    "very small": "tiny", "very fast": "rapid", "very easy": "simple", "very\nhard": "difficult", "quite a few": "several", "A lot of": "many", "the vast majority of": "most", "every good": "every good",
}
PASSIVES = {
    "it is recommended that x": "Recommend: x", "It is suggested that x": "Suggest: x", "it is required that x": "Require: x", "it is necessary to x": "Must x", "it is essential to x": "Must x",
    "it is advisable to x": "Should x", "there is a need to x": "Need to x", "There are several x": "Several x", "there are many x": "Many x", "there is no need to x": "Do not x",
}


@pytest.mark.parametrize("stage, cases", zip(prompt.STAGES, (FILLERS, PHRASES, QUALIFIERS, PASSIVES), strict=False))
def test_every_rule(spark, stage, cases):
    rows = spark.createDataFrame(list(cases.items()), "t string, want string").withColumn("got", stage(F.col("t")))
    assert rows.where("not got <=> want").collect() == []


def test_there_is_a_case_for_every_rule():
    cases = [FILLERS, PHRASES, QUALIFIERS, PASSIVES]
    counts = [len(s) for s in rules.STAGES]
    assert sum(counts) == 69 and all(len(c) >= n for c, n in zip(cases, counts, strict=True))


def test_prices_and_rates(spark):
    prices = {"gpt-4": 3e-5, "GPT-4-turbo": 3e-5, "gpt-4o": 2.5e-6, "gpt-4o-mini": 2.5e-6, "o1": 2.5e-6, "O3-mini": 2.5e-6, "claude-3": 3e-6, "Gemini-2": 7.5e-8, "llama": 1e-5, "": 1e-5}
    rates = {"gpt-4": 130, "GPT-4-turbo": 130, "gpt-4o": 110, "gpt-4o-mini": 110, "o1": 110, "O3-mini": 110, "claude-3": 136, "Gemini-2": 140, "llama": 130, "": 130}
    df = spark.createDataFrame([(m,) for m in prices], "m string").select("m", tokens.price(F.col("m")).alias("p"), tokens.count_tokens(F.lit("w " * 100), F.col("m")).alias("n"))
    rows = {r.m: (r.p, r.n) for r in df.collect()}
    assert rows == {m: (prices[m], rates[m]) for m in prices}


# Entities as Python's re finds them.
_ORGANISATIONS = "Corp|Corporation|Inc|LLC|Ltd|Group|Holdings|Solutions|Systems|Technologies|University|Institute"
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_TECH = r"Python|FastAPI|Pydantic|Docker|PostgreSQL|Celery|Redis|Qdrant|TypeScript|Next\.js|Gemini|Claude|ChatGPT|LLM|RAG|SQLAlchemy"
_PLACES = "New York|San Francisco|London|Tokyo|Paris|Berlin|California|Texas|Washington|Boston|Seattle|India|Germany|Canada|UK|US|USA|United States|United Kingdom"
_FINDERS = (
    ("Organization", rf"\b[A-Z][a-zA-Z0-9&]+(?:\s+[A-Z][a-zA-Z0-9]+)*\s+(?:{_ORGANISATIONS})\b", 0), ("Date", rf"\b(?:\d{{1,2}}\s+(?:{'|'.join(_MONTHS)})\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})\b", 0),
    ("Technology", rf"\b(?:{_TECH})\b", re.I), ("Email", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", 0), ("Phone", r"(?:^|(?<=\s))\+?\d{1,3}[-.\s]?\(?\d{2,3}\)?[-.\s]?\d{3,4}[-.\s]?\d{4}\b", 0),
    ("Location", rf"\b(?:{_PLACES})\b", re.I), ("Monetary", r"\$\d+(?:\.\d+)?(?:\s*(?:million|billion|M|B))?|\b\d+(?:\.\d+)?\s*(?:USD|EUR|GBP|dollars)\b", re.I),
)


def iso(name: str) -> str:
    m = re.fullmatch(r"(\d{1,2})\s+([a-z]+)\s+(\d{4})", name.strip().lower())
    months = {x.lower(): k for k, name in enumerate(_MONTHS, 1) for x in (name, name[:3])}
    return f"{m[3]}-{months[m[2]]:02d}-{m[1].zfill(2)}" if m and m[2] in months else name


def found(text: str) -> list[tuple[str, str, str]]:
    out, seen = [], set()
    for category, pattern, flags in _FINDERS:
        for m in re.finditer(pattern, text, flags):
            name = iso(m[0]) if category == "Date" else m[0]
            if (name.lower(), category) not in seen:
                seen.add((name.lower(), category))
                left, dot = text.rfind(".", 0, m.start()), text.find(".", m.end())
                out.append((name, category, text[left + 1 : dot + 1 if dot >= 0 else m.end() + 50].strip().replace("\n", " ")))
    return out


def test_entities_row_for_row(spark):
    texts = {r.doc_id: r.markdown for r in catalogue.docs(spark, SF).collect()}
    rows = catalogue.queries()["entities_dedup"](spark, SF).collect()
    got = {d: [] for d in texts}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.ord)):
        got[r.doc_id].append((r.name, r.category, r.context))
    assert got == {d: found(t) for d, t in texts.items()} and sum(map(len, got.values())) > 500


def test_packages_row_for_row(spark):
    """The parts of a package against one another, and its entities by Python."""
    given = {r.doc_id: r for r in catalogue._package_input(spark, SF).collect()}
    rows = catalogue.queries()["context_package"](spark, SF).collect()
    assert len(rows) == len(given)
    for r in rows:
        raw = given[r.doc_id]
        assert json.loads(r.metadata) == {"file_type": ".docx", "use_ai_ocr": "False", "target_model": "gpt-4"} and r.document_name == f"doc{r.doc_id}.docx"
        assert [tuple(e.values()) for e in json.loads(r.entities)] == found(r.full_markdown)
        words, m = len(r.full_markdown.split()), json.loads(r.metrics)
        old, new = raw.raw_bytes // 2, max(1, words * 130 // 100)
        assert (m["raw_tokens_estimate"], m["compressed_tokens"], m["tokens_saved"]) == (old, new, max(0, old - new))
        assert abs(m["dollars_saved"] - max(0, old - new) * 3e-5) < 1e-6 and abs(m["savings_percentage"] - max(0, old - new) / old * 100) < 0.0051
        chunks = json.loads(r.chunks)
        bare = [re.sub(r"\A# \[Context: .*?\]\n", "", c) for c in chunks]
        assert " ".join(" ".join(bare).split()) == " ".join(r.full_markdown.split())


@pytest.mark.parametrize(
    "text, chunks",
    [
        ("intro text\n\n# A\n\nbody", ["intro text", "# [Context: A]\n# A\n\nbody"]),
        ("# A\n\n# B\n\nb", ["# [Context: A]\n# A", "# [Context: B]\n# B\n\nb"]),
        ("### deep\n\nx\n\n# top\n\ny", ["# [Context: deep]\n### deep\n\nx", "# [Context: top]\n# top\n\ny"]),
        ("# A\n\none two three four five six. seven eight nine ten eleven twelve.", ["# [Context: A]\n# A", "# [Context: A]\none two three four five six.", "# [Context: A]\nseven eight nine ten eleven twelve."]),
        ("", []),
    ],
)
def test_chunks(spark, text, chunks):
    df = spark.createDataFrame([(text,)], "m string")
    assert chunk.with_chunks(df, "m", 8).first().chunks == chunks


def test_reports_count_prompts_once(spark):
    from loomspark.operators import reports

    rows = [("user", "a", ["x", "y"], 10, 4), ("user", "b", [], 8, 0), ("system", "a", ["y"], 6, 6), (None, "a", ["x"], 1, 1)]
    df = spark.createDataFrame(rows, "role string, model string, techniques array<string>, raw_tokens long, tokens_saved long")
    got = {tuple(r) for r in reports.savings_report(df).collect()}
    assert (None, None, None, 7, 4, 25, 11) in got and ("user", None, None, 3, 2, 18, 4) in got and (None, None, None, 3, 1, 1, 1) in got
    assert (None, None, "y", 6, 2, 16, 10) in got and (None, None, None, 6, 1, 8, 0) in got and (None, "a", "x", 4, 2, 11, 5) in got


def test_demo_is_a_package(spark):
    df = spark.createDataFrame([("d.docx", "# A\n\n" + "word " * 250, 2000)], "document_name string, markdown_raw string, raw_bytes long")
    assert len(package.normalize(df, options=package.DEMO).first().chunks) == 2 and entities.names(F.lit("x"), "Date") is not None
