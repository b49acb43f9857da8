"""How much work a text costs: words counted once, one search for entities, classes of characters that decide early."""

from __future__ import annotations

import re
import time

import pyarrow as pa
import pytest
from loomspark.functions.pytext import NOT_WS, WS
from loomspark.operators import compress, entities, external
from loomspark.plans import catalogue, outside
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["plain_metrics", "scorecard", "doc_dollars"])
def test_words_of_a_text_are_counted_once(spark, name):
    df = outside.queries()[name](spark, SF)
    assert plan(df).count("regexp_extract_all(") == 1


def test_words_are_counted_once_for_all_models(spark):
    """Below the row for each model, not above it."""
    above, below = plan(outside.doc_dollars(spark, SF)).split("Generate explode", 1)
    assert "regexp_extract_all(" not in above and "regexp_extract_all(" in below


@pytest.mark.parametrize("flags", ["", "(?U)", "(?iU)"])
def test_white_space_is_pythons(spark, flags):
    chars = [chr(k) for k in (*range(0xD800), *range(0xE000, 0x10000), 0x1F600)]
    df = spark.createDataFrame([(c,) for c in chars], "c string").select("c", F.col("c").rlike(rf"{flags}^{WS}\z").alias("is"), F.col("c").rlike(rf"{flags}^{NOT_WS}\z").alias("isnt"))
    rows = df.collect()
    assert len(rows) == len(chars) and [r for r in rows if r["is"] != r.c.isspace() or r.isnt == r["is"]] == []


def seconds(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def test_words_cost_little_more_than_those_of_ascii(spark):
    texts = spark.range(0, 4000, 1, 4).select(F.repeat(F.concat(F.lit("some words of a text "), "id", F.lit(" ")), 300).alias("t"))
    counted = lambda p: texts.agg(F.sum(F.regexp_count("t", F.lit(p))))
    least = lambda p: min(seconds(counted(p)) for _ in range(3))
    plain = least("[!-~]+")
    assert least(f"{NOT_WS}+") < 6 * plain


def test_lines_with_single_blanks_are_left_alone(spark):
    """They are most of a corpus; a pattern that replaces each blank by itself costs as much as one that mends it."""
    def least(gap: str) -> float:
        df = spark.range(0, 4000, 1, 4).select(F.repeat(F.lit(gap.join(["some", "words", "of", "a", "text", ""])), 1000).alias("t"))
        return min(seconds(df.select(compress.compress_syntax(F.col("t")))) for _ in range(3))

    assert least(" ") < 0.75 * least("  ")


def test_blanks_and_tabs_are_made_even(spark):
    gaps = [" ", "  ", "\t", " \t", "\t ", "\u00a0", "\u00a0 ", ""]
    lines = [f"{head}a{g}b{h}c{g}" for head in ("", "- ", "  12.  ", "#  ", "##\t") for g in gaps for h in gaps]
    df = spark.createDataFrame([(t,) for t in lines], "t string").select("t", compress.compress_syntax(F.col("t")).alias("got"))

    def want(t: str) -> str:
        even = lambda x: re.sub("[ \t]+", " ", x).strip()
        if m := re.match(r"\s*(#+)\s+", t):
            return f"{m[1]} {even(t[m.end() :])}".strip()
        if m := re.match(r"(\s*)([-*+]|[0-9]+\.)\s+", t):
            return f"{m[1]}{m[2]} {even(t[m.end() :])}".strip()
        return even(t)

    assert [(r.t, r.got, want(r.t)) for r in df.collect() if r.got != want(r.t)] == []


def test_entities_of_long_texts_take_time_in_proportion(spark):
    """No match copies the whole text."""
    def least(n: int) -> float:
        df = spark.range(0, 8, 1, 8).select(F.repeat(F.concat(F.lit("Ann wrote to a"), "id", F.lit("@b.example in 2024-01-31. ")), n).alias("t"))
        return min(seconds(df.select(entities.found(F.col("t"), "Date").alias("e"))) for _ in range(2))

    least(50)
    assert least(16_000) < 10 * least(4_000)


def test_entities_around_marks_and_letters_of_other_cases(spark):
    """A text may have the character that marks matches; ſ, ı and K are forms of s, i and k."""
    words = ["seattle", "ſeattle", "ındia", "UK", "٣ June 2026", "12 June 2026", "$5", "Acme Corp", "a.b@c.example", "+1 555 123 4567", "next.js", "x￿", "￿", "...", "\n"]
    texts = [f"{a} {b}.{c} {a}{b} {c}￿{a}"[: None if k % 3 else -1] for k, a in enumerate(words) for b in words for c in (words[k - 3], "", ".")]
    texts += [t.replace("￿", "") for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[F.transform(entities.found(F.col("t"), k), lambda e: F.struct(e["name"], e["context"])).alias(k) for k in entities.PATTERNS])
    wrong = []
    for row in df.collect():
        for k, p in entities.PATTERNS.items():
            if k == "Date":
                continue  # names are in ISO form
            p = re.sub(r"\(\?(i?)U\)", r"(?\1)", p).replace("(?)", "")
            spans = [m.span() for m in re.finditer(p, row.t)]
            want = []
            for a, b in spans:
                left, right = row.t[:a].rsplit(".", 1)[-1], row.t[b:]
                right = right[: right.index(".") + 1] if "." in right else right[:50]
                want.append((row.t[a:b], (left + row.t[a:b] + right).strip().replace("\n", " ")))
            if [tuple(e) for e in row[k]] != want:
                wrong.append((k, row.t, row[k], want))
    assert wrong[:3] == []


def test_calls_get_batches_in_slices():
    """A batch of many large inputs isn't made Python values of at once, and no row is lost."""
    batch = pa.RecordBatch.from_pydict({"k": list(range(1000)), "content": [b"x" * 20_000] * 1000})
    got = list(external.slices(iter([batch, batch.slice(0, 0), batch.slice(5, 1)])))
    assert max(b.nbytes for b in got) <= 1 << 20 and [k for b in got for k in b.column(0).to_pylist()] == [*range(1000), 5]


def test_a_service_gets_every_row_once(spark):
    df = spark.range(0, 3000, 1, 1).select("id", F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "utf-8").alias("content"))
    rows = external.called(df, F.col("id") % 2 == 0, ["content"], lambda: lambda content: str(len(content))).select("id", "result.value").collect()
    assert sorted(tuple(r) for r in rows) == [(k, None if k % 2 else str(k)) for k in range(3000)]
