"""Streams with state, and windows of savings."""

from __future__ import annotations

import datetime as dt

import pytest
from loomspark.operators import compress, package, prompt
from loomspark.streaming import running, stream
from pyspark.sql import functions as F

PAGES = "doc_id string, page_number int, text_content string, ts timestamp, last boolean"
NOON = dt.datetime(2026, 1, 1, 12)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def page(doc: str, k: int, minutes: float, last: bool | None = None, head: str = "ACME  Report") -> tuple:
    return (doc, k, f"{head}\n# Heading\nBody {k} of {doc}\n| a |\nfooter {'x' if k % 3 else k}", NOON + dt.timedelta(minutes=minutes), last)


def batches(spark, tmp_path, parts: list[list[tuple]]):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    schema = spark.createDataFrame([], PAGES).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def drained(df, tmp_path) -> list:
    df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(180)
    return sorted(map(tuple, df.sparkSession.read.parquet(f"{tmp_path}/out").select("doc_id", "line", "pages").collect()))


def test_running_lines_of_pages_in_several_batches(rocks, tmp_path):
    a = [page("a", k, k) for k in range(1, 7)]
    b = [page("b", k, k, head=f"own {k}") for k in range(1, 5)]
    c = [page("c", k, k) for k in range(1, 3)]  # too few pages
    d = [page("d", k, k, last=k == 4) for k in range(1, 5)]  # says itself that it ends
    far = [page("z", 1, 600)]  # moves the watermark past all of them
    got = drained(running.running_lines_stream(batches(rocks, tmp_path, [a[:2] + b[:1] + d[:2], a[2:5] + c[:1] + d[2:], a[5:] + b[1:] + c[1:], far, far]), late="1 minute"), tmp_path)
    whole = rocks.createDataFrame(a + b + c + d, PAGES)
    batch = compress.running_lines_of(package.joined_pages(whole), "doc_id", "markdown")
    sizes = {"a": 6, "b": 4, "d": 4}
    assert got == sorted((r.doc_id, r.line, sizes[r.doc_id]) for r in batch.collect()) and ("a", "acme report", 6) in got


def test_late_pages_open_a_document_of_their_own(rocks, tmp_path):
    first, late = [page("a", k, k, last=k == 3) for k in range(1, 4)], [page("a", k, k, head="other head") for k in range(4, 7)]
    far = [page("z", 1, 600)]
    got = drained(running.running_lines_stream(batches(rocks, tmp_path, [first, late, far, far]), late="1 minute"), tmp_path)
    assert ("a", "acme report", 3) in got and ("a", "other head", 3) in got


def test_savings_by_window(spark, tmp_path):
    rows = [(k, f"Please kindly review item {k}. In order to finish, test it.", NOON + dt.timedelta(minutes=m)) for k, m in enumerate([1, 2, 11, 12, 13, 300, 301])]
    schema = "prompt_id long, prompt string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    live = stream.read_parquet_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
    out = stream.savings_by_window(stream.optimize_stream(live), "ts").select(F.col("window.start").alias("start"), "prompts", "tokens_saved")
    out.writeStream.format("memory").queryName("saved").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(180)
    want = prompt.optimize_prompts(spark.createDataFrame(rows, schema)).groupBy(F.window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("prompts"), F.sum("tokens_saved").alias("tokens_saved"))
    got = {tuple(r) for r in spark.table("saved").collect()}
    assert got == {tuple(r) for r in want.select("w.start", "prompts", "tokens_saved").collect()} and {r[1] for r in got} == {2, 3}


def test_normalize_stream(spark, tmp_path):
    rows = [(k, f"d{k}.docx", f"# A {k}\n\nAcme   Corp body", 40) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, document_name string, markdown_raw string, raw_bytes long")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    live = stream.normalize_stream(stream.read_parquet_stream(spark, f"{tmp_path}/in", df.schema, 1))
    stream.write_stream(live, f"{tmp_path}/out", f"{tmp_path}/state").start().awaitTermination(180)
    got, want = (sorted((r.doc_id, r.full_markdown, r.chunks, r.entities, r.metrics) for r in x.collect()) for x in (spark.read.parquet(f"{tmp_path}/out"), package.normalize(df)))
    assert got == want
