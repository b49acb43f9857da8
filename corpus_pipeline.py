"""From raw documents to packed sequences: quality, near-dedup, substring dedup, mix, packing.

Each stage takes what the one before kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import minhash, mixing, packing, quality, substring
from loomspark.llm.queries import training_labels, vocabulary
from loomspark.llm.shared import release, tables, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.3 go; the others stay as they are."""
    return quality.keep(docs, quality.train(docs, training_labels(spark, sf_dir)), threshold=0.3)


def _plainly_named(docs: DataFrame) -> DataFrame:
    """The documents with names for their further columns that no operator uses itself."""
    known = ("doc_id", "text", "lang", "source", "n_chars")
    return docs.toDF(*(c if c in known else f"extra{k}" for k, c in enumerate(docs.columns)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows the one of least doc_id stays, nulls last.  Texts
    without words are like no other; of those that repeat with one doc_id one stays.  Where
    doc_ids repeat or are null, rows get keys of their own first."""
    names, docs = docs.columns, _plainly_named(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if not ids.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        gone = written(minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_id")), "pipeline-gone")
        return docs.join(gone, F.col("doc_id").cast("long") == F.col("gone_id"), "left_anti").toDF(*names)
    key = "row_key"
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-rows")
    found = minhash.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias(key), "n_shingles", "component_id")
    alone = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    grouped = rows.select(key, "doc_id").join(found, key).select(key, "doc_id", alone.alias("alone"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("group"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col(key)))
    kept = grouped.groupBy("alone", "group").agg(least.alias("least")).select(F.col(f"least.{key}").alias(key))
    return rows.join(written(kept, "pipeline-kept"), key, "left_semi").select(docs.columns).toDF(*names)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has go; texts that lose none
    stay as they are, and none is dropped."""
    names, docs = docs.columns, _plainly_named(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = substring.without_repeats(docs).withColumn("text", text)
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        changed = changed.withColumn("n_chars", chars)
    return changed.select(docs.columns).toDF(*names)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document."""
    names, docs = docs.columns, _plainly_named(docs)
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.select(*docs.columns, F.explode(F.sequence(F.lit(1), "copies"))).select(docs.columns).toDF(*names)


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 1024 ids."""
    pieces = packing.pack(docs, vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("source_mix", source_mix), ("packing", retrieval_packing)]

#: Hashes of the models, sketches and token ids aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with tables() as made:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            release(*(t for t in made if t is not docs))
    return STAGES[-1][1](spark, docs, sf_dir)
