"""Packages as JSON or Markdown files, and a scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .datasource import register


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    as_json(df).write.text(path)


def write_markdown(df: DataFrame, path: str, name: str = "document_name", column: str = "full_markdown") -> None:
    """A folder for each document, named after it, that holds its text alone; null names share
    one.  Rows are dealt by name, so that a document's rows come from one task."""
    df.select(F.col(name), F.col(column).alias("value")).repartition(name).write.partitionBy(name).text(path)


def file_names(df: DataFrame, name: str, column: str) -> DataFrame:
    """(file_name, text): a document's name with what paths can't hold escaped, then `.md`.

    Names that several rows have, and those of over 180 characters, get a digest of the text,
    so that no file takes another's place but one with the same name and text.  A null or empty
    name is `untitled`."""
    safe = F.replace(F.url_encode(F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit("untitled"))), F.lit("+"), F.lit(" "))
    rows = df.select(safe.alias("_name"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    several = rows.groupBy("_name").count().where("count > 1").select("_name", F.lit(True).alias("_several"))
    digest = F.concat(F.substring("_name", 1, 180), F.lit("~"), F.substring(F.sha2("text", 256), 1, 16))
    told = F.when(F.col("_several") | (F.length("_name") > 180), digest).otherwise(F.col("_name"))
    return rows.join(several, "_name", "left").select(F.concat(told, F.lit(".md")).alias("file_name"), "text")


def write_markdown_files(df: DataFrame, path: str, name: str = "document_name", column: str = "full_markdown", mode: str = "append") -> None:
    """One file for each document, named after it, in a folder for each task; see `contextmd`."""
    register(df.sparkSession)
    file_names(df, name, column).write.format("contextmd").mode(mode).save(path)


def scorecard(df: DataFrame) -> DataFrame:
    """Totals with thousands separators, from a table of packages."""
    m = F.col("metrics")
    total = df.agg(F.sum(m["raw_tokens_estimate"]).alias("raw"), F.sum(m["compressed_tokens"]).alias("new"), F.sum(m["tokens_saved"]).alias("saved"), F.sum(m["dollars_saved"]).alias("dollars"))
    return total.select(*[F.format_number(c, 0).alias(c) for c in ("raw", "new", "saved")], F.format_number("dollars", 6).alias("dollars"))
