"""What several operators use: the shared folder, tables cut from their lineage, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of other characters than these (fixed by the contracts).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
GAP_PATTERN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where it is unset, a temporary
    folder serves a local session; on a cluster that is an error, as executors wouldn't share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/loomspark-{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, so that later jobs
    neither repeat the work nor depend on an executor that may be lost."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return _remembered(spark.read.schema(df.schema).parquet(path), path)


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Like `written`, dealt by the keys to one bucket for each shuffle partition: joins and
    groups on the keys read the buckets and don't shuffle these rows again."""
    spark, n = df.sparkSession, parallelism(df.sparkSession)
    path = shared_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    rows = df.repartition(n, *keys).write.format("parquet").option("path", path).option("compression", "zstd")
    rows.bucketBy(n, *keys).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"drop table {table}")  # the name alone: files at a given path stay
    return _remembered(found, path)


#: Paths of written tables that are still in use.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def _remembered(df: DataFrame, path: str) -> DataFrame:
    _paths[df] = path
    if (made := _made.get()) is not None:
        made.append(df)
    return df


@contextmanager
def tables() -> Iterator[list[DataFrame]]:
    """Gathers the tables that are written inside."""
    token = _made.set([])
    try:
        yield _made.get()
    finally:
        _made.reset(token)


def release(*written_tables: DataFrame) -> None:
    """Removes written tables (again: does nothing) that nothing will read any more: all that
    was made of them has been written itself."""
    for df in written_tables:
        if path := _paths.pop(df, None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """The name with underscores before it, so that no column's name begins with it."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name = f"_{name}"
    return name


def without(docs: DataFrame, names: list[str]) -> list[str]:
    """The columns of `docs` but those that an operator puts out itself."""
    return [c for c in docs.columns if c.lower() not in names]


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sliced(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut to about so many bytes of text, to bound what a task holds."""
    for batch in batches:
        col = column(batch, text)
        sizes = np.diff(np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + len(col) + 1]) if len(col) else np.zeros(0, int)
        start = size = 0
        for k, n in enumerate(sizes):
            if size and size + n > most_bytes:
                yield batch.slice(start, k - start)
                start, size = k, 0
            size += int(n)
        if start < len(sizes):
            yield batch.slice(start)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of (a, b) links; root: the least node reachable.

    Labels spread along links and then jump to the label of their label, so that the number
    of rounds is about logarithmic in the length of a chain.  Every join has a written table
    on either side and nothing above it needs a key's rows together, so AQE can split the
    links of a node with very many.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b"), f"{name}-links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), f"{name}-labels")
    while True:
        heard = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "root")
        spread = written(heard.unionByName(labels).groupBy("node").agg(F.min("root").alias("root")), f"{name}-spread")
        up = spread.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = written(spread.join(up, "root").select("node", F.least("root", "top").alias("root")), f"{name}-jumped")
        moved = jumped.join(labels.select("node", F.col("root").alias("was")), "node").where("root <> was").limit(1).count()
        release(spread, labels)
        if not moved:
            release(both)
            return jumped
        labels = jumped
