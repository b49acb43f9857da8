"""The operators on streams.  They keep no state between rows, so a stream of documents or
prompts goes through the same transforms; windowed totals of savings need a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators.package import Options, normalize
from ..operators.prompt import optimize_prompts


def read_parquet_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def normalize_stream(docs: DataFrame, options: Options = Options(), **columns: str) -> DataFrame:
    return normalize(docs, options=options, **columns)


def optimize_stream(prompts: DataFrame, prompt: str = "prompt", model: str = "gpt-4") -> DataFrame:
    return optimize_prompts(prompts, prompt, model)


def savings_by_window(optimized: DataFrame, ts: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Prompts and tokens saved by event-time window; later rows than `late` are left out."""
    timed = optimized.withWatermark(ts, late)
    return timed.groupBy(F.window(ts, window)).agg(F.count("*").alias("prompts"), F.sum("tokens_saved").alias("tokens_saved"))


def write_stream(df: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """A writer to Parquet, or through `each` for transforms that shuffle by document."""
    out = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return out.foreachBatch(each) if each else out.format("parquet").option("path", path)
