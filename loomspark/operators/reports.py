"""Reports over a corpus: several groupings of one table in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SETS = (("role", "model"), ("role",), ("model", "technique"), ("technique",), ())


def savings_report(rewritten: DataFrame, sets: Sequence[Sequence[str]] = SETS, measures: Sequence[Column] | None = None) -> DataFrame:
    """One row for each group of each set of dimensions, with `grouping_id`: a bit for each dimension,
    the first one highest, that is 1 where the row is not grouped by it.

    `rewritten` has a row for each prompt with its `techniques` and tokens; grouped by technique, a
    prompt counts for each that changed it, under null if none did."""
    names = list(dict.fromkeys(d for s in sets for d in s))
    rows = rewritten
    if "technique" in names:
        rows = rows.select("*", F.explode_outer("techniques").alias("technique"), F.greatest(F.size("techniques"), F.lit(1)).alias("_copies"))
        first = F.col("technique").eqNullSafe(F.get("techniques", F.lit(0)))
    else:
        first = F.lit(True)
    # where technique is no dimension of a set, only a prompt's first row counts
    whole = F.grouping("technique") == 1 if "technique" in names else F.lit(True)
    rows = rows.withColumn("_first", first)
    total = lambda c: F.when(whole, F.sum(F.when(F.col("_first"), c))).otherwise(F.sum(c)).cast("long")
    if measures is None:
        measures = [total(F.lit(1)).alias("prompts"), total(F.col("raw_tokens")).alias("raw_tokens"), total(F.col("tokens_saved")).alias("tokens_saved")]
    grouped = rows.groupingSets([[F.col(d) for d in s] for s in sets], *[F.col(d) for d in names])
    return grouped.agg(F.grouping_id().cast("long").alias("grouping_id"), *measures).select(*names, "grouping_id", *(c for c in ("prompts", "raw_tokens", "tokens_saved")))
