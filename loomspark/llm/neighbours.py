"""The next row in ascending order of an id, over a whole table, without one task for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import parallelism

_LAST = (1 << 63) - 1
#: Most ranges that ids are dealt to.
MOST_RANGES = 20_000


def _range_of(bounds: list[int], key: Column) -> Column:
    """Bounds at or below the key, by binary search."""
    if not bounds:
        return F.lit(0)
    array, top = F.lit(bounds), 1 << (len(bounds).bit_length() - 1)
    steps = F.lit([top >> k for k in range(top.bit_length())])
    fits = lambda k, at, step: (at + step <= F.lit(len(bounds))) & (F.get(array, at + step - F.lit(1)) <= k)
    search = lambda k: F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(k, at, step), at + step).otherwise(at))
    # the key is an argument, as the planner infers filters of columns that it meets inside lambdas alone
    return F.get(F.transform(F.array(key), search), 0)


def with_next(df: DataFrame, key: str, ties: list[str], carry: list[str], out: str = "next_row", derive: dict[str, Column] | None = None) -> DataFrame:
    """Adds a struct of the `carry` columns of the next row by (key, ties), null keys last;
    after the last row comes the first.  A lone row follows itself.

    Ids are cut at their quantiles to ranges, each a window of its own; the last row of a
    range gets the first row of the next one by a join with a table of one row a range.  `derive` are columns made of a row's own once it has been dealt: they
    don't travel, and of the rows read for the ranges' heads only the heads make them.
    """
    spark = df.sparkSession
    n = min(MOST_RANGES, 4 * parallelism(spark))
    keyed = df.withColumn("_key", F.coalesce(F.col(key), F.lit(_LAST)))
    seen = keyed.agg(F.min("_key").alias("least"), F.percentile_approx("_key", [k / n for k in range(1, n)], 20 * n).alias("cuts")).first()
    bounds = sorted({c for c in seen.cuts or [] if c > seen.least})
    ranged = keyed.withColumn("_range", _range_of(bounds, F.col("_key")))
    order = [F.col("_key"), *(F.col(t) for t in ties)]
    carried = F.struct(*carry)
    # one row for each range: its size is bounded by MOST_RANGES
    least = F.broadcast(ranged.groupBy("_range").agg(F.min("_key").alias("_key")))
    own = [c for c in carry if c not in (derive or {})]
    head = F.min(F.struct(*(c.alias(f"_{k}") for k, c in enumerate(order)), *own)).alias("_head")
    heads = keyed.join(least, "_key").groupBy("_range").agg(head).select("_range", *(f"_head.{c}" for c in own)).withColumns(derive or {})
    first = heads.select(F.pmod(F.col("_range") - 1, F.lit(len(bounds) + 1)).alias("_range"), carried.alias("_first"))
    place = Window.partitionBy("_range").orderBy(*order)
    within = ranged.withColumn("_next", F.lead(F.struct(*own)).over(place))
    if derive:  # the first window has dealt and sorted the rows, and the second one finds them so
        within = within.withColumns(derive).withColumn("_made", F.lead(F.struct(*derive)).over(place))
        led = F.struct(*(F.col(f"_next.{c}") if c in own else F.col(f"_made.{c}") for c in carry))
        within = within.withColumn("_next", F.when(F.col("_next").isNotNull(), led))
    return within.join(first, "_range", "left").withColumn(out, F.coalesce("_next", "_first")).drop("_key", "_range", "_next", "_first", "_made")
