"""Mixing sources to target weights by hash-threshold histograms, by DataFrame functions alone.

Each document has a 60-bit hash.  A source takes whole passes over its documents and, for
the rest of its target, those with a hash below its threshold.  A histogram of words by source and hash
bucket finds the bucket in which the threshold lies; only that bucket is cut again, 4096-fold
each time, until a single hash is left, which is taken if that comes nearer to the target.
Nothing is sorted, smaller targets select subsets of larger ones, and reruns agree.

The driver gets one row for each source and level.  A null text has no words; a null source
is a source of its own, after all others; rows that are equal share a hash and are taken
together; an empty table gives an empty mix; other columns stay, but those with the name of an
output (mix_size, source_size, target, copies) give way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD_PATTERN, unused, without, written

BITS, LEVELS = 12, 5
#: Up to so many sources, thresholds are broadcast.
BROADCAST_SOURCES = 10_000


OUTPUTS = ["mix_size", "source_size", "target", "copies"]


def sized(docs: DataFrame, prefix: str = "mix_") -> DataFrame:
    """Adds by name after the prefix: size (words), hash (60 bits of an MD5 of id and text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text)
    return docs.withColumns({
        f"{prefix}size": F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"),
        f"{prefix}hash": F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long"),
    })


def shared_out(sizes: list[int], weights: list[int], total: float, most: float = 2.0) -> list[float]:
    """Targets by weight of at most `most` times a size, the excess reshared by weight."""
    targets, order = [0.0] * len(sizes), sorted(range(len(sizes)), key=lambda k: sizes[k] / weights[k])
    left, weight = total, sum(weights)
    for at, k in enumerate(order):
        if weights[k] * left / weight <= most * sizes[k]:
            for j in order[at:]:
                targets[j] = weights[j] * left / weight
            break
        targets[k] = most * sizes[k]
        left -= targets[k]
        weight -= weights[k]
    return targets


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """The documents with mix_size, source_size, target and copies (times each is taken)."""
    spark = docs.sparkSession
    slim = written(sized(docs.select("doc_id", "text", "source")).select("source", "mix_size", "mix_hash"), "mix-sizes")
    sums = {r.source: r.size for r in slim.groupBy("source").agg(F.sum("mix_size").alias("size")).collect()}
    names = sorted((s for s in sums if s is not None)) + [None] * (None in sums)
    sizes = [sums[s] for s in names]
    targets = shared_out(sizes, [weights[k % len(weights)] for k in range(len(names))], share * sum(sizes))
    full = [1 if t > s else 0 for t, s in zip(targets, sizes, strict=True)]
    ends = _thresholds(slim, names, [t - f * s for t, f, s in zip(targets, full, sizes, strict=True)])
    rows = list(zip(names, sizes, targets, full, ends, strict=True))
    own = unused("mix_", docs.columns)
    named = [f"{own}{c}" for c in ("source", "source_size", "target", "passes", "below")]
    table = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(named, ("string", "long", "double", "int", "long"), strict=True)))
    if len(rows) <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    whole = sized(docs, own).join(table, F.col("source").eqNullSafe(F.col(f"{own}source")))
    copies = F.col(f"{own}passes") + (F.col(f"{own}hash") < F.col(f"{own}below")).cast("int")
    made = [F.col(f"{own}size"), F.col(f"{own}source_size"), F.col(f"{own}target"), copies]
    return whole.select(*without(docs, OUTPUTS), *(c.alias(n) for c, n in zip(made, OUTPUTS, strict=True)))


def _thresholds(slim: DataFrame, names: list, budgets: list[float]) -> list[int]:
    """By source, the end of the hashes whose words come nearest to its budget."""
    spark, width = slim.sparkSession, BITS * LEVELS
    ends = [1 << width] * len(names)  # all of it, unless a bucket goes beyond the budget
    open_ = [(k, s, b, 0) for k, (s, b) in enumerate(zip(names, budgets, strict=True))]  # with the hashes' common prefix
    for level in range(1, LEVELS + 1):
        if not open_:
            break
        shift = width - BITS * level
        part = spark.createDataFrame(open_, "k int, s string, budget double, prefix long")
        part = F.broadcast(part) if len(open_) <= BROADCAST_SOURCES else part
        here = slim.join(part, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("mix_hash", shift + BITS) == F.col("prefix")))
        cells = here.groupBy("k", "budget", F.shiftright("mix_hash", shift).alias("bucket")).agg(F.sum("mix_size").alias("n"), F.min("mix_hash").alias("lo"), F.max("mix_hash").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("k").orderBy("bucket"))  # at most 4096 buckets each
        over = cells.withColumn("upto", upto).where("upto > budget")
        found = over.groupBy("k").agg(F.min_by(F.struct("bucket", "n", "upto", "lo", "hi"), "bucket").alias("b"))
        cut = {r.k: r.b for r in found.collect()}
        again = []
        for k, s, budget, _ in open_:
            if (b := cut.get(k)) is None:
                continue
            before = b.upto - b.n
            if b.lo < b.hi:
                again.append((k, s, budget - before, b.bucket))
            else:
                ends[k] = b.hi + 1 if budget - before >= b.upto - budget else b.lo
        open_ = again
    return ends
