"""Threshold-scaled sketches of documents, by DataFrame functions alone.

A sketch keeps every hash of a five-word shingle below a fixed fraction of the hash range,
and its `LEAST` least hashes where fewer are below.  Both rules survive a union, so sketches
of parts merge to the sketch of the whole.  Up to a bound that can be read from it, a sketch
holds all hashes of its text: the fraction, its last hash if that is above, or any bound if it
has fewer than `LEAST` hashes.  Two sketches are compared up to the lesser of their bounds,
from what they store alone: exactly for two texts of fewer than `LEAST` distinct shingles,
as estimates otherwise.  The share of a short document in a long one is unknown (null) where
the short one has no hash below the fraction; `containment_or_resemblance` then takes the
resemblance, which is 0.

Words are lower-cased.  A text of fewer than five words is one shingle; a null text is empty;
a text without words has the empty sketch, is like another such text by 1 and like any other
by 0.  Repeated rows get equal sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import with_next
from .shared import GAP_PATTERN

#: Share of all shingle hashes that a sketch retains, and how many hashes it has at least (all, if there are fewer).
FRACTION = 1 / 8
LEAST = 37
SHINGLE = 5


def _threshold(fraction: float) -> int:
    """The greatest hash below the fraction."""
    return int((1 << 64) * fraction) - (1 << 63) - 1


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def sketch(text: Column, fraction: float = FRACTION, shingle: int = SHINGLE) -> Column:
    """The sorted retained hashes of a text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP_PATTERN), lambda w: w != "")

    def hashes(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - shingle, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(shingle)]))

    def retained(hs: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(hs, lambda h: h <= F.lit(_threshold(fraction)))))
        return _let(low, lambda kept: F.when(F.size(kept) >= LEAST, kept).otherwise(F.slice(F.array_sort(F.array_distinct(hs)), 1, LEAST)))

    none = F.array().cast("array<bigint>")
    return _let(words, lambda ws: F.when(F.size(ws) == 0, none).otherwise(_let(hashes(ws), retained)))


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of both texts' shingles together."""

    def retained(both: Column) -> Column:
        low = F.filter(both, lambda h: h <= F.lit(_threshold(fraction)))
        return F.when(F.size(low) >= LEAST, low).otherwise(F.slice(both, 1, LEAST))

    return _let(F.array_sort(F.array_union(a, b)), retained)


def _bound(sk: Column, fraction: float) -> Column:
    """The sketch holds all hashes of its text up to here."""
    return F.when(F.size(sk) < LEAST, F.lit((1 << 63) - 1)).otherwise(F.greatest(F.element_at(sk, -1), F.lit(_threshold(fraction))))


def _compared(a: Column, b: Column, fraction: float, share) -> Column:
    """share(hashes of a, hashes of b) up to the bound that both sketches have."""
    up_to = lambda bound: share(F.filter(a, lambda h: h <= bound), F.filter(b, lambda h: h <= bound))
    none = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    return F.when(none == 2, 1.0).when(none == 1, 0.0).otherwise(_let(F.least(_bound(a, fraction), _bound(b, fraction)), up_to))


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of the smaller document's shingles that the other has too; null where
    the bound leaves no hash of it."""
    of = lambda x, y: F.least(F.size(x), F.size(y))
    return _compared(a, b, fraction, lambda x, y: F.when(of(x, y) > 0, F.size(F.array_intersect(x, y)) / of(x, y)))


def resemblance(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated Jaccard similarity."""
    return _compared(a, b, fraction, lambda x, y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def containment_or_resemblance(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    return F.coalesce(containment(a, b, fraction), resemblance(a, b, fraction))


def spelled(sk: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sk, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by the beginning of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch, edited, edited_sketch and next_sketch of every document, where
    `edited` mixes it with the next document by doc_id.  Texts are dealt by ranges of ids;
    their sketches are made once, after that."""
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    near = with_next(own, "doc_id", ["text"], ["text", "sketch"], derive={"sketch": sketch(F.col("text"))})
    mixed = near.select("doc_id", "text", "sketch", F.col("next_row.sketch").alias("next_sketch"), edited(F.col("text"), F.col("next_row.text")).alias("edited"))
    return mixed.withColumn("edited_sketch", sketch(F.col("edited")))
