"""License scans by ordered signature rules, by DataFrame functions alone.

A text's words are written `<one><two>`, so that a signature starts and ends at words and its
places can be counted in words.  A rule is tried only where the text has its keyword: the words
are intersected with all keywords, by a hash set, so that a text without any costs no pattern.
Each text is scanned where it lies: nothing is shuffled.

A detection is suppressed where another contains its interval of words and is of its tier or a
better one; of equal intervals in one tier the earlier rule stays.  Base phrases always stay.
Overlaps that don't contain one another all stay.  Prefix maxima by doubling find what contains a
detection in n log n steps, however many a long text has.

A null text is empty: no words, no detections, a score of 0.  A row is scanned by itself, so that
repeated rows, null ids and further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import RULES, Rule
from .shared import without

#: What words are not made of, after A-Z became a-z (fixed by the contract).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Score of a text by the best tier that stays.
CONFIDENCE = {1: 0.95, 2: 0.8, 3: 0.4}

_MARK = "#"  # is in no marked text


def lowered(text: Column) -> Column:
    """A-Z to a-z.  Other letters may change too, to none of ASCII: the two that would are taken out."""
    return F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ß")), F.lit("İ"), F.lit("ß")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], nothing: Column) -> Column:
    """By element: all up to it combined; by doubling, in n log n steps.  `nothing` changes nothing."""
    n = F.size(values)
    rounds = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def twice(sofar: Column, k: Column) -> Column:
        shifted = F.slice(F.concat(F.array_repeat(nothing, F.pow(F.lit(2), k).cast("int")), sofar), F.lit(1), F.size(sofar))
        return F.zip_with(sofar, shifted, combine)

    return F.aggregate(rounds, values, twice)


def _intervals(text: Column, rule: Column) -> Column:
    """(first word, word after the last) of each match: the text is cut at its matches, and words are counted by part."""
    parts = F.split(F.regexp_replace(text, rule["pattern"], F.lit(f"{_MARK}$0{_MARK}")), F.lit(_MARK), -1)
    words = F.transform(parts, lambda p: F.length(p) - F.length(F.replace(p, F.lit("<"), F.lit(""))))
    pairs = lambda n: F.when(F.size(n) > 1, F.sequence(F.lit(1), F.size(n) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    detection = lambda first, last: F.struct(
        first.alias("first"), (-last).alias("minus_end"), rule["tier"].alias("tier"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["base"].alias("base"),
    )
    return let(running(words, lambda a, b: a + b, F.lit(0)), lambda upto: F.transform(pairs(upto), lambda k: detection(F.get(upto, k - 1), F.get(upto, k))))


def _stays(found: Column) -> Column:
    """The detections, in order of their interval, with whether each stays."""
    upto = lambda d, tier: F.when(d["tier"] <= tier, -d["minus_end"]).otherwise(F.lit(0)).alias(f"t{tier}")
    reaches = F.transform(found, lambda d: F.struct(*(upto(d, t) for t in CONFIDENCE)))
    further = lambda a, b: F.struct(*(F.greatest(a[f"t{t}"], b[f"t{t}"]).alias(f"t{t}") for t in CONFIDENCE))
    furthest = running(reaches, further, F.struct(*(F.lit(0).alias(f"t{t}") for t in CONFIDENCE)))

    def judged(d: Column, k: Column, before: Column) -> Column:
        reach = F.get(before, k - 1)
        of_tier = F.coalesce(*(F.when(d["tier"] == t, reach[f"t{t}"]) for t in CONFIDENCE), F.lit(0))
        kept = d["base"] | (k == 0) | (of_tier < -d["minus_end"])
        return F.struct(d["first"].cast("long").alias("first_word"), (-d["minus_end"]).cast("long").alias("end_word"), d["tier"].alias("tier"), d["rule"].alias("rule"), d["label"].alias("label"), d["base"].alias("base"), kept.alias("kept"))

    return let(furthest, lambda before: F.transform(found, lambda d, k: judged(d, k, before)))


def scanned(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Adds n_words and `detections`, an array of (first_word, end_word, tier, rule, label, base,
    kept) in order of their place; words are numbered from 0 and end_word is the one after."""
    out = ("n_words", "detections")
    kept = [F.col(f"`{c}`") for c in without(docs, list(out))]
    book = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in rule._asdict().items())) for rule in rules))
    plain = F.trim(F.regexp_replace(lowered(F.col(f"`{text}`")), GAP, " "))
    keywords = F.array(*(F.lit(k) for k in sorted({r.keyword for r in rules})))
    split = lambda p: F.when(p != "", F.split(p, " ", -1)).otherwise(F.array().cast("array<string>"))
    marked = lambda p: F.concat(F.lit("<"), F.replace(p, F.lit(" "), F.lit("><")), F.lit(">"))

    def looked_up(p: Column, words: Column) -> Column:
        met = let(F.array_intersect(words, keywords), lambda hits: F.struct(hits.alias("hits"), F.when(F.size(hits) > 0, marked(p)).alias("marked")))
        return F.struct(F.size(words).cast("long").alias("n"), met.alias("met"))

    seen = let(plain, lambda p: let(split(p), lambda words: looked_up(p, words)))
    held = docs.select(*kept, seen.alias("_license"))
    hits, marks = F.col("_license.met.hits"), F.col("_license.met.marked")
    due = F.filter(book, lambda r: F.array_contains(hits, r["keyword"]))
    found = F.sort_array(F.flatten(F.transform(due, lambda r: _intervals(marks, r))))
    nothing = F.array().cast("array<struct<first_word:bigint,end_word:bigint,tier:int,rule:int,label:string,base:boolean,kept:boolean>>")
    detections = F.when(F.size(hits) > 0, let(found, _stays)).otherwise(nothing)
    return held.select(*kept, F.col("_license.n").alias("n_words"), detections.alias("detections"))


def _labels(detections: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")


def summarised(scans: DataFrame) -> DataFrame:
    """Adds to scans: n_base, first_word and last_word of base phrases, base_labels, labels, score."""
    base = F.filter("detections", lambda d: d["base"])
    stay = F.filter("detections", lambda d: d["kept"])
    tier = F.array_min(F.transform(stay, lambda d: d["tier"]))
    starts = F.transform(base, lambda d: d["first_word"])
    return scans.withColumns({
        "n_base": F.size(base).cast("long"), "first_word": F.array_min(starts), "last_word": F.array_max(starts),
        "base_labels": _labels(base), "labels": _labels(stay),
        "score": F.coalesce(*(F.when(tier == t, F.lit(c)) for t, c in CONFIDENCE.items()), F.lit(0.0)),
    })
