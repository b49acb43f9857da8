"""Boilerplate removal and Markdown syntax compression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import WS, begins, each, first_wins, let, lines, runs, squeeze, strip, text

# Fixed value: what marks a line as boilerplate, anywhere in it and in any case.
BOILERPLATE = begins("pca0123456789") + rf"(?iU)(page\s+\d+\s+of\s+\d+|confidential|copyright\s+©\s+\d{{4}}|all\s+rights\s+reserved|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\b\d+\s+of\s+\d+\b)"
PAGE_BREAK = "\n+---\n+"
#: Margin lines looked at on either end of a page, and pages from which on they are.
MARGIN, LEAST_PAGES = 2, 3
#: Lines longer than this are kept once in a document.
LONG_LINE = 50


def is_boilerplate(line: Column) -> Column:
    return strip(line).rlike(BOILERPLATE.replace(r"\s", WS))


def pages(c: Column) -> Column:
    return F.split(text(c), PAGE_BREAK, -1)


def _normal(line: Column) -> Column:
    return F.lower(squeeze(strip(line)))


def margins(page: Column, last: bool) -> Column:
    """Normalised lines at the top (or bottom) of a page, without headings and tables."""
    shown = F.filter(F.transform(lines(page), _normal), lambda x: x != "")
    some = F.slice(F.reverse(shown) if last else shown, 1, MARGIN)
    return F.filter(some, lambda x: ~(F.startswith(x, F.lit("#")) | F.startswith(x, F.lit("|"))))


def running_lines(c: Column) -> Column:
    """Normalised headers and footers that half of the pages or more have, in a row's own text."""

    def frequent(ps: Column, last: bool) -> Column:
        found = F.flatten(F.transform(ps, lambda p: margins(p, last)))
        return F.transform(F.filter(runs(found), lambda r: r["n"] * 2 >= F.size(ps)), lambda r: r["k"])

    none = F.array().cast("array<string>")
    return let(pages(c), lambda ps: F.when(F.size(ps) >= LEAST_PAGES, F.array_union(frequent(ps, False), frequent(ps, True))).otherwise(none))


def running_lines_of(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, line): the same over a table whose documents may be too long for an expression,
    as counts by document and line."""
    ps = each(df, [key], pages(F.col(column)), "page", "p")
    n = ps.groupBy(key).agg(F.count("*").alias("n")).where(f"n >= {LEAST_PAGES}")
    sides = [ps.select(key, F.lit(k).alias("side"), F.explode(margins(F.col("p"), last)).alias("line")) for k, last in enumerate((False, True))]
    counts = sides[0].union(sides[1]).groupBy(key, "side", "line").agg(F.count("*").alias("c"))
    return counts.join(n, key).where("2 * c >= n").select(key, "line").distinct()


def strip_bloat(c: Column) -> Column:
    """Without boilerplate, running headers and footers, and repeats of long lines."""

    def cleaned(t: Column, running: Column) -> Column:
        # most documents have no running lines to compare with
        runs_on = lambda x: F.when(F.size(running) > 0, F.array_contains(running, _normal(x))).otherwise(False)
        left = F.filter(lines(t), lambda x: (strip(x) == "") | ~(is_boilerplate(x) | runs_on(x)))
        once = first_wins(left, lambda x: F.lower(squeeze(strip(x), "")), lambda x: F.length(strip(x)) > LONG_LINE)
        even = F.transform(once, lambda x: F.when(strip(x) == "", F.lit("")).otherwise(x))
        return strip(F.regexp_replace(F.array_join(even, "\n"), "\n{3,}", "\n\n"))

    return let(text(c), lambda t: let(running_lines(t), lambda running: cleaned(t, running)))


_HEADING, _ITEM = rf"^{WS}*(#+){WS}+", rf"^({WS}*)([-*+]|[0-9]+\.){WS}+"


def compress_syntax(c: Column) -> Column:
    """One blank between words, after a heading's marks and after a list's bullet."""

    def even(x: Column) -> Column:
        """Most lines have single blanks alone, which needs no pattern."""
        uneven = F.contains(x, F.lit("  ")) | F.contains(x, F.lit("\t"))
        return strip(F.when(uneven, F.regexp_replace(x, "[ \t]+", " ")).otherwise(x))

    def line(x: Column) -> Column:
        heading = F.concat(F.regexp_extract(x, _HEADING, 1), F.lit(" "), let(F.regexp_replace(x, _HEADING, ""), even))
        item = F.concat(F.regexp_extract(x, _ITEM, 1), F.regexp_extract(x, _ITEM, 2), F.lit(" "), let(F.regexp_replace(x, _ITEM, ""), even))
        return F.when(x.rlike(_HEADING), heading).when(x.rlike(_ITEM), item).otherwise(even(x))

    return strip(F.array_join(F.transform(lines(text(c)), line), "\n"))


def compressed(c: Column, deduplicate_boilerplate: bool = True) -> Column:
    return compress_syntax(strip_bloat(c) if deduplicate_boilerplate else text(c))
