"""String primitives with the semantics that Python's str and re have, as Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LATIN, _WIDE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0]", r"[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: What str.strip() and str.split() take for white space; Java's \\s misses some of it.  Java asks
#: the parts of a class one by one, for every character, so what is frequent comes first.
WS = f"[[^!-~]&&[{_LATIN}{_WIDE}]]"
NOT_WS = rf"[!-~[\xa1-\u167f[^{_LATIN}{_WIDE}]]]"


def begins(ascii_: Iterable[str]) -> str:
    """Before a pattern: lets it be tried only where a character of these stands, in any case, or one that
    isn't of ASCII.  That is one look at a table of bits, where word boundaries and cases cost far more."""
    some = {x for ch in ascii_ for x in (ch.lower(), ch.upper())}
    return "(?![" + "".join(f"\\x{k:02x}" for k in range(128) if chr(k) not in some) + "])"


def text(c: Column) -> Column:
    """Null is an empty text; it goes no farther than here."""
    return F.coalesce(c.cast("string"), F.lit(""))


#: The same characters by themselves, for trims, which look at the ends of a text alone.
SPACES = "".join(chr(k) for k in range(0x3001) if re.match(f"{_LATIN}|{_WIDE}", chr(k)))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def squeeze(c: Column, to: str = " ") -> Column:
    """Every run of white space becomes `to`."""
    return F.regexp_replace(c, f"{WS}+", to)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"{NOT_WS}+"))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), 0)


def running_sum(values: Column) -> Column:
    """By element: the sum of all up to it, in n log n steps: each round adds what lies twice as far back."""
    n = F.size(values)
    rounds = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    before = lambda sums, k: F.slice(F.concat(F.array_repeat(F.lit(0), F.pow(F.lit(2), k).cast("int")), sums), F.lit(1), F.size(sums))
    return F.aggregate(rounds, values, lambda sums, k: F.zip_with(sums, before(sums, k), lambda a, b: a + b))


def runs(keys: Column) -> Column:
    """(k, i, n) of each different key but null: where it is first and how often it comes, by a sort."""
    numbered = F.filter(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda s: s["k"].isNotNull())

    def counted(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, j: F.when((j == 0) | (x["k"] != F.get(s, j - 1)["k"]), j)), lambda j: j.isNotNull())
        run = lambda at, j, all_: F.struct(F.get(s, at)["k"].alias("k"), F.get(s, at)["i"].alias("i"), (F.coalesce(F.get(all_, j + 1), F.size(s)) - at).alias("n"))
        return let(starts, lambda all_: F.transform(all_, lambda at, j: run(at, j, all_)))

    return let(F.sort_array(numbered), counted)


def first_wins(items: Column, key: Callable[[Column], Column], counts: Callable[[Column], Column]) -> Column:
    """Items in order without those that count and whose key an earlier one had."""

    def kept(xs: Column, keys: Column) -> Column:
        free = F.filter(F.transform(keys, lambda k, i: F.when(k.isNull(), i)), lambda i: i.isNotNull())
        places = F.sort_array(F.concat(free, F.transform(runs(keys), lambda r: r["i"])))
        return F.transform(places, lambda i: F.get(xs, i))

    return let(items, lambda xs: let(F.transform(xs, lambda x: F.when(counts(x), key(x))), lambda keys: kept(xs, keys)))


def each(df: DataFrame, keys: list[str], items: Column, place: str, name: str) -> DataFrame:
    """keys, place (from 0) and item of every item.  An outer generator without its null rows: an
    inner one gets a filter on the array's size, which computes the array twice."""
    return df.select(*keys, F.posexplode_outer(items).alias(place, name)).where(F.col(place).isNotNull())
