"""Token estimates, prices and savings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .pytext import let, text, word_count

# Dollars for a token by model family, in order of matching, and the price of others.
PRICES = ((("gpt-4o", "o1", "o3"), 2.5e-6), (("gpt-4",), 3e-5), (("claude",), 3e-6), (("gemini",), 7.5e-8))
OTHER_PRICE = 1e-5
# Percent of the plain estimate by family, in order of matching.
SCALES = ((("claude",), 105), (("gemini",), 108), (("gpt-4o", "o1", "o3"), 85))


def _family(model: Column, names: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for n in names:
        found = found | F.contains(F.lower(model), F.lit(n))
    return found


def _by_family(model: Column, table, other: Column) -> Column:
    out = other
    for names, value in reversed(table):
        out = F.when(_family(model, names), value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def price(model: Column) -> Column:
    return _by_family(model, PRICES, F.lit(OTHER_PRICE))


def sizes(c: Column) -> Column:
    """chars and words of a text: all that its tokens under any model need."""
    return let(text(c), lambda t: F.struct(F.length(t).alias("chars"), word_count(t).cast("long").alias("words")))


def count_tokens(c: Column, model: Column | str = "gpt-4") -> Column:
    """1.3 tokens a word, scaled by family; a text of white space alone has a token for four
    characters, one at least; an empty or null text has none."""
    return let(sizes(c), lambda s: tokens_of(s, model))


def tokens_of(size: Column, model: Column | str = "gpt-4") -> Column:
    """The tokens of a text by its `sizes`."""
    model = F.lit(model) if isinstance(model, str) else model
    div = lambda a, b: F.floor(a / b).cast("long")
    one = F.lit(1).cast("long")

    def scaled(plain: Column) -> Column:
        return _by_family(model, tuple((n, div(plain * percent, 100)) for n, percent in SCALES), plain)

    chars, words = size["chars"], size["words"]
    some = let(F.greatest(one, div(words * 130, 100)), scaled)
    return F.when(chars == 0, F.lit(0).cast("long")).when(words == 0, F.greatest(one, div(chars, 4))).otherwise(some)


def true_tokens(c: Column, vocabulary: str) -> Column:
    """Tokens by the `tokenizers` library and a vocabulary file that every executor has, in
    place of the estimate; an empty or null text has none."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.encode_special_tokens = True  # their strings are ordinary text
        for some in texts:
            yield pd.Series([len(e.ids) for e in tokenizer.encode_batch_fast(some.tolist(), add_special_tokens=False)], dtype="int64")

    return count(text(c))


def byte_proxy(content: Column) -> Column:
    """Raw tokens of a file: half its bytes."""
    return F.floor(F.octet_length(content) / 2).cast("long")


def savings(raw_tokens: Column, tokens: Column, model: Column | str = "gpt-4", exact: bool = False) -> dict[str, Column]:
    """raw_tokens, markdown_tokens, tokens_saved, savings_percentage and dollars_saved.

    Rounding is by `bround` and `round`, which differ from Python's in the last place for
    rare ties; `exact` rounds the binary values in an Arrow UDF.
    """
    model = F.lit(model) if isinstance(model, str) else model
    some = raw_tokens > 0
    saved = F.when(some, F.greatest(F.lit(0).cast("long"), raw_tokens - tokens)).otherwise(F.lit(0).cast("long"))
    share, dollars = saved / raw_tokens * 100.0, saved * price(model)
    percentage, paid = (_rounded(share, 2), _rounded(dollars, 6)) if exact else (F.bround(share, 2), F.round(dollars, 6))
    zero = F.lit(0.0)
    return {
        "raw_tokens": F.when(some, raw_tokens).otherwise(F.lit(0).cast("long")), "markdown_tokens": tokens, "tokens_saved": saved,
        "savings_percentage": F.when(some, percentage).otherwise(zero), "dollars_saved": F.when(some, paid).otherwise(zero),
    }


def _rounded(c: Column, digits: int) -> Column:
    @F.pandas_udf("double")
    def as_python(values: pd.Series) -> pd.Series:
        return values.map(lambda x: round(x, digits), na_action="ignore")

    return as_python(c)


def popup_tokens(c: Column) -> Column:
    """A token for four characters, rounded up (by code points)."""
    return F.ceil(F.length(text(c)) / 4).cast("long")
