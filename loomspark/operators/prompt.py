"""Prompt rewriting: seven stages in order, and the names of those that changed the text."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import WS, first_wins, lines, rstrip, squeeze, strip, text
from ..functions.tokens import count_tokens, popup_tokens, savings
from . import rules
from .external import Limits, called
from .rules import Rule

def apply_rules(c: Column, some: Iterable[Rule], javascript: bool = False) -> Column:
    """The rules one after the other; a text in which none of them matches is left at that."""
    patterns = rules.java_patterns(some, javascript)

    def all_(t: Column) -> Column:
        done = t
        for p, to in patterns:
            done = F.regexp_replace(done, p, to)
        return F.when(t.rlike("|".join(p for p, _ in patterns)), done).otherwise(t)

    return all_(c)


def strip_fillers(c: Column) -> Column:
    return apply_rules(c, rules.STAGES[0])


def compress_phrases(c: Column) -> Column:
    return apply_rules(c, rules.STAGES[1])


def strip_qualifiers(c: Column) -> Column:
    return apply_rules(c, rules.STAGES[2])


def simplify_passive(c: Column) -> Column:
    return apply_rules(c, rules.STAGES[3])


def dedup_instructions(c: Column, least: int = 15) -> Column:
    """Lines that repeat an earlier one go, but for case and white space; blank lines and
    those with a key shorter than `least` stay."""
    key = lambda x: F.lower(squeeze(strip(x)))
    return F.array_join(first_wins(lines(text(c)), key, lambda x: F.length(key(x)) >= least), "\n")


_LABEL = r"^([A-Z][A-Za-z0-9 /&,]{2,50}):" + WS + r"*\z"
_NUMBERED = r"(?Ud)^(\d+)[.)]" + WS + r"+(.+)\z"


def structure_markdown(c: Column) -> Column:
    """Labels become headings and numbered lines lose their indent; all else stays."""

    def line(x: Column) -> Column:
        s = strip(x)
        label = F.concat(F.lit("## "), strip(F.regexp_extract(s, _LABEL, 1)))
        number = F.concat(F.regexp_extract(s, _NUMBERED, 1), F.lit(". "), F.regexp_extract(s, _NUMBERED, 2))
        return F.when(F.startswith(s, F.lit("#")), x).when(s.rlike(_LABEL), label).when(s.rlike(_NUMBERED), number).otherwise(x)

    return F.array_join(F.transform(lines(text(c)), line), "\n")


def normalize_whitespace(c: Column) -> Column:
    squeezed = F.regexp_replace(F.regexp_replace(text(c), "[ \t]+", " "), "\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(lines(squeezed), rstrip), "\n"))


def capitalized(c: Column) -> Column:
    head = F.substring(c, 1, 1)
    return F.when(head.rlike(r"^\p{javaLowerCase}"), F.concat(F.upper(head), F.substring(c, F.lit(2), F.length(c)))).otherwise(c)


STAGES: tuple[Callable[[Column], Column], ...] = (strip_fillers, compress_phrases, strip_qualifiers, simplify_passive, dedup_instructions, structure_markdown, normalize_whitespace)


def optimize(
    df: DataFrame, prompt: str = "prompt", rewrite: Callable[[Column], Column] | None = None, service: Callable[[str], str | None] | None = None, limits: Limits = Limits()
) -> DataFrame:
    """Adds `optimized` and `techniques`.  A blank prompt becomes empty, by no technique.

    `rewrite` is a column function, such as a user's Arrow UDF; `service` a function of the
    rule-based text that calls a language model, for prompts that aren't blank alone.  What they
    give is stripped; where it is null or blank, or the service fails, the rule-based result stays.
    """
    blank = F.trim(squeeze(text(F.col(prompt)))) == ""
    out = df.withColumn("_0", F.when(blank, F.lit("")).otherwise(text(F.col(prompt))))
    for k, stage in enumerate(STAGES, 1):
        out = out.withColumn(f"_{k}", stage(F.col(f"_{k - 1}")))
    n = len(STAGES)
    fired = F.array_compact(F.array(*[F.when(F.col(f"_{k}") != F.col(f"_{k - 1}"), F.lit(name)) for k, name in enumerate(rules.TECHNIQUES, 1)]))
    out = out.withColumns({"techniques": F.when(blank, F.array().cast("array<string>")).otherwise(fired), "optimized": capitalized(F.col(f"_{n}"))})
    if rewrite is not None or service is not None:
        if service is not None:
            out = called(out, ~blank, ["optimized"], lambda: service, "_called", limits).withColumn("_new", F.col("_called.value")).drop("_called")
        else:
            out = out.withColumn("_new", rewrite(F.col("optimized")))
        done = F.coalesce(strip(F.col("_new")) != "", F.lit(False)) & ~blank
        out = out.withColumns({"optimized": F.when(done, strip(F.col("_new"))).otherwise(F.col("optimized")), "techniques": F.when(done, F.array_append("techniques", F.lit(rules.REWRITTEN))).otherwise(F.col("techniques"))}).drop("_new")
    return out.drop(*[f"_{k}" for k in range(n + 1)])


def optimize_prompts(df: DataFrame, prompt: str = "prompt", model: Column | str = "gpt-4", rewrite=None, exact: bool = False, service=None, limits: Limits = Limits()) -> DataFrame:
    """`optimize` with a status, an error for blank prompts, and savings against the original."""
    out = optimize(df, prompt, rewrite, service, limits)
    blank = strip(text(F.col(prompt))) == ""
    out = out.withColumns({"_raw": count_tokens(F.col(prompt), model), "_new": count_tokens(F.col("optimized"), model)})
    numbers = savings(F.col("_raw"), F.col("_new"), model, exact)
    status = {"status": F.when(blank, 400).otherwise(200), "error": F.when(blank, F.lit("Prompt text cannot be empty."))}
    return out.withColumns(numbers | status).drop("_raw", "_new")


def optimize_offline(df: DataFrame, prompt: str = "prompt", profile: str = "popup") -> DataFrame:
    """The shorter rule sets of browser clients: `popup` names its techniques and structures
    Markdown, `inline` only rewrites.  Adds optimized, techniques, tokens_saved and percentage."""
    out = df.withColumn("_0", text(F.col(prompt)))
    stages = rules.POPUP_STAGES if profile == "popup" else rules.INLINE_STAGES
    for k, stage in enumerate(stages, 1):
        out = out.withColumn(f"_{k}", apply_rules(F.col(f"_{k - 1}"), stage, javascript=True))
    out = out.withColumn("_3", structure_markdown(F.col("_2")) if profile == "popup" else F.col("_2"))
    out = out.withColumn("_4", strip(F.regexp_replace(F.regexp_replace(F.col("_3"), "[ \t]+", " "), "\n{3,}", "\n\n")))
    names = (rules.TECHNIQUES[0], rules.TECHNIQUES[1], rules.TECHNIQUES[5])
    fired = [F.when(F.col(f"_{k}") != F.col(f"_{k - 1}"), F.lit(n)) for k, n in enumerate(names, 1)]
    techniques = F.array_compact(F.array(*fired, F.lit(rules.TECHNIQUES[6]))) if profile == "popup" else F.array().cast("array<string>")
    head = F.substring("_4", 1, 1)
    upper = F.when(head.rlike("^[a-z]"), F.concat(F.upper(head), F.substring(F.col("_4"), F.lit(2), F.length("_4")))).otherwise(F.col("_4"))
    out = out.withColumns({"techniques": techniques, "optimized": upper})
    raw, new = popup_tokens(F.col("_0")), popup_tokens(F.col("optimized"))
    saved = F.greatest(F.lit(0).cast("long"), raw - new) if profile == "popup" else raw - new
    percentage = F.when(raw > 0, F.floor(saved / raw * 100 + 0.5)).otherwise(0).cast("long")
    return out.withColumns({"tokens_saved": saved, "percentage": percentage}).drop(*[f"_{k}" for k in range(5)])
