"""Entities by pattern, with the sentence around them, and dates in ISO form."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import WS, begins, each, first_wins, let, running_sum, strip, text

# Suffixes of organisations, names of technologies and places, months.
SUFFIXES = ("Corp", "Corporation", "Inc", "LLC", "Ltd", "Group", "Holdings", "Solutions", "Systems", "Technologies", "University", "Institute")
TECHNOLOGIES = ("Python", "FastAPI", "Pydantic", "Docker", "PostgreSQL", "Celery", "Redis", "Qdrant", "TypeScript", r"Next\.js", "Gemini", "Claude", "ChatGPT", "LLM", "RAG", "SQLAlchemy")
PLACES = (
    "New York", "San Francisco", "London", "Tokyo", "Paris", "Berlin", "California", "Texas", "Washington", "Boston",
    "Seattle", "India", "Germany", "Canada", "UK", "US", "USA", "United States", "United Kingdom",
)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

# Patterns by category, in the order in which they win; \s is Python's.
PATTERNS = {
    "Organization": r"(?U)\b[A-Z][a-zA-Z0-9&]+(?:\s+[A-Z][a-zA-Z0-9]+)*\s+(?:" + "|".join(SUFFIXES) + r")\b",
    "Date": r"(?U)\b(?:\d{1,2}\s+(?:" + "|".join(MONTHS) + r")\s+\d{4}|\d{4}-\d{2}-\d{2})\b",
    "Technology": r"(?iU)\b(?:" + "|".join(TECHNOLOGIES) + r")\b",
    "Email": r"(?U)\b[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
    "Phone": r"(?U)(?:^|(?<=\s))\+?\d{1,3}[-.\s]?\(?\d{2,3}\)?[-.\s]?\d{3,4}[-.\s]?\d{4}\b",
    "Location": r"(?iU)\b(?:" + "|".join(PLACES) + r")\b",
    "Monetary": r"(?iU)(?:\$\d+(?:\.\d+)?(?:\s*(?:million|billion|M|B))?|\b\d+(?:\.\d+)?\s*(?:USD|EUR|GBP|dollars)\b)",
}
#: What a match of each can begin with, of ASCII and in lower case.
_DIGITS = "0123456789"
BEGINS = {
    "Organization": string.ascii_lowercase, "Date": _DIGITS, "Technology": {w[0].lower() for w in TECHNOLOGIES}, "Email": string.ascii_lowercase + _DIGITS + "._%+-",
    "Phone": "+" + _DIGITS, "Location": {w[0].lower() for w in PLACES}, "Monetary": "$" + _DIGITS,
}
#: Characters of context after an entity that no full stop follows.
TAIL = 50
#: Put around the matches of a text: no character of Unicode.
MARK = "\uffff"


def pattern(category: str) -> str:
    p = PATTERNS[category].replace(r"[-.\s]", f"[-.{WS}]")
    return begins(BEGINS[category]) + p.replace(r"\s", WS)


def names(c: Column, category: str) -> Column:
    return F.regexp_extract_all(text(c), F.lit(pattern(category)), 0)


def iso_date(c: Column) -> Column:
    """D Month YYYY as YYYY-MM-DD, without a look at the calendar; all else as it is."""
    clean = F.lower(strip(text(c)))
    spelled = rf"(?U)^(\d{{1,2}}){WS}+([a-z]+){WS}+(\d{{4}})\z"
    word = F.regexp_extract(clean, spelled, 2)
    month = F.lit(None).cast("string")
    for k, name in enumerate(MONTHS, 1):
        month = F.when(word.isin(name.lower(), name[:3].lower()), f"{k:02d}").otherwise(month)
    day = F.lpad(F.regexp_extract(clean, spelled, 1), 2, "0")
    iso = F.concat_ws("-", F.regexp_extract(clean, spelled, 3), month, day)
    return F.when(clean.rlike(r"(?U)^\d{4}-\d{2}-\d{2}\z"), clean).when(clean.rlike(spelled) & month.isNotNull(), iso).otherwise(text(c))


def found(t: Column, category: str) -> Column:
    """name and context of every match: offsets are the running sum of what lies between."""

    def located(parts: Column) -> Column:
        # matches lie between gaps; every part ends at a running sum
        at = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
        ends = running_sum(F.transform(parts, F.length))
        return let(ends, lambda upto: F.transform(at, lambda k: _entity(t, F.get(parts, k), F.get(parts, k - 1), F.get(parts, k + 1), F.get(upto, k - 1), category)))

    none = F.array().cast("array<struct<name:string,category:string,context:string>>")
    return let(_parts(t, pattern(category)), lambda parts: F.when(F.size(parts) == 1, none).otherwise(located(parts)))


def _parts(t: Column, p: str) -> Column:
    """What lies before, between and behind the matches, and the matches, by turns: by one search that marks
    them; a text that has the mark is searched twice."""

    def paired(ms: Column) -> Column:
        return F.flatten(F.transform(F.split(t, p, -1), lambda g, k: F.when(k < F.size(ms), F.array(g, F.get(ms, k))).otherwise(F.array(g))))

    marked = F.split(F.regexp_replace(t, p, f"{MARK}$0{MARK}"), MARK, -1)
    return F.when(F.contains(t, F.lit(MARK)), let(F.regexp_extract_all(t, F.lit(p), 0), paired)).otherwise(marked)


def _entity(t: Column, m: Column, before: Column, after: Column, start: Column, category: str) -> Column:
    """The match with its sentence, which most often begins and ends in the gaps beside it."""
    left = F.when(F.contains(before, F.lit(".")), before).otherwise(F.substring(t, F.lit(1), start))

    def rest(right: Column) -> Column:
        return let(F.instr(right, "."), lambda dot: F.when(dot > 0, F.substring(right, F.lit(1), dot)).otherwise(F.substring(right, 1, TAIL)))

    right = F.when(F.contains(after, F.lit(".")), after).otherwise(F.substring(t, start + F.length(m) + 1, F.length(t)))
    context = F.replace(strip(F.concat(F.substring_index(left, ".", -1), m, let(right, rest))), F.lit("\n"), F.lit(" "))
    return F.struct((iso_date(m) if category == "Date" else m).alias("name"), F.lit(category).alias("category"), context.alias("context"))


def entities(c: Column) -> Column:
    """All entities in order of category and place; of those with one name (in any case) and
    category, the first."""
    all_ = lambda t: F.concat(*[found(t, k) for k in PATTERNS])
    key = lambda e: F.concat(F.lower(e["name"]), F.lit("\n"), e["category"])

    return let(text(c), lambda t: first_wins(all_(t), key, lambda _: F.lit(True)))


def exploded(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, ord, name, category, context)."""
    return each(df, [key], entities(F.col(column)), "ord", "e").select(key, "ord", "e.name", "e.category", "e.context")
