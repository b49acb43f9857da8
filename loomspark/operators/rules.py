"""Rewrite rules as phrases; patterns are built from them for either engine."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from ..functions.pytext import WS

# Fixed values.  Parts in brackets may be missing; white space must follow.
FILLERS = (
    "please", "could you [please]", "can you [please]", "would you [please] [be able to]", "I would like you to",
    "I want you to", "I need you to", "I was wondering if you could", "kindly", "just", "basically", "actually",
    "literally", "simply", "obviously", "of course",
)
POPUP_FILLERS = ("please", "could you [please]", "can you [please]", "would you [please]")
POPUP_FILLERS_ANY_CASE = ("I would like you to", "I want you to", "I need you to")
POPUP_LAST_FILLERS_ANY_CASE = ("just", "basically", "actually")
INLINE_FILLERS = (*POPUP_FILLERS, "I would like you to", "I want you to", "I need you to", "kindly")

# A phrase, whose first letter may be of either case, and what takes its place.
PHRASES = {
    "in order to": "To", "due to the fact that": "Because", "for the purpose of": "To", "in the event that": "If",
    "at this point in time": "Now", "at the present time": "Now", "in the near future": "Soon", "on a daily basis": "Daily",
    "it is important to note that": "Note:", "it should be noted that": "Note:", "it is worth mentioning that": "Note:",
    "as a matter of fact": "In fact", "for the sake of": "For", "with regard to": "Regarding", "with respect to": "Regarding",
    "in regard to": "Regarding", "in terms of": "Regarding", "as well as": "and", "each and every": "Every",
    "first and foremost": "First", "all of the": "All", "a large number of": "Many", "a majority of": "Most",
    "has the ability to": "Can", "is able to": "Can", "make sure that": "Ensure", "make sure to": "Ensure",
    "take into consideration": "Consider", "take into account": "Consider",
}
POPUP_PHRASES = {
    "in order to": "To", "due to the fact that": "Because", "for the purpose of": "To", "in the event that": "If",
    "it is important to note that": "Note:", "it should be noted that": "Note:", "make sure (?:that|to)": "Ensure",
    "all of the": "All", "a lot of": "Many", "is able to": "Can", "has the ability to": "Can",
}
INLINE_PHRASES = {k: v for k, v in POPUP_PHRASES.items() if k not in ("it should be noted that", "has the ability to")}

# Qualifiers in any case, with any white space between their words.
QUALIFIERS = {
    "very important": "important", "extremely important": "critical", "extremely critical": "critical", "very much": "greatly",
    "very good": "excellent", "very bad": "poor", "very big": "large", "very small": "tiny", "very fast": "rapid",
    "very easy": "simple", "very hard": "difficult", "quite a few": "several", "a lot of": "many", "the vast majority of": "most",
}
PASSIVES = {
    "it is recommended that": "Recommend:", "it is suggested that": "Suggest:", "it is required that": "Require:",
    "it is necessary to": "Must", "it is essential to": "Must", "it is advisable to": "Should", "there is a need to": "Need to",
    "there are several": "Several", "there are many": "Many", "there is no need to": "Do not",
}

# Names of stages that changed a text, in order.
TECHNIQUES = (
    "Filler word removal", "Redundant phrase compression", "Verbose qualifier stripping", "Passive voice simplification",
    "Instruction deduplication", "Markdown structuring", "Whitespace normalization",
)
REWRITTEN = "AI-powered semantic rewriting (Gemini)"


@dataclass(frozen=True)
class Rule:
    """A pattern of \\b, \\s and plain parts, what takes its place, and whether case counts."""

    pattern: str
    to: str
    any_case: bool


#: JavaScript's \\b knows ASCII letters alone.
_JS_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _java(r: Rule, javascript: bool) -> str:
    """The rule's pattern with its modes.  Its first letter is looked at before the word boundary
    is, which costs more at each place of a text."""
    p = r.pattern.replace(r"\s", WS)
    first = p.removeprefix(r"\b")
    first = first[: first.index("]") + 1] if first[0] == "[" else first[0]
    p = p.replace(r"\b", _JS_EDGE) if javascript else p
    modes = ("i" if r.any_case else "") + ("" if javascript else "U")
    return f"(?{modes}:(?={first}){p})" if modes else f"(?={first}){p}"


def java_patterns(some: Iterable[Rule], javascript: bool = False) -> list[tuple[str, str]]:
    """Patterns and what takes the place of a match."""
    return [(_java(r, javascript), r.to) for r in some]


def _either(phrase: str) -> str:
    return f"[{phrase[0].upper()}{phrase[0].lower()}]{phrase[1:]}"


def fillers(phrases: tuple[str, ...], any_case: bool = True) -> list[Rule]:
    out = []
    for phrase in phrases:
        head, *options = phrase.replace("]", "").split(" [")
        tail = "".join(rf"(?:{o}\s+)?" for o in options)
        out.append(Rule(rf"\b{head if any_case else _either(head)}\s+{tail}", "", any_case))
    return out


def phrases(table: dict[str, str], any_case: bool = False) -> list[Rule]:
    return [Rule(rf"\b{k if any_case else _either(k)}\b", v, any_case) for k, v in table.items()]


def qualifiers(table: dict[str, str]) -> list[Rule]:
    return [Rule(r"\b" + r"\s+".join(k.split()) + r"\b", v, True) for k, v in table.items()]


STAGES = (fillers(FILLERS), phrases(PHRASES), qualifiers(QUALIFIERS), phrases(PASSIVES))
POPUP_STAGES = (
    fillers(POPUP_FILLERS, False) + fillers(POPUP_FILLERS_ANY_CASE) + fillers(("kindly",), False) + fillers(POPUP_LAST_FILLERS_ANY_CASE),
    phrases(POPUP_PHRASES, any_case=True),
)
INLINE_STAGES = (fillers(INLINE_FILLERS), phrases(INLINE_PHRASES, any_case=True))
