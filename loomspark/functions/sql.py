"""SQL functions for the operators, as temporary functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import rules
from ..operators.entities import MONTHS
from .pytext import NOT_WS, SPACES, WS
from .tokens import OTHER_PRICE, PRICES, SCALES

_WORDS = f"regexp_count(t, r'{NOT_WS}+')"


def _by_family(table, value, other: str) -> str:
    """A CASE over a model's families, in order."""
    held = lambda names: " or ".join(f"contains(lower(m), '{n}')" for n in names)
    return "case " + " ".join(f"when {held(names)} then {value(v)}" for names, v in table) + f" else {other} end"


_PLAIN = f"greatest(1, {_WORDS} * 130 div 100)"
_SCALED = _by_family(SCALES, lambda percent: f"{_PLAIN} * {percent} div 100", _PLAIN)

# --- bodies made from the same tables as the columns ---

_SPACE = "'" + "".join(f"\\u{ord(ch):04x}" for ch in SPACES) + "'"


def _strip(x: str) -> str:
    return f"btrim({x}, {_SPACE})"


def _let(value: str, name: str, body: str) -> str:
    """The body with the value under a name, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _lines(x: str, each: str) -> str:
    """The text with every line x as `each` makes it."""
    return f"array_join(transform(split({x}, '\\n', -1), x -> {each}), '\\n')"


def _replaced(x: str, some: list[rules.Rule]) -> str:
    for pattern, to in rules.java_patterns(some):
        x = f"regexp_replace({x}, r'{pattern}', '{to}')"
    return x


def _syntax() -> str:
    heading, item = rf"^{WS}*(#+){WS}+", rf"^({WS}*)([-*+]|[0-9]+\.){WS}+"
    even = lambda x: _strip(f"regexp_replace({x}, r'[ \t]+', ' ')")
    rest = lambda p: even(f"regexp_replace(x, r'{p}', '')")
    line = f"""case when x rlike r'{heading}' then concat(regexp_extract(x, r'{heading}', 1), ' ', {rest(heading)})
      when x rlike r'{item}' then concat(regexp_extract(x, r'{item}', 1), regexp_extract(x, r'{item}', 2), ' ', {rest(item)}) else {even("x")} end"""
    return _strip(_lines("coalesce(t, '')", line))


def _deduplicated() -> str:
    """Lines whose key of 15 characters or more came before go; places are told apart by a sort."""
    key = f"lower(regexp_replace({_strip('x')}, r'{WS}+', ' '))"
    starts = "transform(filter(s, (x, j) -> j = 0 or x.k <> get(s, j - 1).k), x -> x.i)"
    free = "transform(filter(ks, x -> length(x.k) < 15), x -> x.i)"
    kept = _let("sort_array(filter(ks, x -> length(x.k) >= 15))", "s", f"sort_array(concat({free}, {starts}))")
    places = _let(f"transform(xs, (x, i) -> named_struct('k', {key}, 'i', i))", "ks", kept)
    return _let("split(coalesce(t, ''), '\\n', -1)", "xs", f"array_join(transform({places}, i -> get(xs, i)), '\\n')")


def _structured() -> str:
    label, number = r"^([A-Z][A-Za-z0-9 /&,]{2,50}):" + WS + r"*\z", r"(?Ud)^(\d+)[.)]" + WS + r"+(.+)\z"
    line = f"""case when startswith(s, '#') then x when s rlike r'{label}' then concat('## ', {_strip(f"regexp_extract(s, r'{label}', 1)")})
      when s rlike r'{number}' then concat(regexp_extract(s, r'{number}', 1), '. ', regexp_extract(s, r'{number}', 2)) else x end"""
    return _lines("coalesce(t, '')", _let(_strip("x"), "s", line))


def _even() -> str:
    squeezed = "regexp_replace(regexp_replace(coalesce(t, ''), r'[ \t]+', ' '), r'\n{3,}', '\\n\\n')"
    return _strip(_lines(squeezed, f"trim(trailing {_SPACE} from x)"))


_CAPITAL = r"case when substring(t, 1, 1) rlike r'^\p{javaLowerCase}' then concat(upper(substring(t, 1, 1)), substring(t, 2)) else t end"
_ISO = r"(?U)^\d{4}-\d{2}-\d{2}\z", rf"(?U)^(\d{{1,2}}){WS}+([a-z]+){WS}+(\d{{4}})\z"


def _iso() -> str:
    plain, spelled = _ISO
    months = " ".join(f"when regexp_extract(d, r'{spelled}', 2) in ('{m.lower()}', '{m[:3].lower()}') then '{k:02d}'" for k, m in enumerate(MONTHS, 1))
    part = lambda k: f"regexp_extract(d, r'{spelled}', {k})"
    date = f"concat({part(3)}, '-', case {months} end, '-', lpad({part(1)}, 2, '0'))"
    text = "coalesce(t, '')"
    return _let(f"lower({_strip(text)})", "d", f"case when d rlike r'{plain}' then d else coalesce(case when d rlike r'{spelled}' then {date} end, t, '') end")


_STAGES = ("loom_strip_filler", "loom_compress_phrases", "loom_strip_qualifiers", "loom_simplify_passive", "loom_dedup_instructions", "loom_structure_markdown", "loom_normalize_ws")


def _optimized() -> str:
    x = "t"
    for name in _STAGES:
        x = f"{name}({x})"
    return f"loom_capitalized({x})"


_SAVED = "greatest(0, raw - kept)"
_SHARE = f"case when raw > 0 then bround({_SAVED} / raw * 100.0D, 2) else 0.0D end"

FUNCTIONS = {
    "loom_word_count": ("t STRING", "BIGINT", f"cast(coalesce({_WORDS}, 0) as bigint)"),
    "loom_tokens": ("t STRING, m STRING DEFAULT 'gpt-4'", "BIGINT", f"case when coalesce(t, '') = '' then 0 when {_WORDS} = 0 then greatest(1, length(t) div 4) else {_SCALED} end"),
    "loom_price": ("m STRING", "DOUBLE", _by_family(PRICES, lambda dollars: f"{dollars!r}D", f"{OTHER_PRICE!r}D")),
    "loom_compress_syntax": ("t STRING", "STRING", _syntax()),
    **{name: ("t STRING", "STRING", _replaced("coalesce(t, '')", some)) for name, some in zip(_STAGES, rules.STAGES, strict=False)},
    "loom_dedup_instructions": ("t STRING", "STRING", _deduplicated()),
    "loom_structure_markdown": ("t STRING", "STRING", _structured()),
    "loom_normalize_ws": ("t STRING", "STRING", _even()),
    "loom_capitalized": ("t STRING", "STRING", _CAPITAL),
    "loom_optimize": ("t STRING", "STRING", _optimized()),
    "loom_iso_date": ("t STRING", "STRING", _iso()),
    "loom_savings": (
        "raw BIGINT, kept BIGINT, m STRING DEFAULT 'gpt-4'", "STRUCT<tokens_saved: BIGINT, savings_percentage: DOUBLE, dollars_saved: DOUBLE>",
        f"named_struct('tokens_saved', case when raw > 0 then {_SAVED} else 0L end, 'savings_percentage', {_SHARE}, 'dollars_saved', case when raw > 0 then round({_SAVED} * loom_price(m), 6) else 0.0D end)",
    ),
    "loom_saved": ("raw BIGINT, kept BIGINT", "BIGINT", "greatest(0, raw - kept)"),
}


def register(spark: SparkSession) -> None:
    for name, (arguments, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
