"""Queries of the engine's own operators over whole tables, and the same rows in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.pytext import each
from ..operators import chunk, compress, entities, package, prompt, rules
from ..sources import office, sinks, web
from . import seeds

MODELS = {"gpt4": "gpt-4", "gpt4o": "gpt-4o", "claude": "claude-3-5-sonnet", "gemini": "gemini-2.5-flash"}
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts in fewer partitions than there are cores are dealt to all of them, as
    the expressions over a text cost far more than moving it once."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages", "conversations") and df.rdd.getNumPartitions() < cores else df


def seeded(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    for t in tables:
        sql = sql.replace(f"from {t}\n", f"from {{{t}}}\n")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir, seeds.PROMPTS, "conversations")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir, seeds.DOCS, "documents")


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir, seeds.PAGED, "documents")


# --- SQL of the primitives (RE2 patterns; the seeds are ASCII where they matter) ---


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sub(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(to)}, '{flags}')"


def _strip(x: str) -> str:
    return _sub(x, r"^[\s\v]+|[\s\v]+$")


def _rules(x: str, some: list[rules.Rule]) -> str:
    for r in some:
        x = _sub(x, r.pattern, r.to, "gi" if r.any_case else "g")
    return x


def _words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[^\s\v]+'))"


def _tokens(x: str, model: str = "gpt-4") -> str:
    plain = f"greatest(1, {_words(x)} * 130 // 100)"
    scaled = next((f"({plain} * {percent} // 100)" for names, percent in tokens.SCALES if any(n in model for n in names)), plain)
    return f"(case when {x} = '' then 0 when {_words(x)} = 0 then greatest(1, length({x}) // 4) else {scaled} end)::bigint"


def _lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


def _unlines(x: str) -> str:
    return f"array_to_string({x}, chr(10))"


def _dedup(x: str) -> str:
    key = lambda v: f"lower({_sub(_strip(v), r'[\s\v]+', ' ')})"
    keys = f"list_transform({_lines(x)}, lambda v: {key('v')})"
    return _unlines(f"list_filter({_lines(x)}, lambda v, i: length({key('v')}) < 15 or list_position({keys}, {key('v')}) = i)")


def _structured(x: str) -> str:
    label, number, s = r"^([A-Z][A-Za-z0-9 /&,]{2,50}):\s*$", r"^(\d+)[.)]\s+(.+)$", _strip("v")
    line = f"""case when starts_with({s}, '#') then v when regexp_matches({s}, {_quoted(label)}) then '## ' || {_strip(f"regexp_extract({s}, {_quoted(label)}, 1)")}
      when regexp_matches({s}, {_quoted(number)}) then regexp_extract({s}, {_quoted(number)}, 1) || '. ' || regexp_extract({s}, {_quoted(number)}, 2) else v end"""
    return _unlines(f"list_transform({_lines(x)}, lambda v: {line})")


def _even(x: str) -> str:
    squeezed = _sub(f"regexp_replace({x}, '[ \\t]+', ' ', 'g')", r"\n{3,}", "\n\n")
    rstripped = _sub("v", r"[\s\v]+$")
    return _strip(_unlines(f"list_transform({_lines(squeezed)}, lambda v: {rstripped})"))


def _capital(x: str) -> str:
    return f"(case when regexp_matches({x}, '^\\p{{Ll}}') then upper({x}[1:1]) || {x}[2:] else {x} end)"


_STAGE_SQL = (*[lambda x, s=s: _rules(x, s) for s in rules.STAGES], _dedup, _structured, _even)


def _optimized_sql() -> str:
    out = [f"_s as ({seeds.PROMPTS})", f"_0 as (select *, case when {_strip('prompt')} = '' then '' else prompt end as t0 from _s)"]
    for k, stage in enumerate(_STAGE_SQL, 1):
        out.append(f"_{k} as (select *, {stage(f't{k - 1}')} as t{k} from _{k - 1})")
    fired = ", ".join(f"case when t{k - 1} <> t{k} then {_quoted(n)} end" for k, n in enumerate(rules.TECHNIQUES, 1))
    out.append(f"o as (select prompt_id, role, prompt, {_capital('t7')} as optimized, coalesce(array_to_string(list_filter([{fired}], lambda v: v is not null), '; '), '') as techniques from _7)")
    return "with " + ",\n".join(out)


def _stage_query(stage: Callable[[Column], Column], sql: Callable[[str], str]) -> tuple[Query, str]:
    return (
        lambda spark, d: prompts(spark, d).select("prompt_id", stage(F.col("prompt")).alias("result")),
        f"with s as ({seeds.PROMPTS}) select prompt_id, {sql('prompt')} as result from s",
    )


def _token_query(model: str) -> tuple[Query, str]:
    return (
        lambda spark, d: table(spark, d, "documents").select("doc_id", tokens.count_tokens(F.col("text"), model).alias("n_tokens")),
        f"select doc_id, {_tokens("coalesce(text, '')", model)} as n_tokens from documents",
    )


def _boilerplate_sql(x: str) -> str:
    p = r"page\s+\d+\s+of\s+\d+|confidential|copyright\s+©\s+\d{4}|all\s+rights\s+reserved|\d{1,2}/\d{1,2}/\d{2,4}|\b\d+\s+of\s+\d+\b"
    return f"regexp_matches({_strip(x)}, {_quoted(p)}, 'i')"


def _syntax_sql(x: str) -> str:
    even = lambda v: _strip(f"regexp_replace({v}, '[ \\t]+', ' ', 'g')")
    head, item = r"^\s*(#+)\s+", r"^(\s*)([-*+]|[0-9]+\.)\s+"
    cut = lambda p: even(f"regexp_replace(v, {_quoted(p)}, '')")
    part = lambda p, k: f"regexp_extract(v, {_quoted(p)}, {k})"
    line = f"""case when regexp_matches(v, {_quoted(head)}) then {part(head, 1)} || ' ' || {cut(head)}
      when regexp_matches(v, {_quoted(item)}) then {part(item, 1)} || {part(item, 2)} || ' ' || {cut(item)} else {even('v')} end"""
    return _strip(_unlines(f"list_transform({_lines(x)}, lambda v: {line})"))


def _normal_sql(x: str) -> str:
    return f"lower({_sub(_strip(x), r'[\s\v]+', ' ')})"


def _running_ctes(source: str) -> str:
    """p: document, page list; r: document and running lines, one of each."""
    shown = f"list_filter(list_transform({_lines('pg')}, lambda v: {_normal_sql('v')}), lambda v: v <> '')"
    side = lambda a: f"list_filter({a}, lambda v: not starts_with(v, '#') and not starts_with(v, '|'))"
    return f"""p as (select doc_id, unnest(regexp_split_to_array(markdown, '\\n+---\\n+')) as pg, len(regexp_split_to_array(markdown, '\\n+---\\n+')) as n from {source}),
      l as (select doc_id, n, {shown} as shown from p),
      c as (select doc_id, n, 0 as side, unnest({side('shown[1:2]')}) as line from l union all select doc_id, n, 1, unnest({side('list_reverse(shown)[1:2]')}) from l),
      r as (select distinct doc_id, line from (select doc_id, n, side, line, count(*) as k from c group by all) where n >= 3 and 2 * k >= n)"""


def _bloat_sql(source: str) -> str:
    """b: document and cleaned text."""
    return f"""{_running_ctes(source)},
      e as (select doc_id, unnest({_lines('markdown')}) as v, generate_subscripts({_lines('markdown')}, 1) as i from {source}),
      f as (select e.*, {_strip('v')} as s from e left join r on e.doc_id = r.doc_id and {_normal_sql('v')} = r.line where {_strip('v')} = '' or (r.line is null and not {_boilerplate_sql('v')})),
      g as (select *, row_number() over (partition by doc_id, case when length(s) > 50 then lower({_sub('s', r'[\s\v]+')}) else i::varchar end order by i) as rank from f),
      b as (select doc_id, {_strip(_sub("coalesce(string_agg(case when s = '' then '' else v end, chr(10) order by i), '')", r"\n{3,}", chr(10) * 2))} as cleaned from g where rank = 1 group by doc_id)"""


_ENTITY_SQL = {
    "Organization": (r"\b[A-Z][a-zA-Z0-9&]+(?:\s+[A-Z][a-zA-Z0-9]+)*\s+(?:" + "|".join(entities.SUFFIXES) + r")\b", 0, ""),
    "Date": (r"\b(?:\d{1,2}\s+(?:" + "|".join(entities.MONTHS) + r")\s+\d{4}|\d{4}-\d{2}-\d{2})\b", 0, ""),
    "Technology": (r"\b(?:" + "|".join(entities.TECHNOLOGIES) + r")\b", 0, "i"),
    "Email": (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", 0, ""),
    "Phone": (r"(?:^|\s)(\+?\d{1,3}[-.\s]?\(?\d{2,3}\)?[-.\s]?\d{3,4}[-.\s]?\d{4})\b", 1, ""),
    "Location": (r"\b(?:" + "|".join(entities.PLACES) + r")\b", 0, "i"),
    "Monetary": (r"\$\d+(?:\.\d+)?(?:\s*(?:million|billion|M|B))?|\b\d+(?:\.\d+)?\s*(?:USD|EUR|GBP|dollars)\b", 0, "i"),
}


def _entity_query(category: str) -> tuple[Query, str]:
    p, group, flags = _ENTITY_SQL[category]
    some = lambda spark, d: each(docs(spark, d), ["doc_id"], entities.names(F.col("markdown"), category), "ord", "name")
    if flags:
        p = f"(?{flags}){p}"
    found = f"regexp_extract_all(markdown, {_quoted(p)}, {group})"
    sql = f"with s as ({seeds.DOCS}), e as (select doc_id, unnest({found}) as name, generate_subscripts({found}, 1) - 1 as ord from s) select doc_id, ord::int as ord, name from e"
    return some, sql


def _context_query(category: str) -> tuple[Query, str]:
    p, _, flags = _ENTITY_SQL[category]
    p = f"(?{flags}){p}" if flags else p
    return (
        lambda spark, d: each(docs(spark, d), ["doc_id"], entities.found(F.col("markdown"), category), "ord", "e").select("doc_id", "ord", "e.name", "e.context"),
        f"""with s as ({seeds.DOCS}), m as (select doc_id, markdown, regexp_extract_all(markdown, {_quoted(p)}) as ms, regexp_split_to_array(markdown, {_quoted(p)}) as gs from s),
          u as (select doc_id, markdown, ms, gs, unnest(ms) as name, generate_subscripts(ms, 1) as i from m),
          o as (select *, (coalesce(list_sum(list_transform(gs[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))::bigint as pos from u),
          t as (select *, substr(markdown, 1, pos) as l, substr(markdown, pos + length(name) + 1) as r from o)
          select doc_id, (i - 1)::int as ord, name, replace({_strip("regexp_extract(l, '[^.]*$') || name || case when contains(r, '.') then substr(r, 1, instr(r, '.')) else substr(r, 1, 50) end")}, chr(10), ' ') as context from t""",
    )


def _iso_sql(x: str) -> str:
    p = r"^(\d{1,2})\s+([a-z]+)\s+(\d{4})$"
    clean = f"lower({_strip(x)})"
    month = "case " + " ".join(f"when regexp_extract({clean}, {_quoted(p)}, 2) in ('{m.lower()}', '{m[:3].lower()}') then '{k:02d}'" for k, m in enumerate(entities.MONTHS, 1)) + " end"
    iso = f"regexp_extract({clean}, {_quoted(p)}, 3) || '-' || {month} || '-' || lpad(regexp_extract({clean}, {_quoted(p)}, 1), 2, '0')"
    return f"case when regexp_matches({clean}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') then {clean} else coalesce({iso}, {x}) end"


_DATES = "select doc_id, concat(case when doc_id % 3 = 0 then ' ' else '' end, case doc_id % 6 when 0 then concat(doc_id % 31 + 1, ' June 2026') when 1 then concat(doc_id % 99, ' sep ', 1900 + doc_id % 200) when 2 then '2026-06-12' when 3 then '3 Sept 2020' when 4 then 'soon' else concat(doc_id % 9, '  DECEMBER  1999') end) as d from documents"
_PATHS = "select doc_id, concat('/in/file', doc_id, case doc_id % 7 when 0 then '.PDF' when 1 then '.docx' when 2 then '.pptx' when 3 then '.jpeg' when 4 then '.exe' when 5 then '' else '.webp' end) as path, case when doc_id % 11 = 0 then 0 else n_chars end as n_bytes from documents"
_BLOCKS = "select doc_id div_ 10 as doc_id, cast(doc_id % 3 as int) as page_number, cast(doc_id % 10 as int) as block_no, cast((doc_id * 37) % 400 as double) as x0, cast((doc_id * 53) % 700 as double) as y0, cast((doc_id * 37) % 400 + 50 + (doc_id * 11) % 500 as double) as x1, case when doc_id % 17 = 0 then concat(chr(10), chr(9)) else concat(chr(10), ' block ', doc_id, ' ', chr(9), chr(10)) end as text, cast(case when doc_id % 13 = 0 then 1 else 0 end as int) as block_type, cast(600 as double) as page_width from documents"

_LINKED = _BLOCKS.replace("' block ', doc_id, ' ', chr(9)", "' block ', doc_id, ' of block ', doc_id, chr(9)").replace(" as x1,", " as x1, cast((doc_id * 53) % 700 + 20 as double) as y1,")
_LINKS = "select doc_id div_ 10 as doc_id, cast(doc_id % 3 as int) as page_number, doc_id as link_no, cast((doc_id * 37) % 400 as double) as x0, cast((doc_id * 53) % 700 as double) as y0, cast((doc_id * 37) % 400 + 50 as double) as x1, cast((doc_id * 53) % 700 + 20 as double) as y1, concat('block ', doc_id) as text, concat('https://site.example/', doc_id) as uri from documents where doc_id % 10 = 4"
_ITEMS = """select concat('/in/', doc_id % 50, case when doc_id % 2 = 0 then '.docx' else '.pptx' end) as path, cast(1 as int) as page, cast(doc_id * 2 as int) as ord, case when doc_id % 2 = 0 then 'paragraph' else 'bullet' end as kind,
  case (doc_id div 50) % 4 when 0 then 'Heading 1' when 1 then 'heading 2' when 2 then 'List Bullet 2' else 'Normal' end as style, cast((doc_id div 50) % 3 as int) as level, case when doc_id % 4 < 2 then concat(' ', source, ' ') else ' ' end as text,
  cast(null as array<array<string>>) as rows, cast(null as struct<x0:double,y0:double,x1:double,y1:double>) as box, cast(null as string) as uri, cast(null as string) as error from documents
  union all select concat('/in/', doc_id % 50, case when doc_id % 2 = 0 then '.docx' else '.pptx' end), cast(1 as int), cast(doc_id * 2 + 1 as int), 'table', null, null, null, array(array('name', 'n'), array(coalesce(source, ''), null)), null, null, null from documents where doc_id % 5 = 0"""
_PAGES = "select doc_id div_ 4 as doc_id, cast(doc_id % 4 as int) as page_number, case when doc_id % 7 = 0 then null else source end as text_content from documents"


def _dispatch_sql() -> str:
    kind = r"lower(regexp_extract(path, '[^/\\](\.[^./\\]+)$', 1))"
    formats = (*package.LOCAL_FORMATS, *package.IMAGE_FORMATS)
    known = f"{kind} in ({', '.join(map(_quoted, formats))})"
    bad = f"(not {known} or n_bytes = 0)"
    images = ", ".join(map(_quoted, package.IMAGE_FORMATS))
    return f"""with s as ({_PATHS}) select doc_id, {kind} as file_type, case when {bad} then null when {kind} in ({images}) then 'ai' else 'local' end as reader,
      (case when {bad} then 400 else 200 end)::int as status,
      case when not {known} then 'Unsupported format: ''' || {kind} || '''. Supported formats: {', '.join(formats)}' when n_bytes = 0 then 'Uploaded file is empty.' end as error from s"""


def _chunks_sql(source: str, words: int) -> str:
    """Pieces, the path of headings over them, and the fold of texts, by document."""
    head = r"(?m)^#+\s+.*$"
    joined = "array_to_string({}, chr(10) || chr(10))"
    crumb = "case when len(list_filter(a.path, lambda t: t.title <> '')) = 0 or starts_with({0}, '# [Context:') then {0} else '# [Context: ' || array_to_string(list_transform(list_filter(a.path, lambda t: t.title <> ''), lambda t: t.title), ' > ') || ']' || chr(10) || {0} end"
    add = lambda chunks, parts: f"case when len({parts}) = 0 then {chunks} else list_append({chunks}, {crumb.format(joined.format(parts))}) end"
    none = "[]::varchar[]"
    state = lambda chunks, cur, n, path, p: f"{{'chunks': {chunks}, 'cur': {cur}, 'words': ({n})::bigint, 'path': {path}, 's': {p}.s, 'n': {p}.n, 'level': {p}.level, 'title': {p}.title, 'sentences': {p}.sentences}}"
    packed = "list_reduce(list_prepend({'q': '', 'n': 0::bigint, 'done': []::varchar[][], 'cur': []::varchar[], 'words': 0::bigint}, p.sentences), lambda b, q: case when b.words + q.n > LIMIT and len(b.cur) > 0 then {'q': q.q, 'n': q.n, 'done': list_append(b.done, b.cur), 'cur': [q.q], 'words': q.n} else {'q': q.q, 'n': q.n, 'done': b.done, 'cur': list_append(b.cur, q.q), 'words': b.words + q.n} end)".replace("LIMIT", str(words))
    parts = f"(list_append({packed}.done, {packed}.cur))"
    fold = f"""lambda a, p: case
        when p.level > 0 then {state(add("a.chunks", "a.cur"), "[p.s]", "p.n", "list_append(list_filter(a.path, lambda t: t.level < p.level), {'level': p.level, 'title': p.title})", "p")}
        when p.n > {words} then {state(f"list_concat({add('a.chunks', 'a.cur')}, list_transform({parts}, lambda c: {crumb.format(joined.format('c'))}))", none, "0", "a.path", "p")}
        when a.words + p.n > {words} and len(a.cur) > 0 then {state(add("a.chunks", "a.cur"), "[p.s]", "p.n", "a.path", "p")}
        else {state("a.chunks", "list_append(a.cur, p.s)", "a.words + p.n", "a.path", "p")} end"""
    empty_path = "[]::struct(level bigint, title varchar)[]"
    sentence = f"list_transform(string_split(regexp_replace(s, '([.!?])[\\s\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {{'q': x, 'n': {_words('x')}::bigint, 'done': []::varchar[][], 'cur': []::varchar[], 'words': 0::bigint}})"
    return f"""x as (select doc_id, regexp_extract_all(markdown, '{head}') as hs, regexp_split_to_array(markdown, '{head}') as ts from {source}),
      y as (select doc_id, list_filter(list_transform(flatten(list_transform(ts, lambda t, i: [t, coalesce(hs[i], '')])), lambda t: {_strip('t')}), lambda t: t <> '') as ps from x),
      z as (select doc_id, unnest(ps) as s, generate_subscripts(ps, 1) as i from y),
      q as (select doc_id, list({{'chunks': {none}, 'cur': {none}, 'words': 0::bigint, 'path': {empty_path}, 's': s, 'n': {_words('s')}::bigint,
        'level': (case when regexp_matches(s, '^#+\\s+') then length(regexp_extract(s, '^#+')) else 0 end)::bigint, 'title': {_strip("regexp_replace(s, '^#+', '')")}, 'sentences': {sentence}}} order by i) as ps from z group by doc_id),
      w as (select doc_id, list_reduce(list_prepend({{'chunks': {none}, 'cur': {none}, 'words': 0::bigint, 'path': {empty_path}, 's': '', 'n': 0::bigint, 'level': 0::bigint, 'title': '', 'sentences': ps[1].sentences}}, ps), {fold}) as a from q),
      k as (select doc_id, {add("a.chunks", "a.cur")} as chunks from w)"""


def _chunk_query(words: int) -> tuple[Query, str]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        some = docs(spark, d).select("doc_id", compress.compress_syntax(F.col("markdown")).alias("markdown"))
        return each(chunk.with_chunks(some, "markdown", words), ["doc_id"], F.col("chunks"), "ord", "chunk")

    sql = f"with s as ({seeds.DOCS}), m as (select doc_id, {_syntax_sql('markdown')} as markdown from s), {_chunks_sql('m', words)} select doc_id, unnest(chunks) as chunk, (generate_subscripts(chunks, 1) - 1)::int as ord from k"
    return run, sql


def _package_input(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.concat(F.lit("doc"), "doc_id", F.lit(".docx")).alias("document_name"), F.col("markdown").alias("markdown_raw"), F.octet_length("markdown").alias("raw_bytes"))


def _package_rows(spark: SparkSession, d: str) -> DataFrame:
    return package.normalize(_package_input(spark, d), options=package.Options(chunk_size=120))


def _build() -> dict[str, tuple[Query, str | None]]:
    q: dict[str, tuple[Query, str | None]] = {f"token_counts_{k}": _token_query(m) for k, m in MODELS.items()}
    names = [*MODELS.values(), "o1-mini", "foo1", "O3", "GPT-4-turbo", "Claude", "other"]
    cases = "case when m like '%gpt-4o%' or m like '%o1%' or m like '%o3%' then 2.5e-6::double when m like '%gpt-4%' then 3e-5::double when m like '%claude%' then 3e-6::double when m like '%gemini%' then 7.5e-8::double else 1e-5::double end"
    q["model_pricing"] = (
        lambda spark, d: spark.createDataFrame([(n,) for n in names], "model string").select("model", tokens.price(F.col("model")).alias("price")),
        f"select model, {cases} as price from (select model, lower(model) as m from (values {', '.join(f'({_quoted(n)})' for n in names)}) t(model))",
    )

    def doc_savings(spark: SparkSession, d: str) -> DataFrame:
        some = docs(spark, d).withColumns({"raw": tokens.byte_proxy(F.col("markdown")), "new": tokens.count_tokens(compress.compress_syntax(F.col("markdown")))})
        s = tokens.savings(F.col("raw"), F.col("new"))
        return some.select("doc_id", *[s[c].alias(c) for c in ("raw_tokens", "markdown_tokens", "tokens_saved", "savings_percentage")])

    q["doc_savings"] = doc_savings, f"""with s as ({seeds.DOCS}), m as (select doc_id, (strlen(markdown) // 2)::bigint as raw_tokens, {_syntax_sql('markdown')} as t from s),
      n as (select *, {_tokens('t')} as markdown_tokens from m), k as (select *, greatest(0, raw_tokens - markdown_tokens)::bigint as tokens_saved from n)
      select doc_id, raw_tokens, markdown_tokens, tokens_saved, case when raw_tokens > 0 then round_even(tokens_saved::double / raw_tokens * 100.0::double, 2)::double else 0.0::double end as savings_percentage from k"""
    q["byte_proxy_metrics"] = (
        lambda spark, d: table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("raw_size_bytes"), tokens.byte_proxy(F.col("text")).alias("raw_tokens"), tokens.popup_tokens(F.col("text")).alias("popup_tokens")),
        "select doc_id, strlen(text)::bigint as raw_size_bytes, (strlen(text) // 2)::bigint as raw_tokens, ceil(length(text) / 4.0)::bigint as popup_tokens from documents",
    )
    stage_names = ("strip_filler", "compress_phrases", "strip_qualifiers", "simplify_passive", "dedup_instructions", "structure_markdown", "normalize_ws")
    for name, stage, sql in zip(stage_names, prompt.STAGES, _STAGE_SQL, strict=True):
        q[name] = _stage_query(stage, sql)

    def optimized(spark: SparkSession, d: str) -> DataFrame:
        return prompt.optimize_prompts(prompts(spark, d)).withColumn("techniques", F.array_join("techniques", "; "))

    raw, new = _tokens("prompt"), _tokens("optimized")
    q["optimize_prompts"] = (
        lambda spark, d: optimized(spark, d).select("prompt_id", "optimized", "techniques", "raw_tokens", "markdown_tokens", "tokens_saved", F.col("status").cast("int").alias("status")),
        f"{_optimized_sql()} select prompt_id, optimized, techniques, {raw} as raw_tokens, {new} as markdown_tokens, greatest(0, {raw} - {new})::bigint as tokens_saved, (case when {_strip('prompt')} = '' then 400 else 200 end)::int as status from o",
    )
    q["technique_counts"] = (
        lambda spark, d: each(prompt.optimize(prompts(spark, d)), [], F.col("techniques"), "ord", "technique").groupBy("technique").agg(F.count("*").alias("n")),
        f"{_optimized_sql()} select technique, count(*) as n from (select unnest(string_split(techniques, '; ')) as technique from o where techniques <> '') group by technique",
    )
    q["prompt_savings_by_role"] = (
        lambda spark, d: optimized(spark, d).groupBy("role").agg(F.count("*").alias("prompts"), F.sum("raw_tokens").alias("raw"), F.sum("tokens_saved").alias("saved")),
        f"{_optimized_sql()} select role, count(*) as prompts, sum({raw})::bigint as raw, sum(greatest(0, {raw} - {new}))::bigint as saved from o group by role",
    )
    for profile, stages in (("popup", rules.POPUP_STAGES), ("inline", rules.INLINE_STAGES)):
        a, b = _rules("prompt", stages[0]), _rules("t1", stages[1])
        third = _structured("t2") if profile == "popup" else "t2"
        even = _strip(_sub("regexp_replace(t3, '[ \\t]+', ' ', 'g')", r"\n{3,}", "\n\n"))
        count = lambda x: f"ceil(length({x}) / 4.0)::bigint"
        saved = f"greatest(0, {count('prompt')} - {count('o')})" if profile == "popup" else f"{count('prompt')} - {count('o')}"
        q[f"optimize_{profile}_profile"] = (
            lambda spark, d, p=profile: prompt.optimize_offline(prompts(spark, d), profile=p).select("prompt_id", "optimized", "tokens_saved", "percentage"),
            f"""with s as ({seeds.PROMPTS}), a as (select *, {a} as t1 from s), b as (select *, {b} as t2 from a), c as (select *, {third} as t3 from b), e as (select *, {even} as t4 from c),
              f as (select *, case when regexp_matches(t4, '^[a-z]') then upper(t4[1:1]) || t4[2:] else t4 end as o from e), g as (select *, ({saved})::bigint as tokens_saved from f)
              select prompt_id, o as optimized, tokens_saved, (case when {count('prompt')} > 0 then floor(tokens_saved / {count('prompt')} * 100 + 0.5) else 0 end)::bigint as percentage from g""",
        )
    q["static_boilerplate"] = (
        lambda spark, d: each(docs(spark, d), ["doc_id"], F.filter(F.split("markdown", "\n", -1), compress.is_boilerplate), "ord", "line").select("doc_id", "line"),
        f"with s as ({seeds.DOCS}) select doc_id, unnest(list_filter({_lines('markdown')}, lambda v: {_boilerplate_sql('v')})) as line from s",
    )
    q["page_split"] = (
        lambda spark, d: each(paged(spark, d), ["doc_id"], compress.pages(F.col("markdown")), "page", "text").select("doc_id", "page", F.md5("text").alias("text_md5")),
        f"with s as ({seeds.PAGED}), p as (select doc_id, regexp_split_to_array(markdown, '\\n+---\\n+') as ps from s), u as (select doc_id, unnest(ps) as t, (generate_subscripts(ps, 1) - 1)::int as page from p) select doc_id, page, md5(t) as text_md5 from u",
    )
    q["dynamic_headers"] = lambda spark, d: compress.running_lines_of(paged(spark, d), "doc_id", "markdown"), f"with s as ({seeds.PAGED}), {_running_ctes('s')} select doc_id, line from r"
    q["strip_bloat"] = (
        lambda spark, d: paged(spark, d).select("doc_id", compress.strip_bloat(F.col("markdown")).alias("cleaned")),
        f"with s as ({seeds.PAGED}), {_bloat_sql('s')} select doc_id, cleaned from b",
    )
    q["compress_syntax"] = (
        lambda spark, d: docs(spark, d).select("doc_id", compress.compress_syntax(F.col("markdown")).alias("result")),
        f"with s as ({seeds.DOCS}) select doc_id, {_syntax_sql('markdown')} as result from s",
    )
    head = r"(?m)^#+\s+.*$"
    q["breadcrumbs"] = (
        lambda spark, d: chunk.breadcrumbs(docs(spark, d), "doc_id", "markdown"),
        f"""with s as ({seeds.DOCS}), h as (select doc_id, list_transform(regexp_extract_all(markdown, '{head}'), lambda v: {_strip('v')}) as hs from s),
          u as (select doc_id, unnest(hs) as v, generate_subscripts(hs, 1) as i from h), l as (select doc_id, i, length(regexp_extract(v, '^#+')) as level, {_strip("regexp_replace(v, '^#+', '')")} as title from u)
          select a.doc_id, (a.i - 1)::int as ord, string_agg(b.title, ' > ' order by b.i) as path from l a join l b on a.doc_id = b.doc_id and b.i <= a.i
          and not exists (select 1 from l c where c.doc_id = b.doc_id and c.i > b.i and c.i <= a.i and c.level <= b.level) where b.title <> '' group by all""",
    )
    q["chunks"] = _chunk_query(120)
    q["sentence_pack"] = _chunk_query(40)
    for k in entities.PATTERNS:
        q[f"entities_{k.lower()}"] = _entity_query(k)
    q["entities_dedup"] = lambda spark, d: entities.exploded(docs(spark, d), "doc_id", "markdown"), None
    for k in ("Email", "Organization", "Technology", "Location", "Monetary"):
        q["entity_context" if k == "Email" else f"entity_context_{k.lower()}"] = _context_query(k)
    q["entity_counts"] = (
        lambda spark, d: entities.exploded(docs(spark, d), "doc_id", "markdown").groupBy("category").agg(F.count("*").alias("n"), F.countDistinct(F.lower("name")).alias("names")),
        f"with s as ({seeds.DOCS}), e as ("
        + " union all ".join(f"select distinct doc_id, '{k}' as category, lower(v) as name from (select doc_id, unnest(regexp_extract_all(markdown, {_quoted((f'(?{f})' if f else '') + p)}, {g})) as n from s) t, lateral (select {_iso_sql('n') if k == 'Date' else 'n'} as v)" for k, (p, g, f) in _ENTITY_SQL.items())
        + ") select category, count(*) as n, count(distinct name) as names from e group by category",
    )
    q["iso_dates"] = (
        lambda spark, d: spark.sql(_DATES.replace("from documents", "from {documents}"), documents=table(spark, d, "documents")).select("doc_id", entities.iso_date(F.col("d")).alias("iso")),
        f"with s as ({_DATES}) select doc_id, {_iso_sql('d')} as iso from s",
    )
    q["format_dispatch"] = (
        lambda spark, d: package.dispatch(spark.sql(_PATHS.replace("from documents", "from {documents}"), documents=table(spark, d, "documents"))).select("doc_id", "file_type", "reader", F.col("status").cast("int").alias("status"), "error"),
        _dispatch_sql(),
    )
    q["gfm_tables"] = (
        lambda spark, d: table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r")).select("n_regionkey", package.gfm_table(F.array(F.lit("key"), F.lit("name")), F.transform("r", lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"]))).alias("markdown")),
        "select n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) order by n_nationkey) as markdown from nation group by n_regionkey",
    )
    column = "case when x1 - x0 > page_width * 0.7 then 0 when x0 > page_width * 0.45 then 1 else 0 end"
    q["block_order"] = (
        lambda spark, d: package.pages_of_blocks(spark.sql(_BLOCKS.replace("div_", "div").replace("from documents", "from {documents}"), documents=table(spark, d, "documents"))),
        f"with s as ({_BLOCKS.replace('div_', '//')}) select doc_id, page_number, coalesce(string_agg({_strip('text')}, chr(10) || chr(10) order by {column}, y0, block_no) filter ({_strip('text')} <> ''), '') as text_content from s where block_type = 0 group by all",
    )
    q["pdf_links"] = (
        lambda spark, d: package.pages_of_blocks(*(spark.sql(x.replace("div_", "div").replace("from documents", "from {documents}"), documents=table(spark, d, "documents")) for x in (_LINKED, _LINKS))),
        f"""with s as ({_LINKED.replace('div_', '//')}), l as ({_LINKS.replace('div_', '//')}),
          j as (select s.*, l.text as label, '[' || l.text || '](' || uri || ')' as mark from s left join l on s.doc_id = l.doc_id and s.page_number = l.page_number
            and least(s.x1, l.x1) > greatest(s.x0, l.x0) and least(s.y1, l.y1) > greatest(s.y0, l.y0)),
          t as (select *, {_strip('text')} as body from j),
          r as (select *, case when label is null or not contains(body, label) then body else substr(body, 1, instr(body, label) - 1) || mark || substr(body, instr(body, label) + length(label)) end as shown from t)
          select doc_id, page_number, coalesce(string_agg(shown, chr(10) || chr(10) order by {column}, y0, block_no) filter (shown <> ''), '') as text_content from r where block_type = 0 group by all""",
    )
    q["office_pages"] = (
        lambda spark, d: office.pages(spark.sql(_ITEMS.replace("from documents", "from {documents}"), documents=table(spark, d, "documents"))).select(F.col("doc_id").alias("path"), "page_number", "text_content", "raw_size_bytes"),
        f"""with s as (select concat('/in/', doc_id % 50, case when doc_id % 2 = 0 then '.docx' else '.pptx' end) as path, doc_id, coalesce(source, '') as source from documents),
          i as (select path, doc_id, doc_id % 2 as slides, case when doc_id % 4 < 2 then {_strip("' ' || source || ' '")} else '' end as t, case (doc_id // 50) % 4 when 0 then '# ' when 1 then '## ' when 2 then '- ' else '' end as mark, (doc_id // 50) % 3 as level, source from s),
          u as (select path, doc_id * 2 as ord, case when t = '' then null when slides = 0 then mark || t when level > 0 then repeat('  ', level) || '- ' || t else t end as shown from i
            union all select path, doc_id * 2 + 1, '| name | n |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || {_strip("source")} || ' |  |' from i where doc_id % 5 = 0)
          select path, 1::int as page_number, coalesce(string_agg(shown, chr(10) || chr(10) order by ord), '') as text_content, strlen(coalesce(string_agg(shown, chr(10) || chr(10) order by ord), ''))::bigint as raw_size_bytes from u group by path""",
    )
    q["joined_pages"] = (
        lambda spark, d: package.joined_pages(spark.sql(_PAGES.replace("div_", "div").replace("from documents", "from {documents}"), documents=table(spark, d, "documents"))),
        f"with s as ({_PAGES.replace('div_', '//')}) select doc_id, string_agg(coalesce(text_content, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by page_number) as markdown from s group by doc_id",
    )
    q["plain_metrics"] = (
        lambda spark, d: package.normalize(_package_input(spark, d), options=package.Options(extract_entities=False, deduplicate_boilerplate=False, target_model="claude-3-5-sonnet")).select("doc_id", F.size("entities").cast("long").alias("n_entities"), "metrics.raw_tokens_estimate", "metrics.compressed_tokens", "metrics.tokens_saved"),
        f"""with s as ({seeds.DOCS}), m as (select doc_id, markdown as raw, {_syntax_sql('markdown')} as t from s), n as (select *, {_tokens('t', 'claude')} as new, (strlen(raw) // 2)::bigint as old from m)
          select doc_id, 0::bigint as n_entities, old as raw_tokens_estimate, new as compressed_tokens, greatest(0, old - new)::bigint as tokens_saved from n""",
    )
    q["scorecard"] = (
        lambda spark, d: sinks.scorecard(package.normalize(_package_input(spark, d), options=package.Options(extract_entities=False, deduplicate_boilerplate=False))).select("raw", "new", "saved"),
        f"""with s as ({seeds.DOCS}), m as (select (strlen(markdown) // 2)::bigint as raw, {_syntax_sql('markdown')} as t from s), n as (select raw, {_tokens('t')} as new from m)
          select format('{{:,}}', sum(raw)::bigint) as raw, format('{{:,}}', sum(new)::bigint) as new, format('{{:,}}', sum(greatest(0, raw - new))::bigint) as saved from n""",
    )
    q["package_metrics"] = (
        lambda spark, d: _package_rows(spark, d).select("doc_id", F.size("chunks").cast("long").alias("n_chunks"), F.md5("full_markdown").alias("markdown_md5"), "metrics.raw_tokens_estimate", "metrics.compressed_tokens", "metrics.tokens_saved"),
        f"""with s as ({seeds.DOCS}), {_bloat_sql('s')}, m as (select doc_id, {_syntax_sql('cleaned')} as markdown from b), {_chunks_sql('m', 120).replace('x as (', 'cx as (').replace('from x)', 'from cx)').replace('y as (', 'cy as (').replace('from y)', 'from cy)')}
          select doc_id, len(chunks)::bigint as n_chunks, md5(m.markdown) as markdown_md5, (strlen(s.markdown) // 2)::bigint as raw_tokens_estimate, {_tokens('m.markdown')} as compressed_tokens,
          greatest(0, strlen(s.markdown) // 2 - {_tokens('m.markdown')})::bigint as tokens_saved from m join s using (doc_id) join k using (doc_id)""",
    )
    q["context_package"] = (
        lambda spark, d: _package_rows(spark, d).select("doc_id", "document_name", F.to_json("metadata").alias("metadata"), "full_markdown", F.to_json("entities").alias("entities"), F.to_json("chunks").alias("chunks"), F.to_json("metrics").alias("metrics")),
        None,
    )
    q["html_to_markdown"] = lambda spark, d: web.html_to_markdown(table(spark, d, "pages")).select("page_id", "title", "markdown"), None
    return q


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in _build().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _build().items() if v[1]}
