"""Queries of services, SQL functions, money and reports over whole tables, and the same rows in DuckDB SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql, tokens
from ..functions.pytext import each
from ..operators import chunk, compress, entities, package, prompt, reports, rules
from ..operators.external import Limits
from . import catalogue, seeds

Query = Callable[[SparkSession, str], DataFrame]

# Fixed values, as the survey gives them: dollars for a token, and percent of the plain count.
_PRICES = (("gpt-4", "3e-5", 100), ("gpt-4o", "2.5e-6", 85), ("claude-3-5-sonnet", "3e-6", 105), ("gemini-2.5-flash", "7.5e-8", 108), ("other", "1e-5", 100))


def _digest_reader(content: bytes, path: str) -> str:
    """Stands for a reader of the caller's: some inputs it can't read, some calls fail."""
    if len(content) % 5 == 0:
        raise ValueError(f"unreadable: {path}")
    if len(content) % 7 == 0:
        raise OSError("no answer")
    return hashlib.md5(content).hexdigest()


def external_reader(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of several kinds; only images go to the reader of the caller's."""
    docs = catalogue.table(spark, d, "documents").where("text is not null")
    suffix = F.element_at(F.array(*map(F.lit, (".png", ".docx", ".exe", ".JPG"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    content = F.encode("text", "utf-8")
    files = docs.select("doc_id", F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), suffix).alias("path"), content.alias("content"), F.octet_length("text").cast("long").alias("n_bytes"))
    local = package.dispatch(files).withColumn("markdown_raw", F.when(F.col("reader") == "local", "read before"))
    read = package.with_reader(local, _digest_reader, Limits(tries=2, wait=0.0))
    return read.select("doc_id", "file_type", "reader", "markdown_raw", F.col("status").cast("int").alias("status"), "error")


_READER_SQL = """
with f as (
  select doc_id, '/in/' || doc_id || ['.png', '.docx', '.exe', '.JPG'][doc_id % 4 + 1] as path, lower(['.png', '.docx', '.exe', '.JPG'][doc_id % 4 + 1]) as file_type,
    strlen(text) as n, md5(text) as digest
  from documents where text is not null),
k as (select *, case when file_type = '.exe' then 'bad' when n = 0 then 'empty' when file_type = '.docx' then 'local' else 'ai' end as kind from f)
select doc_id, file_type, case when kind in ('ai', 'local') then kind end as reader,
  case when kind = 'local' then 'read before' when kind = 'ai' and n % 5 <> 0 and n % 7 <> 0 then digest end as markdown_raw,
  (case when kind in ('bad', 'empty') then 400 when kind = 'local' then 200 when n % 5 = 0 then 400 when n % 7 = 0 then 500 else 200 end)::int as status,
  case when kind = 'bad' then 'Unsupported format: ''.exe''. Supported formats: .pdf, .docx, .pptx, .png, .jpg, .jpeg, .webp' when kind = 'empty' then 'Uploaded file is empty.'
    when kind = 'local' then null when n % 5 = 0 then 'unreadable: ' || path when n % 7 = 0 then 'no answer' end as error
from k
"""


def _short_service(text: str) -> str | None:
    """Stands for a language model that answers some prompts, some with blanks, and fails for others."""
    if len(text) % 4 == 0:
        raise RuntimeError("no answer")
    return "  \n" if len(text) % 4 == 1 else f"\n Rewritten: {text}\n\n"


def rewritten_prompts(spark: SparkSession, d: str) -> DataFrame:
    done = prompt.optimize_prompts(catalogue.prompts(spark, d), service=_short_service, limits=Limits(tries=1))
    return done.select("prompt_id", "optimized", F.array_join("techniques", "; ").alias("techniques"), "markdown_tokens", F.col("status").cast("int").alias("status"))


def _rewritten_sql() -> str:
    return f"""{catalogue._optimized_sql()},
      r as (select *, {catalogue._strip('prompt')} <> '' and length(optimized) % 4 >= 2 as done from o),
      n as (select prompt_id, prompt, case when done then 'Rewritten: ' || optimized else optimized end as optimized,
        case when not done then techniques when techniques = '' then {catalogue._quoted(rules.REWRITTEN)} else techniques || '; ' || {catalogue._quoted(rules.REWRITTEN)} end as techniques from r)
      select prompt_id, optimized, techniques, {catalogue._tokens('optimized')} as markdown_tokens, (case when {catalogue._strip('prompt')} = '' then 400 else 200 end)::int as status from n"""


def doc_dollars(spark: SparkSession, d: str) -> DataFrame:
    """Savings of every document under every family of models, in micro-dollars, rounded as binary values are."""
    some = catalogue.docs(spark, d).select("doc_id", tokens.byte_proxy(F.col("markdown")).alias("raw"), tokens.sizes(compress.compress_syntax(F.col("markdown"))).alias("size"))
    models = F.explode(F.array(*(F.lit(m) for m, _, _ in _PRICES))).alias("model")
    counted = some.select("*", models).withColumn("new", tokens.tokens_of(F.col("size"), F.col("model")))
    s = tokens.savings(F.col("raw"), F.col("new"), F.col("model"), exact=True)
    return counted.select("doc_id", "model", s["tokens_saved"].alias("tokens_saved"), F.round(s["dollars_saved"] * 1e6).cast("long").alias("micro_dollars"))


def _dollars_sql() -> str:
    plain = f"greatest(1, {catalogue._words('t')} * 130 // 100)"
    models = ", ".join(f"('{m}', {price}::double, {percent})" for m, price, percent in _PRICES)
    return f"""with s as ({seeds.DOCS}), m as (select doc_id, (strlen(markdown) // 2)::bigint as raw, {catalogue._syntax_sql('markdown')} as t from s),
      n as (select doc_id, raw, {plain} as plain from m), p(model, price, percent) as (values {models}),
      k as (select doc_id, model, price, greatest(0, raw - plain * percent // 100)::bigint as tokens_saved from n cross join p)
      select doc_id, model, tokens_saved, round(printf('%.6f', tokens_saved * price)::double * 1e6)::bigint as micro_dollars from k"""


def exact_savings(spark: SparkSession, d: str) -> DataFrame:
    """Percentages and dollars rounded as binary values are, not as their decimal digits."""
    some = catalogue.docs(spark, d).select("doc_id", tokens.byte_proxy(F.col("markdown")).alias("raw"), tokens.count_tokens(compress.compress_syntax(F.col("markdown"))).alias("new"))
    s = tokens.savings(F.col("raw"), F.col("new"), "gpt-4", exact=True)
    return some.select("doc_id", s["savings_percentage"].alias("savings_percentage"), s["dollars_saved"].alias("dollars_saved"))


def _exact_sql() -> str:
    return f"""with s as ({seeds.DOCS}), m as (select doc_id, (strlen(markdown) // 2)::bigint as raw, {catalogue._syntax_sql('markdown')} as t from s),
      k as (select doc_id, raw, greatest(0, raw - {catalogue._tokens('t')})::bigint as saved from m)
      select doc_id, case when raw > 0 then printf('%.2f', saved::double / raw * 100.0::double)::double else 0.0::double end as savings_percentage,
        case when raw > 0 then printf('%.6f', saved * 3e-5::double)::double else 0.0::double end as dollars_saved from k"""


def savings_report(spark: SparkSession, d: str) -> DataFrame:
    """Prompts and tokens by role, model and technique, in five groupings."""
    model = F.element_at(F.array(*map(F.lit, ("gpt-4", "gpt-4o", "claude"))), (F.col("prompt_id") % 3 + 1).cast("int"))
    some = catalogue.prompts(spark, d).withColumn("model", model)
    return reports.savings_report(prompt.optimize_prompts(some, model=F.col("model")))


def _report_sql() -> str:
    count = lambda x: f"(case when {x} = '' then 0 when {catalogue._words(x)} = 0 then greatest(1, length({x}) // 4) when percent is null then greatest(1, {catalogue._words(x)} * 130 // 100) else greatest(1, {catalogue._words(x)} * 130 // 100) * percent // 100 end)"
    return f"""{catalogue._optimized_sql()},
      m as (select *, ['gpt-4', 'gpt-4o', 'claude'][prompt_id % 3 + 1] as model, [null, 85, 105][prompt_id % 3 + 1] as percent from o),
      n as (select role, model, techniques, {count('prompt')} as raw, {count('optimized')} as new from m),
      k as (select role, model, techniques, raw, case when raw > 0 then greatest(0, raw - new) else 0 end as saved from n),
      t as (select model, unnest(case when techniques = '' then [null] else string_split(techniques, '; ') end) as technique, raw, saved from k),
      r as (
        select role, model, null as technique, grouping(role, model) * 2 + 1 as grouping_id, count(*) as prompts, sum(raw) as raw_tokens, sum(saved) as tokens_saved
        from k group by grouping sets ((role, model), (role), ())
        union all
        select null, model, technique, 4 + grouping(model, technique), count(*), sum(raw), sum(saved) from t group by grouping sets ((model, technique), (technique)))
      select role, model, technique, grouping_id::bigint as grouping_id, prompts::bigint as prompts, raw_tokens::bigint as raw_tokens, tokens_saved::bigint as tokens_saved from r"""


def sql_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The optimizer and its savings as SQL functions."""
    sql.register(spark)
    given = catalogue.prompts(spark, d)
    clean = spark.sql("select prompt_id, prompt, case when trim(regexp_replace(prompt, r'\\s+', ' ')) = '' then '' else loom_optimize(prompt) end as optimized from {given}", given=given)
    saved = "select prompt_id, optimized, loom_savings(loom_tokens(prompt, 'claude'), loom_tokens(optimized, 'claude'), 'claude').tokens_saved as tokens_saved from {clean}"
    return spark.sql(saved, clean=clean)


def _sql_prompts_sql() -> str:
    raw, new = catalogue._tokens("prompt", "claude"), catalogue._tokens("optimized", "claude")
    return f"{catalogue._optimized_sql()} select prompt_id, optimized, (case when {raw} > 0 then greatest(0, {raw} - {new}) else 0 end)::bigint as tokens_saved from o"


def sql_documents(spark: SparkSession, d: str) -> DataFrame:
    """Syntax compression and ISO dates as SQL functions."""
    sql.register(spark)
    dated = spark.sql(catalogue._DATES.replace("from documents", "from {documents}"), documents=catalogue.table(spark, d, "documents"))
    return spark.sql("select s.doc_id, loom_compress_syntax(s.markdown) as result, loom_iso_date(t.d) as iso from {s} s join {t} t on s.doc_id = t.doc_id", s=catalogue.docs(spark, d), t=dated)


def _sql_documents_sql() -> str:
    return f"with s as ({seeds.DOCS}), t as ({catalogue._DATES}) select s.doc_id, {catalogue._syntax_sql('markdown')} as result, {catalogue._iso_sql('d')} as iso from s join t on s.doc_id = t.doc_id"


def demo_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The demonstration settings: pages joined by blank lines alone, without boilerplate, chunks of 100 words."""
    pages = catalogue.docs(spark, d).select((F.col("doc_id") / 2).cast("long").alias("doc_id"), (F.col("doc_id") % 2).cast("int").alias("page_number"), F.col("markdown").alias("text_content"))
    whole = package.joined_pages(pages, separator="\n\n").withColumn("markdown", compress.compressed(F.col("markdown")))
    return each(chunk.with_chunks(whole, "markdown", package.DEMO.chunk_size), ["doc_id"], F.col("chunks"), "ord", "chunk")


def _demo_sql() -> str:
    again = lambda x: x.replace("x as (", "cx as (").replace("from x)", "from cx)").replace("y as (", "cy as (").replace("from y)", "from cy)")
    return f"""with s0 as ({seeds.DOCS}), s as (select doc_id // 2 as doc_id, string_agg(markdown, chr(10) || chr(10) order by doc_id % 2) as markdown from s0 group by all),
      {catalogue._bloat_sql('s')}, m as (select doc_id, {catalogue._syntax_sql('cleaned')} as markdown from b), {again(catalogue._chunks_sql('m', 100))}
      select doc_id, unnest(chunks) as chunk, (generate_subscripts(chunks, 1) - 1)::int as ord from k"""


def entity_context_date(spark: SparkSession, d: str) -> DataFrame:
    return catalogue._context_query("Date")[0](spark, d)


def entity_context_phone(spark: SparkSession, d: str) -> DataFrame:
    return catalogue._context_query("Phone")[0](spark, d)


def _phone_sql() -> str:
    """A match there begins with the blank before the number, which is no part of the name."""
    p, blanks = catalogue._quoted(catalogue._ENTITY_SQL["Phone"][0]), r"' ' || chr(9) || chr(10) || chr(13)"
    return f"""with s as ({seeds.DOCS}), m as (select doc_id, markdown, regexp_extract_all(markdown, {p}) as ms, regexp_split_to_array(markdown, {p}) as gs from s),
      u as (select doc_id, markdown, ms, gs, unnest(ms) as found, generate_subscripts(ms, 1) as i from m),
      o as (select doc_id, markdown, i, ltrim(found, {blanks}) as name, length(found) - length(ltrim(found, {blanks}))
        + coalesce(list_sum(list_transform(gs[1:i], lambda g: length(g))), 0)::bigint + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0)::bigint as pos from u),
      t as (select *, substr(markdown, 1, pos) as l, substr(markdown, pos + length(name) + 1) as r from o)
      select doc_id, (i - 1)::int as ord, name, replace({catalogue._strip("regexp_extract(l, '[^.]*$') || name || case when contains(r, '.') then substr(r, 1, instr(r, '.')) else substr(r, 1, 50) end")}, chr(10), ' ') as context from t"""


def long_breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    return chunk.breadcrumbs_of(catalogue.docs(spark, d), "doc_id", "markdown")


def build() -> dict[str, tuple[Query, str | None]]:
    known = catalogue._build()
    dates = f"select doc_id, ord, {catalogue._iso_sql('name')} as name, context from ({catalogue._context_query('Date')[1]})"
    return known | {
        "external_reader": (external_reader, _READER_SQL), "rewritten_prompts": (rewritten_prompts, _rewritten_sql()),
        "doc_dollars": (doc_dollars, _dollars_sql()), "exact_savings": (exact_savings, _exact_sql()), "savings_report": (savings_report, _report_sql()),
        "sql_prompts": (sql_prompts, _sql_prompts_sql()), "sql_documents": (sql_documents, _sql_documents_sql()), "demo_chunks": (demo_chunks, _demo_sql()),
        "entity_context_date": (entity_context_date, dates), "entity_context_phone": (entity_context_phone, _phone_sql()), "long_breadcrumbs": (long_breadcrumbs, known["breadcrumbs"][1]),
    }


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in build().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in build().items() if v[1]}
