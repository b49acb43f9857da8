"""Heading-aware chunks with the path of headings above them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pytext import NOT_WS, WS, each, let, strip, text

MAX_WORDS = 350
_HEADING = rf"(?Udm)^#+{WS}+.*$"


def pieces(c: Column) -> Column:
    """Headings and the texts between them in order, stripped, without blank ones: s, words,
    level (0: not a heading) and title."""

    def all_(t: Column) -> Column:
        between, headings = F.split(t, _HEADING, -1), F.regexp_extract_all(t, F.lit(_HEADING), 0)
        paired = let(headings, lambda hs: F.flatten(F.transform(between, lambda x, i: F.array(x, F.coalesce(F.get(hs, i), F.lit(""))))))
        return F.filter(F.transform(paired, strip), lambda x: x != "")

    def piece(s: Column) -> Column:
        level = F.when(s.rlike(f"^#+{WS}+"), F.length(F.regexp_extract(s, "^#+", 0))).otherwise(0)
        return F.struct(
            s.alias("s"), F.regexp_count(s, F.lit(f"{NOT_WS}+")).alias("words"), level.alias("level"),
            strip(F.regexp_replace(s, "^#+", "")).alias("title"),
        )

    return F.transform(let(text(c), all_), piece)


# What is gathered so far (cur, words) under the path of headings (path); `chunks` are done.
_STRINGS = "cast(array() as array<string>)"
_CRUMB = "concat('# [Context: ', array_join(transform(filter(a.path, x -> x.title <> ''), x -> x.title), ' > '), ']\\n')"
_TEXT = "array_join({parts}, '\\n\\n')"


def _added(chunks: str, parts: str) -> str:
    """chunks with one more of the parts, below its path unless it says so itself."""
    joined = _TEXT.format(parts=parts)
    bare = f"size(filter(a.path, x -> x.title <> '')) = 0 or startswith({joined}, '# [Context:')"
    return f"if(size({parts}) = 0, {chunks}, array_append({chunks}, if({bare}, {joined}, concat({_CRUMB}, {joined}))))"


# Only a text that is too long is cut to sentences.
_SENTENCES = f"transform(split(p.s, r'(?<=[.!?]){WS}+', -1), x -> named_struct('s', x, 'words', regexp_count(x, r'{NOT_WS}+')))"
_PACKED = f"""aggregate({_SENTENCES},
    named_struct('done', cast(array() as array<array<string>>), 'cur', {_STRINGS}, 'words', 0),
    (b, q) -> if(b.words + q.words > {{limit}} and size(b.cur) > 0,
        named_struct('done', array_append(b.done, b.cur), 'cur', array(q.s), 'words', q.words),
        named_struct('done', b.done, 'cur', array_append(b.cur, q.s), 'words', b.words + q.words)),
    b -> if(size(b.cur) > 0, array_append(b.done, b.cur), b.done))"""
_FOLD = f"""aggregate({{pieces}},
    named_struct('chunks', {_STRINGS}, 'cur', {_STRINGS}, 'words', 0, 'path', cast(array() as array<struct<level:int,title:string>>)),
    (a, p) -> case
        when p.level > 0 then named_struct('chunks', {_added("a.chunks", "a.cur")}, 'cur', array(p.s), 'words', p.words,
            'path', array_append(filter(a.path, x -> x.level < p.level), named_struct('level', p.level, 'title', p.title)))
        when p.words > {{limit}} then named_struct('chunks',
            concat({_added("a.chunks", "a.cur")}, transform({_PACKED}, c -> get({_added(_STRINGS, "c")}, 0))), 'cur', {_STRINGS}, 'words', 0, 'path', a.path)
        when a.words + p.words > {{limit}} and size(a.cur) > 0 then named_struct('chunks', {_added("a.chunks", "a.cur")}, 'cur', array(p.s), 'words', p.words, 'path', a.path)
        else named_struct('chunks', a.chunks, 'cur', array_append(a.cur, p.s), 'words', a.words + p.words, 'path', a.path) end,
    a -> {_added("a.chunks", "a.cur")})"""


def with_chunks(df: DataFrame, column: str, max_words: int = MAX_WORDS, out: str = "chunks") -> DataFrame:
    """Adds the chunks of a Markdown column.

    A heading opens a chunk and the text below joins it while both have at most `max_words`;
    a longer text is packed sentence by sentence, and a longer sentence stands alone.
    """
    some = df.withColumn("_pieces", pieces(F.col(column)))
    fold = _FOLD.replace("{pieces}", "_pieces").replace("{limit}", str(int(max_words)))
    return some.withColumn(out, F.expr(fold)).drop("_pieces")


def sections(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, ord, level, title, words) of each heading and text."""
    return each(df, [key], pieces(F.col(column)), "ord", "p").select(key, "ord", "p.level", "p.title", "p.words")


def breadcrumbs_of(df: DataFrame, key: str, column: str) -> DataFrame:
    """The same as `breadcrumbs`, for documents of very many headings: as of each heading, the last
    one of every level stands in its path unless a later one of a lower level voids it."""
    heads = each(df, [key], F.filter(pieces(F.col(column)), lambda p: p["level"] > 0), "ord", "p").select(key, "ord", "p.level", "p.title")
    upto = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = sorted(r.level for r in heads.select("level").distinct().collect())  # a few small numbers
    latest = {k: F.last(F.when(F.col("level") == k, F.struct("ord", "title")), ignorenulls=True).over(upto) for k in levels}
    above = heads.withColumns({f"_{k}": c for k, c in latest.items()})
    crumbs, voided = [], F.lit(-1)
    for k in levels:
        crumbs.append(F.when(F.col(f"_{k}.ord") > voided, F.nullif(F.col(f"_{k}.title"), F.lit(""))))
        voided = F.greatest(voided, F.coalesce(F.col(f"_{k}.ord"), F.lit(-1)))
    path = F.array_join(F.array_compact(F.array(*crumbs)), " > ") if crumbs else F.lit("")
    return above.select(key, "ord", path.alias("path"))


def breadcrumbs(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, ord, path) of each heading: the titles above it and its own, joined by ' > '."""
    heads = df.select(key, F.filter(pieces(F.col(column)), lambda p: p["level"] > 0).alias("h"))
    path = """transform(h, (x, i) -> array_join(transform(filter(slice(h, 1, i + 1), (y, j) ->
        not exists(slice(h, j + 2, i - j), z -> z.level <= y.level) and y.title <> ''), y -> y.title), ' > '))"""
    return each(heads, [key], F.expr(path), "ord", "path")
