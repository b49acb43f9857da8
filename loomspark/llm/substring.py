"""Substring dedup: windows of words that began in an earlier document are removed.

Every window of WINDOW words has a Rabin-Karp hash.  To count all of them without moving all
of them, windows are taken in runs: each window has an anchor, the least hash of the short
grams in it, and consecutive windows with the same anchor make a run, about one for each
twenty words.  Equal windows have equal anchors, so

* a run whose whole span of words also is a run of an earlier document is covered at once;
* a window can be repeated elsewhere only if other runs with its anchor exist, so only for the
  first run of each kind with such an anchor, windows are looked at, in blocks of up to BLOCK
  whose bounds are counted from the anchor: a block that an earlier document has is covered at
  once, and single windows are hashed and counted for the first block of each kind.

The result is that of counting every window by itself.  Windows, and runs, are taken for equal
where two 64-bit hashes agree: that of all their words and that of their anchor, which lies in them.  Texts are dealt to buckets by document
once, where both later joins with them find them.  Covered windows merge to maximal
intervals by document, and their words go.

Words are unchanged.  A null text has none; one shorter than a window keeps all; null
doc_ids rank last and are removed only against others; rows with equal doc_ids are never
earlier than each other, and equal rows lose the same words; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bucketed, column, release, sliced, without, written
from .words import Words, span_hashes, windows

WINDOW, GRAM, BLOCK = 50, 8, 8
_LAST = (1 << 63) - 1


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each `width` consecutive ones (van Herk: two passes over blocks)."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = np.concatenate([values, np.full(-n % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    head = np.minimum.accumulate(pad, axis=1).ravel()
    tail = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def runs(texts: pa.Array, window: int = WINDOW, gram: int = GRAM) -> pd.DataFrame:
    """text (its number), first (word number of the first window), n (windows), anchor, whole
    (a hash of all words that the run covers) of every run."""
    w = Words(texts)
    h = w.hashes()
    starts, where = windows(w.first, window)
    if not len(starts):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("text", "first", "n", "anchor", "whole")})
    k = np.arange(max(len(h) - gram + 1, 0))
    grams = span_hashes(h, k, k + gram)
    anchor = _sliding_min(grams, window - gram + 1)[starts]
    text = np.repeat(np.arange(len(where) - 1), np.diff(where))
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.concatenate([at, [len(starts)]]))
    whole = span_hashes(h, starts[at], starts[at] + n + window - 1)
    return pd.DataFrame({"text": text[at], "first": starts[at] - w.first[text[at]], "n": n, "anchor": anchor[at].view(np.int64), "whole": whole.view(np.int64)})


def blocks(texts: pa.Array, spans: pa.Array, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """text (its number), first, anchor, hash and the hashes of the single windows of every block
    of the open runs (first, n, anchor) of each text."""
    w = Words(texts)
    h = w.hashes()
    first, n, anchor = (pc.struct_field(spans.flatten(), k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2))
    text = np.repeat(np.arange(len(spans)), pc.list_value_length(spans).to_numpy(zero_copy_only=False))
    start = first + w.first[text]
    last = start + n - 1
    # the anchor's place, the same in equal windows: within all windows of its run
    k = np.arange(max(len(h) - gram + 1, 0))
    grams = span_hashes(h, k, k + gram)
    place = last + (grams[last[:, None] + np.arange(window - gram + 1)] == anchor.view(np.uint64)[:, None]).argmax(axis=1)
    high = (place - start) // block
    many = high - (place - last) // block + 1
    run = np.repeat(np.arange(len(text)), many)
    number = high[run] - (np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many))
    low = np.maximum(start[run], place[run] - number * block - block + 1)
    n = np.minimum(last[run], place[run] - number * block) - low + 1
    upto = np.cumsum(n)
    single = np.repeat(low - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)
    hashes = pa.array(span_hashes(h, single, single + window).view(np.int64))
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]), pa.int32()), hashes)
    return text[run], low - w.first[text[run]], anchor[run], span_hashes(h, low, low + n + window - 1).view(np.int64), listed


def _keyed(docs: DataFrame) -> DataFrame:
    """Rank of a document and, as rows may share a doc_id, a hash of its text, before all its
    columns, which get names that clash with none."""
    columns = [F.col(c).cast("string").alias("text") if c.lower() == "text" else F.col(c).alias(f"own{k}") for k, c in enumerate(docs.columns)]
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    return docs.select(rank.alias("_doc"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_text"), *columns)


def covered(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """_doc, _text and spans: disjoint ascending (start, end) word intervals to remove from
    the texts of rows that have _doc and _text."""

    def all_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            r = runs(column(batch, "text"), window, gram)
            own = [column(batch, c).take(pa.array(r.text.to_numpy())) for c in ("_doc", "_text")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(r["first"].to_numpy(), pa.int32()), pa.array(r.n.to_numpy(), pa.int32()), pa.array(r.anchor.to_numpy()), pa.array(r.whole.to_numpy())], ["_doc", "_text", "first", "n", "anchor", "whole"])

    slim = keyed.select("_doc", "_text", F.col("text").cast("string").alias("text"))
    found = written(slim.mapInArrow(all_runs, "_doc long, _text long, first int, n int, anchor long, whole long"), "substring-runs")
    # equal runs have equal anchors, so only runs with an anchor of several documents matter
    anchors = found.groupBy("anchor").agg(F.min("whole").alias("x"), F.max("whole").alias("y"), F.min("_doc").alias("lo"), F.max("_doc").alias("hi"))
    anchors = written(anchors.where("lo < hi").select("anchor", F.expr("x <> y").alias("several")), "substring-anchors")
    shared = written(found.join(anchors, "anchor"), "substring-shared")
    release(found, anchors)
    # the earliest document of each kind of run; equal ones agree in both hashes
    kind = ["anchor", "whole"]
    twice = written(shared.groupBy(*kind).agg(F.min("_doc").alias("lo"), F.max("_doc").alias("hi")).where("lo < hi").select(*kind, "lo"), "substring-repeated")
    ranked = written(shared.join(twice, kind, "left").drop("whole"), "substring-ranked")
    release(shared, twice)
    gone = ranked.where("lo < _doc").select("_doc", "_text", "first", (F.col("first") + F.col("n") + window - 1).alias("end"))
    open_ = ranked.where("several and (lo is null or lo = _doc)")
    by_doc = open_.groupBy("_doc", "_text").agg(F.collect_list(F.struct("first", "n", "anchor")).alias("open"))
    by_doc = written(by_doc, "substring-open")
    with_text = slim.join(by_doc, ["_doc", "_text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            text, first, anchor, hashes, singles = blocks(column(batch, "text"), column(batch, "open"), window, gram)
            own = [column(batch, c).take(pa.array(text)) for c in ("_doc", "_text")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(first, pa.int32()), pa.array(anchor), pa.array(hashes), singles], ["_doc", "_text", "first", "anchor", "hash", "singles"])

    def earlier(rows: DataFrame, name: str) -> DataFrame:
        """The first document of each kind that several have."""
        found = rows.groupBy("anchor", "hash").agg(F.min("_doc").alias("lo"), F.max("_doc").alias("hi"))
        return written(found.where("lo < hi").select("anchor", "hash", "lo"), name)

    each = written(with_text.mapInArrow(cut, "_doc long, _text long, first int, anchor long, hash long, singles array<long>"), "substring-blocks")
    seen = earlier(each, "substring-block-counts")
    tagged = written(each.join(seen, ["anchor", "hash"], "left").drop("hash"), "substring-tagged")
    release(each, seen)
    late = tagged.where("lo < _doc").select("_doc", "_text", "first", (F.col("first") + F.size("singles") + window - 1).alias("end"))
    alone = tagged.where("lo is null or lo = _doc").select("_doc", "_text", "anchor", F.col("first").alias("begin"), F.posexplode("singles").alias("at", "hash"))
    alone = alone.select("_doc", "_text", "anchor", "hash", (F.col("begin") + F.col("at")).alias("first"))
    counted = earlier(alone, "substring-counts")
    single = alone.join(counted, ["anchor", "hash"]).where("lo < _doc").select("_doc", "_text", "first", (F.col("first") + window).alias("end"))
    spans = F.array_sort(F.collect_set(F.struct("first", "end")))
    both = gone.union(late).union(single).groupBy("_doc", "_text").agg(spans.alias("all"))
    merged = written(both.select("_doc", "_text", _merged("all").alias("spans")), "substring-spans")
    release(ranked, by_doc, tagged, counted)
    return merged


def _merged(spans: str):
    """Maximal intervals of sorted ones: an interval starts where none before reaches, and
    ends with the greatest end up to the next start."""
    expr = f"""
    aggregate({spans}, named_struct('at', -1, 'to', -1, 'done', cast(array() as array<struct<first:int,end:int>>)),
      (acc, s) -> if(acc.to >= s.first,
        named_struct('at', acc.at, 'to', greatest(acc.to, s.end), 'done', acc.done),
        named_struct('at', s.first, 'to', s.end, 'done', if(acc.at < 0, acc.done, array_append(acc.done, named_struct('first', acc.at, 'end', acc.to))))),
      acc -> array_append(acc.done, named_struct('first', acc.at, 'end', acc.to)))"""
    return F.expr(expr)


def kept_words(texts: pa.Array, spans: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words, words removed and the kept words joined by a blank, of each text; spans: disjoint
    (first, end) word intervals to remove, or null."""
    w, n = Words(texts), len(texts)
    owner = np.repeat(np.arange(n), pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False))
    change = np.zeros(len(w.starts) + 1, np.int32)
    for k, by in ((0, 1), (1, -1)):
        np.add.at(change, pc.struct_field(spans.flatten(), k).to_numpy(zero_copy_only=False).astype(np.int64) + w.first[owner], by)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    owner = np.repeat(np.arange(n), w.counts())[kept]
    last = np.ones(len(kept), bool)
    last[:-1] = owner[1:] != owner[:-1]
    sizes = w.ends[kept] - w.starts[kept] + ~last  # with a blank after each but a text's last
    upto = np.cumsum(sizes)
    out = np.concatenate([w.raw, [0]]).astype(np.uint8)[np.repeat(w.starts[kept] - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)]
    out[upto[~last] - 1] = 0x20
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, sizes, n).astype(np.int64))]).astype(np.int32)
    return w.counts(), w.counts() - np.bincount(owner, minlength=n), pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of `docs` with n_words, n_removed and kept_text (kept words joined by a blank);
    own columns of these names give way to them."""
    plain = docs.select(*without(docs, ["n_words", "n_removed", "kept_text"]))
    keyed = bucketed(_keyed(plain), ["_doc", "_text"], "substring-texts")
    spans = covered(keyed, window, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            n_words, n_removed, kept = kept_words(column(batch, "text"), batch.columns[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), kept], schema.names)

    fields = [T.StructField(f.name, T.StringType() if f.name.lower() == "text" else f.dataType) for f in plain.schema.fields]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    both = keyed.join(spans, ["_doc", "_text"], "left")
    return both.select(*keyed.columns[2:], "spans").mapInArrow(cut, schema)
