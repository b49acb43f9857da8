"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

Every document is tokenised whole and ends with an end id.  Its full windows stand alone;
what is left of it (its tail, below one window) is packed with other tails.  Tails are dealt
to shards of about SHARD, so that those with much in common meet: a tree of cuts along the
principal directions of their terms has a leaf for each shard.  The tree alone is fitted on a
bounded sample, about SAMPLE documents taken by a hash; every tail goes down it, and a leaf
that has more than SHARD tails by exact counts is spread over several shards by a hash.  A
shard has an inverted index of its tails; the first unused one is the seed, BM25 ranks the
unused ones for all its terms, and they fill the window greedily, the last one cut to fit.
What is left of a cut tail stays in the pool.  So every window of a shard is full but the
last, whose ids go to sequences of power-of-two lengths, which need no padding either.

A shard's rows, their order and its sequences depend on the documents alone, so reruns agree.

Known limit: a seed is scored against the tails of its shard only, not against all tails.
The README has the recall that this leaves.

Document frequencies and the mean length cover all documents; they are broadcast, one number
for each id of the vocabulary.  A null text is empty (the end id alone); null doc_ids stay
null; repeated rows are packed as often as they come; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, parallelism, sliced, written
from .tokens import encoder
from .words import distinct

K1, B = 1.2, 0.75
#: Tails in one shard, about.
SHARD = 8192
#: Documents that the tree is fitted on, about, and the fewest of their tails in a leaf.
SAMPLE, LEAST = 10_000, 64
#: Principal directions that the tree cuts along.
DIRECTIONS = 8
#: Seeds scored at once, and terms of a shard (the most frequent ones) whose weights are dense.
SEEDS, DENSE = 64, 512

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _presence(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, id) of every distinct id of each of the texts that follow one another."""
    base = int(ids.max(initial=0)) + 1
    kind = np.uint32 if base * len(sizes) < 1 << 32 else np.uint64
    pairs = np.repeat(np.arange(len(sizes), dtype=kind) * kind(base), sizes) + ids.astype(kind)
    pairs = distinct(pairs)
    return (pairs // kind(base)).astype(np.int64), (pairs % kind(base)).astype(np.int64)


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order and how often each comes; less work here than np.unique."""
    ids = np.sort(ids)
    edge = np.concatenate([[-1], np.flatnonzero(ids[1:] != ids[:-1]), [len(ids) - 1]])
    return ids[edge[1:]].astype(np.int64), np.diff(edge)


@dataclass
class Tree:
    """Cuts at medians along the widest of the principal directions of texts, by their ids'
    inverse frequencies: by node the direction, the median, and the nodes on either side; a
    node without them has a leaf."""

    idf: np.ndarray
    directions: np.ndarray  # id x direction; the last row is for ids that aren't known
    cut: list[tuple[int, float, int, int]]
    leaf: list[int]

    def places(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """text x direction."""
        text, term = _presence(ids, sizes)
        term = np.minimum(term, len(self.idf) - 1)
        weight = self.idf[term]
        norm = np.sqrt(np.bincount(text, weight**2, len(sizes)))
        flat = [np.bincount(text, weight * column[term], len(sizes)) for column in self.directions.T]
        return np.column_stack(flat) / np.maximum(norm, 1e-9)[:, None]

    def leaves(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        node = np.zeros(len(sizes), np.int64)
        if len(self.cut) > 1:
            places, cut = self.places(ids, sizes), np.array(self.cut)
            direction, children = cut[:, 0].astype(np.int64), cut[:, 2:].astype(np.int64)
            while (inner := np.flatnonzero(direction[node] >= 0)).size:
                at = node[inner]
                node[inner] = children[at, (places[inner, direction[at]] > cut[at, 1]).astype(np.int64)]
        return np.array(self.leaf)[node]

    @classmethod
    def fitted(cls, texts: list[np.ndarray], total: int, shard: int, least: int = LEAST) -> Tree:
        """On a sample of `total` texts, until a leaf has about `shard` of them."""
        sizes = np.array([len(t) for t in texts], np.int64)
        ids = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
        size = int(ids.max(initial=0)) + 2
        made = cls(np.zeros(size), np.zeros((size, DIRECTIONS)), [(-1, 0.0, 0, 0)], [0])
        if total <= shard or len(texts) < 2 * least:
            return made
        text, term = _presence(ids, sizes)
        df = np.bincount(term, minlength=size)
        made.idf = np.where(df > 0, np.log(1 + (len(texts) - df + 0.5) / (df + 0.5)), 0)
        weight = made.idf[term]
        weight = weight / np.sqrt(np.bincount(text, weight**2))[text]
        onto = lambda m: np.column_stack([np.bincount(text, weight * c[term], len(texts)) for c in m.T])
        back = lambda y: np.column_stack([np.bincount(term, weight * c[text], size) for c in y.T])
        basis = np.random.default_rng(1).normal(size=(size, 3 * DIRECTIONS))
        for _ in range(3):  # subspace iteration
            y = onto(basis)
            basis = np.linalg.qr(back(y - y.mean(axis=0)))[0]
        y = onto(basis)
        _, turn = np.linalg.eigh(np.cov(y.T))
        made.directions = basis @ turn[:, : -DIRECTIONS - 1 : -1]
        places, made.cut, made.leaf, waiting, leaves = made.places(ids, sizes), [], [], [(np.arange(len(texts)), -1, 0)], 0
        while waiting:
            here, parent, side = waiting.pop()
            node = len(made.cut)
            if parent >= 0:
                d, m, *children = made.cut[parent]
                children[side] = node
                made.cut[parent] = (d, m, *children)
            d = int(places[here].std(axis=0).argmax())
            m = float(np.median(places[here, d]))
            high = places[here, d] > m
            few = len(here) * total <= shard * len(texts) or min(high.sum(), (~high).sum()) < least
            made.cut.append((-1, 0.0, 0, 0) if few else (d, m, 0, 0))
            made.leaf.append(leaves if few else -1)
            leaves += few
            if not few:
                waiting += [(here[high], node, 1), (here[~high], node, 0)]
        return made


def fitted_tree(docs: DataFrame, vocabulary: str, window: int, end_id: int, shard: int, sample: int = SAMPLE) -> Tree:
    total = docs.count()
    if total <= shard:
        return Tree.fitted([], total, shard)
    bits = 1 << 30
    mine = F.pmod(F.xxhash64("doc_id", "text"), F.lit(bits)) < int(bits * min(1.0, sample / total))
    tails = tokenised(docs.where(mine), vocabulary, window, end_id).where("leaf is not null").select("ids").toPandas()
    return Tree.fitted([np.frombuffer(t, "<u4") for t in sorted(map(bytes, tails.ids))], total, shard)


def tokenised(docs: DataFrame, vocabulary: str, window: int, end_id: int, tree: Tree | None = None) -> DataFrame:
    """Pieces of whole documents: full windows, and tails with their leaf of the tree (0 without
    one).  Full windows have null there.  A task adds one row with a start of -1: how many of its
    pieces hold each id."""
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "leaf"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, held = encoder(vocabulary), Frequencies()
        for batch in sliced(batches, "text", 2 << 20):
            ids, first = enc.encode_ended(column(batch, "text"), end_id)
            sizes = np.diff(first)
            pieces = -(-sizes // window)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            begin, length = first[doc] + start, np.minimum(sizes[doc] - start, window)
            for a, n in zip(begin.tolist(), length.tolist(), strict=True):
                held.add(ids[a : a + n])
            full = length == window
            leaf = np.zeros(len(doc), np.int32)
            if shared.value is not None and not full.all():
                leaf[~full] = shared.value.leaves(ids[np.repeat(~full, length)], length[~full])
            packed = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(4 * np.concatenate([begin, [len(ids)]])), pa.py_buffer(ids)])
            columns = [column(batch, "doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), packed.cast(pa.binary()), pa.array(sizes[doc]), pa.array(leaf, mask=full)]
            yield pa.RecordBatch.from_arrays(columns, names)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, -1, 0, held.packed(), 0, None), types, strict=True)], names)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, leaf int")


class Frequencies:
    """How many pieces hold each id."""

    def __init__(self) -> None:
        self._seen, self._bits, self._at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint64), 0

    def add(self, ids: np.ndarray) -> None:
        if len(ids) and (most := int(ids.max())) >= len(self._seen):
            self._seen, self._bits = (np.concatenate([x, np.zeros(most, x.dtype)]) for x in (self._seen, self._bits))
        self._bits[ids] |= np.uint64(1 << self._at)  # a bit for each of 64 pieces
        self._at += 1
        if self._at == 64:
            self._flush()

    def _flush(self) -> None:
        self._seen += np.bitwise_count(self._bits)
        self._bits[:] = self._at = 0

    def packed(self) -> bytes:
        """Pairs of an id and its count."""
        self._flush()
        ids = np.flatnonzero(self._seen).astype("<u4")
        return np.column_stack([ids, self._seen[ids]]).astype("<u4").tobytes()


def document_frequencies(pieces: DataFrame) -> np.ndarray:
    """Pieces that hold each id, over all of them; the tasks' counts are summed by id."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in column(batch, "ids").to_pylist():
                term, df = np.frombuffer(counts, "<u4").reshape(-1, 2).T.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df)], ["term", "df"])

    counted = pieces.where("start < 0").select("ids").mapInArrow(unpack, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(int(counted.term.max()) + 1 if len(counted) else 1)
    df[counted.term] = counted.df
    return df


class Pool:
    """The unused tails of a shard with their inverted index."""

    def __init__(self, tails: list[list], idf: np.ndarray, mean: float) -> None:
        self.tails = tails  # [doc_id, start, ids, doc_tokens]
        n = self._n = len(tails)
        self.unused = np.ones(n, bool)
        self._first = 0
        sizes = np.array([len(t[2]) for t in tails], np.int64)
        flat = np.concatenate([t[2] for t in tails]).astype(np.uint64)
        pairs, tf = np.unique(flat * np.uint64(n) + np.repeat(np.arange(n, dtype=np.uint64), sizes), return_counts=True)
        terms, docs = (pairs // np.uint64(n)).astype(np.int64), (pairs % np.uint64(n)).astype(np.int64)
        weights = (idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[docs] / mean))).astype(np.float32)
        # postings by term; the terms of most postings are rows of a dense matrix instead
        df = np.bincount(terms, minlength=len(idf))
        top = np.argsort(-df, kind="stable")[:DENSE]
        row = np.full(len(idf), -1)
        row[top] = np.arange(len(top))
        dense = row[terms] >= 0
        self._dense = np.zeros((len(top), n), np.float32)
        self._dense[row[terms[dense]], docs[dense]] = weights[dense]
        self._docs, self._weights = docs[~dense], weights[~dense]
        self._at = np.concatenate([[0], np.cumsum(np.where(row >= 0, 0, df))])
        # and terms by tail
        order = np.argsort(docs, kind="stable")
        self._terms, self._row, self._terms_at = terms[order], row[terms[order]], np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=n))])
        self._live = np.diff(self._terms_at)  # terms that the tail still has, first in its share
        self._idf, self._mean, self._weight = idf, mean, np.zeros(len(idf), np.float32)
        # a column for each tail that was unused when columns were last dropped
        self._tail, self._column = np.arange(n), np.arange(n)
        self._scored: dict[int, np.ndarray] = {}  # rows of the block of seeds scored last
        self._block, self._theirs, self._theirs_at = np.zeros((0, n), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def cut(self, k: int, tail: list) -> None:
        """Tail k is now `tail`: its postings, its terms as a seed and its scores are of what is left."""
        self.tails[k] = tail
        begin = self._terms_at[k]
        share = slice(begin, begin + self._live[k])
        was, row = self._terms[share].copy(), self._row[share].copy()
        terms, tf = _counted(tail[2])
        self._weight[terms] = self._idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(tail[2]) / self._mean))
        now, column = self._weight[was], self._column[k]
        self._dense[row[row >= 0], column] = now[row >= 0]
        for term, weight in zip(was[row < 0].tolist(), now[row < 0], strict=True):  # a term's postings are in order of their tail
            low, high = self._at[term], self._at[term + 1]
            self._weights[low + self._docs[low:high].searchsorted(column)] = weight
        left = now > 0
        self._live[k] = n = int(left.sum())
        self._terms[begin : begin + n], self._row[begin : begin + n] = was[left], row[left]
        self._scored.pop(k, None)
        for seed in [s for s in self._scored if not self.unused[s]]:
            del self._scored[seed]  # it seeds no window any more
        if self._scored:  # for the whole block at once; none of these seeds was cut since
            self._block[:, column] = np.add.reduceat(self._weight[self._theirs], self._theirs_at)
        self._weight[terms] = 0

    def seed(self) -> int | None:
        while self._first < self._n and not self.unused[self._first]:
            self._first += 1
        return self._first if self._first < self._n else None

    def _drop(self) -> None:
        """Columns of used tails go, once they are a quarter."""
        live = self.unused[self._tail]
        if 4 * int(live.sum()) > 3 * len(live):
            return
        self._tail = self._tail[live]
        self._column[:] = -1
        self._column[self._tail] = np.arange(len(self._tail))
        self._dense = self._dense[:, live]
        kept = live[self._docs]
        self._docs, self._weights = (np.cumsum(live) - 1)[self._docs[kept]], self._weights[kept]
        self._at = np.concatenate([[0], np.cumsum(kept)])[self._at]

    def _shares(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the terms of the seeds are, and where each seed's begin among these."""
        sizes = self._live[seeds]
        first = np.cumsum(sizes) - sizes
        return np.repeat(self._terms_at[seeds] - first, sizes) + np.arange(int(sizes.sum())), first

    def scores(self, seeds: np.ndarray) -> np.ndarray:
        """BM25 of every column's tail for all terms of each seed."""
        n, columns = len(seeds), len(self._tail)
        at, _ = self._shares(seeds)
        which = np.repeat(np.arange(n), self._live[seeds])
        terms, row = self._terms[at], self._row[at]
        held = np.zeros((n, len(self._dense)), np.float32)
        held[which[row >= 0], row[row >= 0]] = 1
        begin, count = self._at[terms], self._at[terms + 1] - self._at[terms]
        posting = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        sparse = np.bincount(np.repeat(which, count) * columns + self._docs[posting], self._weights[posting], n * columns)
        return held @ self._dense + sparse.reshape(n, columns).astype(np.float32)

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused tails by falling BM25 score for all terms of the seed, ties in order."""
        if seed not in self._scored:  # the seeds to come are likely the next unused ones
            ahead = np.concatenate([[seed], seed + 1 + np.flatnonzero(self.unused[seed + 1 : seed + 8 * SEEDS])[: SEEDS - 1]])
            self._drop()
            self._block = self.scores(ahead)
            at, self._theirs_at = self._shares(ahead)
            self._theirs = self._terms[at]
            self._scored = dict(zip(ahead.tolist(), self._block, strict=True))
        scores = self._scored[seed]
        scores[~self.unused[self._tail]] = -1
        if (column := self._column[seed]) >= 0:
            scores[column] = -1
        while len(scores) and scores[k := int(scores.argmax())] >= 0:
            yield int(self._tail[k])
            scores[k] = -1


def fill(pool: Pool, window: int) -> Iterator[list[tuple]]:
    """Full windows, as lists of (doc_id, start, ids, doc_tokens), while the pool's ids last."""
    total = sum(len(t[2]) for t in pool.tails)
    while total >= window:
        seed = pool.seed()
        parts, room = [], window
        for k in chain([seed], pool.neighbours(seed)):
            doc_id, start, ids, n = pool.tails[k]
            take = ids[:room]
            parts.append((doc_id, start, take, n))
            if len(take) == len(ids):
                pool.unused[k] = False
            else:
                pool.cut(k, [doc_id, start + len(take), ids[len(take) :], n])
            room -= len(take)
            if not room:
                break
        total -= window
        yield parts


def powers(pool: Pool) -> Iterator[list[tuple]]:
    """What is left, cut freely to sequences of falling power-of-two lengths."""
    tails = [t for t, free in zip(pool.tails, pool.unused, strict=True) if free]
    left = sum(len(t[2]) for t in tails)
    queue = [list(t) for t in reversed(tails)]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        parts = []
        while room:
            doc_id, start, ids, n = queue.pop()
            take, rest = ids[:room], ids[room:]
            parts.append((doc_id, start, take, n))
            room -= len(take)
            if len(rest):
                queue.append([doc_id, start + len(take), rest, n])
        yield parts


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0, shard: int = SHARD) -> DataFrame:
    """Pieces of all documents in sequences of at most `window` ids: doc_id, start (its
    document's ids before it), length, ids, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tree = fitted_tree(docs, vocabulary, window, end_id, shard)
    counted = written(tokenised(docs, vocabulary, window, end_id, tree), "packing-pieces")
    df, pieces = document_frequencies(counted), counted.where("start >= 0")
    stats = pieces.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    idf = spark.sparkContext.broadcast(np.log(1 + (stats.n - df + 0.5) / (df + 0.5)))
    mean = float(stats.mean or 1)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        tails: list[list] = []

        def sequences(shard: int) -> Iterator[pa.RecordBatch]:
            pool = Pool(tails, idf.value, mean)
            rows = []
            for made, parts in enumerate(chain(fill(pool, window), powers(pool))):
                at = 0
                for doc_id, start, ids, n in parts:
                    rows.append((doc_id, start, len(ids), ids.tobytes(), n, 2 * ((shard << 24) + made) + 1, at))
                    at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names)

        here = None
        for batch in batches:
            columns = (column(batch, c).to_pylist() for c in ("shard", "doc_id", "start", "ids", "doc_tokens"))
            for shard, doc_id, start, ids, n in zip(*columns, strict=True):
                if shard != here and tails:
                    yield from sequences(here)
                    tails = []
                here = shard
                tails.append([doc_id, start, np.frombuffer(ids, "<u4"), n])
        if tails:
            yield from sequences(here)

    full = pieces.where("leaf is null").withColumn("sequence_id", 2 * F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    tails = dealt(pieces.where("leaf is not null"), shard)
    # a task has whole shards, wherever the range's sampled bounds fall
    tails = tails.repartitionByRange(parallelism(spark), "shard").sortWithinPartitions("shard", "doc_id", "start", "ids")
    names = [c.split()[0] for c in PIECES.split(", ")]
    return full.select(names).union(tails.select("shard", "doc_id", "start", "ids", "doc_tokens").mapInArrow(packed, PIECES))


def dealt(tails: DataFrame, shard: int = SHARD) -> DataFrame:
    """Tails with their shard: a leaf has as many as its tails need.  The tree has at most
    SAMPLE / LEAST leaves."""
    leaves = tails.groupBy("leaf").count().toPandas().sort_values("leaf")
    parts = -(-leaves["count"] // shard)
    leaves = pd.DataFrame({"leaf": leaves.leaf, "before": parts.cumsum() - parts, "parts": parts})
    kinds = pa.schema([("leaf", pa.int32()), ("before", pa.int64()), ("parts", pa.int64())])
    table = F.broadcast(tails.sparkSession.createDataFrame(pa.Table.from_pandas(leaves, kinds, preserve_index=False)))
    some = F.pmod(F.xxhash64("doc_id", "start", "ids"), "parts")
    return tails.join(table, "leaf").withColumn("shard", F.col("before") + some)
