"""A factorisation machine that scores text quality.

Features of a text are its hashed words (each occurrence counts 1/n), structure statistics
of the whole text and its length as metadata, the last two as one-hot bins.  The model is

    b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

whose pairwise part is half of sum_f (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2, so a text is
scored in time linear in its words.  It is fitted by minibatch AdaGrad on at most SAMPLE_ROWS
labelled rows, taken by least hash of doc_id; scoring is one pass over whole texts without a
shuffle.

A null text is empty and scored by its statistics; a null label is no label; several labels
of a document each count; without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, sliced
from .words import Words, distinct

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 8_000
WORD_BITS, FACTORS, EPOCHS, BATCH = 15, 8, 8, 256
BINS = 24
_CLASSES = {"digit": "0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "stop": ".,;:!?", "bar": "|", "symbol": "#$%&*+=<>@^_~\\/{}[]", "line": "\n"}
_CLASS_OF = np.zeros(256, np.uint8)
for _k, _chars in enumerate(_CLASSES.values(), 1):
    _CLASS_OF[[ord(c) for c in _chars]] = _k
N_STATS = len(_CLASSES) + 6
SIZE = (1 << WORD_BITS) + N_STATS * BINS


@dataclass
class Features:
    """Occurrences of words (`index`, by text from `first`), and by text one bin of each statistic."""

    index: np.ndarray
    first: np.ndarray
    bins: np.ndarray


def _binned(share: np.ndarray) -> np.ndarray:
    """Bins of shares from 0 to 1 that are finer near 0."""
    return np.clip(np.ceil(np.sqrt(share) * (BINS - 1)), 0, BINS - 1).astype(np.int64)


def features(texts: pa.Array, n_chars: np.ndarray) -> Features:
    """n_chars: the metadata, NaN where null."""
    w = Words(texts, lower=True)
    h, counts = w.hashes(), w.counts()
    n_bytes, n_words = np.diff(w.offsets), np.maximum(counts, 1)
    kinds = _CLASS_OF[w.raw]
    shares = [np.diff(np.searchsorted(np.flatnonzero(kinds == k), w.offsets)) / np.maximum(n_bytes, 1) for k in range(1, len(_CLASSES) + 1)]
    again = np.zeros(len(h) + 1)
    if len(h) > 1:
        again[2:] = np.cumsum(h[1:] == h[:-1])
    repeats = (again[w.first[1:]] - again[np.minimum(w.first[:-1] + 1, w.first[1:])]) / n_words
    kinds_of_words, rare_line = np.zeros(len(counts)), np.zeros(len(counts))
    for k, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
        kinds_of_words[k] = len(distinct(h[a:b])) / max(1, b - a)
        # a line of four words or more that comes again, by the words that open it
        if b - a > 8:
            opens = h[a:b][:-3] + 3 * h[a:b][1:-2] + 5 * h[a:b][2:-1] + 7 * h[a:b][3:]
            rare_line[k] = 1 - len(distinct(opens)) / len(opens)
    letters = np.zeros(len(counts))
    sizes = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
    letters = (sizes[w.first[1:]] - sizes[w.first[:-1]]) / n_words
    logs = np.log2(1 + np.where(np.isnan(n_chars), 0, n_chars))
    fixed = [repeats, kinds_of_words, rare_line, np.minimum(letters / 24, 1), np.minimum(np.log2(1 + counts) / 20, 1) ** 2, np.minimum(logs / 24, 1) ** 2]
    bins = np.column_stack([_binned(s) for s in [*shares, *fixed]])
    bins = bins + (1 << WORD_BITS) + np.arange(N_STATS) * BINS
    return Features((h >> np.uint64(64 - WORD_BITS)).astype(np.int64), w.first, bins)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # SIZE
    factors: np.ndarray  # SIZE x FACTORS

    def _sums(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = np.diff(f.first)
        x = 1 / np.maximum(counts, 1)
        linear, first, square = [], [], []
        for table, out in ((self.weights[:, None], linear), (self.factors, first), (self.factors**2, square)):
            words = np.zeros((len(counts) + 0, table.shape[1]))
            if len(f.index):
                full = np.flatnonzero(counts)
                words[full] = np.add.reduceat(table[f.index], f.first[:-1][full], axis=0)
            scale = x[:, None] if out is not square else (x**2)[:, None]
            out.append(words * scale + table[f.bins].sum(axis=1))
        return linear[0][:, 0], first[0], square[0]

    def score(self, f: Features) -> np.ndarray:
        linear, first, square = self._sums(f)
        z = self.bias + linear + 0.5 * (first**2 - square).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Machine:
    """rows: (word indices, bins, label)."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, FACTORS)))
    labels = np.array([r[2] for r in rows], float)
    if len(set(labels.tolist())) < 2:
        return Machine(0.0, np.zeros(SIZE), np.zeros((SIZE, FACTORS)))
    m.bias = float(np.log(labels.mean() / (1 - labels.mean())))
    g_w, g_v = np.full(SIZE, 1e-3), np.full((SIZE, FACTORS), 1e-3)
    for epoch in range(EPOCHS):
        order, rate = rng.permutation(len(rows)), 0.15 / (1 + 0.15 * epoch)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            counts = np.array([len(rows[k][0]) for k in some])
            f = Features(np.concatenate([rows[k][0] for k in some]).astype(np.int64), np.concatenate([[0], np.cumsum(counts)]), np.array([rows[k][1] for k in some]))
            _, first, _ = m._sums(f)
            error = (m.score(f) - labels[some]) / len(some)
            text = np.concatenate([np.repeat(np.arange(len(some)), counts), np.repeat(np.arange(len(some)), N_STATS)])
            where = np.concatenate([f.index, f.bins.ravel()])
            x = np.concatenate([np.repeat(1 / np.maximum(counts, 1), counts), np.ones(f.bins.size)])
            e = error[text] * x
            used, slot = np.unique(where, return_inverse=True)
            dw = np.bincount(slot, e, len(used)) + 1e-6 * m.weights[used]
            ex = np.bincount(slot, e * x, len(used))
            dv = np.column_stack([np.bincount(slot, e * first[text, k], len(used)) for k in range(FACTORS)]) - ex[:, None] * m.factors[used] + 1e-5 * m.factors[used]
            g_w[used] += dw**2
            g_v[used] += dv**2
            m.weights[used] -= rate * dw / np.sqrt(g_w[used])
            m.factors[used] -= 0.3 * rate * dv / np.sqrt(g_v[used])
            m.bias -= 0.05 * float(error.sum())
    return m


def _numbers(col: pa.Array) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in col.to_pylist()], float)


def _plain(docs: DataFrame) -> DataFrame:
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """labels: doc_id and the label, already without rows that are held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    some = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    # at most sample_rows rows of two numbers
    labelled = _plain(docs).join(F.broadcast(some), "doc_id")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            f = features(column(batch, "text"), _numbers(column(batch, "n_chars")))
            words = [f.index[a:b].astype("<u2").tobytes() for a, b in zip(f.first[:-1], f.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(f.bins.tolist(), pa.list_(pa.int32())), column(batch, "label"), column(batch, "doc_id")], ["words", "bins", "label", "doc_id"])

    rows = labelled.select("doc_id", "text", "n_chars", "label").mapInArrow(take, "words binary, bins array<int>, label int, doc_id long").toLocalIterator()
    found = sorted((r.doc_id, r.label, bytes(r.words), tuple(r.bins)) for r in rows)
    return fit([(np.frombuffer(w, "<u2"), np.array(b), y) for _, y, w, b in found])


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row."""
    model = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights.astype(np.float32), machine.factors.astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*model.value)
        for batch in sliced(batches, "text"):
            s = m.score(features(column(batch, "text"), _numbers(column(batch, "n_chars"))))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return _plain(docs).mapInArrow(score, "doc_id long, score double")


def keep(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, as they are, with a score of `threshold` or more."""
    model = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights.astype(np.float32), machine.factors.astype(np.float32)))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*model.value)
        for batch in sliced(batches, "text"):
            chars = _numbers(column(batch, "n_chars")) if "n_chars" in batch.schema.names else np.full(len(batch), np.nan)
            yield batch.filter(pa.array(m.score(features(column(batch, "text"), chars)) >= threshold))

    return docs.mapInArrow(good, docs.schema)
