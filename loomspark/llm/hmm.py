"""A hidden Markov language model over whole texts.

A text is its lower-cased (A-Z) words and one end.  Words have classes: the OWN_CLASSES most
frequent training words one each, all others one by their last three bytes.  A hidden state
emits a class, the class emits the word by its smoothed count among the class's training
words (all words never seen share one such event), so the model gives every text a
probability.  The forward recursion, scaled at every step, gives its exact logarithm.

Training is Baum-Welch: each task runs the forward and backward recursions over its training
texts and returns expected transition and emission counts by class, which Spark sums.  It
starts from random emissions around the class counts, and all training rows have part in
every round, until one raises their log-likelihood by less than GAIN a token.  For training,
texts are cut to segments of SEGMENT tokens; scoring never cuts one.

Word counts cover all training texts.  Rare words' counts meet the texts by a join, frequent
ones are broadcast, OWN_CLASSES at most.  Words go by 64-bit hashes.  A null text is empty
(its end alone); without training texts the model is uniform; repeated rows count and are
scored as often as they come; a null doc_id hashes as the text "null".
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import column, sliced, written
from .words import Words, mixed

OWN_CLASSES, SUFFIX_CLASSES, STATES = 32_768, 2_048, 8
CLASSES = OWN_CLASSES + SUFFIX_CLASSES + 1
END = CLASSES - 1
#: Baum-Welch ends with the round before which the log10-likelihood rose by less a token.
GAIN = 0.001
SEGMENT = 512
SLOT_BITS = 19


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % folds == fold


def _suffix(w: Words) -> np.ndarray:
    """Class of each word by its last three bytes."""
    out = np.zeros(len(w.ends), np.uint64)
    for back in (1, 2, 3):
        at = w.ends - back
        out = out * np.uint64(257) + np.where(at >= w.starts, w.data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mixed(out) % np.uint64(SUFFIX_CLASSES)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, suffix, c) of all words of the rows where `train` holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, s, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, s, c = h[order], s[order], c[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[at], s[at], np.add.reduceat(c, at)

        def out() -> pa.RecordBatch:
            h, s, c = held[0]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(c)], ["hash", "suffix", "c"])

        for batch in sliced(batches, "text", 4 << 20):
            w = Words(column(batch, "text"), lower=True)
            if not len(w.starts):
                continue
            held.append((w.hashes(), _suffix(w), np.ones(len(w.starts), np.int64)))
            held = [summed()] if len(held) > 1 or size == 0 else held
            size = len(held[0][0])
            if size > 1_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    each = docs.where("train").select("text").mapInArrow(count, "hash long, suffix int, c long")
    return each.groupBy("hash", "suffix").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Counts that fix the words' part: own classes by hash, and totals."""

    keys: np.ndarray  # by slot, the hash of the word that has it
    own: np.ndarray  # by slot, its class
    own_counts: np.ndarray  # by own class
    class_tokens: np.ndarray  # by suffix class: training tokens of words without an own class
    class_words: np.ndarray  # and how many words
    tokens: int
    words: int
    ends: int

    @classmethod
    def of(cls, counts: DataFrame, ends: int) -> Lexicon:
        top = counts.orderBy(F.desc("c"), "hash").limit(OWN_CLASSES).toPandas()
        by_suffix = counts.groupBy("suffix").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas()
        tokens, words = np.zeros(SUFFIX_CLASSES, np.int64), np.zeros(SUFFIX_CLASSES, np.int64)
        tokens[by_suffix.suffix] = by_suffix.n
        words[by_suffix.suffix] = by_suffix.v
        total, distinct = int(tokens.sum()), int(words.sum())
        # the most frequent word of a slot has it; another one there goes by its suffix
        h = top.hash.to_numpy(np.int64).view(np.uint64)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        keys, own = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1, np.int32)
        keys[slot[first]] = h[first]
        own[slot[first]] = first
        own_counts = np.zeros(OWN_CLASSES, np.int64)
        own_counts[first] = top.c.to_numpy(np.int64)[first]
        np.subtract.at(tokens, top.suffix.to_numpy(np.int64)[first], own_counts[first])
        np.subtract.at(words, top.suffix.to_numpy(np.int64)[first], 1)
        return cls(keys, own, own_counts, tokens, words, total + ends, distinct + bool(ends), ends)

    def classes(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of every word, its hash, and whether the class is its own."""
        h = w.hashes()
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        mine = (self.keys[slot] == h) & (self.own[slot] >= 0)
        return np.where(mine, self.own[slot], OWN_CLASSES + _suffix(w)), h, mine

    def class_mass(self) -> np.ndarray:
        """Smoothed training tokens by class, for the first guess and as a prior."""
        return np.concatenate([self.own_counts, self.class_tokens, [self.ends]]) + 0.5


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # CLASSES x K

    @classmethod
    def made(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, mass: np.ndarray, pull: float = 50.0) -> Model:
        """From expected counts, each smoothed towards what is known without them."""
        k = len(start)
        emit = emit + pull * (mass / mass.sum())[:, None]
        return cls((start + 1) / (start.sum() + k), (move + 1) / (move.sum(1, keepdims=True) + k), emit / emit.sum(0))


class Steps:
    """Sequences side by side: tokens by step, and within one by falling length of their sequence."""

    def __init__(self, first: np.ndarray) -> None:
        self.lengths = np.diff(first)
        self.order = np.argsort(-self.lengths, kind="stable")
        most = int(self.lengths.max(initial=0))
        #: by step, how many sequences have it
        self.alive = len(self.lengths) - np.searchsorted(np.sort(self.lengths), np.arange(most), side="right")
        begin = first[:-1][self.order]
        self.tokens = np.concatenate([begin[:n] + t for t, n in enumerate(self.alive.tolist())]) if most else np.zeros(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.alive)])

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """Where the tokens of a step begin, and how many there are."""
        return zip(self.at.tolist(), self.alive.tolist())  # noqa: B905


def log_likelihood(model: Model, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 probability of each class sequence by the scaled forward recursion."""
    steps = Steps(first)
    emit, move = np.ascontiguousarray(model.emit.T), model.move.T.copy()
    scales, alpha = np.empty(len(steps.tokens)), np.repeat(model.start[:, None], len(steps.lengths), axis=1)
    for t, (at, n) in enumerate(steps):
        if t % 64 == 0:  # emissions of some steps at a time
            base, to = at, int(steps.at[min(t + 64, len(steps.alive))])
            emitted = emit[:, classes[steps.tokens[at:to]]]
        alpha = move @ alpha[:, :n] if t else alpha[:, :n]
        alpha = alpha * emitted[:, at - base : at - base + n]
        scale = alpha.sum(axis=0)
        alpha /= scale
        scales[at : at + n] = scale
    result = np.zeros(len(steps.lengths))
    rank = np.concatenate([np.arange(n) for n in steps.alive.tolist()]) if len(steps.alive) else np.zeros(0, np.int64)
    result[steps.order] = np.bincount(rank, np.log10(scales), len(steps.lengths))
    return result


def expected_counts(model: Model, classes: np.ndarray, first: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of starts, moves and emissions, and the log10-likelihood; `begins`: the sequence is the
    beginning of a text (others go on in the middle, from the stationary states)."""
    steps, k = Steps(first), len(model.start)
    begins = begins[steps.order]
    move = model.move.astype(np.float32)
    back = move.T.copy()
    rest = np.linalg.matrix_power(model.move, 64)[0].astype(np.float32)
    seen = classes[steps.tokens]
    emitted = np.ascontiguousarray(model.emit.T.astype(np.float32))[:, seen]
    alphas, scales = np.empty((k, len(seen)), np.float32), np.empty(len(seen), np.float32)
    alpha = np.where(begins, model.start[:, None].astype(np.float32), rest[:, None])
    for t, (at, n) in enumerate(steps):
        here = slice(at, at + n)
        alpha = np.multiply(back @ alpha[:, :n] if t else alpha[:, :n], emitted[:, here], out=alphas[:, here])
        scales[here] = alpha.sum(axis=0)
        alpha /= scales[here]
    emitted /= scales
    moves, beta = np.zeros((k, k)), np.zeros((k, 0), np.float32)
    for at, n in reversed(list(steps)):
        went = beta.shape[1]
        if went:
            tail = beta * emitted[:, at + n : at + n + went]
            moves += alphas[:, at : at + went] @ tail.T
            beta = move @ tail
        if n > went:
            beta = np.concatenate([beta, np.ones((k, n - went), np.float32)], axis=1)
        alphas[:, at : at + n] *= beta
    moves *= model.move
    starts = alphas[:, : int(steps.alive[0])][:, begins[: int(steps.alive[0])]].sum(axis=1, dtype=float) if len(seen) else np.zeros(k)
    counts = np.column_stack([np.bincount(seen, a, CLASSES) for a in alphas])
    return starts, moves, counts, float(np.log10(scales, dtype=float).sum())


def _segments(classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of segments of at most SEGMENT tokens, and which of them begin a text."""
    pieces = np.maximum(1, -(-np.diff(first) // SEGMENT))
    begin = np.repeat(first[:-1], pieces)
    number = np.arange(len(begin)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.concatenate([begin + number * SEGMENT, [len(classes)]]), number == 0


def _joined(sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(s, "<u2") for s in sequences]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint16)).astype(np.int64), first


def _portions(frames: Iterator[pd.DataFrame], most: int = 300_000) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Rows with their class sequences, about `most` tokens at a time."""
    for f in frames:
        sizes = f.classes.map(len).to_numpy() // 2
        cut = np.cumsum(sizes) // most
        for _, part in f.groupby(cut):
            yield part, part.classes.tolist()


def coded(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Class sequences of all rows (unsigned 16-bit), the hashes of words without a class of
    their own, and what the frequent words and suffix classes contribute to the scores."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        own_logs = np.log10(lex.own_counts + 0.5)
        class_logs = np.log10(lex.class_tokens + 0.5 * (lex.class_words + 1))
        for batch in sliced(batches, "text"):
            w = Words(column(batch, "text"), lower=True)
            classes, h, mine = lex.classes(w)
            logs = np.concatenate([[0], np.cumsum(np.where(mine, own_logs[np.where(mine, classes, 0)], 0.0))])
            rare_logs = np.concatenate([[0], np.cumsum(np.where(mine, 0.0, class_logs[np.where(mine, 0, classes - OWN_CLASSES)]))])
            sequences, rare, frequent = [], [], []
            small = classes.astype("<u2")
            end = np.array([END], "<u2").tobytes()
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                sequences.append(small[a:b].tobytes() + end)
                rare.append(h[a:b][~mine[a:b]].view(np.int64))
                frequent.append(b - a - len(rare[-1]))
            span = lambda x, w=w: pa.array(x[w.first[1:]] - x[w.first[:-1]])
            rest = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(w.counts() + 1, pa.int64()), pa.array(frequent, pa.int64()), span(logs), span(rare_logs), pa.array(sequences, pa.binary()), pa.array(rare, pa.list_(pa.int64()))], [*rest.schema.names, "n_tokens", "n_frequent", "own_log", "class_log", "classes", "rare"])

    return docs.mapInArrow(code, "row long, doc_id long, train boolean, n_tokens long, n_frequent long, own_log double, class_log double, classes binary, rare array<long>")


def baum_welch(rows: DataFrame, model: Model, mass: np.ndarray, gain: float = GAIN) -> Model:
    """Rounds over all training rows, until the log-likelihood rises by less than `gain` a
    token; each brings CLASSES sums by state to the driver."""
    spark, k = rows.sparkSession, len(model.start)
    names = [f"s{j}" for j in range(k)]
    schema = "kind int, at int, " + ", ".join(f"{n} double" for n in names)
    before = -np.inf
    while True:
        shared = spark.sparkContext.broadcast(model)

        def expect(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            starts, moves, emitted, fit = np.zeros((1, k)), np.zeros((k, k)), np.zeros((CLASSES, k)), np.zeros((1, k))
            for _, sequences in _portions(frames):
                classes, first = _joined(sequences)
                bounds, begins = _segments(classes, first)
                for total, part in zip((starts, moves, emitted, fit[:, 0]), expected_counts(shared.value, classes, bounds, begins), strict=True):
                    total += part
            for kind, table in enumerate((starts, moves, emitted, fit)):
                at = np.flatnonzero(table.any(axis=1))
                yield pd.DataFrame(table[at], columns=names).assign(kind=kind, at=at)[["kind", "at", *names]]

        sums = rows.where("train").select("classes").mapInPandas(expect, schema).groupBy("kind", "at").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
        tables = [np.zeros((n, k)) for n in (1, k, CLASSES, 1)]
        for kind, table in enumerate(tables):
            part = sums[sums.kind == kind]
            table[part["at"].to_numpy(int)] = part[names].to_numpy(float)
        shared.unpersist()
        model = Model.made(tables[0][0], tables[1], tables[2], mass)
        fit, tokens = tables[3][0, 0], tables[2].sum()
        if fit - before <= gain * tokens:
            return model
        before = fit


def first_guess(mass: np.ndarray, states: int = STATES, seed: int = 3) -> Model:
    """Where Baum-Welch begins: random emissions around the class counts of all training rows."""
    rng = np.random.default_rng(seed)
    share = mass / mass.sum()
    emit = share[:, None] * np.exp(rng.normal(0, 1, (CLASSES, states)))
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def score(docs: DataFrame, states: int = STATES, gain: float = GAIN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = plain.withColumn("train", ~held_out(F.col("doc_id")))
    counts = written(word_counts(plain), "hmm-counts")
    ends = plain.where("train").count()
    lex = Lexicon.of(counts, ends)
    mass = lex.class_mass()
    rows = written(coded(plain, lex), "hmm-rows")
    model = baum_welch(rows, first_guess(mass, states), mass, gain)

    rare = rows.select("row", F.explode("rare").alias("hash"))
    known = rare.join(counts.select("hash", "c"), "hash").groupBy("row").agg(F.sum(F.log10(F.col("c") + 0.5)).alias("rare_log"), F.count("*").alias("n_rare"))
    known = written(known, "hmm-rare")
    shared = spark.sparkContext.broadcast(model)

    def likelihood(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, sequences in _portions(frames, 2_000_000):
            classes, first = _joined(sequences)
            yield pd.DataFrame({"row": part["row"], "classes_log": log_likelihood(shared.value, classes, first)})

    forward = rows.select("row", "classes").mapInPandas(likelihood, "row long, classes_log double")
    base = float(np.log10(lex.tokens + 0.5 * (lex.words + 1)))
    joined = rows.select("row", "doc_id", "train", "n_tokens", "n_frequent", "own_log", "class_log").join(forward, "row").join(known, "row", "left")
    n_rare, rare_log = F.coalesce("n_rare", F.lit(0)), F.coalesce("rare_log", F.lit(0.0))
    # words never seen count 0.5, as does the end where no text was trained on
    unseen = (F.col("n_tokens") - 1 - F.col("n_frequent") - n_rare) * float(np.log10(0.5))
    words = rare_log + unseen
    return joined.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens",
        (F.col("n_frequent") + n_rare + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("own_log") + words + float(np.log10(ends + 0.5)) - F.col("n_tokens") * base).alias("base_score"),
        (F.col("classes_log") + words - F.col("class_log")).alias("score"),
    )
