"""MinHash near-duplicates with tensored banding.

Two collections of TABLES half keys, each of HALF minhashes, are computed for a document;
a table's key combines one half key of either collection.  So TABLES^2 tables of
2 * HALF hashes cost 2 * TABLES * HALF minhashes instead of 2 * TABLES^2 * HALF.

Documents with equal shingle sets are one class from the start.  Each class is first compared
with the least class of its buckets, which connects most groups of copies.  Buckets that then
still hold several components are compared in whole: by size (sets that are alike enough differ
by a third at most), in pairs of blocks of at most BLOCK classes.  A task compares the full sets
of its classes and returns a spanning forest of the links, so that no pair is emitted as a row.
Every candidate pair is confirmed, refuted or already connected.

A text's shingles are those of five lower-cased (A-Z) words; a shorter text is one shingle; a
text without words, or null, has no shingles and no links.  Components are named by their
least doc_id; rows with null doc_id take part and rank last; repeated rows are one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bucketed, column, components, release, sliced, written
from .words import Words, distinct, mixed, span_hashes, windows

SHINGLE, TABLES, HALF = 5, 9, 3
#: Classes of one block; a task holds the sets of two blocks at once.
BLOCK = 128


def _constants(n: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts, lower=True)
    h = w.hashes()
    starts, where = windows(w.first, shingle)
    all_ = span_hashes(h, starts, starts + shingle)
    for k, n in enumerate(np.diff(w.first)):
        if n >= shingle:
            yield distinct(all_[where[k] : where[k + 1]])
        elif n:
            yield span_hashes(h, w.first[k : k + 1], w.first[k + 1 : k + 2])
        else:
            yield np.zeros(0, np.uint64)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, tables: int = TABLES, half: int = HALF, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, node (a digest of the set; null without words) and the half keys."""
    factors = _constants(2 * tables * half)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = list(shingle_sets(column(batch, "text"), shingle))
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            halves = np.zeros((len(sets), 2 * tables), np.int64)
            if len(full):
                flat = np.concatenate([sets[k] for k in full])
                at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                for t in range(2 * tables):
                    key = np.full(len(full), t, np.uint64)
                    for f in factors[t * half : (t + 1) * half]:
                        key = mixed(key ^ np.minimum.reduceat((flat ^ (flat >> np.uint64(29))) * f, at))
                    halves[full, t] = key.view(np.int64)
            nodes = [_digest(s) if len(s) else None for s in sets]
            out = [column(batch, "doc_id"), pa.array(sizes), pa.array(nodes, pa.binary())]
            out += [pa.array(list(halves[:, side * tables : (side + 1) * tables]), pa.list_(pa.int64())) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_shingles", "node", "a", "b"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(sign, "doc_id long, n_shingles long, node binary, a array<long>, b array<long>")


def _texts(docs: DataFrame, signed: DataFrame, shingle: int) -> DataFrame:
    """(s, text) of every text with words, dealt by s: texts that have the same name and set
    come once."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            nodes = [_digest(s) if len(s) else None for s in shingle_sets(column(batch, "text"), shingle)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], ["doc_id", "text", "node"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    own = plain.where("doc_id is not null").select(F.col("doc_id").alias("s"), "text")
    if signed.where("doc_id is null").limit(1).count():
        nameless = plain.where("doc_id is null").mapInArrow(named, "doc_id long, text string, node binary").where("node is not null")
        own = own.unionByName(nameless.select(_name(), "text"))
    if signed.groupBy("doc_id").count().where("count > 1").limit(1).count():
        own = own.groupBy("s", F.md5("text")).agg(F.any_value("text").alias("text")).drop("md5(text)")
    return bucketed(own, ["s"], "minhash-texts")


def _name() -> Column:
    """What a class goes by in buckets: its least doc_id.  Two classes with the same one are
    compared together wherever either is."""
    return F.coalesce("doc_id", F.xxhash64("node")).alias("s")


def _forest(nodes: list[bytes], sets: list[np.ndarray], roots: list[bytes], percent: int) -> Iterator[tuple[bytes, bytes]]:
    """Links that connect what the alike sets among these connect, but for those of one root."""
    sizes = np.array([len(s) for s in sets], np.int64)
    elements, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = seen > 1
    number = np.cumsum(shared) - 1
    owner, at = owner[shared[at]], number[at[shared[at]]]
    both = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for low in range(0, int(shared.sum()), 4096):
        some = slice(*np.searchsorted(at, [low, low + 4096]))
        has = np.zeros((len(sets), 4096), np.float32)
        has[owner[some], at[some] - low] = 1
        both += has @ has.T
    alike = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    names, which = np.unique(np.array(roots, object), return_inverse=True)
    joined = np.zeros((len(names), len(names)), bool)
    one = np.array([np.flatnonzero(which == k)[0] for k in range(len(names))])
    x, y = np.nonzero(alike)
    joined[which[x], which[y]] = True
    left = np.ones(len(names), bool)
    for k in range(len(names)):
        if left[k]:
            left[k], front = False, [k]
            while front:
                near = np.flatnonzero(joined[front].any(axis=0) & left)
                left[near] = False
                yield from ((nodes[one[j]], nodes[one[k]]) for j in near)
                front = near.tolist()


def _compared(texts: DataFrame, groups: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b) links among the classes s of each group g; a group holds two blocks at most.
    Classes of one root are connected already."""

    def compare(table: pa.Table) -> pa.Table:
        sets = shingle_sets(table.column("text").combine_chunks(), shingle)
        found = {n: (s, r or n) for s, r in zip(sets, table.column("root").to_pylist(), strict=True) if len(s) for n in [_digest(s)]}
        links = []
        if len({r for _, r in found.values()}) > 1:
            links = list(_forest(list(found), *zip(*found.values(), strict=True), percent))
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    rows = groups.join(texts, "s")
    return written(rows.select("g", "root", "text").groupBy("g").applyInArrow(compare, "a binary, b binary"), "minhash-links")


def _hubs(members: DataFrame) -> DataFrame:
    """(s, hub): for each class the least one of its buckets."""
    return written(members.where("s <> lo").groupBy("s").agg(F.min("lo").alias("hub")), "minhash-hubs")


def _around_hubs(hubs: DataFrame) -> DataFrame:
    """(g, s, root): each class with its hub, in blocks around that.  Nothing has a root yet."""
    blocks = hubs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    group = lambda k: F.xxhash64("hub", k).alias("g")
    others = hubs.join(blocks, "hub").select(group(F.pmod(F.xxhash64("s"), "blocks").cast("int")), "s")
    centres = blocks.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    both = others.unionByName(centres.select(group(F.col("k")), F.col("hub").alias("s")))
    return written(both.withColumn("root", F.lit(None).cast("binary")), "minhash-groups")


def _whole_buckets(members: DataFrame, hubs: DataFrame, classes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(g, s, root): buckets cut by size and to pairs of blocks, where they hold several
    components and more than a class with its hub."""
    root = F.coalesce("root", "node")
    top = classes.join(roots, "node", "left").groupBy("s").agg(F.min(root).alias("r"), F.max(root).alias("t"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    top = written(top.join(hubs, "s", "left"), "minhash-tops")
    level = lambda c: F.floor(F.log(F.col(c)) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    sized = members.select("key", "s").join(top, "s").select("key", "s", "r", "t", "hub", F.explode(F.sequence(level("least"), level("most") + 1)).alias("level"))
    sized = written(sized, "minhash-sized")
    print_ = F.sum(F.xxhash64("s").cast("decimal(38,0)")).alias("print")
    groups = sized.groupBy("key", "level").agg(F.count("*").alias("n"), print_, F.min("r").alias("r"), F.max("t").alias("t"), F.min("s").alias("lo"), F.max(F.struct("s", "hub")).alias("last"))
    groups = groups.where("r <> t and not (n = 2 and last.hub <=> lo)")
    # groups of the same classes are one
    groups = groups.groupBy("n", "print").agg(F.min(F.struct("key", "level")).alias("one")).select("one.*", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    several = written(groups, "minhash-mixed")
    dealt = sized.join(several, ["key", "level"]).withColumn("own", F.pmod(F.xxhash64("s"), "blocks").cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # two classes by one name have roots of their own
    known = F.when(F.col("r") == F.col("t"), F.col("r")).alias("root")
    out = written(paired.select(F.xxhash64("key", "level", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "s", known), "minhash-groups")
    release(top, sized, several)
    return out


def near_duplicates(docs: DataFrame, percent: int = 75, tables: int = TABLES, half: int = HALF, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    signed = written(signatures(docs, tables, half, shingle), "minhash-signatures")
    same = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.any_value(c).alias(c) for c in ("n_shingles", "a", "b")))
    classes = written(same.select("*", _name()), "minhash-classes")
    keys = F.flatten(F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(i, x, j, y))))
    keyed = classes.select("s", F.explode(keys).alias("key"))
    shared = written(keyed.groupBy("key").agg(F.min("s").alias("lo"), F.count("*").alias("n")).where("n > 1").select("key", "lo"), "minhash-buckets")
    members = written(keyed.join(shared, "key"), "minhash-members")
    release(shared)
    hubs = _hubs(members)
    texts = _texts(docs, signed, shingle)
    groups = _around_hubs(hubs)
    links = _compared(texts, groups, shingle, percent)
    roots = components(links, "minhash")
    mixed_groups = _whole_buckets(members, hubs, classes, roots, percent)
    release(groups, members, hubs)
    more = _compared(texts, mixed_groups, shingle, percent)
    release(texts, mixed_groups)
    if more.limit(1).count():
        release(roots)
        roots = components(links.union(more), "minhash")
    own = classes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = written(own.join(least, "root").select("node", "component_id"), "minhash-labels")
    release(classes, links, more, roots)
    out = signed.join(labels, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
