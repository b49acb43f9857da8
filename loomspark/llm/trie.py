"""Tries of conversations by their turns: one node for each distinct sequence of first turns.

A turn is its digest and its code points; no text leaves the first step.  Conversations with the
same turns are counted as one sequence with its number, so that copies cost one row.
Sequences are dealt by the digest of their first turn; a subtrie of more turns than a task should hold
is dealt anew by the next turn, and so on, until each piece fits or is one sequence.  In a
task a piece becomes a trie of pointers, walked in postorder with a stack of its own.  Nodes above
the pieces are summed in Spark from the tops below them, deepest first.

Rows without conv_id belong to no conversation.  Turns are in order of their number, null first,
equal ones by role and text; a null role or text is empty.  No conversations: no nodes.  Further
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, parallelism, written

#: Turns that a task should hold at most: a larger subtrie is dealt anew.
MOST_TURNS = 200_000
#: Conversation ids that are joined to a text in one row.
CHUNK = 1 << 16
#: Turns of another conversation that a rebuilt one may start with.
MOST_SHARED = 5

NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NONE = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, an array of (digest, size); size: code points of the text."""
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")))
    order = F.struct(F.col("turn").alias("turn"), text("role").alias("role"), F.sha2(text("text"), 256).alias("text"))
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), order.alias("o"), digest.alias("digest"), F.length(text("text")).cast("long").alias("size"))
    listed = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("o", "digest", "size"))).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations with their first turns, crc32(conv_id) % 6 of them, those of the conversation
    that begins their hundred (fewer where it is shorter, none where there is none)."""
    convs = written(convs, "trie-conversations")
    lead = convs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("lead"), F.slice("turns", 1, MOST_SHARED).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)).cast("int")
    own = convs.withColumn("lead", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", h)
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    first = F.when(F.col("first").isNotNull() & (F.col("h") > 0), F.slice("first", F.lit(1), F.col("h")))
    return own.join(lead, "lead", "left").select("conv_id", F.coalesce(F.concat(first, rest), rest).alias("turns"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of (sequence, chunk) to a row a sequence: its ids hashed as they come."""
    held = None  # sequence, hash, number, least id, turns
    for batch in batches:
        rows = zip(*(column(batch, c).to_pylist() for c in ("seq", "ids", "n", "least", "turns")), strict=True)
        done = []
        for seq, ids, n, least, turns in rows:
            if held and held[0] == seq:
                held[1].update(b"," + ids.encode())
                held[2] += n
                continue
            if held:
                done.append(held)
            held = [seq, hashlib.sha256(ids.encode()), n, least, turns]
        yield _ended(done)
    yield _ended([held] if held else [])


_ENDED = pa.schema([("seq", pa.string()), ("ends_sha256", pa.string()), ("n", pa.int64()), ("least", pa.int64()), ("digests", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64()))])


def _ended(rows: list) -> pa.RecordBatch:
    data = [[r[0] for r in rows], [r[1].hexdigest() for r in rows], [r[2] for r in rows], [r[3] for r in rows]]
    data += [[[t["digest"] for t in r[4]] for r in rows], [[t["size"] for t in r[4]] for r in rows]]
    return pa.record_batch(data, schema=_ENDED)


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """Each different sequence once: seq, ends_sha256 of its conversations' ids, n, least, digests, sizes.

    Ids are joined in chunks first, so that a sequence with very many copies comes to one task as
    a few long texts, which are hashed one after the other; turns travel with the first chunk alone."""
    seq = F.md5(F.array_join(F.transform("turns", lambda t: t["digest"]), ","))
    keyed = convs.select("conv_id", seq.alias("seq"), F.floor(F.col("conv_id") / CHUNK).alias("chunk"), "turns")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    chunks = keyed.groupBy("seq", "chunk").agg(ids.alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("turns").alias("turns"))
    dealt = chunks.repartition(parallelism(convs.sparkSession), "seq").sortWithinPartitions("seq", "chunk")
    return dealt.mapInArrow(_ends, "seq string, ends_sha256 string, n long, least long, digests array<string>, sizes array<long>")


def _walked(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of pieces: a trie of pointers, then postorder with a stack.

    A node's conv_id is the least of its members; a piece's own node hangs under a node above
    it, whose conv_id its rows carry."""
    children: list[dict] = []
    n, least, depth, size, parent, ends = [], [], [], [], [], []
    tops: dict[tuple[int, str], int] = {}

    def made(d: int, s: int, up: int) -> int:
        children.append({})
        for values, v in ((n, 0), (least, None), (depth, d), (size, s), (parent, up), (ends, _NONE)):
            values.append(v)
        return len(n) - 1

    over: dict[int, tuple[int, str]] = {}  # a piece's own node: conv_id and prefix of the node above
    for p, start, up, above, count, first, sha, digests, sizes in zip(rows.prefix, rows.depth, rows.parent, rows.above, rows.n, rows.least, rows.ends_sha256, rows.digests, rows.sizes, strict=True):
        at = tops.get((start, p))
        if at is None:
            at = tops[(start, p)] = made(start, sizes[start - 1], -1)
            over[at] = (up, above)
        for k in range(start, len(digests) + 1):
            if k > start:
                following = children[at].get(digests[k - 1])
                if following is None:
                    following = children[at][digests[k - 1]] = made(k, sizes[k - 1], at)
                at = following
            n[at] += count
            least[at] = first if least[at] is None else min(first, least[at])
        ends[at] = sha
    leaves, saved, out = [0] * len(n), [0] * len(n), []
    stack = [(at, False) for at in tops.values()]
    while stack:
        at, below_done = stack.pop()
        if not below_done:
            stack.append((at, True))
            stack.extend((c, False) for c in children[at].values())
            continue
        leaves[at] += not children[at]
        saved[at] += (n[at] - 1) * size[at]
        if (up := parent[at]) >= 0:
            leaves[up] += leaves[at]
            saved[up] += saved[at]
        conv, prefix = over[at] if up < 0 else (least[up], None)
        out.append((depth[at], least[at], conv, n[at], len(children[at]), leaves[at], saved[at], ends[at], prefix))
    return pd.DataFrame(out, columns=["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "above"])


def _pieces(whole: DataFrame, root: int, most_turns: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Sequences by the piece they fall into, and by depth from 1 the nodes whose subtries were
    dealt anew.  A piece is known by the digest of its first turns (`prefix`); `above` is that of the
    node it hangs under and `parent` the conv_id there."""
    rows = whole.where(F.size("digests") > 0).withColumns({"above": F.lit(""), "prefix": F.get("digests", F.lit(0)), "parent": F.lit(root)})
    pieces, split, depth = [], [], 1
    while True:
        here = F.when(F.size("digests") == depth, F.col("ends_sha256"))
        size = F.get("sizes", F.lit(depth - 1))
        sums = rows.groupBy("prefix").agg(
            F.min("least").alias("conv_id"), F.first("parent").alias("parent_conv_id"), F.sum("n").alias("n_convs"), F.coalesce(F.max(here), F.lit(_NONE)).alias("ends_sha256"),
            F.first("above").alias("above"), F.first(size).alias("size"), F.sum(F.size("digests") - depth + 1).alias("turns"), F.count("*").alias("different"),
        )
        large = written(sums.where((F.col("turns") > most_turns) & (F.col("different") > 1)), "trie-large")
        if not large.limit(1).count():
            return [*pieces, rows.withColumn("depth", F.lit(depth))], split
        split.append(large)
        met = rows.join(large.select("prefix", F.col("conv_id").alias("over")), "prefix", "left")
        pieces.append(met.where("over is null").drop("over").withColumn("depth", F.lit(depth)))
        below = met.where(F.col("over").isNotNull() & (F.size("digests") > depth))
        following = F.md5(F.concat("prefix", F.get("digests", F.lit(depth))))
        rows = written(below.withColumns({"above": F.col("prefix"), "prefix": following, "parent": F.col("over")}).drop("over"), "trie-below")
        depth += 1


def nodes(convs: DataFrame, most_turns: int = MOST_TURNS) -> DataFrame:
    """One row a node, of NODE, of conversations with their turns (`sequences`)."""
    spark = convs.sparkSession
    whole = written(distinct_sequences(convs), "trie-sequences")
    ends = F.max(F.when(F.size("digests") == 0, F.col("ends_sha256")))
    root = whole.agg(F.min("least").alias("least"), F.sum("n").alias("n"), ends.alias("ends"), F.sum(F.size("digests") + 1).alias("turns")).first()
    if root.n is None:
        return spark.createDataFrame([], NODE)
    pieces, split = _pieces(whole, root.least, most_turns)
    names = pieces[0].columns
    dealt = pieces[0]
    for piece in pieces[1:]:
        dealt = dealt.unionByName(piece)
    tasks = max(parallelism(spark), 2 * root.turns // most_turns)
    walked = dealt.select(*names, F.pmod(F.xxhash64("depth", "prefix"), F.lit(tasks)).alias("task")).groupBy("task").applyInPandas(lambda rows: _walked(rows), f"{NODE}, above string")
    found = written(walked, "trie-nodes")
    columns = [c.split()[0] for c in NODE.split(", ")]
    out, below = [found.select(columns)], found.where("above is not null").select("depth", "above", "n_leaves", "saved_tokens")
    summit = spark.createDataFrame([(root.least, None, root.n, root.ends or _NONE, None, 0, "")], "conv_id long, parent_conv_id long, n_convs long, ends_sha256 string, above string, size long, prefix string")
    over = None
    for depth, large in reversed(list(enumerate([summit, *split]))):
        tops = below.where(F.col("depth") == depth + 1).select("above", "n_leaves", "saved_tokens")
        tops = tops if over is None else tops.unionByName(over.select("above", "n_leaves", "saved_tokens"))
        sums = tops.groupBy(F.col("above").alias("prefix")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        zero = F.lit(0).cast("long")
        over = large.select("prefix", "above", "conv_id", "parent_conv_id", "n_convs", "ends_sha256", "size", F.lit(depth).cast("long").alias("depth")).join(sums, "prefix", "left")
        over = over.withColumns({
            "n_children": F.coalesce("n_children", zero), "n_leaves": F.coalesce("leaves", F.lit(1).cast("long")),
            "saved_tokens": F.coalesce("saved", zero) + (F.col("n_convs") - 1) * F.col("size"),
        })
        if depth:
            over = written(over, "trie-split")
        out.append(over.select(columns))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result
