"""Merkle manifests of a dataset: a digest of every row, a root of each group and one of all.

Nodes of a group are numbered in order of their key.  A level is a window partitioned by group
and parent index: its ordered full frame collects the digests of the parent's children, which are
the parent's preimage and, but for a node itself, its siblings.  Rows are dealt once to runs of
2^LEVELS nodes, whose tree is made without a shuffle; only the first row of a node hands its
digest on, so that a parent counts once.  Then parents are deduplicated to one row a run, which
are the nodes of the next round.  Each round has 2^LEVELS times fewer rows, and no window holds
more, however large a group is.  Top down, each round joins the path above to its runs.

A row's proof is its siblings by level, left and right of it; `folded` makes the root of a leaf and
a proof again.  A lone last node becomes the digest of itself; a group of one node is that node.

Rows that are equal in group and key are in order of their leaf; equal leaves are alike in all but
their proof, whose order is then not fixed.  Null keys and null groups come first.  An empty
table has no rows and no root.  Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import parallelism, release, written

#: Levels of the tree that are made of one shuffle.
LEVELS = 8
#: Columns of a leaf, in order (fixed by the contract).
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field with its length before it, `-` for null."""
    text = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, start, lambda node, s: digest(s["left"], node, s["right"]))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds `_at`, the number of a row in its `_group` by the order, and `_n`, rows of the group.

    Rows are dealt by ranges of the whole order and written with the range they fell into; a
    row's number is its place in its range and the rows of the ranges before.  A group may
    span any number of ranges; rows that are equal in all are spread by a number.
    """
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parallelism(rows.sparkSession), "_group", *order, "_tie")
    held = written(ranged.withColumn("_range", F.spark_partition_id()), f"{name}-ranges")
    sizes = held.groupBy("_group", "_range").agg(F.count("*").alias("_rows"))
    by_group = Window.partitionBy("_group")  # a row for each range that the group is in
    before = F.sum("_rows").over(by_group.orderBy("_range")) - F.col("_rows")
    offsets = sizes.select("_group", "_range", before.alias("_before"), F.sum("_rows").over(by_group).alias("_n"))
    place = F.row_number().over(Window.partitionBy("_group", "_range").orderBy(*order, "_tie")) - 1
    placed = held.withColumn("_place", place).join(offsets, ["_group", "_range"])
    found = written(placed.withColumn("_at", F.col("_place") + F.col("_before")).drop("_tie", "_range", "_place", "_before"), name)
    release(held)
    return found


def _climbed(nodes: DataFrame) -> DataFrame:
    """Adds `_run`, `_path` (the siblings of up to LEVELS levels) and `_top`, the digest they end at."""
    rows = nodes.withColumn("_run", F.shiftright("_at", LEVELS)).repartition("_group", "_run")
    rows = rows.withColumn("_path", F.array().cast(_PATH)).withColumn("_top", F.col("_node"))
    for level in range(LEVELS):
        bit, first = F.shiftright("_at", level) % 2, F.col("_at") % (1 << level) == 0
        parent = Window.partitionBy("_group", "_run", F.shiftright("_at", level + 1)).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("_children", F.when(F.col("_n") > (1 << level), F.collect_list(F.when(first, F.col("_top"))).over(parent)))
        left = F.when(bit == 1, F.get("_children", F.lit(0))).otherwise("")
        right = F.when(bit == 0, F.coalesce(F.get("_children", F.lit(1)), F.lit(""))).otherwise("")
        grown = F.concat("_path", F.array(F.struct(left.alias("left"), right.alias("right"))))
        more = F.col("_children").isNotNull()
        rows = rows.withColumns({"_path": F.when(more, grown).otherwise(F.col("_path")), "_top": F.when(more, F.sha2(F.array_join("_children", ""), 256)).otherwise(F.col("_top"))})
    return rows.drop("_children")


def tree(nodes: DataFrame, crown: bool = False) -> DataFrame:
    """Adds `path`, the siblings up to the root, `subroot`, the root of the node's group, and
    `root`: the same, or with `crown` that of the tree over all groups in their order, which the path
    then goes on to.  Nodes are rows of (`_group`, `_node`, `_at`, `_n`) and further columns."""
    kept = [c for c in nodes.columns if c not in ("_group", "_node", "_at", "_n")]
    climbed = _climbed(nodes)
    size = F.shiftright(F.col("_n") + ((1 << LEVELS) - 1), LEVELS)
    runs = written(climbed.where(F.col("_at") % (1 << LEVELS) == 0).select("_group", F.col("_top").alias("_node"), F.col("_run").alias("_at"), size.alias("_n"), F.col("_run").alias("_of")), "manifest-runs")
    top = F.col("_top")
    if runs.where("_of > 0").limit(1).count():
        above = written(tree(runs, crown).select("_group", F.col("_of").alias("_run"), "path", "subroot", "root"), "manifest-above")
        return climbed.join(above, ["_group", "_run"]).select(*kept, "_group", F.concat("_path", "path").alias("path"), "subroot", "root")
    if not crown:
        return climbed.select(*kept, "_group", F.col("_path").alias("path"), top.alias("subroot"), top.alias("root"))
    groups = numbered(runs.select(F.lit("").alias("_group"), "_node", F.col("_group").alias("_of")), ["_of"], "manifest-groups")
    above = written(tree(groups).select(F.col("_of").alias("_group"), F.col("path").alias("_rest"), "root"), "manifest-crown")
    return climbed.join(above, "_group").select(*kept, "_group", F.concat("_path", "_rest").alias("path"), top.alias("subroot"), "root")


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", changed: Column | None = None) -> DataFrame:
    """The key, leaf, subroot, root and path of every row; with `changed` also `start`, the leaf
    of the row with n_chars as `changed` makes them."""
    fields = [F.col(f) for f in FIELDS]
    own = leaf(*fields)
    start = own if changed is None else F.when(changed.eqNullSafe(F.col("n_chars")), own).otherwise(leaf(*(changed if f == "n_chars" else F.col(f) for f in FIELDS)))
    # no null, and null first: its order is that of the group
    named = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    leaves = written(docs.select(named.alias("_group"), F.col(key).alias("_key"), own.alias("_node"), start.alias("start")), "manifest-leaves")
    nodes = numbered(leaves, ["_key", "_node"], "manifest-nodes").withColumn("leaf", F.col("_node"))
    release(leaves)
    return tree(nodes, crown=True).select(F.col("_key").alias(key), "leaf", "start", "subroot", "root", "path")


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, left to right at each level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def verified(rows: DataFrame, start: str = "start") -> DataFrame:
    """Adds `folded_root`, which `start` gives with the row's path, and whether it is the root."""
    with_root = rows.withColumn("folded_root", folded(F.col(start), F.col("path")))
    return with_root.withColumn("verified", F.col("folded_root") == F.col("root"))
