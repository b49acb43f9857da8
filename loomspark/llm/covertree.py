"""Exact threshold pairs of embeddings by a dual traversal of cover trees.

Unit vectors of one label with cosine at or above the threshold are at a chord distance of at
most sqrt(2 - 2 t).  Equal vectors are one point with a count.  Points of a label are dealt to
blocks by their nearest pivot and, where a pivot has many, by hash; a pair of blocks is
compared unless their pivots are farther apart than both covering radii and the threshold
allow.  In a task, either block is a tree of nested levels whose radii halve; pairs of nodes
are pruned by their covering radii, taken as linked in whole where the radii prove it, and
otherwise opened; pairs of points are decided by their cosine in double precision.

Each task returns links by point and a spanning forest of what it linked, not the pairs.
Points have numbers of their own, as vec_ids may repeat or be null.  Vectors that are null,
zero, of null or non-finite components, or without a label link with nothing.  Vectors of
different lengths don't link.  Repeated rows link with each other; with equal vec_ids they
count as rows.  Rows with a null vec_id link like others and rank last: a component's id is
null only if all of its vec_ids are.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, written

THRESHOLD = 0.93
#: Points of one block, about; and pivots of all labels together, at most.
BLOCK, PIVOTS = 2048, 1024
#: Slack for what rounding may do to a bound.
SLACK = 1e-9


@dataclass
class Node:
    """A centre, the points of its subtree, their greatest distance to it, and its children
    (none: every point is compared by itself)."""

    centre: np.ndarray
    points: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None


LEAF = 64


def tree(vectors: np.ndarray, points: np.ndarray | None = None, radius: float | None = None) -> Node:
    """Nested levels: the points of a node are covered greedily by balls of half its radius
    around points of its own."""
    points = np.arange(len(vectors)) if points is None else points
    centre = vectors[points[0]]
    gap = np.sqrt(np.maximum(((vectors[points] - centre) ** 2).sum(axis=1), 0))
    node = Node(centre, points, float(gap.max()))
    if len(points) <= LEAF or node.radius <= 1e-12:
        return node
    half = (radius if radius is not None else node.radius) / 2
    left, wide = points, []
    while len(left):
        ball = ((vectors[left] - vectors[left[0]]) ** 2).sum(axis=1) <= half * half
        wide.append(left[ball])
        left = left[~ball]
        if len(wide) > 256 and len(left):  # in many dimensions nearly all points stand alone
            wide += [left[k : k + LEAF] for k in range(0, len(left), LEAF)]
            break
    node.children = [tree(vectors, p, half) if len(p) > 1 else Node(vectors[p[0]], p, 0.0) for p in wide]
    node.centres = np.array([c.centre for c in node.children])
    node.radii = np.array([c.radius for c in node.children])
    return node


class Links:
    """Counts by point, and a spanning forest with the component of every point so far."""

    def __init__(self, n: int) -> None:
        self.counts = np.zeros(n, np.int64)
        self.parent, self.size = np.arange(n), np.ones(n, np.int64)
        self.edges: list[tuple[int, int]] = []

    def roots(self, points: np.ndarray) -> np.ndarray:
        """The representatives of the points' components; their paths are cut short."""
        found = self.parent[points]
        while not np.array_equal(up := self.parent[found], found):
            found = up
        self.parent[points] = found
        return found

    def join(self, a: int, points: np.ndarray) -> None:
        """Links point a to others; an edge is kept for each component that is new to it."""
        own = self.roots(np.array([a]))[0]
        theirs, at = np.unique(self.roots(points), return_index=True)
        new = theirs != own
        if new.any():
            met = np.append(theirs[new], own)
            largest = met[self.size[met].argmax()]
            self.size[largest] = self.size[met].sum()
            self.parent[met] = largest
            self.edges.extend((a, p) for p in points[at[new]].tolist())


def traverse(vectors: np.ndarray, weights: np.ndarray, a: Node, b: Node, threshold: float, links: Links) -> None:
    """Links between the points of two trees; of a tree with itself if they are the same one."""
    reach = np.sqrt(2 - 2 * threshold)
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        if not p.children and not q.children:
            _compare(vectors, weights, p, q, threshold, links)
            continue
        same = p is q
        if p.children and (not q.children or p.radius >= q.radius or same):
            kids, centres, radii = p.children, p.centres, p.radii
            others, far, wide = (p.children, p.centres, p.radii) if same else ([q], q.centre[None], np.array([q.radius]))
        else:
            kids, centres, radii = q.children, q.centres, q.radii
            others, far, wide = [p], p.centre[None], np.array([p.radius])
        gap = np.sqrt(np.maximum((centres**2).sum(1)[:, None] + (far**2).sum(1)[None] - 2 * centres @ far.T, 0))
        near = gap <= radii[:, None] + wide[None] + reach + SLACK
        proven = gap + radii[:, None] + wide[None] <= reach - 1e-6
        for i, j in np.argwhere(near).tolist():
            if same and j < i:
                continue
            x, y = kids[i], others[j]
            if proven[i, j] and x is not y:
                links.counts[x.points] += weights[y.points].sum()
                links.counts[y.points] += weights[x.points].sum()
                links.join(int(x.points[0]), y.points)
                links.join(int(y.points[0]), x.points)
            else:
                stack.append((x, y))


def _compare(vectors: np.ndarray, weights: np.ndarray, p: Node, q: Node, threshold: float, links: Links) -> None:
    cosines = vectors[p.points] @ vectors[q.points].T
    hit = cosines >= threshold
    # the matrix product may round differently from a sum in order; decide close ones by themselves
    for i, j in np.argwhere(np.abs(cosines - threshold) < 1e-12).tolist():
        hit[i, j] = float(np.sum(vectors[p.points[i]] * vectors[q.points[j]])) >= threshold
    if p is q:
        np.fill_diagonal(hit, False)
        links.counts[p.points] += hit @ weights[q.points]
        hit = np.triu(hit)
    else:
        links.counts[p.points] += hit @ weights[q.points]
        links.counts[q.points] += hit.T @ weights[p.points]
    for i in np.flatnonzero(hit.any(axis=1)).tolist():
        links.join(int(p.points[i]), q.points[hit[i]])


def _unit(v) -> np.ndarray:
    u = np.asarray(v, float)
    u = u / np.abs(u).max()  # neither overflows nor vanishes when squared
    return u / np.sqrt(np.sum(u * u))


def _may_link() -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    same = ["label", "v"]
    # adding 0.0 makes -0.0 the same component as 0.0
    rows = vectors.where(_may_link()).select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    rows = written(rows, "cover-rows")
    grouped = rows.groupBy(*same).agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    points = written(grouped.withColumns({"point": F.monotonically_increasing_id(), "h": F.xxhash64(*same)}), "cover-points")
    # pivots: points of least hash, one for each block's worth of points and PIVOTS at most
    pivots = points.orderBy("h", "point").limit(min(PIVOTS, -(-points.count() // block))).select("label", "v").collect()
    by_label: dict[str, list[np.ndarray]] = {}
    for r in pivots:
        by_label.setdefault(r.label, []).append(_unit(r.v))
    shared = spark.sparkContext.broadcast(by_label)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            units = np.array([_unit(v) for v in f.v] + [None], object)[:-1]
            dims = np.array([len(u) for u in units])
            cell, gap = np.full(len(f), -1), np.full(len(f), 2.0)
            for label in set(f.label):
                centres = shared.value.get(label, [])
                for n in set(dims[f.label == label].tolist()):
                    here = np.flatnonzero((f.label == label).to_numpy() & (dims == n))
                    if fits := [k for k, c in enumerate(centres) if len(c) == n]:
                        around = np.stack([centres[k] for k in fits])
                        u = np.stack(units[here])
                        nearest = (u @ around.T).argmax(axis=1)
                        cell[here], gap[here] = np.array(fits)[nearest], np.sqrt(((u - around[nearest]) ** 2).sum(axis=1))
            yield pd.DataFrame({"label": f.label, "dims": dims, "cell": cell, "gap": gap, "point": f.point, "weight": f.weight, "h": f.h, "u": units})

    dealt = written(points.select("label", "v", "point", "weight", "h").mapInPandas(deal, "label string, dims int, cell int, gap double, point long, weight long, h long, u array<double>"), "cover-dealt")
    cells = dealt.groupBy("label", "dims", "cell").agg(F.max("gap").alias("radius"), F.ceil(F.count("*") / block).cast("int").alias("parts"))
    blocks = written(cells.select("label", "dims", "cell", "radius", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "cover-blocks")
    reach = float(np.sqrt(2 - 2 * threshold))

    def far(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            gap = [0.0 if a == b or a < 0 or b < 0 else float(np.sqrt(((shared.value[label][a] - shared.value[label][b]) ** 2).sum())) for label, a, b in zip(f.label, f.cell, f.cell2, strict=True)]
            yield f[np.array(gap) <= f.radius + f.radius2 + reach + SLACK]

    left = blocks.select("label", "dims", "cell", "part", "radius")
    right = blocks.select("label", "dims", F.col("cell").alias("cell2"), F.col("part").alias("part2"), F.col("radius").alias("radius2"))
    pairs = left.join(right, ["label", "dims"]).where("cell < cell2 or (cell = cell2 and part <= part2)")
    pairs = pairs.mapInPandas(far, pairs.schema).withColumn("pair", F.xxhash64("label", "dims", "cell", "part", "cell2", "part2"))
    pairs = written(pairs.select("label", "dims", "cell", "part", "cell2", "part2", "pair"), "cover-pairs")
    sides = pairs.select("label", "dims", "cell", "part", "pair", F.lit(0).alias("side")).union(pairs.where("cell <> cell2 or part <> part2").select("label", "dims", "cell2", "part2", "pair", F.lit(1)))
    parts = blocks.select("label", "dims", "cell", "parts").distinct()
    placed = dealt.join(parts, ["label", "dims", "cell"]).withColumn("part", F.pmod("h", "parts").cast("int"))
    both = placed.join(sides, ["label", "dims", "cell", "part"]).select("pair", "side", "point", "weight", "u")

    def link(f: pd.DataFrame) -> pd.DataFrame:
        u, weight, point = np.stack(f.u.to_numpy()), f.weight.to_numpy(), f.point.to_numpy()
        side = f.side.to_numpy()
        ones, twos = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links = Links(len(u))
        if len(twos) and len(ones):
            traverse(u, weight, tree(u, ones), tree(u, twos), threshold, links)
        elif len(ones) and (f.side == 1).sum() == 0:
            root = tree(u, ones)
            traverse(u, weight, root, root, threshold, links)
        hit = np.flatnonzero(links.counts)
        edges = np.array(links.edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": np.concatenate([point[hit], point[edges[:, 0]]]), "b": np.concatenate([point[hit], point[edges[:, 1]]]), "n": np.concatenate([links.counts[hit], np.zeros(len(edges), np.int64)])})

    found = written(both.groupBy("pair").applyInPandas(link, "a long, b long, n long"), "cover-links")
    counts = written(found.where("n > 0").groupBy(F.col("a").alias("point")).agg(F.sum("n").alias("n")), "cover-counts")
    roots = components(found.where("n = 0").select("a", "b"), "cover")
    known = written(points.join(roots, points.point == roots.node, "left").select(*same, "point", "weight", F.coalesce("root", "point").alias("root"), "least"), "cover-roots")
    named = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(named, "root").join(counts, "point", "left")
    known = written(known.select(*same, (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.col("component").alias("root")), "cover-known")
    of_rows = rows.join(known, same).select("vec_id", "n", "root")
    usable = written(of_rows, "cover-result")
    rest = vectors.where(~_may_link()).select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n"), F.col("vec_id").cast("long").alias("root"))
    return usable.union(rest).select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("root").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("root")).alias("kept"))
