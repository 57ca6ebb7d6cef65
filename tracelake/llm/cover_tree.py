"""Near-duplicate vectors: all pairs over a cosine, exactly, by a dual traversal of a cover tree.

The tree is over angles. Spark splits nodes level by level: the centres of a node are a greedy net of a bounded sample
of its rows, at half the node's radius or less, that keeps the node's own centre; every row goes to its nearest
centre, and the covering radius is measured over all rows, so bounds hold whatever the sample. Below twice the
threshold's angle a centre's ball and what lies beyond it part, so that a hot group of copies ends in a node of less
than half that angle. Leaves are continued in numpy with nets of halving radii, in full.

Pairs of nodes are walked from the root, first as Spark joins, then within pairs of leaves. A pair whose nearest
members can't be near enough is pruned; one whose farthest members are near enough is taken whole, as two counts and
one link; only what is left is opened, down to rows. So a group of copies costs about its size, and no pair of rows is
ever a row of a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch

#: Rows of a leaf at most, rows of a node that are assigned in one task, and centres of one split at most.
LEAF_ROWS, TASK_ROWS, CENTRES = 8192, 32768, 1024
#: Angles are trusted this far; what is nearer to a bound is opened.
EPS = 1e-6


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their unit vectors, for each length of vector; null, empty, zero, null or non-finite components: left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = column.offsets.to_numpy()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    size = np.where(valid, np.diff(offs), 0)
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        m = values[offs[rows][:, None] + np.arange(n)]
        rows, m = rows[fine := np.isfinite(m).all(axis=1)], m[fine]
        most = np.abs(m).max(axis=1, initial=0)
        rows, m = rows[most > 0], m[most > 0] / most[most > 0][:, None]
        if len(rows):
            yield rows, m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _unit_rows(vectors: DataFrame) -> DataFrame:
    """(uid, dim, v) of the vectors that can link; v holds doubles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, m in units(batch.column("embedding")):
                v = pa.array([x.tobytes() for x in m], pa.binary())
                yield pa.record_batch([batch.column("uid").take(pa.array(rows)), pa.array(np.full(len(rows), m.shape[1], np.int32)), v], ["uid", "dim", "v"])

    return vectors.select("uid", "embedding").mapInArrow(run, "uid long, dim int, v binary")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(np.float64).reshape(n, -1)


def net(m: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """A greedy net: centres farther than ``radius`` from each other, the first row among them, and each row's first centre within it."""
    least = math.cos(radius)
    centres, of, left = [], np.full(len(m), -1), np.arange(len(m))
    while len(left):
        block, left = left[:256], left[256:]
        near = m[block] @ m[block].T >= least
        free = np.ones(len(block), bool)
        for i in range(len(block)):
            if free[i]:
                mine = near[i] & free
                mine[i] = True
                of[block[mine]] = len(centres)
                centres.append(block[i])
                free &= ~mine
        fresh = np.array(centres[of[block].min() :])
        for at in range(0, len(left), 4096):
            some = left[at : at + 4096]
            near = m[some] @ m[fresh].T >= least
            hit = near.any(axis=1)
            of[some[hit]] = len(centres) - len(fresh) + near[hit].argmax(axis=1)
        left = left[of[left] < 0]
    return np.array(centres), of


def _split(rows: DataFrame, big: DataFrame, t: float, leaf_rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """One level: ``rows(uid, v, h, node)`` of the nodes ``big`` with their children as nodes, and these children."""

    def centres(table: pa.Table) -> pa.Table:
        order = np.argsort(table["h"].to_numpy())[:CENTRES]
        m = np.vstack([_matrix(table["center"][:1]), _matrix(table["v"])[order]])
        r = table["r"][0].as_py()
        while True:
            r /= 2
            found, _ = net(m, r)
            if len(found) > 1 or r <= t / 2:
                break
        k = len(found)
        return pa.table({"node": pa.array([table["node"][0].as_py()] * k), "k": pa.array(np.arange(k, dtype=np.int32)), "c": pa.array([m[i].tobytes() for i in found], pa.binary()), "r": pa.array(np.full(k, r))})

    def assign(rows: pa.Table, nets: pa.Table) -> pa.Table:
        nets = nets.sort_by("k")
        node, r = nets["node"][0].as_py(), nets["r"][0].as_py()
        m, c = _matrix(rows["v"]), _matrix(nets["c"])
        cosine = np.concatenate([m[a : a + 4096] @ c.T for a in range(0, len(m), 4096)]) if len(m) else np.zeros((0, len(c)))
        k = cosine.argmax(axis=1)
        angle = _angle(cosine[np.arange(len(m)), k])
        part = np.where((angle > r) & (r <= 2 * t), 1, 0)
        child = [f"{node}.{a}{'o' if b else ''}" for a, b in zip(k.tolist(), part.tolist(), strict=True)]
        return pa.table({"uid": rows["uid"], "v": rows["v"], "h": rows["h"], "node": pa.array(child, pa.string()), "parent": pa.array([node] * len(m), pa.string()), "k": pa.array(k.astype(np.int32)), "angle": pa.array(angle)})

    share = F.least(F.lit(float(CENTRES)), F.greatest(F.lit(4.0), F.ceil(2 * F.col("size") / leaf_rows))) / F.col("size")
    in_big = rows.join(big.select("node", "size", "center", "r"), "node")
    sample = in_big.where(F.pmod("h", F.lit(1 << 30)) < 2 * share * (1 << 30)).select("node", "h", "v", "r", "center")
    nets = scratch.keep(sample.unionByName(big.select("node", F.lit(0).cast("long").alias("h"), F.col("center").alias("v"), "r", "center")).groupBy("node").applyInArrow(centres, "node string, k int, c binary, r double"), "nets")
    parts = F.ceil(F.col("size") / TASK_ROWS).cast("long")
    dealt = rows.join(big.select("node", parts.alias("parts")), "node").select("uid", "v", "h", "node", F.pmod("h", "parts").alias("part"))
    copies = nets.join(big.select("node", parts.alias("parts")), "node").select("node", "k", "c", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    out = dealt.groupBy("node", "part").cogroup(copies.groupBy("node", "part")).applyInArrow(assign, "uid long, v binary, h long, node string, parent string, k int, angle double")
    out = scratch.keep(out, "level")
    kids = out.groupBy("node", "parent", "k").agg(F.count("*").alias("size"), F.max("angle").alias("radius"), F.min("uid").alias("rep"))
    kids = kids.join(nets.select(F.col("node").alias("parent"), "k", F.col("c").alias("center"), "r"), ["parent", "k"])
    return out.select("uid", "v", "h", "node"), scratch.keep(kids.select("node", "parent", "size", "radius", "rep", "center", "r"), "nodes")


def build_tree(rows: DataFrame, t: float, leaf_rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Leaves' rows ``(uid, v, node)`` and all nodes ``(node, parent, size, radius, rep, center, leaf)`` of ``rows(uid, dim, v)``; a root for each dim."""
    rows = rows.select("uid", "v", F.xxhash64("v", "uid").alias("h"), F.col("dim").cast("string").alias("node"))
    root = rows.groupBy("node").agg(F.count("*").alias("size"), F.lit(math.pi).alias("radius"), F.min("uid").alias("rep"), F.min_by("v", "h").alias("center"), F.lit(math.pi).alias("r"))
    level = scratch.keep(root.select("node", F.lit(None).cast("string").alias("parent"), "size", "radius", "rep", "center", "r"), "nodes")
    leaves, nodes = [], []
    dense = F.col("radius") <= t / 2 - EPS
    while True:
        small, big = F.col("size") <= leaf_rows, level.where((F.col("size") > leaf_rows) & ~dense)
        nodes.append(level.withColumn("leaf", small))
        leaves.append(rows.join(level.where(small).select("node"), "node").select("uid", "v", "node"))
        # a large dense node is parted by hash: pairs of its parts are never opened
        heavy = level.where(dense & ~small)
        parted = rows.join(heavy.select("node", F.ceil(F.col("size") / leaf_rows).cast("long").alias("n"), "center", "radius", "r"), "node")
        parted = parted.withColumn("part", F.concat("node", F.lit(".p"), F.pmod("h", "n").cast("string")))
        leaves.append(parted.select("uid", "v", F.col("part").alias("node")))
        parts = parted.groupBy("part", "node").agg(F.count("*").alias("size"), F.first("radius").alias("radius"), F.min("uid").alias("rep"), F.first("center").alias("center"), F.first("r").alias("r"))
        nodes.append(parts.select(F.col("part").alias("node"), F.col("node").alias("parent"), "size", "radius", "rep", "center", "r", F.lit(True).alias("leaf")))
        if big.isEmpty():
            break
        rows, level = _split(rows, big, t, leaf_rows, scratch)
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return union(leaves), scratch.keep(union(nodes).drop("r"), "tree")


def _walk(nodes: DataFrame, t: float, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """Pairs of nodes that are taken whole, and pairs of leaves that have to be compared."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            angle = _angle(np.array([float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(b.column("ca").to_pylist(), b.column("cb").to_pylist(), strict=True)]))
            angle[b.column("a").to_numpy(zero_copy_only=False) == b.column("b").to_numpy(zero_copy_only=False)] = 0
            reach = b.column("ra").to_numpy() + b.column("rb").to_numpy()
            leaf = b.column("la").to_numpy(zero_copy_only=False) & b.column("lb").to_numpy(zero_copy_only=False)
            verdict = np.where(angle - reach > t + EPS, "prune", np.where(angle + reach <= t - EPS, "whole", np.where(leaf, "compare", "open")))
            yield pa.record_batch([b.column("a"), b.column("b"), pa.array(verdict.tolist(), pa.string())], ["a", "b", "verdict"])

    facts = lambda x: nodes.select(F.col("node").alias(x), F.col("center").alias(f"c{x}"), F.col("radius").alias(f"r{x}"), F.col("leaf").alias(f"l{x}"))
    kids = nodes.where("parent is not null").select("parent", "node").unionByName(nodes.where("leaf").select(F.col("node").alias("parent"), "node"))
    pairs = nodes.where("parent is null").select(F.col("node").alias("a"), F.col("node").alias("b"))
    whole, compare = [], []
    while True:
        judged = scratch.keep(pairs.join(facts("a"), "a").join(facts("b"), "b").mapInArrow(judge, "a string, b string, verdict string"), "pairs")
        whole.append(judged.where("verdict = 'whole'").select("a", "b"))
        compare.append(judged.where("verdict = 'compare'").select("a", "b"))
        todo = judged.where("verdict = 'open'")
        if todo.isEmpty():
            return whole, compare
        opened = todo.join(kids.select(F.col("parent").alias("a"), F.col("node").alias("x")), "a").join(kids.select(F.col("parent").alias("b"), F.col("node").alias("y")), "b")
        pairs = opened.where("a <> b or x <= y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


class Leaf(NamedTuple):
    """Rows of a leaf in the order of its tree; of each level the first rows (centres) and the radii of its nodes. The last level is the rows."""

    uid: np.ndarray
    m: np.ndarray
    begin: list[np.ndarray]
    radius: list[np.ndarray]


def grow(uid: np.ndarray, m: np.ndarray, t: float) -> Leaf:
    """The tree of a leaf: nets of halving radii until each node is a row or narrower than half of ``t``."""
    n, begins, radii = len(m), [], []
    order, begin = np.arange(n), np.array([0])
    r = min(math.pi / 4, float(_angle(m @ m[0]).max()) / 2)
    while len(begin) < n:
        new, radius, moved = [], [], []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), n], strict=True):
            rows = order[a:b]
            reach = _angle(m[rows] @ m[rows[0]])
            reach[0] = 0
            if b - a == 1 or reach.max() <= t / 2 - EPS:
                new.append(np.array([a]))
                radius.append(np.array([reach.max()]))
                moved.append(rows)
                continue
            centres, of = net(m[rows], r)
            sort = np.lexsort((np.arange(b - a) != centres[of], of))  # a centre comes first
            rows, of = rows[sort], of[sort]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            reach = _angle(np.einsum("ij,ij->i", m[rows], m[rows[first]][of]))
            reach[first] = 0
            new.append(a + first)
            radius.append(np.maximum.reduceat(reach, first))
            moved.append(rows)
        order, fresh, radius = np.concatenate(moved), np.concatenate(new), np.concatenate(radius)
        if len(fresh) > len(begin) or not begins:
            begins.append(fresh)
            radii.append(radius)
        begin = fresh
        if (radius <= t / 2 - EPS).all():
            break
        r /= 2
    if not begins or len(begins[-1]) < n:
        begins.append(np.arange(n))
        radii.append(np.zeros(n))
    return Leaf(uid[order], m[order], begins, radii)


class _Sets:
    """Sets of rows that links join, named by their smallest row."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.of[x], self.of[y]
            if not (apart := a != b).any():
                return
            np.minimum.at(self.of, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while ((up := self.of[self.of]) != self.of).any():
                self.of = up


class _Traversal:
    """The walk over pairs of nodes of two leaves: counts of links by row, and the sets that links join."""

    def __init__(self, one: Leaf, other: Leaf, least: float, same: bool) -> None:
        self.trees, self.least, self.t, self.same = (one, other), least, math.acos(least), same
        self.depth = max(len(one.begin), len(other.begin))
        self.shift = 0 if same else len(one.uid)
        self.sets = _Sets(len(one.uid) + (0 if same else len(other.uid)))
        self.counts = np.zeros(len(one.uid) + 1, np.int64), np.zeros(len(other.uid) + 1, np.int64)  # by differences
        self.joined = np.zeros(len(one.uid) + 1, np.int64), np.zeros(len(other.uid) + 1, np.int64)  # rows that are of one set with the row before
        self.ends = [[np.append(b, len(tree.uid)) for b in tree.begin] for tree in self.trees]

    def level(self, side: int, level: int) -> int:
        return min(level, len(self.trees[side].begin) - 1)

    def range(self, side: int, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = self.ends[side][self.level(side, level)]
        return ends[i], ends[i + 1]

    def kids(self, side: int, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and number of the children of nodes."""
        begin = self.trees[side].begin
        if level + 1 >= len(begin):
            return i, np.ones(len(i), np.int64)
        at = np.searchsorted(begin[level + 1], self.ends[side][level])
        return at[i], at[i + 1] - at[i]

    def take(self, level: int, i: np.ndarray, j: np.ndarray) -> None:
        """All rows of node i are linked with all rows of node j."""
        (a, ae), (b, be) = self.range(0, level, i), self.range(1, level, j)
        n = (be - b) - (self.same & (i == j))
        sides = [(0, a, ae, n)] if self.same else [(0, a, ae, n), (1, b, be, ae - a)]
        for side, begin, end, more in sides:
            np.add.at(self.counts[side], begin, more)
            np.add.at(self.counts[side], end, -more)
            wide = end - begin > 1
            np.add.at(self.joined[side], begin[wide] + 1, 1)
            np.add.at(self.joined[side], end[wide], -1)
        self.sets.join(a, b + self.shift)

    def step(self, level: int, i: np.ndarray, j: np.ndarray, cosine: np.ndarray) -> None:
        """Judge pairs of nodes: take, prune or open."""
        if level == self.depth - 1:
            link = cosine >= self.least
            if self.same:
                link &= i != j
            return self.take(level, i[link], j[link])
        angle = _angle(cosine)
        if self.same:
            angle[i == j] = 0
        reach = self.trees[0].radius[self.level(0, level)][i] + self.trees[1].radius[self.level(1, level)][j]
        whole = angle + reach <= self.t - EPS
        left = ~whole & (angle - reach <= self.t + EPS)
        self.take(level, i[whole], j[whole])
        self.open(level, i[left], j[left])

    def open(self, level: int, i: np.ndarray, j: np.ndarray) -> None:
        (a, na), (b, nb) = self.kids(0, level, i), self.kids(1, level, j)
        total = na * nb
        for k in np.flatnonzero(total > 2048).tolist():
            self.dense(level + 1, np.arange(a[k], a[k] + na[k]), np.arange(b[k], b[k] + nb[k]))
        few = total <= 2048
        a, b, nb, total = a[few], b[few], nb[few], total[few]
        cuts = np.flatnonzero(np.diff(np.cumsum(total) // 65536, prepend=0)).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(total)], strict=True):
            if lo == hi:
                continue
            pair = np.repeat(np.arange(lo, hi), total[lo:hi])
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(total[lo:hi]) - total[lo:hi], total[lo:hi])
            x, y = a[pair] + nth // nb[pair], b[pair] + nth % nb[pair]
            mx, my = self.centre(0, level + 1, x), self.centre(1, level + 1, y)
            self.step(level + 1, x, y, np.einsum("ij,ij->i", mx, my))

    def centre(self, side: int, level: int, i: np.ndarray) -> np.ndarray:
        return self.trees[side].m[self.range(side, level, i)[0]]

    def dense(self, level: int, i: np.ndarray, j: np.ndarray) -> None:
        """All pairs of many nodes, in blocks; those that a bound with the largest radius prunes make no pair."""
        other = self.centre(1, level, j)
        ra, rb = self.trees[0].radius[self.level(0, level)][i], self.trees[1].radius[self.level(1, level)][j].max()
        floor = np.where(ra + rb > 0, np.cos(np.minimum(math.pi, self.t + ra + rb + EPS)), self.least - EPS)
        rows = max(1, (1 << 21) // len(j))
        for at in range(0, len(i), rows):
            cosine = self.centre(0, level, i[at : at + rows]) @ other.T
            x, y = np.nonzero(cosine >= floor[at : at + rows, None])
            self.step(level, i[at + x], j[y], cosine[x, y])

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.dense(0, np.arange(len(self.trees[0].begin[0])), np.arange(len(self.trees[1].begin[0])))
        for side in range(1 if self.same else 2):
            rows = np.flatnonzero(np.cumsum(self.joined[side]) > 0)
            self.sets.join(rows + side * self.shift, rows - 1 + side * self.shift)
        return np.cumsum(self.counts[0])[:-1], np.cumsum(self.counts[1])[:-1], self.sets.of


def compare(one: Leaf, other: Leaf, least: float, same: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each row of ``one`` and of ``other``, and the set of each row (those of ``other`` come after); ``same``: a leaf with itself."""
    return _Traversal(one, other, least, same).run()


def _grown(leaves: DataFrame, t: float) -> DataFrame:
    """One row a leaf: its tree as bytes."""

    def run(rows: pa.Table) -> pa.Table:
        uid = rows["uid"].to_numpy()
        sort = np.argsort(uid)  # whatever order the rows came in
        leaf = grow(uid[sort], _matrix(rows["v"])[sort], t)
        size = [len(b) for b in leaf.begin]
        blob = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.table({"node": rows["node"][:1], "uids": blob(leaf.uid), "m": blob(leaf.m), "sizes": pa.array([size], pa.list_(pa.int32())), "begins": blob(np.concatenate(leaf.begin)), "radii": blob(np.concatenate(leaf.radius))})

    return leaves.groupBy("node").applyInArrow(run, "node string, uids binary, m binary, sizes array<int>, begins binary, radii binary")


def _compared(pairs: DataFrame, trees: DataFrame, least: float, blocks: int) -> DataFrame:
    """(uid, n, other) for pairs of leaves: rows with links, how many, and a row of the same set.

    Leaves are dealt to ``blocks`` by hash and pairs to pairs of blocks, so that a leaf travels once for each block that it meets.
    """

    def read(t: pa.Table, i: int) -> Leaf:
        uid, m, begins, radii = (np.frombuffer(t[c][i].as_py(), d) for c, d in (("uids", np.int64), ("m", np.float64), ("begins", np.int64), ("radii", np.float64)))
        cuts = np.cumsum(t["sizes"][i].as_py())[:-1]
        return Leaf(uid, m.reshape(len(uid), -1), np.split(begins, cuts), np.split(radii, cuts))

    def run(pairs: pa.Table, t: pa.Table) -> pa.Table:
        leaves = {node: read(t, i) for i, node in enumerate(t["node"].to_pylist())}
        out = [(np.zeros(0, np.int64),) * 3]
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
            one, other, same = leaves[a], leaves[b], a == b
            na, nb, of = compare(one, other, least, same)
            uid, n = (one.uid, na) if same else (np.concatenate([one.uid, other.uid]), np.concatenate([na, nb]))
            k = np.flatnonzero(n)
            out.append((uid[k], n[k], uid[of[k]]))
        return pa.table({c: pa.array(np.concatenate(x)) for c, x in zip(("uid", "n", "other"), zip(*out, strict=True), strict=True)})

    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    pairs = pairs.withColumns({"x": F.least(block("a"), block("b")), "y": F.greatest(block("a"), block("b"))})
    sides = pairs.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(F.array("a", "b")).alias("node")).distinct().join(trees, "node")
    return pairs.groupBy("x", "y").cogroup(sides.groupBy("bx", "by")).applyInArrow(run, "uid long, n long, other long")


def linked(vectors: DataFrame, least: float = 0.95, leaf_rows: int = LEAF_ROWS, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Of ``vectors(uid, embedding)``, uid unique: ``(uid, n)`` with the links of each row that has some, and links ``(a, b)`` whose closure is that of all."""
    t = math.acos(least)
    scratch = scratch or Scratch(vectors.sparkSession, "cover")
    rows = scratch.keep(_unit_rows(vectors), "units")
    leaves, nodes = build_tree(rows, t, leaf_rows, scratch)
    leaves = scratch.keep(leaves, "leaves")
    whole, pairs = _walk(nodes, t, scratch)
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    whole, pairs = union(whole), union(pairs)
    blocks = max(1, -(-rows.count() // (2 * leaf_rows)))
    met = scratch.keep(_compared(pairs, scratch.keep(_grown(leaves, t), "trees"), least, blocks), "met")
    # what was taken whole above the leaves: counts and one link for all rows below
    fact = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"s{x}"), F.col("rep").alias(f"r{x}"))
    both = whole.join(fact("a"), "a").join(fact("b"), "b")
    more = both.select(F.col("a").alias("node"), (F.col("sb") - F.when(F.col("a") == F.col("b"), 1).otherwise(0)).alias("n"), F.col("ra").alias("rep"))
    more = more.unionByName(both.where("a <> b").select(F.col("b").alias("node"), F.col("sa").alias("n"), F.col("rb").alias("rep"))).groupBy("node").agg(F.sum("n").alias("n"), F.min("rep").alias("rep"))
    above = nodes.where("leaf").select("node", F.explode(F.expr("transform(sequence(1, size(split(node, '[.]'))), i -> array_join(slice(split(node, '[.]'), 1, i), '.'))")).alias("up"))
    above = above.join(more.withColumnRenamed("node", "up"), "up").groupBy("node").agg(F.sum("n").alias("n"), F.min_by("rep", F.length("up")).alias("rep"))
    taken = scratch.keep(leaves.select("uid", "node").join(above, "node").select("uid", "n", F.col("rep").alias("other")), "taken")
    counts = met.select("uid", "n").unionByName(taken.select("uid", "n")).groupBy("uid").agg(F.sum("n").alias("n")).where("n > 0")
    links = met.unionByName(taken).select(F.col("uid").alias("a"), F.col("other").alias("b")).unionByName(both.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).where("a <> b").distinct()
    return counts, links


def near_vectors(embeddings: DataFrame, least: float = 0.95, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Per vector ``vec_id, n_links, component_id, kept``: vectors with a cosine of ``least`` or more, and the smallest vec_id that links reach.

    Every row is a vector of its own, repeated ids included. Vectors that are null, empty, zero or hold nulls or
    non-finite components link with nothing, nor do vectors of different lengths. A null vec_id counts as no id: its
    component is named by the others, and ``kept`` is true where vec_id and component_id are both null. Columns other
    than ``vec_id`` and ``embedding`` are not looked at; an empty table gives no rows.
    """
    scratch = Scratch(embeddings.sparkSession, "near")
    own = scratch.keep(embeddings.select("vec_id", "embedding", F.monotonically_increasing_id().alias("uid")), "vectors")
    counts, links = linked(own, least, leaf_rows, scratch)
    label = connected_components(links, scratch).select(F.col("node").alias("uid"), "component")
    rows = own.select("uid", "vec_id").join(counts, "uid", "left").join(label, "uid", "left")
    rows = scratch.keep(rows.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component"), "labelled")
    least_id = rows.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("least_id"))
    out = rows.join(least_id, "component", "left").select("vec_id", "n_links", F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
