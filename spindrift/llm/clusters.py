"""Clusters of mutually similar vectors by bisecting k-means on the sphere.

The rows stay where they are; the tree of splits lives on the driver and holds
centres only.  A node is

* a leaf, if every member lies so near to its centre that any two members must be
  similar (the compactness limit);
* split by distance, if at least half of its members do: those are a leaf, the
  others a node of their own;
* split in two by two-means otherwise, the node of the largest dispersion first.

``bisect`` applies these rules to the rows it is given until every part is a leaf.
All open nodes of the tree are bisected at once: on a sample of each node, which
gives first centres for several levels of splits; then a pass over all rows moves
every centre to the mean of its rows, and a second one counts what lies within the
limit.  A node of at most ``local_rows`` rows is its own sample: ``bisect`` runs on
all its rows, many such nodes in one task.  So the tree has a few nodes per
``local_rows`` rows, and copies of one vector, however many, are a leaf at once.

A split can run through a group of similar vectors; so every leaf's most typical
member goes down the tree again, to all nodes whose bounding angle it reaches, and
is compared with the leaves there.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.vectors import arrow_vectors, matrix, stack
from spindrift.session import cut

#: Room for single precision in comparisons with the compactness limit.
_SLACK = 1e-6


@dataclass(frozen=True)
class Limits:
    """``min_cos``: least cosine within a cluster; ``local_rows``: rows of a node that are bisected together in one task;
    ``sample``: rows of a larger node on which its splits begin; ``least``: sampled rows below which a part is not split
    before all its rows are seen; ``block_rows``: leaves that are compared with a node at once."""

    min_cos: float = 0.7
    local_rows: int = 1000
    sample: int = 1024
    least: int = 32
    block_rows: int = 8192

    @property
    def leaf_cos(self) -> float:
        """Members this near to one point are similar to each other: half the angle."""
        return math.cos(math.acos(self.min_cos) / 2)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def two_means(x: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Two centres for rows that are not all equal: seeds far apart, then spherical two-means; both sides have rows."""
    first = int(np.argmin(x @ _unit(x.mean(0))))
    second = int(np.argmin(x @ x[first]))
    c = np.stack([x[first], x[second]]).astype(np.float64)
    for _ in range(rounds):
        right = x @ c[1] > x @ c[0]
        new = _unit(np.stack([x[~right].mean(0), x[right].mean(0)]))
        side = x @ new[1] > x @ new[0]
        if side.all() or not side.any() or np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


@dataclass
class Tree:
    """Node 0 is the root.  ``split[n]``: ('two', centres, children) or ('ball', centre, children); ``centre`` and
    ``low``, the least cosine to it, of the nodes at the ends."""

    leaf_cos: float
    split: dict[int, tuple[str, np.ndarray, tuple[int, int]]] = field(default_factory=dict)
    centre: dict[int, np.ndarray] = field(default_factory=dict)
    low: dict[int, float] = field(default_factory=dict)
    size: int = 1

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The lowest node of each row."""
        at = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node not in self.split or not len(rows):
                at[rows] = node
                continue
            kind, c, (a, b) = self.split[node]
            cos = x[rows] @ c.T
            right = cos[:, 1] > cos[:, 0] if kind == "two" else cos[:, 0] < self.leaf_cos
            todo += [(a, rows[~right]), (b, rows[right])]
        return at

    def add(self, node: int, kind: str, centres: np.ndarray) -> tuple[int, int]:
        a, b = self.size, self.size + 1
        self.size += 2
        self.split[node] = (kind, centres.astype(np.float32), (a, b))
        return a, b

    def below(self, node: int) -> list[int]:
        """The nodes at the ends below a node."""
        ends, todo = [], [node]
        while todo:
            n = todo.pop()
            if n in self.split:
                todo += self.split[n][2]
            else:
                ends.append(n)
        return ends

    def cones(self) -> dict[int, tuple[np.ndarray, float]]:
        """(centre, angle) around all rows of each node; nodes without rows have none."""
        out: dict[int, tuple[np.ndarray, float]] = {}
        for n in range(self.size - 1, -1, -1):
            if n not in self.split:
                if n in self.low:
                    out[n] = (self.centre[n], math.acos(min(1.0, max(-1.0, self.low[n] - _SLACK))))
                continue
            parts = [out[k] for k in self.split[n][2] if k in out]
            if parts:
                c = _unit(np.sum([p[0] for p in parts], axis=0))
                out[n] = (c, min(math.pi, max(math.acos(min(1.0, max(-1.0, float(c @ p[0])))) + p[1] for p in parts)))
        return out


def bisect(x: np.ndarray, leaf_cos: float, least: int = 1) -> tuple[Tree, dict[int, np.ndarray]]:
    """The splits of the rows ``x``, the largest dispersion first, and the rows of each end.

    With ``least`` = 1 every end is compact; parts of fewer rows than ``least`` stay as they are.
    """
    tree, ends = Tree(leaf_cos), {}
    heap: list[tuple[float, int, np.ndarray]] = [(0.0, 0, np.arange(len(x)))]
    while heap:
        _, node, rows = heapq.heappop(heap)
        y = x[rows]
        c = _unit(y.mean(0))
        cos = y @ c
        inside = cos >= leaf_cos - _SLACK
        if len(rows) == 1 or inside.all() or len(rows) < least:
            tree.centre[node], tree.low[node], ends[node] = c, float(cos.min()), rows
            continue
        if inside.sum() * 2 >= len(rows):
            core, rest = tree.add(node, "ball", c[None])
            tree.centre[core], tree.low[core], ends[core] = c, leaf_cos, rows[inside]
            parts = [(rest, rows[~inside])]
        else:
            two = two_means(y)
            right = y @ two[1] > y @ two[0]
            parts = list(zip(tree.add(node, "two", two), (rows[~right], rows[right]), strict=True))
        for n, p in parts:
            heapq.heappush(heap, (-float(len(p) - np.linalg.norm(x[p].sum(0))), n, p))
    return tree, ends


_SPLITS = "node long, at int, kind string, c array<double>, a int, b int"


def _begin(sampled: DataFrame, leaf_cos: float, limits: Limits) -> dict[int, list]:
    """For each sampled node (node, h, vec) its first splits, found on the sample."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = stack(pdf.sort_values("h")["vec"]).astype(np.float64)
        tree, ends = bisect(x, leaf_cos, limits.least)
        if not tree.split:
            # The sample is compact, though not all rows are: split by the limit around its centre.
            tree.add(0, "ball", tree.centre[0][None])
            if len(x) < limits.least and tree.low[0] < leaf_cos:
                tree.split[0] = ("two", two_means(x), tree.split[0][2])
        got = [(key[0], n, kind, c.ravel().tolist(), a, b) for n, (kind, c, (a, b)) in sorted(tree.split.items())]
        return pd.DataFrame(got, columns=["node", "at", "kind", "c", "a", "b"]).astype({"at": "int32", "a": "int32", "b": "int32"})

    out: dict[int, list] = {}
    for r in sampled.groupBy("node").applyInPandas(run, _SPLITS).orderBy("node", "at").collect():
        out.setdefault(r["node"], []).append(r)
    return out


def _sums(rows: DataFrame, tree: Tree, wanted: set[int], dim: int) -> dict[int, tuple[int, np.ndarray]]:
    """Number and vector sum of the rows at each wanted end."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x = matrix(b.column("vec"))
            at = tree.descend(x) if len(x) else np.zeros(0, np.int64)
            for node in wanted.intersection(np.unique(at).tolist()):
                own = at == node
                total[node] = total.get(node, 0.0) + np.concatenate([[own.sum()], x[own].sum(0, dtype=np.float64)])
        if total:
            yield pa.record_batch({"node": pa.array(list(total), pa.int64()), "s": pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))})

    parts = rows.select("vec").mapInArrow(add, "node long, s array<double>")
    got = parts.groupBy("node").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(dim + 1)]).alias("s")).collect()
    return {r["node"]: (int(r["s"][0]), np.array(r["s"][1:])) for r in got}


def _measure(rows: DataFrame, tree: Tree, wanted: dict[int, np.ndarray], expected: dict[int, float], limits: Limits, name: str) -> tuple[dict[int, dict], DataFrame]:
    """Of each wanted end: rows, least cosine to its centre, rows within the limit; and a sample (node, inside, h, vec).

    The sample holds, of each end and side of the limit, the rows of the smallest
    hashes; a task leaves out hashes that are too great by far for the rows expected.
    """
    leaf_cos, most = tree.leaf_cos, limits.sample
    centre = {n: c.astype(np.float32) for n, c in wanted.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        kept: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            x = matrix(b.column("vec"))
            at = tree.descend(x) if len(x) else np.zeros(0, np.int64)
            h = b.column("h").to_numpy(zero_copy_only=False)
            for node in centre.keys() & set(np.unique(at).tolist()):
                own = np.flatnonzero(at == node)
                cos = x[own] @ centre[node]
                within = cos >= leaf_cos
                s = seen.setdefault(node, [0, 2.0, 0])
                s[0], s[1], s[2] = s[0] + len(own), min(s[1], float(cos.min())), s[2] + int(within.sum())
                share = min(1.0, 4 * most / max(expected.get(node, 0.0), 1.0))
                few = own[within & (h[own] <= share * 2.0**64 - 2.0**63)]
                for side, some in ((True, few), (False, own[~within])):
                    if len(some):
                        hs, xs = h[some], x[some]
                        if (node, side) in kept:
                            hs, xs = np.concatenate([kept[node, side][0], hs]), np.concatenate([kept[node, side][1], xs])
                        best = np.argsort(hs, kind="stable")[:most]
                        kept[node, side] = (hs[best], xs[best])
        for node, s in seen.items():
            yield _measured([node], [0], s[0], s[1], s[2], None, None)
        for (node, side), (hs, xs) in kept.items():
            yield _measured([node] * len(hs), [1 if side else 2] * len(hs), None, None, None, hs, xs)

    def _measured(node, kind, n, low, inside, hs, xs) -> pa.RecordBatch:
        k = len(node)
        return pa.record_batch(
            {
                "node": pa.array(node, pa.int64()),
                "kind": pa.array(kind, pa.int32()),
                "n": pa.array([n] * k, pa.int64()),
                "low": pa.array([low] * k, pa.float64()),
                "inside": pa.array([inside] * k, pa.int64()),
                "h": pa.array(hs, pa.int64()) if hs is not None else pa.nulls(k, pa.int64()),
                "vec": arrow_vectors(xs) if xs is not None else pa.nulls(k, pa.list_(pa.float32())),
            }
        )

    got = rows.select(F.xxhash64("id").alias("h"), "vec").mapInArrow(run, "node long, kind int, n long, low double, inside long, h long, vec array<float>")
    got = cut(got, name)
    stats = got.where("kind = 0").groupBy("node").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.sum("inside").alias("inside")).collect()
    w = Window.partitionBy("node", "kind").orderBy("h")
    few = got.where("kind > 0").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select("node", (F.col("kind") == 1).alias("inside"), "h", "vec")
    return {r["node"]: r.asDict() for r in stats}, few


def grow(rows: DataFrame, dim: int, limits: Limits) -> tuple[Tree, set[int]]:
    """The tree of splits, and those of its ends whose rows are to be bisected together."""
    tree, local = Tree(limits.leaf_cos), set()
    wanted, expected = {0: np.zeros(dim)}, {0: 0.0}
    whole = _sums(rows, tree, {0}, dim)
    if whole:
        wanted[0], expected[0] = _unit(whole[0][1]), float(whole[0][0])
    parent: dict[int, float] = {}
    turn = 0
    while wanted:
        stats, sampled = _measure(rows, tree, wanted, expected, limits, f"turn{turn}")
        turn += 1
        both, outside, held = [], [], {}
        as_begun: set[int] = set()
        for node, s in stats.items():
            tree.centre[node], tree.low[node] = wanted[node], s["low"]
            if s["low"] >= limits.leaf_cos - _SLACK:
                continue
            n, of = s["n"], outside
            if s["inside"] * 2 >= n:
                core, rest = tree.add(node, "ball", wanted[node][None])
                tree.centre[core], tree.low[core] = wanted[node], limits.leaf_cos
                tree.centre[rest], tree.low[rest] = wanted[node], s["low"]
                n -= s["inside"]
            else:
                rest, of = node, both
                # Centres moved to the means of their rows can leave a node unsplit: then its next split stays as the sample has it.
                if parent.get(node) == n:
                    as_begun.add(node)
            if n <= limits.local_rows:
                local.add(rest)
            else:
                of.append(node)
                held[node] = (rest, float(n))
        wanted, expected, parent = {}, {}, {}
        if not held:
            break
        take = F.col("node").isin(both) | (F.col("node").isin(outside) & ~F.col("inside"))
        w = Window.partitionBy("node").orderBy("h")
        few = sampled.where(take).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limits.sample).drop("_r", "inside")
        roots = []
        for node, splits in _begin(few, limits.leaf_cos, limits).items():
            at = {0: held[node][0]}
            for r in splits:
                at[r["a"]], at[r["b"]] = tree.add(at[r["at"]], r["kind"], np.array(r["c"]).reshape(-1, dim))
            roots.append((node, at[0], held[node][1]))
        ends = {e: n for _, root, n in roots for e in tree.below(root)}
        found = _sums(rows, tree, set(ends), dim)
        for node, root, _ in roots:
            if node not in as_begun:
                _recentre(tree, root, found)
        for e, n in ends.items():
            count, s = found.get(e, (0, np.zeros(dim)))
            wanted[e], expected[e], parent[e] = _unit(s), float(count), n
        # The core of a ball keeps the centre that cut it out.
        wanted |= {core: c[0].astype(np.float64) for kind, c, (core, _) in tree.split.values() if kind == "ball" and core in wanted}
    return tree, local


def _recentre(tree: Tree, root: int, found: dict[int, tuple[int, np.ndarray]]) -> None:
    """Move the centres of all splits below ``root`` to the means of the rows on their sides."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        if n in tree.split:
            order.append(n)
            todo += tree.split[n][2]
    total = dict(found)
    for n in reversed(order):
        kind, c, (a, b) = tree.split[n]
        sides = [total.get(k, (0, 0.0)) for k in (a, b)]
        total[n] = (sides[0][0] + sides[1][0], sides[0][1] + sides[1][1])
        c = c.copy()
        for k in range(len(c)):
            if sides[k][0]:
                c[k] = _unit(sides[k][1])
        tree.split[n] = (kind, c, (a, b))


def leaves(rows: DataFrame, tree: Tree, local: set[int], limits: Limits) -> DataFrame:
    """(id, leaf, node, cos, vec): the leaf of each unit vector (id, vec), the tree's node it lies in and its cosine to the leaf's centre.

    ``vec`` is kept for a few members of each leaf only, the nearest to its centre among them.
    """
    leaf_cos = limits.leaf_cos
    centre = {n: c.astype(np.float32) for n, c in tree.centre.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = matrix(b.column("vec")), b.column("id").to_numpy(zero_copy_only=False)
            at = tree.descend(x) if len(x) else np.zeros(0, np.int64)
            cos, keep = np.ones(len(x)), np.zeros(len(x), bool)
            for node in np.unique(at).tolist():
                own = np.flatnonzero(at == node)
                if node in local:
                    keep[own] = True
                else:
                    cos[own] = x[own] @ centre[node]
                    keep[own[np.lexsort((ids[own], -cos[own]))[0]]] = True
            place = pa.array(np.where(keep, np.cumsum(keep) - 1, 0), mask=~keep)
            yield pa.record_batch({"id": b.column("id"), "node": pa.array(at), "cos": pa.array(cos), "vec": b.column("vec").filter(pa.array(keep)).take(place)})

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        x = stack(pdf["vec"]).astype(np.float64)
        inner, ends = bisect(x, leaf_cos)
        leaf, cos, best = np.zeros(len(x), np.int64), np.ones(len(x)), np.zeros(len(x), bool)
        for n, own in ends.items():
            leaf[own], cos[own] = n, x[own] @ inner.centre[n]
            best[own[np.argmax(cos[own])]] = True
        return pd.DataFrame({"id": pdf["id"], "leaf": (int(key[0]) << 32) + leaf + 1, "node": key[0], "cos": cos, "vec": pdf["vec"].where(best, None)})

    placed = cut(rows.select("id", "vec").mapInArrow(assign, "id long, node long, cos double, vec array<float>"), "placed")
    few = _nodes(rows, local)
    done = placed.join(few, "node", "left_anti").select("id", F.shiftleft("node", 32).alias("leaf"), "node", "cos", "vec")
    rest = placed.join(few, "node", "left_semi").groupBy("node").applyInPandas(finish, "id long, leaf long, node long, cos double, vec array<float>")
    return done.unionByName(rest)


def _nodes(rows: DataFrame, nodes: set[int]) -> DataFrame:
    return rows.sparkSession.createDataFrame([(n,) for n in sorted(nodes)], "node long")


def similar_leaves(members: DataFrame, tree: Tree, limits: Limits) -> DataFrame:
    """(a, b), a < b: leaves whose most typical members are similar.

    A member can only be similar to rows of a node if it lies within the node's
    angle and the angle of similarity of the node's centre; other nodes are never
    reached.  At a node it meets the leaves there, in blocks.
    """
    best = members.where("vec is not null").groupBy("leaf").agg(F.max_by(F.struct("node", "vec"), F.struct("cos", (-F.col("id")).alias("_id"))).alias("_m"))
    reps = cut(best.select("leaf", "_m.node", "_m.vec"), "reps")
    cones = {n: (c.astype(np.float32), r) for n, (c, r) in tree.cones().items()}
    angle, least, block_rows = math.acos(limits.min_cos), limits.min_cos, limits.block_rows

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, leaf = matrix(b.column("vec")), b.column("leaf").to_numpy(zero_copy_only=False)
            todo = [(0, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if node not in cones or not len(rows):
                    continue
                c, r = cones[node]
                rows = rows[x[rows] @ c >= math.cos(min(math.pi, angle + r)) - 1e-5]
                if node in tree.split:
                    todo += [(k, rows) for k in tree.split[node][2]]
                elif len(rows):
                    yield pa.record_batch({"leaf": pa.array(leaf[rows]), "node": pa.array(np.full(len(rows), node)), "vec": arrow_vectors(x[rows])})

    reached = reps.select("leaf", "vec").mapInArrow(reach, "leaf long, node long, vec array<float>")
    # The leaves that reach a node come in blocks of bounded size; the node's own leaves meet each of them.
    reached = cut(reached, "reached")
    blocks = reached.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))).cast("int").alias("blocks"))
    there = reached.join(blocks, "node").select("node", F.pmod(F.xxhash64("leaf"), "blocks").cast("int").alias("block"), "leaf", "vec", F.lit(False).alias("own"))
    own = reps.join(blocks, "node").select("node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "leaf", "vec", F.lit(True).alias("own"))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["own"]], pdf[~pdf["own"]]
        x, y = stack(left["vec"]), stack(right["vec"])
        a, b = left["leaf"].to_numpy(), right["leaf"].to_numpy()
        found = [np.zeros((2, 0), np.int64)]
        for lo in range(0, len(x) if len(y) else 0, 1024):
            p, q = np.nonzero(x[lo : lo + 1024] @ y.T >= least)
            pair = np.stack([a[lo + p], b[q]])
            found.append(np.stack([pair.min(0), pair.max(0)])[:, pair[0] != pair[1]])
        out = np.concatenate(found, axis=1)
        return pd.DataFrame({"a": out[0], "b": out[1]})

    return there.unionByName(own).groupBy("node", "block").applyInPandas(compare, "a long, b long").distinct()


def _join_leaves(edges: DataFrame) -> DataFrame:
    """(leaf, root): the smallest leaf reachable over the edges, for leaves with an edge."""
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("leaf"), F.least("a", "m").alias("root")), "label")
    while True:
        seen = both.join(label, both["b"] == label["leaf"]).groupBy("a").agg(F.min("root").alias("m"))
        new = label.join(seen, label["leaf"] == seen["a"], "left").select("leaf", F.least("root", "m").alias("root"))
        # Jump: the root's own root.
        up = label.select(F.col("leaf").alias("root"), F.col("root").alias("top"))
        new = cut(new.join(up, "root", "left").select("leaf", F.least("root", F.coalesce("top", "root")).alias("root")), "label")
        if not new.join(label.withColumnRenamed("root", "old"), "leaf").where("root <> old").limit(1).count():
            return new
        label = new


def cluster(vectors: DataFrame, dim: int, limits: Limits = Limits()) -> DataFrame:
    """(id, cluster_id, cos): the cluster of each unit vector (id, vec) that has a similar one.

    ``cluster_id`` is the smallest id of the cluster, ``cos`` the cosine to the
    centre of the member's leaf.  Vectors similar to no other are in no cluster and
    give no row.  If similarity is not transitive in the data, clusters are joined
    along chains of similar leaves.  Equal vectors are in one cluster.  An empty
    table gives no rows.
    """
    vectors = cut(vectors.select("id", "vec"), "vectors")
    tree, local = grow(vectors, dim, limits)
    members = cut(leaves(vectors, tree, local, limits), "leaves")
    roots = _join_leaves(similar_leaves(members, tree, limits))
    placed = members.select("id", "leaf", "cos").join(roots, "leaf", "left").select("id", "cos", F.coalesce("root", "leaf").alias("root"))
    sizes = placed.groupBy("root").agg(F.min("id").alias("cluster_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return placed.join(sizes, "root").select("id", "cluster_id", "cos")


def describe(clusters: DataFrame, labels: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_id, size, typical, label, label_share) of each cluster.

    ``typical`` are the members nearest to their centre, best first; ``label`` is
    the most frequent label (id, label) of the members that have one, the smallest
    on a tie, null if none has.
    """
    w = Window.partitionBy("cluster_id").orderBy(F.desc("cos"), "id")
    top = clusters.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= typical)
    top = top.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"]).alias("typical"))
    size = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    named = clusters.join(labels.where("label is not null"), "id").groupBy("cluster_id", "label").agg(F.count(F.lit(1)).alias("_n"))
    best = named.groupBy("cluster_id").agg(F.max(F.struct("_n", (-F.col("label")).alias("l"))).alias("_b"), F.sum("_n").alias("_all"))
    best = best.select("cluster_id", (-F.col("_b.l")).alias("label"), (F.col("_b._n") / F.col("_all")).alias("label_share"))
    return size.join(top, "cluster_id").join(best, "cluster_id", "left").select("cluster_id", "size", "typical", "label", "label_share")
