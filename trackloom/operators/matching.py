"""One-to-one matching and merging under constraints."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.islands import fold_sorted
from trackloom.session import durable


def greedy_match(edges: DataFrame, left: Sequence[str], right: Sequence[str], score: str) -> DataFrame:
    """The matching that takes edges from the best score down, each side once; ties by the left, then the right key.

    Taking the best edge of all, again and again, gives the same edges as taking at once every edge that is the best of both of
    its ends, dropping what they touch, and repeating. So rounds are joins without any global order; the number of rounds is
    the longest chain of ever better neighbours. Each round is checkpointed.
    """
    keys = list(dict.fromkeys([*left, *right]))
    others = [c for c in edges.columns if c not in keys and c != score]
    edge = F.struct((-F.col(score)).alias("__off"), *left, *[c for c in right if c not in left], score, *others)
    rest, found = durable(edges.where(F.col(score).isNotNull())), None
    while True:
        # The best edge of a node is an aggregate, so a hot node is combined before anything shuffles.
        by_left = rest.groupBy(*[F.col(c).alias(f"__{c}") for c in left]).agg(F.min(edge).alias("e")).select(*[F.col(f"e.{c}").alias(c) for c in edges.columns])
        by_right = rest.groupBy(*[F.col(c).alias(f"__{c}") for c in right]).agg(F.min(edge).alias("e")).select(*[F.col(f"e.{c}").alias(c) for c in keys])
        taken = durable(by_left.join(by_right, keys, "left_semi"))
        if taken.isEmpty():
            return found if found is not None else taken
        found = taken if found is None else found.unionByName(taken)
        rest = rest.join(taken.select(*left), list(left), "left_anti").join(taken.select(*right), list(right), "left_anti")
        rest = durable(rest)


def best_assignment(value: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment with the highest sum of ``value`` (rows and columns used at most once).

    Shortest augmenting paths with potentials, cubic in the smaller side.
    """
    turned = value.shape[0] > value.shape[1]
    cost = -(value.T if turned else value)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            done[at] = True
            row = owner[at]
            open_ = np.flatnonzero(~done[1:]) + 1
            reduced = cost[row - 1, open_ - 1] - u[row] - v[open_]
            better = reduced < least[open_]
            least[open_[better]] = reduced[better]
            back[open_[better]] = at
            following = open_[np.argmin(least[open_])]
            step = least[following]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            at = following
            if owner[at] == 0:
                break
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)


class _Frame:
    def __init__(self, key: tuple) -> None:
        self.key, self.edges = key, []

    def step(self, row):
        self.edges.append((int(row.left), int(row.right), float(row.score)))
        return ()

    def end(self):
        # Parts that share no row are solved apart, so a matrix is never larger than its part.
        root: dict[tuple[bool, int], tuple[bool, int]] = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b, _ in self.edges:
            root[find((True, b))] = find((False, a))
        parts: dict[tuple[bool, int], list[tuple[int, int, float]]] = {}
        for edge in self.edges:
            parts.setdefault(find((False, edge[0])), []).append(edge)
        for edges in parts.values():
            lefts, rights = sorted({e[0] for e in edges}), sorted({e[1] for e in edges})
            value = np.zeros((len(lefts), len(rights)))
            li, ri = {x: i for i, x in enumerate(lefts)}, {x: i for i, x in enumerate(rights)}
            for a, b, s in edges:
                value[li[a], ri[b]] = s
            for i, j in best_assignment(value):
                if value[i, j] > 0:
                    yield (*self.key, lefts[i], rights[j], value[i, j])


def optimal_match(edges: DataFrame, least: float) -> DataFrame:
    """Per frame (clip_id, frame_idx) the assignment of ``left`` to ``right`` with the highest sum of positive ``score``; pairs
    below ``least`` are dropped afterwards, so a frame can lose a pair that a threshold beforehand would have kept.

    An edge that is alone at both of its ends is in every best assignment; only frames with others are solved in Python.
    """
    frame = ["clip_id", "frame_idx"]
    positive = durable(edges.where("score > 0").select(*frame, "left", "right", "score"))
    counted = positive.withColumns(
        {"nl": F.count(F.lit(1)).over(Window.partitionBy(*frame, "left")), "nr": F.count(F.lit(1)).over(Window.partitionBy(*frame, "right"))}
    )
    tangled = counted.where("nl > 1 OR nr > 1").select(*frame).distinct()
    free = counted.join(tangled, frame, "left_anti").select(*frame, "left", "right", "score")
    solved = fold_sorted(positive.join(tangled, frame, "left_semi"), frame, ["left", "right"], _Frame, "clip_id string, frame_idx bigint, left bigint, right bigint, score double")
    return free.unionByName(solved).where(F.col("score") >= least)


class _Union:
    """Groups of intervals; two groups merge only if no two intervals overlap by more than ``tolerance``."""

    def __init__(self, key: tuple, tolerance: int) -> None:
        self.key, self.tolerance = key, tolerance
        self.root: dict[int, int] = {}
        self.spans: dict[int, list[tuple[int, int]]] = {}

    def _find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def step(self, row):
        if row.kind == 0:
            node = int(row.a)
            self.root[node] = node
            self.spans[node] = [(int(row.start_frame), int(row.end_frame))]
            return ()
        if int(row.a) not in self.root or int(row.b) not in self.root:
            return ()
        a, b = self._find(int(row.a)), self._find(int(row.b))
        if a == b:
            return ()
        merged = sorted(self.spans[a] + self.spans[b])
        latest = merged[0][1]
        for start, end in merged[1:]:
            if min(latest, end) - start + 1 > self.tolerance:
                return ()
            latest = max(latest, end)
        # The earliest interval gives its name; of equal starts the lower id.
        first, other = sorted((a, b), key=lambda r: (min(self.spans[r]), r))
        self.root[other] = first
        self.spans[first] = merged
        del self.spans[other]
        return ()

    def end(self):
        for node in sorted(self.root):
            yield (*self.key, node, self._find(node))


def constrained_union(nodes: DataFrame, edges: DataFrame, tolerance: int = 0) -> DataFrame:
    """Merges nodes (clip_id, node, start_frame, end_frame) along edges (clip_id, a, b, score) from the best score down, but never
    two groups that overlap in time by more than ``tolerance`` frames: clip_id, node, root.

    Whether an edge holds depends on the merges before it, so a clip is a fold; it streams the clip's edges and keeps its nodes.
    """
    none = lambda kind: F.lit(None).cast(kind)
    as_rows = nodes.select("clip_id", F.lit(0).alias("kind"), F.lit(0.0).alias("minus"), F.col("node").cast("bigint").alias("a"), none("bigint").alias("b"), "start_frame", "end_frame")
    links = edges.select("clip_id", F.lit(1).alias("kind"), (-F.col("score")).alias("minus"), F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), none("bigint").alias("start_frame"), none("bigint").alias("end_frame"))
    return fold_sorted(as_rows.unionByName(links), ["clip_id"], ["kind", "minus", "a", "b"], lambda key: _Union(key, tolerance), "clip_id string, node bigint, root bigint")
