"""Approximate nearest neighbours by a few stable projections, a kd-tree and a chi-square stopping test.

Every vector is projected on DIMS Gaussian directions. For two vectors at distance s, the squared distance of their
projections is s^2 times a chi-square variable with DIMS degrees of freedom, whatever the original dimension. A
kd-tree over the projections of a block gives a query its projected neighbours step by step, nearest first; each is
verified on the original vectors. The search ends when a still unseen vector at the present k-th distance would have
shown up by now with probability CONFIDENCE: when the next projected distance squared is beyond that quantile times the
k-th distance squared. The same bound prunes the tree on the way down. It starts from what the same search finds in a
tree over a sample of rows, whose projected distances are reached in any case (so that there are always k finds), and
goes on from block to block of a task. Every row is indexed; there is no limit on the rows verified.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierlens.llm.blocks import Best, best, clean, packed, sample, searched
from carrierlens.llm.common import as_batch, drop

DIMS, CONFIDENCE, SEED = 32, 0.85, 7
NEAREST, EVERY = 10, 100
ROWS, LEAF = 16_384, 32


def chi_square_quantile(p: float, degrees: int) -> float:
    """The value that a chi-square variable of an even number of degrees stays below with probability p."""
    half = degrees // 2
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))
    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def directions(dims: int, degrees: int = DIMS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, degrees))


class KdTree:
    """A balanced kd-tree: every node halves its rows at the median of its widest direction; leaves hold LEAF rows or fewer.

    Level l has 2^l nodes; node j has the children 2j and 2j + 1 and the rows order[edges[l][j] : edges[l][j + 1]].
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order, self.edges = points, np.arange(len(points)), [np.array([0, len(points)])]
        while len(points) > leaf << (len(self.edges) - 1):
            edges = [0]
            for a, b in zip(self.edges[-1][:-1].tolist(), self.edges[-1][1:].tolist(), strict=True):
                rows = self.order[a:b]
                part, half = points[rows], (b - a) // 2
                axis = int((part.max(0) - part.min(0)).argmax()) if len(part) else 0
                self.order[a:b] = rows[np.argpartition(part[:, axis], half)] if half else rows
                edges += [a + half, b]
            self.edges.append(np.array(edges))
        parts = np.split(points[self.order], self.edges[-1][1:-1])
        self.low, self.high = [np.array([p.min(0, initial=np.inf) for p in parts])], [np.array([p.max(0, initial=-np.inf) for p in parts])]
        while len(self.low[0]) > 1:
            self.low.insert(0, np.minimum(self.low[0][::2], self.low[0][1::2]))
            self.high.insert(0, np.maximum(self.high[0][::2], self.high[0][1::2]))

    def near(self, point: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray]:
        """The leaves at a squared distance of at most `within`, nearest first, and these distances; by descent from the root."""
        nodes, least = np.zeros(1, np.int64), np.zeros(1)
        for level in range(len(self.edges)):
            if level:
                nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
            gap = np.maximum(0, np.maximum(self.low[level][nodes] - point, point - self.high[level][nodes]))
            least = np.einsum("ij,ij->i", gap, gap)
            near = least <= within
            nodes, least = nodes[near], least[near]
        order = np.argsort(least, kind="stable")
        return nodes[order], least[order]

    def rows(self, leaves: np.ndarray) -> np.ndarray:
        edges = self.edges[-1]
        return np.concatenate([self.order[edges[j] : edges[j + 1]] for j in leaves.tolist()])


def nearest(tree: KdTree, values: np.ndarray, ids: np.ndarray, query: np.ndarray, projected: np.ndarray, own: int, k: int, quantile: float, limit: float = math.inf, seen: list | None = None, floor: float = 0.0):
    """ids and distances of the k nearest found within limit, nearest first, ties to the smaller id.

    floor: a squared projected distance that is searched until there are k. seen: counts what is verified.
    """
    kept, step, at = Best(1, k, np.float64), 2, 0
    slack = 1e-9 * float(projected @ projected)  # projections are rounded, and equal vectors are at distance 0
    leaves, least = tree.near(projected, max(quantile * limit * limit, floor) + slack)
    while at < len(leaves):
        limit = kept.limit(0, limit)
        reach = max(quantile * limit * limit, floor if len(kept.ids[0]) < k else 0.0) + slack
        if least[at] > reach:
            break  # and so are all leaves after it
        rows = tree.rows(leaves[at : at + step])
        at, step = at + step, min(64, 2 * step)
        gap = tree.points[rows] - projected
        rows = rows[(np.einsum("ij,ij->i", gap, gap) <= reach) & (ids[rows] != own)]
        if seen is not None:
            seen.append(len(rows))
        gap = values[rows] - query
        d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        near = d <= limit
        if near.any():
            kept.add(0, ids[rows][near], d[near])
    return kept.ids[0], kept.costs[0]


def _index(ids: np.ndarray, values: np.ndarray) -> dict:
    return {"ids": ids.tobytes(), "values": values.tobytes()}


class _Search:
    """The k nearest rows found of each query over the blocks of a task."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, dims: int, k: int, degrees: int, confidence: float, some: tuple[np.ndarray, np.ndarray]):
        self.ids, self.values, self.dims, self.k, self.degrees = ids, values, dims, k, degrees
        self.quantile = chi_square_quantile(confidence, degrees)
        onto = directions(dims, degrees)
        tree, projected = KdTree(some[1] @ onto), values @ onto
        self.bounds = [self._bound(tree, *some, q, v, p) for q, v, p in zip(ids.tolist(), values, projected, strict=True)]

    def _bound(self, tree: KdTree, ids: np.ndarray, values: np.ndarray, q: int, query: np.ndarray, projected: np.ndarray) -> tuple[float, float]:
        """The k-th distance found among some rows, rounded up, and the farthest projection of those found."""
        found, d = nearest(tree, values, ids, query, projected, q, self.k, self.quantile)
        if len(d) < self.k:
            return math.inf, 0.0
        gap = tree.points[np.isin(ids, found)] - projected
        return float(d[-1]) * (1 + 1e-9), float(np.einsum("ij,ij->i", gap, gap).max())

    def __call__(self, batches):
        onto, kept = directions(self.dims, self.degrees), Best(len(self.ids), self.k, np.float64)
        projected = self.values @ onto
        for batch in batches:
            for r in batch.to_pylist():
                ids, values = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["values"], np.float64).reshape(-1, self.dims)
                tree = KdTree(values @ onto)
                for n, q in enumerate(self.ids.tolist()):
                    limit, floor = self.bounds[n]
                    floor = floor if len(kept.ids[n]) < self.k else 0.0
                    kept.add(n, *nearest(tree, values, ids, self.values[n], projected[n], q, self.k, self.quantile, kept.limit(n, limit), floor=floor))
        query, ids, costs = kept.found(self.ids)
        yield as_batch({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(costs, pa.float64())})


def nearest_neighbours(vectors: DataFrame, every: int = EVERY, k: int = NEAREST, degrees: int = DIMS, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found of each query, by Euclidean distance.

    Queries are the rows of vectors(vec_id, embedding) whose vec_id is divisible by `every`, each against all rows but
    those with its own vec_id. Ties go to the smaller vec_id. Vectors that are null, zero or hold null or non-finite
    components, and rows without an id, take no part; shorter vectors are filled up with zeros. A query's row that
    repeats is asked once. Fewer candidates than k: all of them. No rows: no rows. Other columns are not read.
    """
    rows = clean(vectors).where(F.exists("v", lambda x: x != 0))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 1
    index = packed(rows, ROWS, dims, "vectors", _index, "ids binary, values binary")
    asked, some = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), sample(rows, dims)
    found = searched(asked, index, dims, "neighbours", lambda ids, values: _Search(ids, values, dims, k, degrees, confidence, some), "query_id long, vec_id long, score double")
    drop(index)
    return best(found, k, F.asc("score"), F.asc("vec_id")).select("query_id", "rank", "vec_id", "score")
