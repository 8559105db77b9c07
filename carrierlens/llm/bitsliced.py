"""Exact top-k inner products over a bit-sliced index.

The index of a block, built once, holds for every quantised attribute one bitmap over the block's rows for each bit. A query adds
the slices with bitmap arithmetic only: each set bit of a weight sends the attribute's slices to a column of weights
(their complements for a negative weight, which shifts all sums by a constant), and carry-save adders reduce every
column to one slice of the sum. The top rows are then read off the sum from its most significant slice downward; rows
that tie at the boundary are the smaller vec_ids, and the rows chosen get their exact integer score. A task keeps the
best of its blocks only, and of these what reaches the k-th best score of a sample of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierlens.llm.blocks import Best, best, clean, packed, sample, searched
from carrierlens.llm.common import as_batch, drop

SCALE, TOP, EVERY = 256, 5, 50
#: Quantised components of this size and more, and scores beyond 64 bits, are an error: they have no exact result.
LIMIT = 1 << 62
ROWS = 16_384


def planes_of(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmaps (attribute, bit) over the rows of an integer matrix, in offset binary; and the bits."""
    bits = int(max(1, np.abs(values).max(initial=0))).bit_length() + 1
    shifted = (values + (1 << (bits - 1))).astype(np.uint64)
    words = -(-len(values) // 64)
    out = np.zeros((values.shape[1], bits, words * 8), np.uint8)
    for b in range(bits):
        part = np.packbits(((shifted >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, b, : part.shape[1]] = part
    return out.reshape(-1, words * 8).view(np.uint64), bits


def with_complements(planes: np.ndarray) -> np.ndarray:
    return np.concatenate([planes, ~planes])


def slices(values: np.ndarray) -> tuple[np.ndarray, int]:
    """What add() reads of an integer matrix: its bitmaps, then their complements; and the bits."""
    planes, bits = planes_of(values)
    return with_complements(planes), bits


def add(planes: np.ndarray, bits: int, query: np.ndarray) -> list[np.ndarray]:
    """The slices, least significant first, of the weighted sum of the attributes, up to a constant."""
    weights, half = np.abs(query), len(planes) // 2
    columns: dict[int, list] = {}
    for a in range(int(weights.max(initial=0)).bit_length()):
        own = np.flatnonzero((weights >> a) & 1)
        base = own * bits + np.where(query[own] < 0, half, 0)
        for b in range(bits):
            columns.setdefault(a + b, []).append(base + b)
    out, w = [], 0
    carried: dict[int, list] = {}
    while w in columns or w in carried or w < max([*columns, *carried], default=-1):
        parts = [planes[np.concatenate(columns[w])]] if w in columns else []
        parts += carried.pop(w, [])
        stack = np.concatenate(parts) if parts else np.zeros((0, planes.shape[1]), np.uint64)
        up = carried.setdefault(w + 1, [])
        while len(stack) > 2:  # full adders, three bitmaps to one and a carry
            m = len(stack) // 3
            x = stack[: 3 * m].reshape(m, 3, -1)
            a, b, c = x[:, 0], x[:, 1], x[:, 2]
            t = a ^ b
            up.append((a & b) | (t & c))
            stack = np.concatenate([t ^ c, stack[3 * m :]])
        if len(stack) == 2:
            up.append((stack[0] & stack[1])[None])
            stack = (stack[0] ^ stack[1])[None]
        if not up:
            del carried[w + 1]
        out.append(stack[0] if len(stack) else np.zeros(planes.shape[1], np.uint64))
        w += 1
    return out


def top(sums: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k rows of allowed with the largest sums; of equal sums at the boundary the first."""
    sure, tied = np.zeros_like(allowed), allowed.copy()
    for s in reversed(sums):
        both = tied & s
        n = int(np.bitwise_count(sure | both).sum())
        if n > k:
            tied = both
        else:
            sure |= both
            tied &= ~s
            if n == k:
                tied[:] = 0
                break
    at = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
    chosen = at(sure)
    return np.concatenate([chosen, at(tied)[: max(0, k - len(chosen))]])


def whole(values: np.ndarray) -> np.ndarray:
    """Quantised vectors as rows of integers."""
    if (np.abs(values) >= LIMIT).any():
        raise OverflowError(f"a component beyond +-{LIMIT // SCALE} has no exact score")
    return values.astype(np.int64)


def scores(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products; by Python's integers where 64 bits might not hold a sum on the way."""
    bound = sum(int(v) * int(q) for v, q in zip(np.abs(values).max(0, initial=0), np.abs(query), strict=True))
    if bound < 1 << 63:
        return values @ query
    exact = [sum(map(int.__mul__, row, query.tolist())) for row in values.tolist()]
    if any(not -(1 << 63) <= x < 1 << 63 for x in exact):
        raise OverflowError("a score is beyond 64 bits")
    return np.array(exact, np.int64)


def _index(ids: np.ndarray, values: np.ndarray) -> dict:
    values = whole(values)
    planes, bits = planes_of(values)
    return {"ids": ids.tobytes(), "bits": bits, "planes": planes.tobytes(), "values": values.tobytes()}


class _Search:
    """The k best rows of each query over the blocks of a task."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, dims: int, k: int, some: tuple[np.ndarray, np.ndarray]):
        self.ids, self.values, self.dims, self.k = ids, whole(values), dims, k
        self.least = [self._least(q, v, some[0], whole(some[1])) for q, v in zip(self.ids, self.values, strict=True)]

    def _least(self, q: int, query: np.ndarray, ids: np.ndarray, values: np.ndarray) -> int:
        """The k-th best score among some rows."""
        others = values[ids != q]
        return int(np.sort(scores(others, query))[-self.k]) if len(others) >= self.k else -(1 << 63)

    def __call__(self, batches):
        kept = Best(len(self.ids), self.k, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                ids, values = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["values"], np.int64).reshape(-1, self.dims)
                planes = with_complements(np.frombuffer(r["planes"], np.uint64).reshape(self.dims * r["bits"], -1))
                everyone = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
                everyone = np.concatenate([everyone, np.zeros(planes.shape[1] * 8 - len(everyone), np.uint8)]).view(np.uint64)
                for n, (q, query) in enumerate(zip(self.ids, self.values, strict=True)):
                    allowed = everyone.copy()
                    for own in range(np.searchsorted(ids, q), np.searchsorted(ids, q, "right")):
                        allowed[own // 64] &= ~np.uint64(1 << (own % 64))
                    found = top(add(planes, r["bits"], query), allowed, self.k)
                    score = scores(values[found], query)
                    reach = score >= self.least[n]
                    kept.add(n, ids[found][reach], ~score[reach])  # ~x falls as x rises, without overflow
        query, ids, costs = kept.found(self.ids)
        yield as_batch({c: pa.array(v, pa.int64()) for c, v in (("query_id", query), ("vec_id", ids), ("score", ~costs))})


def top_inner_products(vectors: DataFrame, every: int = EVERY, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with vectors(vec_id, embedding).

    Components are floor(256 x); one of 2^62 or more, or a score beyond 64 bits, raises an error. Queries are the rows whose vec_id is divisible by `every`, each
    against all rows but those with its own vec_id. Ties go to the smaller vec_id. Vectors that are null or hold null or
    non-finite components, and rows without an id, take no part; shorter vectors are filled up with zeros. A query's
    row that repeats is asked once. Fewer candidates than k: all of them. No rows: no rows. Other columns are not read.
    """
    rows = clean(vectors)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 1
    index = packed(rows, ROWS, dims, "slices", _index, "ids binary, bits long, planes binary, values binary")
    asked, some = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), sample(rows, dims)
    found = searched(asked, index, dims, "scores", lambda ids, values: _Search(ids, values, dims, k, some), "query_id long, vec_id long, score long")
    drop(index)
    return best(found, k, F.desc("score"), F.asc("vec_id")).select("query_id", "rank", "vec_id", "score")
