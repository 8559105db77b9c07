"""Vectors in blocks: an index that is built where the rows are, searched by rounds of queries of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from carrierlens.llm.common import as_batch, cut, drop, scratch_path

#: Bytes of the queries that are sent to the index at a time; rows whose costs bound those of all (the first by a hash of the id).
ROUND_BYTES, SAMPLE = 32 << 20, 4096


def clean(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and v (array of double) of the rows whose vector is not null and holds finite components only."""
    v = F.col(vector).cast("array<double>")
    usable = v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrix(column: pa.ChunkedArray, dims: int, kind=np.float64) -> np.ndarray:
    """A list column as rows of dims numbers; shorter vectors are filled up with zeros."""
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    ends = array.offsets.to_numpy()
    flat = array.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    if (sizes == dims).all():
        return flat[ends[0] : ends[-1]].reshape(-1, dims).astype(kind)
    out = np.zeros((len(sizes), dims), kind)
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        out[k, : b - a] = flat[a:b]
    return out


def packed(vectors: DataFrame, rows_per_block: int, dims: int, name: str, index: Callable[[np.ndarray, np.ndarray], dict[str, bytes]], kinds: str) -> DataFrame:
    """The index: a row for each block of rows of vectors(vec_id, v), which each task cuts from its own rows; written once.

    index(ids, values) makes a block's columns, of `kinds`; its rows come in order of vec_id.
    """

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ids = table["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        return as_batch({k: pa.array([v]) for k, v in index(ids[order], matrix(table["v"], dims)[order]).items()})

    def run(batches):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, rows_per_block - n), batch.slice(rows_per_block - n)
                held.append(part)
                n += part.num_rows
                if n == rows_per_block:
                    yield made(held)
                    held, n = [], 0
        if n:
            yield made(held)

    return cut(vectors.mapInArrow(run, kinds), name)


def rows_of(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """A bounded table of vectors(vec_id, v) on the driver: ids and values, in order of vec_id."""
    table = vectors.select("vec_id", "v").toArrow()
    ids = table["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix(table["v"], dims)[order] if len(ids) else np.zeros((0, dims))


def searched(asked: DataFrame, index: DataFrame, dims: int, name: str, search: Callable, kinds: str) -> DataFrame:
    """What search(query ids, query values) finds, as a function on Arrow batches of the index, for queries asked(vec_id, v).

    The index stays where it is: queries are sent to its tasks, ROUND_BYTES of them a round, so what is broadcast has a
    bound that does not grow with the table. What a round finds is written before the next one starts.
    """
    spark = index.sparkSession
    many = max(1, -(-asked.count() * dims * 8 // ROUND_BYTES))
    asked = cut(asked.withColumn("round", F.pmod(F.xxhash64("vec_id"), F.lit(many))), f"{name}-queries")
    path, schema = scratch_path(spark, name), StructType.fromDDL(kinds)
    for k in range(many):
        sent = spark.sparkContext.broadcast(search(*rows_of(asked.where(F.col("round") == k), dims)))
        index.mapInArrow(lambda batches, sent=sent: sent.value(batches), schema).write.mode("append").parquet(path)
        sent.destroy()
    drop(asked)
    return spark.read.schema(schema).parquet(path)


class Best:
    """The k best (least) finds of each query so far, over all blocks of a task: ties to the smaller id."""

    def __init__(self, queries: int, k: int, kind: type):
        self.k, self.ids, self.costs = k, [np.empty(0, np.int64)] * queries, [np.empty(0, kind)] * queries

    def add(self, q: int, ids: np.ndarray, costs: np.ndarray) -> None:
        ids, costs = np.concatenate([self.ids[q], ids]), np.concatenate([self.costs[q], costs])
        order = np.lexsort((ids, costs))[: self.k]
        self.ids[q], self.costs[q] = ids[order], costs[order]

    def limit(self, q: int, otherwise):
        """The k-th cost, which others must reach; `otherwise` if there are fewer."""
        return min(otherwise, self.costs[q][-1]) if len(self.costs[q]) >= self.k else otherwise

    def found(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(queries, list(map(len, self.ids))), np.concatenate([*self.ids, np.empty(0, np.int64)]), np.concatenate([*self.costs, np.empty(0, self.costs[0].dtype if self.costs else np.int64)])


def sample(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """SAMPLE rows, ids and values: what they cost a query is a bound on what the best of all rows cost it."""
    return rows_of(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE), dims)


def best(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k best rows of each query_id, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int")).where(F.col("rank") <= k)
