"""What the operators of this subpackage share: reading, scratch tables, word splitting, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of documents that one Arrow batch carries at most; long texts stay within a worker's memory.
ARROW_ROWS = 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows (Spark's default of 10,000 rows is too many for whole documents)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own, in local mode only."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = f"file://{tempfile.mkdtemp(prefix='carrierlens-')}"
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is still there when the driver ends is deleted then."""
    path = f"{shared_dir(spark)}/carrierlens-{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df once into the shared folder and reads it back: lineage is cut and the table outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._carrierlens_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Deletes a table written by cut() that no later plan reads."""
    path = getattr(df, "_carrierlens_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def with_rest(docs: DataFrame, *named: tuple[str, str]) -> tuple[DataFrame, list[str]]:
    """The named columns (name, type) cast, and all columns of docs as they are in one struct _rest, whatever their names."""
    columns = docs.columns
    kept = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(0))
    return docs.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in named], kept.alias("_rest")), columns


def as_batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, element by element."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges(a long, b long): node, root (smallest node reachable). Nodes without edges are absent.

    Every round points each node of what is left of the graph at its smallest neighbour, then contracts the graph
    by these pointers. All tables are written to the shared folder, so each join reads two plain exchanges that AQE
    can split at a hub; nothing of the graph reaches the driver but whether edges are left.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{name}-edges")
    labels = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-to")
        if labels is None:
            new = to.select(F.col("a").alias("node"), F.col("m").alias("root"))
        else:
            new = labels.join(to.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("m", "root").alias("root"))
        new = cut(new, f"{name}-labels")
        left = edges.join(to.withColumnRenamed("m", "ma"), "a").select("b", "ma")
        left = left.join(to.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b").where("ma != mb")
        left = cut(left.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), f"{name}-edges")
        for old in (labels, edges, to):
            drop(old)
        labels, edges = new, left
        if edges.isEmpty():
            drop(edges)
            return labels
