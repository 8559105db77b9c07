"""Where documents come from. Texts are read as bytes: text readers would rewrite line ends and drop a leading U+FEFF."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierlens.settings import Limits


def from_texts(spark: SparkSession, texts: list[str | None], ids: list[str] | None = None) -> DataFrame:
    """source_id, ord, text of texts at hand, with trusted ids."""
    ids = ids or [str(k) for k in range(1, len(texts) + 1)]
    return spark.createDataFrame([(i, k, t) for k, (i, t) in enumerate(zip(ids, texts, strict=True), 1)], "source_id string, ord long, text string")


def from_bytes(spark: SparkSession, items: list[bytes | None]) -> DataFrame:
    """ord, content of bytes at hand (standard input, for one)."""
    return spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in enumerate(items, 1)], "ord long, content binary")


def files(spark: SparkSession, path: str, limits: Limits | None = None) -> DataFrame:
    """path, length, content of every file; content is null, and not read, beyond the byte limit."""
    limits = Limits() if limits is None else limits
    every = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    fits = every.where(F.col("length") <= limits.max_input_bytes)  # pushed to the scan: larger files are not opened
    large = spark.read.format("binaryFile").load(path).where(F.col("length") > limits.max_input_bytes).select("path", "length")
    return fits.unionByName(large.withColumn("content", F.lit(None).cast("binary")))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every file with universal newlines: \\r\\n and \\r become \\n, so offsets are those of the text as read."""
    out = spark.read.format("binaryFile").load(path)
    return out.select("path", F.regexp_replace(F.col("content").cast("string"), "\\r\\n?", "\n").alias("text"))


def _lines(batches):
    for batch in batches:
        rows = {"batch_id": [], "ord": [], "line": [], "size": []}
        for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
            parts = content.split(b"\n")
            ends = len(parts) - 1
            for k, part in enumerate(parts):
                if k == ends and not part:
                    break
                rows["batch_id"].append(path)
                rows["ord"].append(k + 1)
                rows["line"].append(part)
                rows["size"].append(len(part) + (k < ends))
        kinds = {"batch_id": pa.string(), "ord": pa.int64(), "line": pa.binary(), "size": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in kinds.items()], names=list(kinds))


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, ord, line (bytes without the \\n), size (bytes with it): a file is a batch, its lines are numbered from 1."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInArrow(_lines, "batch_id string, ord long, line binary, size long")


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a multi-line JSON document's `fixtures` array."""
    return spark.read.json(path, multiLine=True).select(F.explode("fixtures").alias("f")).select("f.*")


def emoji_extract(lines: DataFrame, *kinds: str) -> DataFrame:
    """sequence (code points in hexadecimal) of a public emoji data file's lines(value) of the wanted types.

    Ranges (a..b) are refused: error is set on such rows. Repeats are kept, see repeats().
    """
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.substring_index("value", "#", 1), ";")
    rows = body.select(F.trim(parts[0]).alias("sequence"), F.trim(parts[1]).alias("kind")).where(F.col("kind").isin(*kinds))
    return rows.withColumn("error", F.when(F.col("sequence").contains(".."), F.lit("RANGE")))


def repeats(extract: DataFrame) -> DataFrame:
    """sequence, n of what an extract has more than once; a table is whole only if there is none."""
    return extract.groupBy("sequence").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
