"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and gets all that its predecessor kept; all but the last return the columns of
documents. A stage that changes a text sets n_chars anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierlens.llm import packing, simhash, substring, surrogates, toxicity
from carrierlens.llm.common import cut, read

#: Near copies share shingles of so many words.
SHINGLE = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.classify(docs, read(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (a similarity of 0.8 or more) the document with the smallest doc_id stays.

    Rows that repeat a doc_id go or stay together; rows without one stay.
    """
    found = simhash.similar_texts(docs, shingle=SHINGLE)
    copies = found.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; a text that loses nothing stays as it is."""
    found = substring.remove_repeats(docs)
    return _with_text(docs, found, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates."""
    return _with_text(docs, surrogates.replace(docs), F.col("text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack(docs)


def _with_text(docs: DataFrame, changed: DataFrame, text) -> DataFrame:
    ours = {"text": text, "n_chars": F.length(text).cast("long")}
    return changed.select(*[(ours[c] if c in ours else F.col(c)).alias(c) for c in docs.columns])


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", remove_repeated_passages),
    ("pii_surrogates", replace_personal_data),
    ("best_fit_packing", pack_sequences),
]
#: XXH64, zstandard and a tokenizer are out of SQL's reach; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
