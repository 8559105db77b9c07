"""Best-fit packing with large-item matching.

Texts are tokenised once. Documents longer than the capacity are cut into full pieces, the first piece taking what is
left over; every piece is then an item of 1..capacity tokens. Items above one third of the capacity can share a
sequence with at most one other such item, so they are matched greedily: the largest takes the largest partner that
still fits. Smaller items then go, largest first, to the fullest sequence that holds them.

Items of equal length are interchangeable. The packing is therefore worked out on the table of item counts by length,
which has `capacity` rows at any corpus size, and yields runs "the items ranked r..r+n of length s go to the sequences
q..q+n at offset o". Ranks are dealt out in parallel: each group of items counts its lengths, the counts are summed up
by length in Spark, and every item finds its run by its rank.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections import deque
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carrierlens.llm.common import as_batch, cut, small_batches

CAPACITY, END_ID = 1024, 2
TOKENIZER = "byte_bpe_50k.json"
#: Items that are ranked together; a bound on the rows that one group of the ranking holds.
GROUP = 20_000


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, other bytes for 256 and up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """An encoder with the ids of the tokenizers file at path (special tokens included, none added).

    The vocabulary, split pattern and ids are the file's; tiktoken runs them several times faster than the library
    the file is written for. tests/llm/test_packing_sharding.py holds the two against each other.
    """
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    letters = _byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def library(path: str):
    """The library the file is written for."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(text: str | None, path: str) -> np.ndarray:
    """The ids of one document and the end id. Null text: as empty."""
    try:
        ids = tokenizer(path).encode_to_numpy(text or "", allowed_special="all")
    except ValueError:  # its pattern matcher runs out of stack in some hundred thousands of spaces in a row
        ids = np.array(library(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.append(ids.astype(np.uint32), np.uint32(END_ID))


def piece_starts(n: int, capacity: int) -> list[int]:
    """Where the pieces of a document of n ids start: all full but the first."""
    first = n if n <= capacity else n % capacity or capacity
    return [0, *range(first, n, capacity)]


def _cut_pieces(path: str, capacity: int, with_ids: bool):
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encode(text, path)
                starts = piece_starts(len(ids), capacity)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    for name, v in (("doc_id", doc), ("piece", k), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(ids[a:b].astype("<u4").tobytes()))):
                        out[name].append(v)
                    if with_ids:
                        out["ids"].append(ids[a:b].astype(np.int32))
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})
            yield as_batch({k: pa.array(out[k], t) for k, t in kinds.items()})

    return run


class _Open:
    """Open sequences by the room left in them, as runs of consecutive sequence numbers with the same content lengths."""

    def __init__(self):
        self.by_room: dict[int, deque] = {}
        self.rooms: list[int] = []

    def add(self, room: int, first: int, n: int) -> None:
        if room not in self.by_room:
            self.by_room[room] = deque()
            self.rooms.insert(bisect_left(self.rooms, room), room)
        self.by_room[room].append((first, n))

    def take(self, size: int, want: int):
        """A run of at most `want` of the fullest sequences that still hold size: room, first, n; None if there are none."""
        k = bisect_left(self.rooms, size)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        first, n = self.by_room[room].popleft()
        if n > want:
            self.by_room[room].appendleft((first + want, n - want))
            n = want
        if not self.by_room[room]:
            del self.by_room[room], self.rooms[k]
        return room, first, n


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, rank, n, sequence, offset): items rank..rank+n of that length go to sequences sequence.. at offset."""
    runs, used, opened, sequences = [], dict.fromkeys(counts, 0), _Open(), 0

    def place(size, n, first, offset):
        runs.append((size, used[size], n, first, offset))
        used[size] += n

    left = lambda s: counts[s] - used[s]
    large = sorted(s for s in counts if 3 * s > capacity)
    for size in reversed(large):
        while left(size):
            # the largest partner that fits beside it and is not used up; equals pair among themselves
            k = bisect_left(large, capacity - size + 1) - 1
            while k >= 0 and (large[k] > size or not left(large[k]) or large[k] == size and left(size) < 2):
                k -= 1
            if k < 0:
                n, room = left(size), capacity - size
                place(size, n, sequences, 0)
            else:
                n, room = (left(size) // 2 if large[k] == size else min(left(size), left(large[k]))), capacity - size - large[k]
                place(size, n, sequences, 0)
                place(large[k], n, sequences, size)
            opened.add(room, sequences, n)
            sequences += n
    for size in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        while left(size):
            found = opened.take(size, left(size))
            if found is None:
                # as many new sequences as these items fill by themselves
                n = -(-left(size) // (capacity // size))
                opened.add(capacity, sequences, n)
                sequences += n
                continue
            room, first, n = found
            place(size, n, first, capacity - room)
            opened.add(room - size, first, n)
    return runs


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset of every piece of docs(doc_id, text).

    Null or empty text: one piece that holds the end id alone. Null doc_id: packed like any other and returned as
    null. Repeated rows: each is packed by itself. No rows: no rows. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cut_pieces(path, capacity, with_ids), kinds)
    # an item's group: a run of rows of the task that made it
    row = F.monotonically_increasing_id()
    pieces = cut(made.withColumn("_row", row), "pieces").withColumn("_group", F.floor(F.col("_row") / GROUP))
    by_group = cut(pieces.groupBy("_group", "length").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_group.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    runs = plan(counts, capacity)
    # ranks that come before a group's own, by length: spread over blocks of groups first, so no length is summed up in one task
    base = by_group.withColumn("_block", F.floor(F.col("_group") / 64))
    blocks = base.groupBy("length", "_block").agg(F.sum("_n").alias("_bn"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_bn").over(up_to(Window.partitionBy("length").orderBy("_block"))), F.lit(0))).drop("_bn")
    base = base.withColumn("_in", F.coalesce(F.sum("_n").over(up_to(Window.partitionBy("length", "_block").orderBy("_group"))), F.lit(0)))
    base = base.join(blocks, ["length", "_block"]).select("_group", "length", (F.col("_in") + F.col("_before")).alias("_base"))
    ranked = pieces.withColumn("_k", F.row_number().over(Window.partitionBy("_group", "length").orderBy("_row")))
    ranked = ranked.join(base, ["_group", "length"]).withColumn("_rank", F.col("_base") + F.col("_k") - 1)
    columns = [c for c in pieces.columns if not c.startswith("_")]
    # one row for each length: its runs in order of rank; their number depends on the capacity, not on the corpus
    table: dict[int, list] = {}
    for size, rank, n, first, offset in sorted(runs):
        table.setdefault(size, []).append((rank, n, first, offset))
    runs_df = spark.createDataFrame([(s, r) for s, r in table.items()] or [], "length long, _runs array<struct<rank:long, n:long, first:long, offset:long>>")
    found = F.element_at(F.filter("_runs", lambda r: (r["rank"] <= F.col("_rank")) & (F.col("_rank") < r["rank"] + r["n"])), 1)
    placed = ranked.join(F.broadcast(runs_df), "length").withColumn("_at", found)
    return placed.select(*columns, (F.col("_at.first") + F.col("_rank") - F.col("_at.rank")).alias("sequence_id"), F.col("_at.offset").alias("offset"))
