"""Removal of token runs that an earlier document already has, by Rabin-Karp hashes of every fixed-length window.

1. Each task hashes every window of its documents with a rolling polynomial and settles repeats among its own
   documents, so a passage that a third of the corpus shares leaves a task once. What is left goes to hash buckets as
   packed arrays: eight bytes a window, with no positions, in the order of the documents.
2. Each bucket finds, for every hash, the smallest document that has it, and answers with the windows (by their order
   in document and bucket) of larger documents, packed by groups of documents; the groups turn these into one row for
   each document that loses words.
3. Documents meet their rows, hash their windows again, and the repeated windows merge into maximal intervals.

Words are numbered by keyed 128-bit digests and windows hashed modulo 2^61 - 1, twice, with different bases: one hash is
sent, the other tells the bucket. Windows count as equal if both the hash sent and the bucket are, some 61 bits and the
logarithm of the number of buckets, which grows with the corpus: any false match has a chance of about 1e-5 at 0.5 GB,
1e-3 at 30 GB. No text is known for which it is larger, as nobody without the key can choose a word's number.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from carrierlens.llm.common import as_batch, mix, small_batches, with_rest

WINDOW = 13
#: Windows that a task holds at once, about, and windows of one bucket, about.
CHUNK, BUCKET = 300_000, 1_000_000


#: Arithmetic is modulo this prime; the bases of the two hashes are below 2^29, so that no product leaves 64 bits.
PRIME = np.uint64((1 << 61) - 1)
BASES = (0x1B873593, 0x165667B1)
#: Words are numbered by keyed digests. So many of them, and bytes of them, are remembered.
KEY = b"substring-dedup"
WORDS, WORD_BYTES = 1 << 18, 1 << 24
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PART = 1 << 18


class _Known(dict):
    """Places of words in the table of their digests."""

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = place = len(self)
        return place


class Words:
    """Two numbers modulo PRIME for each word, from a keyed BLAKE2b digest of its bytes."""

    def __init__(self, key: bytes = KEY):
        self.key = key
        self.clear()

    def clear(self) -> None:
        self.known, self.digests, self.held, self.bytes = _Known(), np.empty((1 << 12, 2), np.uint64), 0, 0
        self.known.new = []

    def hashes(self, raw: bytes) -> np.ndarray:
        """A row of two numbers for every word of a text; long texts part by part."""
        out, at = [np.empty((0, 2), np.uint64)], 0
        while at < len(raw):
            found = _SPACE.search(raw, at + _PART)  # a part ends at a separator, so no word is cut
            end = found.start() if found else len(raw)
            out.append(self._part(raw[at:end].split()))
            at = end
        return out[1] if len(out) == 2 else np.concatenate(out)

    def _part(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        places = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if known.new:
            made = b"".join([hashlib.blake2b(w, digest_size=16, key=self.key).digest() for w in known.new])
            end = self.held + len(known.new)
            if end > len(self.digests):
                self.digests = np.concatenate([self.digests[: self.held], np.empty((end, 2), np.uint64)])
            self.digests[self.held : end] = np.frombuffer(made, "<u8").reshape(-1, 2) % PRIME
            self.held = end
            self.bytes += sum(map(len, known.new))
            known.new = []
        out = self.digests[places]
        if len(known) > WORDS or self.bytes > WORD_BYTES:
            self.clear()
        return out


def window_hashes(words: np.ndarray, window: int, base: int) -> np.ndarray:
    """The Rabin-Karp hash modulo PRIME of every run of `window` numbers: H(i+1) = (H(i) - w(i) B^(n-1)) B + w(i+n), unrolled."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    b, low, shift = np.uint64(base), np.uint64(0xFFFFFFFF), np.uint64
    out = words[:n].copy()
    for k in range(1, window):
        high = (out >> shift(32)) * b  # times 2^32, which is folded at 2^61
        out &= low
        out *= b
        out += ((high << shift(32)) & PRIME) + (high >> shift(29))
        out += words[k : k + n]
        out = (out & PRIME) + (out >> shift(61))
    return np.where(out >= PRIME, out - PRIME, out)


def _sent(numbers: np.ndarray, window: int) -> np.ndarray:
    """The hash of every window that is sent."""
    return mix(window_hashes(numbers[:, 0], window, BASES[0]))


def _dealt(numbers: np.ndarray, window: int) -> np.ndarray:
    """The hash of every window that its bucket is told by."""
    return mix(window_hashes(numbers[:, 1], window, BASES[1]))


def of_each(numbers: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """How many windows each document has, and which of the windows of all documents, one after another, lie within one."""
    words = np.array([len(n) for n in numbers], np.int64)
    sizes = np.maximum(words - window + 1, 0)
    starts, firsts = np.cumsum(words) - words, np.cumsum(sizes) - sizes
    return sizes, np.repeat(starts - firsts, sizes) + np.arange(int(sizes.sum()))


def _bucket_of(dealt: np.ndarray, buckets: int) -> np.ndarray:
    return (dealt % np.uint64(buckets)).astype(np.int64)


def _narrow(numbers: np.ndarray) -> bytes:
    """Unsigned numbers in the narrowest of 1, 2, 4 and 8 bytes that holds all, behind a byte that says which."""
    most = int(numbers.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.uint64)


def _ids(docs: np.ndarray) -> bytes:
    """Ids in rising order, as differences."""
    return _narrow(np.diff(docs.view(np.uint64), prepend=np.uint64(0))) if len(docs) else _narrow(docs.view(np.uint64))


def _unids(raw: bytes) -> np.ndarray:
    return np.cumsum(_wide(raw), dtype=np.uint64).view(np.int64)


def _ask(window: int, buckets: int):
    """Per chunk of documents and bucket: rows of documents, their windows, which of these are asked for, their hashes."""
    kinds = {"bucket": pa.int64(), "doc": pa.binary(), "text_key": pa.binary(), "n": pa.binary(), "asked": pa.binary(), "hashes": pa.binary()}

    def flush(docs, keys, numbers):
        docs, keys = np.array(docs, np.int64), np.array(keys, np.int64)
        by_id = np.argsort(docs.view(np.uint64), kind="stable")
        docs, keys, numbers = docs[by_id], keys[by_id], [numbers[k] for k in by_id.tolist()]
        sizes, own = of_each(numbers, window)
        numbers = np.concatenate(numbers)
        h, dealt = _sent(numbers, window)[own], _dealt(numbers, window)[own]
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        rank = np.unique(docs, return_inverse=True)[1].astype(np.int32)  # equal ids: equal rank
        order = np.lexsort((rank[row], h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (dealt[order][1:] != dealt[order][:-1])]
        least = rank[row[order]][np.flatnonzero(new)][np.cumsum(new) - 1]
        later = np.empty(len(h), bool)
        later[order] = rank[row[order]] != least
        bucket = _bucket_of(dealt, buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = {k: [] for k in kinds}
        for b in np.flatnonzero(np.diff(edges)):
            of = order[edges[b] : edges[b + 1]]
            rows, n = np.unique(row[of], return_counts=True)
            asked = ~later[of]
            for k, v in (("bucket", int(b)), ("doc", _ids(docs[rows])), ("text_key", _narrow(keys[rows])), ("n", _narrow(n)), ("asked", np.packbits(asked).tobytes()), ("hashes", h[of][asked].astype("<u8").tobytes())):
                out[k].append(v)
        return as_batch({k: pa.array(out[k], t) for k, t in kinds.items()})

    def run(batches):
        docs, keys, numbers, held, known = [], [], [], 0, Words()
        for batch in batches:
            texts = batch["text"].cast(pa.binary()).to_pylist()
            for doc, key, raw in zip(batch["doc"].to_pylist(), batch["text_key"].to_pylist(), texts, strict=True):
                own = known.hashes(raw or b"")
                if len(own) >= window:
                    docs.append(doc)
                    keys.append(key)
                    numbers.append(own)
                    held += len(own)
                if held >= CHUNK:
                    yield flush(docs, keys, numbers)
                    docs, keys, numbers, held = [], [], [], 0
        if held:
            yield flush(docs, keys, numbers)

    return run


def _answer(groups: int):
    """For one bucket: what a smaller document has, by group of documents: rows of documents, their windows and places."""

    def run(table: pa.Table) -> pa.Table:
        docs, keys, row, ordinal, hashes, flagged, at = [], [], [], [], [], [], 0
        for r in table.select(["doc", "text_key", "n", "asked", "hashes"]).to_pylist():
            n = _wide(r["n"]).astype(np.int64)
            total = int(n.sum())
            asked = np.unpackbits(np.frombuffer(r["asked"], np.uint8), count=total).astype(bool)
            of = np.repeat(np.arange(len(n)), n)
            place = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            docs.append(_unids(r["doc"]))
            keys.append(_wide(r["text_key"]).astype(np.int64))
            row.append((of[asked] + at).astype(np.int32))
            ordinal.append(place[asked].astype(np.int32))
            hashes.append(np.frombuffer(r["hashes"], "<u8"))
            # what the task has settled itself
            flagged.append(np.stack([of[~asked] + at, place[~asked]]).astype(np.int32))
            at += len(n)
        docs, keys, row, ordinal, h = map(np.concatenate, (docs, keys, row, ordinal, hashes))
        order = np.lexsort((docs[row], h))
        new = np.r_[True, h[order][1:] != h[order][:-1]] if len(h) else np.empty(0, bool)
        least = docs[row[order]][np.flatnonzero(new)][np.cumsum(new) - 1]
        hit = order[docs[row[order]] != least]
        flagged.append(np.stack([row[hit], ordinal[hit]]))
        row, ordinal = np.concatenate(flagged, axis=1)
        del order, new, least, hit, h, hashes
        group = (mix(docs.view(np.uint64) ^ keys.view(np.uint64)) % np.uint64(groups)).astype(np.int64)[row]
        order = np.lexsort((ordinal, row, group))
        row, ordinal, group = row[order], ordinal[order], group[order]
        edges = np.searchsorted(group, np.arange(groups + 1))
        out = {k: [] for k in ("to", "bucket", "doc", "text_key", "n", "places")}
        bucket = table["bucket"][0].as_py()
        for g in np.flatnonzero(np.diff(edges)):
            a, b = edges[g], edges[g + 1]
            rows, n = np.unique(row[a:b], return_counts=True)
            for k, v in (("to", int(g)), ("bucket", bucket), ("doc", docs[rows].tobytes()), ("text_key", _narrow(keys[rows])), ("n", _narrow(n)), ("places", _narrow(ordinal[a:b]))):
                out[k].append(v)
        return pa.table({k: pa.array(v, pa.int64() if k in ("to", "bucket") else pa.binary()) for k, v in out.items()})

    return run


def _gather(table: pa.Table) -> pa.Table:
    """For one group of documents: a row for each that loses windows, with their buckets and places."""
    docs, keys, buckets, places = [], [], [], []
    for r in table.to_pylist():
        n = _wide(r["n"]).astype(np.int64)
        docs.append(np.repeat(np.frombuffer(r["doc"], np.int64), n))
        keys.append(np.repeat(_wide(r["text_key"]).astype(np.int64), n))
        places.append(_wide(r["places"]).astype(np.int32))
        buckets.append(np.full(len(places[-1]), r["bucket"], np.int32))
    docs, keys, buckets, places = map(np.concatenate, (docs, keys, buckets, places))
    order = np.lexsort((keys, docs))
    docs, keys, buckets, places = docs[order], keys[order], buckets[order], places[order]
    first = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])])
    bounds = np.r_[first, len(docs)].tolist()
    spans = list(zip(bounds[:-1], bounds[1:], strict=True))
    return pa.table({"doc": docs[first], "text_key": keys[first], "buckets": pa.array([buckets[a:b].tobytes() for a, b in spans], pa.binary()), "places": pa.array([places[a:b].tobytes() for a, b in spans], pa.binary())})


def covered(dealt: np.ndarray, at_buckets: np.ndarray, places: np.ndarray, buckets: int, window: int) -> np.ndarray:
    """Which words of a document lie in a repeated window: the maximal removal intervals, as a mask over its words."""
    bucket = _bucket_of(dealt, buckets)
    order = np.argsort(bucket, kind="stable")
    first = np.searchsorted(bucket[order], at_buckets)
    at = np.unique(order[first + places])
    change = np.zeros(len(dealt) + window, np.int32)
    change[at] += 1
    change[at + window] -= 1
    return np.cumsum(change[:-1]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs [start, end) of a mask."""
    edge = np.diff(np.r_[0, mask.astype(np.int8), 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _remove(window: int, buckets: int):
    kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.list_(pa.int64())), "kept": pa.string()}

    def run(batches):
        known = Words()
        for batch in batches:
            out = {k: [] for k in kinds}
            texts, every = batch["text"].cast(pa.binary()).to_pylist(), batch["places"].to_pylist()
            numbers = [known.hashes(raw) for raw, places in zip(texts, every, strict=True) if places]
            sizes, own = of_each(numbers, window)
            dealt = iter(np.split(_dealt(np.concatenate(numbers), window)[own], np.cumsum(sizes)[:-1]) if numbers else [])
            for raw, at, places in zip(texts, batch["buckets"].to_pylist(), every, strict=True):
                words = (raw or b"").split()
                spans, n = [], len(words)
                if places:
                    mask = covered(next(dealt), np.frombuffer(at, np.int32), np.frombuffer(places, np.int32), buckets, window)
                    spans = intervals(mask)
                    words = [w for w, gone in zip(words, mask.tolist(), strict=True) if not gone]
                kept = b" ".join(words)
                for k, v in (("n_words", n), ("n_removed", n - len(words)), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("spans", spans), ("kept", kept.decode())):
                    out[k].append(v)
            yield as_batch({"_rest": batch["_rest"]} | {k: pa.array(out[k], t) for k, t in kinds.items()})

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256, spans (word intervals removed) and kept (the text left) beside its columns.

    Ours replace columns of these names. Words are runs without the six ASCII separators. A word goes if a window of
    `window` words that covers it also starts in a row with a smaller doc_id; windows are judged on the input. Null
    text: no words (kept is empty). Null doc_id: larger than every id. Rows that repeat a doc_id: judged each by its own
    text, never against each other. Fewer words than the window: nothing is removed. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    rows, columns = with_rest(docs, ("doc_id", "long"), ("text", "string"))
    # texts tell rows of one id apart; where no id repeats, none is sent
    repeated = not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    text_key = F.xxhash64("text").bitwiseAND(F.lit(2**63 - 1)) if repeated else F.lit(0).cast("long")
    keyed = rows.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), text_key.alias("text_key"), "text", "_rest")
    octets = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(12, -(-octets // (6 * BUCKET)))  # a word and its separator take six bytes or so
    asked = keyed.select("doc", "text_key", "text").mapInArrow(_ask(window, buckets), "bucket long, doc binary, text_key binary, n binary, asked binary, hashes binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer(buckets), "to long, bucket long, doc binary, text_key binary, n binary, places binary")
    answers = answers.groupBy("to").applyInArrow(_gather, "doc long, text_key long, buckets binary, places binary")
    met = keyed.join(answers, ["doc", "text_key"], "left").select("_rest", "buckets", "places")
    ours = StructType.fromDDL("n_words long, n_removed long, kept_sha256 string, spans array<array<long>>, kept string")
    out = met.withColumn("text", F.col("_rest")["text"].cast("string")).mapInArrow(_remove(window, buckets), StructType([rows.schema["_rest"], *ours.fields]))
    return out.select(*[F.col("_rest")[c].alias(c) for c in columns if c not in ours.names], *ours.names)
