"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Encoding is SentencePiece's agenda: of all neighbours whose concatenation is a piece, the best scored (then the
leftmost) pair is taken off the agenda, and merged. With dropout, a candidate taken off is skipped if a keyed hash of
the seed, the document, the word's position and the candidate's place falls below the rate; it comes back only as a new
candidate, once a neighbour has changed. The hash depends on nothing else, so a seed gives the same pieces on any cluster.

No piece has a space mark but at its beginning, so a word with the spaces before it is encoded by itself. Every
occurrence of a word draws for itself. What occurrences share is the work between draws: equal words are in one state
until their draws differ, and a state's next candidate is found and merged once for all that are in it, all states of a
batch at a time with array operations. Long words go through a heap, occurrence by occurrence.

Characters without a piece become byte pieces, and so does a literal U+2581, which would otherwise decode to a space:
decoding gives back every text exactly.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from carrierlens.llm.common import as_batch, mix, small_batches

MODEL = "piece_bpe_32k.model"
RATE, SEED = 0.1, 2024
MARK = "▁"
#: Words of more characters go through the heap.
LONG = 48
#: Bits of a place among the symbols encoded at a time, and the rank of no candidate.
PLACE = np.int64(24)
NONE = np.int64(1) << np.int64(38)
_WORD = re.compile(r" *[^ ]+| +")
_NORMAL, _BYTE = 1, 6


class Pieces:
    """A BPE model's pieces, merges and byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.normalizer_spec.name != "identity":
            raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        if any(MARK in s.lstrip(MARK) for s in ids):
            raise ValueError("a piece has a space mark within")
        self.bytes = np.zeros(256, np.int32)
        self.raw = []
        for i, p in enumerate(proto.pieces):
            if p.type == _BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
            self.raw.append(bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE else p.piece.replace(MARK, " ").encode() if p.type == _NORMAL else b"")
        self.symbol = np.full(0x110000, -1, np.int32)
        for s, i in ids.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
        self.symbol[ord(" ")], self.symbol[ord(MARK)] = ids[MARK], -1
        score = np.array([p.score for p in proto.pieces])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        pairs = {}
        for s, i in ids.items():
            for k in range(1, len(s)):
                if s[:k] in ids and s[k:] in ids:
                    pairs[ids[s[:k]] << 20 | ids[s[k:]]] = i
        self.pairs = pairs
        # the same as an open hash table, for whole arrays
        self.bits = int(len(pairs) * 4).bit_length()
        keys, found = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        todo, values, self.probes = np.fromiter(pairs, np.int64), np.fromiter(pairs.values(), np.int32), 0
        while len(todo):
            slot = (self._slot(todo) + self.probes) & ((1 << self.bits) - 1)
            free = np.flatnonzero(keys[slot] < 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            keys[slot[free]], found[slot[free]] = todo[free], values[free]
            rest = np.ones(len(todo), bool)
            rest[free] = False
            todo, values, self.probes = todo[rest], values[rest], self.probes + 1
        self.keys, self.found = keys, found

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        out = np.full(len(left), -1, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[at].astype(np.int64) << 20 | right[at]
        slot = self._slot(keys)
        for _ in range(self.probes):
            here = self.keys[slot]
            hit = here == keys
            out[at[hit]] = self.found[slot[hit]]
            go = ~hit & (here >= 0)
            if not go.any():
                break
            at, keys, slot = at[go], keys[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def expand(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece (minus their code point, less one) as byte pieces; and the owner of each id."""
        if not (symbols < 0).any():
            return symbols, owner
        ids, owners = [], []
        for s, w in zip(symbols.tolist(), owner.tolist(), strict=True):
            own = [s] if s >= 0 else self.bytes[list(chr(-s - 1).encode())].tolist()
            ids += own
            owners += [w] * len(own)
        return np.array(ids, np.int32), np.array(owners, np.int64)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def _dropped(key: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Whether candidates (characters start..mid and mid..end of a word) are skipped."""
    place = (start.astype(np.uint64) << np.uint64(42)) ^ (mid.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)
    return (mix(key ^ mix(place + np.uint64(1))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < rate


def _by_heap(model: Pieces, symbols: list[int], key: int, rate: float) -> list[int]:
    """One word by an agenda in a heap: rank, then place."""
    n, key = len(symbols), np.array([key], np.uint64)
    before, after, ends = list(range(-1, n - 1)), [*range(1, n), -1], list(range(1, n + 1))
    agenda: list[tuple[int, int, int, int, int]] = []
    pairs, rank = model.pairs, model.rank

    def offer(i, j):
        if i >= 0 and j >= 0 and symbols[i] >= 0 and symbols[j] >= 0:
            m = pairs.get(symbols[i] << 20 | symbols[j])
            if m is not None:
                heapq.heappush(agenda, (int(rank[m]), i, j, ends[j], m))

    for i in range(n - 1):
        offer(i, i + 1)
    dead = [False] * n
    while agenda:
        _, i, j, end, m = heapq.heappop(agenda)
        if dead[i] or dead[j] or after[i] != j or ends[j] != end or ends[i] != j:
            continue  # a neighbour has changed since
        if pairs.get(symbols[i] << 20 | symbols[j]) != m:
            continue
        if rate > 0 and _dropped(key, np.array([i]), np.array([j]), np.array([end]), rate)[0]:
            continue
        symbols[i], ends[i], after[i], dead[j] = m, end, after[j], True
        if after[i] >= 0:
            before[after[i]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [s for s, gone in zip(symbols, dead, strict=True) if not gone]


def encode_words(model: Pieces, words: list[str], which: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all distinct outcomes, one after another, how many each has, and the outcome of each occurrence.

    Occurrence k is of words[which[k]] and draws with keys[k]. A state is a word and what was drawn for it so far.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    symbols = model.symbol[chars]
    symbols = np.where(symbols < 0, -chars.astype(np.int64) - 1, symbols).astype(np.int32)
    firsts = np.cumsum(lengths) - lengths
    outcome, outcomes = np.zeros(len(which), np.int64), 0
    done, owners = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    plain: dict[int, int] = {}
    for k in np.flatnonzero(lengths[which] > LONG):
        w = int(which[k])
        if rate > 0 or w not in plain:
            own = _by_heap(model, symbols[firsts[w] : firsts[w] + lengths[w]].tolist(), int(keys[k]), rate)
            done.append(np.array(own, np.int32))
            owners.append(np.full(len(own), outcomes))
            plain[w], outcomes = outcomes, outcomes + 1
        outcome[k] = plain[w]
    short = lengths <= LONG
    word = np.repeat(np.cumsum(short) - 1, lengths)
    start = np.arange(len(chars)) - np.repeat(firsts, lengths)
    inside = np.repeat(short, lengths)
    symbols, word, start = symbols[inside], word[inside], start[inside]
    live = np.flatnonzero(short[which])
    state, keys, lengths = (np.cumsum(short) - 1)[which[live]], keys[live], lengths[short]

    def ranks(at: np.ndarray) -> None:
        """Candidates that begin at these symbols, anew."""
        at = at[(at >= 0) & (at < len(symbols))]
        last = at == len(symbols) - 1
        nxt = np.where(last, at, at + 1)
        m = np.where(last | (word[at] != word[nxt]), -1, model.merged(symbols[at], symbols[nxt]))
        rank[at] = np.where(m >= 0, model.rank[m], NONE)
        made[at] = m

    rank, made = np.full(len(symbols), NONE), np.full(len(symbols), -1, np.int32)
    ranks(np.arange(len(symbols)))
    while len(symbols):
        # symbols of a state lie together, states are 0, 1, ... in order
        heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[heads, len(word)])
        first = np.minimum.reduceat((rank << PLACE) + np.arange(len(rank)), heads)
        over = (first >> PLACE) >= NONE
        at = first & ((np.int64(1) << PLACE) - 1)
        if over.any():
            out = np.repeat(over, sizes)
            number = outcomes + np.cumsum(over) - 1
            done.append(symbols[out])
            owners.append(number[word[out]])
            ended = over[state]
            outcome[live[ended]] = number[state[ended]]
            outcomes += int(over.sum())
            live, state, keys = live[~ended], state[~ended], keys[~ended]
        if over.all():
            break
        # each occurrence draws for its state's candidate; a state goes on as those that skip it and those that merge it
        mid = np.minimum(at + 1, len(word) - 1)
        after = np.minimum(at + 2, len(word) - 1)
        end = np.where((at + 2 < len(word)) & (word[after] == word[at]), start[after], lengths)
        if rate > 0:
            drops = _dropped(keys, start[at][state], start[mid][state], end[state], rate)
        else:
            drops = np.zeros(len(state), bool)
        code = 2 * state + drops
        there = np.zeros(2 * len(heads), bool)
        there[code] = True
        goes = np.flatnonzero(there)
        state = (np.cumsum(there) - 1)[code]
        origin, skips = goes >> 1, (goes & 1).astype(bool)
        n = sizes[origin]
        begins = np.cumsum(n) - n
        take = np.repeat(heads[origin] - begins, n) + np.arange(int(n.sum()))
        at, lengths = at[origin] - heads[origin] + begins, lengths[origin]
        word = np.repeat(np.arange(len(goes)), n)
        symbols, start, rank, made = symbols[take], start[take], rank[take], made[take]
        rank[at[skips]] = NONE
        at = at[~skips]
        symbols[at] = made[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        at = np.cumsum(keep)[at] - 1
        symbols, word, start, rank, made = symbols[keep], word[keep], start[keep], rank[keep], made[keep]
        ranks(np.concatenate([at, at[at > 0] - 1]))
    symbols, owner = np.concatenate(done), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    ids, owner = model.expand(symbols[order], owner[order])
    return ids.astype(np.int32), np.bincount(owner, minlength=outcomes), outcome


#: Characters of occurrences that are encoded at a time; their states have no more, and places take PLACE bits.
CHARS = 1 << 22


def encode_batch(model: Pieces, texts: list[str | None], doc_keys: np.ndarray, rate: float = RATE, seed: int = SEED) -> list[np.ndarray]:
    """The ids of each text; a null text as empty, an empty text without ids."""
    lead = " " if model.prefix else ""
    known: dict[str, int] = {}
    codes, keyed, counts = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], []
    for text, key in zip(texts, doc_keys, strict=True):
        own = _WORD.findall(lead + text) if text else []
        codes.append(np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own)))
        keyed.append(mix(mix(np.arange(len(own), dtype=np.uint64) ^ np.uint64(seed)) + key))
        counts.append(len(own))
    which, keys, names = np.concatenate(codes), np.concatenate(keyed), list(known)
    del codes, keyed
    total = np.cumsum(np.fromiter(map(len, names), np.int64, len(names))[which]) if names else np.empty(0, np.int64)
    gathered, sizes, at = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
    while at < len(which):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHARS)))
        distinct, part = np.unique(which[at:end], return_inverse=True)
        ids, many, outcome = encode_words(model, [names[k] for k in distinct.tolist()], part, keys[at:end], rate)
        # every occurrence takes its outcome's ids
        n = many[outcome]
        starts = np.cumsum(n) - n
        gathered.append(ids[np.repeat((np.cumsum(many) - many)[outcome] - starts, n) + np.arange(int(n.sum()))])
        sizes.append(n)
        at = end
    flat = np.concatenate(gathered)
    bounds = np.r_[0, np.cumsum(np.concatenate(sizes))][np.r_[0, np.cumsum(counts)].astype(np.int64)]
    return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def decode(model: Pieces, ids) -> str:
    """The text of ids."""
    raw = model.raw
    out = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
    return out[1:] if model.prefix and out.startswith(" ") else out


#: Bytes of texts that are encoded together: the more, the more often a word is encoded once only.
HELD = 10 << 20


def gathered(batches):
    """Batches joined until they hold HELD bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size or held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()[:1]


def _encode(path: str, rate: float, seed: int):
    def run(batches):
        model = load(path)
        for batch in gathered(batches):
            texts = batch["text"].to_pylist()
            docs = np.array([0 if d is None else d for d in batch["doc_id"].to_pylist()], np.int64).view(np.uint64)
            ids = encode_batch(model, texts, mix(docs + np.uint64(1)), rate, seed)
            back = [decode(model, i.tolist()) == (t or "") for i, t in zip(ids, texts, strict=True)]
            offsets = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
            yield as_batch({"doc_id": batch["doc_id"], "ids": lists, "n_ids": pa.array(np.diff(offsets).astype(np.int64)), "lossless": pa.array(back)})

    return run


def encode(docs: DataFrame, rate: float = RATE, seed: int = SEED, model_path: str | None = None) -> DataFrame:
    """doc_id, ids, n_ids, lossless (whether the ids decode to the text) of every row of docs(doc_id, text).

    Null or empty text: no ids. Null doc_id: encoded as document 0 would be. Repeated rows: equal ids. Rate 0: the
    pieces of SentencePiece itself. No rows: no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    path = model_path or public_tokenizers.path(MODEL)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(path, rate, seed), StructType.fromDDL("doc_id long, ids array<int>, n_ids long, lossless boolean"))
