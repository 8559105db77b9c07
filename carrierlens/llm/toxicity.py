"""Toxicity by compression distance: how much better a text's windows compress beside toxic than beside ordinary text.

A bounded, documented sample of labelled documents trains two zstandard dictionaries: the toxic one from the word
stems that toxic documents favour, the ordinary one from the most frequent words of the others. Both are raw-content
dictionaries filled by coverage, best content last, where matches are cheapest: with dictionaries by the library's own
trainer the held-out recall was lower in every form tried (README). A window is a word with its
separators, followed by a fixed run of bytes that both dictionaries hold, so that even a short window is compressed
and not stored. The pair of compressed lengths of a window (beside the ordinary, beside the toxic dictionary) has a
log-odds in the sample; the windows of a document that lean to toxic add up, and a logistic curve over these sums
calibrates the score. Scoring reads whole texts; equal windows of a task are compressed once.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from carrierlens.llm.common import as_batch, small_batches, with_rest

THRESHOLD = 0.7
#: Bounds of the sample that is fitted, in documents of each kind; longer texts than FIT_CHARS are not fitted on.
FIT_TOXIC, FIT_ORDINARY, FIT_CHARS = 2_000, 5_000, 20_000
TOXIC_BYTES, ORDINARY_BYTES = 1_500, 8_192
#: A stem is favoured if it is in this share of toxic documents and so many times likelier there.
SHARE, LIFT = 0.03, 6.0
CARRIER = bytes(range(128, 192))
#: Compressed lengths are told apart below LENGTHS; windows lean to toxic from this log-odds on.
LENGTHS, LEAN, SMOOTH = 32, 1.5, 50.0
CACHE = 300_000
_NO_LETTERS = re.compile(r"[\W\d_]+")


def windows(text: str | None) -> Counter:
    """The windows of a whole text, lower-cased, with their counts."""
    return Counter(_NO_LETTERS.sub(" ", (text or "").lower()).encode().split())


def _dictionary(segments: Counter, size: int) -> bytes:
    """Content of at most size bytes, by weight times length; what other content holds is not repeated; the best comes last."""
    kept, held, used = [], b"", 0
    for s, n in sorted(segments.items(), key=lambda x: (-x[1] * len(x[0]), x[0])):
        if s in held:
            continue
        if used + len(s) > size:
            break
        kept.append(s)
        held, used = held + b"\x00" + s, used + len(s)
    return b"".join(reversed(kept))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    odds: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def ready(self) -> None:
        options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False, "format": zstandard.FORMAT_ZSTD1_MAGICLESS}
        make = lambda raw: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=zstandard.ZstdCompressionParameters.from_level(3, min_match=3, **options)).compress
        self._beside_ordinary, self._beside_toxic, self._cache = make(self.ordinary), make(self.toxic), {}

    def lengths(self, window: bytes) -> tuple[int, int]:
        w = b" " + window + b" " + CARRIER
        return min(len(self._beside_ordinary(w)), LENGTHS - 1), min(len(self._beside_toxic(w)), LENGTHS - 1)

    def lean(self, window: bytes) -> float:
        got = self._cache.get(window)
        if got is None:
            if len(self._cache) >= CACHE:
                self._cache.clear()
            got = float(self.odds[self.lengths(window)])
            if len(window) < 100:
                self._cache[window] = got
        return got

    def features(self, counts: Counter) -> tuple[float, ...]:
        leans = np.fromiter((self.lean(w) for w in counts), np.float64, len(counts))
        return _features(leans, np.fromiter(counts.values(), np.float64, len(counts)))

    def score(self, counts: Counter) -> float:
        if self.constant is not None:
            return self.constant
        x = (np.array(self.features(counts)) - self.mean) / self.scale
        z = float(self.weights[0] + x @ self.weights[1:])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _features(leans: np.ndarray, counts: np.ndarray) -> tuple[float, ...]:
    total = max(1.0, counts.sum())
    towards, away = float(counts @ np.where(leans > LEAN, leans, 0.0)), float(counts @ leans)
    return towards / total**0.5, 100 * towards / total, np.log1p(towards), np.log(total), away / total**0.5


class Sample:
    """Documents of one kind as numbers of their windows in a shared list, with counts."""

    def __init__(self, texts, known: dict[bytes, int]):
        self.windows, self.counts = [], []
        for text in texts:
            c = windows(text)
            self.windows.append(np.fromiter((known.setdefault(w, len(known)) for w in c), np.int32, len(c)))
            self.counts.append(np.fromiter(c.values(), np.int32, len(c)))

    def __len__(self):
        return len(self.windows)

    def documents_with(self, numbers: np.ndarray) -> np.ndarray:
        """In how many documents each of the numbers (one for each window; negative: none) occurs."""
        out = np.zeros(int(numbers.max(initial=0)) + 1, np.int64)
        for own in self.windows:
            n = numbers[own]
            out[np.unique(n[n >= 0])] += 1
        return out


SHORTEST, LONGEST = 5, 12


def _favoured(padded: list[bytes], toxic: Sample, ordinary: Sample) -> set[bytes]:
    """Beginnings of windows that enough toxic documents have, and few others; longer ones only of frequent shorter ones."""
    out: set[bytes] = set()
    frequent = None
    for n in range(SHORTEST, LONGEST + 1):
        stems: dict[bytes, int] = {}
        numbers = np.fromiter((stems.setdefault(w[:n], len(stems)) if len(w) >= n and (frequent is None or w[: n - 1] in frequent) else -1 for w in padded), np.int64, len(padded))
        in_toxic, in_ordinary = toxic.documents_with(numbers), ordinary.documents_with(numbers)
        frequent = {s for s, k in stems.items() if in_toxic[k] >= max(2, SHARE * len(toxic))}
        out |= {s for s in frequent if in_toxic[stems[s]] / len(toxic) >= LIFT * (in_ordinary[stems[s]] + 1) / (len(ordinary) + 1)}
    return out


def fit(toxic_texts: list[str], ordinary_texts: list[str], weight: float = 1.0) -> Model:
    """A model of both kinds of texts; weight: how many ordinary documents each of those given stands for."""
    if not toxic_texts or not ordinary_texts:
        none = np.zeros(0)
        return Model(b"", b"", none, none, none, none, constant=1.0 if toxic_texts else 0.0)
    known: dict[bytes, int] = {}
    toxic, ordinary = Sample(toxic_texts, known), Sample(ordinary_texts, known)
    padded = [b" " + w + b" " for w in known]
    favoured = _favoured(padded, toxic, ordinary)
    each = np.arange(len(padded))
    in_toxic, in_ordinary = toxic.documents_with(each), ordinary.documents_with(each)
    stems, common = Counter(), Counter()
    for k in np.flatnonzero(in_toxic).tolist():
        w = padded[k]
        longest = next((s for n in range(min(LONGEST, len(w)), SHORTEST - 1, -1) if (s := w[:n]) in favoured), None)
        if longest:
            stems[longest] += int(in_toxic[k])
    for k in np.flatnonzero(in_ordinary > 1).tolist():
        common[padded[k]] = int(in_ordinary[k])
    model = Model(_dictionary(common, ORDINARY_BYTES), _dictionary(stems, TOXIC_BYTES), np.zeros((LENGTHS, LENGTHS)), np.zeros(5), np.ones(5), np.zeros(6))
    model.ready()
    at = np.array([model.lengths(w) for w in known], np.int64).reshape(-1, 2)
    seen = np.zeros((2, LENGTHS, LENGTHS))
    for y, docs in enumerate((ordinary, toxic)):
        for own, n in zip(docs.windows, docs.counts, strict=True):
            np.add.at(seen[y], (at[own, 0], at[own, 1]), n)
    share = seen.sum(0) / max(1, seen.sum())
    rate = (seen + SMOOTH * share) / (seen.sum((1, 2), keepdims=True) + SMOOTH)
    model.odds = np.where(share > 0, np.log(np.where(share > 0, rate[1], 1)) - np.log(np.where(share > 0, rate[0], 1)), 0.0)
    leans = model.odds[at[:, 0], at[:, 1]] if len(at) else np.zeros(0)
    x = np.array([_features(leans[own], n.astype(np.float64)) for docs in (ordinary, toxic) for own, n in zip(docs.windows, docs.counts, strict=True)])
    y = np.r_[np.zeros(len(ordinary)), np.ones(len(toxic))]
    of = np.r_[np.full(len(ordinary), weight), np.ones(len(toxic))]
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    x = np.c_[np.ones(len(x)), (x - model.mean) / model.scale]
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (of * (y - p)) - 0.1 * w
        curve = (x * (of * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    return model


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most FIT_TOXIC + FIT_ORDINARY labelled documents outside the held-out third, chosen by a hash of the id."""
    own = labels.where("doc_id is not null and toxic is not null").where(~_held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    there = {r["toxic"] != 0: r["n"] for r in own.groupBy((F.col("toxic") != 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for toxic, most in ((True, FIT_TOXIC), (False, FIT_ORDINARY)):
        part = own.where((F.col("toxic") != 0) == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.length("text") <= FIT_CHARS)
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    kinds: dict[bool, list] = {True: [], False: []}
    for r in texts.collect():  # a text for each id: at most FIT_TOXIC + FIT_ORDINARY of FIT_CHARS characters
        kinds[r["toxic"] != 0].append((r["doc_id"], r["text"]))
    kinds = {k: [t for _, t in sorted(v)] for k, v in kinds.items()}
    weight = there.get(False, 0) / max(1, len(kinds[False])) / max(1.0, there.get(True, 0) / max(1, len(kinds[True])))
    return fit(kinds[True], kinds[False], max(weight, 1e-3))


def _score(model: Model):
    def run(batches):
        if model.constant is None:
            model.ready()
        for batch in batches:
            scores = [model.score(windows(t)) for t in batch["text"].to_pylist()]
            yield as_batch({n: batch[n] for n in batch.schema.names} | {"score": pa.array(scores, pa.float64())})

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted beside its columns (ours replace columns of these names).

    Read are doc_id and text; labels(doc_id, toxic) are learnt from. The score reads nothing but the text. Null, empty
    and wordless texts: the score of a text without windows. Null doc_id: scored, not held out. Labels that repeat a
    document: toxic if one of them is. Labels of one kind only, or none: the score is that kind's for every text (0
    without labels). Repeated rows: scored each. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    model = train(docs, labels)
    rows, columns = with_rest(docs, ("doc_id", "long"), ("text", "string"))
    scored = rows.mapInArrow(_score(model), StructType([*rows.schema.fields, StructField("score", DoubleType())]))
    ours = {"held_out": _held_out(F.col("doc_id")), "score": F.col("score"), "predicted": (F.col("score") >= threshold).cast("int")}
    return scored.select(*[F.col("_rest")[c].alias(c) for c in columns if c not in ours], *[v.alias(c) for c, v in ours.items()])
