"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is eight bytes. Two fingerprints that differ in at most d bits differ in at most d bytes, so at least
m = 8 - d of their positional bytes are the same (m = 4 for d = 4): that is the guaranteed minimum of matches. The
index posts every distinct fingerprint under each set of m (position, byte) pairs it holds, so that lists of single
bytes, which would grow with the square of the corpus, are never joined. The shared positional bytes of pairs that meet
are tallied; pairs at the minimum and above are retained, in the one list of their first m shared positions, and
verified by the exact bit distance.

Equal fingerprints are collapsed before the index, and a long posting list yields a spanning forest of its links instead
of its pairs: from a seed, everything within reach is taken out of the list at once, so a list of thousands of close
copies costs little more than one pass over it. A bucket with too many postings is posted again by half bytes of what
its lists do not share, by the same count: of 2 d half bytes, d are the same. Such a list has 16^d fingerprints at most.
No list, bucket or partner count is capped.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierlens.llm.common import as_batch, components, cut, drop, mix, small_batches

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Postings of one bucket, about: 8 bytes each.
BUCKET = 500_000
#: Postings of a bucket that is posted again.
HOT = 4 * BUCKET
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def shingle_hashes(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of every run of `size` words, in order; of the whole sequence if it is shorter; none without words."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, size = b" ".join(words), min(size, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - size]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | bytes | None, size: int = SHINGLE) -> int:
    raw = text.encode() if isinstance(text, str) else text
    return majority(shingle_hashes(raw or b"", size))


def _fingerprints(size: int):
    def run(batches):
        for batch in batches:
            texts = batch["text"].cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t, size) for t in texts], np.uint64)
            yield as_batch({"doc_id": batch["doc_id"], "fp": pa.array(fps.view(np.int64))})

    return run


def _masks(distance: int) -> np.ndarray:
    byte = lambda k: 0xFF << (8 * k)
    return np.array([sum(map(byte, kept)) for kept in combinations(range(8), 8 - distance)], np.uint64)


def _post(masks: np.ndarray, parts: int):
    """Rows (bucket, postings): the fingerprints of a batch under every posting key, gathered by bucket of the key."""

    def run(batches):
        for batch in batches:
            fps = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            buckets, blobs = [], []
            for k, mask in enumerate(masks):
                part = (mix((fps & mask) + np.uint64(k)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(edges)):
                    buckets.append(k * parts + int(p))
                    blobs.append(fps[order[edges[p] : edges[p + 1]]].tobytes())
            yield as_batch({"bucket": pa.array(buckets, pa.int64()), "postings": pa.array(blobs, pa.binary())})

    return run


def forest(close: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (smallest, members) of each component of sorted distinct fingerprints under the bit distance."""
    out, rest = [], close
    while len(rest) > 1:
        seed, rest = rest[:1], rest[1:]
        front, found = seed, []
        while len(front) and len(rest):
            step, reached = max(1, (1 << 20) // len(rest)), []
            for at in range(0, len(front), step):
                near = (np.bitwise_count(front[at : at + step, None] ^ rest[None, :]) <= distance).any(0)
                if near.any():
                    reached.append(rest[near])
                    rest = rest[~near]
                    if not len(rest):
                        break
            front = np.concatenate(reached) if reached else rest[:0]
            found += reached
        if found:
            members = np.concatenate(found)
            out.append((np.repeat(seed, len(members)), members))
    return out


def tally(differ: np.ndarray) -> np.ndarray:
    """How many positional bytes pairs share, by the bits in which they differ."""
    return (differ[:, None].view(np.uint8) == 0).sum(1)


def first_list(differ: np.ndarray, least: int) -> np.ndarray:
    """The mask of the first `least` positional bytes that pairs share, which have so many."""
    same = differ[:, None].view(np.uint8) == 0
    first = same & (np.cumsum(same, 1) <= least)
    return np.where(first, np.uint8(255), np.uint8(0)).astype(np.uint8).view("<u8").ravel()


def links(fps: np.ndarray, mask: np.ndarray, distance: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of fingerprints which share the bits in mask and differ in few enough bits.

    whole: the mask is that of a list of whole bytes, and a pair of a short list is told in its first list only.
    """
    fps = np.unique(fps)
    fps = fps[np.argsort(fps & mask, kind="stable")]
    key = fps & mask
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[first, len(key)])
    a, b = [], []
    # short lists: neighbours at every offset, over all lists at once
    longest, least = 8, 8 - distance
    short = np.repeat(sizes <= longest, sizes)
    run = np.repeat(np.arange(len(sizes)), sizes)
    for d in range(1, min(longest, len(fps))):
        hit = np.flatnonzero(short[:-d] & (run[:-d] == run[d:]))
        differ = fps[hit] ^ fps[hit + d]
        kept = tally(differ) >= least
        kept &= np.bitwise_count(differ) <= distance
        if whole:
            kept[kept] = first_list(differ[kept], least) == mask
        hit = hit[kept]
        a.append(fps[hit])
        b.append(fps[hit + d])
    for k in np.flatnonzero(sizes > longest):
        for roots, members in forest(fps[first[k] : first[k] + sizes[k]], distance):
            a.append(roots)
            b.append(members)
    empty = [np.empty(0, np.uint64)]
    return np.concatenate(a or empty), np.concatenate(b or empty)


def _links(masks: np.ndarray, parts: int, distance: int):
    def run(table: pa.Table) -> pa.Table:
        k = table["bucket"][0].as_py() // parts
        fps = np.concatenate([np.frombuffer(x, np.uint64) for x in table["postings"].to_pylist()])
        a, b = links(fps, masks[k], distance)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return run


def _halves(mask: int, distance: int) -> list[int]:
    """The masks of a list's own bytes and each choice of `distance` half bytes of the others."""
    half = lambda k: 0xF << (4 * k)
    others = [k for k in range(16) if not mask & half(k)]
    return [mask | sum(map(half, kept)) for kept in combinations(others, distance)]


def _post_again(masks: np.ndarray, parts: int, distance: int):
    """Rows (bucket, again, part, postings) of buckets with n postings: these under every choice of half bytes."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                fps, n = np.frombuffer(r["postings"], np.uint64), r["n"] // BUCKET + 1
                out = {"again": [], "part": [], "postings": []}
                for k, mask in enumerate(_halves(int(masks[r["bucket"] // parts]), distance)):
                    part = (mix((fps & np.uint64(mask)) + np.uint64(k)) % np.uint64(n)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    edges = np.searchsorted(part[order], np.arange(n + 1))
                    for p in np.flatnonzero(np.diff(edges)).tolist():
                        out["again"].append(k)
                        out["part"].append(p)
                        out["postings"].append(fps[order[edges[p] : edges[p + 1]]].tobytes())
                yield as_batch({"bucket": pa.array([r["bucket"]] * len(out["again"]), pa.int64()), "again": pa.array(out["again"], pa.int64()), "part": pa.array(out["part"], pa.int64()), "postings": pa.array(out["postings"], pa.binary())})

    return run


def _links_again(masks: np.ndarray, parts: int, distance: int):
    def run(table: pa.Table) -> pa.Table:
        mask = _halves(int(masks[table["bucket"][0].as_py() // parts]), distance)[table["again"][0].as_py()]
        fps = np.concatenate([np.frombuffer(x, np.uint64) for x in table["postings"].to_pylist()])
        a, b = links(fps, np.uint64(mask), distance, whole=False)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id of every row of docs(doc_id, text).

    Fingerprints at `distance` (at most 7) or fewer differing bits are linked; component_id is the smallest doc_id
    reachable. Null, empty or blank text: fingerprint zero, linked like any other. Null doc_id: the row has a
    component like others, and a component of null ids only has id null. Repeated rows: returned as often. No rows: no
    rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = cut(rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "fingerprints")
    distinct = cut(rows.select("fp").distinct(), "fps")
    masks = _masks(distance)
    parts = max(1, -(-distinct.count() // BUCKET))
    posted = distinct.mapInArrow(_post(masks, parts), "bucket long, postings binary")
    hot = cut(posted.groupBy("bucket").agg((F.sum(F.octet_length("postings")) / 8).cast("long").alias("n")).where(F.col("n") > HOT), "hot") if distance else None
    some = hot is not None and not hot.isEmpty()
    found = (posted.join(hot, "bucket", "left_anti") if some else posted).groupBy("bucket").applyInArrow(_links(masks, parts, distance), "a long, b long")
    if some:
        again = posted.join(hot, "bucket").mapInArrow(_post_again(masks, parts, distance), "bucket long, again long, part long, postings binary")
        found = found.unionByName(again.groupBy("bucket", "again", "part").applyInArrow(_links_again(masks, parts, distance), "a long, b long"))
    roots = components(found, "simhash")
    drop(distinct)
    drop(hot)
    rooted = rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = cut(rooted.select("doc_id", "fp", F.coalesce("root", "fp").alias("root")), "rooted")
    drop(rows)
    smallest = cut(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    out = rooted.join(smallest, "root")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Texts are near copies if their sets of shingles share 4 of 5 of the union.
SHARE = (4, 5)
#: A text has PRINTS fingerprints of WORDS words, 16 positional bytes each; one of at most FEW shingles has twice as many.
PRINTS, WORDS, FEW = 6, 2, 5
BYTES = 8 * WORDS
#: Candidates share LEAST positional bytes of a fingerprint, and it differs in at most WIDE of its 128 bits.
LEAST, WIDE = 2, 30
#: Buckets of the first position's lists at least; each text is in one of these lists.
HEADS = 8
#: Where fingerprints are posted, by number and position; the last positions can't be the first of LEAST.
PLACES = [(f, i) for f in range(2 * PRINTS) for i in range(BYTES - LEAST + 1)]
#: Lists up to SHORT are compared by neighbours at every offset; one with over DENSE links a member is spanned.
SHORT, DENSE = 32, 8
_STREAMS = np.arange(1, 1 + 2 * PRINTS * WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_LANES = np.uint64(0x0101010101010101)
#: Bits of the sieve that keeps the sets of most texts without candidates out of the exchange: 8 MB whatever the table.
SIEVE = 1 << 26
#: Shingles whose bits are counted at once; candidate texts whose sets are compared in one task, about.
COUNTED, TOGETHER = 1 << 14, 1000
#: Bytes of the sets of a group of candidates that is compared in one task; larger groups are compared by pairs of blocks.
GROUP_BYTES = 64 << 20


def shingle_set(raw: bytes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(raw, size))


def sketches(sets: list[np.ndarray], start: int = 0) -> np.ndarray:
    """PRINTS fingerprints of each set (none empty), from the one numbered start: a row of PRINTS * WORDS words.

    A bit is 1 if set in over half of the shingle hashes, mixed anew for every word.
    """
    words, sizes = PRINTS * WORDS, np.array([len(s) for s in sets], np.int64)
    ones = np.zeros((len(sets), words, 8, 8), np.int32)  # by bit of the byte and byte of the word
    if not len(sets):
        return np.empty((0, words), np.uint64)
    # runs of at most 255 hashes of a set: eight counts fit into the bytes of a word
    flat, runs = np.concatenate(sets), -(-sizes // 255)
    of = np.repeat(np.arange(len(sets)), runs)
    begin = np.repeat(np.cumsum(sizes) - sizes, runs) + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs))
    edges = np.unique(np.r_[np.searchsorted(begin, np.arange(0, len(flat), COUNTED)), len(of)])
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        h = flat[begin[low] : begin[high] if high < len(of) else len(flat)]
        at, counts = begin[low:high] - begin[low], np.empty((high - low, words, 8, 8), np.uint8)
        for w in range(words):
            mixed = mix(h + _STREAMS[start * WORDS + w])
            for bit in range(8):
                lanes = np.add.reduceat(mixed >> np.uint64(bit) & _LANES, at)
                counts[:, w, bit] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
        heads = np.flatnonzero(np.r_[True, of[low + 1 : high] != of[low : high - 1]])
        ones[of[low:high][heads]] += np.add.reduceat(counts, heads, axis=0, dtype=np.int32)
    most = 2 * ones > sizes[:, None, None, None]
    return np.packbits(most.swapaxes(2, 3), axis=-1, bitorder="little").reshape(len(sets), 8 * words).view("<u8")


def _sets(size: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t or b"", size) for t in batch["text"].cast(pa.binary()).to_pylist()]
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            prints = [b""] * len(sets)
            for start, some in ((0, [k for k, s in enumerate(sets) if len(s)]), (PRINTS, [k for k, s in enumerate(sets) if 0 < len(s) <= FEW])):
                for k, row in zip(some, sketches([sets[k] for k in some], start), strict=True):
                    prints[k] += row.tobytes()
            yield as_batch({"doc_id": batch["doc_id"], "id": pa.array(ids), "prints": pa.array(prints, pa.binary()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def _gather(part: np.ndarray, rows: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(part, kind="stable")
    values, first = np.unique(part[order], return_index=True)
    return [(int(p), rows[own].tobytes()) for p, own in zip(values, np.split(order, first[1:]), strict=True)]


def _octets(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, :WORDS]).view(np.uint8)


def _post_prints(places: list[tuple[int, int]], parts: int):
    """Rows (bucket, postings): each fingerprint with its text's id in the list of each of its bytes at places.

    A bucket has some lists of one position.
    """

    def run(batches):
        for batch in batches:
            prints, ids = batch["prints"].to_pylist(), batch["id"].to_numpy().view(np.uint64)
            buckets, blobs = [], []
            for f in sorted({f for f, _ in places}):
                has = [k for k, p in enumerate(prints) if len(p) > f * BYTES]
                words = np.frombuffer(b"".join([prints[k][f * BYTES : (f + 1) * BYTES] for k in has]), np.uint64).reshape(-1, WORDS)
                rows = np.column_stack([words, ids[has]])
                octets = _octets(rows)
                for i in [i for g, i in places if g == f and has]:
                    for p, blob in _gather(octets[:, i].astype(np.int64) % parts, rows):
                        buckets.append((f * BYTES + i) * parts + p)
                        blobs.append(blob)
            yield as_batch({"bucket": pa.array(buckets, pa.int64()), "postings": pa.array(blobs, pa.binary())})

    return run


def _post_prints_again(parts: int):
    """Rows (bucket, other, part, postings) of buckets with n postings: these by each later position and both bytes."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows, n = np.frombuffer(r["postings"], np.uint64).reshape(-1, WORDS + 1), r["n"] // BUCKET + 1
                octets, i = _octets(rows).astype(np.uint64), r["bucket"] // parts % BYTES
                out = {"other": [], "part": [], "postings": []}
                for j in range(i + 1, BYTES):
                    for p, blob in _gather((mix(octets[:, i] << np.uint64(8) | octets[:, j]) % np.uint64(n)).astype(np.int64), rows):
                        out["other"].append(j)
                        out["part"].append(p)
                        out["postings"].append(blob)
                yield as_batch({"bucket": pa.array([r["bucket"]] * len(out["other"]), pa.int64()), "other": pa.array(out["other"], pa.int64()), "part": pa.array(out["part"], pa.int64()), "postings": pa.array(out["postings"], pa.binary())})

    return run


def apart(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many bits fingerprints differ; their words are along the first axis."""
    return sum(np.bitwise_count(a ^ b) for a, b in zip(one, other, strict=True))


def spanned(prints: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (first, other) of links that span the components of a list under the bit distance."""
    a, b, rest = [], [], np.arange(prints.shape[1])
    while len(rest) > 1:
        seed, rest = rest[:1], rest[1:]
        front = seed
        while len(front) and len(rest):
            step, reached = max(1, (1 << 20) // len(rest)), []
            for at in range(0, len(front), step):
                near = (apart(prints[:, front[at : at + step], None], prints[:, None, rest]) <= wide).any(0)
                reached.append(rest[near])
                rest = rest[~near]
                if not len(rest):
                    break
            front = np.concatenate(reached)
            a.append(np.repeat(seed, len(front)))
            b.append(front)
    return np.concatenate(a), np.concatenate(b)


def long_list(prints: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs of a list within the bit distance, or of links that span its components if they are many."""
    n, total, a, b = prints.shape[1], 0, [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, (1 << 20) // n)
    for at in range(0, n, step):
        near = apart(prints[:, at : at + step, None], prints[:, None, at:]) <= wide
        if np.count_nonzero(near) == np.count_nonzero(near.diagonal()):
            continue
        one, other = np.nonzero(near)
        a.append(one[one < other] + at)
        b.append(other[one < other] + at)
        total += len(a[-1])
        if total > DENSE * n:
            return spanned(prints, wide)
    return np.concatenate(a), np.concatenate(b)


def posted_pairs(rows: np.ndarray, i: int, others: range, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs of postings (words, id) in one list of position i that share one of the other positional bytes.

    The shared bytes of each pair are tallied; a pair of a short list that has LEAST and is within the bit distance is
    told where the tally gets there, so once. Long lists of many links yield what spans them, those of one id nothing.
    """
    ids = rows[:, WORDS]
    octets, words = np.ascontiguousarray(_octets(rows).T), np.ascontiguousarray(rows[:, :WORDS].T)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for j in others:
        key = octets[i].astype(np.uint16) << np.uint16(8) | octets[j]
        order = np.argsort(key, kind="stable")
        key, prints = key[order], np.stack([w[order] for w in words])
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[first, len(key)])
        hit = np.flatnonzero(np.repeat(sizes <= SHORT, sizes))
        for d in range(1, SHORT):
            hit = hit[hit + d < len(key)]
            hit = hit[key[hit] == key[hit + d]]
            if not len(hit):
                break
            near = hit[apart([w[hit] for w in prints], [w[hit + d] for w in prints]) <= wide]
            tallied = np.cumsum(_octets((prints[:, near] ^ prints[:, near + d]).T) == 0, 1)
            near = near[(tallied[:, j] == LEAST) & (tallied[:, -1] >= LEAST)]
            a.append(order[near])
            b.append(order[near + d])
        for k in np.flatnonzero(sizes > SHORT):
            own = order[first[k] : first[k] + sizes[k]]
            if (ids[own] == ids[own[0]]).all():
                continue
            one, other = long_list(prints[:, first[k] : first[k] + sizes[k]], wide)
            a.append(own[one])
            b.append(own[other])
    return np.concatenate(a), np.concatenate(b)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of n row numbers that each is connected to by pairs of these."""
    root = np.arange(n)
    while len(a):
        one, other = root[a], root[b]
        far = one != other
        a, b, one, other = a[far], b[far], one[far], other[far]
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while (root[root] != root).any():
            root = root[root]
    return root


def _stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Links (one, other) between ids, which may repeat, that span what the pairs of row numbers connect; an id is other once at most."""
    ids, row = np.unique(ids, return_inverse=True)
    root = _roots(len(ids), row[a], row[b])
    member = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"a": pa.array(ids[root[member]]), "b": pa.array(ids[member])})


def _postings(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["postings"].to_pylist()), np.uint64).reshape(-1, WORDS + 1)


def _gathered(wide: int):
    """Links of the candidates among the texts of a bucket, by every position; what is linked already is one label to later ones."""

    def run(table: pa.Table) -> pa.Table:
        rows = _postings(table).copy()
        ids, root = rows[:, WORDS].copy(), np.arange(len(rows))
        for i in range(BYTES - 1):
            one, other = posted_pairs(rows, i, range(i + 1, BYTES), wide)
            root = _roots(len(rows), np.r_[np.arange(len(rows)), one], np.r_[root, other])
            rows[:, WORDS] = ids[root]
        return _stars(ids.view(np.int64), np.arange(len(rows)), root)

    return run


def _meet(parts: int, wide: int):
    """Links of the candidates of a bucket of lists, or of those of one other position of a bucket posted again."""

    def run(table: pa.Table) -> pa.Table:
        i = table["bucket"][0].as_py() // parts % BYTES
        others = range(i + 1, BYTES)
        if "other" in table.column_names:
            others = [table["other"][0].as_py()]
        rows = _postings(table)
        return _stars(rows[:, WORDS].view(np.int64), *posted_pairs(rows, i, others, wide))

    return run


def _busy(posted: DataFrame, name: str) -> DataFrame:
    """The buckets of more than HOT postings, and how many these are."""
    return cut(posted.groupBy("bucket").agg((F.sum(F.octet_length("postings")) / (8 * WORDS + 8)).cast("long").alias("n")).where(F.col("n") > HOT), f"{name}-busy")


def _met(prints: DataFrame, name: str) -> DataFrame:
    """Components of the candidates by fingerprints prints(id, prints), ids distinct: node, root.

    Each text is in one list of the first place, so in one bucket of these. What the texts of such a bucket span, by all
    positions, names each of them once, by its label. All other lists hold labels and link these only: a group is not
    spanned anew in each list that it is in.
    """
    n = prints.count()
    parts = min(256, max(1, -(-n // BUCKET)))
    heads = max(HEADS, parts)
    posted = prints.mapInArrow(_post_prints(PLACES[:1], heads), "bucket long, postings binary")
    hot = _busy(posted, name) if n > HOT else None  # else no bucket has so many
    whole = hot is None or hot.isEmpty()
    first = (posted if whole else posted.join(hot, "bucket", "left_anti")).groupBy("bucket").applyInArrow(_gathered(WIDE), "a long, b long")
    first = cut(first, f"{name}-first")
    labels = prints.join(first.select(F.col("b").alias("id"), F.col("a").alias("label")), "id", "left")
    labels = cut(labels.select(F.coalesce("label", "id").alias("id"), "prints"), f"{name}-labels")
    posted = labels.mapInArrow(_post_prints(PLACES[1:] if whole else PLACES, parts), "bucket long, postings binary")
    busy = _busy(posted, name) if n > HOT else None
    some = busy is not None and not busy.isEmpty()
    found = (posted.join(busy, "bucket", "left_anti") if some else posted).groupBy("bucket").applyInArrow(_meet(parts, WIDE), "a long, b long")
    if some:
        again = posted.join(busy, "bucket").mapInArrow(_post_prints_again(parts), "bucket long, other long, part long, postings binary")
        found = found.unionByName(again.groupBy("bucket", "other", "part").applyInArrow(_meet(parts, WIDE), "a long, b long"))
    met = components(first.unionByName(found), f"{name}-met")
    for old in (hot, first, labels, busy):
        drop(old)
    return met


def _sieve(met: DataFrame, bits: int) -> np.ndarray:
    """Words whose bits are set at the ids of met(node), modulo bits (a power of two)."""
    at = met.select(F.col("node").bitwiseAND(F.lit(bits - 1).cast("long")).alias("at"))
    table = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("held")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[table["word"].to_numpy()] = table["held"].to_numpy().view(np.uint64)
    return words


def _sift(words):
    """Rows whose id may be in the broadcast words of a sieve: all that are, and a few more."""

    def run(batches):
        for batch in batches:
            held = words.value
            at = batch["id"].to_numpy().view(np.uint64) & np.uint64(len(held) * 64 - 1)
            yield batch.filter(pa.array((held[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)))

    return run


def _pack_sets(parts: int):
    """Rows (bucket, roots, ids, sizes, shingles) of a batch, gathered by bucket of the root."""

    def run(batches):
        for batch in batches:
            roots, ids, sets = batch["root"].to_numpy(), batch["id"].to_numpy(), batch["shingles"].to_pylist()
            part = (mix(roots.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            out = {"bucket": [], "roots": [], "ids": [], "sizes": [], "shingles": []}
            for p in np.unique(part):
                own = np.flatnonzero(part == p)
                out["bucket"].append(int(p))
                out["roots"].append(roots[own].tobytes())
                out["ids"].append(ids[own].tobytes())
                out["sizes"].append(np.array([len(sets[k]) // 8 for k in own], np.int64).tobytes())
                out["shingles"].append(b"".join([sets[k] for k in own]))
            yield as_batch({c: pa.array(v, pa.int64() if c == "bucket" else pa.binary()) for c, v in out.items()})

    return run


def similar(one: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Which of the sets (one after another in flat, as codes) are near copies of the set `one`; mark: all False."""
    mark[one] = True
    shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)
    mark[one] = False
    return SHARE[1] * shared >= SHARE[0] * (len(one) + sizes - shared)


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of distinct sets, not empty, under the exact similarity of every pair."""
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    mark, own = np.zeros(int(codes.max()) + 1, bool), [codes[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    out, rest = [], np.arange(len(sets))
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        front = np.array([seed])
        while len(front) and len(rest):
            few, many = (front, rest) if len(front) <= len(rest) else (rest, front)
            far, near = many, np.zeros(len(rest), bool)
            flat, n = np.concatenate([own[k] for k in far]), sizes[far]
            for at, k in enumerate(few):
                hit = similar(own[k], flat, np.cumsum(n) - n, n, mark)
                if few is rest:
                    near[at] = hit.any()
                elif hit.any():  # what is found needs no other look
                    near[np.searchsorted(rest, far[hit])] = True
                    flat, far, n = flat[np.repeat(~hit, n)], far[~hit], n[~hit]
                    if not len(far):
                        break
            front, rest = rest[near], rest[~near]
            out += [(int(seed), int(k)) for k in front]
    return out


def _verify(table: pa.Table) -> pa.Table:
    """Exact links within each group of candidates of a bucket."""
    whole = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
    roots, ids, sizes, flat = whole("roots", np.int64), whole("ids", np.int64), whole("sizes", np.int64), whole("shingles", np.uint64)
    ends = np.cumsum(sizes)
    order = np.lexsort((sizes, roots))
    bounds = np.flatnonzero(np.r_[True, roots[order][1:] != roots[order][:-1], True]) if len(roots) else np.zeros(1, np.int64)
    a, b = [], []
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        own = order[start:end]
        for i, j in linked([flat[ends[k] - sizes[k] : ends[k]] for k in own]):
            a.append(ids[own[i]])
            b.append(ids[own[j]])
    return pa.table({"a": pa.array(np.array(a, np.int64)), "b": pa.array(np.array(b, np.int64))})


def similar_texts(docs: DataFrame, shingle: int = 5, name: str = "similar") -> DataFrame:
    """doc_id, component_id of every row of docs(doc_id, text): components of texts of a similarity of 0.8 and more.

    Similarity: what the sets of shingles of two texts share, of their union. Texts at 0.8 lie some 19 of 128 bits apart,
    so no byte is guaranteed to match; a text therefore has PRINTS fingerprints. Each is posted in the lists of its
    positional bytes, the shared bytes of pairs are tallied, and pairs with LEAST are verified by the bit distance:
    these, and all that such pairs connect, are candidates. Within such a group the exact sets of all are compared, so
    nothing below 0.8 is linked, and of the pairs at 0.8 and above all are but the 2e-7 (at 0.8; fewer above) that meet
    in no fingerprint.
    A group of more than GROUP_BYTES is cut into blocks, and each pair of blocks is compared in a task of its own. component_id: the smallest doc_id reachable. Nulls, empty texts, repeats: as
    near_duplicates().
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = cut(rows.mapInArrow(_sets(shingle), "doc_id long, id long, prints binary, shingles binary"), "sets")
    prints = cut(rows.select("id", "prints").dropDuplicates(["id"]), f"{name}-prints")
    met = _met(prints, name)
    drop(prints)
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(met, SIEVE))
    candidates = rows.select("id", "shingles").mapInArrow(_sift(sieve), "id long, shingles binary").dropDuplicates(["id"]).join(met.withColumnRenamed("node", "id"), "id")
    # blocks of half the bytes of each group; a group of one block is a task's, else each row goes to every pair of its block
    sized = rows.select("id", F.octet_length("shingles").alias("n")).dropDuplicates(["id"]).join(met.withColumnRenamed("node", "id"), "id")
    sized = sized.groupBy("root").agg(F.sum("n").cast("long").alias("n")).withColumn("blocks", F.ceil(2 * F.col("n") / GROUP_BYTES))
    hot = cut(sized.where("blocks > 2").select("root", "blocks"), f"{name}-hot")
    if not hot.isEmpty():
        large = candidates.join(hot, "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        large = large.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other != block")
        large = large.select("id", "shingles", F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("root"))
        candidates = candidates.join(hot, "root", "left_anti").select("id", "shingles", "root").unionByName(large)
    volume = sized.agg(F.sum(F.col("n") * F.when(F.col("blocks") > 2, F.col("blocks")).otherwise(1))).first()[0] or 0
    parts = max(1, -(-met.count() // TOGETHER), -(-int(volume) // GROUP_BYTES))
    packed = candidates.mapInArrow(_pack_sets(parts), "bucket long, roots binary, ids binary, sizes binary, shingles binary")
    roots = components(packed.groupBy("bucket").applyInArrow(_verify, "a long, b long"), name)
    rooted = rows.select("doc_id", "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
    rooted = cut(rooted.select("doc_id", F.coalesce("root", "id").alias("root")), "rooted")
    for old in (rows, met, roots, hot):
        drop(old)
    smallest = cut(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    return rooted.join(smallest, "root").select("doc_id", "component_id")
