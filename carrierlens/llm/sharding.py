"""Sharding to near equal bytes by histogram sort. DataFrame and SQL functions only.

Rows are ordered by the hash of their text, then by that of their id, then by that of a row number, so equal texts lie
together and no group of them, nor of equal rows, is a key of its own. Splitters are found by counting: each round counts
the exact bytes below a grid of candidate boundaries inside the cells that still hold a target, then narrows every
target to one cell of the grid. A target is settled when its cell is within the tolerance, a single row, or a group of
equal texts whose edge is near enough; larger groups are split by the next key. The splitters cut each shard into PIECES
of near equal bytes, and the rows are exchanged once, by piece: where a row goes is what has been counted, nothing is
sampled. Counts of a round (a grid for each target at most) are all that reaches the driver, at any corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carrierlens.llm.common import cut, drop

SHARDS, PIECES = 8, 8
#: Shares of a shard's bytes: a splitter may be this far off; it may be this far off to keep equal texts together.
TOLERANCE, GROUP_TOLERANCE = 0.0005, 0.005
BITS = 10  # a round tells 2^BITS cells of an interval apart
KEYS = ("k1", "k2", "k3")
_MIN, _MAX = -(2**63), 2**63 - 1


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and one), text_crc32 and the ordering hashes of docs(doc_id, text).

    The last hash is of a row number: the table is to be written before it is read twice.
    """
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("k1"), F.xxhash64("doc_id").alias("k2"), F.xxhash64(F.monotonically_increasing_id()).alias("k3"))


def _flipped(key: Column) -> Column:
    """A signed key as an unsigned one of the same order."""
    return key.bitwiseXOR(F.lit(_MIN))


def _upper(key: Column, bits: int) -> Column:
    """The first bits (less than 64) of a key, as a number from 0."""
    return F.shiftrightunsigned(_flipped(key), 64 - bits) if bits else F.lit(0).cast("long")


def _next(key: Column, bits: int, step: int) -> Column:
    """The `step` bits of a key that follow its first `bits`."""
    return F.shiftrightunsigned(F.shiftleft(_flipped(key), bits), 64 - step)


class _Target:
    """A number of bytes that should lie below a splitter, and the cell that holds it: first bits of a key, the keys before it fixed."""

    def __init__(self, want: float):
        self.want, self.below, self.bits, self.prefix, self.fixed, self.splitter = want, 0, 0, 0, (), None

    def where(self):
        return self.fixed, self.bits


def _splitter(fixed: tuple[int, ...], edge: int | None) -> tuple[int, int, int]:
    """The least keys from `edge` on under the fixed ones; with edge None, those after all of them."""
    while edge is None:
        if not fixed:
            return (_MAX,) * 3
        *fixed, last = fixed
        edge = last + 1 if last < _MAX else None
    return (*fixed, edge, *[_MIN] * (2 - len(fixed)))


def _bound(bits: int, prefix: int) -> int | None:
    """The smallest signed key whose first bits are at least prefix; None if it is past the last key."""
    v = (prefix << (64 - bits)) + _MIN
    return v if v <= _MAX else None


def _counted(rows: DataFrame, open_: list[_Target]) -> dict:
    """For each open cell, by (fixed, bits, prefix): the bytes, rows, least and largest key of each next cell in it."""
    places = sorted({t.where() for t in open_})
    place = prefix = cell = value = None
    for n, (fixed, bits) in enumerate(places):
        key = F.col(KEYS[len(fixed)])
        wanted = sorted({t.prefix for t in open_ if t.where() == (fixed, bits)})
        ours = _upper(key, bits).isin(wanted)
        for k, v in zip(KEYS, fixed):
            ours = ours & (F.col(k) == F.lit(v))
        step = min(BITS, 64 - bits)
        add = lambda so_far, v: F.when(ours, v) if so_far is None else so_far.when(ours, v)  # noqa: B023, E731
        place, prefix, cell, value = add(place, F.lit(n)), add(prefix, _upper(key, bits)), add(cell, _next(key, bits, step)), add(value, key)
    counted = rows.select(place.alias("place"), prefix.alias("prefix"), cell.alias("cell"), value.alias("value"), "size").where("place is not null")
    counted = counted.groupBy("place", "prefix", "cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("value").alias("first"), F.max("value").alias("last"))
    found: dict = {}
    for r in counted.collect():
        found.setdefault((*places[r["place"]], r["prefix"]), []).append((r["cell"], r["bytes"], r["n"], r["first"], r["last"]))
    return {k: sorted(v) for k, v in found.items()}


def splitters(rows: DataFrame, parts: int, per_shard: int = 1) -> list[tuple[int, int, int]]:
    """The keys from which the parts after the first begin, for rows(size, k1, k2, k3); tolerances are of a shard's bytes."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = total / parts * per_shard
    targets = [_Target(total / parts * k) for k in range(1, parts)]
    while open_ := [t for t in targets if t.splitter is None]:
        found = _counted(rows, open_)
        for t in open_:
            step, below, up_to = min(BITS, 64 - t.bits), t.below, t.below
            inner = found.get((t.fixed, t.bits, t.prefix), [])
            if not inner:  # no rows at all
                t.splitter = _splitter((), None)
                continue
            for cell, size, n, first, last in inner:
                below, up_to = up_to, up_to + size
                if up_to >= t.want:
                    break
            bits, prefix = t.bits + step, (t.prefix << step) + cell
            near = min(t.want - below, below + size - t.want)
            one = first == last
            if near <= TOLERANCE * share or n == 1 or (one and not t.fixed and near <= GROUP_TOLERANCE * share) or (one and len(t.fixed) == 2):
                t.splitter = _splitter(t.fixed, _bound(bits, prefix + (below + size - t.want < t.want - below)))
            elif one:
                t.fixed, t.bits, t.prefix, t.below = (*t.fixed, first), 0, 0, below  # a large group: go on inside it
            else:
                t.bits, t.prefix, t.below = bits, prefix, below
    return sorted(t.splitter for t in targets)


def part_of(found: list[tuple[int, int, int]]) -> Column:
    """How many splitters are not above a row's keys, by bisection."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        a, b, c = (F.lit(v) for v in found[mid])
        reached = (F.col("k1") > a) | ((F.col("k1") == a) & ((F.col("k2") > b) | ((F.col("k2") == b) & (F.col("k3") >= c))))
        return F.when(reached, among(mid + 1, high)).otherwise(among(low, mid))

    return among(0, len(found))


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) of every row of docs(doc_id, text).

    Null text: of size 1, as empty. Null doc_id: placed like others. Rows that repeat id and text: next to each other,
    and in several shards only if they are too many for one. Fewer rows than shards, no rows: some or all shards stay
    empty. Other columns are not read.
    """
    rows = cut(keyed(docs), "sizes")
    placed = rows.withColumn("piece", part_of(splitters(rows, shards * PIECES, PIECES)))
    counts = {r["piece"]: r["n"] for r in placed.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a piece
    before, bases = 0, []
    for piece in range(shards * PIECES):
        before = before if piece % PIECES else 0
        bases.append(before)
        before += counts.get(piece, 0)
    within = F.row_number().over(Window.partitionBy("piece").orderBy(*KEYS)).cast("long") - 1
    slot = F.element_at(F.array(*[F.lit(b).cast("long") for b in bases]), F.col("piece") + 1) + within
    placed = cut(placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.floor(F.col("piece") / PIECES).cast("int").alias("shard"), slot.alias("slot")), "shards")
    drop(rows)
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))
