import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from carrierlens.llm import packing, sharding

ODD = ["", None, "a", "word " * 3000, "<|endoftext|> x<|endoftext|>", "  two  spaces\n\n\ttab", "日本語 text é", "don't we'll", "12345 67", "​x", "a" * 5000, "🙂🙂"]


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame(list(zip(ids, texts, ["x"] * len(texts), strict=True)), "doc_id long, text string, length string")


def test_ids_are_those_of_the_tokenizer_file(sf_dir):
    import pyarrow.parquet as pq

    path = public_tokenizers.path(packing.TOKENIZER)
    theirs = Tokenizer.from_file(path)
    for t in [*ODD, *pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()]:
        assert packing.encode(t, path).tolist() == [*theirs.encode(t or "", add_special_tokens=False).ids, packing.END_ID]


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + " " * 700_000 + "b\n" + "\n" * 300_000, "x" * 300_000, "\t \n" * 200_000, "é" * 100_000])
def test_long_runs_have_the_ids_of_the_tokenizer_file(text):
    path = public_tokenizers.path(packing.TOKENIZER)
    assert packing.encode(text, path).tolist()[:-1] == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def fewest(items, capacity):
    """The least number of bins, by trying every placement."""
    best, items = len(items), sorted(items, reverse=True)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for j, room in enumerate(rooms):
            if room >= items[k] and room not in rooms[:j]:
                place(k + 1, [*rooms[:j], room - items[k], *rooms[j + 1 :]])
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best


def test_plan_beside_the_best_of_all_placements():
    rng, extra = random.Random(4), 0
    for _ in range(300):
        capacity = rng.choice([10, 24, 60])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        used = max(first + n for _, _, n, first, _ in packing.plan(dict(Counter(items)), capacity))
        assert fewest(items, capacity) <= used <= fewest(items, capacity) + 1
        extra += used - fewest(items, capacity)
    assert extra <= 15


def check_packed(rows, texts, capacity=packing.CAPACITY):
    path = public_tokenizers.path(packing.TOKENIZER)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, t in texts.items():
        ids = packing.encode(t, path)
        parts = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
        at = 0
        for k, r in enumerate(parts):
            assert r.start == at and r.length <= capacity and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert len(parts) == max(1, -(-len(ids) // capacity))
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_packing_of_odd_texts(spark):
    rows = packing.pack(docs(spark, ODD)).collect()
    check_packed(rows, dict(enumerate(ODD)))


def test_packing_of_documents(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(table).collect()
    n = check_packed(rows, {r.doc_id: r.text for r in table.collect()})
    assert n <= 1.02 * sum(r.length for r in rows) / packing.CAPACITY + 1


def test_packing_keeps_ids_nulls_and_repeats(spark):
    rows = packing.pack(docs(spark, ["same", "same", None], [None, None, 5]), with_ids=True).collect()
    assert Counter(r.doc_id for r in rows) == {None: 2, 5: 1} and all(len(r.ids) == r.length for r in rows)
    assert packing.pack(docs(spark, [])).count() == 0


@pytest.mark.parametrize("capacity", [10, 30, 1024])
def test_plan_places_every_item_once(capacity):
    rng = random.Random(capacity)
    for n in (0, 1, 7, 4000):
        items = Counter(rng.randint(1, capacity) for _ in range(n))
        seqs, placed = {}, Counter()
        for size, rank, k, first, offset in packing.plan(dict(items), capacity):
            assert rank == placed[size]
            placed[size] += k
            for i in range(k):
                seqs.setdefault(first + i, []).append((offset, size))
        assert placed == items
        for parts in seqs.values():
            at = 0
            for o, s in sorted(parts):
                assert o == at
                at += s
            assert at <= capacity and sum(3 * s > capacity for _, s in parts) <= 2
        assert len(seqs) <= 1.1 * sum(s * k for s, k in items.items()) / capacity + 1


def shards(rows, n=8):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(n))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    return {s: sum(r.size for r in part) for s, part in by.items()}


def test_shards_of_documents(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sharding.shard_by_bytes(table).collect()
    texts = {r.doc_id: r.text for r in table.collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items()}
    sizes, largest = shards(rows), max(r.size for r in rows)
    mean = sum(sizes.values()) / 8
    assert all(abs(v - mean) <= largest for v in sizes.values()) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_a_hot_text_is_split(spark):
    texts = ["hot copy"] * 4000 + [f"text {k}" * (k % 5) for k in range(4000)]
    rows = sharding.shard_by_bytes(docs(spark, texts)).collect()
    sizes = shards(rows)
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(abs(v - mean) for v in sizes.values()) <= 0.01 * mean
    small = {}
    for r in rows:
        if r.doc_id >= 4000:
            small.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for c, s in small.items()) <= 8


def test_odd_rows_are_sharded(spark):
    rows = sharding.shard_by_bytes(docs(spark, [None, "", "é", "é", "x" * 100_000], [None, 1, 2, 2, 3])).collect()
    assert len(rows) == 5 and sorted(r.size for r in rows) == [1, 1, 3, 3, 100_001] and shards(rows)
    assert sharding.shard_by_bytes(docs(spark, [])).count() == 0


@pytest.mark.parametrize("ids", [[None] * 800, [7] * 800, [7] * 800 + list(range(1000, 1100))])
def test_rows_that_repeat_are_shared_out(spark, ids):
    rows = sharding.shard_by_bytes(docs(spark, ["same text"] * 800 + [f"other {k}" for k in range(len(ids) - 800)], ids)).collect()
    sizes = shards(rows)
    mean = sum(sizes.values()) / 8
    assert len(rows) == len(ids) and len(sizes) == 8 and max(abs(v - mean) for v in sizes.values()) <= 0.02 * mean + 20


def test_splitters_are_those_of_sorted_rows(spark):
    """Beside bytes summed over sorted rows: each splitter is within the tolerance, or at the nearest edge there is."""
    rng = random.Random(6)
    texts = [f"t{rng.randint(0, 400)} " * rng.randint(1, 40) for _ in range(3000)]
    rows = sharding.cut(sharding.keyed(docs(spark, texts)), "t")
    every = sorted((r.k1, r.k2, r.k3, r.size) for r in rows.collect())
    total = sum(r[3] for r in every)
    found = sharding.splitters(rows, 64, 8)
    assert found == sorted(found) and len(found) == 63
    for k, splitter in enumerate(found, 1):
        want, below = total * k / 64, sum(r[3] for r in every if r[:3] < splitter)
        edges, at = [0], 0
        for r in every:
            at += r[3]
            edges.append(at)
        nearest = min(abs(e - want) for e in edges)
        assert abs(below - want) <= max(nearest, sharding.GROUP_TOLERANCE * total / 8) + 1e-6
    counted = Counter(r.p for r in rows.select(sharding.part_of(found).alias("p")).collect())
    assert counted == Counter(sum(s <= r[:3] for s in found) for r in every)


def test_order_of_signed_keys():
    assert sharding._bound(10, 0) == -(2**63) and sharding._bound(10, 1 << 10) is None and sharding._bound(64, 2**63) == 0
    most, least = 2**63 - 1, -(2**63)
    assert sharding._splitter((5, most), None) == (6, least, least) and sharding._splitter((most, most), None) == (most,) * 3


def test_no_python_in_the_plan(spark, sf_dir):
    out = sharding.shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
