import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from carrierlens.llm import simhash, substring
from carrierlens.llm.common import components


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp string, places string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_fingerprint(text, size=4):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_components(texts):
    fps = np.array([brute_fingerprint(t) for t in texts], np.uint64)
    linked = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4)]
    return [f"{int(f):016x}" for f in fps], roots(len(texts), linked)


def near_copies(seed, n):
    rng = random.Random(seed)
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 30)) for _ in range(300)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "changed" + str(rng.randint(0, 9))
        out.append(" ".join(w))
    return out


def test_near_duplicates_are_those_of_brute_force(spark):
    texts = [*near_copies(1, 60), *near_copies(2, 20), "", None, " \t\n", "one", "One", "two words", "é É", *(["copy of this text here"] * 5), *[f"own text number {k} of the lot" for k in range(40)]]
    rows = sorted(simhash.near_duplicates(docs(spark, texts)).collect(), key=lambda r: r.doc_id)
    fps, comp = brute_components(texts)
    assert [r.fingerprint for r in rows] == fps and [r.component_id for r in rows] == comp


def test_hot_buckets_are_posted_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 20)
    monkeypatch.setattr(simhash, "BUCKET", 60)
    test_near_duplicates_are_those_of_brute_force(spark)


def test_short_lists_tell_a_pair_once():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**64, 200, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, fps ^ np.uint64(1), fps ^ np.uint64(1 << 9 | 1 << 30)]))
    told = [pair for mask in simhash._masks(4) for pair in zip(*(x.tolist() for x in simhash.links(fps, mask, 4)), strict=True)]
    want = {(int(fps[i]), int(fps[j])) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4) if j > i}
    assert len(told) == len(want) and {tuple(sorted(p)) for p in told} == want
    x = np.array([0, 0xFF, 0x0100FF00000000FF], np.uint64)
    assert simhash.tally(x).tolist() == [8, 7, 5] and simhash.first_list(x, 4).tolist() == [0xFFFFFFFF, 0xFFFFFFFF00, 0xFFFFFFFF00]


def test_halves_meet_all_links():
    rng, mask = np.random.default_rng(3), 0xFF00FF00FF00FF
    base = rng.integers(0, 2**64, dtype=np.uint64)
    free = [k for k in range(64) if not mask >> k & 1]
    fps = np.unique(np.array([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(free, rng.integers(0, 7), replace=False))) for _ in range(400)], np.uint64))
    linked = [p for m in simhash._halves(mask, 4) for p in zip(*(x.tolist() for x in simhash.links(fps, np.uint64(m), 4, whole=False)), strict=True)]
    at = {int(f): k for k, f in enumerate(fps)}
    pairs = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4)]
    assert len(simhash._halves(mask, 4)) == 70 and roots(len(fps), [(at[a], at[b]) for a, b in linked]) == roots(len(fps), pairs)


def test_near_duplicates_of_documents(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(simhash.near_duplicates(table).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in table.collect()}
    ids = sorted(texts)
    fps, comp = brute_components([texts[i] for i in ids])
    assert [(r.doc_id, r.fingerprint, r.component_id) for r in rows] == [(i, f, ids[c]) for i, f, c in zip(ids, fps, comp, strict=True)]


def test_odd_ids(spark):
    rows = simhash.near_duplicates(docs(spark, ["same text", "same text", "same text", "alone"], [7, None, 7, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (-1, 7), (7, 7), (7, 7)]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_links_span_what_all_pairs_span():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 3, dtype=np.uint64)
    flips = lambda k: np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64))
    fps = np.unique(np.array([c ^ flips(rng.integers(1, 6)) for c in centre for _ in range(300)], np.uint64))
    linked = []
    for k, mask in enumerate(simhash._masks(4)):
        a, b = simhash.links(fps, mask, 4)
        assert (np.bitwise_count(a ^ b) <= 64).all() and len(a) < 8 * len(fps), k
        linked += zip(a.tolist(), b.tolist(), strict=True)
    at = {int(f): k for k, f in enumerate(fps)}
    pairs = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4)]
    assert roots(len(fps), [(at[a], at[b]) for a, b in linked]) == roots(len(fps), pairs)


def test_similar_texts(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(400)]
    copies = [base, base[:10] + ["new"] + base[10:], [*base[:200], "other", *base[201:]], base[:-8]]
    texts = [*(" ".join(c) for c in copies), *(" ".join(f"v{rng.randint(0, 9999)}" for _ in range(300)) for _ in range(50)), "", None, "", "short"]
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs(spark, texts)).collect()}
    assert [got[k] for k in range(4)] == [0] * 4 and all(got[k] == k for k in range(4, 54)) and got[54] == got[55] == got[56] == 54 and got[57] == 57
    assert simhash.similar_texts(docs(spark, [])).count() == 0


def test_large_groups_are_compared_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_BYTES", 30_000)
    test_similar_texts_are_those_of_brute_force(spark)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + k, 501 + k) for k in range(40)]
    want = roots(600, pairs)
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {n: want[n] for n in {x for p in pairs for x in p if p[0] != p[1]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removal(rows, window=13):
    first = {}
    big = float("inf")
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, big), big if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (big if i is None else i):
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def held(spark, rows):
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    got = substring.remove_repeats(df).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute_removal(rows)
    for r in got:
        w = words(r.text)
        gone = {k for a, b in r.spans for k in range(a, b)}
        assert r.kept == " ".join(x for k, x in enumerate(w) if k not in gone) and r.fp == "x" and len(gone) == r.n_removed
    return got


def test_repeated_passages_go(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["é", "a", "bb", "ccc", "x y", "​z", "dddd"]) + str(rng.randint(0, 50))
    passages = [" ".join(word() for _ in range(rng.choice([12, 13, 14, 60]))) for _ in range(12)]
    rows = []
    for i in rng.sample(range(1000), 150):
        parts = [rng.choice([" ".join(word() for _ in range(rng.randint(0, 30))), rng.choice(passages)]) for _ in range(rng.randint(0, 5))]
        rows.append((i, rng.choice([" ", "\n", "\t \r\n", "\x0b"]).join(parts)))
    rows += [(2000, None), (2001, ""), (2002, "w " * 400), (2003, "w " * 500), (2004, "w " * 13), (None, passages[3] + " more"), (None, passages[3]), (5000, rows[0][1]), (5000, rows[1][1]), (5000, rows[1][1])]
    got = held(spark, rows)
    assert sum(r.n_removed > 0 for r in got) > 50


def test_documents_of_the_table(spark, sf_dir):
    held(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_few_rows(spark):
    assert substring.remove_repeats(docs(spark, [])).count() == 0
    held(spark, [(1, "few words only")])


def test_long_texts_are_hashed_in_parts():
    raw = b" ".join(b"w%d" % (k % 977) for k in range(200_000))
    whole = substring.Words()._part(raw.split())
    assert (substring.Words().hashes(raw) == whole).all() and len(whole) == 200_000
    assert len(substring.Words().hashes(b"x" * 1_500_000 + b" y")) == 2 and len(substring.Words().hashes(b"")) == 0


def test_forgotten_words_keep_their_numbers(monkeypatch):
    raw = b" ".join(b"w%d" % (k % 977) for k in range(5_000))
    want = substring.Words().hashes(raw)
    monkeypatch.setattr(substring, "WORDS", 100)
    monkeypatch.setattr(substring, "_PART", 1000)
    known = substring.Words()
    assert (known.hashes(raw) == want).all() and (known.hashes(raw) == want).all() and len(known.known) < 400


@pytest.mark.parametrize("window", [1, 2, 13, 40])
def test_window_hashes_are_polynomials_modulo_the_prime(window):
    prime, rng = 2**61 - 1, np.random.default_rng(0)
    numbers = np.r_[rng.integers(0, prime, 200, dtype=np.uint64), np.full(50, prime - 1, np.uint64), np.zeros(50, np.uint64)]
    for base in substring.BASES:
        got = substring.window_hashes(numbers, window, base).tolist()
        w = numbers.tolist()
        assert got == [sum(w[i + k] * pow(base, window - 1 - k, prime) for k in range(window)) % prime for i in range(len(w) - window + 1)]
    assert len(substring.window_hashes(numbers[:3], 4, 5)) == 0


def test_words_that_differ_as_thue_and_morse_have_them_stay(spark):
    """Letters in the order of the Thue-Morse sequence and of its complement have equal polynomials modulo 2^64."""
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    start = " ".join(f"w{k}" for k in range(12))
    got = held(spark, [(1, f"{start} {one}"), (2, f"{start} {other}"), (3, f"{start} {one}")])
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 13}


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def test_similar_texts_are_those_of_brute_force(spark):
    """Pairs on either side of 0.8, chains and a large group: the links are those of the exact shingle similarity."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 99_999)}"
    texts = []
    for k in range(150):
        base = [word() for _ in range(rng.choice([30, 120, 404]))]
        other = list(base)
        for at in rng.sample(range(len(base)), max(1, round(len(base) * rng.uniform(0.015, 0.032)))):
            other[at] = word()
        texts += [" ".join(base), " ".join(other).upper() if k % 7 == 0 else " ".join(other)]
    texts += [*near_copies(3, 80), "", None, "few words", "few words"]
    w = [words((t or "").lower()) for t in texts]
    sets = [frozenset(" ".join(x[i : i + 5]) for i in range(max(1, len(x) - 4))) if x else frozenset() for x in w]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or jaccard(sets[i], sets[j]) >= 0.8]
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs(spark, texts)).collect()}
    near = [jaccard(sets[2 * k], sets[2 * k + 1]) for k in range(150)]
    assert sum(0.8 <= s < 0.85 for s in near) > 15 and sum(0.7 < s < 0.8 for s in near) > 15
    assert [got[k] for k in range(len(texts))] == roots(len(texts), linked)


def test_similar_texts_meet_in_fingerprints(spark, monkeypatch):
    """Where no fingerprint is near enough, nothing is compared: there is no other way to a link."""
    texts = near_copies(3, 40)
    comp = lambda: {r.component_id for r in simhash.similar_texts(docs(spark, texts)).collect()}
    assert len(comp()) < len(set(texts))
    monkeypatch.setattr(simhash, "WIDE", -1)
    assert len(comp()) == len(set(texts))


def test_wide_fingerprints_are_majorities():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 4, 255, 256, 3, 20_000, 700)]
    for start in (0, simhash.PRINTS):
        got = simhash.sketches(sets, start)
        for own, row in zip(sets, got, strict=True):
            streams = simhash._STREAMS[start * simhash.WORDS :][: simhash.PRINTS * simhash.WORDS]
            assert row.tolist() == [simhash.majority(simhash.mix(own + x)) for x in streams]
    assert simhash.sketches([]).shape == (0, simhash.PRINTS * simhash.WORDS)


def test_pairs_are_told_by_the_tally_of_their_bytes(monkeypatch):
    """Posted pairs are all that share two positional bytes within the distance, once; long lists span the same."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, (60, 2), dtype=np.uint64)
    flips = np.packbits(rng.random((240, 128)) < 0.12, axis=1).view(np.uint64)
    prints = np.concatenate([base, np.repeat(base, 4, axis=0) ^ flips])
    rows = np.column_stack([prints, np.arange(len(prints), dtype=np.uint64)])
    differ = prints[:, None] ^ prints[None]
    near = (np.bitwise_count(differ).sum(2) <= simhash.WIDE) & ((differ.view(np.uint8) == 0).sum(2) >= simhash.LEAST)
    want = [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True) if a < b]

    def told():
        out = []
        for i in range(simhash.BYTES - 1):
            lists = [rows[rows[:, :2].copy().view(np.uint8)[:, i] == v] for v in range(256)]
            for some in [x for x in lists if len(x)]:
                out += [tuple(sorted(int(some[k, 2]) for k in p)) for p in zip(*simhash.posted_pairs(some, i, range(i + 1, simhash.BYTES), simhash.WIDE), strict=True)]
        return out

    assert len(want) > 150 and sorted(told()) == want
    for dense in (0, 8):
        monkeypatch.setattr(simhash, "SHORT", 1)
        monkeypatch.setattr(simhash, "DENSE", dense)
        assert set(told()) >= set(want) if dense else roots(len(rows), told()) == roots(len(rows), want)


def test_a_group_is_not_spanned_in_each_list(spark, monkeypatch):
    """A group's links to its candidates are some a text, not one for each of the 90 lists that a text is in."""
    told = {}

    def counted(edges, name):
        told[name] = edges.count()
        return components(edges, name)

    monkeypatch.setattr(simhash, "components", counted)
    for n in (200, 800):
        texts = near_copies(3, n)
        got = simhash.similar_texts(docs(spark, texts)).collect()
        assert {r.component_id for r in got} == {0} and len(got) == n
        assert len(set(texts)) - 1 <= told["similar-met"] < 20 * n


def test_labels_that_repeat_are_linked_once():
    ids = np.array([7, -3, 7, 5, 5, 9], np.int64)
    got = simhash._stars(ids, np.array([0, 1, 3, 2]), np.array([2, 2, 4, 1])).to_pydict()
    assert got == {"a": [-3], "b": [7]}
    assert simhash._stars(ids, np.array([0, 3, 1]), np.array([3, 5, 4])).to_pydict() == {"a": [-3, -3, -3], "b": [5, 7, 9]}


def test_busy_lists_are_posted_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 60)
    monkeypatch.setattr(simhash, "HOT", 20)
    test_similar_texts_are_those_of_brute_force(spark)


def test_short_texts_at_the_limit_are_linked(spark):
    """Four shingles of five, where a bit differs most often: each text and the same with a word more."""
    rng = random.Random(6)
    own = [" ".join(f"w{rng.randint(0, 99_999)}" for _ in range(8)) for _ in range(2000)]
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs(spark, [*own, *(f"{t} more" for t in own)])).collect()}
    assert all(got[k] == got[k + 2000] == k for k in range(2000))


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_a_full_sieve_loses_no_candidate(spark, monkeypatch, bits):
    monkeypatch.setattr(simhash, "SIEVE", bits)
    ids = [-1, -(2**63), 2**63 - 1, 0, 63, 64, *(int(x) for x in np.random.default_rng(7).integers(-(2**63), 2**63, 300))]
    words = simhash._sieve(spark.createDataFrame([(i,) for i in ids], "node long"), bits)
    at = {i % bits for i in ids}
    assert {k for k in range(bits) if int(words[k >> 6]) >> (k & 63) & 1} == at
    test_similar_texts(spark)
