import re

import corpus_pipeline as pipeline
from carrierlens.llm import queries, toxicity
from carrierlens.llm.common import read
from test_duplicates import brute_removal, roots, words


def test_stages(spark, sf_dir):
    """Each stage against its rule, judged on its own input."""
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "substring_dedup", "pii_surrogates", "best_fit_packing"]
    docs = read(spark, sf_dir, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    kept = pipeline.cut(pipeline.drop_toxic(spark, docs, sf_dir), "t1")
    scores = {r.doc_id: r.predicted for r in toxicity.classify(docs, read(spark, sf_dir, "labels")).collect()}
    after = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == columns and set(after) == {d for d, p in scores.items() if not p}

    near = pipeline.cut(pipeline.drop_near_copies(spark, kept, sf_dir), "t2")
    ids = sorted(after)
    own = [words("".join(c.lower() if "A" <= c <= "Z" else c for c in after[d].text)) for d in ids]
    sets = [frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in own]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])]
    comp = roots(len(ids), linked)
    left = {r.doc_id: r for r in near.collect()}
    assert near.columns == columns and set(left) == {ids[c] for c in comp}

    passages = pipeline.cut(pipeline.remove_repeated_passages(spark, near, sf_dir), "t3")
    gone = {d: n for d, _, n, _ in brute_removal([(d, r.text) for d, r in left.items()])}
    now = {r.doc_id: r for r in passages.collect()}
    assert passages.columns == columns and set(now) == set(left)
    for d, r in now.items():
        assert r.n_chars == len(r.text) and (r.text == left[d].text if not gone[d] else len(r.text.split()) == len(left[d].text.split()) - gone[d])

    private = pipeline.cut(pipeline.replace_personal_data(spark, passages, sf_dir), "t4")
    find = lambda t: set(re.findall(r"\w+\.\d\d@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b[0-9a-f]{40}\b", t))
    real = {x for r in now.values() for x in find(r.text)}
    assert private.columns == columns and private.count() == len(now) and not any(find(r.text) & real for r in private.collect())

    packed = pipeline.pack_sequences(spark, private, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(now)
    whole = pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 11))
    assert pipeline.ORACLE_SQL is None and set(queries.ORACLE) <= set(queries.QUERIES)
