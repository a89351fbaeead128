"""The pipeline's near-duplicates against brute-force Jaccard similarity of five-word shingles."""

import itertools
import random

import corpus_pipeline
import numpy as np
from eventide.llm import buckets, minhash, simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def components(texts, least=0.8):
    """{id: smallest id reachable} over {id: text}."""
    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x == y or (len(x & y) >= least * len(x | y) - 1e-9 and x and y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in texts}


def edited(words, n, draw):
    out = list(words)
    for at in draw.sample(range(len(out)), n):
        out[at] = f"new{draw.random()}"
    return " ".join(out)


def test_stage_links_five_word_shingles_at_0_8(spark):
    """One word in 100 changed leaves 91 of 101 shingles but moves SimHash by more than two bits."""
    draw = random.Random(3)
    texts = {}
    for i in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(100)]
        texts[4 * i], texts[4 * i + 1] = " ".join(words), edited(words, 1, draw)
        texts[4 * i + 2], texts[4 * i + 3] = edited(words, 8, draw), f"Only here {i}"
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    want = components(texts)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert found == want
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(want.values()) and not kept & {4 * i + 1 for i in range(60)}
    assert kept < {r.doc_id for r in simhash.keep_representatives(docs).collect()}


def test_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == components({r.doc_id: r.text for r in docs.collect()})
    assert len(got) == docs.count()


def test_a_large_group_of_near_copies(spark):
    """Copies that differ from their base alone link through it; blocks find every component of a crowded bucket."""
    draw = random.Random(4)
    base = [f"w{draw.randrange(5000)}" for _ in range(120)]
    texts = {i: edited(base, draw.choice([0, 1, 2, 3, 4]), draw) for i in range(1, 300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == components(texts)


def test_blocks_compare_all_pairs_that_no_link_joins(spark):
    """One bucket of 40 sets in blocks of 4: a chain of near neighbours and sets that link with nothing."""
    sets = [np.arange(k, k + 20, dtype=np.uint64) for k in range(20)] + [np.arange(1000 * k, 1000 * k + 5, dtype=np.uint64) for k in range(1, 21)]
    members = spark.createDataFrame([(0, 7, k, len(s)) for k, s in enumerate(sets)], "band int, key long, node long, weight long")
    held = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "node long, shingles binary")
    for block in (4, 256):
        assert {r.node: r.component for r in buckets.linked(members, held, minhash.similar(0.9), block, 10**6).collect()} == {k: 0 for k in range(20)}


def test_overlaps_are_those_of_sets():
    draw = random.Random(6)
    sets = [np.array(sorted(draw.sample(range(300), draw.randrange(1, 120))), np.uint64) for _ in range(40)]
    want = [[len(set(a) & set(b)) for b in sets] for a in sets]
    assert (minhash.overlaps(sets) + np.diag([0] * 40))[~np.eye(40, dtype=bool)].tolist() == np.array(want)[~np.eye(40, dtype=bool)].tolist()


def test_edge_rows(spark):
    rows = [(5, "a b c d e"), (3, "A B c d E"), (None, "a b c d e"), (9, None), (8, ""), (7, "other words in here"), (7, "other words in here"), (7, "again the id but another text"), (None, "nobody")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (9, 8), (8, 8), (7, 7), (7, 7), (7, 7), (None, None)], key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
