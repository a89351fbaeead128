"""op1 against brute force, and the edge cases of its docstring."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventide.llm import queries, simhash


def brute(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """{id: smallest id reachable} over {id: fingerprint}."""
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n:]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_masks_cover_the_radius():
    masks = simhash.masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "One TWO three", "a b c d", "É é x É\x0by", "x " * 5000])
def test_fingerprint_is_the_brute_one(text):
    assert simhash.simhash64(None if text is None else text.encode()) % 2**64 == brute(text)


def test_spark_xxhash_agrees(spark):
    words = ["", "a", "Ünï", "the cat sat"]
    got = [r[0] % 2**64 for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    assert got == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]


def test_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: brute(t) for i, t in docs.items()}
    want = components(fps)
    got = queries.op1_simhash_near_dedup(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in docs}
    assert len(got) == len(docs)


def test_links_of_planted_fingerprints(spark):
    random.seed(1)
    base = [random.getrandbits(64) for _ in range(40)]
    fps = list(base)
    for f in base[:20]:
        for _ in range(4):  # chains of near ones
            f ^= (1 << random.randrange(64)) ^ (1 << random.randrange(64))
            fps.append(f)
        fps.append(f ^ 0b111 << 20)  # three bits off: no link
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    classes = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, node long")
    from eventide.llm.common import connected_components

    found = {r.node: r.component for r in connected_components(simhash.linked_fingerprints(classes)).collect()}
    want = components(dict(enumerate(fps)))
    assert {i: found.get(i, i) for i in range(len(fps))} == want


def test_edge_rows(spark):
    rows = [(5, "a b c d e"), (3, "A B c d E"), (None, "a b c d e"), (9, None), (8, ""), (7, "other words in here"), (7, "other words in here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (9, 8), (8, 8), (7, 7), (7, 7)], key=str)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_representatives(docs.limit(0)).count() == 0


def test_a_hot_group(spark):
    texts = [(i, "the same words again and again" if i % 3 else f"only here {i} {i * 7} {i * 13} words") for i in range(300)]
    got = simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).where("doc_id % 3 != 0")
    assert {r.component_id for r in got.collect()} == {1}
    assert np.isclose(got.count(), 200)
