"""op3 against brute force."""

import numpy as np
from pyspark.sql import functions as F

from eventide.llm import cross_polytope, queries


def brute(ids, vectors, labels, threshold=0.98):
    n = len(ids)
    links, parent = [0] * n, list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) if g else None for v, g in zip(vectors, good, strict=True)]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and labels[i] is not None and labels[i] == labels[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return {ids[i]: (links[i], ids[find(i)]) for i in range(n)}


def planted(n, dim=64, seed=3):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(n)]
    for k in range(n // 4):
        base = rows[int(rng.integers(0, n))]
        noise = rng.normal(size=dim)
        rows.append(base + noise / np.linalg.norm(noise) * np.linalg.norm(base) * rng.uniform(0.0, 0.24))
    return [r.astype(np.float32).tolist() for r in rows]


def check(spark, vectors, labels, least=1.0):
    ids = list(range(10, 10 + len(vectors)))
    table = spark.createDataFrame(list(zip(ids, vectors, labels, strict=True)), "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in cross_polytope.near_duplicates(table).collect()}
    want = brute(ids, vectors, labels)
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in ids)
    found, there = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert found >= least * there
    if found == there:
        assert got == want
    return there


def test_recall_over_planted_pairs(spark):
    vectors = planted(800)
    assert check(spark, vectors, [i % 3 for i in range(len(vectors))], 0.98) > 0
    assert check(spark, vectors, [1] * len(vectors), 0.98) > 200


def test_hot_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    near = [(base + 0.02 * rng.normal(size=16)).astype(np.float32).tolist() for _ in range(150)]
    vectors = near + [near[0]] * 60 + planted(60, 16)
    check(spark, vectors, [7] * len(vectors), 0.98)


def test_edge_rows(spark):
    x = [1.0, 2.0, 3.0]
    rows = [
        (1, x, 1), (2, x, 1), (3, [2.0, 4.0, 6.0], 1), (4, x, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [0.0, 0.0, 0.0], 1),
        (8, [float("nan"), 1.0, 1.0], 1), (9, [float("inf"), 1.0, 1.0], 1), (10, [None, 1.0, 1.0], 1), (11, [], 1), (12, x, 2), (13, [1.0, 2.0], 1), (None, x, 1),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("class", F.lit(1)).withColumn("k1", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cross_polytope.near_duplicates(table).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (3, 1, False) and got[None] == (3, 1, False)
    for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13):
        assert got[i] == (0, i, True)
    assert cross_polytope.near_duplicates(table.limit(0)).count() == 0


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows], [r.label for r in rows])
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op3_embedding_near_dedup(spark, sf).collect()}
    assert got == want


def test_groups_of_any_cut_are_walked_whole(spark, monkeypatch):
    """Arrow batches of a few rows cut every group."""
    monkeypatch.setattr(cross_polytope, "SMALL", 4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        vectors = planted(200)
        check(spark, vectors, [i % 2 for i in range(len(vectors))], 0.98)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_doubles_and_labels_of_any_type(spark):
    """Components that a float or a square can't hold, and labels that are texts."""
    rows = [
        (1, [1e300, 0.0], "a"), (2, [1e300, 1e296], "a"), (3, [1e-60, 1e-60], "a"), (4, [1e-60, 1.00001e-60], "a"), (5, [1e-320, 1e-320], "a"), (6, [1e300, 0.0], "b"), (7, [1e300, 0.0], None), (8, [0.0, -1e-310], "a"),
        (9, [1.0, 0.2030], "a"), (10, [1.0, 0.2031], "c"), (11, [1.0, 0.0], "c"),
    ]
    got = {r.vec_id: (r.n_links, r.component_id) for r in cross_polytope.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    want = {}
    for i, v, label in rows:
        own = np.array(v) / np.abs(v).max()
        near = [j for j, u, other in rows if j != i and label is not None and label == other and (w := np.array(u) / np.abs(u).max()) @ own / np.sqrt((w @ w) * (own @ own)) >= 0.98]
        want[i] = (len(near), min([i, *near]))
    assert got == want and got[2][0] and got[4] == (2, 3) and not got[6][0] and not got[7][0]
