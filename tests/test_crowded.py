"""Operators on crowded and odd tables: results against plain restatements, and plans whose work doesn't grow with the square of what is crowded."""

import random

import numpy as np
from eventide.operators import blocks, folds, graphs, motion, series, tracking
from eventide.plans import registry
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_right_neighbours_of_crowded_places(spark):
    draw = random.Random(5)
    items = [(i, draw.choice(["a", "b", None]), draw.randrange(90), draw.randrange(30), draw.randrange(4, 9)) for i in range(1500)]
    found = tracking.right_neighbours(spark.createDataFrame(items, "id long, k string, x long, y long, h long"), ["k"], "id", 3, 0.6, 40)
    want = {}
    for i, k, x, y, h in items:
        near = [(u, j) for j, m, u, v, _ in items if k is not None and m == k and u > x and u - x <= 3 * h and abs(v - y) <= 0.6 * h]
        if near:
            want[i] = min(near)[1]
    assert {r.id: r.right for r in found.collect()} == want
    assert "Join" not in plan(found)  # items of a crowded place don't meet each other


def test_region_motion_of_odd_rows(spark):
    rows = [(1, 0, [1.0, 2.0, 3.0, 4.0]), (1, 1, None), (1, 2, [3.0, None, 5.0, 9.0]), (None, 3, [1.0, 1.0, 1.0, 1.0]), (1, 4, [2.0, 2.0, 2.0, 2.0])]
    grids = spark.createDataFrame(rows, "k int, id long, g array<double>")
    region = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (None, 0, 0)], "k int, x long, y long")
    found = motion.region_motion(grids, region, ["k"], "id", "g", 2)
    # a null vector has no values but is there; a null key has no region
    assert sorted((r.id, r.level, r.change) for r in found.collect()) == [(0, 1.5, None), (1, 0.0, 0.0), (2, 3.0, 0.0), (3, 0.0, 0.0), (4, 2.0, 1.0)]


def vectors_of(spark, n, keys=2):
    draw = random.Random(7)
    rows = [(i, i % keys, [draw.gauss(0, 1) for _ in range(6)]) for i in range(n)]
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(20)]  # copies
    return rows, spark.createDataFrame(rows, "id long, k int, v array<float>")


def test_blocks_grow_beyond_few(spark, monkeypatch):
    rows, df = vectors_of(spark, 300)
    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(blocks, "FEW", 3)
    monkeypatch.setattr(blocks, "STRIPE", 16)
    assert blocks._dealt(df, ["k"], "id", "v").agg({"blocks": "max"}).first()[0] == 3  # shipped: rows times blocks
    unit = {i: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for i, _, v in rows}
    found = blocks.top_partners(df.where("id % 5 = 0"), df, ["k"], "id", "v", 3).collect()
    got = {}
    for r in found:
        got.setdefault(r.a, []).append((r.rank, r.b))
    for i, k, _ in rows:
        if i % 5 == 0:
            want = sorted((-round(float(unit[i] @ unit[j]), 9), j) for j, m, _ in rows if m == k and j != i)[:3]
            assert [b for _, b in sorted(got[i])] == [j for _, j in want]


def test_dominant_component_of_query_links(spark, sf):
    """Queries meet all rows in blocks, not as rows of a join."""
    assert "zip_with" not in plan(registry.QUERIES["dominant_component"](spark, sf))
    rows, df = vectors_of(spark, 120)
    unit = {i: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for i, _, v in rows}
    label = {i: i for i in unit}
    changed = True
    while changed:
        changed = False
        for i, k, _ in rows:
            for j, m, _ in rows if i % 20 == 0 else []:
                if m == k and i != j and unit[i] @ unit[j] >= 0.7 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    edges = blocks.linked(df, ["k"], "id", "v", 0.7, df.where("id % 20 = 0"))
    assert {r.id: r.component for r in graphs.components(df.select("id"), edges).collect()} == label


def test_component_gate_meets_in_blocks(spark, sf):
    assert "zip_with" not in plan(registry.QUERIES["component_gate"](spark, sf))


def test_folds_read_checkpointed_rows(spark, sf):
    from eventide.operators import learning
    from eventide.plans import model_queries

    found = learning.cross_scored(model_queries.quality_features(spark, sf), "source", model_queries.FEATURES, "quality", 2)
    assert "documents.parquet" not in plan(found)  # the models of all folds read the features once


def test_placed_samples_are_numbered_once(spark):
    rows = spark.createDataFrame([(i % 3, i, float(i)) for i in range(30)], "k int, t int, x double")
    found = series.placed(rows, ["k"], ["t"], "x")
    assert {(r.k, r.i, r.v) for r in found.collect()} == {(i % 3, i // 3, float(i)) for i in range(30)}
    assert "Window" not in plan(found)  # whoever reads the samples repeatedly doesn't sort them again


def test_boxes_are_decided_in_tiers(spark, monkeypatch):
    draw = random.Random(9)
    boxes = [(i, i % 2, float(draw.randrange(5)), draw.randrange(30), draw.randrange(20), draw.randrange(5, 15), draw.randrange(5, 12)) for i in range(400)]
    met, overlapping = [], folds._overlapping
    monkeypatch.setattr(folds, "TIER", 8)
    monkeypatch.setattr(folds, "_overlapping", lambda *a: met.append((found := overlapping(*a)).count()) or found)
    df = spark.createDataFrame(boxes, "id long, k int, score double, x long, y long, w long, h long").withColumn("kind", F.lit("a"))
    got = {r.id for r in folds.suppress_boxes(df, ["k"], "id", "score", "kind", 0.45).collect()}
    kept, pairs = [], 0
    for i, k, _, x, y, w, h in sorted(boxes, key=lambda b: (-b[2], b[0])):
        def over(b):
            shared = max(0, min(x + w, b[3] + b[5]) - max(x, b[3])) * max(0, min(y + h, b[4] + b[6]) - max(y, b[4]))
            return b[1] == k and shared / (w * h + b[5] * b[6] - shared) > 0.45
        pairs += sum(over(b) for b in boxes if b[0] != i)
        if not any(over(b) for b in kept):
            kept.append((i, k, _, x, y, w, h))
    assert got == {b[0] for b in kept}
    assert sum(met) < pairs / 4  # half of pairs would be all of them
