"""Components against union-find, and models by held-out quality."""

import random

from eventide.operators import graphs
from eventide.plans import model_queries


def test_components(spark):
    random.seed(7)
    ids = list(range(60))
    pairs = [(random.randrange(60), random.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(40, 55)]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    got = graphs.components(nodes, spark.createDataFrame(pairs, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == {i: find(i) for i in ids}
    alone = graphs.components(nodes, spark.createDataFrame([], "a long, b long"))
    assert all(r.id == r.component for r in alone.collect())


def test_quality_model_on_folds_of_whole_sources(spark):
    found = model_queries.cv_auc(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == 4
    assert sum(r.auc for r in found) / 4 > 0.85


def test_missing_features_take_the_training_rows_mean(spark):
    import math

    from eventide.operators import learning

    rows = [(float(i), None if i % 7 == 0 else float(i % 5), int(i > 20)) for i in range(40)]
    train = spark.createDataFrame(rows, "a double, b double, y int")
    model = learning.logistic(train, ["a", "b"], "y")
    seen = [b for _, b, _ in rows if b is not None]
    mean = sum(seen) / len(seen)
    # alone in its table, a row without b scores as with the training mean, not with its own or none
    lone = [learning.scored(model, spark.createDataFrame([(25.0, b)], "a double, b double")).first().p for b in (None, math.nan, mean)]
    assert max(lone) - min(lone) < 1e-12 and 0 < lone[0] < 1
