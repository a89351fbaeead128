"""Whitening against NumPy's full eigendecomposition of the covariance."""

import numpy as np
import pytest
from eventide.llm import whitening as w
from pyspark.sql import functions as F


def exact(vectors: list[list[float]], k: int = 4) -> tuple:
    """(n, sums, values, vectors, trace, of integer vector: projections)."""
    x = np.unique(np.floor(256 * np.array(vectors, np.float64)).astype(np.int64), axis=0)
    mean = x.sum(0) / len(x)
    c = x - mean
    values, turn = np.linalg.eigh(c.T @ c / len(x))
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return len(x), x.sum(0), values, turn, np.trace(c.T @ c / len(x)), mean


def hold(rows: list, ids: list, vectors: list[list[float]], k: int = 4, tolerance: float = 1e-8) -> None:
    n, sums, values, turn, trace, mean = exact(vectors, k)
    got: dict = {}
    for r in rows:
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert len(rows) == len(ids) * k and {c for _, c in got} == set(range(1, k + 1))
    signs = None
    for ident, vector in zip(ids, vectors, strict=True):
        x = np.floor(256 * np.array(vector, np.float64)).astype(np.int64)
        want = (x - mean) @ turn / np.sqrt(values)
        have = np.array([got[ident, i + 1][0].whitened for i in range(k)])
        if signs is None and np.all(np.abs(want) > 1e-3):
            signs = np.sign(want * have)
        assert np.allclose(np.abs(have), np.abs(want), atol=tolerance)
        if signs is not None:
            assert np.allclose(have, want * signs, atol=tolerance)
        r = got[ident, 1][0]
        assert (r.n, r.deviation) == (n, sum((int(n) * int(a) - int(s)) ** 2 for a, s in zip(x, sums)))
    for i in range(k):
        some = got[ids[0], i + 1][0]
        assert some.explained == pytest.approx(values[i] / trace, rel=1e-9) and some.identity_error < 1e-9


@pytest.mark.parametrize(("n", "d", "spread"), [(700, 48, 0.02), (400, 90, 0.0), (60, 5, 1.0), (300, 33, 0.3)])
def test_against_numpy(spark, n, d, spread):
    """Flat spectra (the wanted values close to the rest), steep ones, fewer dimensions than the subspace has vectors."""
    draw = np.random.default_rng(n + d)
    vectors = (draw.standard_normal((n, d)) * (1 + spread * np.arange(d))).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(5)
    hold(w.whitened(df).collect(), list(range(n)), vectors)


def test_filter_needs_few_passes(spark):
    draw = np.random.default_rng(4)
    vectors = draw.standard_normal((3000, 64)).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = w.fit(w.distinct_blocks(df, "embedding").cache())
    assert found.errors.max() <= w.CERTAIN and found.passes < 80
    assert found.values == pytest.approx(exact(vectors)[2], rel=1e-12)


def test_unusable_rows_and_repeats(spark):
    """Nulls, NaN, infinities, empty and odd lengths, repeated rows and vectors, a hot vector, huge entries, clashing names."""
    draw = np.random.default_rng(5)
    good = draw.standard_normal((80, 6)).tolist()
    rows = [(i, v) for i, v in enumerate(good)] + [(i, good[7]) for i in range(100, 160)] + [(3, good[3])]
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [1.0] * 5), (204, []), (205, [1.0, 2.0]), (None, [float("-inf")] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({n: F.lit("clash") for n in ("x", "dims", "n", "component", "whitened", "_vector")}).repartition(4)
    got = w.whitened(df).collect()
    hold(got, [i for i, _ in rows], [v for _, v in rows])
    big = spark.createDataFrame([(i, [1e300 * (i % 2), float(i)]) for i in range(6)], "vec_id long, embedding array<double>")
    found = w.whitened(big).collect()
    assert {r.n for r in found} == {6} and all(r.deviation is None for r in found) and {r.component for r in found} == {1}


def test_nothing_to_whiten(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert w.whitened(empty).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], "vec_id long, embedding array<float>")
    assert w.whitened(same).collect() == []


def test_equal_eigenvalues(spark):
    """A space of equal eigenvalues has no basis of its own: any orthonormal one whitens."""
    vectors = [[s * (j == i) for j in range(8)] for i in range(8) for s in (1.0, -1.0)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    got = w.whitened(df).collect()
    assert len(got) == 16 * 4 and all(r.identity_error < 1e-9 for r in got) and {round(r.explained, 9) for r in got} == {0.125}


def test_query(spark, sf):
    from eventide.llm import queries

    given = [r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None]
    hold(queries.op12_embedding_whitening(spark, sf).collect(), [r.vec_id for r in given], [r.embedding for r in given])
