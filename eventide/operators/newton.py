"""Ridge logistic models by Newton steps: what a step needs of the rows is one aggregate, for one model or for all that leave a group out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics
from .cuts import checkpointed

Names = Sequence[str]
#: Bounds of the linear score and of a row's weight, and the step that ends the search.
STEEPEST, LIGHTEST, STILL = 30.0, 1e-6, 1e-9


def _design(df: DataFrame, features: Names, label: str, group: str | None) -> DataFrame:
    """``(g, y, x)`` of the rows whose label, group and features are all there and finite."""
    values = [F.col(f"`{f}`").cast("double") for f in features]
    whole = F.col(label).isNotNull()
    for v in values:
        whole = whole & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    if group is not None:
        whole = whole & F.col(group).isNotNull()
    return df.where(whole).select((F.col(group).cast("string") if group else F.lit("")).alias("g"), F.col(label).cast("double").alias("y"), F.array(*values).alias("x"))


def _summed(rows: DataFrame, part, width: int) -> dict[str, np.ndarray]:
    """By name, the summed vectors that part(g, y, x) gives for a batch: each task adds up its own, then Spark adds by name and place. What is collected are names x width numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                g, y = np.array(batch.column(0).to_pylist(), object), np.asarray(batch.column(1))
                x = np.asarray(batch.column(2).flatten()).reshape(len(y), -1)
                for name, sums in part(g, y, x):
                    total[name] = total[name] + sums if name in total else sums
        for name, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * width), pa.array(range(width), pa.int32()), pa.array(sums)], names=["name", "place", "value"])

    out: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(run, "name string, place int, value double").groupBy("name", "place").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r.name, np.zeros(width))[r.place] = r.value
    return out


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -STEEPEST, STEEPEST)))


def _curvature(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and Gram matrix of rows (with a leading one) at w, as one vector."""
    p = _probability(x, w)
    s = np.maximum(p * (1 - p), LIGHTEST)
    return np.concatenate([x.T @ (p - y), ((x * s[:, None]).T @ x).ravel()])


def _step(w: np.ndarray, sums: np.ndarray, ridge: float) -> np.ndarray:
    d = len(w)
    penalty = np.full(d, ridge)
    penalty[0] = 0.0
    return w - np.linalg.solve(sums[d:].reshape(d, d) + np.diag(penalty), sums[:d] + penalty * w)


def fit(df: DataFrame, features: Names, label: str, ridge: float, steps: int = 60) -> list[float]:
    """Weights of a logistic model with a ridge penalty, the unpenalised bias first: Newton steps until none moves a weight by 1e-9, at most ``steps``.

    A step is one pass that sums gradient and Gram matrix on the executors; the driver solves a system as wide as the features. Rows with
    a null or a feature that isn't finite are left out; without rows all weights are 0.
    """
    rows = checkpointed(_design(df, features, label, None))
    w = np.zeros(1 + len(features))
    for _ in range(steps):
        part = lambda g, y, x, w=w: [("", _curvature(np.hstack([np.ones((len(x), 1)), x]), y, w))]
        sums = _summed(rows, part, len(w) + len(w) ** 2)
        if not sums:
            break
        before, w = w, _step(w, sums[""], ridge)
        if np.abs(w - before).max() < STILL:
            break
    return w.tolist()


def probability(features: Names, weights: Sequence[float]) -> Column:
    """The model's probability of label 1."""
    score = F.lit(weights[0])
    for f, w in zip(features, weights[1:], strict=True):
        score = score + F.col(f"`{f}`").cast("double") * w
    return 1 / (1 + F.exp(-F.greatest(F.lit(-STEEPEST), F.least(F.lit(STEEPEST), score))))


def leave_one_out(df: DataFrame, group: str, features: Names, label: str, ridge: float, steps: int = 60) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By group (as text), ``(mean, deviation, weights)`` of the model of all other groups' rows, standardised by those rows.

    Moments come from one aggregate by group, a group's complement being the total less its own. The models' Newton steps share
    their passes: a pass sums every model's gradient and Gram matrix over all rows but its own group's. What is
    held is one small model for each group.
    """
    rows = checkpointed(_design(df, features, label, group))
    d = len(features)
    one = lambda g, y, x: [(name, np.concatenate([[len(v := x[g == name])], v.sum(0), (v * v).sum(0)])) for name in set(g)]
    moments = _summed(rows, one, 1 + 2 * d)
    total = sum(moments.values())
    scales = {}
    for name, own in moments.items():
        rest = total - own
        if rest[0] > 0:
            mean = rest[1 : 1 + d] / rest[0]
            deviation = np.sqrt(np.maximum(rest[1 + d :] / rest[0] - mean * mean, 0))
            scales[name] = (mean, np.where(deviation < 1e-9, 1.0, deviation))
    weights = {name: np.zeros(1 + d) for name in scales}
    moving = set(weights)
    for _ in range(steps):
        if not moving:
            break

        def part(g: np.ndarray, y: np.ndarray, x: np.ndarray, held=tuple((n, *scales[n], weights[n]) for n in sorted(moving))):
            for name, mean, deviation, w in held:
                other = g != name
                if other.any():
                    yield name, _curvature(np.hstack([np.ones((int(other.sum()), 1)), (x[other] - mean) / deviation]), y[other], w)

        for name, sums in _summed(rows, part, (1 + d) * (2 + d)).items():
            w = _step(weights[name], sums, ridge)
            if np.abs(w - weights[name]).max() < STILL:
                moving.discard(name)
            weights[name] = w
    return {name: (*scales[name], weights[name]) for name in scales}


def leave_one_out_scored(df: DataFrame, group: str, features: Names, label: str, ridge: float, steps: int = 60, out: str = "p") -> DataFrame:
    """df with ``p`` by the model that has not seen the row's group; null where the group or a feature is null or not finite, or no other group has rows."""
    models = leave_one_out(df, group, features, label, ridge, steps)
    rows = [(name, *[[float(v) for v in part] for part in parts]) for name, parts in models.items()]
    table = df.sparkSession.createDataFrame(rows, "_name string, _mean array<double>, _deviation array<double>, _w array<double>")
    score = F.col("_w")[0]
    for i, f in enumerate(features):
        score = score + (F.col(f"`{f}`").cast("double") - F.col("_mean")[i]) / F.col("_deviation")[i] * F.col("_w")[i + 1]
    p = F.when(~F.isnan(score) & (F.abs(score) != float("inf")), 1 / (1 + F.exp(-F.greatest(F.lit(-STEEPEST), F.least(F.lit(STEEPEST), score)))))
    joined = df.join(F.broadcast(table), F.col(group).cast("string") == F.col("_name"), "left")  # one row for each group, as held by the driver already
    return joined.select(*[f"`{c}`" for c in df.columns if c != out], p.alias(out))


def leave_one_out_auc(df: DataFrame, group: str, features: Names, label: str, ridge: float, least: int = 2, steps: int = 60, digits: int = 9) -> DataFrame:
    """``(group, n_pos, n_neg, auc)`` within every group, by the model of the others; null with fewer than ``least`` rows of a class. Scores count as equal by their first digits."""
    scored = leave_one_out_scored(df.select(group, label, *features), group, features, label, ridge, steps).where("p IS NOT NULL")
    return metrics.rank_auc(scored.withColumn("p", F.round("p", digits)), [group], "p", label, least)
