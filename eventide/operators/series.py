"""Fixed-length descriptors of series around their peaks, templates of them, and ranking by likeness to reference windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .cuts import checkpointed, running

Names = Sequence[str]
#: Fixed value: keeps the logarithm of an empty bin finite.
TINY = 1e-6


class Shape:
    """What a descriptor looks at: frame length, frame starts from the peak, band edges as bins of the half spectrum, and how far back and ahead the attack and the decay may reach."""

    def __init__(self, frame: int, starts: Sequence[int], edges: Sequence[int], back: int, ahead: int):
        self.frame, self.starts, self.back, self.ahead = frame, list(starts), back, ahead
        self.edges = [0, *[min(e, frame // 2) for e in edges], frame // 2]
        self.first, self.last = min(-back, *starts), max(ahead, *(s + frame - 1 for s in starts))
        self.length = len(self.starts) * (len(self.edges) + 1) + 2


def _described(window: np.ndarray, held: int, left: int, shape: Shape) -> np.ndarray:
    """The descriptor of one window of samples from shape.first on (zero where the series has none); ``left`` and ``held``: samples of the series before and from the peak."""
    half, out = shape.frame // 2, []
    hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(shape.frame) / (shape.frame - 1)))
    for start in shape.starts:
        at = start - shape.first
        size = np.abs(np.fft.fft(window[at : at + shape.frame] * hann))[:half]
        total = size.sum()
        share = [size[a:b].sum() / total if total > 0 else 0.0 for a, b in zip(shape.edges, shape.edges[1:])]
        centroid = (np.arange(half) * size).sum() / total / half if total > 0 else 0.0
        flatness = np.exp(np.log(size + TINY).mean()) / (total / half + TINY)
        out += [*share, centroid, flatness]
    peak = -shape.first
    top = abs(window[peak])
    if top == 0:
        return np.array([*out, 0.0, 0.0])
    reach = min(shape.back, left)
    quiet = np.flatnonzero(np.abs(window[peak - reach + 1 : peak + 1][::-1]) <= top * 0.1)
    attack = quiet[0] if len(quiet) else reach
    span = min(shape.ahead, held)
    calm = np.flatnonzero(np.abs(window[peak : peak + span]) <= top * 0.2)
    decay = calm[0] if len(calm) else span
    return np.array([*out, min(1.0, attack / shape.back), min(1.0, decay / shape.ahead)])


def _describe(shape: Shape, places: Column, values: Column, before: Column, after: Column, overlap: int) -> Column:
    """Descriptors of windows given as sparse samples: places from the peak, and their values."""

    @F.arrow_udf("array<double>")
    def run(places: pa.Array, values: pa.Array, before: pa.Array, after: pa.Array) -> pa.Array:
        out = []
        for p, v, left, held in zip(places.to_pylist(), values.to_pylist(), before.to_pylist(), after.to_pylist(), strict=True):
            window = np.zeros(shape.last - shape.first + 1 + overlap)
            window[np.array(p) - shape.first + overlap] = v
            made = window[overlap:].copy()
            if overlap:  # a delayed copy over itself
                made += window[:-overlap]
                held += overlap
            out.append(_described(made, held, left, shape))
        return pa.array([x.tolist() for x in out], pa.list_(pa.float64()))

    return run(places, values, before, after)


def placed(df: DataFrame, keys: Names, order: Names, value: str, keep: Names = ()) -> DataFrame:
    """``(keys, i, v, keep)``: samples numbered from 0 in order; a hot key is numbered range by range. Null values count as 0.

    The numbers are checkpointed: what reads the samples several times doesn't sort them anew."""
    rows = df.select(*keys, *order, *keep, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    return checkpointed(running(rows, keys, order, _place=F.lit(1)).select(*keys, (F.col("_place") - 1).cast("long").alias("i"), "v", *keep))


def peaks(samples: DataFrame, keys: Names) -> DataFrame:
    """``(keys, peak, top, n)``: place and size of each series' largest absolute value (the first of equals), and its length."""
    loud = F.max_by(F.struct("i", F.abs("v").alias("top")), F.struct(F.abs(F.col("v")), -F.col("i")))
    return samples.groupBy(*keys).agg(loud.alias("_p"), F.count("*").alias("n")).select(*keys, F.col("_p.i").alias("peak"), F.col("_p.top").alias("top"), "n")


def fingerprints(samples: DataFrame, keys: Names, shape: Shape, at: DataFrame, overlap: int = 0) -> DataFrame:
    """``(keys, peak, top, fingerprint)`` of series ``i, v``, around the places ``at`` (as of peaks()).

    The fingerprint: for each frame, Hann-windowed, the bands' shares of the spectrum's sizes, its centroid and flatness; then how long
    the series took to rise from a tenth of the peak and to fall to a fifth, as shares of the longest looked at. With overlap the series
    is first laid over itself that much later. Only samples near the peak leave their partitions.
    """
    places = at.select(*[F.col(k).alias("_of_" + k) for k in keys], "peak", "top", "n")
    near = F.col("i").between(F.col("peak") + shape.first - overlap, F.col("peak") + shape.last)
    for k in keys:
        near = near & F.col(k).eqNullSafe(F.col("_of_" + k))
    met = samples.join(places, near).groupBy(*keys, "peak", "top", "n").agg(F.collect_list(F.struct((F.col("i") - F.col("peak")).cast("int").alias("p"), "v")).alias("w"))
    made = _describe(shape, F.col("w.p"), F.col("w.v"), F.col("peak").cast("int"), (F.col("n") - F.col("peak")).cast("int"), overlap)
    return met.select(*keys, "peak", "top", made.alias("fingerprint"))


def templates(samples: DataFrame, keys: Names, group: str, shape: Shape, delay: int) -> DataFrame:
    """``(group, kind, members, template)``: ``single`` is the mean of the fingerprints of the group's series, ``burst`` that of its loudest series (the smallest keys of equals) laid over itself after a delay.

    Silent series (all zero) don't count. The samples carry the group beside their keys.
    """
    parts = [group, *[k for k in keys if k != group]]
    at = checkpointed(peaks(samples, parts).where("top > 0"))
    mean = vectors.mean_vector(fingerprints(samples, parts, shape, at), [group], "fingerprint").select(group, F.lit("single").alias("kind"), F.col("fingerprint").alias("template"))
    loudest = at.groupBy(group).agg(F.min_by(F.struct(*parts, "peak", "top", "n"), F.struct(-F.col("top"), *parts)).alias("b"), F.count("*").alias("members"))
    burst = fingerprints(samples, parts, shape, loudest.select("b.*"), delay).select(group, F.lit("burst").alias("kind"), F.col("fingerprint").alias("template"))
    return mean.unionByName(burst).join(loudest.select(group, "members"), group)


def _patch(values: Column) -> Column:
    """Values less their mean, of unit length (zeros, if they are all alike)."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    centred = F.transform(values, lambda x: x - mean)
    norm = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(centred, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def patches(samples: DataFrame, keys: Names, centres: DataFrame, before: int, after: int) -> DataFrame:
    """centres ``(keys, at, ...)`` with ``patch``: the samples from before to after them, held at the series' ends, centred and of unit length. Centres outside of the series go."""
    ends = samples.groupBy(*keys).agg(F.max("i").alias("_last"))
    wanted = centres.join(ends, list(keys)).where((F.col("at") >= 0) & (F.col("at") <= F.col("_last")))
    names = centres.columns
    wanted = wanted.withColumn("_j", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("i", F.greatest(F.lit(0), F.least("_last", F.col("at") + F.col("_j"))).cast("long"))
    met = wanted.join(samples.select(*keys, "i", "v"), [*keys, "i"]).groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", "v"))), lambda s: s["v"]).alias("_w"))
    return met.withColumn("patch", _patch(F.col("_w"))).drop("_w")


def _best_likeness(moved: DataFrame, refs: DataFrame, keys: Names, ident: str) -> DataFrame:
    """``(keys, ident, similarity)``: the largest product of a candidate's patches with its key's reference patches."""
    right = refs.select(*keys, F.col("patch").alias("_ref"))
    return moved.join(right, list(keys)).groupBy(*keys, ident).agg(F.max(F.round(vectors.dot(F.col("patch"), F.col("_ref")), 9)).alias("similarity"))


def rerank(samples: DataFrame, candidates: DataFrame, references: DataFrame, keys: Names, ident: str, score: str, before: int, after: int, jitter: int, weight: float = 0.5, expand: int = 3) -> DataFrame:
    """``(keys, ident, at, score, similarity, final)``: candidates ``at`` places of series, ranked by score and by likeness to references ``at`` places of the same key.

    Likeness: the largest cosine of a window within jitter places of the candidate with any reference window. First against the
    references alone; the ``expand`` most alike candidates (then the smaller ident) of a key become references too. final = score + weight x similarity.
    Candidates of keys without a reference, or outside of the series, are left out. References are few for each key; candidates meet only those of their key.
    """
    steps = F.explode(F.sequence(F.lit(-jitter), F.lit(jitter)))
    around = candidates.select(*keys, ident, steps.alias("_d"), F.col("at").alias("_at")).select(*keys, ident, (F.col("_at") + F.col("_d")).alias("at"))
    refs = patches(samples, keys, references.select(*keys, "at").distinct(), before, after)
    moved = checkpointed(patches(samples, keys, around.join(references.select(*keys).distinct(), list(keys), "left_semi"), before, after))
    first = _best_likeness(moved, refs, keys, ident)
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col(ident).alias("id")))), 1, expand)
    # a key's candidates are cut to the best of each part before they meet
    parts = first.withColumn("_part", F.pmod(F.xxhash64(ident), F.lit(64))).groupBy(*keys, "_part").agg(top.alias("best"))
    best = parts.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, expand).alias("best")).select(*keys, F.explode("best.id").alias(ident))
    grown = moved.join(candidates.select(*keys, ident, "at"), [*keys, ident, "at"], "left_semi").join(best, [*keys, ident], "left_semi")
    likeness = _best_likeness(moved, refs.select(*keys, "patch").unionByName(grown.select(*keys, "patch")), keys, ident)
    return candidates.join(likeness, [*keys, ident]).select(*keys, ident, "at", F.col(score).alias("score"), "similarity", (F.col(score) + weight * F.col("similarity")).alias("final"))
