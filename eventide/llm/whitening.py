"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The distinct vectors are kept as packed integer blocks. A pass goes over them
once: every task sums ``Xc' (Xc Q)`` of its centred blocks for a narrow matrix Q, and
the sums meet in a few tasks before one matrix reaches the driver; no covariance of
all dimensions is ever formed. A polynomial recurrence over such passes damps
the spectrum below the wanted part, then QR and a Rayleigh-Ritz step give pairs, whose
residuals and gaps certify them; else the filter runs again, with a wider block
where it gains little.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed

#: Components that are asked for.
COMPONENTS = 4
#: Vectors of the subspace for each component, and the filter's degree.
WIDTH, DEGREE = 8, 10
#: Steps that estimate the lower end of the spectrum.
LANCZOS = 10
#: A pair is certain if its residual, over its distance to the rest of the spectrum, is below this.
CERTAIN = 1e-10
#: Eigenvalues at or under this share of the largest are zero.
RANK = 1e-12
#: Bytes of a block as doubles, and tasks that sums meet in.
BLOCK, MEETING = 4 << 20, 8
#: Packed bytes of a pass's task.
TASK = 64 << 20
#: Entries are held within this.
MOST = 2.0**62


def _integers(values: pa.Array) -> np.ndarray:
    """floor(256 * c) of finite values."""
    x = np.floor(np.asarray(values.cast(pa.float64()), np.float64) * 256.0)
    return np.clip(x, -MOST, MOST).astype(np.int64)


def _usable(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with at least one entry, all of them there and finite; their lengths; their entries as one array)."""
    flat = vectors.values
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.asarray(vectors.offsets, np.int64)
    good = np.asarray(vectors.is_valid()) & (bad[ends[1:]] == bad[ends[:-1]]) & (ends[1:] > ends[:-1])
    lengths = (ends[1:] - ends[:-1])[good]
    chosen = np.repeat(good, ends[1:] - ends[:-1])
    return np.flatnonzero(good), lengths, _integers(pa.array(values[ends[0] : ends[-1]][chosen]))


def _packed(entries: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Each vector in two bytes an entry if that holds all of its entries, else in eight."""
    ends = np.cumsum(lengths)
    narrow = entries.astype(np.int16)
    wide = np.logical_or.reduceat(narrow != entries, np.concatenate([[0], ends[:-1]])) if len(ends) else []
    return [(entries if w else narrow)[b - n : b].tobytes() for w, n, b in zip(wide, lengths, ends, strict=True)]


def _unpacked(cells: list[bytes], dims: int) -> np.ndarray:
    """Vectors of equal length as rows of longs."""
    out = np.empty((len(cells), dims), np.int64)
    for width, kind in ((2, np.int16), (8, np.int64)):
        at = [i for i, cell in enumerate(cells) if len(cell) == width * dims]
        if at:
            out[at] = np.frombuffer(b"".join([cells[i] for i in at]), kind).reshape(len(at), dims)
    return out


def distinct_blocks(df: DataFrame, vector: str) -> DataFrame:
    """``(dims, m, cells)``: every distinct vector of longs once, m of them packed in a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lengths, entries = _usable(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), pa.array(_packed(entries, lengths), pa.binary())], names=["dims", "x"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}

        def out(dims: int) -> pa.RecordBatch:
            x = _unpacked(held.pop(dims), dims)
            narrow = x.astype(np.int16)
            kept = narrow if np.array_equal(narrow, x) else x
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([kept.tobytes()], pa.binary())], names=["dims", "m", "cells"])

        for batch in batches:
            for dims, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                cells = held.setdefault(dims, [])
                cells.append(x)
                if len(cells) * dims * 8 >= BLOCK:
                    yield out(dims)
        for dims in list(held):
            yield out(dims)

    return df.select(_doubles(F.col(vector))).mapInArrow(pack, "dims int, x binary").distinct().mapInArrow(block, "dims int, m long, cells binary")


def _summed(blocks: DataFrame, size: int, kind: type, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of part(vectors), an array of that size, over all blocks: by task, then in MEETING tasks."""

    def out(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for batch in batches:
            for dims, m, cells in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                total += part(np.frombuffer(cells, np.int16 if len(cells) == 2 * dims * m else np.int64).reshape(m, dims))
        yield out(total)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for batch in batches:
            for cell in batch.column(0):
                total += np.frombuffer(cell.as_py(), kind)
        yield out(total)

    sums = blocks.mapInArrow(first, "sums binary").repartition(MEETING).mapInArrow(second, "sums binary")
    total = np.zeros(size, kind)
    for row in sums.collect():  # MEETING rows
        total += np.frombuffer(row.sums, kind)
    return total


@dataclass
class Whitener:
    """The fit: vectors' count and exact sums, the trace, and unit eigenvectors (columns) by falling eigenvalue, with bounds of their errors."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    errors: np.ndarray
    passes: int = 0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _moments(blocks: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Count and exact sums: high and low halves of the entries are summed apart, so that no long overflows."""

    def part(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        return np.concatenate([[len(x)], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])

    found = _summed(blocks, 1 + 2 * dims, np.int64, part).tolist()
    return found[0], [(hi << 32) + lo for hi, lo in zip(found[1 : 1 + dims], found[1 + dims :], strict=True)]


def fit(blocks: DataFrame, k: int = COMPONENTS, seed: int = 0) -> Whitener:
    """Leading eigenpairs of the covariance of blocks of one length (divisor n, centred before multiplying)."""
    dims = blocks.select("dims").first()
    if dims is None:
        return Whitener(0, [], 0.0, np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    d = dims[0]
    n, sums = _moments(blocks, d)
    mean = np.array([s / n for s in sums])
    passes = 1

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        columns = q.shape[1]
        return _summed(blocks, d * columns, np.float64, lambda x: ((c := x - mean).T @ (c @ q)).ravel()).reshape(d, columns) / n

    squares = _summed(blocks, d, np.float64, lambda x: ((x - mean) ** 2).sum(0)) / n
    trace = float(squares.sum())
    passes += 1
    k = min(k, d)
    draw = np.random.default_rng(seed)
    if not trace > 0:
        return Whitener(n, sums, trace, np.zeros(0), np.zeros((d, 0)), np.zeros(0), passes)
    low = max(0.0, _lower_end(product, d, trace, draw)) if d > WIDTH * k else 0.0
    width = min(d, WIDTH * k)
    values, q, images = _ritz(product, draw.standard_normal((d, width)))
    before = np.inf
    while True:
        errors = _errors(values, q, images, k)
        worst = errors.max()
        # certain; or a full basis, or as far as sums of doubles go
        if worst <= CERTAIN or q.shape[1] == d or worst <= 1e-6 and worst > before / 2:
            break
        if worst > before / 100:  # little gained: the spectrum is dense below the block
            more = draw.standard_normal((d, min(d, 2 * q.shape[1]) - q.shape[1]))
            q = np.linalg.qr(np.hstack([q, more]))[0]
            values, q, images = _ritz(product, q)
        before = worst
        if q.shape[1] < d:
            values, q, images = _ritz(product, _filtered(product, q, images, low, values[-1], values[0]))
    real = values[:k] > RANK * values[0]
    return Whitener(n, sums, trace, values[:k][real], q[:, :k][:, real], errors[real], passes)


def _ritz(product: Callable, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values by falling size, orthonormal vectors, their images) of the covariance on the space of x's columns."""
    q = np.linalg.qr(np.linalg.qr(x)[0])[0]
    images = product(q)
    small = q.T @ images
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, images @ turn


def _errors(values: np.ndarray, q: np.ndarray, images: np.ndarray, k: int) -> np.ndarray:
    """By wanted pair, its residual over its distance to the Ritz values that differ from it: a bound of the vector's angle."""
    residuals = np.linalg.norm(images - q * values, axis=0)
    out = []
    for i in range(k):
        away = np.abs(values - values[i])
        away = away[away > 1e-9 * values[0]]
        out.append(residuals[i] / (away.min() if len(away) else values[0]))
    return np.array(out)


def _filtered(product: Callable, q: np.ndarray, images: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """A Chebyshev polynomial of the covariance times q: bounded on [low, high], growing fastest above; scaled so that the top keeps its size."""
    e, c = max((high - low) / 2, 1e-12 * top), (high + low) / 2
    sigma = first = e / (top - c)
    x, y = q, (images - c * q) * (sigma / e)
    for _ in range(DEGREE - 1):
        following = 1 / (2 / first - sigma)
        x, y = y, (product(y) - c * y) * (2 * following / e) - (sigma * following) * x
        sigma = following
    return y


def _lower_end(product: Callable, d: int, scale: float, draw: np.random.Generator) -> float:
    """A bound below the spectrum from a few Lanczos steps: the least Ritz value, less the norm of what is left over."""
    v = draw.standard_normal(d)
    basis, alphas, betas = [v / np.linalg.norm(v)], [], []
    for _ in range(LANCZOS):
        w = product(basis[-1][:, None])[:, 0]
        alphas.append(float(w @ basis[-1]))
        for _ in range(2):
            for b in basis:
                w = w - (w @ b) * b
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-12 * scale:
            return 0.0
        basis.append(w / betas[-1])
    inner = np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1)
    return float(np.linalg.eigvalsh(inner)[0]) - betas[-1]


def identity_error(blocks: DataFrame, found: Whitener) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity."""
    k = len(found.values)
    if not k:
        return 0.0
    mean, turn = found.mean, found.vectors / np.sqrt(found.values)
    total = _summed(blocks, k * k + k, np.float64, lambda x: np.concatenate([((w := (x - mean) @ turn).T @ w).ravel(), w.sum(0)])) / found.n
    centre = total[k * k :]
    return float(np.abs(total[: k * k].reshape(k, k) - np.outer(centre, centre) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly; None where that is no long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if most * most * x.shape[1] < 2**63:
        return (((x * n - np.array(sums, np.int64)) ** 2).sum(1)).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)
    return [v if v < 2**63 else None for v in exact]


def whitened(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """``(ident, component, n, deviation, whitened, explained, identity_error)``, one row for each usable vector and component.

    Vectors that are null, empty, or hold nulls or entries that aren't finite give no rows, nor do those
    whose length isn't the commonest among distinct vectors (the longest of equals). Entries
    become floor(256 c), held within 2^62; repeated vectors count once in the fit, but each of their rows is returned.
    Components of no variance are left out: equal vectors, one vector or none give no rows. A deviation that no long
    holds is null. Other columns of df aren't looked at.
    """
    blocks = checkpointed(distinct_blocks(df, vector))
    common = blocks.groupBy("dims").agg(F.sum("m").alias("m"), F.sum(F.octet_length("cells")).alias("bytes")).orderBy(F.desc("m"), F.desc("dims")).first()
    # every pass is a job over all blocks: as many tasks as they need, not as many as the shuffle had
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, common.bytes // TASK + 1 if common else 1)
    blocks = blocks.where(F.col("dims") == (common.dims if common else 0)).coalesce(tasks)
    found = fit(blocks, k)
    error = identity_error(blocks, found)
    d, count, n, sums = len(found.sums), len(found.values), found.n, found.sums
    turn = found.vectors / np.sqrt(found.values) if count else None
    explained = (found.values / found.trace).tolist() if count else []
    mean = found.mean if n else None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, entries = _usable(batch.column(1))
            held = np.repeat(lengths == d, lengths)
            rows, x = rows[lengths == d], entries[held].reshape(-1, d) if d else entries.reshape(0, 0)
            if not count or not len(rows):
                continue
            w = (x - mean) @ turn
            each = np.repeat(np.arange(len(rows)), count)
            components = np.tile(np.arange(1, count + 1, dtype=np.int32), len(rows))
            deviation = pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(each))
            size = len(each)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[each])), pa.array(components), pa.array(np.full(size, n)), deviation, pa.array(w.ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(size, error))],
                names=[ident, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kinds = T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double").fields
    return df.select(F.col(ident), _doubles(F.col(vector))).mapInArrow(project, T.StructType([T.StructField(ident, df.schema[ident].dataType), *kinds]))


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>").alias("_vector")
