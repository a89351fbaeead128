"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard
transform; its hash is the closest of the 2d signed axes. A table joins HASHES
such hashes, and every vector is also put in the bucket that swaps its least
certain axis for the runner-up (multiprobe). Candidates, vectors that share a
bucket, are verified by cosine in double precision.

Equal vectors are one class. Buckets of any size are dealt to pairs of blocks,
each a bounded task; a block pair counts links in place and passes on one
spanning forest, never the pairs themselves. A pair that meets in several
buckets is counted in the first of them only, so counts are exact.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, connected_components

THRESHOLD = 0.98
TABLES = 8
HASHES = 2
PROBES = 2
#: Bucket codes are taken modulo this; buckets that meet by it cost time only, as candidates are verified.
CODES = 2**31 - 1
#: Groups of up to so many rows are compared pair by pair in one go, larger ones as a matrix product each.
SMALL = 48
#: Vectors of a bucket that one block holds.
BLOCK = 512
SEED = 11


@cache
def _signs(size: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).choice([-1.0, 1.0], (TABLES, HASHES, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (their length a power of two)."""
    n, size = x.shape
    step = 1
    while step < size:
        pairs = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, size)
        step *= 2
    return x


def bucket_codes(vectors: np.ndarray) -> np.ndarray:
    """``(n, TABLES * PROBES)`` buckets of the rows: for each table its own, then the probed one."""
    n, dim = vectors.shape
    size = max(2, 1 << (dim - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :dim] = vectors
    out = np.empty((n, TABLES, PROBES), np.int64)
    rows = np.arange(n)
    for t in range(TABLES):
        own, other, gaps = [], [], []
        for h in range(HASHES):
            x = padded
            for signs in _signs(size)[t, h]:
                x = hadamard(x * signs) / np.sqrt(size)
            big = np.abs(x)
            first = big.argmax(axis=1)
            top = big[rows, first].copy()
            big[rows, first] = -1.0
            second = big.argmax(axis=1)
            own.append(2 * first + (x[rows, first] < 0))
            other.append(2 * second + (x[rows, second] < 0))
            gaps.append(top - big[rows, second])
        swap = np.argmin(gaps, axis=0)
        for probe in range(PROBES):
            code = np.zeros(n, np.int64)
            for h in range(HASHES):
                code = code * (2 * size) + np.where((swap == h) & (probe == 1), other[h], own[h])
            out[:, t, probe] = code
    return (out % CODES).astype(np.int32).reshape(n, TABLES * PROBES)


def codes(vector: Column) -> Column:
    @F.pandas_udf("array<int>")
    def run(vectors: pd.Series) -> pd.Series:
        out = np.empty(len(vectors), object)
        lengths = vectors.map(len).to_numpy()
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            for part in np.array_split(at, max(1, len(at) // 1024)):
                for i, row in zip(part, bucket_codes(np.stack(vectors.iloc[part].to_list()).astype(np.float64)), strict=True):
                    out[i] = row
        return pd.Series(out)

    return run(vector)


def usable(vector: Column) -> Column:
    """Not null, not empty, finite throughout and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce((F.size(vector) > 0) & ~bad & some, F.lit(False))


def _meet_first(a: np.ndarray, b: np.ndarray, table: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For pairs of code rows, if their bucket is the first (by table, then by code) that both are in."""
    a, b = a.reshape(len(a), TABLES, PROBES), b.reshape(len(b), TABLES, PROBES)
    first = np.ones(len(a), bool)
    for t in range(int(table.max()) if len(table) else 0):
        later = table > t
        for p in range(PROBES):
            for q in range(PROBES):
                first &= ~later | (a[:, t, p] != b[:, t, q])
    rows = np.arange(len(a))
    for p in range(PROBES):
        for q in range(PROBES):
            first &= (a[rows, table, p] != b[rows, table, q]) | (a[rows, table, p] >= code)
    return first


def near_pairs(unit: np.ndarray, lengths: np.ndarray, block: np.ndarray, cross: np.ndarray, threshold: float):
    """Row pairs (i, j) of equal groups with cosine at the threshold or above. Groups are
    stretches of the given lengths; those of two blocks (cross) pair rows of different blocks only."""
    ends = np.cumsum(lengths)
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, end in zip((ends - lengths)[lengths > SMALL].tolist(), ends[lengths > SMALL].tolist(), strict=True):
        near = unit[start:end] @ unit[start:end].T >= threshold
        i, j = np.nonzero(np.triu(near, 1))
        found_i.append(i + start)
        found_j.append(j + start)
    left = np.where(np.repeat(lengths, lengths) <= SMALL, np.repeat(ends, lengths) - np.arange(len(unit)) - 1, 0)  # partners after a row
    i = np.repeat(np.arange(len(unit)), left)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(left) - left, left)
    for part in np.array_split(np.arange(len(i)), max(1, len(i) // 100_000)):
        near = np.einsum("ij,ij->i", unit[i[part]], unit[j[part]]) >= threshold
        found_i.append(i[part][near])
        found_j.append(j[part][near])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    apart = ~cross[i] | (block[i] != block[j])
    return i[apart], j[apart]


def compare(chunk: pa.Table, lengths: np.ndarray, threshold: float, kind: type = np.float32) -> pa.RecordBatch:
    """Links within the groups of a chunk: ``(class, links, root)`` of the rows that have any; roots make a forest over them."""
    ids, sizes, block = (chunk.column(c).to_numpy() for c in ("class", "n", "block"))
    raw = np.frombuffer(b"".join(chunk.column("vector").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64)
    raw /= np.abs(raw).max(axis=1, keepdims=True)
    unit = raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]
    codes = np.frombuffer(b"".join(chunk.column("codes").to_pylist()), np.int32).reshape(len(ids), -1)
    cross = chunk.column("low").to_numpy() != chunk.column("high").to_numpy()
    i, j = near_pairs(unit, lengths, block, cross, threshold)
    table, code = chunk.column("table").to_numpy()[i], chunk.column("code").to_numpy()[i]
    links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for part in np.array_split(np.arange(len(i)), max(1, len(i) // 200_000)):
        first = part[_meet_first(codes[i[part]], codes[j[part]], table[part], code[part])]
        a, b = i[first], j[first]
        links += np.bincount(a, sizes[b], len(ids)).astype(np.int64) + np.bincount(b, sizes[a], len(ids)).astype(np.int64)
        while len(a):  # hooking and pointer jumping
            x, y = parent[a], parent[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(parent, parent[parent]):
                parent = parent[parent]
    some = links > 0
    return pa.RecordBatch.from_pydict({"class": ids[some], "links": links[some], "root": ids[parent[some]]})


SCHEMA = "class long, links long, root long"
KEYS = ("label", "dim", "table", "code", "low", "high")


def _walk(threshold: float, kind: type):
    """Arrow batches sorted by KEYS to rows (class, links, root): whole groups at a time, however batches cut them."""

    def run(batches):
        held = None
        for batch in batches:
            chunk = pa.Table.from_batches([batch])
            chunk = pa.concat_tables([held, chunk]) if held is not None else chunk
            starts = _group_starts(chunk)
            held = chunk.slice(starts[-1])  # the last group may go on
            if len(starts) > 1:
                yield from _by_dim(chunk.slice(0, starts[-1]), starts, threshold, kind)
        if held is not None and len(held) > 1:
            yield from _by_dim(held, np.array([0, len(held)]), threshold, kind)

    return run


def _group_starts(chunk: pa.Table) -> np.ndarray:
    marks = np.ones(len(chunk), bool)
    marks[1:] = False
    for k in KEYS:
        values = chunk.column(k).to_numpy()
        marks[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(marks)


def _by_dim(chunk: pa.Table, bounds: np.ndarray, threshold: float, kind: type):
    """Compare the groups between bounds, vectors of one length at a time."""
    dims = chunk.column("dim").to_numpy()
    bounds = np.unique(np.append(bounds[bounds < len(chunk)], len(chunk)))
    cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(chunk)]
    for start, end in zip(cuts, cuts[1:], strict=False):
        inner = bounds[(bounds >= start) & (bounds <= end)]
        yield compare(chunk.slice(start, end - start), np.diff(inner), threshold, kind)


def scaled(vector: Column) -> Column:
    """The vector times the power of two that brings its largest component to between a half and one: no cosine changes by it, and no square overflows or vanishes."""

    @F.pandas_udf("array<double>")
    def run(vectors: pd.Series) -> pd.Series:
        def one(x) -> np.ndarray:
            x = np.asarray(x, np.float64)
            return np.ldexp(x, -np.frexp(np.abs(x).max())[1])

        return vectors.map(one)

    return run(vector)


def packed(vector: Column, kind: type) -> Column:
    """The vector as bytes of its own precision: what is a float stays one."""

    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: np.asarray(x, kind).tobytes())

    return run(vector)


def candidate_links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(class, links, root)`` rows over classes ``(class, n, label, vector)``: links of a
    class in one bucket block pair (in vectors, other classes only), and an edge to a class it is connected with there."""
    kind = np.float32 if classes.schema["vector"].dataType.elementType.typeName() == "float" else np.float64
    hashed = checkpointed(classes.select("class", "n", "label", F.size("vector").alias("dim"), codes(F.col("vector")).alias("codes"), packed(F.col("vector"), kind).alias("vector")))
    slots = hashed.select("class", "label", "dim", F.posexplode("codes").alias("slot", "code"))
    slots = slots.withColumn("table", F.floor(F.col("slot") / PROBES).cast("int")).drop("slot")
    bucket = ["label", "dim", "table", "code"]
    sizes = slots.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1")
    entries = slots.join(sizes, bucket).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    entries = entries.withColumn("block", F.pmod(F.xxhash64("class", F.lit(SEED)), F.col("blocks")).cast("int"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    entries = entries.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    payload = hashed.select("class", "n", code_bytes(F.col("codes")).alias("codes"), "vector")
    dealt = entries.select(*KEYS, "class", "block").join(payload, "class")
    return dealt.repartition(*KEYS).sortWithinPartitions(*KEYS, "class").mapInArrow(_walk(threshold, kind), SCHEMA)


def code_bytes(codes: Column) -> Column:
    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: np.asarray(x, np.int32).tobytes())

    return run(codes)


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``(<id_col>, n_links, component_id, kept)``, one row for each row of table.

    Vectors that are null, empty, zero or hold a null or non-finite component,
    and those of a null label, link with nothing; so do vectors of different
    lengths. Cosines are in double precision, whatever the size of the components; labels may be of any type (those that
    aren't whole numbers meet by their 64-bit hash). Repeated rows are vectors of their own and link with each other. A
    null id is in a component but never names one (unless it is alone). No rows
    give no rows.
    """
    element = table.schema[vector_col].dataType.elementType.typeName()
    label = F.col(label_col).cast("long") if isinstance(table.schema[label_col].dataType, T.IntegralType) else F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col))
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), label.alias("label"))
    rows = rows.withColumn("ok", usable(F.col("vector")) & F.col("label").isNotNull())
    # -0.0 + 0.0 is 0.0: equal vectors have equal hashes
    same = F.transform("vector", lambda x: x + F.lit(0.0))
    rows = rows.withColumn("k1", F.when(F.col("ok"), F.xxhash64(same))).withColumn("k2", F.when(F.col("ok"), F.hash(same)))
    if element != "float":  # floats have squares within a double's range as they are
        rows = rows.withColumn("vector", F.when(F.col("ok"), F.col("vector").cast("array<double>")))
    groups = rows.where("ok").groupBy("label", "k1", "k2").agg(F.min("id").alias("class"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    groups = checkpointed(groups.withColumn("class", F.coalesce("class", F.lit(-(2**63)).cast("long") + F.pmod("k1", F.lit(2**40)))))
    vector = F.col("vector") if element == "float" else scaled(F.col("vector")).alias("vector")
    found = checkpointed(candidate_links(groups.select("class", "n", "label", vector), threshold))
    components = connected_components(found.select("class", "root"), "class", "root")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    named = groups.select("label", "k1", "k2", "class", "n").join(links, "class", "left").join(components.withColumnRenamed("node", "class"), "class", "left")
    named = named.select(F.col("label").alias("_l"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "class").alias("component"))
    joined = rows.join(named, (rows["label"] == named["_l"]) & (rows["k1"] == named["_k1"]) & (rows["k2"] == named["_k2"]), "left")
    component = F.when(F.col("component") > -(2**62), F.col("component"))
    out = joined.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(component, F.col("id")).cast("long").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
