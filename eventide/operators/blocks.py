"""Similarity of all vectors of a key with all others, in pairs of blocks: a task multiplies two blocks of bounded size and gives on
what is kept of them (the best partners, or a spanning forest of the links), never the pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

Names = Sequence[str]
#: Vectors of a block, while a key has few; beyond FEW blocks they grow up to LARGE vectors (of 64 entries, less if they are longer): what is shipped is a key's rows times its blocks.
BLOCK, FEW, LARGE = 512, 16, 8192
#: Rows of a block that are multiplied at once.
STRIPE = 512
#: Partners that are picked one after the other; more are sorted.
PICKED = 16


def _dealt(df: DataFrame, keys: Names, ident: str, vector: str) -> DataFrame:
    """``(keys, id, v, block, blocks)``: vectors dealt to as many blocks of their key as its number of rows asks for."""
    kind = "array<float>" if df.schema[vector].dataType == T.ArrayType(T.FloatType(), df.schema[vector].dataType.containsNull) else "array<double>"  # floats are shipped as such
    rows = df.where(F.col(vector).isNotNull()).select(*keys, F.col(ident).alias("id"), F.col(vector).cast(kind).alias("v"))
    large = F.greatest(F.lit(BLOCK), F.least(F.lit(LARGE), F.floor(LARGE * 64 / F.greatest(F.lit(1), F.max(F.size("v"))))))
    blocks = F.least(F.ceil(F.count("*") / BLOCK), F.greatest(F.lit(FEW), F.ceil(F.count("*") / large)))
    sizes = rows.groupBy(*[F.col(k).alias("_of_" + k) for k in keys]).agg(blocks.cast("int").alias("blocks"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_of_" + k))
    placed = rows.join(sizes, same) if keys else rows.crossJoin(sizes)  # without keys: one row
    return placed.select(*keys, "id", "v", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "blocks")


def _met(left: DataFrame, right: DataFrame | None, keys: Names, ident: str, vector: str) -> tuple[DataFrame, list[str]]:
    """Rows of both sides, sent to every pair of blocks that they belong to; without a right side, pairs of left's own blocks (each once)."""
    a = _dealt(left, keys, ident, vector)
    group = [*keys, "low", "high"]
    if right is None:
        sent = a.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sent = sent.select(*keys, F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), F.when(F.col("block") <= F.col("_other"), 0).otherwise(1).alias("side"), "id", "v")
        return sent, group
    b = _dealt(right, keys, ident, vector)

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*[F.col(k).alias("_of_" + k) for k in keys]).agg(F.max("blocks").alias(name))

    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_of_" + k))
    with_number = lambda df, numbers: (df.join(numbers, same) if keys else df.crossJoin(numbers)).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    one = with_number(a, count(b, "_n")).select(*keys, F.col("block").alias("low"), F.col("_other").alias("high"), F.lit(0).alias("side"), "id", "v")
    two = with_number(b, count(a, "_n")).select(*keys, F.col("_other").alias("low"), F.col("block").alias("high"), F.lit(1).alias("side"), "id", "v")
    return one.unionByName(two), group


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _walked(sent: DataFrame, group: list[str], keys: Names, kind: T.DataType, out: list[tuple[str, str]], kernel: Callable, apart: bool) -> DataFrame:
    """kernel(left ids, left unit vectors, right ids, right unit vectors, one block alone) for every pair of blocks and length of vector."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [sent.schema[k] for k in keys] + [T.StructField(n, kind if t == "id" else T._parse_datatype_string(t)) for n, t in out]
    schema = T.StructType(fields)
    arrow, n = to_arrow_schema(schema), len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple]:
            at, held = None, []
            for batch in batches:
                heads = list(zip(*[c.to_pylist() for c in batch.columns[:n]], strict=True))
                cuts = [i for i in range(len(heads)) if i == 0 or heads[i] != heads[i - 1]]
                for start, end in zip(cuts, [*cuts[1:], len(heads)], strict=True):
                    if heads[start] != at:
                        if held:
                            yield at, held
                        at, held = heads[start], []
                    held.append(batch.slice(start, end - start))
            if held:
                yield at, held

        for at, rows in pairs():
            side, ids, vectors = (pa.concat_arrays([r.column(n + i) for r in rows]) for i in range(3))
            side, ids, flat, size = side.to_numpy(), ids.to_pylist(), vectors.flatten().to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy()
            begin = np.cumsum(size, dtype=np.int64) - size
            for dims in np.unique(size).tolist():
                sides = [np.flatnonzero((side == s) & (size == dims)) for s in (0, 1)]
                alone = not apart and at[-2] == at[-1]
                named = [[ids[i] for i in own.tolist()] for own in sides]
                units = [_unit(flat[begin[own][:, None] + np.arange(dims)]) for own in sides]
                found = kernel(named[0], units[0], named[0] if alone else named[1], units[0] if alone else units[1], alone)
                if found and len(found[0]):
                    columns = [[at[i]] * len(found[0]) for i in range(len(keys))] + list(found)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return sent.select(*group, "side", "id", "v").repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema)


def _highest(likeness: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(row, column, value) of every row's k highest values above minus infinity, the first columns of equals. The matrix is used up."""
    if k > PICKED:
        top = np.argsort(-likeness, axis=1, kind="stable")[:, :k]
        yield from ((i, j, float(likeness[i, j])) for i in range(len(top)) for j in top[i].tolist() if likeness[i, j] > -np.inf)
        return
    every = np.arange(len(likeness))
    for _ in range(min(k, likeness.shape[1])):
        best = likeness.argmax(axis=1)
        value = likeness[every, best]
        yield from ((i, j, x) for i, j, x in zip(every.tolist(), best.tolist(), value.tolist(), strict=True) if x > -np.inf)
        likeness[every, best] = -np.inf


def top_partners(left: DataFrame, right: DataFrame, keys: Names, ident: str, vector: str, k: int) -> DataFrame:
    """``(keys, a, b, rank, similarity)``: the k right rows of the same key most alike to each left row by cosine (0 for a zero vector), itself excluded; the smaller id on ties.

    Null vectors, and vectors of other lengths, meet nothing. The best of every block first, then over the blocks.
    """
    sent, group = _met(left, right, keys, ident, vector)

    def best(a: list, u: np.ndarray, b: list, v: np.ndarray, alone: bool):
        if not a or not b:
            return None
        order = np.argsort(np.array(b, object), kind="stable")
        names, right = [b[i] for i in order], v[order].T
        place = {x: i for i, x in enumerate(names)}
        rows = []
        for start in range(0, len(a), STRIPE):
            likeness = u[start : start + STRIPE] @ right
            own = [(i, place[x]) for i, x in enumerate(a[start : start + STRIPE]) if x in place]
            for i, j in own:
                likeness[i, j] = -np.inf
            for i, j, x in _highest(likeness, k):
                rows.append((a[start + i], names[j], x))
        return list(zip(*rows, strict=True)) if rows else None

    met = _walked(sent, group, keys, left.schema[ident].dataType, [("a", "id"), ("b", "id"), ("similarity", "double")], best, True)
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def linked(rows: DataFrame, keys: Names, ident: str, vector: str, threshold: float, queries: DataFrame | None = None) -> DataFrame:
    """``(a, b)``: edges that connect all rows of a key which links of cosine at least the threshold connect; of each pair of blocks, a spanning forest. Null vectors link with nothing.

    With queries, links are those of the queries with all rows (a query is linked with itself, too).
    """
    sent, group = _met(rows, None, keys, ident, vector) if queries is None else _met(queries, rows, keys, ident, vector)

    def forest(a: list, u: np.ndarray, b: list, v: np.ndarray, alone: bool):
        if not a or not b:
            return None
        names = a if alone else [*a, *b]
        parent = np.arange(len(names))
        for start in range(0, len(a), STRIPE):
            i, j = np.nonzero(u[start : start + STRIPE] @ v.T >= threshold)
            i, j = i + start, j if alone else j + len(a)
            while len(i):  # hooking and pointer jumping
                x, y = parent[i], parent[j]
                apart = x != y
                i, j, x, y = i[apart], j[apart], x[apart], y[apart]
                np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
                while not np.array_equal(parent, parent[parent]):
                    parent = parent[parent]
        moved = np.flatnonzero(parent != np.arange(len(names)))
        return [names[k] for k in moved], [names[parent[k]] for k in moved]

    return _walked(sent, group, keys, rows.schema[ident].dataType, [("a", "id"), ("b", "id")], forest, queries is not None).select("a", "b")


def gate(best: DataFrame, threshold: float) -> DataFrame:
    """Of top_partners: rows whose last partner (the k-th best, or the worst, if there are fewer) reaches the threshold: ``(a, kth)``."""
    return best.groupBy("a").agg(F.min("similarity").alias("kth")).where(F.col("kth") >= threshold)

