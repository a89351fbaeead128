"""Vector similarity, nearest prototypes and gated components, as Column expressions and equi joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Names = Sequence[str]


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision over the common length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two packed longs."""
    return F.bit_count(a.bitwiseXOR(b))


def nearest_prototypes(df: DataFrame, prototypes: DataFrame, ident: str, vector: str, label: str, order: str, keys: Names = ()) -> DataFrame:
    """Every row with the prototype of largest cosine (the first in order on ties): ``near, similarity``.

    prototypes is a small reference set; Spark joins it by its size.
    """
    right = prototypes.select(*[F.col(k).alias("r_" + k) for k in keys], F.col(vector).alias("_pv"), F.col(label).alias("_label"), F.col(order).alias("_ord"))
    condition = F.lit(True)
    for k in keys:
        condition = condition & (F.col(k) == F.col("r_" + k))
    scored = df.join(right, condition).withColumn("_sim", cosine(F.col(vector), F.col("_pv")))
    best = F.max_by(F.struct(F.col("_label").alias("near"), F.col("_sim").alias("similarity")), F.struct(F.col("_sim"), -F.col("_ord")))
    return scored.groupBy(ident).agg(best.alias("b")).select(ident, "b.near", "b.similarity")


def similar_pairs(left: DataFrame, right: DataFrame, keys: Names, ident: str, vector: str) -> DataFrame:
    """``(keys, a, b, similarity)`` of left rows (a stated query set) against all right rows of equal keys, themselves excluded."""
    a = left.select(*keys, F.col(ident).alias("a"), F.col(vector).alias("_va"))
    b = right.select(*keys, F.col(ident).alias("b"), F.col(vector).alias("_vb"))
    return a.join(b, list(keys)).where("a != b").select(*keys, "a", "b", cosine(F.col("_va"), F.col("_vb")).alias("similarity"))


def top_similar(pairs: DataFrame, n: int) -> DataFrame:
    """The n most similar rows to every ``a``, the smaller id on ties."""
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def mean_vector(df: DataFrame, keys: Names, vector: str) -> DataFrame:
    """Element-wise mean of every key's vectors."""
    long = df.select(*keys, F.posexplode(vector).alias("_i", "_x"))
    means = long.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"])
    return means.groupBy(*keys).agg(ordered.alias(vector))


def similarity_gate(pairs: DataFrame, core: DataFrame, k: int, threshold: float) -> DataFrame:
    """Rows whose k-th best similarity to the core (or worst, if it is smaller) reaches the threshold: ``(a, kth)``."""
    own = pairs.join(core.select(F.col("id").alias("b")), "b", "left_semi")
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    n = F.count("*").over(Window.partitionBy("a"))
    ranked = own.withColumn("_r", F.row_number().over(w)).withColumn("_n", n)
    return ranked.where((F.col("_r") == F.least(F.lit(k), F.col("_n"))) & (F.col("similarity") >= threshold)).select("a", F.col("similarity").alias("kth"))
