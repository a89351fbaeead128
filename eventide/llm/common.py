"""Shared pieces of the training-data operators: durable lineage cuts,
connected components, distributed ranks and prefix sums."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.cuts import checkpointed, shared_folder  # noqa: F401

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 500, mb: int = 2) -> None:
    """Bound the Arrow batches that Python workers get, in rows and bytes: texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def any_of(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of every node with an edge; component = smallest node reachable.

    Alternating large-star / small-star contraction. All neighbourhood work is
    a ``min`` aggregate plus an equi join, so no node's neighbours are ever
    gathered in one place; every round is checkpointed. Edges with a null end
    and self-loops are ignored; no edges give no rows.
    """
    edges = (
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    edges = checkpointed(edges)
    mark = _fingerprint(edges)
    before = None
    while mark != before and mark[0]:  # every round that changes anything lowers a label, so it settles
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .select(F.explode(F.array(F.struct("lo", "m"), F.struct(F.col("hi").alias("lo"), "m"))).alias("e"))
            .select(F.col("e.lo").alias("hi"), F.col("e.m").alias("lo"))
            .where("hi != lo")
            .distinct()
        )
        edges = checkpointed(small)
        before, mark = mark, _fingerprint(edges)
    nodes = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast(T.DecimalType(38, 0)))).first())


def prefix_sums(df: DataFrame, keys: list[str], order: str, value: str, buckets: int) -> DataFrame:
    """Adds ``start``: the sum of ``value`` over the rows of the same keys that come
    before in ``order`` (a uniform 64-bit hash), without one task per key.

    Rows are cut into ``buckets`` ranges of the hash; bucket totals (keys x
    buckets rows) are summed along the key, rows only within their bucket.
    Ties of ``order`` fall in one bucket and are broken by the value.
    """
    width = 2**64 // buckets + 1
    df = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(float(width))).cast("int"))
    totals = df.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(order, value).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return df.join(totals, [*keys, "_bucket"]).withColumn("start", F.col("_before") + F.col("_within")).drop("_bucket", "_before", "_within")
