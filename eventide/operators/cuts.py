"""Lineage cuts that outlive executors, and running sums that no task holds a whole key for."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Names = Sequence[str]


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. A folder of this machine is made only where neither the session nor the context names one and all tasks run in this process (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^\[\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="eventide-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ranged(df: DataFrame, keys: Names, order: Names, part: str = "_part") -> DataFrame:
    """df dealt to ranges of ``(keys, order)`` that are numbered upwards in ``part``; rows that are equal in both stay together.

    A hot key is many ranges. The numbers are checkpointed, so that all that is computed from them agrees.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(parts, *keys, *order).withColumn(part, F.spark_partition_id()))


def running(df: DataFrame, keys: Names, order: Names, **sums: Column) -> DataFrame:
    """df with a column for each sum: over the rows of its keys up to its own place in order (equal rows included or not as they come; order should be total).

    Rows are summed within a range; of a range, only its total goes to those after it.
    """
    placed = ranged(df, keys, order)
    totals = placed.groupBy(*keys, "_part").agg(*[F.sum(c).alias("_before_" + name) for name, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = totals.select(*[F.col(k).alias("_of_" + k) for k in keys], F.col("_part").alias("_of_part"), *[F.coalesce(F.sum("_before_" + name).over(earlier), F.lit(0)).alias("_before_" + name) for name in sums])
    here = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = placed.withColumns({"_within_" + name: F.sum(c).over(here) for name, c in sums.items()})
    same = F.col("_part") == F.col("_of_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_of_" + k))
    return within.join(totals, same).select(*[f"`{c}`" for c in df.columns], *[(F.coalesce(F.col("_within_" + name), F.lit(0)) + F.col("_before_" + name)).alias(name) for name in sums])
