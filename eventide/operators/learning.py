"""Logistic scoring models fitted by Spark ML and judged on folds that keep groups whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics
from .cuts import checkpointed


def logistic(df: DataFrame, features: Sequence[str], label: str, strength: float = 0.05):
    """Model of standardised features with classes of equal weight. Null and NaN features count as the mean of the rows it is fitted on."""
    value = lambda c: f"nanvl(cast(`{c}` AS double), NULL)"
    sizes = {r[0]: r["count"] for r in df.groupBy(label).count().collect()}  # one row for each class
    means = df.agg(*[F.expr(f"avg({value(c)})").alias(c) for c in features]).first()
    filled = ", ".join(f"coalesce({value(c)}, {float(means[c] or 0.0)!r}D) AS _filled_{i}" for i, c in enumerate(features))
    weight = F.lit(None).cast("double")
    for y, n in sizes.items():
        weight = F.when(F.col(label).eqNullSafe(F.lit(y)), F.lit(sum(sizes.values()) / len(sizes) / n)).otherwise(weight)
    steps = [
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"_filled_{i}" for i in range(len(features))], outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True),
        LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_weight", regParam=strength, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y"),
    ]
    return Pipeline(stages=steps).fit(df.withColumn("_weight", weight))


def scored(model, df: DataFrame, out: str = "p") -> DataFrame:
    """df with the model's probability of label 1."""
    names = [c for c in df.columns if c != out]
    return model.transform(df).withColumn(out, vector_to_array("_p")[1]).select(*names, out)


def cross_scored(df: DataFrame, group: str, features: Sequence[str], label: str, k: int) -> DataFrame:
    """df with ``fold`` and ``p`` from the model of the other folds; folds hold whole groups."""
    df = checkpointed(df)  # each fold's model reads the rows many times
    folded = checkpointed(df.join(metrics.group_folds(df, group, k), group))
    parts = [scored(logistic(folded.where(F.col("fold") != i), features, label), folded.where(F.col("fold") == i)) for i in range(k)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
