"""Label documents: one JSON file for each clip, with its shots. Bad files become quarantine rows, never errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
SOURCES = ("own", "enemy")
SHOT = "struct<time:double,source:string,weapon:string,hard:boolean,note:string>"
SCHEMA = f"version int, clip string, slug string, duration double, sampleRate int, numberOfChannels int, labeledAt string, notes string, complete boolean, shots array<{SHOT}>, _bad string"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """All label files with ``file_name`` and ``reject_reason`` (null for good ones); shots sorted by time, defaults filled in."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = raw.withColumn("file_name", F.col("_metadata.file_name"))
    return rows.withColumn("reject_reason", reject_reason()).select("file_name", "reject_reason", *_defaults(), "labeledAt", "notes", "complete", shots_by_time().alias("shots"))


def reject_reason() -> Column:
    shots = F.coalesce(F.col("shots"), F.array().cast(f"array<{SHOT}>"))
    odd_time = F.exists(shots, lambda s: s["time"].isNull() | F.isnan(s["time"]) | (F.abs(s["time"]) == float("inf")))
    odd_source = F.exists(shots, lambda s: ~F.coalesce(s["source"].isin(*SOURCES), F.lit(False)))
    return (
        F.when(F.col("_bad").isNotNull(), "not a label document")
        .when(~F.coalesce(F.col("version") == VERSION, F.lit(False)), "unknown version")
        .when(F.coalesce(F.col("slug"), F.lit("")) == "", "no slug")
        .when(F.col("shots").isNull(), "no shots")
        .when(odd_time, "shot without a finite time")
        .when(odd_source, "shot of unknown source")
    )


def _defaults() -> list[Column]:
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0).cast(kind)).alias(c)
    return [F.col("version"), F.col("clip"), F.col("slug"), zero("duration", "double"), zero("sampleRate", "int"), zero("numberOfChannels", "int")]


def shots_by_time() -> Column:
    filled = F.transform("shots", lambda s: F.struct(s["time"].alias("time"), s["source"].alias("source"), s["weapon"].alias("weapon"), F.coalesce(s["hard"], F.lit(False)).alias("hard"), s["note"].alias("note")))
    ordinal = F.transform(filled, lambda s, i: F.struct(s["time"].alias("t"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(ordinal), lambda x: x["s"])


def corpus(labels: DataFrame, complete: bool = True, only: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents that are good, complete if asked for, and among ``only`` if given; skipped ``(file_name, reason)``)."""
    chosen = labels.where(F.col("slug").isin(*only) | F.col("slug").isNull()) if only else labels
    good = chosen.where("reject_reason IS NULL")
    kept = good.where(F.coalesce("complete", F.lit(False))) if complete else good
    return kept.drop("reject_reason"), chosen.where("reject_reason IS NOT NULL").select("file_name", F.col("reject_reason").alias("reason"))


def shots(documents: DataFrame, source: str | None = None) -> DataFrame:
    """``(slug, ord, t, source, weapon, hard, note)``, one row for each shot."""
    rows = documents.select("slug", F.posexplode("shots").alias("ord", "s")).select("slug", "ord", F.col("s.time").alias("t"), "s.source", "s.weapon", "s.hard", "s.note")
    return rows.where(F.col("source") == source) if source else rows


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """``(slug, start, end)`` of a JSON object of slugs with their [start, end] pairs."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", "map<string,array<array<double>>>")).alias("slug", "spans"))
    return parsed.select("slug", F.explode("spans").alias("s")).select("slug", F.col("s")[0].alias("start"), F.col("s")[1].alias("end"))


def compare_with_baseline(current: DataFrame, baseline: DataFrame, key: str = "slug", slack: float = 0.0005) -> DataFrame:
    """Every clip's ``f1`` beside the baseline's: ``delta`` and ``worse`` (by more than slack); new clips have null."""
    before = baseline.select(key, F.col("f1").alias("f1_before"))
    joined = current.join(before, key, "left").withColumn("delta", F.col("f1") - F.col("f1_before"))
    return joined.withColumn("worse", F.coalesce(F.col("delta") < -slack, F.lit(False)))


def catalogue(media: DataFrame, labels: DataFrame, cached: DataFrame) -> DataFrame:
    """Media files ``(slug)`` with ``has_labels, has_cache, shot_count, complete``."""
    own = labels.where("reject_reason IS NULL").select("slug", F.size("shots").alias("shot_count"), "complete", F.lit(True).alias("has_labels"))
    held = cached.select("slug").distinct().withColumn("has_cache", F.lit(True))
    joined = media.join(own, "slug", "left").join(held, "slug", "left")
    filled = lambda c, d: F.coalesce(c, F.lit(d)).alias(c)
    return joined.select("slug", filled("has_labels", False), filled("has_cache", False), filled("shot_count", 0), filled("complete", False))
