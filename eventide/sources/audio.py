"""WAV files to and from sample columns; the header is read with Column expressions, samples by one small Arrow function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PCM, IEEE_FLOAT = 1, 3


def _chunks(data: bytes):
    """(name, start, length) of the RIFF chunks, which begin at even places."""
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], at + 8, min(size, len(data) - at - 8)
        at += 8 + size + size % 2


def _samples(data: bytes) -> tuple[int, list[np.ndarray]] | None:
    """(rate, channels) of a RIFF file of PCM 8 to 32 bit or 32-bit floats; None for anything else."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    found = {name: (start, size) for name, start, size in _chunks(data)}
    if b"fmt " not in found or b"data" not in found:
        return None
    f = found[b"fmt "][0]
    kind, channels, rate = int.from_bytes(data[f : f + 2], "little"), int.from_bytes(data[f + 2 : f + 4], "little"), int.from_bytes(data[f + 4 : f + 8], "little")
    bits, (start, size) = int.from_bytes(data[f + 14 : f + 16], "little"), found[b"data"]
    width = bits // 8 * channels
    if not channels or not width:
        return None
    raw = data[start : start + size // width * width]
    if (kind, bits) == (IEEE_FLOAT, 32):
        x = np.frombuffer(raw, "<f4")
    elif (kind, bits) == (PCM, 8):
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif (kind, bits) == (PCM, 16):
        x = np.frombuffer(raw, "<i2") / np.float32(32768)
    elif (kind, bits) == (PCM, 24):
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / np.float32(1 << 23)
    elif (kind, bits) == (PCM, 32):
        x = np.frombuffer(raw, "<i4") / np.float32(2147483648)
    else:
        return None
    return rate, [x[c::channels].astype(np.float32) for c in range(channels)]


def decoded(content: Column) -> Column:
    """Struct ``(sample_rate, channels array<array<float>>)`` of a file's bytes, null if they are no WAV that is known here."""

    @F.pandas_udf("sample_rate int, channels array<array<float>>")
    def run(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_samples(x) or (None, None) for x in files], columns=["sample_rate", "channels"]).astype(object)

    return run(content)


def encoded(channels: Column, rate: Column) -> Column:
    """Bytes of a 16-bit PCM WAV: interleaved, clamped to [-1, 1], negative values scaled by 32768 and others by 32767."""

    @F.pandas_udf("binary")
    def run(clips: pd.Series, rates: pd.Series) -> pd.Series:
        def one(channels, rate) -> bytes:
            x = np.clip(np.stack([np.asarray(c, np.float64) for c in channels], axis=1), -1, 1)
            body = np.where(x < 0, x * 32768, x * 32767).astype("<i2").tobytes()
            n, u4, u2 = len(channels), lambda v: int(v).to_bytes(4, "little"), lambda v: int(v).to_bytes(2, "little")
            head = b"RIFF" + u4(36 + len(body)) + b"WAVEfmt " + u4(16) + u2(PCM) + u2(n) + u4(rate) + u4(rate * n * 2) + u2(n * 2) + u2(16)
            return head + b"data" + u4(len(body)) + body

        return pd.Series([one(c, r) for c, r in zip(clips, rates, strict=True)])

    return run(channels, rate)


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """``(slug, channel, sample_rate, samples)`` of the WAV files of a folder, and none for other files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    slug = F.regexp_extract("path", r"([^/]+)\.wav$", 1)
    rows = files.select(slug.alias("slug"), decoded(F.col("content")).alias("w")).where("w.channels IS NOT NULL")
    return rows.select("slug", F.posexplode("w.channels").alias("channel", "samples"), "w.sample_rate").select("slug", "channel", "sample_rate", "samples")


def synthetic(spark: SparkSession, shots: DataFrame, rate: int, seconds: float, seed: int = 1) -> DataFrame:
    """``(slug, samples)``: decaying noise at the shots' times ``(slug, t)`` over a noise floor, made of expressions over a range of samples."""
    n = int(rate * seconds)
    base = shots.select("slug").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    noise = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "slug", "i"), F.lit(2_000_001)) / 1_000_000 - 1
    loud = shots.select("slug", F.floor(F.col("t") * rate).cast("int").alias("s0")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(rate // 20))))
    loud = loud.select("slug", (F.col("s0") + F.col("k")).alias("i"), F.exp(-F.col("k") / (rate / 100)).alias("gain")).groupBy("slug", "i").agg(F.sum("gain").alias("gain"))
    rows = base.join(loud, ["slug", "i"], "left").withColumn("x", noise(0) * 0.01 + noise(1) * F.coalesce("gain", F.lit(0.0)))
    return rows.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"].cast("float")).alias("samples"))
