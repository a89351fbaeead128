"""Signal operators: frames are rows, spectra come from a small Arrow function, everything after is windows and joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators import windows as w


def frames(audio: DataFrame, size: int, hop: int, samples: str = "samples", key: str = "slug") -> DataFrame:
    """``(key, i, frame)``: overlapping stretches of a clip's samples; a tail shorter than size is left out."""
    n = F.floor((F.size(samples) - size) / hop).cast("int")
    rows = audio.where(F.size(samples) >= size).withColumn("i", F.explode(F.sequence(F.lit(0), n)))
    return rows.select(key, "i", F.slice(samples, F.col("i") * hop + 1, F.lit(size)).alias("frame"))


def magnitudes(frame: Column, size: int) -> Column:
    """Magnitudes of the Hann-windowed spectrum, size / 2 bins."""
    window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(size) / (size - 1)))

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: np.abs(np.fft.rfft(np.asarray(x, np.float64) * window))[: size // 2])

    return run(frame)


def spectral_flux(spectra: DataFrame, key: str = "slug", order: str = "i", spectrum: str = "spectrum") -> DataFrame:
    """spectra with ``flux`` (summed rises of the bins from the frame before) and ``hfc`` (magnitudes weighted by their bin)."""
    before = F.lag(spectrum).over(w.ordered([key], [order]))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    rises = F.zip_with(F.col(spectrum), F.col("_before"), lambda x, y: F.greatest(x - y, F.lit(0.0)))
    out = spectra.withColumn("_before", before).withColumn("flux", F.when(F.col("_before").isNull(), 0.0).otherwise(total(rises)))
    return out.withColumn("hfc", total(F.transform(spectrum, lambda x, b: x * b))).drop("_before")


def onset_strength(audio: DataFrame, rate: int, size: int = 1024, hop: int = 256, key: str = "slug") -> DataFrame:
    """``(key, i, t, flux, hfc, strength)``: half normalised flux, half normalised rise of the high-frequency content; t is the frame's centre."""
    spectra = frames(audio, size, hop, key=key).withColumn("spectrum", magnitudes(F.col("frame"), size))
    curve = spectral_flux(spectra, key).withColumn("_rise", w.rectified_difference("hfc", [key], ["i"]))
    curve = metrics.with_peak_share(metrics.with_peak_share(curve, [key], "flux", "_flux"), [key], "_rise", "_high")
    strength = (F.col("_flux") + F.col("_high")) / 2
    return curve.select(key, "i", ((F.col("i") * hop + size / 2) / rate).alias("t"), "flux", "hfc", strength.alias("strength"))


def mel_filters(bands: int, size: int, rate: int, low: float, high: float) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over size / 2 bins."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(low), mel(min(high, rate / 2)), bands + 2) / 2595) - 1)
    bins = np.arange(size // 2) * rate / size
    up = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(spectrum: Column, bands: int, size: int, rate: int, low: float = 60.0, high: float = 20_000.0) -> Column:
    filters = mel_filters(bands, size, rate, low, high)

    @F.pandas_udf("array<float>")
    def run(spectra: pd.Series) -> pd.Series:
        return spectra.map(lambda s: np.log(filters @ (np.asarray(s) ** 2) + 1e-10).astype(np.float32))

    return run(spectrum)


def band_zscores(mels: DataFrame, key: str = "slug", order: str = "i", mel: str = "mel") -> DataFrame:
    """Every band of a clip as standard scores over its frames (deviation 0 counts as 1)."""
    long = mels.select(key, order, F.posexplode(mel).alias("band", "x")).withColumn("x", F.col("x").cast("double"))
    scored = metrics.with_zscore(long, [key, "band"], "x", "z")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("band", "z"))), lambda s: s["z"].cast("float"))
    return scored.groupBy(key, order).agg(rows.alias(mel))


def convolve(df: DataFrame, layer: int, kernels: list, bias: list, key: str = "slug", order: str = "i", vector: str = "mel", relu: bool = True) -> DataFrame:
    """One layer of a 1-D convolution over time with same padding: kernels[out][in][k]. Neighbour frames come by lag and lead."""
    width = len(kernels[0][0])
    half, whole = width // 2, w.ordered([key], [order])
    out = df
    for k in range(width):
        d = k - half
        moved = F.col(vector) if d == 0 else (F.lead(vector, d) if d > 0 else F.lag(vector, -d)).over(whole)
        out = out.withColumn(f"_c{layer}_{k}", moved)
    rows = []
    for o, taps in enumerate(kernels):
        total = F.lit(float(bias[o]))
        for k in range(width):
            weights = F.array(*[F.lit(float(taps[i][k])) for i in range(len(taps))])
            part = F.aggregate(F.zip_with(F.col(f"_c{layer}_{k}"), weights, lambda x, a: x.cast("double") * a), F.lit(0.0), lambda s, x: s + x)
            total = total + F.coalesce(part, F.lit(0.0))
        rows.append(F.greatest(total, F.lit(0.0)) if relu else total)
    return out.withColumn(vector, F.array(*rows)).drop(*[f"_c{layer}_{k}" for k in range(width)])


def net_probability(mels: DataFrame, weights: dict, key: str = "slug", order: str = "i", mel: str = "mel") -> DataFrame:
    """``(key, i, p)``: stacked convolutions ``weights['layers'] = [(kernels, bias), ...]``, rectified but for the last, and a sigmoid."""
    out, layers = mels, weights["layers"]
    for n, (kernels, bias) in enumerate(layers):
        out = convolve(out, n, kernels, bias, key, order, mel, relu=n < len(layers) - 1)
    return out.select(key, order, (1 / (1 + F.exp(-F.element_at(mel, 1)))).alias("p"))


def refractory_peaks(curve: DataFrame, key: str, t: str, value: str, threshold: float, gap: float) -> DataFrame:
    """Local maxima at the threshold or above, each at least gap after the last accepted one."""
    peaks = w.local_maxima(curve, [key], [t], value, threshold)
    chained = w.sessionize(peaks, [key], t, gap, (), "_chain")
    row = F.array_sort(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v"))))
    empty = F.array().cast("array<struct<t:double,v:double>>")
    last = lambda kept: F.try_element_at(kept, F.lit(-1))["t"]
    kept = F.aggregate("_x", empty, lambda s, x: F.when((F.size(s) == 0) | (x["t"] - last(s) >= gap), F.array_append(s, x)).otherwise(s))
    return chained.groupBy(key, "_chain").agg(row.alias("_x")).select(key, F.explode(kept).alias("p")).select(key, F.col("p.t").alias(t), F.col("p.v").alias(value))


def background_level(audio: DataFrame, rate: int, half: int, key: str = "slug", samples: str = "samples") -> DataFrame:
    """``(key, i, rms, background)``: RMS in frames of 10 ms and its centred running upper median."""
    size = max(1, rate // 100)
    rms = F.sqrt(F.aggregate("frame", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / size)
    levels = frames(audio, size, size, samples, key).select(key, "i", rms.alias("rms"))
    return levels.withColumn("background", w.centered_median("rms", [key], ["i"], half))


def band_shares(spectrum: Column, cuts: list[int]) -> Column:
    """Shares of a spectrum's energy between bin cuts; zeros for a silent one."""
    energy = F.transform(spectrum, lambda x: x * x)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    parts = [total(F.slice(energy, a + 1, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    whole = sum(parts[1:], parts[0])
    return F.when(whole > 0, F.array(*[p / whole for p in parts])).otherwise(F.array(*[F.lit(0.0) for _ in parts]))
