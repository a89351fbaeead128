"""Scalar functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Round half up, towards plus infinity."""
    return F.floor(x + 0.5).cast("long")


def fnv1a32(text: Column) -> Column:
    """FNV-1a of the characters' codes (of the BMP), as 8 hex digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long"))
    folded = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.lpad(F.lower(F.hex(folded)), 8, "0")


def slug_base(name: Column, limit: int = 48) -> Column:
    """Lower-case ASCII letters and digits joined by single hyphens; extension dropped, ``limit`` characters at most."""
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    joined = F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(joined, "^-+|-+$", ""), 1, limit)


def slugify(name: Column, limit: int = 48) -> Column:
    """slug_base of the name without accents, and the FNV-1a of the name as given."""
    return F.concat_ws("-", slug_base(strip_accents(name), limit), fnv1a32(name))


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks; Spark has no built-in for it."""

    @F.pandas_udf("string")
    def strip(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not 0x300 <= ord(c) <= 0x36F))

    return strip(text)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def integer_gray(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright((r * 77 + g * 150 + b * 29).cast("int"), 8)


def ink(r: Column, g: Column, b: Column, level: int = 190) -> Column:
    """If the brightest channel reaches the level."""
    return F.greatest(r, g, b) >= level


def ramp(x: Column, dead: float, full: float) -> Column:
    """0 up to dead, 1 from full, linear between."""
    return F.when(x <= dead, 0.0).otherwise(F.least(F.lit(1.0), (x - dead) / (full - dead)))


def ownership(flash: Column, recoil: Column) -> Column:
    """Combined score of a flash and a recoil score; 0 without a flash."""
    return F.when(flash <= 0, 0.0).otherwise(F.least(F.lit(1.0), 0.75 * flash + 0.25 * recoil + 0.15 * flash * recoil))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def linear_score(features: dict[str, tuple[float, float, float]], bias: float) -> Column:
    """Logistic score of named features, each (mean, scale, weight); NaN and null count as the mean."""
    total = F.lit(bias)
    for name, (mean, scale, weight) in features.items():
        x = F.nanvl(F.coalesce(F.col(name), F.lit(mean)).cast("double"), F.lit(mean))
        total = total + (x - mean) / scale * weight
    return sigmoid(total)


def hz_to_mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def mel_to_hz(mel: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mel / 2595) - 1)


def ratio_db(a: Column, b: Column, floor: float = 1e-12) -> Column:
    return 10 * F.log10(F.greatest(a, F.lit(floor)) / F.greatest(b, F.lit(floor)))


def prominence_db(amplitude: Column, background: Column) -> Column:
    return 20 * F.log10((amplitude + 1e-9) / (background + 1e-9))


def letterbox(width: Column, height: Column, size: int) -> Column:
    """Struct ``(scale, pad_x, pad_y)`` that fits a picture into a square."""
    scale = F.least(F.lit(size) / width, F.lit(size) / height)
    return F.struct(scale.alias("scale"), ((size - width * scale) / 2).alias("pad_x"), ((size - height * scale) / 2).alias("pad_y"))


def pixel_rect(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Struct of a share-of-picture rectangle in whole pixels, inside the picture and at least one pixel large."""
    left, top = F.least(F.greatest(F.floor(x * width), F.lit(0)), width - 1), F.least(F.greatest(F.floor(y * height), F.lit(0)), height - 1)
    right, bottom = F.least(F.floor((x + w) * width), width), F.least(F.floor((y + h) * height), height)
    return F.struct(left.cast("long").alias("x"), top.cast("long").alias("y"), F.greatest(right - left, F.lit(1)).cast("long").alias("w"), F.greatest(bottom - top, F.lit(1)).cast("long").alias("h"))


def parabola_peak(left: Column, centre: Column, right: Column) -> Column:
    """Sub-sample offset of an extremum from three samples; 0 where it lies more than one sample off."""
    bend = left - 2 * centre + right
    offset = (left - right) / (2 * F.nullif(bend, F.lit(0.0)))
    return F.when(F.abs(offset) <= 1, offset).otherwise(0.0)


def slot_number(t: Column, phase: Column, period: Column) -> Column:
    return js_round((t - phase) / period)


def media_kind(content: Column) -> Column:
    """Container by magic bytes; under 12 bytes unknown."""
    head = F.hex(F.substring(content, 1, 12))
    at = lambda i, n: F.substring(head, 2 * i + 1, 2 * n)
    return (
        F.when(F.length(head) < 24, "unknown")
        .when(at(4, 4) == "66747970", "isobmff")
        .when(at(0, 4) == "1A45DFA3", "webm")
        .when((at(0, 4) == "52494646") & (at(8, 4) == "57415645"), "wav")
        .when(at(0, 4) == "4F676753", "ogg")
        .when((at(0, 3) == "494433") | (at(0, 2).isin("FFFB", "FFF3", "FFF2", "FFFA")), "mp3")
        .otherwise("unknown")
    )


def within_limits(duration: Column, width: Column, height: Column, max_seconds: float = 60, long_side: int = 2560, short_side: int = 1440) -> Column:
    """If a picture's length and sides are allowed; an unknown or endless duration is."""
    finite = ~(F.isnan(duration) | duration.isNull() | (F.abs(duration) == float("inf")))
    return (~finite | (duration <= max_seconds)) & (F.greatest(width, height) <= long_side) & (F.least(width, height) <= short_side)


def resample_linear(values: Column, n: Column) -> Column:
    """n samples of a line through the values, both ends kept."""
    m = F.size(values)
    step = F.when(n > 1, (m - 1) / (n - 1)).otherwise(0.0)

    def at(i: Column) -> Column:
        x = i * step
        low = F.least(F.floor(x), m - 1).cast("int")
        high = F.least(low + 1, m - 1)
        a, b = F.element_at(values, low + 1), F.element_at(values, high + 1)
        return a + (b - a) * (x - low)

    return F.when((m > 0) & (n > 0), F.transform(F.sequence(F.lit(0), n.cast("int") - 1), at)).otherwise(F.array().cast("array<double>"))


def mono(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def hann(n: int) -> Column:
    """Symmetric Hann window."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: 0.5 * (1 - F.cos(2 * 3.141592653589793 * i / (n - 1))))


def trim_bounds(samples: Column, ratio: float) -> Column:
    """Struct ``(first, last)`` of the samples (from 0) that reach ratio times the peak; null if the samples are silent."""
    peak = F.aggregate(samples, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    loud = F.filter(F.transform(samples, lambda x, i: F.when(F.abs(x) >= peak * ratio, i)), lambda i: i.isNotNull())
    return F.when(peak > 0, F.struct(F.element_at(loud, 1).alias("first"), F.element_at(loud, -1).alias("last")))


def frame_index(t: Column, start: Column, fps: float) -> Column:
    """Number of the frame that shows a time."""
    return js_round((t - start) * fps)


def iso_date(t: Column) -> Column:
    """UTC time as ISO text with milliseconds (of a session in UTC)."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def percent(share: Column, digits: int = 1) -> Column:
    """Share as a percentage to show; a null or undefined one is a dash."""
    return F.when(share.isNull() | F.isnan(share), "-").otherwise(F.concat(F.round(share * 100, digits).cast(f"decimal(18,{digits})").cast("string"), F.lit("%")))


def glyph_like(width: Column, height: Column, fill: Column, frame_height: Column) -> Column:
    """If a box may be a character: its height 0.6 to 6 % of the frame's, its width 0.15 to 1.3 of its height, and 0.15 to 0.92 of it filled."""
    share = height / frame_height
    return share.between(0.006, 0.06) & (width / F.nullif(height, F.lit(0))).between(0.15, 1.3) & fill.between(0.15, 0.92)
