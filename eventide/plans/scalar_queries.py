"""Queries of the scalar functions and of the signal operators, over short series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions import signal
from .common import query, rounded, table

PICTURE = "p AS (SELECT p_partkey AS id, p_partkey % 256 AS r, p_size * 5 AS g, (p_partkey * 7) % 256 AS b, 320 + p_size * 61 AS w, 240 + (p_partkey * 13) % 1900 AS h, CAST(p_retailprice AS DOUBLE) AS v FROM part)"


@query(f"""WITH {PICTURE}, f AS (SELECT *, CASE WHEN v <= 950 THEN 0e0 ELSE least(1, (v - 950) / 803.7e0) END AS flash, CASE WHEN p.r <= 40 THEN 0e0 ELSE least(1, (p.r - 40) / 120) END AS recoil, least(640e0 / w, 640e0 / h) AS scale FROM p),
c AS (SELECT *, least(greatest(CAST(floor(0.1e0 * w) AS BIGINT), 0), w - 1) AS l, least(greatest(CAST(floor(0.7e0 * h) AS BIGINT), 0), h - 1) AS t FROM f)
SELECT id, round(0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b, 6) AS luminance, (r * 77 + g * 150 + b * 29) // 256 AS gray, greatest(r, g, b) >= 190 AS ink, round(flash, 6) AS flash,
  round(CASE WHEN flash <= 0 THEN 0e0 ELSE least(1, 0.75e0 * flash + 0.25e0 * recoil + 0.15e0 * flash * recoil) END, 6) AS owned, round(scale, 6) AS scale, round((640 - w * scale) / 2, 6) AS pad_x, round((640 - h * scale) / 2, 6) AS pad_y,
  l AS x, t AS y, greatest(least(CAST(floor((0.1e0 + 0.3e0) * w) AS BIGINT), w) - l, 1) AS w, greatest(least(CAST(floor((0.7e0 + 0.2e0) * h) AS BIGINT), h) - t, 1) AS h, (v / 20 <= 60) AND greatest(w, h) <= 2560 AND least(w, h) <= 1440 AS allowed FROM c""")
def picture_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """Colours, scores, letterboxes, regions and limits of pictures made of parts."""
    k, n = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf, "part").select(k.alias("id"), (k % 256).alias("r"), (n * 5).alias("g"), (k * 7 % 256).alias("b"), (320 + n * 61).cast("long").alias("w"), (240 + k * 13 % 1900).alias("h"), F.col("p_retailprice").cast("double").alias("v"))
    r, g, b, w, h, v = (F.col(c) for c in ("r", "g", "b", "w", "h", "v"))
    flash, recoil = s.ramp(v, 950.0, 1753.7), s.ramp(r, 40.0, 160.0)
    box, rect = s.letterbox(w, h, 640), s.pixel_rect(F.lit(0.1), F.lit(0.7), F.lit(0.3), F.lit(0.2), w, h)
    found = rows.select(
        "id", s.luminance(r, g, b).alias("luminance"), s.integer_gray(r, g, b).cast("long").alias("gray"), s.ink(r, g, b).alias("ink"), flash.alias("flash"), s.ownership(flash, recoil).alias("owned"),
        box["scale"].alias("scale"), box["pad_x"].alias("pad_x"), box["pad_y"].alias("pad_y"), rect["x"].alias("x"), rect["y"].alias("y"), rect["w"].alias("w"), rect["h"].alias("h"), s.within_limits(v / 20, w, h).alias("allowed"),
    )
    return rounded(found, "luminance", "flash", "owned", "scale", "pad_x", "pad_y")


@query("""WITH e AS (SELECT event_id, value AS v, event_id % 7 - 3 AS d, event_id % 11 AS q FROM events)
SELECT event_id, round(2595 * log10(1 + v / 700), 6) AS mel, round(700 * (pow(10, v / 2595) - 1), 6) AS hz, round(10 * log10(greatest(v, 1e-12) / greatest(q, 1e-12)), 6) AS ratio, round(20 * log10((v + 1e-9) / (q + 1e-9)), 6) AS prominence,
  round(CASE WHEN abs((v - 40) / (2 * nullif(v - 2 * d + 40, 0))) <= 1 THEN (v - 40) / (2 * nullif(v - 2 * d + 40, 0)) ELSE 0 END, 6) AS parabola, CAST(floor((v - 3) / 2.5e0 + 0.5) AS BIGINT) AS slot, CAST(floor(d * 0.5e0 + 0.5) AS BIGINT) AS half,
  round(1 / (1 + exp(-(0.3e0 + (v - 50) / 40 * 0.8e0 + (q - 5) / 3e0 * -0.4e0))), 6) AS score FROM e""")
def signal_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """Mel scale, decibels, parabolas, slots, rounding and a linear score of event values."""
    rows = table(spark, sf, "events").select("event_id", F.col("value").alias("v"), (F.col("event_id") % 7 - 3).cast("double").alias("d"), (F.col("event_id") % 11).cast("double").alias("q"))
    v, d, q = F.col("v"), F.col("d"), F.col("q")
    found = rows.select(
        "event_id", s.hz_to_mel(v).alias("mel"), s.mel_to_hz(v).alias("hz"), s.ratio_db(v, q).alias("ratio"), s.prominence_db(v, q).alias("prominence"), s.parabola_peak(v, d, F.lit(40.0)).alias("parabola"),
        s.slot_number(v, F.lit(3.0), F.lit(2.5)).alias("slot"), s.js_round(d * 0.5).alias("half"), s.linear_score({"v": (50.0, 40.0, 0.8), "q": (5.0, 3.0, -0.4)}, 0.3).alias("score"),
    )
    return rounded(found, "mel", "hz", "ratio", "prominence", "parabola", "score")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings WHERE embedding IS NOT NULL),
r AS (SELECT vec_id, a, list_transform(range(10), lambda i: CAST(i AS DOUBLE) * (len(a) - 1) / 9) AS xs, list_max(list_transform(a, lambda x: abs(x))) AS peak FROM v),
l AS (SELECT *, list_transform(xs, lambda x: a[least(CAST(floor(x) AS INT), len(a) - 1) + 1] + (a[least(CAST(floor(x) AS INT) + 1, len(a) - 1) + 1] - a[least(CAST(floor(x) AS INT), len(a) - 1) + 1]) * (x - floor(x))) AS line, list_filter(range(len(a)), lambda i: abs(a[i + 1]) >= peak * 0.6e0) AS loud FROM r)
SELECT vec_id, round(list_sum(list_transform(range(10), lambda i: line[i + 1] * (i + 1))), 6) AS line, round(list_sum(list_transform(range(32), lambda i: (a[i + 1] + a[i + 33]) / 2 * 0.5e0 * (1 - cos(2 * pi() * i / 31)))), 6) AS tapered, loud[1] AS first, loud[-1] AS last FROM l""")
def short_series(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as sound: resampled, mixed to one channel under a window, and trimmed."""
    rows = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x)
    line = total(F.transform(s.resample_linear(F.col("a"), F.lit(10)), lambda x, i: x * (i + 1)))
    tapered = total(F.zip_with(s.mono(F.slice("a", 1, 32), F.slice("a", 33, 32)), s.hann(32), lambda x, h: x * h))
    ends = s.trim_bounds(F.col("a"), 0.6)
    found = rows.select("vec_id", line.alias("line"), tapered.alias("tapered"), ends["first"].cast("long").alias("first"), ends["last"].cast("long").alias("last"))
    return rounded(found, "line", "tapered")


SIZE, HOP = 16, 8
WAVES = ", ".join(f"({k}, {j}, {math.cos(2 * math.pi * k * j / SIZE) * (h := 0.5 * (1 - math.cos(2 * math.pi * j / (SIZE - 1))))!r}, {math.sin(2 * math.pi * k * j / SIZE) * h!r})" for k in range(SIZE // 2) for j in range(SIZE))


@query(f"""WITH w AS (SELECT * FROM (VALUES {WAVES}) v(k, j, c, q)), x AS (SELECT vec_id, i, k, sum(embedding[i * {HOP} + j + 1] * c) AS re, sum(embedding[i * {HOP} + j + 1] * q) AS im FROM embeddings, range(7) r(i), w WHERE embedding IS NOT NULL GROUP BY vec_id, i, k),
m AS (SELECT vec_id, i, k, sqrt(re * re + im * im) AS m FROM x), d AS (SELECT *, lag(m) OVER (PARTITION BY vec_id, k ORDER BY i) AS b FROM m),
c AS (SELECT vec_id, i, sum(CASE WHEN b IS NULL THEN 0 ELSE greatest(m - b, 0) END) AS flux, sum(m * k) AS hfc FROM d GROUP BY vec_id, i), h AS (SELECT *, greatest(coalesce(hfc - lag(hfc) OVER (PARTITION BY vec_id ORDER BY i), 0), 0) AS rise FROM c),
n AS (SELECT *, max(flux) OVER (PARTITION BY vec_id) AS tf, max(rise) OVER (PARTITION BY vec_id) AS tr FROM h)
SELECT vec_id, i, round((i * {HOP} + {SIZE / 2}) / 100, 6) AS t, round(flux, 5) AS flux, round(hfc, 5) AS hfc, round((CASE WHEN tf > 0 THEN flux / tf ELSE flux END + CASE WHEN tr > 0 THEN rise / tr ELSE rise END) / 2, 5) AS strength FROM n""")
def onset_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as sound: spectral flux, high-frequency content and onset strength of overlapping frames."""
    rows = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("slug"), F.col("embedding").cast("array<double>").alias("samples"))
    found = signal.onset_strength(rows, 100, SIZE, HOP).withColumnRenamed("slug", "vec_id").withColumn("i", F.col("i").cast("long"))
    return found.select("vec_id", "i", F.round("t", 6).alias("t"), *[F.round(c, 5).alias(c) for c in ("flux", "hfc", "strength")])


@query("""WITH f AS (SELECT vec_id, i, sqrt(sum(CAST(embedding[i * 4 + j + 1] AS DOUBLE) ** 2) / 4) AS rms FROM embeddings, range(16) r(i), range(4) q(j) WHERE embedding IS NOT NULL GROUP BY vec_id, i),
b AS (SELECT vec_id, i, rms, list_sort(list(rms) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS near FROM f)
SELECT vec_id, i, round(rms, 6) AS rms, round(near[CAST(floor(len(near) / 2) AS INT) + 1], 6) AS background FROM b""")
def background_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as sound: levels of frames of four samples and their running median."""
    rows = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("slug"), F.col("embedding").cast("array<double>").alias("samples"))
    found = signal.background_level(rows, 400, 3).withColumnRenamed("slug", "vec_id").withColumn("i", F.col("i").cast("long"))
    return rounded(found, "rms", "background")


FIRST = ([[[0.5, -1.0, 0.25], [1.5, 0.0, -0.5]], [[-0.75, 2.0, 1.0], [0.1, 0.3, -0.2]]], [0.05, -0.02])
SECOND = ([[[1.0, 2.0, -1.5], [0.7, -0.4, 0.9]]], [-0.1])


def _layer(source: str, out: str, kernels: list, bias: list, relu: bool) -> str:
    """One convolution in SQL over channels h1, h2 of rows in order."""
    taps = lambda ks: " + ".join(f"{w}e0 * coalesce({('lag', '', 'lead')[k]}{'(' if k != 1 else ''}h{c + 1}{') OVER o' if k != 1 else ''}, 0)" for c, ws in enumerate(ks) for k, w in enumerate(ws))
    sums = ", ".join((f"greatest({taps(ks)} + {b}e0, 0)" if relu else f"{taps(ks)} + {b}e0") + f" AS h{i + 1}" for i, (ks, b) in enumerate(zip(kernels, bias, strict=True)))
    return f"{out} AS (SELECT label, vec_id, {sums} FROM {source} WINDOW o AS (PARTITION BY label ORDER BY vec_id))"


@query(f"""WITH v AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS h1, CAST(embedding[2] AS DOUBLE) AS h2 FROM embeddings WHERE embedding IS NOT NULL), {_layer('v', 'a', *FIRST, True)}, {_layer('a', 'b', *SECOND, False)}
SELECT label, vec_id, round(1 / (1 + exp(-h1)), 6) AS p FROM b""")
def net_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Two stacked convolutions over each label's vectors (their first two entries) and a sigmoid."""
    rows = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select("label", "vec_id", F.slice("embedding", 1, 2).cast("array<double>").alias("mel"))
    return signal.net_probability(rows, {"layers": [FIRST, SECOND]}, "label", "vec_id").withColumn("p", F.round("p", 6))


@query("""SELECT p_partkey FROM part WHERE (p_size % 23 + 1) / (200 + p_partkey % 300) BETWEEN 0.006e0 AND 0.06e0 AND (p_partkey % 17 + 1) / (p_size % 23 + 1) BETWEEN 0.15e0 AND 1.3e0 AND (p_partkey % 101) / 100 BETWEEN 0.15e0 AND 0.92e0""")
def glyph_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Parts whose boxes could be characters."""
    k, n = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").where(s.glyph_like(k % 17 + 1, n % 23 + 1, k % 101 / 100, 200 + k % 300)).select("p_partkey")
