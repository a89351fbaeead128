"""Rendering of splices: gain curves as linear pieces that meet the samples of their stretch, and outros."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Names = Sequence[str]
#: Samples of a stretch that pieces are dealt to.
STRETCH = 256


def _piece(seq: int, kind: str, begin: Column, end: Column, first: Column, slope: Column) -> Column:
    """One linear piece: gain first + slope x (i - begin) on [begin, end)."""
    value = [F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), begin.cast("long").alias("begin"), end.cast("long").alias("end"), first.cast("double").alias("first"), slope.cast("double").alias("slope")]
    return F.struct(*value)


def pieces(windows: DataFrame, keys: Names, start: str, fade: int, order: Names) -> DataFrame:
    """``(keys, rank, seq, kind, begin, end, first, slope, start)``: the gain curves of splices ``start, insert_end, mute_end, duck_end, total``.

    In turn: the original fades out before the start (scale), the clip stands from start to insert_end with tapered edges (clip),
    silence to mute_end (clip, at 0), then the original ramps up from 0 to duck_end (original), or without that fades in (scale). Later splices go over earlier ones.
    """
    s, e, m, d, n = F.col(start), F.col("insert_end"), F.col("mute_end"), F.col("duck_end"), F.col("total")
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))  # noqa: E731  (a piece without samples has no slope)
    out = F.greatest(F.lit(0), s - fade)
    edge = F.least(F.lit(fade), F.floor((e - s) / 2))
    up, ramp = F.least(n, m + fade), d - m
    one = F.lit(1.0)
    made = F.array(
        _piece(0, "scale", out, s, 1 - over(one, s - out), -over(one, s - out)),
        _piece(1, "clip", s, s + edge, F.lit(0.0), over(one, edge)),
        _piece(2, "clip", s + edge, e - edge, one, F.lit(0.0)),
        _piece(3, "clip", e - edge, e, over(edge - 1, edge), -over(one, edge)),
        _piece(4, "clip", e, m, F.lit(0.0), F.lit(0.0)),
        _piece(5, "original", m, d, F.when(ramp == 1, 1.0).otherwise(0.0), over(one, ramp - 1)),
        _piece(6, "scale", m, F.when(ramp > 0, m).otherwise(up), over(one, up - m), over(one, up - m)),
    )
    rank = F.struct(s.alias("s"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    safe = windows.where((s >= 0) & (e > s))
    return safe.select(*keys, rank.alias("rank"), s.alias("start"), F.explode(made).alias("p")).select(*keys, "rank", "start", "p.*").where("end > begin")


def render(samples: DataFrame, edits: DataFrame, clip: DataFrame, keys: Names) -> DataFrame:
    """samples ``(keys, i, v)`` with the edits of pieces() applied: ``v`` is the spliced value. clip: ``(j, r)``, the clip's samples (beyond them, silence).

    A piece meets only the samples of the stretches that it covers; a sample gathers the few pieces that lie over it, and no series is ever an array.
    """
    placed = samples.withColumn("_stretch", F.expr(f"i div {STRETCH}"))
    laid = edits.select(*[F.col(k).alias("_of_" + k) for k in keys], *[F.col(c).alias("_" + c) for c in ("rank", "seq", "kind", "begin", "end", "first", "slope", "start")])
    laid = laid.withColumn("_cell", F.explode(F.sequence(F.expr(f"_begin div {STRETCH}"), F.expr(f"(_end - 1) div {STRETCH}"))))
    over = (F.col("_stretch") == F.col("_cell")) & (F.col("i") >= F.col("_begin")) & (F.col("i") < F.col("_end"))
    for k in keys:
        over = over & F.col(k).eqNullSafe(F.col("_of_" + k))
    gain = F.col("_first") + F.col("_slope") * (F.col("i") - F.col("_begin"))
    met = placed.join(laid, over).withColumn("_j", F.when(F.col("_kind") == "clip", F.col("i") - F.col("_start")))
    met = met.join(clip.select(F.col("j").cast("long").alias("_j"), F.col("r").cast("double").alias("_r")), "_j", "left")
    step = F.struct(F.col("_rank").alias("rank"), F.col("_seq").alias("seq"), F.col("_kind").alias("kind"), gain.alias("g"), F.coalesce("_r", F.lit(0.0)).alias("r"))
    steps = met.groupBy(*[F.col(k).alias("_at_" + k) for k in keys], F.col("i").alias("_at")).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    same = samples["i"] == steps["_at"]
    for k in keys:
        same = same & samples[k].eqNullSafe(steps["_at_" + k])
    joined = samples.join(steps, same, "left")
    fold = lambda v, x: F.when(x["kind"] == "scale", v * x["g"]).when(x["kind"] == "clip", x["r"] * x["g"]).otherwise(F.col("v") * x["g"])
    new = F.aggregate(F.coalesce(F.col("_steps"), F.array().cast(steps.schema["_steps"].dataType)), F.col("v").cast("double"), fold)
    return joined.select(*keys, "i", new.alias("v"))


def with_outro(samples: DataFrame, sound: DataFrame, keys: Names, length: int, gain: float) -> DataFrame:
    """samples with ``length`` more after every series' last: the sound ``(j, r)`` times gain, held within -1 and 1, then silence."""
    ends = samples.groupBy(*keys).agg(F.max("i").alias("_last"))
    tail = ends.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, length) - 1).cast("long"))))
    tail = tail.join(sound.select(F.col("j").cast("long").alias("j"), F.col("r").cast("double").alias("_r")), "j", "left")
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("_r", F.lit(0.0)) * gain))
    return samples.select(*keys, "i", "v").unionByName(tail.select(*keys, (F.col("_last") + 1 + F.col("j")).alias("i"), value.alias("v")))
