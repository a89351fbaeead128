"""Offsets between two series by counted hits, periods by the gaps of spaced peaks, and boxes judged against the truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import folds, joins, streams
from . import windows as w
from .metrics import LOWER, UPPER, order_statistics

Names = Sequence[str]


def _same(keys: Names, prefix: str = "_of_") -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(prefix + k))
    return out


def offset_hits(events: DataFrame, candidates: DataFrame, keys: Names, t: str, ident: str, offsets: Sequence[int], tolerance: int, one_to_one: bool) -> DataFrame:
    """``(keys, offset, hits)``: events that have a candidate within the tolerance once shifted; one_to_one: in order, each candidate for one event only."""
    if not one_to_one:
        return joins.offset_grid(events, candidates, keys, t, offsets, tolerance)
    grid = F.explode(F.array(*[F.lit(int(o)).cast("long") for o in offsets])).alias("offset")
    shifted = events.select(*keys, grid, F.col(ident), F.col(t)).withColumn(t, F.col(t) + F.col("offset"))
    heard = candidates.select(*keys, grid, F.col(ident), F.col(t))
    parts = [*keys, "offset"]
    pairs = folds.match_one_to_one(heard, shifted, parts, t, tolerance, ident).groupBy(*[F.col(p).alias("_of_" + p) for p in parts]).agg(F.count("*").alias("_hits"))
    every = events.select(*keys).distinct().select(*keys, grid)
    return every.join(pairs, _same(parts), "left").select(*parts, F.coalesce("_hits", F.lit(0)).cast("long").alias("hits"))


def estimate_offset(
    events: DataFrame, candidates: DataFrame, keys: Names, t: str, ident: str, offsets: Sequence[int], tolerance: int, one_to_one: bool, gain: float = 1.0, least: int = 0, cap: float = 0.0, unique: float = 0.0, apart: int = 0, margin: int = 2
) -> DataFrame:
    """``(keys, offset, hits, base)``: the offset with most hits of each key, 0 where it isn't trusted. base: the hits without an offset.

    Offsets other than 0 count from ``least`` on, up to ``cap`` times the median gap of the key's events (0: any). The best (the smaller, then the lower, of
    equals; none against as many hits without an offset) must have margin hits and gain times more than base, and ``unique`` more than any counted offset farther than apart from
    it. Keys of fewer than three events, or without candidates, keep 0.
    """
    hits = offset_hits(events, candidates, keys, t, ident, sorted({0, *offsets}), tolerance, one_to_one)
    gap = F.col(t) - F.lag(t).over(w.ordered(keys, [t, ident]))
    gaps = order_statistics(events.select(*keys, gap.alias("_gap")), keys, "_gap", lower=LOWER, upper=UPPER)
    gaps = gaps.select(*[F.col(k).alias("_of_" + k) for k in keys], (F.col("n") + 1).alias("_n"), ((F.col("lower") + F.col("upper")) / 2).alias("_median"))
    some = candidates.select(*[F.col(k).alias("_has_" + k) for k in keys]).distinct().withColumn("_some", F.lit(True))
    met = hits.join(gaps, _same(keys), "left").join(some, _same(keys, "_has_"), "left")
    far = F.lit(cap) * F.col("_median") if cap > 0 else F.lit(float("inf"))
    size = F.abs("offset")
    met = met.withColumn("_open", (size <= far) & ((F.col("offset") == 0) | (size >= least))).withColumn("_able", F.coalesce((F.col("_n") >= 3) & F.col("_some"), F.lit(False)))
    row = F.struct(F.col("offset").alias("o"), F.col("hits").alias("h"))
    found = met.groupBy(*keys).agg(
        F.max(F.when(F.col("offset") == 0, F.col("hits"))).alias("base"), F.first("_able").alias("_able"), F.collect_list(F.when(F.col("_open"), row)).alias("_grid"),
        F.max_by(row, F.when(F.col("_open") | (F.col("offset") == 0), F.struct(F.col("hits").alias("h"), (-size).alias("s"), (-F.col("offset")).alias("o")))).alias("_b"),
    )  # fmt: skip  (one entry for each offset)
    rival = F.coalesce(F.array_max(F.transform(F.filter("_grid", lambda x: F.abs(x["o"] - F.col("_b.o")) > apart), lambda x: x["h"])), F.lit(0))
    trusted = F.col("_able") & (F.col("_b.h") >= F.col("base") + margin) & (F.col("_b.h") >= F.col("base") * gain)
    if unique > 0:
        trusted = trusted & (F.col("_b.h") >= rival + unique)
    return found.select(*keys, F.when(trusted, F.col("_b.o")).otherwise(0).cast("long").alias("offset"), F.when(trusted, F.col("_b.h")).otherwise(F.col("base")).cast("long").alias("hits"), F.col("base").cast("long").alias("base"))


def spaced_maxima(series: DataFrame, keys: Names, order: Names, t: str, value: str, refractory: int) -> DataFrame:
    """``(keys, t)`` of the local maxima (above the value before, not below the one after), each at least refractory after the last one taken."""
    spec = w.ordered(keys, order)
    marked = series.select(*keys, F.col(t).alias("_t"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], ((F.col(value) > F.lag(value).over(spec)) & (F.col(value) >= F.lead(value).over(spec))).alias("_top"))
    kind = series.schema[t].dataType.simpleString()
    names = [f"_o{i}" for i in range(len(order))]
    return streams.streamed(marked.where("_top"), keys, [], names, ["_t", *names], f"`{t}` {kind}", lambda: streams.Spaced(refractory))


def gap_period(times: DataFrame, keys: Names, t: str, periods: Sequence[int], tolerance: int, share: float = 0.6, least: int = 3) -> DataFrame:
    """``(keys, n, period)``: the longest period of which at least share of a key's gaps are whole multiples, null if none is; keys of fewer than ``least`` times are left out."""
    gap = F.col(t) - F.lag(t).over(w.ordered(keys, [t]))
    gaps = times.select(*keys, gap.alias("_gap")).where("_gap IS NOT NULL")
    times_of = lambda p: F.floor(F.col("_gap") / p + 0.5)
    fit = lambda p: F.count_if((times_of(p) >= 1) & (F.abs(F.col("_gap") - times_of(p) * p) <= tolerance))
    counted = gaps.groupBy(*keys).agg(F.count("*").alias("n"), *[fit(p).alias(f"_f{i}") for i, p in enumerate(periods)]).where(F.col("n") >= least - 1)
    first = F.lit(None).cast("long")
    for p, i in sorted((p, i) for i, p in enumerate(periods)):
        first = F.when(F.col(f"_f{i}") >= F.ceil(F.col("n") * share), F.lit(p)).otherwise(first)
    return counted.select(*keys, "n", first.cast("long").alias("period"))


def evaluate_boxes(pairs: DataFrame, keys: Names, found: str, truth: str, miss: float = 0.2) -> DataFrame:
    """``(keys, total, found, median, mean, missed, centred)`` over rows of structs ``x, y, w, h``: a null found box has IoU 0; the median is the upper one; missed: IoU
    under ``miss``; centred: the found box's centre lies in the true one. Rows without a truth don't count."""
    box, real = F.col(found), F.col(truth)
    x, y = box["x"] + box["w"] / 2, box["y"] + box["h"] / 2
    centred = x.between(real["x"], real["x"] + real["w"]) & y.between(real["y"], real["y"] + real["h"])
    judged = pairs.where(real.isNotNull()).select(*keys, box.isNotNull().alias("_found"), F.coalesce(folds.iou(box, real), F.lit(0.0)).alias("_iou"), F.coalesce(centred, F.lit(False)).alias("_centred"))
    sums = judged.groupBy(*[F.col(k).alias("_of_" + k) for k in keys]).agg(F.count("*").alias("total"), F.count_if("_found").alias("found"), F.avg("_iou").alias("mean"), F.count_if(F.col("_iou") < miss).alias("missed"), F.count_if("_centred").alias("centred"))
    middle = order_statistics(judged, keys, "_iou", median=UPPER)
    return middle.join(sums, _same(keys)).select(*keys, "total", "found", "median", "mean", "missed", "centred")


def frame_stats(df: DataFrame, keys: Names, order: Names, value: str, before: int, after: int) -> DataFrame:
    """df with ``mean_abs, deviation, flips`` over the rows from before to after: mean size, population deviation, and the share of neighbours of opposite sign among those that aren't zero."""
    near = w.ordered(keys, order).rowsBetween(-before, after)
    values = F.collect_list(F.coalesce(F.col(value), F.lit(0.0))).over(near)  # before + after + 1 values
    signs = F.filter(F.transform("_near", lambda x: F.signum(x)), lambda s: s != 0)
    turns = F.size(F.filter(F.zip_with(F.slice("_signs", 1, F.greatest(F.size("_signs") - 1, F.lit(0))), F.slice("_signs", 2, F.greatest(F.size("_signs") - 1, F.lit(0))), lambda a, b: a != b), lambda x: x))
    out = df.withColumn("mean_abs", F.avg(F.abs(value)).over(near)).withColumn("deviation", F.stddev_pop(value).over(near)).withColumn("_near", values).withColumn("_signs", signs)
    return out.withColumn("flips", F.when(F.size("_signs") > 1, turns / (F.size("_signs") - 1)).otherwise(0.0)).drop("_near", "_signs")
