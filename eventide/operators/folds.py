"""Order-dependent operators: peaks, suppression, one-to-one matching and slot tracks, as folds that stream over sorted rows.

Series are cut where the state provably resets (matches, suppression and
tracks never reach across a gap above their tolerance); what lies between two
cuts passes through one task with a bounded state, however long it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import streams
from .cuts import checkpointed, running
from .streams import chained, streamed

Names = Sequence[str]
#: Boxes of a group's first tier (twice as many with the one after it).
TIER = 256


def hysteresis_peaks(df: DataFrame, keys: Names, order: Names, t: str, value: str, threshold: float, valley: float) -> DataFrame:
    """``(keys, t, value)`` of the peaks: armed by a value above the threshold, the largest
    value (the first of equals) is emitted when one falls under valley times it, or at the end. Null values are passed over."""
    rows = df.select(*keys, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(t).alias("_t"), F.col(value).cast("double").alias("_v"))
    out = f"`{t}` {df.schema[t].dataType.simpleString()}, `{value}` double"
    return streamed(rows, keys, [], [f"_o{i}" for i in range(len(order))], ["_t", "_v", *[f"_o{i}" for i in range(len(order))]], out, lambda: _FirstTwo(streams.Peaks(threshold, valley)))


class _FirstTwo(streams.Machine):
    """Passes on two columns; the others only sort."""

    def __init__(self, inner: streams.Machine):
        self.inner = inner

    def feed(self, a, b, *_):
        return self.inner.feed(a, b)

    def close(self):
        return self.inner.close()


def suppress(df: DataFrame, keys: Names, t: str, score: str, gap, ident: str) -> DataFrame:
    """Greedy suppression: by score (highest first, then by ident) a row stays unless a kept one is closer than gap. Rows without a score go."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (ident, t, score)}
    rows = chained(df.where(F.col(score).isNotNull()), keys, t, gap)
    return streamed(rows, keys, ["_chain"], [t, ident], [t, score, ident], f"`{ident}` {kinds[ident]}, `{t}` {kinds[t]}, `{score}` {kinds[score]}", lambda: streams.Suppressing(gap))


def merge_close(df: DataFrame, keys: Names, t: str, score: str, gap, ident: str) -> DataFrame:
    """In time order, a row closer than gap to a kept one replaces the first such if it is stronger, else goes. Rows without a score go."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (ident, t, score)}
    rows = chained(df.where(F.col(score).isNotNull()), keys, t, gap)
    merged = streamed(rows, keys, ["_chain"], [t, ident], [t, ident, score], f"`{t}` {kinds[t]}, `{ident}` {kinds[ident]}, `{score}` {kinds[score]}", lambda: streams.Merging(gap))
    return merged.select(*keys, ident, t, score)


def _sides(first: DataFrame, second: DataFrame, keys: Names, t: str, ident: str, reach) -> DataFrame:
    side = lambda df, n: df.select(*keys, F.col(t).alias("t"), F.lit(n).alias("side"), F.col(ident).alias("id"))
    return chained(side(first, 0).unionByName(side(second, 1)), keys, "t", reach)


def match_one_to_one(refs: DataFrame, preds: DataFrame, keys: Names, t: str, tolerance, ident: str) -> DataFrame:
    """Pairs ``(keys, ref, pred, ref_t, pred_t)`` of a largest one-to-one matching within the tolerance.

    Predictions in time order take the earliest reference that is still free
    and lies within the tolerance, which is optimal as all windows are alike.
    """
    both = _sides(refs, preds, keys, t, ident, tolerance)
    kind = both.schema["id"].dataType.simpleString()
    return streamed(both, keys, ["_chain"], ["t", "side", "id"], ["t", "side", "id"], f"ref {kind}, pred {kind}, ref_t long, pred_t long", lambda: streams.Matching(tolerance))


def confirm_in_order(events: DataFrame, candidates: DataFrame, keys: Names, t: str, snap, ident: str, move: bool = False) -> DataFrame:
    """Events with ``candidate`` (null if unconfirmed): in time order each takes the nearest candidate
    within snap that comes after the last one taken. With move the event's time becomes the candidate's."""
    both = _sides(events, candidates, keys, t, ident, snap)
    kind, time = both.schema["id"].dataType.simpleString(), both.schema["t"].dataType.simpleString()
    found = streamed(both, keys, ["_chain"], ["t", "side", "id"], ["t", "side", "id"], f"id {kind}, t {time}, candidate {kind}, ct {time}", lambda: streams.Confirming(snap))
    at = F.coalesce("ct", "t") if move else F.col("t")
    return found.select(*keys, F.col("id").alias(ident), at.alias(t), "candidate")


def track_slots(items: DataFrame, keys: Names, frame: str, ident: str, gap: int, **fit) -> DataFrame:
    """``(keys, frame, ident, track, nth)``: items ``x, y, h`` of frames dealt to tracks, which are named by their first item.

    Frames pass in order, their items by ident. An item goes to the nearest track (|dx| + |dy| from its running means, the older of equals)
    that it fits in place and height and that has no item in this frame, else it opens one. A track that isn't seen for more than gap frames is closed.
    """
    rows = chained(items.select(*keys, frame, ident, *[F.col(c).cast("double").alias(c) for c in "xyh"]), keys, frame, gap)
    kind = {c: items.schema[c].dataType.simpleString() for c in (frame, ident)}
    return streamed(rows, keys, ["_chain"], [frame, ident], [frame, ident, "x", "y", "h"], f"`{frame}` {kind[frame]}, `{ident}` {kind[ident]}, track {kind[ident]}, nth long", lambda: streams.Tracks(gap, **fit))


def cluster_bits(samples: DataFrame, keys: Names, ident: str, bits: str, width: int, reach: float, most: int) -> DataFrame:
    """``(keys, ident, members, prototype)``: greedy clusters of packed bits (a long of up to 63 bits, or decimal), by first member.

    Samples come by ident; each joins the nearest prototype within reach (a share of the width) or begins one, while
    there are fewer than most; the others are left out. prototype: the majority's bits, the lowest first. Null samples are passed over.
    """
    rows = samples.select(*keys, ident, F.col(bits).alias("_bits")).where(F.col("_bits").isNotNull())
    kind = samples.schema[ident].dataType.simpleString()
    return streamed(rows.withColumn("_bits", F.col("_bits").cast("string")), keys, [], [ident], [ident, "_bits"], f"`{ident}` {kind}, members long, prototype string", lambda: _Packed(streams.Leaders(width, reach, most)))


class _Packed(_FirstTwo):
    """Samples as decimal text to whole numbers."""

    def feed(self, ident, sample):
        return self.inner.feed(ident, int(sample))


def suppress_boxes(df: DataFrame, keys: Names, ident: str, score: str, kind: str, limit: float, grid: float = 16.0) -> DataFrame:
    """Boxes ``x, y, w, h`` (corner and size) that stay: by score (then ident), unless one kept of the same kind overlaps by IoU above limit.

    Equal boxes are one from the start: the best stands for them. A group's boxes are decided in tiers by rank, each as large as all before it:
    first those go that a box kept by then overlaps, so that few of a crowded place meet each other. Within a tier boxes meet in the cells of a grid, each pair in one
    cell only, and then in rounds: a box that no undecided better one overlaps stays, and those that it overlaps go; rounds are as many as the longest chain of decisions.
    """
    group = [*keys, kind]
    sides = [F.col(c).cast("double").alias("_" + c) for c in "xywh"]
    rows = df.where(F.col(score).isNotNull()).select(*group, ident, score, *sides)
    flat = rows.where("NOT (_w > 0 AND _h > 0)").select(*group, ident, score)  # overlap nothing
    solid = rows.where("_w > 0 AND _h > 0")
    order = F.struct((-F.col(score)).alias("s"), F.col(ident).alias("id"))
    first = checkpointed(solid.groupBy(*group, "_x", "_y", "_w", "_h").agg(F.min(order).alias("o"))) if limit < 1 else checkpointed(solid.withColumn("o", order))
    ranked = running(first.withColumns({"_s": F.col("o.s"), "_id": F.col("o.id")}), group, ["_s", "_id"], _place=F.lit(1))
    ranked = checkpointed(ranked.withColumn("_tier", F.greatest(F.lit(0), F.floor(F.log2(F.col("_place") / TIER)).cast("int"))))
    kept = None
    for tier in range((ranked.agg(F.max("_tier")).first()[0] or 0) + 1):
        here = ranked.where(F.col("_tier") == tier)
        if kept is not None:
            gone = _overlapping(kept, here, group, limit, grid).select(F.col("b").alias("_id")).distinct()
            here = checkpointed(here.join(gone, "_id", "left_anti"))
        edges, left = checkpointed(_overlapping(here, here, group, limit, grid)), checkpointed(here.select(F.col("_id").alias("id")))
        stay = None
        while True:
            blocked = edges.select(F.col("b").alias("id")).distinct()
            clear = checkpointed(left.join(blocked, "id", "left_anti"))
            stay = clear if stay is None else stay.unionByName(clear)
            if edges.isEmpty():
                break
            gone = edges.join(clear.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
            left = checkpointed(left.join(clear, "id", "left_anti").join(gone, "id", "left_anti"))
            edges = checkpointed(edges.join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi"))
        decided = checkpointed(here.join(stay.select(F.col("id").alias("_id")), "_id", "left_semi").select(*group, "o", "_x", "_y", "_w", "_h"))
        kept = decided if kept is None else kept.unionByName(decided)
    kept = kept.select(F.col("o.id").alias("id"))
    stay = solid.join(kept.select(F.col("id").alias("_id")), solid[ident] == F.col("_id"), "left_semi")
    return stay.select(*group, ident, score).unionByName(flat)


def _overlapping(better: DataFrame, worse: DataFrame, group: Names, limit: float, grid: float) -> DataFrame:
    """``(a, b)``: idents of boxes ``o, _x, _y, _w, _h`` and of those after them in o that they overlap by IoU above limit; each pair meets in one cell."""
    cell = lambda c: F.floor(c / grid).cast("long")

    def named(df: DataFrame, p: str) -> DataFrame:
        laid = df.withColumn("_cx", F.explode(F.sequence(cell(F.col("_x")), cell(F.col("_x") + F.col("_w"))))).withColumn("_cy", F.explode(F.sequence(cell(F.col("_y")), cell(F.col("_y") + F.col("_h")))))
        return laid.select(*[F.col(k).alias(p + k) for k in group], F.col("o").alias(p + "o"), *[F.col(c).alias(p + c) for c in ("_x", "_y", "_w", "_h", "_cx", "_cy")])

    box = lambda p: F.struct(*[F.col(f"{p}_{c}").alias(c) for c in "xywh"])
    same = (F.col("a_cx") == F.col("b_cx")) & (F.col("a_cy") == F.col("b_cy")) & (F.col("ao") < F.col("bo"))
    same = same & (F.col("a_cx") == cell(F.greatest("a_x", "b_x"))) & (F.col("a_cy") == cell(F.greatest("a_y", "b_y")))
    for k in group:
        same = same & F.col("a" + k).eqNullSafe(F.col("b" + k))
    return named(better, "a").join(named(worse, "b"), same).where(iou(box("a"), box("b")) > limit).select(F.col("ao.id").alias("a"), F.col("bo.id").alias("b"))


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (structs x, y, w, h) over their union; 0 for empty ones."""
    across = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    down = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - across * down
    return F.when(union > 0, across * down / union).otherwise(0.0)
