"""The event metric: labelled runs against predicted marks, after a constant shift is taken out per key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins, windows
from .cuts import checkpointed
from .metrics import LOWER, UPPER, order_statistics


@dataclass(frozen=True)
class EventRules:
    """Limits of the event metric, in units of the time column."""

    gap: int
    tolerance: int
    fast_period: int
    fast_min: int
    hole: int
    excuse: int
    pad: int
    shift_max: int
    min_pairs: int
    grid: int


#: The metric's limits in microseconds of media time.
MEDIA = EventRules(gap=400_000, tolerance=50_000, fast_period=140_000, fast_min=4, hole=500_000, excuse=150_000, pad=200_000, shift_max=250_000, min_pairs=4, grid=1_000_000)


def clip_shift(refs: DataFrame, marks: DataFrame, key: str, t: str, ident: str, limit: int, min_pairs: int) -> DataFrame:
    """``(key, shift)``: median of the marks' deltas to their nearest reference within limit, 0 with fewer than min_pairs of them."""
    near = joins.nearest(marks, refs, [key], t, ident, limit).where("near_t IS NOT NULL")
    found = order_statistics(near.select(key, "delta"), [key], "delta", lower=LOWER, upper=UPPER)
    return found.select(key, F.when(F.col("n") >= min_pairs, (F.col("lower") + F.col("upper")) / 2).otherwise(0.0).alias("shift"))


def rigid_shift(refs: DataFrame, marks: DataFrame, key: str, t: str, ident: str, window: int, least: int = 3) -> DataFrame:
    """``(key, n, shift)``: upper median of the marks' deltas within the window, where there are ``least`` of them."""
    near = joins.nearest(marks, refs, [key], t, ident, window).where("near_t IS NOT NULL")
    return order_statistics(near.select(key, "delta"), [key], "delta", shift=UPPER).where(F.col("n") >= least).select(key, "n", "shift")


def align(marks: DataFrame, shifts: DataFrame, key: str, t: str) -> DataFrame:
    """Marks moved by their key's shift, not before 0."""
    moved = marks.join(shifts.select(key, F.col("shift").alias("_shift")), key, "left")
    return moved.withColumn(t, F.greatest(F.lit(0).cast("long"), F.col(t) + F.floor(F.coalesce("_shift", F.lit(0)) + 0.5).cast("long"))).drop("_shift")


def judge_runs(refs: DataFrame, marks: DataFrame, blind: DataFrame, key: str, t: str, ident: str, rules: EventRules, shift: bool = True) -> tuple[DataFrame, DataFrame]:
    """(runs ``(key, run_id, n, start, end, kind, found, hole, ok)``, extras ``(key, n_extra)``).

    Labelled runs that overlap a padded blind span are left out. A single event
    is right if a mark lies within the tolerance; a fast run if marks leave no
    hole longer than ``rules.hole``; any other if as many marks as events lie within
    its padded span. Marks near no label, run of the fast kind or blind span are extras, counted as runs.
    """
    if shift:
        shifts = clip_shift(refs, marks, key, t, ident, rules.shift_max, rules.min_pairs)
        marks = align(marks, shifts, key, t)
    marks = checkpointed(marks)  # these three are read several times
    runs = checkpointed(windows.run_kinds(refs, [key], t, rules.gap, rules.fast_period, rules.fast_min, [ident]))
    kept = joins.overlapping(runs, blind, [key], rules.grid, rules.pad, "left_anti")
    padded = kept.select(key, "run_id", (F.col("start") - rules.tolerance).alias("start"), (F.col("end") + rules.tolerance).alias("end"), F.col("start").alias("s"), F.col("end").alias("e"))
    held = joins.in_intervals(marks.select(F.col(key), F.col(t)), padded, [key], t, rules.grid)
    held = held.select(F.col("r_" + key).alias(key), F.col("r_run_id").alias("run_id"), F.col("r_s").alias("start"), F.col("r_e").alias("end"), F.col(t), F.lit(True).alias("in_run"))
    held = checkpointed(held)
    counted = held.groupBy(key, "run_id").agg(F.count("*").alias("found"))
    holes = windows.worst_hole(held, [key, "run_id"], t, "start", "end", "in_run")
    judged = kept.join(counted, [key, "run_id"], "left").join(holes.select(key, "run_id", "hole"), [key, "run_id"], "left")
    judged = judged.withColumn("found", F.coalesce("found", F.lit(0)).cast("long")).withColumn("hole", F.coalesce("hole", F.col("end") - F.col("start") + 1).cast("long"))
    ok = F.when(F.col("kind") == "single", F.col("found") >= 1).when(F.col("kind") == "fast", (F.col("found") > 0) & (F.col("hole") <= rules.hole)).otherwise(F.col("found") == F.col("n"))
    judged = judged.withColumn("ok", ok)

    free = joins.range_anti(marks, refs, [key], t, rules.excuse)
    wide = blind.select(key, (F.col("start") - rules.pad).alias("start"), (F.col("end") + rules.pad).alias("end"))
    free = joins.in_intervals(free, wide, [key], t, rules.grid, how="left_anti")
    fast = runs.where("kind = 'fast'").select(key, "start", "end")
    free = joins.in_intervals(free, fast, [key], t, rules.grid, how="left_anti")
    extras = windows.session_runs(free, [key], t, rules.gap, [ident]).groupBy(key).agg(F.count("*").alias("n_extra"))
    return judged, extras


def event_totals(judged: DataFrame, extras: DataFrame, key: str) -> DataFrame:
    """``(key, tp, fp, fn, singles, singles_ok)`` per key."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    single = F.col("kind") == "single"
    by_key = judged.groupBy(key).agg(n(F.col("ok")).alias("tp"), n(~F.col("ok")).alias("fn"), n(single).alias("singles"), n(single & F.col("ok")).alias("singles_ok"))
    joined = by_key.join(extras, key, "full")
    value = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return joined.select(key, value("tp").alias("tp"), value("n_extra").alias("fp"), value("fn").alias("fn"), value("singles").alias("singles"), value("singles_ok").alias("singles_ok"))


def orphan_share(witnesses: DataFrame, events: DataFrame, key: str, t: str, tolerance: int, least: int = 3, limit: float = 0.5) -> DataFrame:
    """``(key, witnesses, orphans, share, rejected)``: witnesses without an event near; a source is rejected when too many are."""
    alone = joins.range_anti(witnesses, events, [key], t, tolerance).groupBy(key).agg(F.count("*").alias("orphans"))
    every = witnesses.groupBy(key).agg(F.count("*").alias("witnesses"))
    out = every.join(alone, key, "left").withColumn("orphans", F.coalesce("orphans", F.lit(0)).cast("long"))
    share = F.col("orphans") / F.col("witnesses")
    return out.withColumn("share", share).withColumn("rejected", (F.col("witnesses") >= least) & (F.col("share") > limit))


def mark_ladder(sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """The marks of the first source in the list that has any for a key, tagged ``source``."""
    tagged = None
    for rank, (name, marks) in enumerate(sources):
        one = marks.withColumn("source", F.lit(name)).withColumn("_rank", F.lit(rank))
        tagged = one if tagged is None else tagged.unionByName(one)
    best = tagged.groupBy(key).agg(F.min("_rank").alias("_best"))
    return tagged.join(best, key).where("_rank = _best").drop("_rank", "_best")


def splice_plan(shots: DataFrame, keys: list[str], t: str, total: int, lead: int, fade: int, budget: int, insert: int, order: tuple | list = ()) -> DataFrame:
    """Per shot ``insert_start, insert_end, mute_end, duck_end``: a replacement of length ``insert``
    begins ``lead`` early, the original is muted under it and ducked for up to ``budget`` after, never beyond the next one or the end."""
    start = F.greatest(F.lit(0), F.col(t) - lead)
    placed = shots.withColumn("insert_start", start)
    following = F.lead("insert_start").over(windows.ordered(keys, ["insert_start", t, *order]))
    bound = F.least(F.coalesce(following, F.lit(total)), F.lit(total))
    insert_end = F.least(F.col("insert_start") + insert, bound)
    out = placed.withColumn("_bound", bound).withColumn("insert_end", insert_end)
    out = out.withColumn("mute_end", F.least(F.col("insert_end") + fade, F.col("_bound")))
    return out.withColumn("duck_end", F.least(F.col("mute_end") + budget, F.col("_bound"))).drop("_bound")


def splice_windows(shots: DataFrame, keys: list[str], t: str, total: int, clip: int, order: tuple | list = (), budget: int | None = None, mute: int | None = None, decay: str | None = None, extension: int = 0) -> DataFrame:
    """Per shot ``insert_end, mute_end, duck_end``, never beyond the next shot or the end; shots without room go.

    The policy is the first that is given: budget (the original fades in over what the clip leaves of it), mute (muted
    for that long, which also ends the clip) or decay (a column: muted until the sound has decayed, at most extension after the clip).
    """
    following = F.lead(t).over(windows.ordered(keys, [t, *order]))
    bound = F.least(F.coalesce(following, F.lit(total)), F.lit(total))
    placed = shots.withColumn("_bound", bound).withColumn("insert_end", F.least(F.col(t) + clip, "_bound"))
    if budget is not None:
        left = F.greatest(F.lit(0), F.lit(budget) - (F.col("insert_end") - F.col(t)))
        out = placed.withColumn("mute_end", F.col("insert_end")).withColumn("duck_end", F.least(F.col("insert_end") + left, "_bound"))
    elif mute is not None:
        out = placed.withColumn("mute_end", F.least(F.col(t) + mute, "_bound"))
        out = out.withColumn("insert_end", F.least("insert_end", "mute_end")).withColumn("duck_end", F.col("mute_end"))
    else:
        out = placed.withColumn("mute_end", F.least(F.greatest("insert_end", F.coalesce(F.col(decay), F.col("insert_end"))), F.col("insert_end") + extension, F.col("_bound")))
        out = out.withColumn("duck_end", F.col("mute_end"))
    return out.where(F.col("insert_end") > F.col(t)).drop("_bound")


def decay_ends(series: DataFrame, keys: list[str], order: list[str], value: str, ratio: float, hold: int, most: int) -> DataFrame:
    """series with ``decay``: rows from a row to where its value has decayed, i.e. the first of ``hold`` rows in a row
    at or under ratio times it; without such, the rows that are left, ``most`` at most. A row of value 0 has decayed at once."""
    ahead = F.collect_list(value).over(windows.ordered(keys, order).rowsBetween(0, most - 1))
    calm = F.transform(F.col("_ahead"), lambda v: v <= F.col("_ahead")[0] * ratio)
    held = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_ahead") - hold + 1)), lambda i: (F.size(F.slice(F.col("_calm"), i, hold)) == hold) & F.forall(F.slice(F.col("_calm"), i, hold), lambda c: c))
    at = F.array_position(held, True)
    out = series.withColumn("_ahead", ahead).withColumn("_calm", calm)
    return out.withColumn("decay", F.when(F.col(value) == 0, 0).when(at > 0, at - 1).otherwise(F.size("_ahead")).cast("long")).drop("_ahead", "_calm")
