"""Window operators over time-stamped events and sampled series.

Every operator takes the key columns that part the series and the columns that
order it totally, and is a composition of Spark window functions: one shuffle
on the keys, shared by consecutive operators on the same keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

Names = Sequence[str]


def ordered(keys: Names, order: Names) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def so_far(keys: Names, order: Names) -> WindowSpec:
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def sessionize(df: DataFrame, keys: Names, t: str, gap, order: Names = (), run: str = "run_id") -> DataFrame:
    """Number the runs (from 1): a row joins the run of the one before if it comes at most ``gap`` later."""
    order = [t, *order]
    before = F.lag(t).over(ordered(keys, order))
    fresh = F.when(F.col(t) - before <= gap, 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn(run, F.sum("_fresh").over(so_far(keys, order)).cast("long")).drop("_fresh")


def session_runs(df: DataFrame, keys: Names, t: str, gap, order: Names = ()) -> DataFrame:
    """``(keys, run_id, n, start, end)`` of the runs."""
    return sessionize(df, keys, t, gap, order).groupBy(*keys, "run_id").agg(F.count("*").alias("n"), F.min(t).alias("start"), F.max(t).alias("end"))


def run_kinds(df: DataFrame, keys: Names, t: str, gap, fast_period, fast_min: int = 4, order: Names = ()) -> DataFrame:
    """session_runs with ``period`` (median gap within the run) and ``kind``: single, fast or countable."""
    runs = sessionize(df, keys, t, gap, order)
    inner = F.col(t) - F.lag(t).over(ordered([*keys, "run_id"], [t, *order]))
    found = runs.withColumn("_gap", inner).groupBy(*keys, "run_id").agg(F.count("*").alias("n"), F.min(t).alias("start"), F.max(t).alias("end"), F.percentile("_gap", 0.5).alias("period"))
    kind = F.when(F.col("n") == 1, "single").when((F.col("period") <= fast_period) & (F.col("n") >= fast_min), "fast").otherwise("countable")
    return found.withColumn("kind", kind)


def isolated(df: DataFrame, keys: Names, t: str, gap, order: Names = ()) -> DataFrame:
    """Rows whose gaps on either side both exceed ``gap`` (an end of the series is infinitely far)."""
    w = ordered(keys, [t, *order])
    before, after = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
    return df.withColumn("_before", before).withColumn("_after", after).where(((F.col("_before") > gap) | F.col("_before").isNull()) & ((F.col("_after") > gap) | F.col("_after").isNull())).drop("_before", "_after")


def coalesce_spans(df: DataFrame, keys: Names, start: str, end: str, gap=0, order: Names = ()) -> DataFrame:
    """Merge spans of a key that overlap or lie at most ``gap`` apart: ``(keys, span_id, start, end, n)``."""
    order = [start, end, *order]
    reach = F.max(end).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(start) - reach <= gap, 0).otherwise(1)
    numbered = df.withColumn("_fresh", fresh).withColumn("span_id", F.sum("_fresh").over(so_far(keys, order)).cast("long"))
    return numbered.groupBy(*keys, "span_id").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def islands(df: DataFrame, keys: Names, order: Names, value: str, island: str = "island") -> DataFrame:
    """Number the stretches (from 1) in which the value stays equal; nulls are equal to each other."""
    before = F.lag(F.struct(value)).over(ordered(keys, order))
    fresh = F.when(before.isNotNull() & before[value].eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn(island, F.sum("_fresh").over(so_far(keys, order)).cast("long")).drop("_fresh")


def run_lengths(df: DataFrame, keys: Names, order: Names, value: str) -> DataFrame:
    """Run-length encoding: ``(keys, island, value, n)``."""
    return islands(df, keys, order, value).groupBy(*keys, "island", value).agg(F.count("*").alias("n"))


def with_run_length(df: DataFrame, keys: Names, order: Names, value: str, out: str = "run_length") -> DataFrame:
    """Every row with the length of the stretch of equal values it lies in."""
    numbered = islands(df, keys, order, value, "_island")
    return numbered.withColumn(out, F.count("*").over(Window.partitionBy(*keys, "_island"))).drop("_island")


def change_points(df: DataFrame, keys: Names, order: Names, value: str) -> DataFrame:
    """Rows that differ from the one before, the first of each key included."""
    before = F.lag(value).over(ordered(keys, order))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def counter_drops(df: DataFrame, keys: Names, order: Names, value: str, max_step: int = 3) -> DataFrame:
    """Rows with ``delta`` from the read before and its ``kind``: reload (up), event (down 1),
    interpolated (down 2 to max_step), skipped (down further), steady, first."""
    delta = F.col(value) - F.lag(value).over(ordered(keys, order))
    kind = (
        F.when(F.col("delta").isNull(), "first").when(F.col("delta") > 0, "reload").when(F.col("delta") == 0, "steady")
        .when(F.col("delta") == -1, "event").when(F.col("delta") >= -max_step, "interpolated").otherwise("skipped")
    )
    return df.withColumn("delta", delta).withColumn("kind", kind)


def counter_events(df: DataFrame, keys: Names, order: Names, t: str, value: str, max_step: int = 3) -> DataFrame:
    """One row for each unit that a counter drops by (at most max_step at once): ``(keys, at, of, nth)``,
    spread evenly between the two reads."""
    before = F.lag(t).over(ordered(keys, order))
    dropped = counter_drops(df.withColumn("_t0", before), keys, order, value, max_step).where(F.col("kind").isin("event", "interpolated"))
    units = dropped.withColumn("of", (-F.col("delta")).cast("long")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("of"))))
    return units.select(*keys, (F.col("_t0") + (F.col(t) - F.col("_t0")) * F.col("nth") / F.col("of")).alias("at"), "of", "nth")


def despike3(value: str, keys: Names, order: Names) -> Column:
    """Median of a sample and its two neighbours; ends stay."""
    w = ordered(keys, order)
    a, b, c = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
    return F.when(a.isNull() | c.isNull(), b).otherwise(F.greatest(F.least(a, b), F.least(F.greatest(a, b), c)))


def stabilize(df: DataFrame, keys: Names, order: Names, value: str, min_run: int = 2, out: str = "stable") -> DataFrame:
    """A value holds from the start of its first stretch of min_run equal reads; shorter stretches keep the value before."""
    held = with_run_length(df, keys, order, value, "_n")
    trusted = F.when(F.col("_n") >= min_run, F.col(value))
    return held.withColumn("_trusted", trusted).withColumn(out, F.last("_trusted", ignorenulls=True).over(so_far(keys, order))).drop("_n", "_trusted")


def floor_quantile(sorted_values: Column, q: float) -> Column:
    """``sorted[min(n - 1, floor(n q))]`` of a sorted array, null if empty."""
    n = F.size(sorted_values)
    return F.when(n > 0, F.get(sorted_values, F.least(n - 1, F.floor(n * F.lit(q)).cast("int"))))


def upper_median(sorted_values: Column) -> Column:
    """``sorted[floor(n / 2)]``."""
    return floor_quantile(sorted_values, 0.5)


def local_threshold(value: str, keys: Names, order: Names, rows: int, k: float, floor: float, warm_up: bool = False) -> Column:
    """Robust threshold from the ``rows`` values before: median + k * IQR / 1.349, floor at least.

    With warm_up the first ``rows`` rows of a key use the first ``rows`` values, later ones included.
    """
    w = ordered(keys, order)
    history = F.sort_array(F.collect_list(value).over(w.rowsBetween(-rows, -1)))
    if warm_up:
        head = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        first = F.sort_array(F.first(F.collect_list(value).over(w.rowsBetween(0, rows - 1))).over(head))
        history = F.when(F.row_number().over(w) <= rows, first).otherwise(history)
    spread = (floor_quantile(history, 0.75) - floor_quantile(history, 0.25)) / 1.349
    return F.greatest(F.lit(floor), F.coalesce(upper_median(history) + k * spread, F.lit(floor)))


def centered_median(value: str, keys: Names, order: Names, half: int) -> Column:
    """Upper median of up to ``half`` rows on either side, truncated at the ends."""
    return upper_median(F.sort_array(F.collect_list(value).over(ordered(keys, order).rowsBetween(-half, half))))


def around(keys: Names, t: str, before, after) -> WindowSpec:
    """Rows of a key at most ``before`` earlier and ``after`` later, in units of t."""
    return Window.partitionBy(*keys).orderBy(t).rangeBetween(-before, after)


def edge_shift(value: str, keys: Names, order: Names, n: int) -> Column:
    """The value n rows later (earlier if negative), held at the ends of the series."""
    w = ordered(keys, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if n == 0:
        return F.col(value)
    moved = F.lead(F.struct(value), n).over(w) if n > 0 else F.lag(F.struct(value), -n).over(w)
    end = F.last(value).over(whole) if n > 0 else F.first(value).over(whole)
    return F.when(moved.isNotNull(), moved[value]).otherwise(end)


def lag_features(df: DataFrame, keys: Names, order: Names, value: str, reach: int = 3) -> DataFrame:
    """Columns ``m<reach> .. m1, z0, p1 .. p<reach>`` (held at the ends) with rise, decay, over_min and post_pre."""
    names = {n: (f"m{-n}" if n < 0 else "z0" if n == 0 else f"p{n}") for n in range(-reach, reach + 1)}
    out = df.withColumns({name: edge_shift(value, keys, order, n) for n, name in names.items()})
    pre = [F.col(names[n]) for n in range(-reach, 0)]
    post = [F.col(names[n]) for n in range(1, reach + 1)]
    mean = lambda xs: sum(xs[1:], xs[0]) / len(xs)
    return out.withColumns({
        "rise": F.col("z0") - F.col("m1"),
        "decay": F.col("z0") - F.col("p1"),
        "over_min": F.col("z0") - F.least(*pre, F.col("z0"), *post),
        "post_pre": mean(post) - mean(pre),
    })


def local_maxima(df: DataFrame, keys: Names, order: Names, value: str, threshold: float) -> DataFrame:
    """Rows at the threshold or above that are no lower than either neighbour; ends are none."""
    w = ordered(keys, order)
    peaks = df.withColumn("_a", F.lag(value).over(w)).withColumn("_c", F.lead(value).over(w))
    return peaks.where((F.col(value) >= threshold) & (F.col(value) >= F.col("_a")) & (F.col(value) >= F.col("_c"))).drop("_a", "_c")


def rectified_difference(value: str, keys: Names, order: Names) -> Column:
    """Rise from the sample before, 0 where it falls and at the start."""
    return F.greatest(F.lit(0.0), F.coalesce(F.col(value) - F.lag(value).over(ordered(keys, order)), F.lit(0.0)))


def hot_intervals(df: DataFrame, keys: Names, t: str, score: str, threshold: float, step: float, gap: float, order: Names = ()) -> DataFrame:
    """Intervals of frames at the threshold or above: ``(keys, run_id, start, end, peak, score, runs)``.

    Frames join at gaps up to max(1.5 step, gap); runs counts the stretches without a missing frame.
    """
    hot = sessionize(df.where(F.col(score) >= threshold), keys, t, max(1.5 * step, gap), order)
    inner = F.col(t) - F.lag(t).over(ordered([*keys, "run_id"], [t, *order]))
    best = F.max_by(F.col(t), F.struct(F.col(score), -F.col(t)))
    return hot.withColumn("_gap", inner).groupBy(*keys, "run_id").agg(F.min(t).alias("start"), F.max(t).alias("end"), best.alias("peak"), F.max(score).alias("score"), (F.count(F.when(F.col("_gap") > 1.5 * step, 1)) + 1).alias("runs"))


def worst_hole(df: DataFrame, run_keys: Names, t: str, start: str, end: str, within: str) -> DataFrame:
    """Longest stretch of a run ``[start, end]`` without a row for which ``within`` holds (edges count; none at all: length + 1)."""
    marks = df.where(F.col(within))
    inner = F.col(t) - F.lag(t).over(ordered(run_keys, [t]))
    held = marks.withColumn("_gap", inner).groupBy(*run_keys).agg(F.max("_gap").alias("_inner"), F.min(t).alias("_first"), F.max(t).alias("_last"))
    runs = df.select(*run_keys, start, end).distinct().join(held, list(run_keys), "left")
    hole = F.greatest(F.coalesce("_inner", F.lit(0)), F.col("_first") - F.col(start), F.col(end) - F.col("_last"), F.lit(0))
    return runs.select(*run_keys, F.when(F.col("_first").isNull(), F.col(end) - F.col(start) + 1).otherwise(hole).alias("hole"))


def carry_forward(value: str, keys: Names, order: Names) -> Column:
    """The last value that isn't null."""
    return F.last(value, ignorenulls=True).over(so_far(keys, order))


def first_of(df: DataFrame, keys: Names, order: Names) -> DataFrame:
    """The first row of every key."""
    return df.withColumn("_n", F.row_number().over(ordered(keys, order))).where("_n = 1").drop("_n")


def top_rows(df: DataFrame, keys: Names, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The n first rows of every key with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)
