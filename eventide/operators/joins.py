"""Range, nearest, as-of and interval joins.

Spark joins on equal keys; a time condition alone would compare a whole key's
rows pairwise. Here time is cut into buckets as wide as the tolerance and the
bucket joins the key, so a hot key's rows meet only their neighbours in time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Names = Sequence[str]


def _bucket(t: Column, width) -> Column:
    return F.floor(t / F.lit(width)).cast("long")


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def within(left: DataFrame, right: DataFrame, keys: Names, t: str, tolerance, how: str = "inner", right_t: str | None = None) -> DataFrame:
    """Join rows of equal keys at most ``tolerance`` apart. Right columns get the prefix ``r_``; how: inner, left, left_semi, left_anti."""
    right_t = right_t or t
    width = max(tolerance, 1) if isinstance(tolerance, int) else tolerance
    near = _prefixed(right, "r_").withColumn("_rb", F.explode(F.array(*[_bucket(F.col("r_" + right_t), width) + d for d in (-1, 0, 1)])))
    placed = left.withColumn("_lb", _bucket(F.col(t), width))
    condition = (F.col("_lb") == F.col("_rb")) & F.col("r_" + right_t).between(F.col(t) - tolerance, F.col(t) + tolerance)
    for k in keys:
        condition = condition & (placed[k] == near["r_" + k])
    return placed.join(near, condition, how).drop("_lb", "_rb")


def range_semi(left: DataFrame, right: DataFrame, keys: Names, t: str, tolerance) -> DataFrame:
    """Left rows that have a right row within the tolerance."""
    return within(left, right, keys, t, tolerance, "left_semi")


def range_anti(left: DataFrame, right: DataFrame, keys: Names, t: str, tolerance) -> DataFrame:
    """Left rows that have none."""
    return within(left, right, keys, t, tolerance, "left_anti")


def _tagged(left: DataFrame, right: DataFrame, keys: Names, t: str, order: Names, right_order: Names) -> DataFrame:
    side = left.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"), F.lit(None).cast("long").alias("_rt"), F.lit(None).cast(right.schema[right_order[0]].dataType).alias("_rid"))
    other = right.select(*keys, F.col(t).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(side.schema["_row"].dataType).alias("_row"), F.col(t).cast("long").alias("_rt"), F.col(right_order[0]).alias("_rid"))
    return side.unionByName(other)


def neighbours(left: DataFrame, right: DataFrame, keys: Names, t: str, right_id: str) -> DataFrame:
    """Every left row with the right rows before (or at) and after (or at) it: ``prev_t, prev_id, next_t, next_id``.

    One shuffle and one sort of the tagged union; of right rows at one time the
    smallest id is taken.
    """
    tagged = _tagged(left, right, keys, t, [], [right_id])
    mark = F.when(F.col("_side") == 0, F.struct(F.col("_rt").alias("t"), F.col("_rid").alias("id")))
    back = Window.partitionBy(*keys).orderBy("_t", F.col("_side"), F.desc("_rid")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.col("_side"), F.desc("_rid")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = tagged.withColumn("_mark", mark).withColumn("_prev", F.last("_mark", ignorenulls=True).over(back)).withColumn("_next", F.last("_mark", ignorenulls=True).over(ahead))
    return found.where("_side = 1").select("_row.*", F.col("_prev.t").alias("prev_t"), F.col("_prev.id").alias("prev_id"), F.col("_next.t").alias("next_t"), F.col("_next.id").alias("next_id"))


def nearest(left: DataFrame, right: DataFrame, keys: Names, t: str, right_id: str, tolerance=None) -> DataFrame:
    """Every left row with its nearest right row: ``near_t, near_id, delta`` (right minus left); the earlier one wins ties.
    Null where there is none, or none within the tolerance."""
    both = neighbours(left, right, keys, t, right_id)
    back, ahead = F.col(t) - F.col("prev_t"), F.col("next_t") - F.col(t)
    use_prev = F.col("next_t").isNull() | (F.col("prev_t").isNotNull() & (back <= ahead))
    out = both.withColumn("near_t", F.when(use_prev, F.col("prev_t")).otherwise(F.col("next_t"))).withColumn("near_id", F.when(use_prev, F.col("prev_id")).otherwise(F.col("next_id")))
    if tolerance is not None:
        far = F.abs(F.col("near_t") - F.col(t)) > tolerance
        out = out.withColumn("near_id", F.when(~far, F.col("near_id"))).withColumn("near_t", F.when(~far, F.col("near_t")))
    return out.withColumn("delta", F.col("near_t") - F.col(t)).drop("prev_t", "prev_id", "next_t", "next_id")


def asof_backward(left: DataFrame, right: DataFrame, keys: Names, t: str, right_id: str) -> DataFrame:
    """Every left row with the last right row at or before it, as ``prev_t, prev_id``."""
    return neighbours(left, right, keys, t, right_id).drop("next_t", "next_id")


def in_intervals(points: DataFrame, intervals: DataFrame, keys: Names, t: str, grid, start: str = "start", end: str = "end", how: str = "inner") -> DataFrame:
    """Join points with the closed intervals of their key that hold them; interval columns get the prefix ``r_``.

    Intervals are laid over a grid of the given width; a point lies in one cell.
    """
    cells = _prefixed(intervals, "r_").withColumn("_cell", F.explode(F.sequence(_bucket(F.col("r_" + start), grid), _bucket(F.col("r_" + end), grid))))
    placed = points.withColumn("_at", _bucket(F.col(t), grid))
    condition = (F.col("_at") == F.col("_cell")) & F.col(t).between(F.col("r_" + start), F.col("r_" + end))
    for k in keys:
        condition = condition & (placed[k] == cells["r_" + k])
    return placed.join(cells, condition, how).drop("_at", "_cell")


def overlapping(left: DataFrame, right: DataFrame, keys: Names, grid, pad=0, how: str = "left_semi", start: str = "start", end: str = "end") -> DataFrame:
    """Left spans that overlap (left_semi), or don't (left_anti), a right span widened by ``pad`` on either side; touching counts."""
    cells = _prefixed(right, "r_").withColumn("r_" + start, F.col("r_" + start) - pad).withColumn("r_" + end, F.col("r_" + end) + pad)
    cells = cells.withColumn("_cell", F.explode(F.sequence(_bucket(F.col("r_" + start), grid), _bucket(F.col("r_" + end), grid))))
    own = [*keys, start, end]
    placed = left.select(*own).distinct().withColumn("_at", F.explode(F.sequence(_bucket(F.col(start), grid), _bucket(F.col(end), grid))))
    condition = (F.col("_at") == F.col("_cell")) & ~((F.col(end) < F.col("r_" + start)) | (F.col(start) > F.col("r_" + end)))
    for k in keys:
        condition = condition & (placed[k] == cells["r_" + k])
    hit = placed.join(cells, condition, "left_semi").select(*own).distinct()
    return left.join(hit, own, how)


def coverage(spans: DataFrame, others: DataFrame, keys: Names, grid, start: str = "start", end: str = "end") -> DataFrame:
    """Spans with ``covered``: the summed overlap with other spans over their width, 1 at most.

    Overlaps are cut at the grid, so each cell adds its own part and no pair counts twice.
    """
    cell = lambda s, e: F.explode(F.sequence(_bucket(s, grid), _bucket(e, grid)))
    own = [*keys, start, end]
    placed = spans.select(*own).distinct().withColumn("_cell", cell(F.col(start), F.col(end)))
    right = _prefixed(others, "r_").withColumn("_r_cell", cell(F.col("r_" + start), F.col("r_" + end)))
    condition = F.col("_cell") == F.col("_r_cell")
    for k in keys:
        condition = condition & (placed[k] == right["r_" + k])
    lo = F.greatest(F.col(start), F.col("r_" + start), F.col("_cell") * grid)
    hi = F.least(F.col(end), F.col("r_" + end), (F.col("_cell") + 1) * grid)
    summed = placed.join(right, condition).groupBy(*own).agg(F.sum(F.greatest(F.lit(0), hi - lo)).alias("_sum"))
    share = F.least(F.lit(1.0), F.coalesce(F.col("_sum"), F.lit(0)) / F.greatest(F.col(end) - F.col(start), F.lit(1)))
    return spans.join(summed, own, "left").withColumn("covered", share).drop("_sum")


def offset_grid(events: DataFrame, candidates: DataFrame, keys: Names, t: str, offsets: Sequence[int], tolerance) -> DataFrame:
    """``(keys, offset, hits)``: for each offset, the events that have a candidate within the tolerance once shifted."""
    grid = F.explode(F.array(*[F.lit(o).cast("long") for o in offsets]))
    shifted = events.select(*keys, F.monotonically_increasing_id().alias("_e"), F.col(t), grid.alias("offset")).withColumn("shifted", F.col(t) + F.col("offset"))
    found = within(shifted, candidates.select(*keys, F.col(t).alias("shifted")), keys, "shifted", tolerance, "left_semi")
    hits = found.groupBy(*keys, "offset").agg(F.count("*").alias("hits"))
    every = events.select(*keys).distinct().withColumn("offset", grid)
    return every.join(hits, [*keys, "offset"], "left").select(*keys, "offset", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def best_offset(grid: DataFrame, keys: Names) -> DataFrame:
    """The offset with most hits for every key; the smaller absolute one wins ties, then the smaller."""
    best = F.max_by(F.struct("offset", "hits"), F.struct(F.col("hits"), -F.abs("offset"), -F.col("offset")))
    return grid.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.offset", "b.hits")


def assign_to_nearest(frames: DataFrame, candidates: DataFrame, keys: Names, t: str, candidate_id: str, frame_id: str, score: str, slack) -> DataFrame:
    """Every candidate with the best score of the frames that have it as their nearest one (within slack): ``(keys, candidate, score, frame)``."""
    taken = nearest(frames, candidates, keys, t, candidate_id, slack).where("near_id IS NOT NULL")
    best = F.max_by(F.struct(F.col(score).alias("score"), F.col(frame_id).alias("frame")), F.struct(F.col(score), -F.col(frame_id)))
    return taken.groupBy(*keys, F.col("near_id").alias("candidate")).agg(best.alias("b")).select(*keys, "candidate", "b.score", "b.frame")


def with_dimension(facts: DataFrame, dimension: DataFrame, on: str, value: str, default) -> DataFrame:
    """Left join with a small dimension table (Spark broadcasts it by its size), with a default for missing keys."""
    return facts.join(dimension, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))
