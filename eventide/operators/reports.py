"""Error analysis of detections: recall of categories, other events, causes of misses and extras, counters and clocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import folds, graphs, joins, windows

Names = Sequence[str]


def _n(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def category_recall(refs: DataFrame, pairs: DataFrame, ident: str, label: Column) -> DataFrame:
    """``(label, total, matched, recall)`` over the categories of the references; the matching is that of all references."""
    found = refs.join(pairs.select(F.col("ref").alias(ident), F.lit(1).alias("_hit")), ident, "left")
    counted = found.groupBy(label.alias("label")).agg(F.count("*").alias("total"), _n(F.col("_hit").isNotNull()).alias("matched"))
    return counted.withColumn("recall", F.col("matched") / F.col("total"))


def score_with_others(refs: DataFrame, others: DataFrame, preds: DataFrame, keys: Names, t: str, tolerance, ident: str) -> DataFrame:
    """``(keys, tp, fp, fn, absorbed, error)``: references have first refusal, then every prediction near an event of
    another kind is absorbed. error is the mean distance of the matched pairs (null if there are none)."""
    pairs = folds.match_one_to_one(refs, preds, keys, t, tolerance, ident)
    spare = preds.join(pairs.select(F.col("pred").alias(ident)), ident, "left_anti")
    absorbed = joins.range_semi(spare, others, list(keys), t, tolerance)
    hits = pairs.groupBy(*keys).agg(F.count("*").alias("tp"), F.avg(F.abs(F.col("pred_t") - F.col("ref_t"))).alias("error"))
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    out = count(refs, "_refs").join(count(preds, "_preds"), list(keys), "full").join(hits, list(keys), "left").join(count(absorbed, "absorbed"), list(keys), "left")
    value = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        *keys, value("tp").alias("tp"), (value("_preds") - value("tp") - value("absorbed")).alias("fp"), (value("_refs") - value("tp")).alias("fn"), value("absorbed").alias("absorbed"), "error"
    )


def extra_causes(refs: DataFrame, others: DataFrame, preds: DataFrame, keys: Names, t: str, tolerance, near, ident: str) -> DataFrame:
    """Unmatched predictions with ``cause``: other (an event of another kind within the tolerance), noise (no reference
    within near), duplicate (the nearest one is matched already) or placement (it is not)."""
    pairs = folds.match_one_to_one(refs, preds, keys, t, tolerance, ident)
    extras = preds.join(pairs.select(F.col("pred").alias(ident)), ident, "left_anti").select(*keys, ident, t)
    marked = refs.join(pairs.select(F.col("ref").alias(ident), F.lit(True).alias("taken")), ident, "left")
    marked = marked.select(*keys, ident, t, F.coalesce("taken", F.lit(False)).alias("taken"))
    close = joins.within(extras, marked, keys, t, near)
    nearest = close.groupBy(ident).agg(F.min_by("r_taken", F.struct(F.abs(F.col(f"r_{t}") - F.col(t)), F.col(f"r_{t}"), F.col(f"r_{ident}"))).alias("_taken"))
    other = joins.range_semi(extras, others, list(keys), t, tolerance).select(ident, F.lit(True).alias("_other"))
    cause = F.when(F.col("_other"), "other").when(F.col("_taken").isNull(), "noise").when(F.col("_taken"), "duplicate").otherwise("placement")
    return extras.join(nearest, ident, "left").join(other, ident, "left").select(*keys, ident, t, cause.alias("cause"))


def miss_causes(refs: DataFrame, confirmed: DataFrame, candidates: DataFrame, keys: Names, t: str, score: str, tolerance, gap, ident: str) -> DataFrame:
    """``(keys, own, hit, no_candidate, rejected, best_rejected, burst, burst_hit, partial)``: what became of the
    references, the best score that was rejected, and the runs of two or more that were found in part only."""
    runs = windows.sessionize(refs, keys, t, gap, [ident], "_run").select(*keys, ident, t, "_run")
    pool = confirmed.select(*keys, t, F.lit(None).cast("double").alias("score")).union(candidates.select(*keys, t, F.col(score).cast("double")))
    near = joins.within(runs, pool, keys, t, tolerance).groupBy(ident).agg(F.max(F.col("r_score").isNull()).alias("_hit"), F.max("r_score").alias("_best"))
    told = runs.join(near, ident, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    lost = ~F.col("_hit")
    by_run = told.groupBy(*keys, "_run").agg(
        F.count("*").alias("n"), _n(F.col("_hit")).alias("got"), _n(lost & F.col("_best").isNull()).alias("none"), _n(lost & F.col("_best").isNotNull()).alias("no"), F.max(F.when(lost, F.col("_best"))).alias("best")
    )
    burst = F.col("n") >= 2
    total = lambda c: F.sum(c).cast("long")
    return by_run.groupBy(*keys).agg(
        total("n").alias("own"), total("got").alias("hit"), total("none").alias("no_candidate"), total("no").alias("rejected"), F.max("best").alias("best_rejected"),
        total(F.when(burst, F.col("n")).otherwise(0)).alias("burst"), total(F.when(burst, F.col("got")).otherwise(0)).alias("burst_hit"), _n(burst & (F.col("got") > 0) & (F.col("got") < F.col("n"))).alias("partial"),
    )


def conservation(df: DataFrame, keys: Names, order: Names, value: str, reserve: str, most: int = 3) -> DataFrame:
    """``(keys, shots, held, reloads, conserved, switches)``: drops of up to most during which the reserve held, and
    rises that the reserve paid for (conserved) or did not (switches). Rows with a null or negative value say nothing of their two steps."""
    spec = windows.ordered(keys, order)
    a, ra, b, rb = F.lag(value).over(spec), F.lag(reserve).over(spec), F.col(value), F.col(reserve)
    steps = df.select(*keys, (b - a).alias("_d"), (ra - rb).alias("_paid"), ((a >= 0) & (b >= 0) & (a != b) & ra.isNotNull() & rb.isNotNull()).alias("_told"))
    shot, rise = F.col("_told") & F.col("_d").between(-most, -1), F.col("_told") & (F.col("_d") > 0)
    paid = F.col("_paid") == F.col("_d")
    return steps.groupBy(*keys).agg(
        _n(shot).alias("shots"), _n(shot & (F.col("_paid") == 0)).alias("held"), _n(rise).alias("reloads"), _n(rise & paid).alias("conserved"), _n(rise & ~paid).alias("switches")
    )


def lasting_slots(df: DataFrame, keys: Names, slot: str, share: float = 0.1, least: int = 8) -> DataFrame:
    """``(keys, slot, n, place)``: slots seen in max(least, floor(share * all)) rows of their key at least, the fullest first."""
    sizes = df.groupBy(*keys, slot).agg(F.count("*").alias("n"))
    total = F.sum("n").over(windows.Window.partitionBy(*keys))
    kept = sizes.withColumn("_all", total).where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("_all") * share))).drop("_all")
    return kept.withColumn("place", F.row_number().over(windows.ordered(keys, [F.desc("n"), slot])))


def edited_marks(marks: DataFrame, added: DataFrame, removed: DataFrame, moved: DataFrame, keys: Names, t: str, ident: str) -> DataFrame:
    """``(keys, ident, t, strength, place)`` of the marks after edits: added ones have strength 1, removed ones go, moved
    ones take the time ``to``; the places follow the final times."""
    every = marks.select(*keys, ident, t, "strength").unionByName(added.select(*keys, ident, t, F.lit(1.0).alias("strength")))
    left = every.join(removed.select(ident), ident, "left_anti").join(moved.select(ident, "to"), ident, "left")
    final = left.select(*keys, ident, F.coalesce("to", t).alias(t), "strength")
    return final.withColumn("place", F.row_number().over(windows.ordered(keys, [t, ident])))


def clock_drift(df: DataFrame, keys: Names, t: str, order: Names) -> DataFrame:
    """``(keys, n, rate, worst, middle)``: rows per unit of time and the largest and upper median distance of a row's
    time from the first plus its number over the rate. A single row, or one time only, has no rate (null) and no drift."""
    spec = windows.ordered(keys, [t, *order])
    numbered = df.select(*keys, F.col(t).alias("_t"), (F.row_number().over(spec) - 1).alias("_i"))
    span = numbered.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_t").alias("_t0"), (F.max("_t") - F.min("_t")).alias("_span"))
    rate = F.when(F.col("_span") > 0, (F.col("n") - 1) / F.col("_span"))
    off = numbered.join(span.withColumn("rate", rate), list(keys)).withColumn("_off", F.coalesce(F.abs(F.col("_t") - F.col("_t0") - F.col("_i") / F.col("rate")), F.lit(0.0)))
    ranked = off.withColumn("_place", F.row_number().over(windows.ordered(keys, ["_off"])) - 1)
    return ranked.groupBy(*keys, "n", "rate").agg(F.max("_off").alias("worst"), F.max(F.when(F.col("_place") == F.floor(F.col("n") / 2), F.col("_off"))).alias("middle"))


def ordinal_pairs(left: DataFrame, right: DataFrame, keys: Names, order: Names, value: str) -> DataFrame:
    """``(keys, place, a, b)``: k-th row with k-th row, for keys that have equally many on both sides."""

    def placed(df: DataFrame, name: str) -> DataFrame:
        sized = df.groupBy(*keys).agg(F.count("*").alias("_size"))
        return df.select(*keys, F.row_number().over(windows.ordered(keys, order)).alias("place"), F.col(value).alias(name)).join(sized, list(keys))

    return placed(left, "a").join(placed(right, "b"), [*keys, "place", "_size"]).drop("_size")


def grid_component(cells: DataFrame, keys: Names, x: str, y: str, corners: bool = False) -> DataFrame:
    """cells ``(keys, x, y)`` of each key's largest component of neighbours by edge (or corner), with its ``size``; of
    equals the one whose first cell in row order is first."""
    nodes = cells.select(*keys, F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")).distinct().withColumn("id", F.struct(*keys, "y", "x"))
    steps = [(1, 0), (0, 1)] + ([(1, 1), (-1, 1)] if corners else [])
    beside = F.explode(F.array(*[F.struct(*keys, (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dx, dy in steps]))
    edges = nodes.select(F.col("id").alias("a"), beside.alias("b")).join(nodes.select(F.col("id").alias("b")), "b")
    found = nodes.join(graphs.components(nodes.select("id"), edges.select("a", "b")), "id")
    sizes = found.groupBy(*keys, "component").agg(F.count("*").alias("size"))
    first = sizes.withColumn("_k", F.row_number().over(windows.ordered(keys, [F.desc("size"), "component"]))).where("_k = 1")
    return found.join(first.drop("_k"), [*keys, "component"]).select(*keys, F.col("x").alias(x), F.col("y").alias(y), "size")
