"""Detection scoring: precision, recall, rank AUC, sweeps, cross-validated thresholds and the different medians."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cuts import running

Names = Sequence[str]


def precision(tp: Column, fp: Column, n_refs: Column) -> Column:
    """tp / (tp + fp); nothing judged: 1 if there was nothing to find, else 0."""
    return F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.when(n_refs == 0, 1.0).otherwise(0.0))


def recall(tp: Column, fp: Column, n_refs: Column) -> Column:
    """tp / refs; nothing to find: 1 if nothing was judged, else 0."""
    return F.when(n_refs > 0, tp / n_refs).otherwise(F.when(tp + fp == 0, 1.0).otherwise(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def with_scores(counts: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """counts with ``precision, recall, f1``."""
    t, f, n = F.col(tp), F.col(fp), F.col(tp) + F.col(fn)
    out = counts.withColumn("precision", precision(t, f, n)).withColumn("recall", recall(t, f, n))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def score_matches(refs: DataFrame, preds: DataFrame, pairs: DataFrame, keys: Names) -> DataFrame:
    """``(keys, tp, fp, fn)`` per key from the references, the predictions and their matched pairs."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    joined = n(refs, "n_refs").join(n(preds, "n_preds"), list(keys), "full").join(n(pairs, "tp"), list(keys), "left")
    value = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return joined.select(*keys, value("tp").alias("tp"), (value("n_preds") - value("tp")).alias("fp"), (value("n_refs") - value("tp")).alias("fn"))


def totals(counts: DataFrame, by: Names) -> DataFrame:
    """Summed counts and their scores for every value of ``by`` and for all (null): counts first, then ratios."""
    summed = counts.rollup(*by).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return with_scores(summed)


def _same(keys: Names) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col("_of_" + k))
    return out


def _with(df: DataFrame, keys: Names, **aggregates: Column) -> DataFrame:
    """df with aggregates of its keys: partial sums first, then a join with one row a key, so a hot key stays where its rows are."""
    found = df.groupBy(*[F.col(k).alias("_of_" + k) for k in keys]).agg(*[c.alias(name) for name, c in aggregates.items()])
    return df.join(found, _same(keys)).drop(*["_of_" + k for k in keys])


def with_normalized_rank(df: DataFrame, keys: Names, value: str, ties: Names, out: str) -> DataFrame:
    """df with (position - 1) / (n - 1) of a row among its key's by value, ties in their given order; 0 for a lone row."""
    counted = _with(running(df, keys, [value, *ties], _place=F.lit(1)), keys, _n=F.count("*"))
    return counted.withColumn(out, (F.col("_place") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_place", "_n")


def with_peak_share(df: DataFrame, keys: Names, value: str, out: str) -> DataFrame:
    """df with the value over the key's largest one, unchanged where that isn't positive."""
    return _with(df, keys, _top=F.max(value)).withColumn(out, F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(F.col(value))).drop("_top")


def with_zscore(df: DataFrame, keys: Names, value: str, out: str) -> DataFrame:
    """df with the standard score by the population deviation; deviation 0 counts as 1."""
    score = (F.col(value) - F.col("_mean")) / F.coalesce(F.nullif("_dev", F.lit(0.0)), F.lit(1.0))
    return _with(df, keys, _mean=F.avg(value), _dev=F.stddev_pop(value)).withColumn(out, score).drop("_mean", "_dev")


def rank_auc(df: DataFrame, keys: Names, score: str, label: str, least: int = 1) -> DataFrame:
    """``(keys, n_pos, n_neg, auc)`` with tied scores' ranks averaged; null with fewer than ``least`` rows of a class.

    Ties are counted before ranking, so ranks are running sums over distinct scores, range by range.
    """
    by_score = df.groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    ranked = running(by_score, keys, [score], _upto=F.col("n")).withColumn("mean_rank", F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("mean_rank")).alias("r"), F.sum("pos").alias("n_pos"), F.sum(F.col("n") - F.col("pos")).alias("n_neg"))
    p, n = F.col("n_pos"), F.col("n_neg")
    auc = F.when((p >= least) & (n >= least), (F.col("r") - p * (p + 1) / 2) / (p * n))
    return sums.select(*keys, p.cast("long").alias("n_pos"), n.cast("long").alias("n_neg"), auc.alias("auc"))


def extras_at_recall(df: DataFrame, keys: Names, score: str, label: str, ties: Names, target: float) -> DataFrame:
    """By score from the top, where the share of positives found first reaches the target: ``(keys, score, tp, fp, ratio)``."""
    y = F.col(label).cast("long")
    rows = df.select(*keys, F.col(score).alias("_score"), (-F.col(score)).alias("_down"), *ties, y.alias("_y"))
    walked = running(rows, keys, ["_down", *ties], tp=F.col("_y"), fp=1 - F.col("_y")).withColumnRenamed("_score", score)
    every = rows.groupBy(*[F.col(k).alias("_of_" + k) for k in keys]).agg(F.sum("_y").alias("_all"))
    met = walked.join(every, _same(keys)) if keys else walked.crossJoin(every)  # without keys: one row
    reached = met.where((F.col("_all") > 0) & (F.col("tp") >= F.col("_all") * target))
    best = reached.groupBy(*keys).agg(F.min_by(F.struct(F.col(score).alias("score"), "tp", "fp"), F.struct("tp", "fp")).alias("b"))
    return best.select(*keys, "b.*", (F.col("b.fp") / F.col("b.tp")).alias("ratio"))


def sweep(df: DataFrame, keys: Names, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """``(keys, threshold, tp, fp, fn, precision, recall, f1)`` of the rule score >= threshold, for each threshold."""
    y, grid = F.col(label).cast("long"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    each = df.select(*keys, F.col(score).alias("_s"), y.alias("_y"), grid.alias("threshold"))
    hit = F.col("_s") >= F.col("threshold")
    total = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    counts = each.groupBy(*keys, "threshold").agg(total(hit & (F.col("_y") == 1)).alias("tp"), total(hit & (F.col("_y") == 0)).alias("fp"), total(~hit & (F.col("_y") == 1)).alias("fn"))
    return with_scores(counts)


def best_threshold(swept: DataFrame, keys: Names) -> DataFrame:
    """The threshold with the best F1 for every key, the lower one on ties."""
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold")))
    return swept.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """``(group, fold)``: groups in order dealt to k folds, so that no group is split."""
    names = df.select(group).distinct()
    return names.withColumn("fold", ((F.row_number().over(Window.orderBy(group)) - 1) % k).cast("int"))


def cross_validated(df: DataFrame, group: str, score: str, label: str, thresholds: Sequence[float], k: int) -> DataFrame:
    """``(fold, threshold, tp, fp, fn, ...)``: each fold judged at the threshold that is best on the other folds."""
    folded = df.join(group_folds(df, group, k), group)
    per_fold = sweep(folded, ["fold"], score, label, thresholds)
    train = per_fold.select("fold").distinct().withColumnRenamed("fold", "test").join(per_fold, F.col("fold") != F.col("test"))
    sums = with_scores(train.groupBy("test", "threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    chosen = best_threshold(sums.withColumnRenamed("test", "fold"), ["fold"]).select("fold", "threshold")
    return chosen.join(per_fold, ["fold", "threshold"])


def order_statistics(df: DataFrame, keys: Names, value: str, weight: str | None = None, **places: Callable[[Column], Column]) -> DataFrame:
    """``(keys, n, name...)``: for each name the value at a place of the key's sorted values, given as a function of their number n (from 0).
    With weight, a row counts that many times.

    Values are counted before they are ranked, and ranks are running sums over
    ranges, so no task sorts or holds a whole key. Null values don't count; keys without any give no row.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    counted = df.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(value).alias("_v")).agg((F.count("*") if weight is None else F.sum(weight)).alias("_c"))
    upto = running(counted, own, ["_v"], _upto=F.col("_c"))
    sizes = upto.groupBy(*own).agg(F.sum("_c").alias("_n"))
    same = F.lit(True)
    for o in own:
        same = same & upto[o].eqNullSafe(F.col("_of" + o))
    met = upto.join(sizes.select(*[F.col(o).alias("_of" + o) for o in own], "_n"), same)
    at = lambda place: F.max(F.when((place >= F.col("_upto") - F.col("_c")) & (place < F.col("_upto")), F.col("_v")))
    found = met.groupBy(*own).agg(F.first("_n").alias("n"), *[at(place(F.col("_n"))).alias(name) for name, place in places.items()])
    return found.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], "n", *places)


LOWER, UPPER = (lambda n: F.floor((n - 1) / 2)), (lambda n: F.floor(n / 2))


def medians(df: DataFrame, keys: Names, value: str, q: float = 0.9) -> DataFrame:
    """The three kinds: interpolated and upper median, and the floor-index quantile."""
    found = order_statistics(df, keys, value, lower=LOWER, upper=UPPER, quantile=lambda n: F.least(F.floor(n * q), n - 1))
    return found.select(*keys, ((F.col("lower") + F.col("upper")) / 2).alias("median"), "upper", "quantile")


def mad(df: DataFrame, keys: Names, value: str) -> DataFrame:
    """Median of the absolute deviations from the median."""
    middle = lambda rows, v: order_statistics(rows, keys, v, lower=LOWER, upper=UPPER).select(*keys, ((F.col("lower") + F.col("upper")) / 2).alias("_m"))
    centre = middle(df, value).withColumnRenamed("_m", "median")
    off = middle(df.join(centre, list(keys)).withColumn("_d", F.abs(F.col(value) - F.col("median"))), "_d").withColumnRenamed("_m", "mad")
    return centre.join(off, list(keys))


def mode_low(df: DataFrame, keys: Names, value: str, least: int = 2) -> DataFrame:
    """The most frequent value, the lowest on ties, null if seen fewer than ``least`` times."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    top = counted.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("v"), "n"), F.struct(F.col("n"), -F.col(value))).alias("b"))
    return top.select(*keys, F.when(F.col("b.n") >= least, F.col("b.v")).alias("mode"), F.col("b.n").alias("n"))


def shares_within(df: DataFrame, keys: Names, delta: str, limits: dict[str, float]) -> DataFrame:
    """Share of rows whose absolute delta is at most each limit."""
    return df.groupBy(*keys).agg(*[F.avg((F.abs(F.col(delta)) <= x).cast("int")).alias(name) for name, x in limits.items()])


def circular_phase(angle: Column, period: float) -> Column:
    """Aggregate: circular mean of times modulo period."""
    turn = angle * (2 * 3.141592653589793 / period)
    mean = F.atan2(F.sum(F.sin(turn)), F.sum(F.cos(turn))) / (2 * 3.141592653589793) * period
    return F.pmod(mean, F.lit(float(period)))


def otsu_separation(df: DataFrame, keys: Names, value: str, least: int = 6) -> DataFrame:
    """Four times the largest between-class variance of a split of the sorted values, over the squared span; 0 for few rows."""
    # a split between equal values is never better than one beside them, so values are counted first
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    summed = running(counted, keys, ["_v"], _n0=F.col("_c"), _s0=F.col("_c") * F.col("_v"))
    split = _with(summed, keys, _n=F.sum("_c"), _s=F.sum(F.col("_c") * F.col("_v")), _span=F.max("_v") - F.min("_v"))
    n1 = F.col("_n") - F.col("_n0")
    gap = F.col("_s0") / F.col("_n0") - (F.col("_s") - F.col("_s0")) / F.nullif(n1, F.lit(0))
    between = F.col("_n0") * n1 / (F.col("_n") * F.col("_n")) * gap * gap
    out = split.groupBy(*keys).agg(F.max(between).alias("_b"), F.first("_n").alias("n"), F.first("_span").alias("_w"))
    return out.select(*keys, F.when((F.col("n") >= least) & (F.col("_w") > 0), 4 * F.col("_b") / (F.col("_w") * F.col("_w"))).otherwise(0.0).alias("separation"))
