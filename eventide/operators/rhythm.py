"""Rhythm grids: even nodes that are laid through the candidates near a span so that they gain most weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import joins
from .cuts import checkpointed, running

Names = Sequence[str]


def _between(low: Column, high: Column, period: Column) -> tuple[Column, Column]:
    """The whole multiples of the period from low to high, as the first and the last factor."""
    return F.ceil(low / period).cast("long"), F.floor(high / period).cast("long")


def place_grid(
    spans: DataFrame, candidates: DataFrame, keys: Names, span: str, t: str, strength: str, periods: Sequence[int], window: tuple[int, int], tolerance: int, share: float = 0.15, average: float = 0.8, least: float = 0.6
) -> DataFrame:
    """``(keys, span, period, count, support, fit, k, t, filled)``: the nodes of each span's best grid.

    spans hold ``start, end, n``; candidates of the same key come window[0] to window[1] after a span's moments (times are whole numbers). A grid has as many
    nodes as periods fit into the span, rounded, and one more; it passes through a candidate and stays within the tolerance of the candidates'
    range. A node weighs as much as the strongest candidate within the tolerance (or share of the period, if smaller); the grid with most
    2 x weight - count x average wins, then the longer period, the earlier candidate, the earlier node there. Spans of one event, shorter than
    all periods, without candidates, or whose best grid has less than the least share of nodes supported, give no rows. Nodes snap to the nearest candidate
    nearer than the tolerance (filled: false), or stay.

    All grids of a period are judged in one sweep over their start: a candidate adds to a node's weight while the start lies in
    an interval, so weights of all starts are running sums of changes, and no grid is laid out but the best.
    """
    own = [*keys, span]
    wide = spans.where(F.col("n") >= 2).select(*own, "start", "end", (F.col("start") - window[1] - tolerance).alias("from"), (F.col("end") - window[0] + tolerance).alias("to"))
    met = joins.in_intervals(candidates.select(*keys, t, strength), wide, keys, t, max(periods), "from", "to")
    inside = met.groupBy(*keys, F.col("r_" + span).alias(span), F.col("r_start").alias("start"), F.col("r_end").alias("end"), F.col("r_from").alias("from"), F.col("r_to").alias("to"), F.col(t).alias("at"))
    inside = checkpointed(inside.agg(F.max(F.col(strength).cast("double")).alias("s")))
    p = F.col("period")
    each = inside.withColumn("period", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in periods]))).where(p <= F.col("end") - F.col("start"))
    each = each.withColumn("count", (F.floor((F.col("end") - F.col("start")) / p + 0.5) + 1).cast("long"))
    each = each.withColumn("near", F.least(F.lit(tolerance), F.floor(p * share)).cast("long")).withColumn("latest", F.col("to") - (F.col("count") - 1) * p).where("latest >= `from`")
    grid = [*own, "period"]
    # where a candidate supports node j: while the start is within near of at - j * period
    low, high = _between(F.col("at") - F.col("near") - F.col("latest"), F.col("at") + F.col("near") - F.col("from"), p)
    low, high = F.greatest(low, F.lit(0)), F.least(high, F.col("count") - 1)
    held = each.where(F.col("s") > 0).where(low <= high).withColumn("j", F.explode(F.sequence(low, high)))
    held = held.select(*grid, "j", "near", (F.col("at") - F.col("j") * p).alias("place"), "s")
    turns = held.select(*grid, "j", "near", F.explode(F.array(F.col("place") - F.col("near"), F.col("place") + F.col("near") + 1)).alias("x")).distinct()
    others = held.select(*[F.col(c).alias("_" + c) for c in [*grid, "j"]], "place", "s")
    same = (F.col("j") == F.col("_j")) & F.col("place").between(F.col("x") - F.col("near"), F.col("x") + F.col("near"))
    for c in grid:
        same = same & (F.col(c) == F.col("_" + c))
    levels = turns.join(others, same, "left").groupBy(*grid, "j", "x").agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("w"))
    by_node = Window.partitionBy(*grid, "j").orderBy("x")
    before = F.coalesce(F.lag("w").over(by_node), F.lit(0.0))
    changes = levels.select(*grid, "x", (F.col("w") - before).alias("dw"), ((F.col("w") > 0).cast("long") - (before > 0).cast("long")).alias("ds"))
    changes = changes.groupBy(*grid, "x").agg(F.sum("dw").alias("dw"), F.sum("ds").alias("ds"))
    none = F.lit(None).cast("long")
    changes = changes.select(*grid, "x", F.lit(0).alias("ask"), none.alias("anchor"), none.alias("node"), none.alias("count"), "dw", "ds")
    low, high = _between(F.col("at") - F.col("latest"), F.col("at") - F.col("from"), p)
    low, high = F.greatest(low, F.lit(0)), F.least(high, F.col("count") - 1)
    asked = each.where(low <= high).withColumn("node", F.explode(F.sequence(low, high)))
    asked = asked.select(*grid, (F.col("at") - F.col("node") * p).alias("x"), F.lit(1).alias("ask"), F.col("at").alias("anchor"), "node", "count", F.lit(0.0).alias("dw"), F.lit(0).cast("long").alias("ds"))
    swept = running(changes.unionByName(asked), grid, ["x", "ask", "anchor"], weight=F.col("dw"), support=F.col("ds")).where("ask = 1")
    fit = F.round(2 * F.col("weight") - F.col("count") * average, 6)
    best = F.max_by(F.struct("period", "x", "count", "support", fit.alias("fit")), F.struct(fit, p, -F.col("anchor"), -F.col("node")))
    chosen = swept.groupBy(*own).agg(best.alias("b")).select(*own, "b.*").where(F.col("support") >= F.col("count") * least)
    nodes = chosen.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))).withColumn("at", F.col("x") + F.col("k") * p)
    snapped = joins.nearest(nodes, inside.select(*own, "at"), own, "at", "at", tolerance - 1)
    return snapped.select(*own, "period", "count", "support", "fit", "k", F.coalesce("near_t", "at").alias("t"), F.col("near_t").isNull().alias("filled"))
