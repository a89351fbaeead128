"""Candidate windows, rectangles, neighbours, rhythms, episodes and prominence over event series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import joins, streams
from . import windows as w

Names = Sequence[str]


def candidate_stacks(candidates: DataFrame, frames: DataFrame, keys: Names, t: str, ident: str, offsets: Sequence[int], tolerance: int, frame_id: str) -> DataFrame:
    """Candidates with one frame near each of the offsets: ``(keys, ident, frames)``; those that lack any are left out."""
    grid = F.explode(F.array(*[F.lit(o).cast("long") for o in offsets]))
    wanted = candidates.select(*keys, F.col(ident), F.col(t).alias("_t0"), grid.alias("_offset")).withColumn(t, F.col("_t0") + F.col("_offset"))
    found = joins.nearest(wanted, frames, keys, t, frame_id, tolerance).where("near_id IS NOT NULL")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("_offset", "near_id"))), lambda s: s["near_id"])
    stacks = found.groupBy(*keys, ident).agg(F.count("*").alias("_n"), rows.alias("frames"))
    return stacks.where(F.col("_n") == len(offsets)).drop("_n")


def in_rectangles(points: DataFrame, boxes: DataFrame, keys: Names, grid: int, how: str = "left_semi") -> DataFrame:
    """Points ``x, y`` inside a box ``x0, y0, x1, y1`` of their key. Boxes are laid over a grid; a point lies in one cell."""
    cell = lambda c: F.floor(c / grid).cast("long")
    across = F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1"))))
    laid = boxes.select(*[F.col(k).alias("_k" + k) for k in keys], "x0", "y0", "x1", "y1", across.alias("_cx"))
    laid = laid.withColumn("_cy", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1")))))
    placed = points.withColumn("_px", cell(F.col("x"))).withColumn("_py", cell(F.col("y")))
    condition = (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    for k in keys:
        condition = condition & (placed[k] == laid["_k" + k])
    return placed.join(laid, condition, how).drop("_px", "_py")


def right_neighbours(items: DataFrame, keys: Names, ident: str, reach: float, drift: float, grid: int) -> DataFrame:
    """``(ident, right)``: the item of the key that begins nearest to the right of an item ``x, y, h``, within
    reach heights across and drift heights down; the smaller ident on ties. Items of a null key meet nothing.

    An item is sent to the cells of a grid that its reach covers and to its own; a cell's rows pass in one sweep from the right, so an item meets
    no more than one of each height above it, however crowded the cell is.
    """
    named = F.lit(True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    cell = lambda c: F.floor(c / grid).cast("long")
    across, down = reach * F.col("h"), drift * F.col("h")
    slack = F.lit(1e-6)  # rounding at a cell's edge; the sweep judges exactly
    asking = items.where(named).withColumn("_cx", F.explode(F.sequence(cell(F.col("x")), cell(F.greatest(F.col("x"), F.col("x") + across + slack)))))
    asking = asking.withColumn("_cy", F.explode(F.sequence(cell(F.col("y") - F.abs(down) - slack), cell(F.col("y") + F.abs(down) + slack))))
    one = lambda df, side: df.select(*keys, "_cx", "_cy", (-F.col("x")).alias("_down"), F.lit(side).alias("_side"), "x", "y", "h", F.col(ident).alias("_id"))
    placed = items.where(named).where("x IS NOT NULL AND y IS NOT NULL").withColumns({"_cx": cell(F.col("x")), "_cy": cell(F.col("y"))})
    rows = one(asking, 0).unionByName(one(placed, 1))
    kind, width = items.schema[ident].dataType.simpleString(), items.schema["x"].dataType.simpleString()
    met = streams.streamed(rows, [], [*keys, "_cx", "_cy"], ["_down", "_side"], ["_side", "x", "y", "h", "_id"], f"_asked {kind}, _x {width}, _right {kind}", lambda: streams.Rightward(reach, drift))
    return met.groupBy(F.col("_asked").alias(ident)).agg(F.min_by("_right", F.struct("_x", "_right")).alias("right"))


def mode_first(df: DataFrame, keys: Names, value: str, order: str, least_share: float = 0.0) -> DataFrame:
    """The most frequent value, the first seen on ties; null under the share of rows asked for."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    top = counted.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("v"), "n"), F.struct(F.col("n"), -F.col("_first"))).alias("b"), F.sum("n").alias("_all"))
    return top.select(*keys, F.when(F.col("b.n") >= F.col("_all") * least_share, F.col("b.v")).alias("mode"), F.col("b.n").alias("n"))


def episodes(df: DataFrame, keys: Names, t: str, value: str, gap, order: Names = (), shown: int = 10, broken: float = 3) -> DataFrame:
    """Runs of counter reads: ``(keys, run_id, n, drops, reloads, broken, path)``; path shows the first reads, broken an unlikely drop."""
    runs = w.sessionize(df, keys, t, gap, order)
    delta = F.col(value) - F.lag(value).over(w.ordered([*keys, "run_id"], [t, *order]))
    place = F.row_number().over(w.ordered([*keys, "run_id"], [t, *order]))
    rows = runs.withColumn("_d", delta).withColumn("_k", place)
    shown_reads = F.array_sort(F.collect_list(F.when(F.col("_k") <= shown, F.struct("_k", F.col(value).cast("long").cast("string").alias("v")))))
    found = rows.groupBy(*keys, "run_id").agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.when(F.col("_d") < 0, -F.col("_d"))), F.lit(0.0)).alias("drops"),
        F.count(F.when(F.col("_d") > 0, 1)).alias("reloads"),
        F.coalesce(F.max(F.col("_d") < -broken), F.lit(False)).alias("broken"),
        F.array_join(F.transform(shown_reads, lambda s: s["v"]), " -> ").alias("path"),
    )
    return found


def rhythm_fit(df: DataFrame, keys: Names, t: str, periods: dict[str, int], tolerance: int, least: int = 3) -> DataFrame:
    """``(keys, period, worst)``: the slowest tabulated period of which every event of the key lies within the
    tolerance of a whole multiple from the first, and that fits into the key's span at least once."""
    first = df.groupBy(*keys).agg(F.min(t).alias("_t0"), (F.max(t) - F.min(t)).alias("_span"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    table = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).cast("long").alias("period")) for name, p in periods.items()]))
    each = df.join(first, list(keys)).withColumn("_p", table).where(F.col("_p.period") <= F.col("_span"))
    since = F.col(t) - F.col("_t0")
    rest = F.abs(since - F.floor(since / F.col("_p.period") + 0.5) * F.col("_p.period"))
    fits = each.groupBy(*keys, "_p").agg(F.max(rest).alias("worst")).where(F.col("worst") <= tolerance)
    best = fits.groupBy(*keys).agg(F.max_by(F.struct(F.col("_p.name").alias("period"), "worst"), F.col("_p.period")).alias("b"))
    return best.select(*keys, "b.*")


def prominence(value: str, keys: Names, order: Names, reach: int) -> Column:
    """How far a sample stands above the higher of the two lowest samples between it and the next higher one (or reach rows)."""
    before = F.reverse(F.collect_list(value).over(w.ordered(keys, order).rowsBetween(-reach, -1)))
    after = F.collect_list(value).over(w.ordered(keys, order).rowsBetween(1, reach))

    def base(side: Column) -> Column:
        walked = F.aggregate(
            side,
            F.struct(F.lit(False).alias("stop"), F.col(value).alias("low")),
            lambda s, x: F.struct((s["stop"] | (x > F.col(value))).alias("stop"), F.when(s["stop"] | (x > F.col(value)), s["low"]).otherwise(F.least(s["low"], x)).alias("low")),
        )
        return walked["low"]

    return F.col(value) - F.greatest(base(before), base(after))


def held_value(value: str, keys: Names, order: Names, reads: int) -> Column:
    """The value, where it has just been read ``reads`` times in a row."""
    steady = F.size(F.collect_set(value).over(w.ordered(keys, order).rowsBetween(1 - reads, 0))) == 1
    full = F.count("*").over(w.ordered(keys, order).rowsBetween(1 - reads, 0)) == reads
    return F.when(steady & full, F.col(value))


def with_held_value(df: DataFrame, keys: Names, order: Names, value: str, reach: int = 5, reads: int = 3, out: str = "held") -> DataFrame:
    """Rows with the value held at or up to reach rows before them, null if none is."""
    marked = df.withColumn("_h", held_value(value, keys, order, reads))
    return marked.withColumn(out, F.last("_h", ignorenulls=True).over(w.ordered(keys, order).rowsBetween(-reach, 0))).drop("_h")


def floods(df: DataFrame, keys: Names, t: str, value: str, rise: float, within: int, plateau: int, share: float) -> DataFrame:
    """Rows at which a series has risen by ``rise`` over its lowest value of the time ``within`` before, and stays at share of the level for the plateau."""
    low = F.min(value).over(w.around(keys, t, within, 0))
    floor = F.min(value).over(w.around(keys, t, 0, plateau))
    return df.withColumn("_low", low).withColumn("_floor", floor).where((F.col(value) - F.col("_low") >= rise) & (F.col("_floor") >= share * F.col(value))).drop("_low", "_floor")


def autocorrelation(df: DataFrame, keys: Names, order: Names, value: str, lags: int) -> DataFrame:
    """``(keys, lag, r)``: normalised autocorrelation of a series at lags 1 to ``lags``."""
    centred = df.withColumn("_x", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    whole = w.ordered(keys, order)
    products = [(F.col("_x") * F.lag("_x", k).over(whole)).alias(f"_p{k}") for k in range(1, lags + 1)]
    rows = centred.select(*keys, F.col("_x"), *products)
    energy = F.sum(F.col("_x") * F.col("_x"))
    sums = rows.groupBy(*keys).agg(energy.alias("_e"), *[F.sum(f"_p{k}").alias(f"_s{k}") for k in range(1, lags + 1)])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_s{k}").alias("s")) for k in range(1, lags + 1)]))
    return sums.where("_e > 0").withColumn("_q", pairs).select(*keys, "_q.lag", (F.col("_q.s") / F.col("_e")).alias("r"))

