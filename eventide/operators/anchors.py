"""Places that gather most weight, peeled off one after the other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cuts import checkpointed
from .metrics import UPPER, order_statistics

Names = Sequence[str]


def _matched(left: str, right: str, keys: Names) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(left + k).eqNullSafe(F.col(right + k))
    return out


#: Spots of a key up to which all of them meet without a grid, and members of an anchor up to which its medians come from one array.
WHOLE, HELD = 512, 1024


def _weighed(rest: DataFrame, keys: Names, radius: float, spread: float) -> DataFrame:
    """``(s_keys, s_id, s_cx, s_cy, s_area, members, weight)`` of every spot's cluster.

    A seed is in one cell, of twice the radius; a member goes to the cells that its radius reaches, which are four. A key without grid is one cell.
    """
    width, reach = 2 * radius, radius * (1 + 1e-9)  # rounding takes no member from its seed
    reached = lambda c: F.sequence(F.floor((F.col(c) - reach) / width), F.floor((F.col(c) + reach) / width))
    cell = lambda c: F.when(F.col("_grid"), F.floor(F.col(c) / width)).otherwise(F.lit(0).cast("long"))
    cells = lambda c: F.when(F.col("_grid"), reached(c)).otherwise(F.array(F.lit(0).cast("long")))
    seeds = rest.select(*[F.col(k).alias("s_" + k) for k in keys], F.col("_id").alias("s_id"), F.col("cx").alias("s_cx"), F.col("cy").alias("s_cy"), F.col("area").alias("s_area"), cell("cx").alias("_sx"), cell("cy").alias("_sy"))
    members = rest.select(*[F.col(k).alias("m_" + k) for k in keys], "cx", "cy", "area", "_n", F.explode(cells("cx")).alias("_mx"), cells("cy").alias("_my")).withColumn("_my", F.explode("_my"))
    met = seeds.join(members, _matched("s_", "m_", keys) & (F.col("_sx") == F.col("_mx")) & (F.col("_sy") == F.col("_my")) & _near(radius, spread))
    return met.groupBy(*["s_" + k for k in keys], "s_id", "s_cx", "s_cy", "s_area").agg(F.sum("_n").alias("members"), F.sum(F.col("_n") * F.col("area")).alias("weight"))


def _near(radius: float, spread: float) -> Column:
    """If the spot ``cx, cy, area`` is a member of the cluster of ``s_cx, s_cy, s_area``."""
    return (F.sqrt((F.col("cx") - F.col("s_cx")) ** 2 + (F.col("cy") - F.col("s_cy")) ** 2) <= radius) & (F.col("area") <= F.col("s_area") * spread) & (F.col("area") * spread >= F.col("s_area"))


def _middles(own: DataFrame, keys: Names, large: bool) -> DataFrame:
    """``(keys, members, cx, cy, area)``: upper medians over an anchor's members, each spot counted ``_n`` times. Large: some anchor has more than HELD."""
    whole = lambda c: F.sort_array(F.flatten(F.collect_list(F.array_repeat(c, F.col("_n").cast("int")))))
    upper = lambda c: F.element_at(c, F.expr("cast(members div 2 + 1 AS int)")).alias(c)
    names = ("cx", "cy", "area")
    found = own.where(F.col("members") <= HELD).groupBy(*keys, "members").agg(*[whole(c).alias(c) for c in names]).select(*keys, "members", *[upper(c) for c in names])
    if not large:
        return found
    long = own.where(F.col("members") > HELD).select(*keys, "members", "_n", F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in names])).alias("m")).select(*keys, "members", "_n", "m.*")
    middle = order_statistics(long, [*keys, "members", "what"], "value", weight="_n", upper=UPPER)
    return found.unionByName(middle.groupBy(*keys, "members").agg(*[F.max(F.when(F.col("what") == c, F.col("upper"))).alias(c) for c in names]))


def find_anchors(spots: DataFrame, keys: Names, ident: str, radius: float, spread: float, least: int, most: int, ratio: float) -> DataFrame:
    """``(keys, place, cx, cy, area, members)``: up to ``most`` anchors of every key's spots ``cx, cy, w, h``.

    A spot's cluster: the spots within the radius whose area is at most spread times larger or smaller. The cluster (of ``least`` members at
    least) with the largest summed area is an anchor, at the upper medians of its members; of equals, that of the smallest ident. Its members
    are taken away, and the search goes on until nothing is left or an anchor has less than ratio times the first one's area. Spots without extent don't count.

    All keys peel in the same round; equal spots are counted once before they meet. Keys of more than WHOLE spots meet in a grid.
    """
    area = (F.col("w") * F.col("h")).cast("double").alias("area")
    spots = spots.where("w > 0 AND h > 0")
    rest = spots.select(*keys, F.col(ident).alias("_id"), F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"), area)
    rest = rest.groupBy(*keys, "cx", "cy", "area").agg(F.min("_id").alias("_id"), F.count("*").alias("_n"))
    sizes = spots.groupBy(*[F.col(k).alias("s_" + k) for k in keys]).agg((F.count("*") > WHOLE).alias("_grid"))
    rest = checkpointed(rest.join(sizes, _matched("", "s_", keys)).select(rest["*"], "_grid"))
    found = main = anchor = None
    for place in range(1, most + 1):
        weighed = _weighed(rest, keys, radius, spread).where(F.col("members") >= least)
        best = weighed.groupBy(*["s_" + k for k in keys]).agg(F.max_by(F.struct("s_cx", "s_cy", "s_area", "members"), F.struct(F.col("weight"), -F.col("s_id"))).alias("b"))
        if anchor is not None:  # a key that has ended has no best, and so nothing left
            best = best.join(anchor.select(*[F.col(k).alias("g_" + k) for k in keys]), _matched("s_", "g_", keys), "left_semi")
        best = checkpointed(best.select(*["s_" + k for k in keys], "b.*"))
        largest = best.agg(F.max("members")).first()[0]
        if largest is None:
            break
        own = rest.join(best, _matched("", "s_", keys)).withColumn("_in", _near(radius, spread)).drop("s_cx", "s_cy", "s_area", *["s_" + k for k in keys])
        marked = checkpointed(own if place < most else own.where("_in"))
        anchor = _middles(marked.where("_in"), keys, largest > HELD).select(*keys, F.lit(place).alias("place"), "cx", "cy", "area", "members")
        if main is not None:
            anchor = anchor.join(main, _matched("", "f_", keys)).where(F.col("area") >= ratio * F.col("f_area")).select(anchor["*"])
        anchor = checkpointed(anchor)
        if main is None:
            main = anchor.select(*[F.col(k).alias("f_" + k) for k in keys], F.col("area").alias("f_area"))
        found = anchor if found is None else found.unionByName(anchor)
        rest = marked.where("NOT coalesce(_in, false)").drop("_in", "members")
    if found is None:
        return rest.select(*keys, F.lit(1).alias("place"), "cx", "cy", "area", F.lit(0).cast("long").alias("members")).limit(0)
    return found
