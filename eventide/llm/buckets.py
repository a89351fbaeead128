"""Links between members of hash buckets, without listing a bucket's pairs.

A bucket's members are dealt to blocks. The first bands' blocks are compared
where they lie, each on its own, and pass on a spanning forest: that joins the
mass of a large group at linear cost. Buckets that lie in one component by then
are done. In the others, of all bands, the members outside the bucket's largest
component meet all its blocks, so every pair of a bucket that no link has
joined by then is compared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components

SEED = 42
GROUP = ("band", "key", "low", "high")


def _stars(near: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) within the components of a symmetric matrix."""
    order = np.argsort(node)
    left = np.ones(len(near), bool)
    a, b = [], []
    for root in order.tolist():
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & left)
            left[front] = False
            a.append(node[front])
            b.append(np.full(len(front), node[root]))
    return np.concatenate(a), np.concatenate(b)


def _walk(links: Callable[[pa.Table], np.ndarray]):
    """Arrow batches sorted by GROUP to links (a, b), whole groups at a time however batches cut them."""

    def compare(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray] | None:
        component = chunk.column("component").to_numpy()
        left, right = chunk.column("left").to_numpy(), chunk.column("right").to_numpy()
        asked = component[:, None] != component[None, :]
        asked &= (left[:, None] & right[None, :]) | (right[:, None] & left[None, :])
        if not asked.any():
            return None
        return _stars(links(chunk) & asked, chunk.column("node").to_numpy())

    def run(batches):
        held = None
        for batch in batches:
            chunk = pa.Table.from_batches([batch])
            chunk = pa.concat_tables([held, chunk]).combine_chunks() if held is not None else chunk
            marks = np.zeros(len(chunk), bool)
            for c in GROUP:
                values = chunk.column(c).to_numpy()
                marks[1:] |= values[1:] != values[:-1]
            starts = [0, *np.flatnonzero(marks).tolist()]
            found = [compare(chunk.slice(s, e - s)) for s, e in zip(starts, starts[1:], strict=False) if e - s > 1]
            held = chunk.slice(starts[-1])  # the last group may go on
            yield from _rows(found)
        if held is not None and len(held) > 1:
            yield from _rows([compare(held)])

    return run


def _rows(found: list):
    found = [x for x in found if x is not None]
    if found:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        yield pa.RecordBatch.from_pydict({"a": a, "b": b})


def linked(members: DataFrame, payload: DataFrame, links: Callable[[pa.Table], np.ndarray], block: int, block_weight: int, first: int | None = None) -> DataFrame:
    """``(node, component)`` of the nodes that links join with others.

    members: ``(band, key, node, weight)``, any number in a bucket; payload:
    ``(node, ...)``, what ``links`` compares. links gives a symmetric matrix of
    booleans over a table of rows ``(node, ...)``. A block has ``block``
    members and so much weight on average. first: bands whose blocks go first (all if None).
    """
    bucket = ["band", "key"]
    at = lambda blocks: F.pmod(F.xxhash64(F.lit(SEED), "node"), blocks).cast("int")
    blocks = lambda count, weight: F.greatest(F.ceil(count / block), F.ceil(weight / block_weight)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    yes, no = F.lit(True), F.lit(False)

    def compared(dealt: DataFrame) -> DataFrame:
        return checkpointed(dealt.join(payload, "node").repartition(*GROUP).sortWithinPartitions(*GROUP, "node").mapInArrow(_walk(links), "a long, b long"))

    buckets = members.groupBy(*bucket).agg(F.count("*").alias("m"), F.sum("weight").alias("w")).where("m > 1")
    sized = checkpointed(members.join(buckets.select(*bucket, blocks(F.col("m"), F.col("w")).alias("blocks")), bucket))
    part = sized if first is None else sized.where(F.col("band") < first)
    within = lambda df: df.select(*bucket, at(F.col("blocks")).alias("low"), F.lit(-1).alias("high"), "node", "component", yes.alias("left"), yes.alias("right"))
    labels = checkpointed(connected_components(compared(within(part.withColumn("component", F.col("node"))))))

    rest = sized.where("blocks > 1") if first is None else sized.where((F.col("band") >= first) | (F.col("blocks") > 1))
    if rest.isEmpty():
        return labels
    rest = rest.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = rest.groupBy(*bucket, "component").agg(F.count("*").alias("c"))
    main = parts.groupBy(*bucket).agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("n")).where("n > 1")
    rest = checkpointed(rest.join(main.select(*bucket, "main"), bucket))
    large = rest.where("blocks > 1")
    outside = large.where("component != main").groupBy(*bucket).agg(blocks(F.count("*"), F.sum("weight")).alias("rows"))
    large = large.join(outside, bucket)
    columns = (*GROUP, "node", "component", "left", "right")
    of_left = large.where("component != main").select("*", at(F.col("rows")).alias("low"), every(F.col("blocks")).alias("high"), yes.alias("left"), no.alias("right"))
    of_right = large.select("*", every(F.col("rows")).alias("low"), at(F.col("blocks")).alias("high"), no.alias("left"), yes.alias("right"))
    late = compared(within(rest.where("blocks = 1")).union(of_left.select(*columns)).union(of_right.select(*columns)))
    if late.isEmpty():
        return labels
    return checkpointed(connected_components(late.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))))


def crowded(keys: DataFrame) -> DataFrame:
    """Rows of ``(band, key, node, ...)`` that share their bucket with another one."""
    more = keys.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1").select("band", "key")
    return keys.join(more, ["band", "key"], "left_semi")

