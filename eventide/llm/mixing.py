"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents are put in a keyed random order and their words cut
into blocks; a source's target is an exact quota of block copies (whole passes
over its blocks, then a permuted part of them, the last one cut to the word).
The vector of quotas is split down a binary tree over the output shards: the
left child of a node gets a multivariate-hypergeometric draw, so each shard's
quotas are distributed as if all block copies were dealt at random, and sum up
exactly. A shard then takes the next blocks of each source's permuted deck
(disjoint from every other shard's) and shuffles them locally.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpointed, prefix_sums, unused

SEED = 7
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_PASSES = 2.0
BLOCK_WORDS = 4096
SHARD_BLOCKS = 256
#: Block copies of one tree: more are cut into ranges first, each with its exact share of every source and a tree of its own.
MAX_COPIES = 100_000_000
#: Shards whose running quotas one task sums up.
SHARD_RANGE = 4096
#: Levels of the tree that one grouped task splits.
LEVELS = 3
#: Documents of one source and hash range that one task orders.
BUCKET_ROWS = 2_000
PRIMES = (1_000_003, 998_244_353, 754_974_721)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_passes: float = MAX_PASSES) -> DataFrame:
    """sizes ``(source, source_size, n_docs)`` plus ``sid, weight, target``.

    Sources in code-point order (null last) weigh ``weights`` in turn and share
    ``share`` times all words; a target stops at ``max_passes`` times its
    source's size and the excess is shared anew by weight among the others.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("sid", (F.row_number().over(order) - 1).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1)
    ranked = checkpointed(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_passes)))
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, n_capped = 0.0, -1
    while True:
        at = F.col("cap") <= F.col("weight") * level
        capped, n, free = ranked.agg(F.sum(F.when(at, F.col("cap"))), F.count(F.when(at, 1)), F.sum(F.when(~at, F.col("weight")))).first()
        if n == n_capped or not free:
            break
        n_capped, level = n, (total - (capped or 0.0)) / free
    return ranked.withColumn("target", F.least("cap", F.col("weight") * level)).drop("cap")


def _splitter(level: int, n: int, seed: int):
    """Splits a node (of a level of the tree) n levels down; draws depend on the node and the seed alone."""

    def split(node: pd.DataFrame) -> pd.DataFrame:
        node = node.sort_values("sid")
        sid, found = node["sid"].to_numpy(), {int(node["node"].iloc[0]): node["quota"].to_numpy(np.int64)}
        for k in range(level, level + n):
            below = {}
            for at, quota in found.items():
                draw = np.random.default_rng([seed, k, at])
                left = draw.multivariate_hypergeometric(quota, int(quota.sum()) // 2, method="marginals")
                below[2 * at], below[2 * at + 1] = left, quota - left
            found = below
        return pd.concat([pd.DataFrame({"node": at, "sid": sid, "quota": quota}) for at, quota in found.items()])

    return split


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``(shard, sid, quota)`` from ``(sid, quota)``: exact per-source block quotas of ``shards`` (a power of two) shards."""
    depth = shards.bit_length() - 1
    copies = quotas.agg(F.sum("quota")).first()[0] or 0
    top = min(depth, max(0, math.ceil(math.log2(max(1, copies / MAX_COPIES)))))
    part = lambda i: F.floor(F.col("quota").cast("decimal(38,0)") * i / (1 << top)).cast("long")
    nodes = quotas.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << top) - 1).cast("long"))).alias("node"), "sid", "quota")
    nodes = nodes.select("node", "sid", (part(F.col("node") + 1) - part(F.col("node"))).alias("quota"))
    for level in range(top, depth, LEVELS):
        n = min(LEVELS, depth - level)
        nodes = nodes.groupBy("node").applyInPandas(_splitter(level, n, seed), "node long, sid int, quota long")
    return nodes.withColumnRenamed("node", "shard")


def layout(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, options: dict) -> tuple[DataFrame, DataFrame, int]:
    """(positions of the rows in their source's word stream, sources with their targets, block size)."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(id_col, text_col, source_col).alias("row_key")
    )
    rows = checkpointed(rows.withColumn("order", F.xxhash64(F.lit(seed), "id", "row_key")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = checkpointed(source_targets(sizes, **options))
    n_docs = sources.agg(F.sum("n_docs")).first()[0]
    block = BLOCK_WORDS
    taken = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(taken / F.col("source_size"))).otherwise(0).cast("long")
    n_blocks = F.ceil(F.col("source_size") / block).cast("long")
    sources = sources.withColumn("n_blocks", n_blocks).withColumn("full", full).withColumn("rest", taken - F.col("full") * F.col("source_size"))
    sources = sources.withColumn("quota", F.col("full") * F.col("n_blocks") + F.ceil(F.col("rest") / block).cast("long"))
    placed = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = prefix_sums(placed, ["sid"], "order", "size", max(1, math.ceil((n_docs or 0) / BUCKET_ROWS)))
    return placed, sources, block


def spans(placed: DataFrame, sources: DataFrame, block: int, seed: int = SEED) -> DataFrame:
    """``(shard, position, sid, pass, id, row_key, start, size, first_word, n_words)``: the
    mix, shard by shard. first_word counts from the document's start; position is the place in the locally shuffled shard."""
    copies = sources.agg(F.sum("quota")).first()[0] or 0
    shards = 1 << max(0, math.ceil(math.log2(max(1, copies / SHARD_BLOCKS))))
    leaves = split_quotas(sources.select("sid", "quota"), shards, seed)
    leaves = checkpointed(leaves.withColumn("range", F.floor(F.col("shard") / SHARD_RANGE)))
    before = F.sum("s").over(Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = leaves.groupBy("sid", "range").agg(F.sum("quota").alias("s")).select("sid", "range", F.coalesce(before, F.lit(0)).alias("before"))
    until = F.col("before") + F.sum("quota").over(Window.partitionBy("sid", "range").orderBy("shard"))
    dealt = leaves.join(ranges, ["sid", "range"]).withColumn("until", until).where("quota > 0").select("shard", "sid", F.explode(F.sequence(F.col("until") - F.col("quota"), F.col("until") - 1)).alias("copy"))

    b = F.lit(block)
    blocks = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))
    parts = placed.where("size > 0").withColumn("block", F.explode(blocks))
    full_blocks = F.col("n_blocks") - 1  # the last block may be short: it comes last in every pass
    step = F.coalesce(*[F.when(full_blocks % p != 0, F.lit(p)) for p in PRIMES], F.lit(1)).cast("long")
    rank = F.when(F.col("block") >= full_blocks, full_blocks).otherwise((F.col("block") * step + F.lit(seed)) % F.greatest(full_blocks, F.lit(1)))
    parts = parts.withColumn("rank", rank)
    passes = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("full")),
        lambda p: F.struct(p.alias("pass"), F.when(p < F.col("full"), b).otherwise(F.least(b, F.col("rest") - F.col("rank") * b)).alias("words")),
    )
    parts = parts.withColumn("p", F.explode(passes)).where("p.words > 0").withColumn("pass", F.col("p.pass"))
    begin = F.greatest("start", F.col("block") * b)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * b + F.col("p.words"))
    parts = parts.withColumn("first_word", begin - F.col("start")).withColumn("n_words", end - begin).where("n_words > 0")
    parts = parts.withColumn("copy", F.col("pass") * F.col("n_blocks") + F.col("rank"))
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "sid", "copy"), "sid", "copy", "start")
    columns = ("sid", "pass", "id", "row_key", "start", "size", "first_word", "n_words")
    # as many rows as block copies, which the planner can't tell from the few quotas they come from: never broadcast
    return parts.join(dealt.hint("merge"), ["sid", "copy"]).select("shard", F.row_number().over(shuffled).alias("position"), *columns)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The mix as spans of documents (see spans()).

    Null texts and texts without words are never taken; a null source is one
    source, the last; repeated rows are documents of their own; an empty table
    gives no rows. The same rows give the same mix, however they are partitioned.
    """
    return spans(*layout(docs, id_col, text_col, source_col, seed, options), seed)


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """``(id, row_key, size, source_size, target, taken)``, one row for each row of docs: what the mix takes of it."""
    placed, sources, block = layout(docs, id_col, text_col, source_col, seed, options)
    placed = checkpointed(placed)
    got = spans(placed, sources, block, seed).groupBy(F.col("sid").alias("_sid"), F.col("start").alias("_start")).agg(F.sum("n_words").alias("taken"))
    same = (placed["sid"] == got["_sid"]) & (placed["start"] == got["_start"]) & (placed["size"] > 0)
    return placed.join(got, same, "left").select("id", "row_key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """Rows of docs as the mix holds them: once for every pass that takes it, rounded to whole documents without bias.

    Null texts and texts without words are never held, a null source is one
    source, the last, and an empty table gives no rows.

    A pass that takes n of a document's words holds it with probability
    n / size, by a hash of the document and the pass: expected words are those
    of the mix, whatever a document's length. Identical rows share their copies evenly, rounded up.
    """
    placed, sources, block = layout(docs, id_col, text_col, source_col, seed, options)
    placed = checkpointed(placed)
    each = spans(placed, sources, block, seed).groupBy("sid", "start", "row_key", "pass").agg(F.sum("n_words").alias("n"), F.first("size").alias("size"))
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("round"), "sid", "start", "row_key", "pass"), 11) / F.lit(float(2**53))
    copies = each.where(uniform * F.col("size") < F.col("n")).groupBy(F.col("row_key").alias("_row_key")).agg(F.count("*").alias("_copies"))
    rows = placed.groupBy(F.col("row_key").alias("_row_key")).agg(F.count("*").alias("_rows"))
    copies = copies.join(rows, "_row_key").select("_row_key", F.ceil(F.col("_copies") / F.col("_rows")).cast("int").alias("_copies"))
    own, key, number, copy = (unused(docs, c) for c in ("_doc_key", "_row_key", "_copies", "_copy"))
    copies = copies.select(F.col("_row_key").alias(key), F.col("_copies").alias(number))
    keyed = docs.withColumn(own, F.xxhash64(id_col, text_col, source_col))
    joined = keyed.join(copies, keyed[own] == copies[key])
    return joined.select(*[keyed[f"`{c}`"] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(number))).alias(copy)).drop(copy)
