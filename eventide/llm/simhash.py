"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprints of 64 bits link when they differ in at most two bits. Seven
structured masks cover that radius: bit ``i`` gets the colour ``i % 7 + 1`` (a
non-zero vector of GF(2)^3), and mask ``v`` keeps the bits whose colour has an
odd inner product with ``v``. Any two bits lie outside some mask, so every pair
within the radius agrees on all bits of that mask: no link can be missed.

Fingerprints that meet in a bucket of some table are compared there, in blocks
that pass on a spanning forest, never the bucket's pairs (see buckets).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import crowded, linked
from .common import bounded_batches, checkpointed

SEED = 42
RADIUS = 2
SHINGLE = 3
#: Fingerprints of one block of a bucket.
BLOCK = 1024
#: Bits of every byte value, lowest first.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
BYTE = 256 * np.arange(8)


def masks(radius: int = RADIUS) -> list[int]:
    """The ``2^(radius+1) - 1`` masks that cover ``radius`` differing bits of 64."""
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(64) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def simhash64(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of UTF-8 text: a bit is set if over half the shingles' XXH64 have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    values = np.array(hashes, np.uint64)
    seen = np.bincount((values.view(np.uint8).reshape(-1, 8) + BYTE).ravel(), minlength=2048).reshape(8, 256)
    bits = 2 * (seen @ BITS).ravel() > len(values)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def simhash(text: Column) -> Column:
    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series(list(map(simhash64, texts)), dtype="int64")

    return fingerprints(text.cast("binary"))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def close(radius: int = RADIUS):
    """Links of a table of ``fp``: at most ``radius`` differing bits."""

    def links(chunk: pa.Table) -> np.ndarray:
        fp = chunk.column("fp").to_numpy().view(np.uint64)
        return np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius

    return links


def covering(fp: Column, radius: int = RADIUS) -> Column:
    """Array of ``(band, key)``: the fingerprint's bucket in each of the tables that cover the radius."""
    return F.array(*[F.struct(F.lit(v).cast("byte").alias("band"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(masks(radius))])


def linked_fingerprints(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Star edges ``(a, b)`` from nodes of ``classes (fp, node)`` (distinct fp) to the smallest
    node of their component of "at most radius differing bits"."""
    keys = classes.select("node", F.explode(covering(F.col("fp"), radius)).alias("k")).select("k.band", "k.key", "node", F.lit(1).cast("long").alias("weight"))
    members = checkpointed(crowded(keys))
    return linked(members, classes.select("node", "fp"), close(radius), BLOCK, BLOCK).select(F.col("node").alias("a"), F.col("component").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, fp, component_id)`` for every row of docs.

    A null or blank text has fingerprint zero and links like any other; a null
    id belongs to a component but never names one (a component of null ids
    alone has a null id); repeated rows come out as often as they go in; an
    empty table gives no rows. Columns other than the two named are not read.
    """
    bounded_batches(docs.sparkSession)
    fps = checkpointed(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col)).alias("fp")))
    classes = checkpointed(fps.groupBy("fp").agg(F.min("id").alias("node")))
    components = linked_fingerprints(classes.where("node IS NOT NULL")).toDF("node", "component")
    named = classes.join(components, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=near_duplicates) -> DataFrame:
    """docs with one document of each near-duplicate component that ``find`` gives: the smallest id.

    Rows that repeat both id and text count as one document; rows of a null id
    all stay, as nothing names them.
    """
    found = find(docs, id_col, text_col)
    ids = found.where(F.col(id_col).isNull() | (F.col(id_col) == F.col("component_id"))).groupBy(F.col(id_col).alias("_kept")).count()
    ids = checkpointed(ids)
    if not ids.where("count > 1 AND _kept IS NOT NULL").isEmpty():
        docs = docs.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]).unionByName(docs.where(F.col(id_col).isNull()))
    return docs.join(ids, docs[id_col].eqNullSafe(ids["_kept"]), "left_semi")
