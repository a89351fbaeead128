"""Near-duplicates by Jaccard similarity of word shingles, for the pipeline's SimHash stage.

Candidates come from the covering tables of the texts' SimHash fingerprints:
all pairs within the radius meet there. At 0.8, two sets differ in 10 of 64
fingerprint bits on average and in up to 20 at times; covering masks for such a
radius number 2^18 and more. So MinHash bands are added for the pairs beyond
the radius. Links of both are verified on the sets themselves.

Texts of equal shingle sets are one class. A class has the covering keys of
its texts' fingerprints, and BANDS keys of ROWS minima each; two sets of similarity
s miss each other in all bands with probability ``(1 - s^ROWS)^BANDS`` (3e-5 at 0.8).

Every pair of a bucket that no other link joins is verified (see buckets).
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
from .simhash import covering, simhash

SEED = 42
SHINGLE = 5
MIN_SIMILARITY = 0.8
BANDS = 20
ROWS = 4
#: Sets of a block, and their hashes (of 8 bytes each) together, on average.
BLOCK = 256
BLOCK_HASHES = 1_000_000
#: Bands that are compared first: pairs that these link needn't be compared again.
FIRST = 4
#: Rows of crowded buckets are looked up by a broadcast of up to so many ids (8 bytes each), and by a shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Cells of one block's incidence matrix that are held at once.
CELLS = 4_000_000
_RANDOM = np.random.default_rng(SEED)
_XOR = _RANDOM.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
_FACTOR = _RANDOM.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
#: Shingles that are hashed in one go.
CHUNK = 4096


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the text's runs of ``shingle`` words (of all words, if there are fewer); empty for a blank text."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """The BANDS keys of a shingle set; none of an empty one."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for start in range(0, len(found), CHUNK):
        least = np.minimum(least, ((found[start : start + CHUNK] ^ _XOR) * _FACTOR).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), SEED) for band in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64)


def set_name(found: np.ndarray) -> int:
    """Signed 64-bit name of a shingle set."""
    return int(np.array([xxhash.xxh3_64_intdigest(found.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def sketch(text: Column, shingle: int) -> Column:
    """``node`` (the shingle set's name), its ``weight`` (the set's size) and ``bands``."""

    @F.pandas_udf("node long, weight long, bands array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [shingle_set(t, shingle) for t in texts]
        return pd.DataFrame({"node": np.array([set_name(x) for x in found], np.int64), "weight": np.array([len(x) for x in found], np.int64), "bands": pd.Series([band_keys(x) for x in found], dtype=object)})

    return run(text.cast("binary"))


def shingle_bytes(text: Column, shingle: int) -> Column:
    """``node`` and ``shingles``, the bytes of the set's hashes."""

    @F.pandas_udf("node long, shingles binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [shingle_set(t, shingle) for t in texts]
        return pd.DataFrame({"node": np.array([set_name(x) for x in found], np.int64), "shingles": pd.Series([x.tobytes() for x in found], dtype=object)})

    # called nondeterministic so that no filter on its answer runs it on rows that the join drops
    return run.asNondeterministic()(text.cast("binary"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of elements that sorted distinct sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    names, column = np.unique(column[shared], return_inverse=True)
    owner = owner[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, CELLS // len(sets))
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, len(names), step):
        own = slice(*np.searchsorted(column, [start, start + step]))
        cells = np.zeros((len(sets), min(step, len(names) - start)), np.float32)
        cells[owner[own], column[own] - start] = 1
        common += cells @ cells.T
    return common


def similar(least: float):
    """Links of a table of ``shingles``: Jaccard similarity ``least`` at least."""

    def links(chunk: pa.Table) -> np.ndarray:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in chunk.column("shingles")]
        size = np.array([len(x) for x in sets])
        if len(sets) == 2:
            both = len(np.intersect1d(*sets, assume_unique=True))
            return np.full((2, 2), both >= least * (size.sum() - both) - 1e-9)
        common = overlaps(sets)
        return common >= least * (size[:, None] + size[None, :] - common) - 1e-6

    return links


def fingerprint_keys(found: DataFrame) -> DataFrame:
    """``(node, weight, band, key)``: covering keys of the fingerprints of every class's texts, numbered after the bands. Blank texts are one class and need none."""
    prints = found.where("weight > 0 AND id IS NOT NULL").select("node", "weight", "fp").distinct()
    keys = prints.select("node", "weight", F.explode(covering(F.col("fp"))).alias("k"))
    return keys.select("node", "weight", (F.col("k.band").cast("int") + BANDS).alias("band"), "k.key").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``(<id_col>, component_id)`` for every row of docs: texts link whose word shingles have that Jaccard similarity.

    Null and blank texts link with each other only; a null id belongs to a
    component but never names one (a component of null ids alone has a null
    id); repeated rows come out as often as they go in; an empty table gives no
    rows. Columns other than the two named are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = checkpointed(rows.select("id", sketch(F.col("text"), shingle).alias("s"), simhash(F.col("text")).alias("fp")).select("id", "s.node", "s.weight", "s.bands", "fp"))
    classes = checkpointed(found.groupBy("node").agg(F.min("id").alias("least_id"), F.first("weight").alias("weight"), F.first("bands").alias("bands")).where("least_id IS NOT NULL"))
    keys = classes.select("node", "weight", F.posexplode("bands").alias("band", "key")).unionByName(fingerprint_keys(found))
    members = checkpointed(crowded(keys))
    close = members.select("node").distinct()
    ids = checkpointed(classes.join(close, "node", "left_semi").select(F.col("least_id").alias("id")).distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    sets = rows.join(ids, "id", "left_semi").select(shingle_bytes(F.col("text"), shingle).alias("s")).select("s.node", "s.shingles")
    sets = checkpointed(sets.join(close, "node", "left_semi").dropDuplicates(["node"]))
    named = classes.join(linked(members, sets, similar(min_similarity), BLOCK, BLOCK_HASHES, FIRST), "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("component"))
    names = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    owners = named.join(names, "component").select("node", "component_id")
    return found.select("id", "node").join(owners, "node", "left").select(F.col("id").alias(id_col), "component_id")
