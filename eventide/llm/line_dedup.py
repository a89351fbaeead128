"""Removal of lines that many sites share.

Spread of a line = distinct sites (sources) that print it, over distinct texts:
copies of a text are one print, that of its first source, so that a document's
own lines don't become boilerplate by its being copied. HyperLogLog sketches
per line hash merge by aggregation; a line whose estimate lies near the
threshold gets an exact distinct count, so every decision is exact up to the
sketch's error far from the threshold (25 % off at 1.6 % standard error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, unused

#: A line on so many sites is boilerplate.
MIN_SITES = 10
#: Estimates within this share of the threshold are counted exactly.
MARGIN = 0.25
LG_K = 12
#: Parts that a line's occurrences are dealt to before they meet in its sketch.
SALTS = 16
#: Hashes of lines are broadcast up to so many (8 bytes each), and joined by a shuffle beyond.
BROADCAST_LINES = 200_000


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def _clean(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def lines_of(docs: DataFrame, text_col: str, source_col: str) -> DataFrame:
    """``(k1, k2, t1, t2, pos, h, salt, site)``, one row for each line that has more than blanks.

    k1, k2: 96 bits that identify the row by what it holds (id-less, null-safe); t1, t2 those of the text.
    """
    text = [F.xxhash64(text_col).alias("t1"), F.hash(text_col).alias("t2")]
    lines = docs.select(*_keys(docs), *text, F.col(source_col).alias("site"), F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
    lines = lines.withColumn("line", _clean(F.col("line"))).where("line != ''")
    return lines.select("k1", "k2", "t1", "t2", "pos", F.xxhash64("line").alias("h"), F.pmod("t1", F.lit(SALTS)).cast("int").alias("salt"), "site")


def _keys(docs: DataFrame) -> list[Column]:
    columns = [f"`{f.name}`" for f in docs.schema if isinstance(f.dataType, T.AtomicType)]
    return [F.xxhash64(*columns).alias("k1"), F.hash(*columns).alias("k2")]


def _of_hashes(lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """lines ``(h, salt, ...)`` with one of the hashes ``(h)``; beyond a broadcast's size, a hot line's rows are dealt to SALTS parts."""
    if hashes.count() <= BROADCAST_LINES:
        return lines.join(F.broadcast(hashes), "h", "left_semi")
    salted = hashes.select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return lines.join(salted.hint("merge"), ["h", "salt"], "left_semi")


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``(h, sites, exact)`` of the lines of lines_of() on at least ``min_sites`` sites."""
    prints = lines.where("site IS NOT NULL").groupBy("h", "salt", "t1", "t2").agg(F.min("site").alias("site"))
    prints = checkpointed(prints.select("h", "salt", F.xxhash64("site").alias("site")))
    # a line in fewer texts than min_sites, or on one site only, can't reach the threshold
    often = prints.groupBy("h").agg(F.count("*").alias("n"), F.min("site").alias("s0"), F.max("site").alias("s1")).where((F.col("n") >= min_sites) & ((F.col("s0") != F.col("s1")) | F.lit(min_sites <= 1)))
    prints = _of_hashes(prints, checkpointed(often.select("h")))
    parts = prints.groupBy("h", "salt").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    sketched = checkpointed(parts.groupBy("h").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate")))
    sure = sketched.where(F.col("estimate") > min_sites * (1 + MARGIN)).select("h", F.col("estimate").cast("long").alias("sites"), F.lit(False).alias("exact"))
    near = sketched.where((F.col("estimate") <= min_sites * (1 + MARGIN)) & (F.col("estimate") >= min_sites * (1 - MARGIN))).select("h")
    counted = _of_hashes(prints, near).select("h", "site").distinct().groupBy("h").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.unionByName(counted.withColumn("exact", F.lit(True)))


def mark_lines(docs: DataFrame, text_col: str = "text", source_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with ``removed_lines``: the positions (from 0) of the lines to remove, in order.

    Lines are compared without blanks at their ends; blank lines are never
    removed and a null source is no site. Null and empty texts have no lines;
    a text of wide lines only loses all of them; repeated rows are one print
    and are marked alike; an empty table gives no rows.
    """
    lines = checkpointed(lines_of(docs, text_col, source_col))
    wide = checkpointed(spread_lines(lines, min_sites).select("h"))
    hits = _of_hashes(lines, wide).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("removed_lines"))
    one, two, gone = unused(docs, "_row_k1"), unused(docs, "_row_k2"), unused(docs, "_removed")
    hits = hits.select(F.col("k1").alias("_" + one), F.col("k2").alias("_" + two), F.col("removed_lines").alias(gone))
    keyed = docs.select("*", *[c.alias(k) for c, k in zip(_keys(docs), (one, two), strict=True)])
    joined = keyed.join(hits, (keyed[one] == hits["_" + one]) & (keyed[two] == hits["_" + two]), "left")
    names = [keyed[f"`{c}`"] for c in docs.columns if c != "removed_lines"]
    return joined.select(*names, F.coalesce(hits[gone], F.array().cast("array<int>")).alias("removed_lines"))


def without_lines(text: Column, removed: Column) -> Column:
    kept = F.filter(split_lines(text), lambda _, i: ~F.array_contains(removed, i))
    return F.when(F.size(removed) == 0, text).otherwise(F.array_join(kept, "\n"))


def drop_spread_lines(docs: DataFrame, text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", **options) -> DataFrame:
    """docs with the marked lines taken out of the text, and ``length_col`` brought up to date where a text changed.

    Rows and columns stay as they are otherwise; a text that loses all its lines is empty, a null one stays null.
    """
    marked = mark_lines(docs, text_col, source_col, **options)
    text = without_lines(F.col(text_col), F.col("removed_lines"))
    out = marked.withColumn(text_col, text)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.size("removed_lines") > 0, F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*docs.columns)


ORACLE_SQL = """
WITH prints AS (SELECT text, min(source) AS source FROM documents WHERE source IS NOT NULL GROUP BY text),
wide AS (
  SELECT clean FROM (SELECT source, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS clean FROM prints)
  WHERE clean <> '' GROUP BY clean HAVING count(DISTINCT source) >= 10),
lines AS (
  SELECT doc_id, t.pos, trim(t.line, ' ' || chr(9) || chr(13)) AS clean
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) t),
hits AS (SELECT doc_id, count(*) AS n, list(pos) AS gone FROM lines JOIN wide USING (clean) GROUP BY doc_id),
parts AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS parts, h.gone, h.n
  FROM documents d LEFT JOIN hits h USING (doc_id))
SELECT doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       CASE WHEN gone IS NULL THEN text
            ELSE array_to_string([parts[i] FOR i IN range(1, len(parts) + 1) IF NOT list_contains(gone, i - 1)], chr(10)) END AS text
FROM parts
"""
