"""Document fingerprints: a Merkle tree over sections and paragraphs, in DataFrame functions only.

Sections are parted by blank lines, paragraphs by line feeds, and a paragraph
is cut into short leaves (up to a sentence end or LEAF characters). Every cut
is reversible, so two texts have equal roots iff they are equal (up to hash
collisions). A leaf's code is 56 bits of its hash and 8 of its length; the
fingerprint is the root and the codes of all leaves in tree order, from which
likeness and the branches that differ are read without the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of a leaf without a sentence end.
LEAF = 96
LEAF_PATTERN = rf"(?s)[^.!?]{{1,{LEAF}}}[.!?]{{0,32}}|[.!?]{{1,32}}"


def tree(text: Column) -> Column:
    """``array<array<array<long>>>``: leaf codes by section and paragraph; a null text is an empty one."""
    code = lambda leaf: F.xxhash64(leaf).bitwiseAND(F.lit(~255)).bitwiseOR(F.least(F.length(leaf), F.lit(255)).cast("long"))
    paragraph = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF_PATTERN), F.lit(0)), code)
    section = lambda s: F.transform(F.split(s, "\n"), paragraph)
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), section)


def paragraph_nodes(nodes: Column) -> Column:
    """``array<array<string>>``: a hash for every paragraph, over its leaves."""
    return F.transform(nodes, lambda s: F.transform(s, lambda p: F.sha2(_codes(p), 256)))


def section_nodes(nodes: Column) -> Column:
    """``array<string>``: a hash for every section, over its paragraphs' hashes."""
    return F.transform(paragraph_nodes(nodes), lambda s: F.sha2(F.array_join(s, ","), 256))


def root(nodes: Column) -> Column:
    return F.sha2(F.array_join(section_nodes(nodes), ";"), 256)


def _codes(paragraph: Column) -> Column:
    return F.array_join(F.transform(paragraph, lambda c: F.lpad(F.hex(c), 16, "0")), "")


def fingerprint(nodes: Column) -> Column:
    """``root:leaves``: sections parted by ``;``, paragraphs by ``,``, 16 digits for a leaf."""
    leaves = F.array_join(F.transform(nodes, lambda s: F.array_join(F.transform(s, _codes), ",")), ";")
    return F.concat(root(nodes), F.lit(":"), F.lower(leaves))


def leaves(nodes: Column) -> Column:
    return F.flatten(F.flatten(nodes))


def _chars(codes: Column) -> Column:
    return F.aggregate(codes, F.lit(0).cast("long"), lambda total, c: total + c.bitwiseAND(F.lit(255).cast("long")))


def _matched_prefix(a: Column, b: Column) -> Column:
    """Characters of the leaves that a and b begin with alike."""
    n = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(n == 0, _chars(a)).otherwise(_chars(F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0)).cast("int"))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from the leaf codes of two fingerprints: the share of characters in leaves
    that they share, either in place (from the start and from the end of both) or anywhere
    (each different leaf once), whichever is more. Two empty texts are alike."""
    size_a, size_b = _chars(a), _chars(b)
    ends = _matched_prefix(a, b) + _matched_prefix(F.reverse(a), F.reverse(b))
    in_place = F.least(ends, size_a, size_b) * 2 / (size_a + size_b)
    once_a, once_b = F.array_distinct(a), F.array_distinct(b)
    anywhere = _chars(F.array_intersect(a, b)) * 2 / (_chars(once_a) + _chars(once_b))
    return F.when(size_a + size_b == 0, F.lit(1.0)).otherwise(F.greatest(in_place, anywhere))


def differing_branches(a: Column, b: Column) -> Column:
    """``array<struct<section, paragraph>>`` (from 0) of the paragraphs whose hashes differ
    between two trees, by position; branches with equal section hashes are not entered."""
    both = F.arrays_zip(section_nodes(a).alias("sa"), section_nodes(b).alias("sb"), paragraph_nodes(a).alias("pa"), paragraph_nodes(b).alias("pb"))
    none = F.array().cast("array<struct<section:int,paragraph:int>>")

    def inside(x, i):
        pairs = F.arrays_zip(F.coalesce(x["pa"], F.array().cast("array<string>")).alias("p"), F.coalesce(x["pb"], F.array().cast("array<string>")).alias("q"))
        marked = F.transform(pairs, lambda y, j: F.when(~y["p"].eqNullSafe(y["q"]), F.struct(i.cast("int").alias("section"), j.cast("int").alias("paragraph"))))
        return F.when(x["sa"].eqNullSafe(x["sb"]), none).otherwise(F.array_compact(marked))

    return F.flatten(F.transform(both, inside))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, nodes, next_text, next_nodes)``: every row with the one that follows in
    descending id (the first follows the last).

    One shuffle, by ranges of the id: the first row of a range (in descending
    order) is also sent to the range before it. Ranges come from quantiles of
    the ids; what reaches the driver is two numbers for each range, and there
    are as many ranges as shuffle partitions. Null ids come last; rows of one
    id are ordered by their text's hash.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long"))
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("key"))
    cuts = keyed.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 20_000)).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(int(c)).cast("long") for c in cuts]).cast("array<long>")
    keyed = keyed.withColumn("range", F.size(F.filter(bounds, lambda c: c <= F.col("key"))))
    firsts = sorted((r["range"], r["first"]) for r in keyed.groupBy("range").agg(F.max("key").alias("first")).collect())
    above = {first: firsts[(i + 1) % len(firsts)][0] for i, (_, first) in enumerate(firsts)}
    leads = F.array(*[F.lit(f).cast("long") for f in above]).cast("array<long>")
    to = F.array(*[F.lit(r) for r in above.values()]).cast("array<int>")
    at = F.array_position(leads, F.col("key")).cast("int")
    own = F.struct(F.col("range"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.try_element_at(to, at).alias("range"), F.lit(True).alias("ghost"))
    sent = keyed.withColumn("to", F.explode(F.when(at > 0, F.array(own, ghost)).otherwise(F.array(own))))
    sent = sent.select("id", "text", "key", F.col("to.range").alias("range"), F.col("to.ghost").alias("ghost")).repartition("range").withColumn("nodes", tree(F.col("text")))
    order = Window.partitionBy("range").orderBy("ghost", F.desc("key"), F.xxhash64("text"), "text")
    led = sent.withColumn("next_text", F.lead("text").over(order)).withColumn("next_nodes", F.lead("nodes").over(order))
    return led.where("NOT ghost").select("id", "text", "nodes", "next_text", "next_nodes")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint beside that of an edited text, in which the last third
    (rounded down) of the code points is replaced by the first as many (or all) of the next document's.

    Null texts count as empty; an empty table gives no rows; a lone row is its own next.
    """
    led = with_next(docs, id_col, text_col)
    text, after = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("next_text"), F.lit(""))
    led = led.withColumn("n_chars", F.length(text).cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), F.col("n_chars").cast("int") - third), F.substring(after, F.lit(1), third))
    led = led.withColumn("edited", edited).withColumn("edited_nodes", tree(F.col("edited")))
    own, changed, following = (leaves(F.col(c)) for c in ("nodes", "edited_nodes", "next_nodes"))
    return led.select(
        F.col("id").alias(id_col), "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("nodes")).alias("fingerprint"),
        fingerprint(F.col("edited_nodes")).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"),
        likeness(own, following).alias("near_next"),
        differing_branches(F.col("nodes"), F.col("edited_nodes")).alias("edited_branches"),
    )
