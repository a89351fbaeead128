"""Queries of the component and model operators; held against brute force and held-out quality in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, graphs, learning, metrics
from .common import query, table

LINK = 0.3

DOMINANT = f"""WITH RECURSIVE p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
  AND list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) >= {LINK}),
edge AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.id WHERE r.root < e.b),
lab AS (SELECT e.label, e.vec_id AS id, min(r.root) AS component FROM embeddings e JOIN reach r ON r.id = e.vec_id GROUP BY e.label, e.vec_id),
sizes AS (SELECT label, component, count(*) AS size FROM lab GROUP BY label, component),
best AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY size DESC, component) AS k FROM sizes)
SELECT l.label, l.id, l.component, b.size FROM lab l JOIN best b ON b.label = l.label AND b.component = l.component WHERE b.k = 1"""


@query(DOMINANT)
def dominant_component(spark: SparkSession, sf: str) -> DataFrame:
    """Each label's largest component of the graph that links query rows with rows of cosine 0.3 at least."""
    rows = table(spark, sf, "embeddings")
    edges = blocks.linked(rows, ["label"], "vec_id", "embedding", LINK, rows.where("vec_id % 20 = 0"))
    return graphs.dominant_component(rows.select("label", F.col("vec_id").alias("id")), edges, ["label"]).select("label", "id", "component", "size")


WHOLE = DOMINANT.replace(" WHERE a.vec_id % 20 = 0\n  AND", " WHERE")


@query(WHOLE)
def whole_dominant_component(spark: SparkSession, sf: str) -> DataFrame:
    """Each label's largest component of the graph of all its links of cosine 0.3 at least."""
    rows = table(spark, sf, "embeddings")
    return _core(rows).select("label", "id", "component", "size")


def _core(rows: DataFrame) -> DataFrame:
    edges = blocks.linked(rows, ["label"], "vec_id", "embedding", LINK)
    return graphs.dominant_component(rows.select("label", F.col("vec_id").alias("id")), edges, ["label"])


@query(f"""{WHOLE[: WHOLE.rindex('SELECT l.label')]}, core AS (SELECT l.label, l.id FROM lab l JOIN best b ON b.label = l.label AND b.component = l.component WHERE b.k = 1),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) AS sim
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id JOIN core ON core.id = b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS k, count(*) OVER (PARTITION BY a) AS n FROM s)
SELECT a, round(sim, 6) AS kth FROM r WHERE k = least(3, n) AND sim >= 0.28""")
def core_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose third best likeness to their label's dominant component is 0.28 at least."""
    rows = table(spark, sf, "embeddings")
    core = rows.join(_core(rows).select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    return blocks.gate(blocks.top_partners(rows, core, ["label"], "vec_id", "embedding", 3), 0.28).select("a", F.round("kth", 6).alias("kth"))


FEATURES = ["n_chars", "upper", "odd", "spaces"]


def quality_features(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda pattern: F.regexp_count("text", F.lit(pattern)) / F.greatest(F.length("text"), F.lit(1))
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars", share("[A-Z]").alias("upper"), share(r"[^\p{L}\s.,]").alias("odd"), share(r"\s").alias("spaces"))
    return table(spark, sf, "labels").select("doc_id", "quality").join(docs, "doc_id")


@query()
def cv_auc(spark: SparkSession, sf: str) -> DataFrame:
    """Rank AUC of a logistic model of document quality, by folds of whole sources."""
    found = learning.cross_scored(quality_features(spark, sf), "source", FEATURES, "quality", 4)
    return metrics.rank_auc(found, ["fold"], "p", "quality")
