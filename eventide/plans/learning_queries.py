"""Queries of the Newton models and of table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import newton
from .common import E, events, query
from .model_queries import quality_features

FEATURES = ["upper", "odd"]
SHARES = "f AS (SELECT l.doc_id, l.quality AS y, d.source, length(regexp_replace(d.text, '[^A-Z]', '', 'g')) / greatest(length(d.text), 1) AS upper, length(regexp_replace(d.text, '[\\p{L}\\s.,]', '', 'g')) / greatest(length(d.text), 1) AS odd FROM labels l JOIN documents d USING (doc_id))"


def _solved(source: str, target: str, by: str = "") -> str:
    """One Newton step in SQL: sums over the model's rows, then Cramer's rule for three unknowns."""
    head, tail = (f"{by}, ", f" GROUP BY {by}, w0, w1, w2") if by else ("", " GROUP BY w0, w1, w2")
    entries = ", ".join(f"sum(s * {a} * {b}) + {r} AS a{i}{j}" for (i, a), (j, b), r in [((0, "1"), (0, "1"), 0), ((0, "1"), (1, "x1"), 0), ((0, "1"), (2, "x2"), 0), ((1, "x1"), (1, "x1"), "any_value(ridge)"), ((1, "x1"), (2, "x2"), 0), ((2, "x2"), (2, "x2"), "any_value(ridge)")])
    det = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
    matrix = ["a00", "a01", "a02", "a01", "a11", "a12", "a02", "a12", "a22"]
    column = lambda k: det([f"g{i // 3}" if i % 3 == k else m for i, m in enumerate(matrix)])
    p = "1 / (1 + exp(-greatest(-30, least(30, w0 + w1 * x1 + w2 * x2))))"
    return f"""{target}_s AS (SELECT {head}w0, w1, w2, {entries}, sum(p - y) AS g0, sum((p - y) * x1) + any_value(ridge) * w1 AS g1, sum((p - y) * x2) + any_value(ridge) * w2 AS g2 FROM (SELECT *, greatest(p * (1 - p), 1e-6) AS s FROM (SELECT *, {p} AS p FROM {source})){tail}),
{target} AS (SELECT {head}{', '.join(f"w{k} - {column(k)} / {det(matrix)} AS w{k}" for k in range(3))} FROM {target}_s)"""


def _newton_sql(steps: int) -> str:
    out = ["w_0 AS (SELECT 0e0 AS w0, 0e0 AS w1, 0e0 AS w2)"]
    for i in range(steps):
        out += [f"r_{i} AS (SELECT upper * 20 AS x1, odd * 20 AS x2, y, 1e0 AS ridge, w.* FROM f, w_{i} w)", _solved(f"r_{i}", f"w_{i + 1}")]
    return ",\n".join(out)


@query(f"""WITH {SHARES}, {_newton_sql(5)}
SELECT unnest(['bias', 'upper', 'odd']) AS term, round(unnest([w0, w1, w2]), 6) AS weight FROM w_5""")
def newton_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Ridge logistic weights of document quality after five Newton steps."""
    rows = quality_features(spark, sf).withColumns({c: F.col(c) * 20 for c in FEATURES})
    weights = newton.fit(rows, FEATURES, "quality", 1.0, 5)
    made = F.array(*[F.struct(F.lit(n).alias("term"), F.lit(round(w, 6)).alias("weight")) for n, w in zip(["bias", *FEATURES], weights, strict=True)])
    return spark.range(1).select(F.explode(made).alias("m")).select("m.*")


def _grouped_sql(steps: int) -> str:
    out = [
        "m AS (SELECT g.source AS model, avg(upper) AS m1, stddev_pop(upper) AS d1, avg(odd) AS m2, stddev_pop(odd) AS d2 FROM (SELECT DISTINCT source FROM f) g JOIN f ON f.source <> g.source GROUP BY g.source)",
        "w_0 AS (SELECT model, 0e0 AS w0, 0e0 AS w1, 0e0 AS w2 FROM m)",
    ]
    scaled = "(upper - m1) / CASE WHEN d1 < 1e-9 THEN 1 ELSE d1 END AS x1, (odd - m2) / CASE WHEN d2 < 1e-9 THEN 1 ELSE d2 END AS x2"
    for i in range(steps):
        out += [f"r_{i} AS (SELECT m.model, {scaled}, y, 10e0 AS ridge, w0, w1, w2 FROM m JOIN w_{i} w USING (model) JOIN f ON f.source <> m.model)", _solved(f"r_{i}", f"w_{i + 1}", "model")]
    out.append(f"p AS (SELECT source, y, round(1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2))), 9) AS p FROM (SELECT f.source, y, {scaled}, w.* FROM f JOIN m ON m.model = f.source JOIN w_{steps} w ON w.model = f.source))")
    return ",\n".join(out)


@query(f"""WITH {SHARES}, {_grouped_sql(4)},
n AS (SELECT source, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM p GROUP BY source),
pairs AS (SELECT a.source, sum(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5e0 ELSE 0 END) AS wins FROM p a JOIN p b ON a.source = b.source AND a.y = 1 AND b.y = 0 GROUP BY a.source)
SELECT source, n_pos, n_neg, CASE WHEN n_pos >= 2 AND n_neg >= 2 THEN wins / (n_pos * n_neg) END AS auc FROM n LEFT JOIN pairs USING (source)""")
def leave_one_out_auc(spark: SparkSession, sf: str) -> DataFrame:
    """AUC of document quality within each source, by models of four Newton steps that have not seen it."""
    return newton.leave_one_out_auc(quality_features(spark, sf), "source", FEATURES, "quality", 10.0, steps=4)


STRATEGIES = [("loud", 100.0, 0.3), ("steep", 60.0, 0.6), ("any", 20.0, 0.5)]


@query(f"""WITH RECURSIVE {E}, s AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {t}e0, {v}e0)" for n, t, v in STRATEGIES)}) v(strategy, threshold, valley)),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS size FROM e),
w AS (SELECT DISTINCT user_id, strategy, threshold, valley, CAST(0 AS BIGINT) AS i, false AS armed, false AS fell, CAST(0 AS BIGINT) AS pt, 0e0 AS pv, size FROM n, s
  UNION ALL SELECT n.user_id, strategy, threshold, valley, n.i, CASE WHEN w.armed THEN n.value >= w.pv * valley ELSE n.value > threshold END, w.armed AND n.value < w.pv * valley,
    CASE WHEN n.value > CASE WHEN w.armed THEN w.pv ELSE threshold END THEN n.t ELSE w.pt END, CASE WHEN n.value > CASE WHEN w.armed THEN w.pv ELSE threshold END THEN n.value ELSE w.pv END, n.size FROM w JOIN n ON n.user_id = w.user_id AND n.i = w.i + 1)
SELECT user_id AS key, strategy, pt AS t, pv AS value FROM w WHERE fell OR (armed AND i = size)""")
def strategy_table(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks under three strategies, by a table function called from SQL."""
    tables.register(spark, STRATEGIES)
    rows = events(spark, sf).select(F.col("user_id").alias("key"), "t", "value", "event_id")
    return spark.sql("SELECT * FROM peak_strategies(TABLE(SELECT * FROM {rows}) PARTITION BY key ORDER BY (t, event_id))", rows=rows)
