"""Queries of rhythm grids, slot tracks, anchors and prototypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anchors, folds, rhythm
from ..operators import windows as w
from .common import DAY, HOUR, E, events, of_type, query, runs_sql, table
from .metric_queries import matched_sql

USER = ["user_id"]
PERIODS = [8 * HOUR, 12 * HOUR, 24 * HOUR, 36 * HOUR]
BACK, FORWARD, NEAR = -2 * HOUR, 4 * HOUR, 3 * HOUR


@query(f"""WITH {E}, {of_type('clicks', 'click')}, {runs_sql('clicks', 48 * HOUR)},
spans AS (SELECT user_id, run_id, min(t) AS a, max(t) AS b, min(t) - {FORWARD + NEAR} AS lo, max(t) - {BACK - NEAR} AS hi FROM runs GROUP BY user_id, run_id HAVING count(*) >= 2),
inside AS (SELECT s.*, e.t AS ct, max(least(e.value / 50, 2)) AS s FROM spans s JOIN e ON e.user_id = s.user_id AND e.t BETWEEN lo AND hi GROUP BY ALL),
each AS (SELECT i.*, p, CAST(floor((b - a) / p + 0.5e0) AS BIGINT) + 1 AS n, CAST(least({NEAR}, floor(p * 0.15e0)) AS BIGINT) AS near FROM inside i, unnest({PERIODS}) u(p) WHERE p <= b - a),
grids AS (SELECT * FROM (SELECT *, unnest(range(n)) AS node, ct - unnest(range(n)) * p AS x FROM each) WHERE x >= lo AND x + (n - 1) * p <= hi),
nodes AS (SELECT *, unnest(range(n)) AS j FROM grids),
weighed AS (SELECT g.user_id, g.run_id, g.p, g.n, g.ct, g.node, g.x, g.j, max(i.s) AS s FROM nodes g LEFT JOIN inside i ON i.user_id = g.user_id AND i.run_id = g.run_id AND abs(i.ct - g.x - g.j * g.p) <= g.near AND i.s > 0 GROUP BY ALL),
fits AS (SELECT user_id, run_id, p, n, ct, node, x, count(s) AS support, round(2 * coalesce(sum(s), 0) - n * 0.8e0, 6) AS fit FROM weighed GROUP BY user_id, run_id, p, n, ct, node, x),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run_id ORDER BY fit DESC, p DESC, ct, node) AS k FROM fits) WHERE k = 1 AND support >= n * 0.6e0),
placed AS (SELECT user_id, run_id, p, n, support, fit, unnest(range(n)) AS j, x FROM best)
SELECT q.user_id, q.run_id, q.p AS period, q.n AS count, q.support, q.fit, q.j AS k,
    coalesce((SELECT arg_min(i.ct, struct_pack(d := abs(i.ct - q.x - q.j * q.p), t := i.ct)) FROM inside i WHERE i.user_id = q.user_id AND i.run_id = q.run_id AND abs(i.ct - q.x - q.j * q.p) < {NEAR}), q.x + q.j * q.p) AS t,
    NOT EXISTS (SELECT 1 FROM inside i WHERE i.user_id = q.user_id AND i.run_id = q.run_id AND abs(i.ct - q.x - q.j * q.p) < {NEAR}) AS filled FROM placed q""")
def rhythm_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of clicks laid out as even nodes through the user's events."""
    spans = w.session_runs(events(spark, sf, "click"), USER, "t", 48 * HOUR, ["event_id"])
    heard = events(spark, sf).select("user_id", "t", F.least(F.col("value") / 50, F.lit(2.0)).alias("strength"))
    return rhythm.place_grid(spans, heard, USER, "run_id", "t", "strength", PERIODS, (BACK, FORWARD), NEAR)


FIT = "abs(r.x - s.x) <= greatest(1.5e0 * s.h, 12) AND abs(r.y - s.y) <= greatest(0.6e0 * s.h, 6) AND abs(r.h - s.h) <= 0.35e0 * s.h"
ITEMS = "i AS (SELECT user_id, event_id, t // 86400000000 AS frame, value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y, CAST(20 + event_id % 7 AS DOUBLE) AS h FROM e)"


@query(f"""WITH RECURSIVE {E}, {ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frame, event_id) AS k FROM i),
walk AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, h DOUBLE, n BIGINT, last BIGINT)[]) AS tracks, CAST(0 AS BIGINT) AS track, CAST(0 AS BIGINT) AS nth FROM n
  UNION ALL
  SELECT user_id, k, CASE WHEN best IS NULL THEN list_append(held, {{'id': event_id, 'x': x, 'y': y, 'h': h, 'n': 1, 'last': frame}}) ELSE list_transform(held, lambda s, j: CASE WHEN j = best
      THEN {{'id': s.id, 'x': (s.x * s.n + x) / (s.n + 1), 'y': (s.y * s.n + y) / (s.n + 1), 'h': (s.h * s.n + h) / (s.n + 1), 'n': s.n + 1, 'last': frame}} ELSE s END) END,
    CASE WHEN best IS NULL THEN event_id ELSE held[best].id END, CASE WHEN best IS NULL THEN 1 ELSE held[best].n + 1 END
  FROM (SELECT *, list_sort(list_filter(list_transform(held, lambda s, j: CASE WHEN s.last < r.frame AND {FIT} THEN {{'d': abs(r.x - s.x) + abs(r.y - s.y), 'j': j}} END), lambda c: c IS NOT NULL))[1].j AS best
    FROM (SELECT r.*, list_filter(w.tracks, lambda s: r.frame - s.last <= 4) AS held FROM walk w JOIN n r ON r.user_id = w.user_id AND r.k = w.k + 1) r))
SELECT n.user_id, n.frame, n.event_id, w.track, w.nth FROM walk w JOIN n ON n.user_id = w.user_id AND n.k = w.k""")
def slot_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events of a day are the items of a frame; which track each belongs to."""
    rows = events(spark, sf).select("user_id", "event_id", F.expr(f"t div {DAY}").alias("frame"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), (20 + F.col("event_id") % 7).alias("h"))
    return folds.track_slots(rows, USER, "frame", "event_id", 4)


def _peeled_sql(rounds: int, least: int, radius: int) -> str:
    """One block of CTEs for each round: seeds, the best, its members, the anchor, what is left."""
    near = f"sqrt((b.cx - a.cx) ** 2 + (b.cy - a.cy) ** 2) <= {radius} AND b.area <= a.area * 3e0 AND b.area * 3e0 >= a.area"
    middle = lambda c: f"list_sort(list({c}))[CAST(floor(count(*) / 2) AS INT) + 1] AS {c}"
    blocks = []
    for i in range(1, rounds + 1):
        far = "" if i == 1 else f" WHERE area >= (SELECT f.area FROM a1 f WHERE f.user_id = x.user_id) * {1 / 3!r}"
        blocks.append(f"""s{i} AS (SELECT a.user_id, a.id, a.cx, a.cy, a.area, sum(b.area) AS weight FROM rest{i} a JOIN rest{i} b ON a.user_id = b.user_id AND {near} GROUP BY ALL HAVING count(*) >= {least}),
b{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, id) AS k FROM s{i}) WHERE k = 1),
m{i} AS (SELECT b.* FROM rest{i} b JOIN b{i} a ON a.user_id = b.user_id AND {near}),
a{i} AS (SELECT * FROM (SELECT user_id, {i} AS place, {middle('cx')}, {middle('cy')}, {middle('area')}, count(*) AS members FROM m{i} GROUP BY user_id) x{far}),
rest{i + 1} AS (SELECT * FROM rest{i} WHERE user_id IN (SELECT user_id FROM a{i}) AND (user_id, id) NOT IN (SELECT user_id, id FROM m{i}))""")
    return ",\n".join(blocks)


@query(f"""WITH {E}, rest1 AS (SELECT user_id, event_id AS id, value AS cx, CAST(json_extract(props, '$.k') AS DOUBLE) AS cy, CAST((event_id % 7) * (event_id % 5 + 1) AS DOUBLE) AS area FROM e WHERE event_id % 7 > 0),
{_peeled_sql(4, 3, 18)}
{' UNION ALL '.join(f"SELECT user_id, place, cx, cy, area, members FROM a{i}" for i in range(1, 5))}""")
def anchor_peel(spark: SparkSession, sf: str) -> DataFrame:
    """Up to four places at which each user's events gather most area."""
    rows = events(spark, sf).select("user_id", "event_id", F.col("value").alias("cx"), F.get_json_object("props", "$.k").alias("cy"), (F.col("event_id") % 7).alias("w"), (F.col("event_id") % 5 + 1).alias("h"))
    return anchors.find_anchors(rows, USER, "event_id", 18.0, 3.0, 3, 4, 1 / 3)


@query("""WITH RECURSIVE v AS (SELECT label, vec_id, list_transform(embedding[1:48], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY label) AS size FROM embeddings WHERE embedding IS NOT NULL),
walk AS (
  SELECT DISTINCT label, CAST(0 AS BIGINT) AS k, size, CAST([] AS STRUCT(id BIGINT, n BIGINT, sums BIGINT[], bits INT[])[]) AS made FROM v
  UNION ALL
  SELECT label, k, size, CASE WHEN best.d <= 17 THEN list_transform(made, lambda s, j: CASE WHEN j = best.j
      THEN {'id': s.id, 'n': s.n + 1, 'sums': list_transform(s.sums, lambda y, i: y + bits[i]), 'bits': list_transform(s.sums, lambda y, i: CASE WHEN 2 * (y + bits[i]) >= s.n + 1 THEN 1 ELSE 0 END)} ELSE s END)
    WHEN len(made) < 12 THEN list_append(made, {'id': vec_id, 'n': 1, 'sums': bits, 'bits': bits}) ELSE made END
  FROM (SELECT v.*, w.made, list_sort(list_transform(w.made, lambda s, j: {'d': list_sum(list_transform(s.bits, lambda y, i: CASE WHEN y <> v.bits[i] THEN 1 ELSE 0 END)), 'j': j}))[1] AS best FROM walk w JOIN v ON v.label = w.label AND v.k = w.k + 1)),
ends AS (SELECT label, unnest(made) AS c FROM walk WHERE k = size)
SELECT label, c.id AS vec_id, c.n AS members, list_aggregate(c.bits, 'string_agg', '') AS prototype FROM ends""")
def sign_prototypes(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy prototypes of each label over the signs of its vectors' first 48 entries."""
    bits = F.expr("aggregate(transform(slice(embedding, 1, 48), (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (s, x) -> s + x)")
    rows = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select("label", "vec_id", bits.alias("bits"))
    return folds.cluster_bits(rows, ["label"], "vec_id", "bits", 48, 17 / 48, 12)


@query(f"WITH RECURSIVE {E}, {of_type('buys', 'purchase')}, {of_type('clicks', 'click')}, {matched_sql(DAY // 4, nearest=True, refs='clicks', preds='buys')} SELECT user_id, pred AS event_id, coalesce(ref_t, pred_t) AS t, ref AS candidate FROM m")
def snap_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases moved to the clicks that confirm them."""
    return folds.confirm_in_order(events(spark, sf, "purchase"), events(spark, sf, "click"), USER, "t", DAY // 4, "event_id", move=True)
