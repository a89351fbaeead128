"""Queries of the tracking operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tracking as tr
from ..operators import windows as w
from .common import DAY, HOUR, E, events, of_type, query, runs_sql, table

USER = ["user_id"]
ORDER = ["t", "event_id"]
W = "OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN"
CLICKS, BUYS = of_type("clicks", "click"), of_type("buys", "purchase")
OFFSETS = [-12 * HOUR, 0, 12 * HOUR]


@query(f"""WITH {E}, {BUYS}, o AS (SELECT unnest([{', '.join(map(str, OFFSETS))}]) AS off),
w AS (SELECT b.user_id, b.event_id, o.off, e.event_id AS frame, row_number() OVER (PARTITION BY b.event_id, o.off ORDER BY abs(e.t - b.t - o.off), e.t, e.event_id) AS k
  FROM buys b CROSS JOIN o JOIN e ON e.user_id = b.user_id AND abs(e.t - b.t - o.off) <= {6 * HOUR})
SELECT user_id, event_id, string_agg(frame, ',' ORDER BY off) AS frames FROM w WHERE k = 1 GROUP BY user_id, event_id HAVING count(*) = 3""")
def candidate_stacks(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases with an event near half a day before, near themselves and near half a day after."""
    rows = events(spark, sf).select("user_id", "event_id", "t")
    buys = events(spark, sf, "purchase").select("user_id", F.col("event_id").alias("buy_id"), "t")
    found = tr.candidate_stacks(buys, rows, USER, "t", "buy_id", OFFSETS, 6 * HOUR, "event_id")
    return found.select("user_id", F.col("buy_id").alias("event_id"), F.array_join("frames", ",").alias("frames"))


BOXES = "boxes AS (SELECT s_nationkey % 5 AS zone, (s_suppkey * 37) % 400 AS x0, (s_suppkey * 91) % 400 AS y0, (s_suppkey * 37) % 400 + 30 AS x1, (s_suppkey * 91) % 400 + 30 AS y1 FROM supplier)"


@query(f"""WITH {BOXES}, p AS (SELECT p_partkey, p_partkey % 5 AS zone, (p_partkey * 13) % 430 AS x, (p_partkey * 29) % 430 AS y FROM part)
SELECT p_partkey FROM p WHERE EXISTS (SELECT 1 FROM boxes b WHERE b.zone = p.zone AND p.x BETWEEN b.x0 AND b.x1 AND p.y BETWEEN b.y0 AND b.y1)""")
def point_in_rectangle(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    points = table(spark, sf, "part").select("p_partkey", (k % 5).alias("zone"), (k * 13 % 430).alias("x"), (k * 29 % 430).alias("y"))
    boxes = table(spark, sf, "supplier").select((F.col("s_nationkey") % 5).cast("long").alias("zone"), (s * 37 % 400).alias("x0"), (s * 91 % 400).alias("y0"), (s * 37 % 400 + 30).alias("x1"), (s * 91 % 400 + 30).alias("y1"))
    return tr.in_rectangles(points, boxes, ["zone"], 50).select("p_partkey")


ITEMS = "i AS (SELECT p_partkey AS id, p_brand, (p_partkey * 13) % 997 AS x, (p_partkey * 29) % 101 AS y, p_size % 9 + 4 AS h FROM part)"


@query(f"""WITH {ITEMS}, m AS (SELECT a.id, b.id AS "right", row_number() OVER (PARTITION BY a.id ORDER BY b.x, b.id) AS k FROM i a JOIN i b ON a.p_brand = b.p_brand AND b.x > a.x AND b.x - a.x <= 3 * a.h AND abs(b.y - a.y) <= 0.6e0 * a.h)
SELECT id, "right" FROM m WHERE k = 1""")
def right_neighbour(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    items = table(spark, sf, "part").select(k.alias("id"), "p_brand", (k * 13 % 997).alias("x"), (k * 29 % 101).alias("y"), (F.col("p_size") % 9 + 4).alias("h"))
    return tr.right_neighbours(items, ["p_brand"], "id", 3, 0.6, 40)


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY p_brand, p_type), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f) AS k, sum(n) OVER (PARTITION BY p_brand) AS total FROM c)
SELECT p_brand, CASE WHEN n >= total * 0.06e0 THEN p_type END AS mode, n FROM r WHERE k = 1""")
def mode_first(spark: SparkSession, sf: str) -> DataFrame:
    return tr.mode_first(table(spark, sf, "part"), ["p_brand"], "p_type", "p_partkey", 0.06)


@query(f"""WITH {E}, v AS (SELECT *, floor(value / 10) AS v FROM e), {runs_sql('v', 4 * HOUR)},
d AS (SELECT *, v - lag(v) OVER (PARTITION BY user_id, run_id ORDER BY t, event_id) AS d, row_number() OVER (PARTITION BY user_id, run_id ORDER BY t, event_id) AS k FROM runs)
SELECT user_id, run_id, count(*) AS n, coalesce(sum(-d) FILTER (WHERE d < 0), 0e0) AS drops, count(*) FILTER (WHERE d > 0) AS reloads, coalesce(bool_or(d < -3), false) AS broken,
string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ' -> ' ORDER BY k) FILTER (WHERE k <= 10) AS path FROM d GROUP BY user_id, run_id""")
def episode_delta(spark: SparkSession, sf: str) -> DataFrame:
    reads = events(spark, sf).withColumn("v", F.floor(F.col("value") / 10).cast("double"))
    return tr.episodes(reads, USER, "t", "v", 4 * HOUR, ["event_id"])


PERIODS = {"2h": 2 * HOUR, "3h": 3 * HOUR, "4h": 4 * HOUR, "6h": 6 * HOUR}


@query(f"""WITH {E}, {runs_sql('e', 4 * HOUR)}, f AS (SELECT user_id, run_id, min(t) AS t0, max(t) - min(t) AS span, count(*) AS n FROM runs GROUP BY user_id, run_id HAVING count(*) >= 3),
p AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {p})" for n, p in PERIODS.items())}) v(name, period)),
w AS (SELECT r.user_id, r.run_id, p.name, p.period, max(abs((r.t - f.t0) - floor((r.t - f.t0) / p.period + 0.5) * p.period)) AS worst FROM runs r JOIN f USING (user_id, run_id) JOIN p ON p.period <= f.span GROUP BY r.user_id, r.run_id, p.name, p.period),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, run_id ORDER BY period DESC) AS k FROM w WHERE worst <= {HOUR})
SELECT user_id, run_id, name AS period, CAST(worst AS DOUBLE) AS worst FROM b WHERE k = 1""")
def rhythm_fit(spark: SparkSession, sf: str) -> DataFrame:
    runs = w.sessionize(events(spark, sf), USER, "t", 4 * HOUR, ["event_id"])
    return tr.rhythm_fit(runs, ["user_id", "run_id"], "t", PERIODS, HOUR).withColumn("worst", F.col("worst").cast("double"))


@query(f"""WITH {E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e),
hi AS (SELECT a.event_id, max(b.i) FILTER (WHERE b.i < a.i AND b.value > a.value) AS lo_stop, min(b.i) FILTER (WHERE b.i > a.i AND b.value > a.value) AS hi_stop FROM n a JOIN n b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 10 AND a.i + 10 GROUP BY a.event_id),
m AS (SELECT a.event_id, a.value, least(a.value, min(b.value) FILTER (WHERE b.i < a.i AND b.i > coalesce(h.lo_stop, a.i - 11))) AS l, least(a.value, min(b.value) FILTER (WHERE b.i > a.i AND b.i < coalesce(h.hi_stop, a.i + 11))) AS r
  FROM n a JOIN hi h USING (event_id) JOIN n b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 10 AND a.i + 10 GROUP BY a.event_id, a.value)
SELECT event_id, round(value - greatest(l, r), 6) AS prominence FROM m""")
def prominence(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", F.round(tr.prominence("value", USER, ORDER, 10), 6).alias("prominence"))


@query(f"""WITH {E}, v AS (SELECT *, CAST(floor(value / 60) AS BIGINT) AS v FROM e),
s AS (SELECT *, CASE WHEN count(*) {W} 2 PRECEDING AND CURRENT ROW) = 3 AND min(v) {W} 2 PRECEDING AND CURRENT ROW) = max(v) {W} 2 PRECEDING AND CURRENT ROW) THEN v END AS h FROM v)
SELECT event_id, coalesce(last_value(h IGNORE NULLS) {W} 5 PRECEDING AND CURRENT ROW), -1) AS held FROM s""")
def held_value(spark: SparkSession, sf: str) -> DataFrame:
    reads = events(spark, sf).withColumn("v", F.floor(F.col("value") / 60).cast("long"))
    return tr.with_held_value(reads, USER, ORDER, "v").select("event_id", F.coalesce("held", F.lit(-1).cast("long")).alias("held"))


@query(f"""WITH {E}, f AS (SELECT event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS low, min(value) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND {6 * HOUR} FOLLOWING) AS keep FROM e)
SELECT event_id FROM f WHERE value - low >= 40 AND keep >= 0.75e0 * value""")
def flood_windows(spark: SparkSession, sf: str) -> DataFrame:
    return tr.floods(events(spark, sf), USER, "t", "value", 40, DAY, 6 * HOUR, 0.75).select("event_id")


@query(f"""WITH {E}, x AS (SELECT user_id, t, event_id, value - avg(value) OVER (PARTITION BY user_id) AS x FROM e), l AS (SELECT user_id, x, {', '.join(f'x * lag(x, {k}) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p{k}' for k in range(1, 6))} FROM x),
s AS (SELECT user_id, sum(x * x) AS e, {', '.join(f'sum(p{k}) AS s{k}' for k in range(1, 6))} FROM l GROUP BY user_id HAVING sum(x * x) > 0)
{' UNION ALL '.join(f'SELECT user_id, {k} AS lag, round(s{k} / e, 5) AS r FROM s' for k in range(1, 6))}""")
def autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    return tr.autocorrelation(events(spark, sf), USER, ORDER, "value", 5).withColumn("r", F.round("r", 5))
