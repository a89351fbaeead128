"""Queries of the range, nearest, as-of and interval joins, and of the event metric built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import joins as j
from ..operators import windows as w
from .common import DAY, HOUR, E, events, of_type, query, runs_sql, table

USER = ["user_id"]
CLICKS, BUYS, ERRORS = of_type("clicks", "click"), of_type("buys", "purchase"), of_type("errors", "error")
BLIND = f"{ERRORS}, blind AS (SELECT user_id, t - {HOUR} AS a, t + {HOUR} AS b FROM errors)"


def _clicks(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf, "click").select("user_id", "event_id", "t", "value")


def _buys(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf, "purchase").select("user_id", "event_id", "t", "value")


def _blind(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf, "error").select("user_id", (F.col("t") - HOUR).alias("start"), (F.col("t") + HOUR).alias("end"))


@query(f"WITH {E}, {CLICKS}, {BUYS} SELECT event_id, user_id, t FROM buys b WHERE EXISTS (SELECT 1 FROM clicks c WHERE c.user_id = b.user_id AND abs(c.t - b.t) <= {2 * HOUR})")
def range_semi(spark: SparkSession, sf: str) -> DataFrame:
    return j.range_semi(_buys(spark, sf), _clicks(spark, sf), USER, "t", 2 * HOUR).select("event_id", "user_id", "t")


@query(f"WITH {E}, {CLICKS}, {BUYS} SELECT event_id, user_id, t FROM buys b WHERE NOT EXISTS (SELECT 1 FROM clicks c WHERE c.user_id = b.user_id AND abs(c.t - b.t) <= {2 * HOUR})")
def range_anti(spark: SparkSession, sf: str) -> DataFrame:
    return j.range_anti(_buys(spark, sf), _clicks(spark, sf), USER, "t", 2 * HOUR).select("event_id", "user_id", "t")


@query(f"WITH {E}, {CLICKS}, {BUYS} SELECT b.event_id, c.event_id AS click_id, c.t - b.t AS delta FROM buys b JOIN clicks c ON c.user_id = b.user_id AND abs(c.t - b.t) <= {6 * HOUR}")
def range_join(spark: SparkSession, sf: str) -> DataFrame:
    found = j.within(_buys(spark, sf), _clicks(spark, sf), USER, "t", 6 * HOUR)
    return found.select("event_id", F.col("r_event_id").alias("click_id"), (F.col("r_t") - F.col("t")).alias("delta"))


NEAREST = """near AS (SELECT * FROM (SELECT b.user_id, b.event_id, b.t, c.event_id AS near_id, c.t - b.t AS delta,
  row_number() OVER (PARTITION BY b.event_id ORDER BY abs(c.t - b.t), c.t, c.event_id) AS k FROM buys b JOIN clicks c USING (user_id)) WHERE k = 1)"""


@query(f"WITH {E}, {CLICKS}, {BUYS}, {NEAREST} SELECT event_id, near_id, delta FROM near")
def nearest_prev_next(spark: SparkSession, sf: str) -> DataFrame:
    found = j.nearest(_buys(spark, sf), _clicks(spark, sf), USER, "t", "event_id")
    return found.where("near_id IS NOT NULL").select("event_id", "near_id", "delta")


@query(f"WITH {E}, {CLICKS}, {BUYS} SELECT b.event_id, c.event_id AS click_id, b.t - c.t AS age FROM buys b ASOF JOIN (SELECT user_id, t, min(event_id) AS event_id FROM clicks GROUP BY user_id, t) c ON b.user_id = c.user_id AND b.t >= c.t")
def asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    found = j.asof_backward(_buys(spark, sf), _clicks(spark, sf), USER, "t", "event_id").where("prev_id IS NOT NULL")
    return found.select("event_id", F.col("prev_id").alias("click_id"), (F.col("t") - F.col("prev_t")).alias("age"))


RIGID = f"""{NEAREST}, rigid AS (SELECT user_id, count(*) AS n, list_sort(list(delta)) AS d FROM near WHERE abs(delta) <= {DAY} GROUP BY user_id)"""


@query(f"WITH {E}, {CLICKS}, {BUYS}, {RIGID} SELECT user_id, n, d[n // 2 + 1] AS shift FROM rigid WHERE n >= 3")
def rigid_shift(spark: SparkSession, sf: str) -> DataFrame:
    return ev.rigid_shift(_clicks(spark, sf), _buys(spark, sf), "user_id", "t", "event_id", DAY)


OFFSETS = [h * HOUR // 2 for h in range(-12, 13)]


@query(f"""WITH {E}, {CLICKS}, {BUYS}, o AS (SELECT h * {HOUR // 2} AS "offset" FROM generate_series(-12, 12) g(h)),
hits AS (SELECT b.user_id, o."offset", count(*) FILTER (WHERE EXISTS (SELECT 1 FROM clicks c WHERE c.user_id = b.user_id AND c.t BETWEEN b.t + o."offset" - {HOUR // 2} AND b.t + o."offset" + {HOUR // 2})) AS hits
  FROM buys b CROSS JOIN o GROUP BY b.user_id, o."offset"),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hits DESC, abs("offset"), "offset") AS k FROM hits)
SELECT user_id, "offset", hits FROM r WHERE k = 1""")
def offset_grid(spark: SparkSession, sf: str) -> DataFrame:
    grid = j.offset_grid(_buys(spark, sf), _clicks(spark, sf), USER, "t", OFFSETS, HOUR // 2)
    return j.best_offset(grid, USER)


@query(f"WITH {E}, {CLICKS}, {BLIND} SELECT c.event_id, b.a AS start_us, count(*) AS n FROM clicks c JOIN blind b ON b.user_id = c.user_id AND c.t BETWEEN b.a AND b.b GROUP BY c.event_id, b.a")
def interval_contains(spark: SparkSession, sf: str) -> DataFrame:
    held = j.in_intervals(_clicks(spark, sf), _blind(spark, sf), USER, "t", 2 * HOUR)
    return held.groupBy("event_id", F.col("r_start").alias("start_us")).agg(F.count("*").alias("n"))


RUNS = f"{runs_sql('clicks', 4 * HOUR)}, spans AS (SELECT user_id, run_id, count(*) AS n, min(t) AS a, max(t) AS b FROM runs GROUP BY user_id, run_id)"


@query(f"""WITH {E}, {CLICKS}, {BLIND}, {RUNS} SELECT user_id, run_id, n, a AS start_us, b AS end_us FROM spans s
WHERE NOT EXISTS (SELECT 1 FROM blind x WHERE x.user_id = s.user_id AND NOT (s.b < x.a - {HOUR} OR s.a > x.b + {HOUR}))""")
def overlap_drop(spark: SparkSession, sf: str) -> DataFrame:
    runs = w.session_runs(_clicks(spark, sf), USER, "t", 4 * HOUR, ["event_id"])
    kept = j.overlapping(runs, _blind(spark, sf), USER, DAY, HOUR, "left_anti")
    return kept.select("user_id", "run_id", "n", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(f"""WITH {E}, {CLICKS}, {BLIND}, {RUNS}
SELECT user_id, run_id, a AS start_us, round(least(1e0, coalesce((SELECT sum(greatest(0, least(s.b, x.b) - greatest(s.a, x.a))) FROM blind x WHERE x.user_id = s.user_id), 0) / greatest(s.b - s.a, 1)), 6) AS covered FROM spans s""")
def coverage_ratio(spark: SparkSession, sf: str) -> DataFrame:
    runs = w.session_runs(_clicks(spark, sf), USER, "t", 4 * HOUR, ["event_id"])
    found = j.coverage(runs, _blind(spark, sf), USER, DAY)
    return found.select("user_id", "run_id", F.col("start").alias("start_us"), F.round("covered", 6).alias("covered"))


FREE = f"""free AS (SELECT c.* FROM clicks c
  WHERE NOT EXISTS (SELECT 1 FROM buys p WHERE p.user_id = c.user_id AND abs(p.t - c.t) <= {2 * HOUR})
  AND NOT EXISTS (SELECT 1 FROM blind x WHERE x.user_id = c.user_id AND c.t BETWEEN x.a AND x.b))"""


@query(f"WITH {E}, {CLICKS}, {BUYS}, {BLIND}, {FREE}, {runs_sql('free', 4 * HOUR)} SELECT user_id, count(DISTINCT run_id) AS n_extra, count(*) AS n_clicks FROM runs GROUP BY user_id")
def excused_extras(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks that neither a purchase nor a blind window excuses, counted as runs."""
    free = j.range_anti(_clicks(spark, sf), _buys(spark, sf), USER, "t", 2 * HOUR)
    free = j.in_intervals(free, _blind(spark, sf), USER, "t", 2 * HOUR, how="left_anti")
    runs = w.session_runs(free, USER, "t", 4 * HOUR, ["event_id"])
    return runs.groupBy("user_id").agg(F.count("*").alias("n_extra"), F.sum("n").alias("n_clicks"))


RULES = ev.EventRules(gap=4 * HOUR, tolerance=2 * HOUR, fast_period=HOUR, fast_min=4, hole=3 * HOUR, excuse=3 * HOUR, pad=HOUR, shift_max=12 * HOUR, min_pairs=4, grid=DAY)

EVENT_SQL = f"""WITH {E}, {BUYS}, {CLICKS}, {BLIND},
pairs AS (SELECT * FROM (SELECT c.user_id, b.t - c.t AS delta, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(b.t - c.t), b.t, b.event_id) AS k FROM clicks c JOIN buys b USING (user_id)) WHERE k = 1 AND abs(delta) <= {RULES.shift_max}),
shifts AS (SELECT user_id, CASE WHEN count(*) >= {RULES.min_pairs} THEN quantile_cont(delta, 0.5) ELSE 0 END AS shift FROM pairs GROUP BY user_id),
marks AS (SELECT c.user_id, c.event_id, greatest(0, c.t + CAST(floor(coalesce(s.shift, 0) + 0.5) AS BIGINT)) AS t FROM clicks c LEFT JOIN shifts s USING (user_id)),
{runs_sql('buys', RULES.gap, 'refs')},
gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, run_id ORDER BY t, event_id) AS gap FROM refs),
grouped AS (SELECT user_id, run_id, count(*) AS n, min(t) AS a, max(t) AS b, quantile_cont(gap, 0.5) AS period FROM gaps GROUP BY user_id, run_id),
kinds AS (SELECT *, CASE WHEN n = 1 THEN 'single' WHEN period <= {RULES.fast_period} AND n >= {RULES.fast_min} THEN 'fast' ELSE 'countable' END AS kind FROM grouped),
kept AS (SELECT * FROM kinds k WHERE NOT EXISTS (SELECT 1 FROM blind x WHERE x.user_id = k.user_id AND NOT (k.b < x.a - {RULES.pad} OR k.a > x.b + {RULES.pad}))),
held AS (SELECT k.user_id, k.run_id, k.a, k.b, m.t, m.t - lag(m.t) OVER (PARTITION BY k.user_id, k.run_id ORDER BY m.t) AS gap FROM kept k JOIN marks m ON m.user_id = k.user_id AND m.t BETWEEN k.a - {RULES.tolerance} AND k.b + {RULES.tolerance}),
counted AS (SELECT user_id, run_id, count(*) AS found, greatest(coalesce(max(gap), 0), min(t) - min(a), min(b) - max(t), 0) AS hole FROM held GROUP BY user_id, run_id),
judged AS (SELECT k.*, coalesce(c.found, 0) AS found, CASE WHEN k.kind = 'single' THEN coalesce(c.found, 0) >= 1 WHEN k.kind = 'fast' THEN coalesce(c.found, 0) > 0 AND coalesce(c.hole, k.b - k.a + 1) <= {RULES.hole} ELSE coalesce(c.found, 0) = k.n END AS ok FROM kept k LEFT JOIN counted c USING (user_id, run_id)),
free AS (SELECT m.* FROM marks m WHERE NOT EXISTS (SELECT 1 FROM buys r WHERE r.user_id = m.user_id AND abs(r.t - m.t) <= {RULES.excuse})
  AND NOT EXISTS (SELECT 1 FROM blind x WHERE x.user_id = m.user_id AND m.t BETWEEN x.a - {RULES.pad} AND x.b + {RULES.pad})
  AND NOT EXISTS (SELECT 1 FROM kinds k WHERE k.kind = 'fast' AND k.user_id = m.user_id AND m.t BETWEEN k.a AND k.b)),
{runs_sql('free', RULES.gap, 'extra')},
extras AS (SELECT user_id, count(DISTINCT run_id) AS n_extra FROM extra GROUP BY user_id),
per_user AS (SELECT user_id, count(*) FILTER (WHERE ok) AS tp, count(*) FILTER (WHERE NOT ok) AS fn, count(*) FILTER (WHERE kind = 'single') AS singles, count(*) FILTER (WHERE kind = 'single' AND ok) AS singles_ok FROM judged GROUP BY user_id),
event_counts AS (SELECT coalesce(p.user_id, x.user_id) AS user_id, coalesce(p.tp, 0) AS tp, coalesce(x.n_extra, 0) AS fp, coalesce(p.fn, 0) AS fn, coalesce(p.singles, 0) AS singles, coalesce(p.singles_ok, 0) AS singles_ok FROM per_user p FULL JOIN extras x ON p.user_id = x.user_id)"""


def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    judged, extras = ev.judge_runs(_buys(spark, sf), _clicks(spark, sf), _blind(spark, sf), "user_id", "t", "event_id", RULES)
    return ev.event_totals(judged, extras, "user_id")


@query(f"{EVENT_SQL} SELECT * FROM event_counts")
def event_metric(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases as labelled events, clicks as marks, hours around errors as blind windows; per user."""
    return event_counts(spark, sf)


@query(f"{EVENT_SQL}, ranked AS (SELECT *, tp / (tp + fn) AS share FROM event_counts WHERE tp + fn > 0) SELECT user_id, tp, fp, fn, round(share, 6) AS share FROM ranked ORDER BY share, fp DESC, user_id LIMIT 8")
def top_worst(spark: SparkSession, sf: str) -> DataFrame:
    """The eight users with the smallest share of right events: a report."""
    ranked = event_counts(spark, sf).where("tp + fn > 0").withColumn("share", F.col("tp") / (F.col("tp") + F.col("fn")))
    return ranked.orderBy("share", F.desc("fp"), "user_id").limit(8).select("user_id", "tp", "fp", "fn", F.round("share", 6).alias("share"))


@query(f"""WITH {E}, {CLICKS}, strong AS (SELECT * FROM e WHERE event_type = 'purchase' AND value >= 80)
SELECT user_id, count(*) AS witnesses, count(*) FILTER (WHERE NOT near) AS orphans, round(count(*) FILTER (WHERE NOT near) / count(*), 6) AS share, count(*) >= 3 AND count(*) FILTER (WHERE NOT near) / count(*) > 0.5 AS rejected
FROM (SELECT s.*, EXISTS (SELECT 1 FROM clicks c WHERE c.user_id = s.user_id AND abs(c.t - s.t) <= {DAY}) AS near FROM strong s) GROUP BY user_id""")
def witness_veto(spark: SparkSession, sf: str) -> DataFrame:
    found = ev.orphan_share(_buys(spark, sf).where("value >= 80"), _clicks(spark, sf), "user_id", "t", DAY)
    return found.withColumn("share", F.round("share", 6))


@query(f"""WITH {E}, ranked AS (SELECT *, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS rank FROM e),
best AS (SELECT user_id, min(rank) AS best FROM ranked WHERE rank IS NOT NULL GROUP BY user_id)
SELECT r.user_id, r.event_type AS source, count(*) AS n FROM ranked r JOIN best b ON r.user_id = b.user_id AND r.rank = b.best GROUP BY r.user_id, r.event_type""")
def mark_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's marks come from the first source that has any: purchases, clicks, views."""
    sources = [(k, events(spark, sf, k).select("user_id", "event_id", "t")) for k in ("purchase", "click", "view")]
    return ev.mark_ladder(sources, "user_id").groupBy("user_id", "source").agg(F.count("*").alias("n"))


SPLICE = {"total": 2_000_000_000 * 1_000_000, "lead": HOUR // 10, "fade": HOUR // 20, "budget": 2 * HOUR, "insert": HOUR}


@query(f"""WITH {E}, s AS (SELECT event_id, user_id, t, greatest(0, t - {SPLICE['lead']}) AS insert_start FROM e),
b AS (SELECT *, least(coalesce(lead(insert_start) OVER (PARTITION BY user_id ORDER BY insert_start, t, event_id), {SPLICE['total']}), {SPLICE['total']}) AS bound FROM s),
i AS (SELECT *, least(insert_start + {SPLICE['insert']}, bound) AS insert_end FROM b),
m AS (SELECT *, least(insert_end + {SPLICE['fade']}, bound) AS mute_end FROM i)
SELECT event_id, insert_start, insert_end, mute_end, least(mute_end + {SPLICE['budget']}, bound) AS duck_end FROM m""")
def splice_plan(spark: SparkSession, sf: str) -> DataFrame:
    shots = events(spark, sf).select("event_id", "user_id", "t")
    plan = ev.splice_plan(shots, USER, "t", order=["event_id"], **SPLICE)
    return plan.select("event_id", "insert_start", "insert_end", "mute_end", "duck_end")


@query(f"""WITH {E}, {CLICKS}, {BUYS}, o AS (SELECT h * {HOUR} AS step FROM generate_series(-2, 1) g(h))
SELECT DISTINCT user_id, (t + step) // {HOUR} AS slot FROM buys CROSS JOIN o""")
def explode_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hours to look at around each purchase."""
    steps = F.explode(F.array(*[F.lit(h * HOUR) for h in range(-2, 2)]))
    return _buys(spark, sf).withColumn("step", steps).select("user_id", F.floor((F.col("t") + F.col("step")) / HOUR).cast("long").alias("slot")).distinct()


RATES = {"Brand#11": 600, "Brand#12": 750, "Brand#13": 666, "Brand#21": 800, "Brand#22": 857}


@query(f"""WITH rates AS (SELECT * FROM (VALUES {', '.join(f"('{b}', {r})" for b, r in RATES.items())}) v(p_brand, rate)) SELECT p_partkey, coalesce(rate, 400) AS rate FROM part LEFT JOIN rates USING (p_brand)""")
def dim_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rates = spark.createDataFrame(list(RATES.items()), "p_brand string, rate int")
    return j.with_dimension(table(spark, sf, "part"), rates, "p_brand", "rate", 400).select("p_partkey", "rate")


@query(f"""WITH {E}, {CLICKS}, {BUYS},
near AS (SELECT * FROM (SELECT c.event_id, c.user_id, c.value, b.event_id AS candidate, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(b.t - c.t), b.t, b.event_id) AS k, abs(b.t - c.t) AS d FROM clicks c JOIN buys b USING (user_id)) WHERE k = 1 AND d <= {DAY}),
best AS (SELECT *, row_number() OVER (PARTITION BY user_id, candidate ORDER BY value DESC, event_id) AS r FROM near)
SELECT user_id, candidate, value AS score, event_id AS frame FROM best WHERE r = 1""")
def assign_to_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Every purchase with the strongest of the clicks that have it as their nearest."""
    return j.assign_to_nearest(_clicks(spark, sf), _buys(spark, sf), USER, "t", "event_id", "event_id", "value", DAY)
